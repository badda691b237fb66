"""Scalars of the notice domain: dates, money, codes, statuses, display forms."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from noticelake.functions.text import blank_to_null, squash
from noticelake.schemas import CRORE, MONEY

LOCAL_ZONE = "Asia/Dhaka"

# Published label -> vocabulary.
NATURES = {"goods": "goods", "works": "works", "services": "services", "service": "services"}
STATUSES = {"live": "live", "closed": "closed", "cancelled": "cancelled",
            "canceled": "cancelled", "archived": "closed", "awarded": "awarded"}
# The portal's own wording on its demonstration records.
TEST_RECORD_PHRASES = ("this is an invalid tender", "used to explain corrigendum process")
# A notice without a closing date counts as open for this long.
STALE_DAYS = 180
MIN_DESCRIPTION_CHARS = 60


def lookup(c: Column, table: dict[str, str], default: str) -> Column:
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(mapping, F.lower(c)), F.lit(default))


def nature(c: Column) -> Column:
    return lookup(c, NATURES, "other")


def status(c: Column) -> Column:
    return lookup(c, STATUSES, "live")


def local_timestamp(c: Column) -> Column:
    """'13-Sep-2026 13:00', '13-Sep-2026' or '13/09/2026' in local time -> UTC."""
    text = squash(c)
    naive = F.coalesce(
        F.when(text.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4} \d{1,2}:\d{1,2}$"),
               F.try_to_timestamp(text, F.lit("d-MMM-yyyy H:m"))),
        F.when(text.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
               F.try_to_timestamp(text, F.lit("d-MMM-yyyy"))),
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"),
               F.try_to_timestamp(text, F.lit("d/M/yyyy"))),
    )
    return F.to_utc_timestamp(naive, LOCAL_ZONE)


def closing_timestamp(c: Column) -> Column:
    """As :func:`local_timestamp`, but a bare date means the end of that day."""
    utc = local_timestamp(c)
    local = F.from_utc_timestamp(utc, LOCAL_ZONE)
    end_of_day = F.to_utc_timestamp(local + F.expr("INTERVAL '23:59' HOUR TO MINUTE"), LOCAL_ZONE)
    return F.when(local == F.date_trunc("day", local), end_of_day).otherwise(utc)


def _number(c: Column, pattern: str, kind) -> Column:
    digits = F.translate(c, "০১২৩৪৫৬৭৮৯", "0123456789")
    found = F.regexp_replace(F.regexp_extract(digits, pattern, 0), ",", "")
    return blank_to_null(found).try_cast(kind)


def money(c: Column) -> Column:
    """First amount in the text, separators dropped; zero means unknown."""
    amount = _number(c, r"[0-9,]+(\.[0-9]+)?", MONEY)
    return F.when(amount > 0, amount)


def award_value(c: Column) -> Column:
    """Published award figure, unconverted; zero is kept, negative is unknown."""
    amount = _number(c, r"-?[0-9,]+(\.[0-9]+)?", CRORE)
    return F.when(amount >= 0, amount)


def method_code(c: Column) -> Column:
    """'Open Tendering Method (OTM)' -> 'OTM'; text without a code stays whole."""
    text = F.trim(c)
    code = blank_to_null(F.regexp_extract(text, r"\(([A-Za-z]{2,6})\)\s*$", 1))
    return F.coalesce(F.upper(code), blank_to_null(text))


def derived_status(published_at: Column, closing_at: Column, as_of: Column) -> Column:
    """Live or closed from dates alone; an undated notice is closed, never live."""
    too_old = published_at < as_of - F.expr(f"INTERVAL {STALE_DAYS} DAYS")
    return (F.when(closing_at <= as_of, "closed")
            .when(closing_at.isNotNull(), "live")
            .when(published_at.isNull() | too_old, "closed")
            .otherwise("live"))


def effective_status(status_col: Column, closing_at: Column, as_of: Column) -> Column:
    """Stored status, except that a live notice past its closing time is closed."""
    return F.when((status_col == "live") & (closing_at <= as_of), "closed").otherwise(status_col)


def countdown(closing_at: Column, as_of: Column) -> Column:
    """'9d 16h left', '5h 3m left', '40m left', 'closed' or a dash."""
    micros = F.unix_micros(closing_at) - F.unix_micros(as_of)
    left = F.floor(micros / F.lit(1_000_000)).cast("long")
    days = F.floor(left / 86400)
    hours = F.floor((left % 86400) / 3600)
    minutes = F.floor((left % 3600) / 60)
    return (F.when(closing_at.isNull(), "—")
            .when(micros <= 0, "closed")
            .when(days > 0, F.format_string("%dd %dh left", days, hours))
            .when(hours > 0, F.format_string("%dh %dm left", hours, minutes))
            .otherwise(F.format_string("%dm left", minutes)))


def urgency(closing_at: Column, as_of: Column) -> Column:
    micros = F.unix_micros(closing_at) - F.unix_micros(as_of)
    hour = 3_600_000_000
    return (F.when(closing_at.isNull(), "")
            .when(micros <= 0, "closed")
            .when(micros <= 24 * hour, "urgent")
            .when(micros <= 72 * hour, "soon")
            .otherwise(""))


def lakh_format(amount: Column) -> Column:
    """Taka with South Asian grouping: last three digits, then pairs."""
    whole = F.abs(amount.cast("decimal(38,6)"))
    digits = F.floor(whole).cast("decimal(38,0)").cast("string")
    head = F.substring(digits, F.lit(1), F.length(digits) - 3)
    pairs = F.reverse(F.regexp_replace(F.reverse(head), r"(..)(?=.)", "$1,"))
    grouped = (F.when(F.length(digits) > 3, F.concat(pairs, F.lit(","), F.right(digits, F.lit(3))))
               .otherwise(digits))
    return F.when(amount.isNull(), "—").otherwise(F.concat(F.lit("৳"), grouped))


def display_local(ts: Column) -> Column:
    local = F.date_format(F.from_utc_timestamp(ts, LOCAL_ZONE), "dd MMM yyyy, hh:mm a")
    return F.coalesce(local, F.lit("—"))


def normalize_phone(c: Column) -> Column:
    """+8801XXXXXXXXX, or NULL when the text is not a mobile number."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\-()]", "")
    local = F.regexp_extract(bare, r"^(?:\+?880|0)(1[3-9]\d{8})$", 1)
    return F.when(local != "", F.concat(F.lit("+880"), local))


def valid_email(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def minutes_since(ts: Column, as_of: Column) -> Column:
    minutes = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(60_000_000))
    return F.when(ts.isNotNull(), F.greatest(F.lit(0).cast("long"), minutes))


def is_fresh(ts: Column, as_of: Column, within_minutes: int = 30) -> Column:
    return F.coalesce(minutes_since(ts, as_of) <= within_minutes, F.lit(False))


def query_url(base: str, path: str, key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{base}{path}?{key}="), F.url_encode(value))
