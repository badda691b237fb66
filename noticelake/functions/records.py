"""Record functions: the version hash, the field diff and its classification."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from noticelake.schemas import HASH_FIELDS, VALUE_FIELDS

NULL_MARK = "␀"
SEPARATOR = "␟"


def as_text(name: str, c: Column) -> Column:
    """Canonical text of a field: money at two decimals, times as UTC micros."""
    kind = VALUE_FIELDS[name]
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    return c.cast(kind).cast("string")


def display_text(name: str, c: Column) -> Column:
    """Field value as shown in a diff."""
    kind = VALUE_FIELDS[name]
    if isinstance(kind, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast(kind).cast("string")


def canonical_hash(get) -> Column:
    """SHA-256 over the version-defining fields; ``get(name)`` gives each Column.

    Each value is cast to its storage type first, so that hash and diff are
    computed from the same value and can never disagree."""
    parts = [F.coalesce(as_text(n, get(n)), F.lit(NULL_MARK)) for n in HASH_FIELDS]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def changed_fields(old, new) -> Column:
    """Map of field -> (old, new) texts over the version-defining fields."""
    entries = [
        F.when(~old(n).eqNullSafe(new(n)),
               F.struct(F.lit(n).alias("key"),
                        F.struct(display_text(n, old(n)).alias("old"),
                                 display_text(n, new(n)).alias("new")).alias("value")))
        for n in HASH_FIELDS
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def first_fill(changes: Column) -> Column:
    """True when every change went from nothing to something."""
    return F.forall(F.map_values(changes), lambda v: v["old"].isNull())


def change_type(changes: Column, status: Column, old_closing: Column,
                new_closing: Column) -> Column:
    """Cancellation, then extension, then enrichment, else corrigendum."""
    return (F.when(status == "cancelled", "cancellation")
            .when(new_closing > old_closing, "extension")
            .when((F.cardinality(changes) > 0) & first_fill(changes), "enrichment")
            .otherwise("corrigendum"))
