"""Text functions: normalization, tokens, slugs, digests, embedding texts."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The characters Python's str.split() treats as whitespace,
# written out because Java's and RE2's \s differ from it and from each other.
WHITESPACE = (
    r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Word characters, with the Bangla block spelled out so that
# vowel signs (combining marks) stay inside their word.
WORD = r"[\p{L}\p{N}_\x{0980}-\x{09FF}]+"

# Words that never become search keywords. The second group is
# trade boilerplate found in nearly every business description.
STOPWORDS = (
    "a an and are as at be by for from has have in is it its of on or our "
    "that the their they this to we will with you your "
    "work works service services supply company limited ltd firm business "
    "do does doing govt government office offices"
).split()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Spark recomputes a repeated expression inside filters and lambda bodies; a
    lambda variable is bound once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def squash(c: Column) -> Column:
    """Collapse whitespace runs to one space and trim; never returns NULL for ''."""
    return F.trim(F.regexp_replace(c, WHITESPACE + "+", " "))


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode NFC. Spark has no built-in, so this is an Arrow batch UDF that is
    sent NULL for pure ASCII values, which need no normalization."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def normalize_text(c: Column) -> Column:
    """NFC, whitespace collapsed, '' becomes NULL."""
    return blank_to_null(squash(nfc(c)))


def tokens(c: Column) -> Column:
    """Lowercase words in text order, duplicates kept."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1),
                      F.array().cast("array<string>"))


def is_keyword(word: Column) -> Column:
    """Three characters or more, not a stopword, not a bare number."""
    return (F.length(word) >= 3) & ~word.isin(STOPWORDS) & ~word.rlike(r"^\p{Nd}+$")


def slug(c: Column) -> Column:
    """ASCII slug; a trailing '-' is kept because published links contain it."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def text_digest(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def truncated(c: Column, limit: int) -> Column:
    return F.left(c, F.lit(limit))


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in phrases])


def joined(*parts: Column) -> Column:
    """Trimmed non-blank parts joined by a space."""
    return F.concat_ws(" ", *[blank_to_null(F.trim(p)) for p in parts])


def notice_text(title: Column, description: Column) -> Column:
    """Text a notice is embedded from. Title and description often repeat each
    other, so when one contains the other only the longer is kept."""
    t, d = (blank_to_null(F.trim(c)) for c in (title, description))
    return (F.when(F.contains(t, d), t)
            .when(F.contains(d, t), d)
            .otherwise(F.concat_ws(" ", t, d)))


def profile_text(description: Column, keywords: Column, enlistment: Column,
                 experience: Column) -> Column:
    """Text a user profile is embedded from and its keywords are taken from."""
    return joined(description, F.array_join(keywords, " "),
                  F.array_join(enlistment, " "), experience)


def search_document(title: Column, description: Column, package_no: Column,
                    reference_no: Column, organization: Column, district: Column,
                    project: Column) -> Column:
    return F.concat_ws(" ", title, description, package_no, reference_no,
                       organization, district, project)


def meta_json(meta: Column) -> Column:
    """Free-form payload metadata as JSON text."""
    return F.to_json(meta)
