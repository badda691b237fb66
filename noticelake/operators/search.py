"""Keyword search: the query syntax of a search box compiled to one predicate."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, functions as F

from noticelake.functions.text import let, search_document, tokens

OCCURRENCE_WEIGHT = 0.1  # Fixed value: rank contribution of one matching word.


class Term(NamedTuple):
    words: tuple[str, ...]  # several words form a phrase
    negated: bool


def parse_query(q: str) -> list[list[Term]]:
    """Alternatives of conjunctions: words are AND-ed, ``or`` separates
    alternatives, quotes make a phrase, a leading ``-`` excludes."""
    groups: list[list[Term]] = [[]]
    for match in re.finditer(r'(-?)"([^"]*)"|(-?)([^\s"]+)', q):
        negated = bool(match.group(1) or match.group(3))
        text = match.group(2) if match.group(2) is not None else match.group(4)
        if match.group(4) is not None and text.lower() == "or" and not negated:
            groups.append([])
            continue
        words = tuple(re.findall(r"[\wঀ-৿]+", text.lower()))
        if words:
            groups[-1].append(Term(words, negated))
    return [g for g in groups if g]


def document(df_alias: str = "") -> Column:
    c = lambda n: F.col(f"{df_alias}{n}")
    return search_document(c("title"), c("description"), c("package_no"), c("reference_no"),
                           c("organization_path"), c("district"), c("project_name"))


def _holds(words: Column, term: Term) -> Column:
    if len(term.words) == 1:
        found = F.array_contains(words, term.words[0])
    else:
        text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        found = F.contains(text, F.lit(f" {' '.join(term.words)} "))
    return ~found if term.negated else found


def matches(words: Column, q: str) -> Column:
    """True where the tokens satisfy the query; an empty query matches nothing."""
    groups = [reduce(lambda a, b: a & b, [_holds(words, t) for t in g]) for g in parse_query(q)]
    return reduce(lambda a, b: a | b, groups) if groups else F.lit(False)


def occurrences(words: Column, wanted: Column) -> Column:
    """How many of the tokens are in ``wanted``."""
    return F.size(F.filter(words, lambda w: F.array_contains(wanted, w)))


def rank(words: Column, q: str) -> Column:
    """Relevance: matching occurrences of the query's positive words."""
    positive = sorted({w for g in parse_query(q) for t in g if not t.negated for w in t.words})
    wanted = F.array(*[F.lit(w) for w in positive]) if positive else F.array().cast("array<string>")
    return occurrences(words, wanted) * F.lit(OCCURRENCE_WEIGHT)


def substring(c: Column, q: str) -> Column:
    """Case-insensitive substring; wildcard characters in ``q`` are literal."""
    return F.contains(F.lower(c), F.lit(q.lower()))


def search_filter(q: str) -> Column:
    """Full text over the search document, or a fragment of a number."""
    return (let(tokens(document()), lambda words: matches(words, q))
            | F.coalesce(substring(F.col("package_no"), q), F.lit(False))
            | F.coalesce(substring(F.col("reference_no"), q), F.lit(False)))
