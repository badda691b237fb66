"""Table-driven checks of the scalar functions."""

from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from noticelake.functions import text as X, values as V
from noticelake.operators import search
from noticelake.sources import parse as P


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def apply(spark, values, fn, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(fn(F.col("v"))).collect()]


CASES = [
    # Dhaka is six hours ahead of UTC; dates alone are midnight there.
    (V.local_timestamp, {
        "05-Mar-2031 06:30": datetime(2031, 3, 5, 0, 30), "9-nov-2030": datetime(2030, 11, 8, 18),
        "28/02/2031": datetime(2031, 2, 27, 18), "\t29-Feb-2032  00:05 ": datetime(2032, 2, 28, 18, 5),
        "30-Feb-2032": None, "soon": None, "": None, None: None}),
    (V.closing_timestamp, {
        "02-Jun-2031": datetime(2031, 6, 2, 17, 59), "02-Jun-2031 11:45": datetime(2031, 6, 2, 5, 45),
        "02-Jun-2031 00:00": datetime(2031, 6, 2, 17, 59), "later": None}),
    (V.money, {"12,34,567.8": D("1234567.80"), "Tk. 75": D("75.00"), "0.00": None, " ": None,
               None: None, "৯৮৭": D("987.00"), ",,": None}),
    (V.award_value, {"2.5": D("2.5000"), "0.00004": D("0.0000"), "7,001.25": D("7001.2500"),
                     "unknown": None, "00": D("0.0000"), "-0.1": None}),
    (V.method_code, {"Request For Quotation (RFQ)": "RFQ", "Two Stage (tstm)": "TSTM",
                     "No code here": "No code here", "": None, None: None}),
    (V.nature, {"GOODS": "goods", "Services": "services", "Lease": "other", None: "other"}),
    (V.status, {"Cancelled": "cancelled", "Closed": "closed", "?": "live", None: "live"}),
    (X.normalize_text, {"  a   b ": "a b", "   ": None, None: None,
                        "ড়া": "ড়া", "ড়া": "ড়া",
                        "é": "é"}),
    (X.slug, {"LGED, Dhaka (HQ)": "lged-dhaka-hq-"}),
    (V.normalize_phone, {"01712345678": "+8801712345678", "+880 1712-345678": "+8801712345678",
                         "8801712345678": "+8801712345678", "0121234567": None, None: None}),
    (V.valid_email, {"a@b.cd": True, "a b@c.d": False, "a@b": False, None: False}),
    (P.total_pages, {'<input id="totalPages" type="hidden" value="377">': 377, "none": None}),
    (P.split_categories, {"Works; Roads , Bridges;": ["Works", "Roads", "Bridges"], None: []}),
]


@pytest.mark.parametrize("fn,table", CASES, ids=[c[0].__name__ for c in CASES])
def test_scalar(spark, fn, table):
    assert apply(spark, list(table), fn) == list(table.values())


def test_lakh_format(spark):
    assert apply(spark, [D("1234567.89"), D("999"), D("100000"), D("-100000.5"), None], V.lakh_format,
                 "decimal(18,2)") == ["৳12,34,567", "৳999", "৳1,00,000", "৳1,00,000", "—"]


def test_countdown_and_urgency(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    times = [datetime(2026, 1, 10, 16, 30), datetime(2026, 1, 1, 5, 3), datetime(2026, 1, 1, 0, 40),
             datetime(2026, 1, 1), datetime(2026, 1, 3, 23), None]
    assert apply(spark, times, lambda c: V.countdown(c, now), "timestamp") == [
        "9d 16h left", "5h 3m left", "40m left", "closed", "2d 23h left", "—"]
    assert apply(spark, times, lambda c: V.urgency(c, now), "timestamp") == [
        "", "urgent", "urgent", "closed", "soon", ""]


@pytest.mark.parametrize("published,closing,status", [
    ("2014-01-01", None, "closed"), ("2026-08-25", None, "live"), ("2026-03-05", None, "live"),
    ("2026-03-03", None, "closed"), (None, None, "closed"), ("2026-08-01", "2026-09-02", "live"),
    ("2026-08-01", "2026-09-01", "closed")])
def test_offline_status(spark, published, closing, status):
    # 2026-03-05 is exactly 180 days before the clock.
    at = lambda v: F.lit(v).cast("timestamp")
    got = spark.range(1).select(V.derived_status(at(published), at(closing), at("2026-09-01"))).first()[0]
    assert got == status


@pytest.mark.parametrize("parts,expected", [
    (["QRS-77", "Two drains"], ("QRS-77", "Two drains")), (["a/b", "x", "y"], ("a/b", "x y")),
    (["(৫)_x.1", "z"], ("(৫)_x.1", "z")), (["Ropes and knots"], (None, "Ropes and knots")),
    (["Rope 5", "thin"], (None, "Rope 5 thin")), (["Rope", "5 m"], (None, "Rope 5 m")),
    (["7" * 80, "x"], ("7" * 80, "x")), (["7" * 81, "x"], (None, "7" * 81 + " x")), (["q,1", "x"], (None, "q,1 x")),
    (["9"], ("9", None)), ([], (None, None))])
def test_split_brief(spark, parts, expected):
    df = spark.createDataFrame([(parts,)], "p array<string>")
    assert tuple(df.select(*P.split_brief(F.col("p"))).first()) == expected


def test_short_hierarchy_is_right_aligned(spark):
    df = spark.createDataFrame([(["Agency", "Office"],), (["M", "D", "A", "E", "X"],)], "p array<string>")
    rows = [tuple(r[0]) for r in df.select(P.organization_from_lines(F.col("p"))).collect()]
    assert rows == [(None, None, "Agency", "Office"), ("M", "D", "A", "E")]
    offline = df.select(P.organization_offline(F.col("p")).alias("o")).select(P.deepest(F.col("o")))
    assert [r[0] for r in offline.collect()] == ["Office", "D"]


@pytest.mark.parametrize("title,description,expected", [
    ("Road", "Road works at X", "Road works at X"), ("Road works at X", "Road", "Road works at X"),
    ("Road", "Bridge", "Road Bridge"), (None, "Bridge", "Bridge"), (" ", None, ""), ("a", "a", "a")])
def test_notice_text(spark, title, description, expected):
    text = lambda v: F.lit(v).cast("string")
    assert spark.range(1).select(X.notice_text(text(title), text(description))).first()[0] == expected


def test_test_record_phrases_spare_near_misses(spark):
    # Every fixed phrase counts in any case and between other words; words of it alone do not.
    texts = [f"Lot 1. {p.upper()} end" for p in V.TEST_RECORD_PHRASES] + ["invalid", "this tender explains the process", "Tender", None, ""]
    assert apply(spark, texts, lambda c: P.is_test_record(c)) == [True] * len(V.TEST_RECORD_PHRASES) + [False] * 5


def test_keywords_drop_stopwords_numbers_and_short_words(spark):
    words = ["pump", "the", "12", "ab", "work", "পানি", "২০২৬", "x1y"]
    assert apply(spark, words, X.is_keyword) == [True, False, False, False, False, True, False, True]


@pytest.mark.parametrize("q,expected", [
    ("water pump", [True, False, False]), ("water or bridge", [True, True, True]),
    ('"deep pump"', [False, False, False]), ('"pump deep"', [True, False, False]),
    ("water -pump", [False, False, True]), ("", [False, False, False]), ("-pump", [False, True, True])])
def test_search_syntax(spark, q, expected):
    docs = [["water", "pump", "deep"], ["bridge"], ["water"]]
    assert apply(spark, docs, lambda c: search.matches(c, q), "array<string>") == expected
