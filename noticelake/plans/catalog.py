"""Named queries over the test tables, each beside the SQL that checks it.

A query gets :class:`Tables` and returns a DataFrame. Timestamps leave as text
and money as DOUBLE, so that results compare the same in every engine."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticelake.operators import (
    accounts, alerts, awards, browse, embedding, filters, matching, merge, metrics, quality,
    repair, search)
from noticelake.plans.oracle import AS_OF as SQL_AS_OF, EVENTS_AS_OF as SQL_EVENTS_AS_OF, sql, ts
from noticelake.plans.proxies import AS_OF, EVENTS_AS_OF, MODEL, Tables
from noticelake.functions import text as X, values as V, vectors
from noticelake.schemas import NOTICE
from noticelake.session import cut_lineage, written
from noticelake.sources import archive, parse, tables


class Entry(NamedTuple):
    run: Callable[[Tables], DataFrame]
    oracle: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, body: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name!r} registered twice")
        CATALOG[name] = Entry(fn, sql(body) if body else None)
        return fn
    return register


def stamp(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def dbl(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")


def as_of() -> Column:
    return filters.timestamp(AS_OF)


C = F.col

# ----------------------------------------------------------- scalar functions


@query("normalize_text", r"""
SELECT doc_id, nullif(trim(regexp_replace(nfc_normalize(text),
  '[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+',
  ' ', 'g')), '') AS text FROM documents""")
def _(t):
    return t.raw("documents").select("doc_id", X.normalize_text(C("text")).alias("text"))


@query("tokenize", r"""
SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct,
  array_to_string(w, ' ') AS words
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_\x{0980}-\x{09FF}]+') AS w FROM documents)""")
def _(t):
    w = t.raw("documents").select("doc_id", X.tokens(C("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"),
                    F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
                    F.array_join("w", " ").alias("words"))


@query("local_timestamps", f"""
SELECT id, {ts("x - INTERVAL 6 HOUR")} AS with_time, {ts("date_trunc('day', x) - INTERVAL 6 HOUR")} AS date_only,
  {ts("date_trunc('day', x) - INTERVAL 6 HOUR")} AS slashed, CAST(NULL AS VARCHAR) AS junk,
  {ts("CASE WHEN x = date_trunc('day', x) THEN x + INTERVAL '23 hours 59 minutes' ELSE x END - INTERVAL 6 HOUR")} AS closing
FROM (SELECT id, first_seen_at AS x FROM notices)""")
def _(t):
    x = t.notices().select("id", *[F.date_format("first_seen_at", p).alias(n) for n, p in (
        ("a", "dd-MMM-yyyy HH:mm"), ("b", "d-MMM-yyyy"), ("c", "dd/MM/yyyy"), ("d", "yyyy.MM"))])
    return x.select("id", stamp(V.local_timestamp(C("a"))).alias("with_time"),
                    stamp(V.local_timestamp(C("b"))).alias("date_only"),
                    stamp(V.local_timestamp(C("c"))).alias("slashed"),
                    stamp(V.local_timestamp(C("d"))).alias("junk"),
                    stamp(V.closing_timestamp(C("a"))).alias("closing"))


@query("money_and_codes", """
SELECT o_orderkey AS id, CASE WHEN v > 0 THEN CAST(v AS DOUBLE) END AS money,
  CAST(v AS DOUBLE) AS award_value, substr(o_orderpriority, 3) AS method_plain,
  'M' || chr(CAST(65 + o_orderkey % 26 AS INTEGER)) AS method_code,
  CASE o_orderkey % 4 WHEN 0 THEN 'goods' WHEN 1 THEN 'services' ELSE 'other' END AS nature,
  CASE o_orderkey % 3 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'closed' ELSE 'live' END AS status
FROM (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS v FROM orders)""")
def _(t):
    k = C("o_orderkey")
    amount = F.when(k % 9 == 0, F.lit(0).cast("long")).otherwise(F.floor("o_totalprice"))
    text = F.concat(F.lit("BDT "), F.format_number(amount, 0), F.lit(" only"))
    label = F.when(k % 4 == 0, "Goods").when(k % 4 == 1, "SERVICE").otherwise("misc")
    state = F.when(k % 3 == 0, "Canceled").when(k % 3 == 1, "Archived").otherwise("??")
    code = F.concat(F.lit("Some Method (m"), F.chr((k % 26) + 65), F.lit(") "))
    return t.raw("orders").select(
        k.alias("id"), dbl(V.money(text)).alias("money"), dbl(V.award_value(text)).alias("award_value"),
        V.method_code(F.substring("o_orderpriority", 3, 99)).alias("method_plain"),
        V.method_code(code).alias("method_code"), V.nature(label).alias("nature"),
        V.status(state).alias("status"))


@query("slugs_and_digests", """
SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug,
  sha256(c_name) AS content_hash, left(sha256(c_name), 16) AS digest, left(c_name, 5) AS cut,
  'https://x/s?q=' || url_encode(c_name) AS url, '{"segment":"' || c_mktsegment || '"}' AS meta
FROM customer""")
def _(t):
    return t.raw("customer").select(
        "c_custkey", X.slug(C("c_name")).alias("slug"), X.content_hash(C("c_name")).alias("content_hash"),
        X.text_digest(C("c_name")).alias("digest"), X.truncated(C("c_name"), 5).alias("cut"),
        V.query_url("https://x", "/s", "q", C("c_name")).alias("url"),
        X.meta_json(F.create_map(F.lit("segment"), C("c_mktsegment"))).alias("meta"))


@query("display_formats", f"""
SELECT id, CASE WHEN closing_at IS NULL THEN '—' WHEN s <= 0 THEN 'closed'
    WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h left'
    WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm left'
    ELSE (s // 60) || 'm left' END AS countdown,
  CASE WHEN closing_at IS NULL THEN '' WHEN s <= 0 THEN 'closed' WHEN s <= 86400 THEN 'urgent'
    WHEN s <= 259200 THEN 'soon' ELSE '' END AS urgency,
  coalesce(strftime(closing_at + INTERVAL 6 HOUR, '%d %b %Y, %I:%M %p'), '—') AS local,
  CASE WHEN d IS NULL THEN '—' WHEN length(d) <= 3 THEN '৳' || d
    ELSE '৳' || reverse(regexp_replace(reverse(left(d, length(d) - 3)), '(..)', '\\1,', 'g'))
      || ',' || right(d, 3) END AS amount,
  CASE WHEN closing_at <= {SQL_AS_OF} AND status = 'live' THEN 'closed' ELSE status END AS effective_status,
  CASE WHEN closing_at <= {SQL_AS_OF} THEN 'closed' WHEN closing_at IS NOT NULL THEN 'live'
    WHEN published_at < {SQL_AS_OF} - INTERVAL 180 DAY THEN 'closed' ELSE 'live' END AS derived_status
FROM (SELECT *, CAST(epoch(closing_at) - epoch({SQL_AS_OF}) AS BIGINT) AS s,
        CAST(CAST(floor(tender_security) AS BIGINT) AS VARCHAR) AS d FROM notices)""".replace(
    "reverse(regexp_replace(reverse(left(d, length(d) - 3)), '(..)', '\\1,', 'g'))",
    "ltrim(reverse(regexp_replace(reverse(left(d, length(d) - 3)), '(..)', '\\1,', 'g')), ',')"))
def _(t):
    n, c = t.notices(), C("closing_at")
    return n.select(
        "id", V.countdown(c, as_of()).alias("countdown"), V.urgency(c, as_of()).alias("urgency"),
        V.display_local(c).alias("local"), V.lakh_format(C("tender_security")).alias("amount"),
        V.effective_status(C("status"), c, as_of()).alias("effective_status"),
        V.derived_status(C("published_at"), c, as_of()).alias("derived_status"))


@query("contact_checks", r"""
SELECT signup_id, CASE WHEN regexp_full_match(p, '(\+?880|0)1[3-9][0-9]{8}')
    THEN '+8801' || right(p, 9) END AS phone,
  regexp_full_match(trim(email), '[^@\s]+@[^@\s]+\.[^@\s]+') AS ok_email,
  length(trim(business_description)) >= 60 AS ok_description, coalesce(low <= high, true) AS ok_bounds,
  CASE WHEN lower(c_mktsegment) IN ('goods', 'works', 'services', 'other') THEN 2 ELSE 1 END AS natures_kept,
  coalesce(regexp_full_match(p, '(\+?880|0)1[3-9][0-9]{8}')
    AND regexp_full_match(trim(email), '[^@\s]+@[^@\s]+\.[^@\s]+')
    AND length(trim(business_description)) >= 60 AND coalesce(low <= high, true), false) AS valid
FROM (SELECT *, regexp_replace(phone, '[\s\-()]', '', 'g') AS p FROM signups)""")
def _(t):
    return accounts.expectations(t.signups()).select(
        "signup_id", C("phone_normalized").alias("phone"), "ok_email", "ok_description", "ok_bounds",
        F.size("natures_kept").alias("natures_kept"), "valid")


@query("freshness", f"""
SELECT run_id, greatest(0, CAST(floor((epoch({SQL_EVENTS_AS_OF}) - epoch(finished_at)) / 60) AS BIGINT)) AS minutes,
  floor((epoch({SQL_EVENTS_AS_OF}) - epoch(finished_at)) / 60) <= 30 AS is_fresh FROM runs""")
def _(t):
    now = filters.timestamp(EVENTS_AS_OF)
    return t.runs().select("run_id", V.minutes_since(C("finished_at"), now).alias("minutes"),
                           V.is_fresh(C("finished_at"), now).alias("is_fresh"))


@query("canonical_hashes", """
SELECT external_ref, k, hash FROM hashed""")
def _(t):
    folded = _folded(t)
    return folded.select("external_ref", _sweep(), C("_hash").alias("hash"))


@query("cosine_similarity", """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
  CAST(b.embedding AS DOUBLE[])), 5) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t):
    e = t.raw("embeddings")
    a = e.select(C("vec_id").alias("a"), C("embedding").alias("x"), (C("vec_id") + 1).alias("b"))
    b = e.select(C("vec_id").alias("b"), C("embedding").alias("y"))
    return a.join(b, "b").select("a", "b", F.round(vectors.cosine_similarity(C("x"), C("y")), 5)
                                 .alias("similarity"))


_VECTORS = r"""
SELECT id, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS value, slot
FROM (SELECT id, slot, CAST(count(*) AS DOUBLE) AS n FROM (
  SELECT id, CAST('0x' || left(md5(word), 8) AS BIGINT) % 64 AS slot
  FROM (SELECT {id} AS id, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_\x{{0980}}-\x{{09FF}}]+')) AS word
        FROM {table})) GROUP BY ALL)"""


@query("hashing_vectors", "SELECT id AS doc_id, slot, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 5) AS value FROM ("
       + _VECTORS.format(id="doc_id", text="text", table="documents") + ")")
def _(t):
    v = vectors.hashing_vectors(t.raw("documents"), "doc_id", "text")
    return (v.select("doc_id", F.posexplode("embedding").alias("slot", "value")).filter("value > 0")
            .select("doc_id", C("slot").cast("long").alias("slot"), F.round(dbl("value"), 5).alias("value")))


@query("embed_profiles", "SELECT id AS user_id, slot, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 5) AS value FROM ("
       + _VECTORS.format(id="user_id", text="profile_text", table="profiles") + ")")
def _(t):
    v = embedding.embed_profiles(t.profiles())
    return (v.select("user_id", F.posexplode("embedding").alias("slot", "value")).filter("value > 0")
            .select("user_id", C("slot").cast("long").alias("slot"), F.round(dbl("value"), 5).alias("value")))


@query("embedding_texts", """
SELECT id, CASE WHEN contains(t, d) THEN t WHEN contains(d, t) THEN d
  ELSE concat_ws(' ', t, d) END AS text
FROM (SELECT id, nullif(trim(title), '') AS t, nullif(trim(description), '') AS d FROM notices
      UNION ALL SELECT id + 1000000000, nullif(trim(title), ''), nullif(trim(description), '') FROM corpus)""")
def _(t):
    cols = ["id", "title", "description"]
    both = t.notices().select(*cols).unionByName(t.corpus().select(
        (C("id") + 1000000000).alias("id"), "title", "description"))
    return both.select("id", X.notice_text(C("title"), C("description")).alias("text"))


@query("profile_texts", "SELECT user_id, profile_text AS text FROM profiles")
def _(t):
    return embedding.profile_texts(t.profiles())


# ------------------------------------------------------------------- filters


@query("hard_filter_one_profile", f"""
SELECT id FROM notices WHERE status = 'live' AND closing_at >= {SQL_AS_OF} + INTERVAL 24 HOUR
  AND closing_at <= {SQL_AS_OF} + INTERVAL 90 DAY
  AND (district IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') OR district IS NULL)
  AND procurement_nature IN ('goods', 'works')
  AND (tender_security IS NULL OR tender_security >= 100000)
  AND (tender_security IS NULL OR tender_security <= 900000)""")
def _(t):
    return filters.hard_filter(
        t.notices(), AS_OF, districts=["NATION_1", "NATION_2", "NATION_3", "NATION_4"],
        natures=["goods", "works"], min_security=100000, max_security=900000).select("id")


@query("exclude_test_records", """
SELECT id, title FROM notices WHERE NOT (lower(coalesce(description, '') || ' ' || coalesce(title, ''))
  LIKE '%this is an invalid tender%' OR lower(coalesce(description, '') || ' ' || coalesce(title, ''))
  LIKE '%used to explain corrigendum process%')""")
def _(t):
    return filters.exclude_test_records(t.notices()).select("id", "title")


@query("excluded_test_records", "SELECT id FROM notices WHERE id % 997 = 0")
def _(t):
    return filters.excluded_test_records(t.notices()).select("id")


@query("closing_windows", f"""
SELECT 'today' AS bucket, id FROM notices WHERE closing_at >= {SQL_AS_OF} AND closing_at < {SQL_AS_OF} + INTERVAL 1 DAY
UNION ALL SELECT 'week', id FROM notices WHERE closing_at >= {SQL_AS_OF} AND closing_at < {SQL_AS_OF} + INTERVAL 7 DAY
UNION ALL SELECT 'open', id FROM notices WHERE closing_at >= {SQL_AS_OF}""")
def _(t):
    n = t.notices()
    buckets = [F.when(filters.closing_window(C("closing_at"), b, as_of()), b)
               for b in ("today", "week", "open")]
    return (n.select("id", F.explode(F.array(*buckets)).alias("bucket"))
            .filter("bucket IS NOT NULL").select("bucket", "id"))


@query("point_lookups", """
SELECT user_id, email FROM users WHERE lower(email) = lower('uSER42@mail.example')""")
def _(t):
    return filters.user_by_email(t.users(), " uSER42@mail.example ").select("user_id", "email")


@query("digest_recipients", f"""
SELECT user_id, email, {ts('verified_at')} AS verified_at FROM users
WHERE unsubscribed_at IS NULL AND email IS NOT NULL AND verified_at IS NOT NULL""")
def _(t):
    return filters.digest_recipients(t.users()).select("user_id", "email", stamp("verified_at").alias("verified_at"))


@query("active_users", "SELECT user_id FROM users WHERE unsubscribed_at IS NULL")
def _(t):
    return filters.active_users(t.users()).select("user_id")


@query("needs_detail", """
SELECT source_key, external_ref, position FROM (SELECT *, row_number() OVER (PARTITION BY source_key
  ORDER BY published_at DESC NULLS LAST, external_ref) AS position FROM notices
  WHERE detail_fetched_at IS NULL AND status = 'live') WHERE position <= 200""")
def _(t):
    return filters.needs_detail(t.notices()).select("source_key", "external_ref", "position")


@query("amendment_history", """
SELECT notice_id, version_no, change_type FROM versions
WHERE change_type IN ('corrigendum', 'cancellation', 'extension')""")
def _(t):
    return filters.amendments(t.versions()).select("notice_id", "version_no", "change_type")


@query("notice_history", """
SELECT notice_id, version_no, change_type FROM versions WHERE notice_id = 7
  AND change_type IN ('corrigendum', 'cancellation', 'extension')""")
def _(t):
    return filters.notice_history(t.versions(), {"notice_id": 7}).select(
        "notice_id", "version_no", "change_type")


@query("enabled_sources", "SELECT DISTINCT source_key, 30 AS crawl_interval_min FROM notices WHERE source_key <> 'offline'")
def _(t):
    s = t.sources().withColumns({"is_enabled": C("source_key") != "offline", "crawl_interval_min": F.lit(30)})
    return filters.enabled_sources(s)


# ------------------------------------------------------------ browse, search


_PAGE = "id, organization_path, district, procurement_nature"


@query("browse_page", f"""
SELECT {_PAGE}, {ts('closing_at')} AS closing_at, CAST(tender_security AS DOUBLE) AS tender_security
FROM notices WHERE status = 'live' AND procurement_nature = 'goods' AND closing_at >= {SQL_AS_OF}
ORDER BY closing_at NULLS LAST, id LIMIT 25 OFFSET 50""")
def _(t):
    page, _total = browse.browse(t.notices(), browse.Request({"procurement_nature": "goods"}, closing="open", page=3), AS_OF)
    return page.select("id", "organization_path", "district", "procurement_nature",
                       stamp("closing_at").alias("closing_at"), dbl("tender_security").alias("tender_security"))


@query("browse_total", f"""
SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) AS pages FROM notices
WHERE status = 'live' AND procurement_nature = 'goods' AND closing_at >= {SQL_AS_OF}""")
def _(t):
    return browse.browse(t.notices(), browse.Request({"procurement_nature": "goods"}, closing="open", page=3), AS_OF)[1]


_WORDS = r"regexp_extract_all(lower(concat_ws(' ', title, description, package_no, reference_no, organization_path, district, project_name)), '[\p{L}\p{N}_]+')"


@query("search_words", rf"""
SELECT id FROM (SELECT *, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS w FROM notices)
WHERE status = 'live' AND ((contains(w, ' machinery ') AND contains(w, ' lot ') AND NOT contains(w, ' urgent '))
  OR contains(w, ' supply for customer ') AND contains(w, ' nation_3 ')
  OR contains(lower(coalesce(package_no, '')), lower('machinery lot -urgent or "supply for customer" nation_3')))""")
def _(t):
    q = 'machinery lot -urgent or "supply for customer" nation_3'
    return t.notices().filter(browse.predicate(browse.Request(text=q), AS_OF)).select("id")


@query("search_page", r"""
SELECT id, position FROM (SELECT id, row_number() OVER (ORDER BY hits DESC, closing_at NULLS LAST, id) AS position
  FROM (SELECT c.id, c.closing_at, len(list_filter(w, lambda x: x = 'the' OR x = 'and')) AS hits
        FROM (SELECT *, regexp_extract_all(lower(concat_ws(' ', title, description, reference_no,
                organization_path, district)), '[\p{L}\p{N}_]+') AS w FROM corpus) c
        WHERE status = 'live' AND list_contains(w, 'the') AND list_contains(w, 'and'))) WHERE position <= 25""")
def _(t):
    from pyspark.sql import Window

    request = browse.Request(text="the and")
    found = browse.ranked(t.corpus().filter(browse.predicate(request, AS_OF)), request)
    top = found.orderBy(*browse.order(request)).limit(browse.PER_PAGE)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*browse.order(request)))).select("id", "position")


@query("search_fragment", """
SELECT id, reference_no FROM notices WHERE status = 'live' AND contains(lower(reference_no), '/12')""")
def _(t):
    return t.notices().filter(browse.predicate(browse.Request(text="F/12"), AS_OF) | (
        (C("status") == "live") & search.substring(C("reference_no"), "/12"))).select("id", "reference_no")


@query("recent_notices", f"""
SELECT id, {ts('first_seen_at')} AS first_seen_at FROM notices WHERE status = 'live'
ORDER BY first_seen_at DESC, id LIMIT 10""")
def _(t):
    return browse.recent(t.notices()).select("id", stamp("first_seen_at").alias("first_seen_at"))


@query("site_stats", f"""
SELECT count(*) FILTER (status = 'live') AS live_notices,
  count(*) FILTER (status = 'live' AND closing_at >= {SQL_AS_OF} AND closing_at < {SQL_AS_OF} + INTERVAL 1 DAY) AS closing_today,
  count(*) FILTER (status = 'live' AND closing_at >= {SQL_AS_OF} AND closing_at < {SQL_AS_OF} + INTERVAL 7 DAY) AS closing_week,
  count(*) FILTER (first_seen_at > {SQL_AS_OF} - INTERVAL 1 DAY) AS added_today FROM notices""")
def _(t):
    return browse.site_stats(t.notices(), AS_OF)


@query("facets", """
SELECT facet, value, n, position FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS position
  FROM (SELECT 'districts' AS facet, district AS value, count(*) AS n FROM notices WHERE status = 'live' AND district IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'organizations', organization_path, count(*) FROM notices WHERE status = 'live' GROUP BY ALL
    UNION ALL SELECT 'natures', procurement_nature, count(*) FROM notices WHERE status = 'live' GROUP BY ALL
    UNION ALL SELECT 'methods', procurement_method, count(*) FROM notices WHERE status = 'live' GROUP BY ALL))
WHERE position <= CASE WHEN facet IN ('natures', 'methods') THEN 10 ELSE 20 END""")
def _(t):
    return browse.facets(t.notices())


@query("district_pages", "SELECT district AS name, count(*) AS n FROM notices WHERE district IS NOT NULL GROUP BY ALL HAVING count(*) >= 5")
def _(t):
    return browse.district_pages(t.notices())


@query("organization_pages", """
SELECT organization_path AS name, regexp_replace(lower(organization_path), '[^a-z0-9]+', '-', 'g') AS slug,
  count(*) AS n FROM notices GROUP BY ALL HAVING count(*) >= 5""")
def _(t):
    return browse.organization_pages(t.notices())


@query("organization_by_slug", """
SELECT slug, min(name) AS name, count(*) > 1 AS collides FROM (SELECT DISTINCT organization_path AS name,
  regexp_replace(lower(organization_path), '[^a-z0-9]+', '-', 'g') AS slug FROM notices) GROUP BY slug""")
def _(t):
    return browse.organization_by_slug(t.notices())


@query("sitemap", """
SELECT '/' AS loc, CAST(NULL AS VARCHAR) AS lastmod, 'hourly' AS changefreq, '1.0' AS priority
UNION ALL SELECT '/tenders', NULL, 'hourly', '0.9' UNION ALL SELECT '/browse', NULL, 'daily', '0.8'
UNION ALL SELECT '/tenders/district/' || url_encode(district), NULL, 'daily', '0.7'
  FROM notices WHERE district IS NOT NULL GROUP BY district HAVING count(*) >= 5
UNION ALL SELECT '/tenders/organization/' || regexp_replace(lower(organization_path), '[^a-z0-9]+', '-', 'g'), NULL, 'daily', '0.6'
  FROM notices GROUP BY organization_path HAVING count(*) >= 5
UNION ALL SELECT '/tenders/' || id, strftime(greatest(first_seen_at, last_seen_at), '%Y-%m-%d'), 'daily', '0.5'
  FROM (SELECT id, first_seen_at, last_seen_at FROM notices WHERE status = 'live' ORDER BY first_seen_at DESC, id LIMIT 40000)""")
def _(t):
    return browse.sitemap_entries(t.notices())


# ------------------------------------------------------------------ matching


def _pairs(t: Tables) -> DataFrame:
    return matching.candidates(t.corpus(), t.profiles(), AS_OF)


@query("candidates_all_users", """
SELECT user_id, notice_id, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY published_at DESC NULLS LAST, notice_id) AS position FROM eligible_notices) WHERE position <= 500""")
def _(t):
    return matching.candidates(t.notices(), t.customer_profiles(), AS_OF)


@query("candidates_top_20_unseen", """
SELECT user_id, notice_id, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY published_at DESC NULLS LAST, notice_id) AS position
  FROM eligible_notices e WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.user_id = e.user_id AND m.notice_id = e.notice_id)
    AND NOT EXISTS (SELECT 1 FROM feedback f WHERE f.user_id = e.user_id AND f.notice_id = e.notice_id))
WHERE position <= 20""")
def _(t):
    return matching.candidates(t.notices(), t.customer_profiles(), AS_OF,
                               seen=[t.matches(), t.feedback()], limit=20)


@query("candidate_counts", """
SELECT p.user_id, count(e.notice_id) AS candidates FROM customer_profiles p
LEFT JOIN eligible_notices e ON e.user_id = p.user_id GROUP BY p.user_id""")
def _(t):
    return matching.count_candidates(t.notices(), t.customer_profiles(), AS_OF)


@query("profile_keywords", "SELECT user_id, word, n, position FROM keywords")
def _(t):
    return matching.profile_keywords(embedding.profile_texts(t.profiles()))


@query("vector_arm", "SELECT user_id, notice_id, similarity, vector_position FROM vector_hits")
def _(t):
    return matching.vector_arm(_pairs(t), t.notice_vectors(), t.profile_vectors(), MODEL)


@query("keyword_arm", "SELECT user_id, notice_id, hits, keyword_position FROM keyword_hits")
def _(t):
    words = matching.profile_keywords(embedding.profile_texts(t.profiles()))
    return matching.keyword_arm(_pairs(t), matching.word_counts(t.corpus(), words), words).select(
        "user_id", "notice_id", C("hits").cast("long").alias("hits"), "keyword_position")


def _matches(t: Tables) -> DataFrame:
    return matching.match_all(t.corpus(), t.profiles(), t.notice_vectors(), t.profile_vectors(), AS_OF, MODEL)


@query("hybrid_matches", """
SELECT user_id, notice_id, position, round(score, 9) AS score, similarity, matched_by,
  round(floor, 4) AS floor FROM fused""")
def _(t):
    return _matches(t).select("user_id", "notice_id", "position", F.round("score", 9).alias("score"),
                              C("layer2_score").alias("similarity"), "reasons.matched_by", "reasons.floor")


@query("fused_arms", """
SELECT user_id, notice_id, position, round(score, 9) AS score, similarity, matched_by FROM fused""")
def _(t):
    words = matching.profile_keywords(embedding.profile_texts(t.profiles()))
    pairs = _pairs(t)
    fused = matching.fuse(matching.vector_arm(pairs, t.notice_vectors(), t.profile_vectors(), MODEL),
                          matching.keyword_arm(pairs, matching.word_counts(t.corpus(), words), words))
    return fused.select("user_id", "notice_id", "position", F.round("score", 9).alias("score"),
                        C("layer2_score").alias("similarity"), "reasons.matched_by")


@query("match_report", """
SELECT p.user_id, false AS skipped_no_profile, (SELECT count(*) FROM corpus_candidates c WHERE c.user_id = p.user_id) AS candidates,
  (SELECT count(*) FROM fused f WHERE f.user_id = p.user_id) AS ranked,
  (SELECT count(*) FROM (SELECT user_id, notice_id FROM fused UNION SELECT user_id, notice_id FROM matches) m
   WHERE m.user_id = p.user_id) AS stored FROM profiles p""")
def _(t):
    # Stored are the ranked matches and those that the table held before.
    pairs, ranked = _pairs(t), written(_matches(t).select("user_id", "notice_id", "score"))
    stored = matching.upsert_matches(t.matches().select("user_id", "notice_id", "score"), ranked)
    return matching.match_report(t.profiles(), pairs, ranked, stored)


@query("upsert_matches", """
SELECT user_id, notice_id, CASE WHEN notice_id % 2 = 0 THEN score + 1 ELSE score END AS score FROM matches""")
def _(t):
    m = t.matches().drop("reasons")
    return matching.upsert_matches(m, m.filter("notice_id % 2 = 0").withColumn("score", C("score") + 1))


@query("needs_embedding", f"""
SELECT n.id FROM corpus n LEFT JOIN (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'older' ELSE 'emb-64' END AS model FROM embeddings) e
  ON e.vec_id = n.id AND e.model = 'emb-64' WHERE n.status = 'live' AND trim(n.description) <> '' AND (e.vec_id IS NULL OR n.id % 11 = 0)""")
def _(t):
    texts = embedding.notice_texts(t.corpus()).select("id", X.text_digest(F.when(
        C("id") % 11 == 0, "changed").otherwise(C("text"))).alias("text_digest"))
    held = t.notice_vectors().withColumn("model", F.when(C("id") % 5 == 0, "older").otherwise(MODEL))
    return embedding.needs_embedding(t.corpus(), held.join(texts, "id"), MODEL).select("id")


@query("embedding_backlog", """
SELECT count(*) AS backlog FROM corpus WHERE status = 'live' AND trim(description) <> ''
  AND id NOT IN (SELECT vec_id FROM embeddings)""")
def _(t):
    held = t.notice_vectors().join(embedding.notice_texts(t.corpus()).select(
        "id", X.text_digest(C("text")).alias("text_digest")), "id")
    return embedding.needs_embedding(t.corpus(), held, MODEL).agg(F.count("*").alias("backlog"))


@query("embed_newest", """
SELECT id, t AS source_text, 'hashing-64' AS model, left(sha256(t), 16) AS text_digest, 64 AS dimensions
FROM (SELECT id, trim(description) AS t FROM corpus WHERE status = 'live' AND trim(description) <> '')""")
def _(t):
    held = t.notice_vectors().withColumn("text_digest", F.lit("")).limit(0)
    fresh = embedding.embed(embedding.needs_embedding(t.corpus(), held))
    return fresh.select("id", "source_text", "model", "text_digest", F.size("embedding").alias("dimensions"))


@query("upsert_embeddings", """
SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'newer' ELSE 'emb-64' END AS model,
  round(CAST(embedding[1] AS DOUBLE) * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END, 6) AS head FROM embeddings""")
def _(t):
    held = t.notice_vectors()
    fresh = held.filter("id % 3 = 0").select(
        "id", F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"),
        F.lit("newer").alias("model"))
    return embedding.upsert_embeddings(held, fresh).select(
        "id", "model", F.round(dbl(F.get("embedding", F.lit(0))), 6).alias("head"))


# --------------------------------------------------------------------- merge


def _folded(t: Tables) -> DataFrame:
    empty = t.spark.createDataFrame([], NOTICE)
    observations = parse.as_observations(t.observations())
    return merge.fold_observations(empty, observations, (), hot_rows=None)


def _sweep() -> Column:
    return (C("raw_document_id") % 4).alias("k")


@query("merge_current", f"""
SELECT source_key, external_ref, s_title AS title, s_package_no AS package_no, s_description AS description,
  s_district AS district, CAST(s_tender_security AS DOUBLE) AS tender_security, {ts('s_closing_at')} AS closing_at,
  s_status AS status, hash AS canonical_hash, {ts('observed_at')} AS last_seen_at,
  (SELECT count(*) FROM outcomes v WHERE v.external_ref = o.external_ref AND v.outcome <> 'unchanged') AS version_no
FROM outcomes o WHERE k = 3""")
def _(t):
    return merge.results_of(_folded(t)).current.select(
        "source_key", "external_ref", "title", "package_no", "description", "district",
        dbl("tender_security").alias("tender_security"), stamp("closing_at").alias("closing_at"),
        "status", "canonical_hash", stamp("last_seen_at").alias("last_seen_at"),
        C("version_no").cast("long").alias("version_no"))


@query("merge_versions", f"""
SELECT external_ref, row_number() OVER (PARTITION BY external_ref ORDER BY k) AS version_no, change_type,
  {ts('observed_at')} AS observed_at, hash AS canonical_hash, CASE WHEN k = 0 THEN 0 ELSE n_changes END AS n_changes
FROM outcomes WHERE outcome <> 'unchanged'""")
def _(t):
    return merge.results_of(_folded(t)).versions.select(
        "external_ref", C("version_no").cast("long").alias("version_no"), "change_type",
        stamp("observed_at").alias("observed_at"), "canonical_hash",
        F.cardinality("changed_fields").alias("n_changes"))


@query("merge_outcomes", "SELECT external_ref, k, outcome FROM outcomes")
def _(t):
    return _folded(t).select("external_ref", _sweep(), "outcome")


@query("merge_hot_keys", """
SELECT external_ref, k, outcome, hash FROM outcomes""")
def _(t):
    # The same fold with every key treated as oversized: chunks of one day.
    empty = t.spark.createDataFrame([], NOTICE)
    observations = parse.as_observations(t.observations())
    return merge.fold_observations(empty, observations, (), hot_rows=0, chunk_seconds=86400).select(
        "external_ref", _sweep(), "outcome", C("_hash").alias("hash"))


@query("merge_repeated", """
SELECT 0 AS items_new, 0 AS items_changed, true AS idempotent""")
def _(t):
    # Ten more sweeps' worth of the last list observations change nothing.
    folded = merge.results_of(_folded(t)).current
    again = folded.select(*[c for c in folded.columns if c not in merge.STORED], F.lit("list").alias("kind"),
                          (C("last_seen_at") + F.expr("INTERVAL 1 DAY")).alias("observed_at"),
                          F.lit(0).cast("long").alias("raw_document_id"))
    result = merge.merge_observations(folded, parse.as_observations(again), hot_rows=None)
    r = quality.replay_is_idempotent(result.outcomes)
    return r.select(C("items_new").cast("int"), C("items_changed").cast("int"), "idempotent")


_CURRENT = CATALOG["merge_current"].oracle


def _two_batches(t: Tables, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[merge.MergeResult, merge.MergeResult]:
    """Sweeps 0 and 1 stored, then sweeps 2 and 3 merged into them."""
    observations = parse.as_observations(t.observations())
    early = C("raw_document_id") % 4 < 2
    first = merge.merge_observations(t.spark.createDataFrame([], NOTICE), observations.filter(early), always_latest=(), hot_rows=None)
    first = first._replace(current=keep(first.current))
    return first, merge.merge_observations(first.current, observations.filter(~early), always_latest=(), hot_rows=None)


@query("merge_second_batch_current")
def _(t):
    first, second = _two_batches(t, written)  # read by the second fold and by the result
    return merge.apply_merge(first.current, written(second.current)).select(
        "source_key", "external_ref", "title", "package_no", "description", "district",
        dbl("tender_security").alias("tender_security"), stamp("closing_at").alias("closing_at"),
        "status", "canonical_hash", stamp("last_seen_at").alias("last_seen_at"),
        C("version_no").cast("long").alias("version_no"))


CATALOG["merge_second_batch_current"] = CATALOG["merge_second_batch_current"]._replace(oracle=_CURRENT)


@query("merge_second_batch_versions", """
SELECT external_ref, version_no, change_type, old_title, new_title FROM (
  SELECT external_ref, k, row_number() OVER (PARTITION BY external_ref ORDER BY k) AS version_no, change_type,
    CASE WHEN s_title IS DISTINCT FROM old_title THEN old_title END AS old_title,
    CASE WHEN s_title IS DISTINCT FROM old_title THEN s_title END AS new_title
  FROM (SELECT *, lag(s_title) OVER (PARTITION BY external_ref ORDER BY k) AS old_title FROM outcomes)
  WHERE outcome <> 'unchanged') WHERE k >= 2""")
def _(t):
    title = C("changed_fields")["title"]
    return _two_batches(t)[1].versions.select(
        "external_ref", C("version_no").cast("long").alias("version_no"), "change_type",
        title["old"].alias("old_title"), title["new"].alias("new_title"))


@query("merge_second_batch_outcomes", """
SELECT external_ref, kind, outcome, count(*) AS n FROM (SELECT external_ref, outcome,
  CASE WHEN detail THEN 'detail' ELSE 'list' END AS kind FROM outcomes WHERE k >= 2) GROUP BY ALL""")
def _(t):
    return _two_batches(t)[1].outcomes.groupBy("external_ref", "kind", "outcome").agg(F.sum("n").alias("n"))


@query("fold_rows", """
SELECT path, external_ref, k, outcome, CASE WHEN k = 1 THEN 3 ELSE 1 END AS copies
FROM outcomes, (VALUES ('ordinary'), ('hot')) p(path)""")
def _(t):
    # The second sweep arrives three times; no path may show it in the number of rows.
    observations = parse.as_observations(t.observations())
    times = F.when(C("raw_document_id") % 4 == 1, 3).otherwise(1)
    observations = observations.withColumn("_", F.explode(F.array_repeat(F.lit(0), times))).drop("_")
    empty = t.spark.createDataFrame([], NOTICE)
    fold = lambda path, hot: merge.fold_observations(empty, observations, (), hot, 86400).select(
        F.lit(path).alias("path"), "external_ref", _sweep(), "outcome", C("_copies").alias("copies"))
    return fold("ordinary", None).unionByName(fold("hot", 0))


@query("merge_latest_fields", f"""
SELECT external_ref, s_title AS title, {ts('closing_at')} AS closing_at, status FROM (
  SELECT external_ref, k, s_title, last_value(b.closing_at IGNORE NULLS) OVER w AS closing_at, last_value(b.status IGNORE NULLS) OVER w AS status
  FROM outcomes JOIN (SELECT external_ref, k, closing_at, status FROM observations) b USING (external_ref, k)
  WINDOW w AS (PARTITION BY external_ref ORDER BY k)) WHERE k = 3""")
def _(t):
    observations = parse.as_observations(t.observations())
    merged = merge.merge_observations(t.spark.createDataFrame([], NOTICE), observations, hot_rows=None)
    return merged.current.select("external_ref", "title", stamp("closing_at").alias("closing_at"), "status")


@query("merge_run_report", """
SELECT k AS sweep, count(*) FILTER (NOT detail) AS items_found, count(*) FILTER (outcome = 'new') AS items_new,
  count(*) FILTER (outcome = 'changed') AS items_changed, count(*) FILTER (outcome = 'unchanged') AS items_unchanged
FROM outcomes GROUP BY k""")
def _(t):
    o = _folded(t).select(_sweep(), F.when(C("_detail"), "detail").otherwise("list").alias("kind"),
                          "outcome", C("_copies").alias("n")).withColumnRenamed("k", "sweep")
    return metrics.run_report(o, ["sweep"])


@query("healed_hashes", "SELECT external_ref FROM observations WHERE k = 0 AND o_orderkey % 13 = 0")
def _(t):
    current = merge.results_of(_folded(t)).current
    broken = current.withColumn("canonical_hash", F.when(
        C("external_ref").cast("long") % 13 == 0, "x").otherwise(C("canonical_hash")))
    return merge.healed(broken).select("external_ref")


@query("healed_table", "SELECT external_ref, hash AS canonical_hash, 0 AS wrong FROM outcomes WHERE k = 3")
def _(t):
    current = merge.results_of(_folded(t)).current
    healed = merge.heal(current.withColumn("canonical_hash", F.when(
        C("external_ref").cast("long") % 13 == 0, "x").otherwise(C("canonical_hash"))))
    wrong = merge.healed(healed).select("external_ref", F.lit(1).alias("wrong"))
    return healed.select("external_ref", "canonical_hash").join(wrong, "external_ref", "left").fillna(0, ["wrong"])


@query("version_gaps", """
SELECT notice_id, CAST(count(*) AS INTEGER) AS n FROM versions WHERE NOT (version_no = 2 AND notice_id % 5 = 0)
GROUP BY notice_id HAVING notice_id % 5 = 0 AND max(version_no) > 2""")
def _(t):
    # Every fifth notice has lost its second version, which shows where a third one follows.
    lost = (C("version_no") == 2) & (C("notice_id") % 5 == 0)
    return quality.version_gaps(t.versions().filter(~lost), ["notice_id"]).select("notice_id", C("n").cast("int").alias("n"))


@query("repair_stale_status", f"""
SELECT id, CASE WHEN source_key = 'offline' AND status = 'live' AND closing_at IS NULL
  AND (published_at IS NULL OR published_at < {SQL_AS_OF} - INTERVAL 180 DAY) THEN 'closed' ELSE status END AS status FROM notices""")
def _(t):
    return repair.repair_stale_status(t.notices(), AS_OF).select("id", "status")


@query("repair_package_no", """
SELECT id, CASE WHEN package_no LIKE '% %' AND (description IS NULL OR description = '') THEN package_no ELSE description END AS description,
  CASE WHEN package_no LIKE '% %' THEN NULL ELSE package_no END AS package_no FROM notices""")
def _(t):
    return repair.repair_package_no(t.notices()).select("id", "description", "package_no")


@query("drop_phantom_versions", "SELECT notice_id, version_no FROM versions WHERE NOT (version_no > 1 AND n_changes = 0)")
def _(t):
    return repair.drop_phantom_versions(t.versions()).select("notice_id", "version_no")


@query("repoint_current_version", """
SELECT notice_id, max(version_no) AS phantom_version, max(version_no) FILTER (NOT (version_no > 1 AND n_changes = 0)) AS version_no
FROM versions GROUP BY notice_id
HAVING max(version_no) FILTER (NOT (version_no > 1 AND n_changes = 0)) IS DISTINCT FROM max(version_no)""")
def _(t):
    return repair.repoint_current(t.versions(), ["notice_id"])


@query("latest_versions", """
SELECT notice_id, max(version_no) AS version_no, arg_max(change_type, version_no) AS change_type
FROM versions WHERE NOT (version_no > 1 AND n_changes = 0) GROUP BY notice_id""")
def _(t):
    return repair.latest_versions(t.versions(), ["notice_id"]).select("notice_id", "version_no", "change_type")


@query("reclassify_enrichment", """
SELECT notice_id, version_no, CASE WHEN change_type = 'corrigendum' AND n_changes > 0 AND NOT has_old
  THEN 'enrichment' ELSE change_type END AS change_type FROM versions""")
def _(t):
    return repair.reclassify_enrichment(t.versions()).select("notice_id", "version_no", "change_type")


@query("cascade_delete", """
SELECT 'matches' AS child, count(*) AS n FROM matches WHERE notice_id % 997 <> 0
UNION ALL SELECT 'feedback', count(*) FROM feedback WHERE notice_id NOT IN (SELECT id FROM notices WHERE id % 997 = 0)
UNION ALL SELECT 'versions', count(*) FROM versions WHERE notice_id % 997 <> 0""")
def _(t):
    gone = filters.excluded_test_records(t.notices()).select(C("id").alias("notice_id"))
    kept = repair.cascade_delete(gone, "notice_id", {
        "matches": t.matches(), "feedback": t.feedback(), "versions": t.versions()})
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n")
             for name, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -------------------------------------------------------- alerts and accounts


@query("unsent_matches", f"""
SELECT user_id, notice_id, position FROM (SELECT m.user_id, m.notice_id,
    row_number() OVER (PARTITION BY m.user_id ORDER BY m.score DESC, n.closing_at, m.notice_id) AS position
  FROM matches m JOIN notices n ON n.id = m.notice_id WHERE n.status = 'live' AND n.closing_at > {SQL_AS_OF}
    AND NOT EXISTS (SELECT 1 FROM alert_items a WHERE a.user_id = m.user_id AND a.notice_id = m.notice_id AND a.sent_at IS NOT NULL))
WHERE position <= 10""")
def _(t):
    return alerts.unsent_matches(t.matches(), t.notices(), t.alerts(), AS_OF).select("user_id", "notice_id", "position")


@query("resend_after_failure", f"""
SELECT user_id, notice_id, position FROM (SELECT m.user_id, m.notice_id,
    row_number() OVER (PARTITION BY m.user_id ORDER BY m.score DESC, n.closing_at, m.notice_id) AS position
  FROM matches m JOIN notices n ON n.id = m.notice_id WHERE n.status = 'live' AND n.closing_at > {SQL_AS_OF}
    AND NOT EXISTS (SELECT 1 FROM (SELECT alert_id, user_id, unnest(notice_ids) AS notice_id FROM alerts) a
      WHERE a.user_id = m.user_id AND a.notice_id = m.notice_id AND a.alert_id % 2 = 0))
WHERE position <= 10""")
def _(t):
    # Alerts are written unsent; those with an odd number fail and their notices come back.
    written = t.alerts().select("alert_id", "user_id", "notice_ids", F.lit("email").alias("channel"))
    outcomes = written.select("alert_id", as_of().alias("ts"), F.when(
        C("alert_id") % 2 == 0, "sent").otherwise("failed").alias("outcome"), F.lit("bounced").alias("error"))
    log = alerts.alerts_with_outcome(written, outcomes)
    return alerts.unsent_matches(t.matches(), t.notices(), log, AS_OF).select("user_id", "notice_id", "position")


@query("digests", f"""
SELECT user_id, string_agg(CAST(notice_id AS VARCHAR), ',' ORDER BY position) AS notice_ids, count(*) AS n
FROM (SELECT m.user_id, m.notice_id, row_number() OVER (PARTITION BY m.user_id ORDER BY m.score DESC, n.closing_at, m.notice_id) AS position
  FROM matches m JOIN notices n ON n.id = m.notice_id WHERE n.status = 'live' AND n.closing_at > {SQL_AS_OF}
    AND NOT EXISTS (SELECT 1 FROM alert_items a WHERE a.user_id = m.user_id AND a.notice_id = m.notice_id AND a.sent_at IS NOT NULL))
WHERE position <= 10 AND user_id IN (SELECT user_id FROM users WHERE unsubscribed_at IS NULL AND email IS NOT NULL AND verified_at IS NOT NULL)
GROUP BY user_id""")
def _(t):
    unsent = alerts.unsent_matches(t.matches(), t.notices(), t.alerts(), AS_OF)
    d = alerts.digests(unsent, filters.digest_recipients(t.users()))
    return d.select("user_id", F.array_join(C("notice_ids").cast("array<string>"), ",").alias("notice_ids"), "n")


@query("profile_matches", f"""
SELECT user_id, notice_id, position FROM (SELECT m.user_id, m.notice_id,
    row_number() OVER (PARTITION BY m.user_id ORDER BY m.score DESC, n.closing_at, m.notice_id) AS position
  FROM matches m JOIN notices n ON n.id = m.notice_id WHERE n.status = 'live' AND n.closing_at > {SQL_AS_OF}) WHERE position <= 20""")
def _(t):
    return alerts.profile_matches(t.matches(), t.notices(), AS_OF).select("user_id", "notice_id", "position")


_URGENT = f"""
SELECT m.user_id, m.notice_id, m.score, n.title FROM matches m JOIN notices n ON n.id = m.notice_id
JOIN users u ON u.user_id = m.user_id
WHERE n.status = 'live' AND u.unsubscribed_at IS NULL AND m.score >= 0.05
  AND n.closing_at BETWEEN {SQL_AS_OF} AND {SQL_AS_OF} + INTERVAL 720 HOUR
  AND NOT EXISTS (SELECT 1 FROM alert_items a WHERE a.user_id = m.user_id AND a.notice_id = m.notice_id AND a.channel = 'push')"""


def _urgent(t: Tables) -> DataFrame:
    return alerts.urgent_matches(t.matches(), t.notices(), t.users(), t.alerts(), AS_OF,
                                 within_hours=720, min_score=0.05)


@query("urgent_matches", f"SELECT user_id, notice_id, round(score, 6) AS score FROM ({_URGENT})")
def _(t):
    return _urgent(t).select("user_id", "notice_id", F.round("score", 6).alias("score"))


@query("urgent_alert_groups", f"""
SELECT user_id, count(*) AS total, string_agg(CAST(notice_id AS VARCHAR), ',' ORDER BY score DESC, notice_id) AS notice_ids,
  first(notice_id ORDER BY score DESC, notice_id) AS top_notice_id,
  CASE WHEN count(*) = 1 THEN 'Closing soon: 1 tender for you' ELSE 'Closing soon: ' || count(*) || ' tenders for you' END AS title,
  left(first(title ORDER BY score DESC, notice_id), 160) AS body
FROM ({_URGENT}) GROUP BY user_id""")
def _(t):
    g = alerts.group_alert_ids(_urgent(t))
    return g.select("user_id", "total", F.array_join(C("notice_ids").cast("array<string>"), ",").alias("notice_ids"),
                    "top_notice_id", "title", "body")


@query("alert_outcomes", f"""
SELECT a.alert_id, {ts('max(e.ts) FILTER (e.event_type = $$view$$)')} AS sent_at,
  {ts('min(e.ts) FILTER (e.event_type = $$click$$)')} AS opened_at,
  left(arg_max(e.props, e.ts) FILTER (e.event_type = 'error'), 1000) AS error
FROM alerts a LEFT JOIN events e ON e.user_id = a.alert_id GROUP BY a.alert_id""")
def _(t):
    outcomes = t.raw("events").select(
        C("user_id").alias("alert_id"), C("ts").cast("timestamp").alias("ts"),
        F.when(C("event_type") == "view", "sent").when(C("event_type") == "click", "opened")
        .when(C("event_type") == "error", "failed").otherwise("other").alias("outcome"),
        C("props").alias("error"))
    rows = alerts.alerts_with_outcome(t.alerts().select("alert_id"), outcomes)
    return rows.select("alert_id", stamp("sent_at").alias("sent_at"), stamp("opened_at").alias("opened_at"), "error")


@query("latest_verdicts", f"SELECT user_id, notice_id, verdict, {ts('created_at')} AS created_at FROM verdicts")
def _(t):
    return accounts.latest_verdicts(t.feedback()).withColumn("created_at", stamp("created_at"))


@query("first_opens", f"SELECT user_id % 50 AS alert_id, {ts('min(ts)')} AS opened_at FROM events WHERE event_type = 'view' GROUP BY ALL")
def _(t):
    opens = t.raw("events").filter("event_type = 'view'").select(
        (C("user_id") % 50).alias("alert_id"), C("ts").cast("timestamp").alias("opened_at"))
    return accounts.first_opens(opens).withColumn("opened_at", stamp("opened_at"))


@query("account_state", f"""
SELECT user_id, {ts('v')} AS verified_at, {ts('s')} AS last_seen_at, {ts('CASE WHEN s >= l THEN NULL ELSE l END')} AS unsubscribed_at
FROM (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS v, max(ts) FILTER (event_type = 'signup') AS s,
        max(ts) FILTER (event_type = 'error') AS l FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id)""")
def _(t):
    e = t.raw("events").filter(C("event_type").isin("signup", "error")).select(
        "user_id", C("ts").cast("timestamp").alias("ts"),
        F.when(C("event_type") == "signup", "login").otherwise("unsubscribe").alias("event"))
    s = accounts.account_state(e)
    return s.select("user_id", *[stamp(c).alias(c) for c in ("verified_at", "last_seen_at", "unsubscribed_at")])


@query("upsert_users", """
SELECT 'p' || user_id AS phone, arg_max(event_type, (ts, event_id)) AS company FROM events GROUP BY user_id
UNION ALL SELECT 'x' || item_id, 'kept' FROM benchmark""")
def _(t):
    held = t.raw("benchmark").select(F.concat(F.lit("x"), C("item_id").cast("string")).alias("phone"),
                                     F.lit("kept").alias("company"))
    feed = t.raw("events").select(
        F.concat(F.lit("p"), C("user_id").cast("string")).alias("phone"), C("event_type").alias("company"),
        F.struct("ts", "event_id").alias("changed_at"))
    return accounts.upsert_users(held, feed)


@query("upsert_profiles", """
SELECT user_id, arg_max(props, (ts, event_id)) AS business_description FROM events GROUP BY user_id
UNION ALL SELECT item_id, 'old' FROM benchmark WHERE item_id NOT IN (SELECT user_id FROM events)""")
def _(t):
    feed = t.raw("events").select("user_id", C("props").alias("business_description"),
                                  F.struct("ts", "event_id").alias("updated_at"))
    held = t.profiles().select("user_id", F.lit("old").alias("business_description"))
    return accounts.upsert_profiles(held, feed)


@query("upsert_sources", """
SELECT source_key, arg_max(name, event_id) AS name FROM (SELECT event_type AS source_key, props AS name, event_id FROM events) GROUP BY source_key""")
def _(t):
    feed = t.raw("events").select(C("event_type").alias("source_key"), C("props").alias("name"),
                                  C("event_id").alias("registered_at"))
    held = t.raw("events").select(C("event_type").alias("source_key"), F.lit("old").alias("name")).distinct()
    return tables.upsert_sources(held, feed)


@query("subscriptions", """
SELECT 'ep-' || user_id AS endpoint, user_id, 'agent' AS user_agent FROM (
  SELECT user_id, max(ts) FILTER (event_type = 'signup') AS s, max(ts) FILTER (event_type = 'error') AS d
  FROM events GROUP BY user_id) WHERE s IS NOT NULL AND (d IS NULL OR s > d)""")
def _(t):
    e = t.raw("events").filter(C("event_type").isin("signup", "error", "view"))
    kind = F.when(C("event_type") == "error", "delete").otherwise("subscribe")
    events = e.select(
        F.concat(F.lit("ep-"), C("user_id").cast("string")).alias("endpoint"), "user_id",
        C("ts").cast("timestamp").alias("ts"), kind.alias("event"),
        # Views carry incomplete keys and must be refused.
        F.when(C("event_type") == "signup", "k").alias("p256dh"), F.lit("a").alias("auth"),
        F.lit("agent").alias("user_agent"))
    return accounts.subscriptions(events).select("endpoint", "user_id", "user_agent")


_HEALTH = f"""
SELECT endpoint, count(*) FILTER (current AND counted AND outcome = 'error' AND (reset IS NULL OR (ts, seq) > reset)) AS failure_count,
  {ts('max(retired.ts)')} AS retired_at, {ts("max(ts) FILTER (outcome = $$ok$$)")} AS last_success_at
FROM (SELECT *, max(CASE WHEN counted AND outcome IN ('ok', 'subscribe') THEN (ts, seq) END) OVER (PARTITION BY endpoint) AS reset
  FROM (SELECT *, retired IS NULL OR struct_pack(ts := ts, seq := seq) <= retired AS counted
        FROM (SELECT *, min(CASE WHEN current AND retires THEN struct_pack(ts := ts, seq := seq) END)
            OVER (PARTITION BY endpoint) AS retired
          FROM (SELECT *, coalesce((ts, seq) >= since, true) AS current
            FROM (SELECT *, outcome = 'gone' OR count(*) FILTER (outcome = 'error') OVER (PARTITION BY endpoint
                    ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS retires,
                  max(CASE WHEN outcome = 'subscribe' THEN (ts, seq) END) OVER (PARTITION BY endpoint) AS since FROM sends)))))
GROUP BY endpoint"""


@query("subscription_health", _HEALTH)
def _(t):
    h = accounts.subscription_health(t.sends())
    return h.select("endpoint", "failure_count", stamp("retired_at").alias("retired_at"),
                    stamp("last_success_at").alias("last_success_at"))


@query("send_streaks", """
SELECT seq, outcome = 'gone' OR count(*) FILTER (outcome = 'error') OVER (PARTITION BY endpoint
  ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS retires FROM sends""")
def _(t):
    return accounts.send_streaks(t.sends()).select("seq", "retires")


# -------------------------------------------------------------------- metrics


@query("yield_anomalies", """
SELECT run_id, round(baseline, 6) AS baseline, yield_anomaly FROM anomalies""")
def _(t):
    # Chunks of two days, so that the carried history is exercised.
    r = metrics.yield_anomalies(t.runs(), chunk=F.floor(F.unix_seconds("started_at") / 172800))
    return r.select("run_id", F.round("baseline", 6).alias("baseline"), "yield_anomaly")


@query("trailing_yield", """
SELECT source_key, round(avg(items_found), 6) AS baseline, count(*) AS runs FROM (
  SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY started_at DESC) AS rn FROM runs
  WHERE status = 'ok' AND is_full_sweep AND items_found > 0) WHERE rn <= 10 GROUP BY source_key""")
def _(t):
    return metrics.trailing_yield(t.runs()).withColumn("baseline", F.round("baseline", 6))


@query("recent_runs", f"""
SELECT run_id, r.source_key, {ts('started_at')} AS started_at, status, 'Source ' || r.source_key AS name
FROM runs r ORDER BY r.started_at DESC, run_id LIMIT 10""")
def _(t):
    s = t.runs().select("source_key").distinct().withColumn("name", F.concat(F.lit("Source "), C("source_key")))
    return metrics.recent_runs(t.runs(), s).select(
        "run_id", "source_key", stamp("started_at").alias("started_at"), "status", "name")


@query("last_success", f"""
SELECT source_key, {ts('max(finished_at)')} AS last_success_at FROM runs WHERE status = 'ok' GROUP BY source_key""")
def _(t):
    return metrics.last_success(t.runs()).withColumn("last_success_at", stamp("last_success_at"))


@query("last_crawl", f"SELECT {ts('max(finished_at)')} AS last_crawl_at FROM runs WHERE status = 'ok'")
def _(t):
    return browse.last_crawl(metrics.last_success(t.runs())).select(stamp("last_crawl_at").alias("last_crawl_at"))


@query("source_health", f"""
SELECT s.source_key, count(n.id) FILTER (n.status = 'live') AS live_notices, {ts('max(n.first_seen_at)')} AS newest_notice,
  any_value(CAST(NULL AS VARCHAR)) AS last_success_at
FROM (SELECT DISTINCT source_key FROM notices UNION ALL SELECT 'idle') s LEFT JOIN notices n ON n.source_key = s.source_key GROUP BY s.source_key""")
def _(t):
    idle = t.raw("region").select(F.lit("idle").alias("source_key")).distinct()
    s = t.sources().select("source_key").unionByName(idle)
    h = metrics.source_health(s, t.notices(), t.runs())
    return h.select("source_key", "live_notices", stamp("newest_notice").alias("newest_notice"),
                    stamp("last_success_at").alias("last_success_at"))


@query("live_counts", "SELECT source_key, count(*) AS n FROM notices WHERE status = 'live' GROUP BY source_key")
def _(t):
    return metrics.live_counts(t.notices())


@query("crawl_quality", f"""
SELECT {ts("max(finished_at) FILTER (status = $$ok$$)")} AS last_success,
  count(*) FILTER (yield_anomaly AND started_at > {SQL_EVENTS_AS_OF} - INTERVAL 7 DAY) AS anomalies_7d,
  (SELECT count(*) FROM failures WHERE resolved_at IS NULL) AS unresolved_failures FROM anomalies""")
def _(t):
    q = metrics.crawl_quality(metrics.yield_anomalies(t.runs()), t.failures(), EVENTS_AS_OF)
    return q.withColumn("last_success", stamp("last_success"))


@query("sweep_completeness", """
SELECT event_type AS source_key, user_id AS run_id, count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) AS pages_seen,
  CAST(10 + max(event_id % 9) AS INTEGER) AS pages_declared,
  count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) >= 10 + max(event_id % 9) AS complete FROM events GROUP BY ALL""")
def _(t):
    html = F.format_string('<form><input type="hidden" id="totalPages" name="n" value="%d"><input id="x" value="1">', C("event_id") % 9 + 10)
    pages = t.raw("events").select(
        C("event_type").alias("source_key"), C("user_id").alias("run_id"),
        F.get_json_object("props", "$.k").cast("long").alias("page_no"),
        parse.total_pages(html).alias("total_pages"))
    return metrics.sweep_completeness(pages)


@query("user_counts", f"""
SELECT count(*) AS total, count(verified_at) AS verified, count(unsubscribed_at) AS unsubscribed,
  count(*) FILTER (created_at > {SQL_EVENTS_AS_OF} - INTERVAL 7 DAY) AS last_7d FROM users""")
def _(t):
    return metrics.user_counts(t.users(), EVENTS_AS_OF)


_RATES = f"""
SELECT count(a.sent_at) AS sent, count(a.opened_at) AS opened,
  count(a.sent_at) FILTER (u.created_at < {SQL_EVENTS_AS_OF} - INTERVAL 21 DAY) AS sent_week3,
  count(a.opened_at) FILTER (u.created_at < {SQL_EVENTS_AS_OF} - INTERVAL 21 DAY) AS opened_week3
FROM alerts a JOIN users u ON u.user_id = a.user_id WHERE a.channel = 'email'"""


@query("open_rates", f"""
SELECT sent, opened, sent_week3, opened_week3, round(opened / nullif(sent, 0), 6) AS open_rate,
  round(opened_week3 / nullif(sent_week3, 0), 6) AS open_rate_week3 FROM ({_RATES})""")
def _(t):
    r = metrics.open_rates(t.alerts(), t.users(), EVENTS_AS_OF)
    return r.withColumns({c: F.round(c, 6) for c in ("open_rate", "open_rate_week3")})


@query("match_precision", """
SELECT count(*) FILTER (verdict = 'up') AS thumbs_up, count(*) FILTER (verdict = 'down') AS thumbs_down, count(*) AS rated,
  round(count(*) FILTER (verdict = 'up') / nullif(count(*), 0), 6) AS precision, CAST(0.3 AS DOUBLE) AS target FROM verdicts""")
def _(t):
    return metrics.match_precision(accounts.latest_verdicts(t.feedback())).withColumn(
        "precision", F.round("precision", 6))


@query("precision_both", f"""
SELECT up AS thumbs_up, down AS thumbs_down, rated, sent AS alerts_sent, round(up / rated, 6) AS precision_of_rated,
  round(up / sent, 6) AS precision_of_sent
FROM (SELECT count(*) FILTER (verdict = 'up') AS up, count(*) FILTER (verdict = 'down') AS down, count(*) AS rated FROM verdicts), ({_RATES})""")
def _(t):
    r = metrics.precision_both(accounts.latest_verdicts(t.feedback()), t.alerts(), t.users(), EVENTS_AS_OF)
    return r.withColumns({c: F.round(c, 6) for c in ("precision_of_rated", "precision_of_sent")})


@query("match_mix", """
SELECT count(*) AS total, count(DISTINCT user_id) AS users_with_matches, count(*) FILTER (matched_by = 'both') AS both,
  count(*) FILTER (matched_by = 'semantic') AS semantic, count(*) FILTER (matched_by = 'keyword') AS keyword FROM matches""")
def _(t):
    return metrics.match_mix(t.matches())


@query("match_mix_of_days", """
SELECT count(*) AS total, count(DISTINCT user_id) AS users_with_matches, count(*) FILTER (matched_by = 'both') AS both,
  count(*) FILTER (matched_by = 'semantic') AS semantic, count(*) FILTER (matched_by = 'keyword') AS keyword FROM matches""")
def _(t):
    day = F.date_add(F.lit("1998-01-01").cast("date"), (C("notice_id") % 31).cast("int"))
    return metrics.match_mix_of_days(written(metrics.daily_match_mix(t.matches(), day)))


@query("push_counts", f"SELECT count(*) FILTER (retired_at IS NULL) AS active, count(retired_at) AS retired FROM ({_HEALTH})")
def _(t):
    return metrics.push_counts(accounts.subscription_health(t.sends()))


@query("active_subscriptions", f"SELECT endpoint FROM ({_HEALTH}) WHERE retired_at IS NULL")
def _(t):
    return filters.active_subscriptions(accounts.subscription_health(t.sends())).select("endpoint")


# --------------------------------------------------------------------- awards


@query("insert_awards", """
SELECT tender_external_ref, pkg_lot_id, winner, count(*) AS n FROM (
  SELECT DISTINCT tender_external_ref, pkg_lot_id, winner FROM awards a WHERE NOT EXISTS (SELECT 1 FROM awards h
    WHERE h.advertised_at < TIMESTAMP '1996-06-01' AND h.tender_external_ref IS NOT DISTINCT FROM a.tender_external_ref
      AND h.pkg_lot_id IS NOT DISTINCT FROM a.pkg_lot_id AND h.winner = a.winner)) GROUP BY ALL""")
def _(t):
    held = t.awards().filter(C("advertised_at") < F.lit("1996-06-01").cast("timestamp"))
    fresh = awards.new_awards(held, t.awards())
    return fresh.groupBy("tender_external_ref", "pkg_lot_id", "winner").agg(F.count("*").alias("n"))


@query("award_links", f"""
SELECT a.tender_external_ref, a.pkg_lot_id, a.winner, n.id AS notice_id, n.id IS NOT NULL AS has_notice, count(*) AS n
FROM awards a LEFT JOIN (SELECT external_ref, min(id) AS id FROM notices WHERE source_key = 'etender' GROUP BY 1) n
  ON n.external_ref = a.tender_external_ref GROUP BY ALL""")
def _(t):
    linked = awards.link_notices(t.awards(), t.notices(), "etender")
    return linked.groupBy("tender_external_ref", "pkg_lot_id", "winner", "notice_id", "has_notice").agg(
        F.count("*").alias("n"))


@query("newest_awards", f"""
SELECT {ts('contract_signed_at')} AS contract_signed_at, tender_external_ref, pkg_lot_id, winner FROM awards
ORDER BY contract_signed_at DESC, tender_external_ref, pkg_lot_id NULLS FIRST, winner""")
def _(t):
    return awards.newest(t.awards()).select(
        stamp("contract_signed_at").alias("contract_signed_at"), "tender_external_ref", "pkg_lot_id", "winner")


@query("top_winners", """
SELECT procuring_entity, winner, contracts, CAST(value AS DOUBLE) AS value, position FROM (
  SELECT *, row_number() OVER (PARTITION BY procuring_entity ORDER BY contracts DESC, value DESC, winner) AS position
  FROM (SELECT procuring_entity, winner, count(*) AS contracts, coalesce(sum(value_crore), 0) AS value FROM awards GROUP BY ALL)) WHERE position <= 3""")
def _(t):
    return awards.top_winners(t.awards().fillna(0, ["value_crore"])).withColumn("value", dbl("value"))


@query("award_competition", """
SELECT procuring_entity, CAST(sum(n) AS BIGINT) AS contracts, count(*) AS winners, round(max(n) / sum(n), 6) AS top_share,
  round(sum(n * n) / (sum(n) * sum(n)), 6) AS concentration
FROM (SELECT procuring_entity, winner, count(*) AS n FROM awards GROUP BY ALL) GROUP BY procuring_entity""")
def _(t):
    return awards.competition(t.awards()).withColumns({
        c: F.round(c, 6) for c in ("top_share", "concentration")})


@query("typical_award_value", """
SELECT procurement_method, district_name, count(*) AS contracts, CAST(quantile_disc(value_crore, 0.25) AS DOUBLE) AS p25,
  CAST(quantile_disc(value_crore, 0.5) AS DOUBLE) AS median, CAST(quantile_disc(value_crore, 0.75) AS DOUBLE) AS p75,
  CAST(min(value_crore) AS DOUBLE) AS low, CAST(max(value_crore) AS DOUBLE) AS high
FROM awards WHERE value_crore IS NOT NULL GROUP BY ALL""")
def _(t):
    v = awards.typical_value(t.awards(), ["procurement_method", "district_name"])
    return v.select("procurement_method", "district_name", "contracts",
                    *[dbl(c).alias(c) for c in ("p25", "median", "p75", "low", "high")])


# ------------------------------------------------------------------ parse job


def _brief(has_package: str) -> str:
    return f"""CASE WHEN {has_package} THEN package_no END AS package_no,
  CASE WHEN package_no IS NULL OR {has_package} THEN coalesce(description, 'Pipes & fittings')
    ELSE package_no || ' ' || coalesce(description, 'Pipes & fittings') END AS description"""


@query("parse_list_pages", f"""
SELECT external_ref, reference_no, {_brief("package_no LIKE 'PKG-%'")}, procurement_nature, procurement_type,
  'OTM' AS procurement_method, organization_path AS entity, CASE WHEN id % 2 = 0 THEN 'Ministry of Trade, Industry' END AS ministry,
  {ts('published_at')} AS published_at, {ts('closing_at')} AS closing_at, status,
  'https://x/resources/common/ViewTender.jsp?id=' || external_ref AS detail_url FROM notices""")
def _(t):
    r = parse.parse_payloads(t.list_payloads(), as_of(), "https://x").records
    return r.select("external_ref", "reference_no", "package_no", "description", "procurement_nature",
                    "procurement_type", "procurement_method", C("organization.procuring_entity").alias("entity"),
                    "organization.ministry", stamp("published_at").alias("published_at"),
                    stamp("closing_at").alias("closing_at"), "status", "detail_url")


def _list_pages_by_sql(t):
    r = parse.parse_cells(parse.tokenized_by_sql(t.list_payloads()), as_of(), "https://x").records
    return r.select("external_ref", "reference_no", "package_no", "description", "procurement_nature",
                    "procurement_type", "procurement_method", C("organization.procuring_entity").alias("entity"),
                    "organization.ministry", stamp("published_at").alias("published_at"),
                    stamp("closing_at").alias("closing_at"), "status", "detail_url")


CATALOG["parse_list_pages_by_sql"] = Entry(_list_pages_by_sql, CATALOG["parse_list_pages"].oracle)


@query("parse_offline_pages", f"""
SELECT external_ref, reference_no, coalesce(description, 'Desk "large"') AS title, procurement_nature,
  'Direct Procurement' AS procurement_method, organization_path AS agency, CAST(NULL AS VARCHAR) AS entity,
  {ts("date_trunc('day', published_at + INTERVAL 6 HOUR) - INTERVAL 6 HOUR")} AS published_at, {ts('c')} AS closing_at,
  CASE WHEN c <= {SQL_AS_OF} THEN 'closed' WHEN c IS NOT NULL THEN 'live'
    WHEN date_trunc('day', published_at) - INTERVAL 6 HOUR < {SQL_AS_OF} - INTERVAL 180 DAY THEN 'closed' ELSE 'live' END AS status,
  'https://x/resources/common/ViewTenderWithoutPQ.jsp?p=AB' || external_ref AS detail_url
FROM (SELECT *, date_trunc('day', closing_at + INTERVAL 6 HOUR) + INTERVAL '17 hours 59 minutes' AS c FROM notices)""")
def _(t):
    r = parse.parse_payloads(t.offline_payloads(), as_of(), "https://x").records
    return r.select("external_ref", "reference_no", "title", "procurement_nature", "procurement_method",
                    C("organization.agency").alias("agency"), C("organization.procuring_entity").alias("entity"),
                    stamp("published_at").alias("published_at"), stamp("closing_at").alias("closing_at"),
                    "status", "detail_url")


@query("parse_detail_pages", f"""
SELECT external_ref, CASE WHEN package_no IS NOT NULL THEN package_no END AS package_no,
  coalesce(description, 'Pipes & fittings') AS description, organization_path AS entity, district, procurement_nature,
  'LTM' AS procurement_method, CAST(document_price AS DOUBLE) AS document_price,
  CASE WHEN tender_security > 0 OR document_price > 0 THEN CAST(coalesce(tender_security, 0) + coalesce(document_price, 0) AS DOUBLE) END AS tender_security,
  CAST((tender_security IS NOT NULL)::INT + (document_price IS NOT NULL)::INT AS INTEGER) AS n_lots,
  'Works|Roads|Bridges' AS categories, {ts('closing_at')} AS closing_at,
  CASE WHEN tender_security IS NOT NULL OR document_price IS NOT NULL THEN 'Sadar' END AS upazila FROM notices""")
def _(t):
    r = parse.parse_payloads(t.detail_payloads(), as_of()).records
    return r.select("external_ref", "package_no", "description", C("organization.procuring_entity").alias("entity"),
                    "district", "procurement_nature", "procurement_method",
                    dbl("document_price").alias("document_price"), dbl("tender_security").alias("tender_security"),
                    F.size("lots").alias("n_lots"), F.array_join("categories", "|").alias("categories"),
                    stamp("closing_at").alias("closing_at"), "upazila")


@query("parse_award_pages", f"""
SELECT CAST(l_orderkey AS VARCHAR) AS tender_external_ref, CAST(l_linenumber AS VARCHAR) AS pkg_lot_id,
  'REF,' || l_linenumber AS reference_no, 'Supply of part ' || l_partkey AS title, 'Ministry D Division E' AS ministry,
  'Entity ' || l_orderkey % 7 AS procuring_entity, 'RFQ' AS procurement_method, 'Dist' AS district_name, s_name AS winner,
  CASE WHEN l_returnflag <> 'A' THEN floor(l_extendedprice) END AS value_crore,
  {ts("date_trunc('day', l_shipdate) - INTERVAL 6 HOUR")} AS advertised_at,
  {ts("date_trunc('day', l_shipdate) - INTERVAL 6 HOUR")} AS contract_signed_at
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 1""")
def _(t):
    cells = parse.tokenized(t.award_payloads())
    a = parse.parse_awards(cells)
    return a.select("tender_external_ref", "pkg_lot_id", "reference_no", "title", "ministry", "procuring_entity",
                    "procurement_method", "district_name", "winner", dbl("value_crore").alias("value_crore"),
                    stamp("advertised_at").alias("advertised_at"), stamp("contract_signed_at").alias("contract_signed_at"))


@query("award_report", """
SELECT 'pages' AS metric, count(DISTINCT l_orderkey) AS n FROM lineitem
UNION ALL SELECT 'found', count(*) FROM lineitem WHERE l_quantity > 1
UNION ALL SELECT 'new', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_quantity > 1)""")
def _(t):
    payloads = t.award_payloads()
    # Two counts come of the parsed rows: they are parsed once.
    found = written(parse.parse_awards(parse.tokenized(payloads)).select(
        *awards.AWARD_KEY, "advertised_at", "contract_signed_at", "raw_document_id"))
    return awards.award_report(payloads, found, awards.new_awards(None, found))


def _all_payloads(t: Tables) -> DataFrame:
    return t.list_payloads().unionByName(t.offline_payloads()).unionByName(t.award_payloads())


@query("parse_all_sources", """
SELECT 'etender' AS source_key, 'notice' AS what, external_ref AS ref, count(*) AS n FROM notices GROUP BY ALL
UNION ALL SELECT 'offline', 'notice', external_ref, count(*) FROM notices GROUP BY ALL
UNION ALL SELECT 'awards', 'award', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem WHERE l_quantity > 1 GROUP BY ALL""")
def _(t):
    r = parse.parse_payloads(_all_payloads(t), as_of())
    notices = r.records.select("source_key", F.lit("notice").alias("what"), C("external_ref").alias("ref"))
    found = r.awards.select("source_key", F.lit("award").alias("what"), C("tender_external_ref").alias("ref"))
    return notices.unionByName(found).groupBy("source_key", "what", "ref").agg(F.count("*").alias("n"))


@query("ingest_run_report", """
SELECT source_key, kind, pages, parse_failures, CASE WHEN kind = 'empty' THEN 0 ELSE items_found END AS items_found,
  CASE WHEN kind = 'empty' THEN 0 ELSE items_found END AS items_new, 0 AS items_changed, rows_header, rows_demonstration,
  rows_header + rows_demonstration AS rows_dropped, 'partial' AS status, kind IN ('was larger', 'empty') AS yield_anomaly
FROM (SELECT source_key, count(DISTINCT page) AS pages, count(DISTINCT page) FILTER (page % 7 = 0) AS parse_failures,
    count(*) FILTER (page % 7 <> 0 AND id % 13 <> 0) AS items_found, count(DISTINCT page) FILTER (page % 7 <> 0) AS rows_header,
    count(*) FILTER (page % 7 <> 0 AND id % 13 = 0) AS rows_demonstration
  FROM (SELECT 'etender' AS source_key, id // 10 AS page, id FROM notices
    UNION ALL SELECT 'offline', id // 20, id FROM notices) GROUP BY source_key),
  (VALUES ('own history'), ('was larger'), ('capped'), ('no history'), ('empty')) v(kind)""")
def _(t):
    # Every seventh page is broken, every other one ends with a row that is no notice, and
    # every thirteenth notice is demonstration data.
    pages = t.list_payloads(demonstration=13).unionByName(t.offline_payloads(demonstration=13))
    pages = pages.withColumn("content", F.when(C("run_id") % 7 == 0, F.unhex(F.lit("1F8B00"))).otherwise(
        F.concat("content", F.encode(F.lit("<tr><td>end</td></tr>"), "UTF-8"))))
    result, counts = parse.parse_counted(pages, as_of())
    merged = merge.merge_observations(t.spark.createDataFrame([], NOTICE), result.records, hot_rows=None)
    runs = cut_lineage(metrics.ingest_runs(counts, merged.outcomes))
    # The run of each source judged against a history of its own yield, of three times as
    # much, and of none; as a capped run; and as one that found nothing.
    judged = [("own history", True, 1), ("was larger", True, 3), ("capped", False, 3), ("no history", True, None), ("empty", True, 1)]
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(full).alias("is_full_sweep"),
                                         F.lit(x).cast("double").alias("factor")) for k, full, x in judged]))
    cases = runs.select("*", kinds.alias("case")).select("*", "case.*").drop("case")
    cases = cases.withColumn("source", C("source_key")).withColumn("source_key", F.concat_ws("/", "source_key", "kind"))
    history = cases.filter("factor IS NOT NULL").select(
        "source_key", (C("items_found") * C("factor")).cast("long").alias("items_found"), F.lit(1).alias("run_id"), "started_at",
        F.lit("ok").alias("status"), F.lit(True).alias("is_full_sweep"))
    for n in ("items_found", "items_new"):
        cases = cases.withColumn(n, F.when(C("kind") == "empty", 0).otherwise(C(n)))
    return metrics.yield_verdicts(cases, history).select(
        C("source").alias("source_key"), "kind", "pages", "parse_failures", "items_found", "items_new",
        C("items_changed").cast("int").alias("items_changed"), "rows_header", "rows_demonstration", "rows_dropped", "status", "yield_anomaly")


@query("parse_failures", """
SELECT 'page-' || (id // 10) AS url, count(*) > 0 AS failed FROM notices WHERE id // 10 % 7 = 0 GROUP BY ALL""")
def _(t):
    # Every seventh payload claims to be gzip and is not.
    p = t.list_payloads().withColumn("content", F.when(
        C("run_id") % 7 == 0, F.unhex(F.lit("1F8B00"))).otherwise(C("content")))
    f = parse.parse_payloads(p, as_of()).failures
    return f.select("url", (F.length("error") > 0).alias("failed"))


@query("replay_failed_payloads", """
SELECT external_ref FROM notices WHERE id // 10 % 7 = 0""")
def _(t):
    p = t.list_payloads()
    bad = p.filter("run_id % 7 = 0").select("source_key", "url", "fetched_at", parse.payload_id(
        C("source_key"), C("url"), C("fetched_at"), C("content")).alias("raw_document_id"),
        F.lit(None).cast("timestamp").alias("resolved_at"))
    return archive.replay_failures(p, bad, as_of()).records.select("external_ref")


@query("replay_of_sources", """
SELECT 'etender' AS source_key, external_ref FROM notices WHERE id // 10 % 3 = 1""")
def _(t):
    pages = written(t.list_payloads().unionByName(t.offline_payloads()))
    known = t.sources().filter("name LIKE '%etender'")
    records = archive.replay_of_sources(pages, known.union(known), C("run_id") % 3 == 1, as_of()).records
    return records.select("source_key", "external_ref")


@query("probe_payloads", """
SELECT count(*) AS records, array_to_string(list(external_ref ORDER BY external_ref)[1:3], ',') AS samples FROM notices GROUP BY id // 10""")
def _(t):
    p = parse.probe(t.list_payloads(), as_of())
    return p.select("records", F.array_join(F.transform("samples", lambda s: s["external_ref"]), ",").alias("samples"))


@query("new_blobs", """
SELECT source_key, sha256(html) AS content_hash, min(page_id) AS first_page, count(*) > 0 AS kept
FROM (SELECT *, 'site' || page_id % 3 AS source_key FROM pages) GROUP BY ALL""")
def _(t):
    # Every page is fetched twice; the second fetch is a copy.
    p = t.page_payloads()
    twice = p.unionByName(p.withColumn("fetched_at", C("fetched_at") + F.expr("INTERVAL 1 SECOND")))
    b = archive.new_blobs(twice)
    return b.select("source_key", "content_hash",
                    ((F.unix_seconds("fetched_at") - 883612800) / 60).cast("long").alias("first_page"),
                    F.lit(True).alias("kept"))


@query("fetch_log", """
SELECT url, 'site' || page_id % 3 || '/1998/01/01/' || left(sha256(html), 16) || '.gz' AS storage_path,
  '{"page":"' || page_id || '"}' AS meta, strlen(html) AS bytes FROM pages WHERE page_id < 1440
UNION ALL SELECT url, 'site' || page_id % 3 || strftime(TIMESTAMP '1998-01-01' + to_minutes(page_id), '/%Y/%m/%d/') || left(sha256(html), 16) || '.gz',
  '{"page":"' || page_id || '"}', strlen(html) FROM pages WHERE page_id >= 1440""")
def _(t):
    return archive.fetch_log(t.page_payloads()).select("url", "storage_path", "meta", "bytes")


@query("page_links", """
SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
  len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links FROM pages""")
def _(t):
    html = C("html")
    return t.raw("pages").select(
        "page_id", F.regexp_extract(html, "<title>(.*?)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)).cast("long").alias("n_links"))


# -------------------------------------------------------------------- quality


@query("enum_violations", """
SELECT 'procurement_nature' AS column_name, CAST(count(*) FILTER (id % 9 = 0) AS INTEGER) AS violations, count(*) AS rows FROM notices
UNION ALL SELECT 'status', CAST(count(*) FILTER (id % 7 = 0) AS INTEGER), count(*) FROM notices""")
def _(t):
    broken = t.notices().withColumns({
        "procurement_nature": F.when(C("id") % 9 == 0, None).otherwise(C("procurement_nature")),
        "status": F.when(C("id") % 7 == 0, "Live").otherwise(C("status"))})
    q = quality.enum_violations(broken, {"procurement_nature": "procurement_nature", "status": "status"})
    return q.select("column_name", C("violations").cast("int").alias("violations"), "rows")


@query("enum_quarantine", """
SELECT event_id, verdict, coalesce(verdict IN ('up', 'down'), false) AS valid FROM (SELECT event_id, CASE event_type
  WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' WHEN 'view' THEN NULL ELSE event_type END AS verdict FROM events)""")
def _(t):
    kind = C("event_type")
    e = t.raw("events").select("event_id", F.when(kind == "purchase", "up").when(kind == "error", "down")
                               .when(kind != "view", kind).alias("verdict"))
    valid, rest = quality.split_by_enum(e, "verdict", "verdict")
    return valid.withColumn("valid", F.lit(True)).unionByName(rest.withColumn("valid", F.lit(False)))


@query("reconcile_copies", """
SELECT 'orders' AS table_name, count(*) AS left_rows, count(*) AS right_rows, 'OK' AS result FROM orders
UNION ALL SELECT 'customer', count(*), count(*), 'MISMATCH' FROM customer
UNION ALL SELECT 'events', count(*), NULL, 'MISMATCH' FROM events""")
def _(t):
    altered = t.raw("customer").withColumn("c_acctbal", F.when(
        C("c_custkey") == 7, C("c_acctbal") + 1).otherwise(C("c_acctbal")))
    return tables.reconcile(
        {"orders": t.raw("orders"), "customer": t.raw("customer"), "events": t.raw("events")},
        {"orders": t.raw("orders").orderBy("o_custkey"), "customer": altered})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry):
        return lambda spark, sf_dir: entry.run(Tables(spark, sf_dir))

    return {name: bind(entry) for name, entry in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.oracle for name, entry in CATALOG.items() if entry.oracle}
