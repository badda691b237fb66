"""The derived tables of :mod:`noticelake.plans.proxies`, stated in SQL.

``sql(body)`` puts in front of a query the CTEs it names, so that each oracle
runs on the raw test tables alone."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '1998-01-01 00:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

CTES: dict[str, str] = {}

CTES["notices"] = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'offline' ELSE 'etender' END AS source_key,
  CAST(o_orderkey AS VARCHAR) AS external_ref,
  CASE WHEN o_orderkey % 997 = 0 THEN 'This is an Invalid Tender'
       ELSE c_mktsegment || ' ' || o_orderpriority || ' supply for ' || c_name END AS title,
  CASE WHEN o_orderkey % 6 <> 0 THEN 'Lot ' || o_orderkey || ' of ' || lower(c_mktsegment)
       || ' delivery' END AS description,
  CASE WHEN o_orderkey % 11 = 0 THEN 'spare parts and tools'
       WHEN o_orderkey % 4 = 0 THEN 'PKG-' || o_orderkey || '/' || o_custkey END AS package_no,
  'REF/' || o_custkey || '/' || o_orderkey AS reference_no,
  c_name AS organization_path,
  CASE WHEN o_orderkey % 10 <> 0 THEN n_name END AS district,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'works' WHEN 'MACHINERY' THEN 'goods'
       WHEN 'FURNITURE' THEN 'goods' WHEN 'HOUSEHOLD' THEN 'services' ELSE 'other' END
    AS procurement_nature,
  CASE WHEN o_orderkey % 4 = 0 THEN 'ICT' ELSE 'NCT' END AS procurement_type,
  substr(o_orderpriority, 1, 1) AS procurement_method,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(floor(o_totalprice * 2) AS BIGINT) AS DECIMAL(18,2))
    END AS tender_security,
  CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderkey % 50 * 100 AS DECIMAL(18,2)) END
    AS document_price,
  o_orderdate AS published_at,
  CASE WHEN o_orderkey % 23 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 100 + 10 AS INTEGER))
       + INTERVAL 9 HOUR END AS closing_at,
  CASE WHEN o_orderkey % 29 = 0 THEN 'cancelled' WHEN o_orderstatus = 'O' THEN 'live'
       WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'awarded' END AS status,
  o_orderdate + to_hours(o_orderkey % 24) AS first_seen_at,
  o_orderdate + to_hours(o_orderkey % 24) + to_days(CAST(o_orderkey % 40 AS INTEGER)) AS last_seen_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_hours(o_orderkey % 24 + 1) END
    AS detail_fetched_at,
  CASE WHEN o_orderkey % 8 = 0 THEN 'Project ' || c_nationkey END AS project_name
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

CTES["corpus"] = f"""
SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS description,
  'DOC/' || doc_id AS reference_no, 'Office ' || source AS organization_path,
  CASE WHEN doc_id % 10 <> 0 THEN source END AS district,
  CASE lang WHEN 'en' THEN 'goods' WHEN 'fr' THEN 'works' WHEN 'de' THEN 'services'
       ELSE 'other' END AS procurement_nature,
  CASE doc_id % 3 WHEN 0 THEN 'OTM' WHEN 1 THEN 'LTM' ELSE 'RFQ' END AS procurement_method,
  CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars * 100 AS DECIMAL(18,2)) END AS tender_security,
  {AS_OF} - to_days(CAST(doc_id % 365 AS INTEGER)) AS published_at,
  CASE WHEN doc_id % 23 <> 0 THEN {AS_OF} + to_days(CAST(doc_id % 120 - 20 AS INTEGER))
       + INTERVAL 12 HOUR END AS closing_at,
  CASE WHEN doc_id % 9 = 0 THEN 'closed' ELSE 'live' END AS status
FROM documents"""

CTES["profiles"] = """
SELECT item_id AS user_id, text AS business_description,
  CASE WHEN item_id % 4 <> 0 THEN ['src' || item_id % 20, 'src' || item_id * 7 % 20,
       'src' || (item_id + 5) % 20] ELSE [] END AS district_names,
  CASE WHEN item_id % 3 <> 0 THEN ['goods', 'works'] ELSE [] END AS procurement_natures,
  CASE WHEN item_id % 5 = 0 THEN ['OTM'] ELSE [] END AS procurement_methods,
  CASE WHEN item_id % 6 = 1 THEN CAST(20000 AS DECIMAL(18,2)) END AS min_security,
  CASE WHEN item_id % 6 = 2 THEN CAST(300000 AS DECIMAL(18,2)) END AS max_security,
  trim(text) || CASE WHEN item_id % 2 = 0 THEN ' thon erbl' ELSE '' END || ' class A' AS profile_text
FROM benchmark"""

CTES["customer_profiles"] = """
SELECT c_custkey AS user_id,
  CASE WHEN c_custkey % 4 <> 0 THEN [n_name] ELSE [] END AS district_names,
  CASE WHEN c_custkey % 3 <> 0 THEN [CASE c_mktsegment WHEN 'BUILDING' THEN 'works'
       WHEN 'MACHINERY' THEN 'goods' WHEN 'FURNITURE' THEN 'goods' WHEN 'HOUSEHOLD' THEN 'services'
       ELSE 'other' END] ELSE [] END AS procurement_natures,
  CASE WHEN c_custkey % 5 = 0 THEN ['1', '2'] ELSE [] END AS procurement_methods,
  CASE WHEN c_custkey % 6 = 1 THEN CAST(200000 AS DECIMAL(18,2)) END AS min_security,
  CASE WHEN c_custkey % 6 = 2 THEN CAST(600000 AS DECIMAL(18,2)) END AS max_security
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def eligible(notices: str, profiles: str) -> str:
    """All (user, notice) pairs passing the hard filters, as the theta join."""
    return f"""
SELECT p.user_id, n.id AS notice_id, n.published_at
FROM {notices} n JOIN {profiles} p ON n.status = 'live'
 AND n.closing_at >= {AS_OF} + INTERVAL 24 HOUR AND n.closing_at <= {AS_OF} + INTERVAL 90 DAY
 AND (len(p.district_names) = 0 OR n.district IS NULL OR list_contains(p.district_names, n.district))
 AND (len(p.procurement_natures) = 0 OR list_contains(p.procurement_natures, n.procurement_nature))
 AND (len(p.procurement_methods) = 0 OR list_contains(p.procurement_methods, n.procurement_method))
 AND (p.min_security IS NULL OR n.tender_security IS NULL OR n.tender_security >= p.min_security)
 AND (p.max_security IS NULL OR n.tender_security IS NULL OR n.tender_security <= p.max_security)"""


CTES["eligible_notices"] = eligible("notices", "customer_profiles")
CTES["eligible_corpus"] = eligible("corpus", "profiles")
CTES["corpus_candidates"] = """
SELECT user_id, notice_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY published_at DESC NULLS LAST, notice_id) AS position FROM eligible_corpus)
WHERE position <= 500"""

CTES["keywords"] = r"""
SELECT * FROM (SELECT user_id, word, n, row_number() OVER (PARTITION BY user_id
    ORDER BY n DESC, word) AS position
  FROM (SELECT user_id, word, count(*) AS n
        FROM (SELECT user_id, unnest(regexp_extract_all(lower(profile_text),
                '[\p{L}\p{N}_\x{0980}-\x{09FF}]+')) AS word FROM profiles)
        WHERE length(word) >= 3 AND NOT regexp_full_match(word, '\p{Nd}+')
          AND NOT list_contains(string_split('a an and are as at be by for from has have in is it its of on or our that the their they this to we will with you your work works service services supply company limited ltd firm business do does doing govt government office offices', ' '), word)
        GROUP BY ALL)) WHERE position <= 12"""

CTES["vector_hits"] = """
SELECT user_id, notice_id, similarity, position - 1 AS vector_position
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, notice_id) AS position
  FROM (SELECT c.user_id, c.notice_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]),
               CAST(p.embedding AS DOUBLE[])), 6) AS similarity
        FROM corpus_candidates c JOIN embeddings e ON e.vec_id = c.notice_id
        JOIN embeddings p ON p.vec_id = c.user_id)) WHERE position <= 100"""

CTES["keyword_hits"] = r"""
SELECT user_id, notice_id, hits, position - 1 AS keyword_position
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, notice_id) AS position
  FROM (SELECT c.user_id, c.notice_id, count(*) AS hits
        FROM corpus_candidates c
        JOIN (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', title, description,
                reference_no, organization_path, district)), '[\p{L}\p{N}_\x{0980}-\x{09FF}]+')) AS word
              FROM corpus) w ON w.id = c.notice_id
        JOIN keywords k ON k.user_id = c.user_id AND k.word = w.word
        GROUP BY ALL)) WHERE position <= 100"""

CTES["fused"] = """
SELECT user_id, notice_id, similarity, hits, floor, matched_by, score, position
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, notice_id) AS position
  FROM (SELECT user_id, notice_id, similarity, hits, floor,
          CASE WHEN vector_position IS NOT NULL AND keyword_position IS NOT NULL THEN 'both'
               WHEN vector_position IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS matched_by,
          coalesce(1.0::DOUBLE / (61 + vector_position), 0)
            + coalesce(1.0::DOUBLE / (61 + keyword_position), 0) AS score, keyword_position
        FROM (SELECT *, greatest(0.15::DOUBLE, coalesce(max(similarity) OVER (PARTITION BY user_id)
                * 0.6::DOUBLE, 0.15::DOUBLE)) AS floor
              FROM vector_hits FULL JOIN keyword_hits USING (user_id, notice_id)))
  WHERE keyword_position IS NOT NULL OR similarity >= floor) WHERE position <= 50"""

CTES["users"] = """
SELECT user_id, min(ts) + to_days(CAST(user_id % 29 AS INTEGER)) AS created_at,
  CASE WHEN user_id % 7 <> 0 THEN min(CASE WHEN event_type = 'click' THEN ts END) END AS verified_at,
  CASE WHEN user_id % 10 = 0 THEN max(ts) END AS unsubscribed_at,
  CASE WHEN user_id % 17 <> 0 THEN 'User' || user_id || '@Mail.Example' END AS email
FROM events GROUP BY user_id"""

CTES["alerts"] = """
SELECT event_id AS alert_id, user_id,
  CASE WHEN event_id % 3 = 0 THEN 'push' ELSE 'email' END AS channel,
  [event_id, event_id + 1, event_id + 2] AS notice_ids, ts AS created_at,
  CASE WHEN event_type <> 'error' THEN ts END AS sent_at,
  CASE WHEN event_type = 'click' THEN ts + INTERVAL 1 HOUR END AS opened_at
FROM events"""

CTES["alert_items"] = """
SELECT user_id, channel, sent_at, unnest(notice_ids) AS notice_id FROM alerts"""

CTES["matches"] = """
SELECT o_custkey % 150 AS user_id, o_orderkey AS notice_id,
  CAST(o_orderkey * 7919 % 10007 AS DOUBLE) / 10007 AS score,
  CASE o_orderkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'semantic' ELSE 'keyword' END AS matched_by
FROM orders"""

CTES["feedback"] = """
SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS notice_id,
  CASE WHEN event_type = 'purchase' THEN 'up' ELSE 'down' END AS verdict, ts AS created_at
FROM events WHERE event_type IN ('purchase', 'error')"""

CTES["verdicts"] = """
SELECT user_id, notice_id, arg_max(verdict, (created_at, verdict)) AS verdict,
  max(created_at) AS created_at FROM feedback GROUP BY ALL"""

CTES["sends"] = """
SELECT 'ep-' || user_id AS endpoint, ts, event_id AS seq,
  CASE WHEN event_type = 'signup' THEN 'subscribe' WHEN event_type = 'click' THEN 'ok'
       WHEN event_type = 'purchase' AND value > 150 THEN 'gone' ELSE 'error' END AS outcome
FROM events"""

CTES["runs"] = """
SELECT run_id, source_key, make_timestamp(b * 21600 * 1000000) AS started_at,
  make_timestamp(b * 21600 * 1000000) + INTERVAL 10 MINUTE AS finished_at,
  CASE WHEN b % 13 = 0 THEN 'failed' WHEN b % 7 = 0 THEN 'partial' ELSE 'ok' END AS status,
  CASE WHEN b % 11 = 0 THEN n // 4 ELSE n END AS items_found,
  b % 5 <> 0 AS is_full_sweep, b % 3 AS parse_failures
FROM (SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS b, event_type AS source_key,
        count(*) AS n, min(event_id) AS run_id FROM events GROUP BY ALL)"""

CTES["baselines"] = """
SELECT r.*, (SELECT avg(items_found) FROM (SELECT q.items_found FROM runs q
    WHERE q.source_key = r.source_key AND q.status = 'ok' AND q.is_full_sweep AND q.items_found > 0
      AND q.started_at < r.started_at ORDER BY q.started_at DESC LIMIT 10)) AS baseline
FROM runs r"""

CTES["anomalies"] = """
SELECT *, CASE WHEN status = 'failed' OR items_found = 0 THEN true
  WHEN NOT is_full_sweep OR baseline IS NULL THEN false
  ELSE items_found < baseline * 0.5 END AS yield_anomaly FROM baselines"""

CTES["failures"] = """
SELECT event_id AS raw_document_id, CASE WHEN event_id % 3 <> 0 THEN ts END AS resolved_at
FROM events WHERE event_type = 'error'"""

CTES["versions"] = """
SELECT l_orderkey AS notice_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate,
    l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS version_no,
  l_shipdate AS observed_at,
  CASE WHEN l_quantity < 10 THEN 0 ELSE 1 END AS n_changes,
  l_tax >= 0.03 AS has_old,
  CASE l_returnflag WHEN 'A' THEN 'corrigendum' WHEN 'R' THEN 'extension'
    ELSE CASE WHEN l_tax < 0.05 THEN 'enrichment' ELSE 'cancellation' END END AS change_type
FROM lineitem"""

CTES["awards"] = """
SELECT CASE WHEN l_linenumber = 7 THEN 'old-' || l_orderkey ELSE CAST(l_orderkey AS VARCHAR) END
    AS tender_external_ref,
  CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber AS VARCHAR) END AS pkg_lot_id,
  c_name AS procuring_entity, substr(o_orderpriority, 1, 1) AS procurement_method,
  'D' || c_nationkey AS district_name, s_name AS winner,
  CASE WHEN l_quantity > 2 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS DECIMAL(18,4)) END
    AS value_crore,
  o_orderdate AS advertised_at, l_shipdate AS contract_signed_at
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey"""

CTES["observations"] = """
SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'offline' ELSE 'etender' END AS source_key,
  CAST(o_orderkey AS VARCHAR) AS external_ref, o_orderdate + to_days(CAST(k AS INTEGER)) AS observed_at,
  CASE WHEN detail THEN 'Order ' || o_orderkey
       WHEN o_orderkey % 3 = 0 THEN 'order ' || o_orderkey END AS title,
  CASE WHEN o_orderkey % 6 = k THEN 'PKG/' || o_orderkey END AS package_no,
  'REF/' || o_custkey AS reference_no,
  CASE WHEN (o_orderkey + k) % 7 <> 0 THEN 'Supply ' || (o_orderkey % 9
       + CASE WHEN k = 3 THEN 1 ELSE 0 END) END AS description,
  CASE WHEN detail THEN 'D' || o_orderkey % 25 END AS district,
  'goods' AS procurement_nature,
  CASE WHEN detail AND o_orderkey % 2 = 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT)
       AS DECIMAL(18,2)) END AS tender_security,
  CASE WHEN detail THEN CAST(500 AS DECIMAL(18,2)) END AS document_price,
  o_orderdate AS published_at,
  CASE WHEN o_orderkey % 8 <> 0 THEN o_orderdate + to_days(CAST(20 + CASE WHEN (o_orderkey + k) % 5 = 0
       THEN 7 ELSE 0 END AS INTEGER)) END AS closing_at,
  CASE WHEN o_orderkey % 31 = 0 AND k >= 2 THEN 'cancelled' ELSE 'live' END AS status
FROM (SELECT *, (o_orderkey + k) % 4 = 2 AS detail FROM orders, range(4) t(k))"""

MERGED = ("title", "package_no", "reference_no", "description", "district", "procurement_nature",
          "tender_security", "document_price", "published_at", "closing_at", "status")

_over = "OVER (PARTITION BY external_ref ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_state = ",\n  ".join(
    f"coalesce(last_value(CASE WHEN ruling THEN {c} END IGNORE NULLS) {_over}, "
    f"first_value(CASE WHEN NOT ruling THEN {c} END IGNORE NULLS) {_over}) AS s_{c}"
    for c in MERGED)
CTES["ruled"] = """
SELECT *, detail OR NOT coalesce(bool_or(detail) OVER (PARTITION BY external_ref ORDER BY k
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ruling FROM observations"""
CTES["states"] = f"""
SELECT source_key, external_ref, k, detail, observed_at,
  {_state} FROM ruled"""

_text = {"tender_security": "CAST(s_{c} AS VARCHAR)", "document_price": "CAST(s_{c} AS VARCHAR)",
         "published_at": "CAST(epoch_us(s_{c}) AS VARCHAR)",
         "closing_at": "CAST(epoch_us(s_{c}) AS VARCHAR)"}
_fields = ("title", "package_no", "reference_no", "description", "district", None,
           "procurement_nature", None, None, None, "tender_security", "document_price",
           "published_at", "closing_at", None, "status")
_parts = ", ".join("'␀'" if c is None else
                   f"coalesce({_text.get(c, 's_{c}').format(c=c)}, '␀')" for c in _fields)
_lags = ", ".join(f"lag(s_{c}) OVER w AS o_{c}" for c in MERGED)
CTES["hashed"] = f"""
SELECT *, sha256(concat_ws('␟', {_parts})) AS hash, {_lags}
FROM states WINDOW w AS (PARTITION BY external_ref ORDER BY k)"""
_diffs = " + ".join(f"CAST(s_{c} IS DISTINCT FROM o_{c} AS INTEGER)" for c in MERGED)
_olds = " + ".join(f"CAST(s_{c} IS DISTINCT FROM o_{c} AND o_{c} IS NOT NULL AS INTEGER)" for c in MERGED)
CTES["outcomes"] = f"""
SELECT *, CASE WHEN k = 0 THEN 'new' WHEN n_changes > 0 THEN 'changed' ELSE 'unchanged' END AS outcome,
  CASE WHEN k = 0 THEN 'new' WHEN s_status = 'cancelled' THEN 'cancellation'
       WHEN s_closing_at > o_closing_at THEN 'extension' WHEN n_amended = 0 THEN 'enrichment'
       ELSE 'corrigendum' END AS change_type
FROM (SELECT *, {_diffs} AS n_changes, {_olds} AS n_amended FROM hashed)"""

CTES["signups"] = """
SELECT c_custkey AS signup_id,
  CASE WHEN c_custkey % 9 = 0 THEN '12345'
       WHEN c_custkey % 4 = 0 THEN '+880 1' || (c_custkey % 8 + 2) || '-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')
       ELSE '01' || (c_custkey % 8 + 2) || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
  CASE WHEN c_custkey % 7 = 0 THEN 'bad address' ELSE ' c' || c_custkey || '@mail.example ' END AS email,
  repeat('we supply ', c_custkey % 12) AS business_description,
  CASE WHEN c_custkey % 5 = 0 THEN 2000 END AS low,
  CASE WHEN c_custkey % 10 = 0 THEN 1500 WHEN c_custkey % 3 = 0 THEN NULL ELSE 9000 END AS high,
  c_mktsegment
FROM customer"""


def sql(body: str) -> str:
    """``body`` preceded by every CTE it needs, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s*\(?{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{n} AS ({CTES[n].strip()})" for n in CTES if n in needed]
    return f"WITH {', '.join(parts)}\n{body.strip()}" if parts else body.strip()


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
