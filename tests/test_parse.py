"""The parse job on synthetic fragments of the published shapes."""

import gzip
import time
from datetime import datetime
from decimal import Decimal as D
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from noticelake.schemas import PAYLOAD
from noticelake.sources import archive, html as H, parse as P

AT = datetime(2027, 4, 1)
# Invented rows in the shape of the portal's tables.
LIST_ROW = (
    "<tr id=r1><td>1</td><td>4400021,<br/>QX.7 (12)  Date: 02/03/2027,<br/><label>Live</label></td>"
    "<td>Goods,<br /><form><a href='j' onclick=\"f('a>b')\"><span><p>QRS-77/b<br />\nCulvert &lt;3 m&gt; &amp; drain</p>\n"
    "</span></a></form></td><td>Board of Paths, North, East,<br/> Bureau,<br/> Unit (Z),<br/>"
    " Depot, Lakeside</td><td>ICT,<br /> LTM</td><td>02-Mar-2027 10:15,<br />19-Mar-2027 12:30</td></tr>")
TEST_ROW = (
    "<tr><td>1</td><td>4400022<br/>Z-9<br/><label>Live</label></td><td>Goods,<br/><p>This is an Invalid "
    "Tender.</p></td><td>Lakeside</td><td>ICT,<br/>LTM</td><td>05-Feb-2027 09:00,<br/>06-Feb-2027 09:00</td></tr>")
OFFLINE_ROW = (
    "<tr><td>1</td><td>5001<br/>QX.8</td><td>Services<br/><a href='ViewTenderWithoutPQ.jsp?p=0A1B2C'>Rope "
    "&#34;thin&quot; 5'</a></td><td>Board of Ropes<br/>Bureau of Knots<br/>A PERSON</td><td>ICT<br/>Direct (DPM)</td>"
    "<td>20-Mar-2027<br/>11-Apr-2027</td><td><a href='x'>View</a></td></tr>")
DETAIL = (
    "<html><table><tr><td><table><tr><td>Ministry :</td><td>Board <i>of</i> Paths</td><td>Tender/Proposal<br/>"
    "Closing Date and Time :</td><td>19-Mar-2027 12:30</td></tr><tr><td>Invitation Reference No. :</td>"
    "<td>QX.7</td><td>Ministry :</td><td>another</td></tr><tr><td>Tender/Proposal Package No. and Description :"
    "</td><td>QRS-77<br>Two drains<script>var t='<td>';</script></td></tr><tr><td>Procuring Entity District :"
    "</td><td>Lakeside</td></tr></table></td></tr></table><table><tr><td>1</td><td>Lower  drain</td><td>Bank</td>"
    "<td>1,25,000</td><td>03-Apr-2027</td><td>03-May-2027</td></tr><tr><td>2</td><td>m</td><td>n</td><td>-</td>"
    "<td></td><td></td></tr></table></html>")
AWARD_ROW = (
    "<tr><td>1</td><td>Board of Ropes</td><td><a href=\"/v.jsp?pkgLotId=31&amp;tenderid=909\">909, QX.9</a>"
    "<br/> <span> Forty  ropes </span> Date: 21/03/2027</td><td>Depot Two<br/> DPM</td><td>Lakeside</td>"
    "<td>22-Mar-2027</td><td>{winner}</td><td>3.250</td></tr>")


def payload(content, source="etender", kind="list", url="u", meta=None):
    content = content.encode() if isinstance(content, str) else content
    return (source, 1, url, kind, AT, "text/html", content, meta)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), PAYLOAD)


def records(spark, *rows):
    now = F.lit(AT)
    return P.parse_payloads(frame(spark, *rows), now, "https://x").records.collect()


def test_list_row(spark):
    [r] = records(spark, payload(LIST_ROW))
    assert (r.external_ref, r.reference_no, r.package_no) == ("4400021", "QX.7 (12) Date: 02/03/2027", "QRS-77/b")
    assert r.title == r.description == "Culvert <3 m> & drain"
    assert tuple(r.organization) == ("Board of Paths, North, East", "Bureau", "Unit (Z)", "Depot, Lakeside")
    assert (r.procurement_nature, r.procurement_type, r.procurement_method) == ("goods", "ICT", "LTM")
    assert (r.published_at, r.closing_at) == (datetime(2027, 3, 2, 4, 15), datetime(2027, 3, 19, 6, 30))
    assert (r.status, r.kind) == ("live", "list")
    assert r.detail_url == "https://x/resources/common/ViewTender.jsp?id=4400021"


def test_test_record_is_dropped_and_its_neighbour_stays(spark):
    got = records(spark, payload(TEST_ROW + "<tr><td>only</td><td>two</td></tr>" + LIST_ROW
                                 + "<tr><td>2</td><td>no number</td>" + "<td>y</td>" * 4 + "</tr>"))
    assert [r.external_ref for r in got] == ["4400021"]


@pytest.mark.parametrize("before", ["", " " * 300, "<table></table>", "<table><tr><td>x</td></tr></table>" + " " * 500])
def test_bare_rows_after_anything(spark, before):
    assert [r.external_ref for r in records(spark, payload(before + LIST_ROW + OFFLINE_ROW[:0] + "</table>" + LIST_ROW))] == ["4400021"] * 2


def test_expired_session_gives_nothing(spark):
    assert records(spark, payload("<h1>Session Expired</h1>" + LIST_ROW)) == []


def test_offline_row(spark):
    [r] = records(spark, payload(OFFLINE_ROW, "offline"))
    assert r.title == "Rope \"thin\" 5'" and r.procurement_method == "DPM" and r.status == "live"
    assert tuple(r.organization) == ("Board of Ropes", None, "Bureau of Knots", None)
    assert r.closing_at == datetime(2027, 4, 11, 17, 59)
    assert r.detail_url.endswith("ViewTenderWithoutPQ.jsp?p=0A1B2C")


def test_detail_page(spark):
    [r] = records(spark, payload(DETAIL, kind="detail", url="https://d", meta={"tender_id": "4400021"}))
    assert (r.external_ref, r.kind, r.detail_url) == ("4400021", "detail", "https://d")
    assert (r.package_no, r.description) == ("QRS-77", "Two drains")
    assert r.organization.ministry == "Board of Paths" and r.district == "Lakeside" and r.upazila == "Bank"
    assert r.closing_at == datetime(2027, 3, 19, 6, 30) and r.tender_security == D("125000.00")
    assert [(lot.lot_no, lot.description, lot.completion_date) for lot in r.lots] == [
        ("1", "Lower drain", datetime(2027, 5, 2, 18))]


def test_award_rows_need_a_winner(spark):
    rows = AWARD_ROW.format(winner="Rope & Sons") + AWARD_ROW.format(winner=" ")
    [a] = P.parse_payloads(frame(spark, payload(rows, "awards"), payload(LIST_ROW)), F.lit(AT), "https://x").awards.collect()
    assert (a.tender_external_ref, a.pkg_lot_id, a.reference_no, a.title) == ("909", "31", "QX.9", "Forty ropes")
    assert (a.procuring_entity, a.procurement_method, a.winner) == ("Depot Two", "DPM", "Rope & Sons")
    assert a.value_crore == D("3.2500") and a.advertised_at == datetime(2027, 3, 20, 18)


@pytest.mark.parametrize("part", ["<p ", "<", "<!", "<!--", "<script>", "<a x='", "<td>", "<a b='c\">", "<?"])
def test_scanner_is_linear(part):
    start = time.perf_counter()
    H.cells_of((part * (1_000_000 // len(part)) + LIST_ROW).encode())
    assert time.perf_counter() - start < 20


def test_broken_payload_is_quarantined_and_gzip_is_read(spark):
    df = frame(spark, payload(gzip.compress(LIST_ROW.encode()), url="a"), payload(b"\x1f\x8bxx", url="b"),
               payload(None, url="c"))
    result = P.parse_payloads(df, F.lit(AT))
    assert [r.external_ref for r in result.records.collect()] == ["4400021"]
    failed = {r.url: r for r in result.failures.collect()}
    assert set(failed) == {"b", "c"} and all(0 < len(r.error) <= 2000 for r in failed.values())
    again = archive.replay_failures(df.withColumn("content", F.encode(F.lit(LIST_ROW), "UTF-8")),
                                    result.failures, F.lit(AT))
    assert again.records.count() == 0  # other content, other payload id
    assert archive.replay(df, F.col("url") == "a", F.lit(AT)).records.count() == 1


class _Plain(HTMLParser):
    """Text of flat cells by the standard library, to cross-check the scanner."""

    def __init__(self):
        super().__init__()
        self.rows, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        if tag == "td":
            self.rows[-1].append([])

    def handle_data(self, data):
        if self.rows and self.rows[-1]:
            self.rows[-1][-1].append(data)


@pytest.mark.parametrize("html", [LIST_ROW + TEST_ROW, OFFLINE_ROW * 3, "<tr><td>a < b &amp; c<td>d<tr><td>e"])
def test_scanner_agrees_with_the_standard_library(html):
    plain = _Plain()
    plain.feed(html)
    plain.close()
    flat = lambda rows: [["".join(c).split() for c in row] for row in rows]
    assert flat([[c["texts"] for c in r] for r in H.cells_of(html.encode())]) == flat(plain.rows)


def test_archive_keeps_one_blob_per_content_and_logs_every_fetch(spark, tmp_path):
    df = frame(spark, payload(LIST_ROW, url="a"), payload(LIST_ROW, url="b"), payload("পানি", url="c"))
    archive.archive_payloads(df, str(tmp_path), "0")
    archive.archive_payloads(df, str(tmp_path), "0")   # the batch is replayed
    archive.archive_payloads(df.filter("url = 'a'"), str(tmp_path), "1")
    blobs = archive.read_payloads(spark, str(tmp_path))
    assert blobs.count() == 2 and spark.read.parquet(f"{tmp_path}/fetch_log").count() == 4
    assert {bytes(r.content) for r in blobs.collect()} == {LIST_ROW.encode(), "পানি".encode()}
    pruned = blobs.filter("source_key = 'etender'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_key" in pruned


def test_blob_files(spark, tmp_path):
    day = tmp_path / "etender" / "2027" / "04" / "01"
    day.mkdir(parents=True)
    (day / "0123456789abcdef.gz").write_bytes(gzip.compress(LIST_ROW.encode()))
    files = archive.read_blob_files(spark, str(tmp_path), "etender", "list")
    [r] = P.parse_payloads(files, F.lit(AT)).records.collect()
    assert (r.external_ref, r.observed_at) == ("4400021", AT)


def test_the_table_function_of_sql_reads_like_the_job(spark):
    rows = [payload(LIST_ROW, url="a"), payload(b"\x1f\x8bxx", url="b"), payload(OFFLINE_ROW, "offline", url="c")]
    rows.append(payload(None, url="d"))
    pages = spark.createDataFrame(rows, PAYLOAD)
    by_job, by_sql = P.tokenized(pages), P.tokenized_by_sql(pages)
    assert by_sql.columns == by_job.columns
    assert sorted(map(str, by_sql.collect())) == sorted(map(str, by_job.collect()))
    assert P.tokenized_by_sql(pages.limit(0)).count() == 0
    pages.createOrReplaceTempView("some_payloads")
    found = spark.sql("SELECT p.url, size(t.rows) AS n, t.error IS NULL AS fine FROM some_payloads p, "
                      "LATERAL payload_cells(p.kind, p.content) t").collect()
    assert {r.url: r.fine for r in found}["b"] is False and {r.url for r in found} == {"a", "b", "c", "d"}


def test_replay_of_registered_sources_only(spark):
    pages = spark.createDataFrame([payload(LIST_ROW, url="a"), payload(LIST_ROW, url="b"), payload(OFFLINE_ROW, "offline", url="c")], PAYLOAD)
    sources = spark.createDataFrame([("etender",), ("etender",), ("other",), (None,)], "source_key string")
    found = archive.replay_of_sources(pages, sources, F.col("url") != "b", F.lit(AT))
    assert [r.external_ref for r in found.records.collect()] == ["4400021"] and found.failures.count() == 0
    assert archive.replay_of_sources(pages, sources.limit(0), F.lit(True), F.lit(AT)).records.count() == 0


def test_a_batch_of_pages_leaves_in_slices_of_bounded_size():
    import pyarrow as pa

    n = 40
    page = (LIST_ROW * 600).encode()
    batch = pa.RecordBatch.from_pydict({"url": [str(i) for i in range(n)], "kind": ["list"] * n, "content": [page] * n})
    out = list(H.tokenize_batches([batch]))
    cells = [sum(len(r) for p in b.column("rows") for r in p) for b in out]
    assert len(out) > 2 and max(cells) < H.CELLS_AT_ONCE + 600 * 6
    assert [u.as_py() for b in out for u in b.column("url")] == [str(i) for i in range(n)]
    assert sum(cells) == n * 600 * 6


def test_pages_of_plain_tags_are_split_in_one_step_and_others_are_not():
    for plain in (LIST_ROW.replace("f('a>b')", "f()"), OFFLINE_ROW.replace("5'", "5")):
        end, slow = 0, []
        for start, stop, closing, tag, attributes in H._marks(plain):
            slow.append((plain[end:start], closing, tag, attributes))
            end = stop
        assert list(H._nodes(plain))[:-1] == slow and len(H._PLAIN.split(plain)) // 4 == len(slow)
    hidden = "<tr><td>a<!-- <td>b --><script>'<td>c'</script><td title='>'>d"
    assert [[c["texts"] for c in r] for r in H.table_cells(hidden)] == [[["a"], ["d"]]]


def test_flat_pages_are_split_together_and_read_as_one_by_one(monkeypatch):
    import random

    import pyarrow as pa

    r = random.Random(4)
    inner = ["a", " ", "&lt;", "é", "e\u0301", ">", "'", "<br/>", "<span>", "</span>", "<p title=\"\">", "<a href='j?a=1&amp;b=2'>", "<a>",
             "</a>", "<A class=q href=z>", "<abbr>", "<", "<!-- -->", "<th>", "<table>", "</td>", "<td>"]
    cell = lambda: r.choice(["<td>", "<TD a=\"b\">", " <td\n>"]) + "".join(r.choices(inner, [9] * 16 + [1] * 6, k=r.randint(0, 6))) + "</td>"
    row = lambda: r.choice(["<tr>", "x<TR id='x'>", "<tr/>"]) + "".join(cell() for _ in range(r.randint(0, 4))) + "</tr>"
    pages = ["".join(row() for _ in range(r.randint(0, 3))).encode() for _ in range(2000)]
    pages += [None, b"", b"\xff<tr><td>x</td></tr>", gzip.compress(OFFLINE_ROW.encode()), b"\x1f\x8bxx", b"<tr><td>Session Expired</td></tr>"]
    kinds = ["list"] * len(pages)
    pages, kinds = [*pages, AWARD_ROW.encode(), AWARD_ROW.encode()], [*kinds, "detail", None]
    want = [H.read_payload(p, k) for p, k in zip(pages, kinds)]
    alone, read = [], H.read_payload
    monkeypatch.setattr(H, "read_payload", lambda content, kind: alone.append(content) or read(content, kind))
    batch = pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "content": pa.array(pages, pa.binary())})
    got = [x for b in H.tokenize_batches([batch]) for x in b.to_pylist()]
    assert [(x["rows"], x["fields"], x["error"]) for x in got] == want[:-2] + [(want[-2][0], want[-2][1], None), want[-1]]
    assert len(pages) // 3 < len(alone) < len(pages) * 2 // 3
    alone.clear()
    list(H.tokenize_batches([pa.RecordBatch.from_pydict({"kind": ["list"] * 9, "content": [(AWARD_ROW * 30).encode()] * 9})]))
    assert not alone


def test_pages_are_dealt_by_their_size_and_not_into_a_task_per_core(spark, tables):
    # The number of tasks is open, so the planner chooses it by size.
    for pages in (tables.list_payloads(), tables.detail_payloads(), tables.award_payloads()):
        plan = pages._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan
