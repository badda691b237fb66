"""The parse job: payloads -> observations, awards and quarantined failures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from noticelake.functions import values as V
from noticelake.functions.text import (
    blank_to_null, contains_any, content_hash, squash, truncated)
from noticelake.schemas import OBSERVATION
from noticelake.session import written
from noticelake.sources.html import TOKENIZED, read_payload, tokenize_batches

# Shapes of package numbers, links and page markers at the source.
PACKAGE_NO = r"^(?=.*[\p{Nd}/])[\p{L}\p{N}_./()\-]+$"
AWARD_LINK = r"pkgLotId=(\d+)&(?:amp;)?tenderid=(\d+)"
OFFLINE_LINK = r"ViewTenderWithoutPQ\.jsp\?p=([A-Za-z0-9]+)"
TOTAL_PAGES = r'id="totalPages"[^>]*value="(\d+)"'
DETAIL_PATH = "/resources/common/ViewTender.jsp"
OFFLINE_PATH = "/resources/common/ViewTenderWithoutPQ.jsp"
AWARD_PATH = "/resources/common/ViewAwardedContracts.jsp"

# Detail-page labels of each field, in order of preference.
LABELS = {
    "external_ref": ["tender/proposal id"],
    "package": ["tender/proposal package no. and description", "brief description of works"],
    "categories": ["category"],
    "nature": ["procurement nature"],
    "status": ["tender/proposal status"],
    "reference_no": ["invitation reference no."],
    "ministry": ["ministry"],
    "division": ["division"],
    "agency": ["organization"],
    "procuring_entity": ["procuring entity name"],
    "district": ["procuring entity district"],
    "procurement_type": ["procurement type"],
    "procurement_method": ["procurement method"],
    "document_price": ["tender/proposal document price (in bdt)",
                       "tender document price (in bdt)"],
    "published_at": ["scheduled tender/proposal publication date and time"],
    "closing_at": ["tender/proposal closing date and time"],
    "opening_at": ["tender/proposal opening date and time"],
    "document_last_selling_at": [
        "tender/proposal document last selling / downloading date and time"],
    "eligibility_text": ["eligibility of tenderer"],
    "project_name": ["project name"],
    "app_id": ["app id"],
}


class ParseResult(NamedTuple):
    records: DataFrame
    failures: DataFrame
    awards: DataFrame    # contract awards


# ------------------------------------------------------------------ cells

def payload_id(source: Column, url: Column, fetched_at: Column, content: Column) -> Column:
    """Stable id of a fetched payload; failures and records carry it for replay."""
    return F.xxhash64(source, url, fetched_at, content_hash(content))


def tokenized(payloads: DataFrame) -> DataFrame:
    """One row per payload with its table cells and labels, or an ``error``; no shuffle."""
    narrow = payloads.select(
        payload_id(F.col("source_key"), F.col("url"), F.col("fetched_at"),
                   F.col("content")).alias("raw_document_id"),
        "source_key", "kind", "url", "fetched_at",
        F.try_element_at("meta", F.lit("tender_id")).alias("meta_ref"), "content")
    schema = T.StructType([f for f in narrow.schema.fields if f.name != "content"] + TOKENIZED)
    return narrow.mapInArrow(tokenize_batches, schema)


class _Cells:
    """Cells of one payload, for SQL."""

    def eval(self, kind: str, content: bytes):
        yield read_payload(content, kind)


def register_sql(spark: SparkSession, name: str = "payload_cells") -> None:
    """Make the tokenizer a table function of SQL, to be joined laterally:

        SELECT p.source_key, p.url, t.* FROM payloads p, LATERAL payload_cells(p.kind, p.content) t

    It returns one row a payload: rows, fields and error, as :func:`tokenized` does; a null
    payload has an error like any other that cannot be read."""
    spark.udtf.register(name, F.udtf(_Cells, returnType=T.StructType(TOKENIZED), useArrow=True))


def tokenized_by_sql(payloads: DataFrame, name: str = "payload_cells") -> DataFrame:
    """As :func:`tokenized`, by the lateral join that SQL users write."""
    spark = payloads.sparkSession
    register_sql(spark, name)
    return spark.sql(
        "SELECT xxhash64(source_key, url, fetched_at, sha2(content, 256)) AS raw_document_id, source_key, kind, url, "
        "fetched_at, try_element_at(meta, 'tender_id') AS meta_ref, t.* "
        f"FROM {{payloads}} p, LATERAL {name}(p.kind, p.content) t", payloads=payloads)


def html_rows(cells: DataFrame, min_cells: int) -> DataFrame:
    """Explode payloads into table rows having at least ``min_cells`` cells."""
    return (cells.select("raw_document_id", "source_key", "kind", "url", "fetched_at",
                         F.posexplode("rows").alias("row_no", "cells"))
            .filter(F.size("cells") >= min_cells))


def cell_lines(texts: Column) -> Column:
    """Lines of a cell. Names contain commas, so only trailing ones are cut."""
    lines = F.transform(F.split(F.array_join(texts, "\n"), "\n"),
                        lambda x: F.trim(F.regexp_replace(squash(x), ",+$", "")))
    return F.filter(lines, lambda x: x != "")


def cell_text(texts: Column, separator: str = " ") -> Column:
    """Text of a cell: every node trimmed, joined by ``separator``."""
    return F.array_join(F.transform(texts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")),
                        separator)


def total_pages(html: Column) -> Column:
    return blank_to_null(F.regexp_extract(html, TOTAL_PAGES, 1)).try_cast("int")


# ---------------------------------------------------------------- records

def split_brief(parts: Column) -> tuple[Column, Column]:
    """(package number, description): the first line is a package number only if
    it is one short token with a digit or a slash; otherwise it is prose."""
    first = F.get(parts, F.lit(0))
    is_package = F.coalesce((F.length(first) <= 80) & first.rlike(PACKAGE_NO), F.lit(False))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    text = F.when(is_package, F.array_join(rest, " ")).otherwise(F.array_join(parts, " "))
    return F.when(is_package, first), blank_to_null(text)


def split_package(value: Column) -> tuple[Column, Column]:
    """Detail page: first line package number, rest description; one line is prose."""
    lines = F.filter(F.transform(F.split(value, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    several = F.size(lines) > 1
    rest = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), " ")
    return (F.when(several, F.get(lines, F.lit(0))),
            F.when(several, rest).otherwise(F.get(lines, F.lit(0))))


def organization_from_lines(parts: Column) -> Column:
    """Hierarchy lines right-aligned: two lines are agency and entity."""
    missing = F.greatest(F.lit(4) - F.size(parts), F.lit(0))
    padded = F.concat(F.array_repeat(F.lit(None).cast("string"), missing), parts)
    return F.struct(*[F.get(padded, F.lit(i)).alias(n) for i, n in enumerate(
        ("ministry", "division", "agency", "procuring_entity"))])


def organization_offline(parts: Column) -> Column:
    """Offline notices: ministry, agency; the third line is a person and dropped."""
    none = F.lit(None).cast("string")
    return F.struct(F.get(parts, F.lit(0)).alias("ministry"), none.alias("division"),
                    F.get(parts, F.lit(1)).alias("agency"), none.alias("procuring_entity"))


def deepest(organization: Column) -> Column:
    return F.coalesce(*[blank_to_null(organization[n]) for n in
                        ("procuring_entity", "agency", "division", "ministry")])


def is_test_record(*texts: Column) -> Column:
    """True when the source itself declares the row to be demonstration data."""
    return contains_any(F.lower(F.concat_ws(" ", *texts)), V.TEST_RECORD_PHRASES)


def split_categories(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: F.trim(x)),
                    lambda x: x != "")


def lot_security_total(lots: Column) -> Column:
    """Sum of the lots' amounts; nothing or zero means unknown."""
    zero = F.lit(0).cast("decimal(18,2)")
    total = F.aggregate(lots, zero, lambda acc, lot: (
        acc + F.coalesce(lot["security_amount"], zero)).cast("decimal(18,2)"))
    return F.when(total > 0, total)


def clean(c: Column) -> Column:
    """Whitespace collapsed, '' becomes NULL; the cells are NFC already."""
    return blank_to_null(squash(c))


def as_observations(df: DataFrame, *more: str) -> DataFrame:
    """Project to the observation schema; absent fields are NULL."""
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in OBSERVATION.fields] + list(more))


# Why a row of a page gives no record.
HEADER, DEMONSTRATION, NO_REFERENCE = "header", "demonstration", "no reference"


def _row_fields(cells: DataFrame, dropped: bool) -> DataFrame:
    """Line arrays shared by the two list layouts; rows that are no notice, those of the
    table's head and foot, only if asked for."""
    lines = lambda i: cell_lines(F.get("cells", F.lit(i))["texts"])
    rows = html_rows(cells, 0 if dropped else 6).select(
        "*", lines(1).alias("ident"), lines(2).alias("brief"), lines(3).alias("org"), lines(4).alias("proc"),
        lines(5).alias("dates"))
    notice = (F.size("cells") >= 6) & F.coalesce(F.get("ident", F.lit(0)).rlike(r"^\p{Nd}+$"), F.lit(False))
    return rows.withColumn("dropped", F.when(~notice, HEADER)) if dropped else rows.filter(notice).withColumn(
        "dropped", F.lit(None).cast("string"))


def _without(df: DataFrame, reason: Column, dropped: bool) -> DataFrame:
    """Only rows without a reason to drop them, or all rows with their reason."""
    df = df.withColumn("dropped", F.coalesce("dropped", reason))
    return df if dropped else df.filter(F.col("dropped").isNull())


def _common(df: DataFrame) -> DataFrame:
    return df.select(
        "source_key", F.lit("list").alias("kind"), F.col("fetched_at").alias("observed_at"),
        "raw_document_id", "cells", "ident", "brief", "org", "dates", "dropped",
        F.get("ident", F.lit(0)).alias("external_ref"),
        F.get("ident", F.lit(1)).alias("reference_no"),
        V.nature(F.get("brief", F.lit(0))).alias("procurement_nature"),
        F.get("proc", F.lit(0)).alias("procurement_type"),
        V.method_code(F.get("proc", F.lit(1))).alias("procurement_method"),
        V.local_timestamp(F.get("dates", F.lit(0))).alias("published_at"),
        F.slice("brief", F.lit(2), F.greatest(F.size("brief") - 1, F.lit(0))).alias("rest"))


def parse_list(cells: DataFrame, as_of: Column, base_url: str, dropped: bool = False) -> DataFrame:
    """List rows of electronic notices (six cells) -> observations."""
    package_no, description = split_brief(F.col("rest"))
    df = (_common(_row_fields(cells, dropped))
          .select("*", package_no.alias("package_no"), description.alias("description")))
    df = (_without(df, F.when(is_test_record(F.col("description"), F.col("package_no")), DEMONSTRATION), dropped)
          .withColumns({
              "title": F.coalesce("description", "package_no"),
              "organization": organization_from_lines(F.col("org")),
              "closing_at": V.local_timestamp(F.get("dates", F.lit(1))),
              "status": V.status(F.coalesce(F.get("ident", F.lit(2)), F.lit("live"))),
              "detail_url": F.concat(F.lit(f"{base_url}{DETAIL_PATH}?id="), "external_ref")}))
    return as_observations(df, *["dropped"] * dropped)


def parse_offline(cells: DataFrame, as_of: Column, base_url: str, dropped: bool = False) -> DataFrame:
    """List rows of offline notices -> observations; status comes from the dates."""
    hrefs = F.array_join(F.get("cells", F.lit(2))["hrefs"], " ")
    link = blank_to_null(F.regexp_extract(hrefs, OFFLINE_LINK, 1))
    df = _common(_row_fields(cells, dropped)).withColumn("description", blank_to_null(F.array_join("rest", " ")))
    df = (_without(df, F.when(is_test_record(F.col("description")), DEMONSTRATION), dropped)
          .withColumns({
              "title": F.col("description"),
              "organization": organization_offline(F.col("org")),
              "closing_at": V.closing_timestamp(F.get("dates", F.lit(1))),
              "detail_url": F.concat(F.lit(f"{base_url}{OFFLINE_PATH}?p="), link)})
          .withColumn("status", V.derived_status(F.col("published_at"), F.col("closing_at"), as_of)))
    return as_observations(df, *["dropped"] * dropped)


def labelled_value(fields: Column, labels: list[str]) -> Column:
    """The value of the first of the labels that a detail page has, blanks apart."""
    return F.coalesce(*[blank_to_null(F.try_element_at(fields, F.lit("".join(x.split())))) for x in labels])


def lots(rows: Column) -> Column:
    """Lot table: rows of six cells with a lot number and a positive amount."""
    def lot(row: Column) -> Column:
        text = lambda i: cell_text(F.get(row, F.lit(i))["texts"])
        return F.struct(
            text(0).alias("lot_no"), blank_to_null(squash(text(1))).alias("description"),
            blank_to_null(squash(text(2))).alias("location"),
            V.money(text(3)).alias("security_amount"),
            V.local_timestamp(text(4)).alias("start_date"),
            V.local_timestamp(text(5)).alias("completion_date"))

    six = F.transform(F.filter(rows, lambda r: F.size(r) == 6), lot)
    return F.filter(six, lambda x: x["lot_no"].rlike(r"^\p{Nd}+$") & x["security_amount"].isNotNull())


def parse_detail(cells: DataFrame, as_of: Column, base_url: str, dropped: bool = False) -> DataFrame:
    """Detail pages -> full observations."""
    df = cells.filter(F.cardinality("fields") > 0).withColumn("lots", lots(F.col("rows")))
    df = df.select("*", *[labelled_value(F.col("fields"), labels).alias(f"f_{n}") for n, labels in LABELS.items()])
    f = lambda name: F.col(f"f_{name}")
    package_no, description = split_package(f("package"))
    df = (df.select("*", package_no.alias("package_no"), description.alias("description"),
                    F.lit(None).cast("string").alias("dropped"))
          .withColumn("external_ref", F.coalesce(f("external_ref"), blank_to_null(F.col("meta_ref")))))
    reason = F.when(F.col("external_ref").isNull(), NO_REFERENCE).when(
        is_test_record(F.col("description"), F.col("package_no")), DEMONSTRATION)
    df = (_without(df, reason, dropped)
          .withColumns({
              "kind": F.lit("detail"), "observed_at": F.col("fetched_at"),
              "title": F.coalesce("description", "package_no"),
              "organization": F.struct(*[clean(f(n)).alias(n) for n in (
                  "ministry", "division", "agency", "procuring_entity")]),
              "upazila": F.get("lots", F.lit(0))["location"],
              "procurement_nature": V.nature(f("nature")),
              "procurement_method": V.method_code(f("procurement_method")),
              "tender_security": lot_security_total(F.col("lots")),
              "document_price": V.money(f("document_price")),
              "status": V.status(F.coalesce(f("status"), F.lit("live"))),
              "categories": split_categories(f("categories")),
              "detail_url": F.col("url"),
              **{n: V.local_timestamp(f(n)) for n in (
                  "published_at", "closing_at", "opening_at", "document_last_selling_at")},
              "app_id": f("app_id"),
              **{n: clean(f(n)) for n in ("reference_no", "district", "procurement_type",
                                          "eligibility_text", "project_name")}}))
    return as_observations(df, *["dropped"] * dropped)


def parse_awards(cells: DataFrame, base_url: str = "") -> DataFrame:
    """Award rows (eight cells) -> awards; a row without a winner is not an award."""
    cell = lambda i: F.get("cells", F.lit(i))
    ident = clean(cell_text(cell(2)["link_texts"], ""))
    href = F.coalesce(F.get(cell(2)["hrefs"], F.lit(0)), F.lit(""))
    lot_id, ref = (blank_to_null(F.regexp_extract(href, AWARD_LINK, i)) for i in (1, 2))
    body = cell_text(cell(2)["texts"], "\n")
    rows = html_rows(cells, 8).select(
        "source_key", "raw_document_id", "cells", ident.alias("ident"),
        lot_id.alias("pkg_lot_id"), ref.alias("tender_external_ref"),
        F.transform(F.split(body, "\n"), squash).alias("body_lines"), body.alias("body"),
        cell_lines(cell(3)["texts"]).alias("entity"))
    title = F.get(F.filter("body_lines", lambda x: (x != "") & ~x.startswith("Date:")
                           & ~x.eqNullSafe(F.col("ident"))), F.lit(0))
    has_ref = F.contains("ident", F.lit(","))
    advertised = F.regexp_extract("body", r"Date:\s*(\d{2}/\d{2}/\d{4})", 1)
    return rows.select(
        "source_key", "tender_external_ref", "pkg_lot_id",
        F.when(has_ref, blank_to_null(squash(F.regexp_replace("ident", "^[^,]*,", ""))))
        .alias("reference_no"),
        clean(title).alias("title"),
        clean(cell_text(cell(1)["texts"])).alias("ministry"),
        F.get("entity", F.lit(0)).alias("procuring_entity"),
        F.get("entity", F.lit(1)).alias("procurement_method"),
        clean(cell_text(cell(4)["texts"], "")).alias("district_name"),
        clean(cell_text(cell(6)["texts"])).alias("winner"),
        V.award_value(cell_text(cell(7)["texts"], "")).alias("value_crore"),
        V.local_timestamp(advertised).alias("advertised_at"),
        V.local_timestamp(cell_text(cell(5)["texts"], "")).alias("contract_signed_at"),
        F.concat(F.lit(f"{base_url}{AWARD_PATH}?pkgLotId="), "pkg_lot_id", F.lit("&tenderid="),
                 "tender_external_ref").alias("detail_url"),
        "raw_document_id").filter(F.col("winner").isNotNull())


# --------------------------------------------------------------- the job

# A parser that is asked for its dropped rows too gets a fourth argument, True, and adds
# the column ``dropped`` with the reason.
Parser = Callable[..., DataFrame]

# Source registry: (source key, payload kind) -> projection of its cells.
PARSERS: dict[tuple[str, str], Parser] = {
    ("etender", "list"): parse_list,
    ("etender", "detail"): parse_detail,
    ("offline", "list"): parse_offline,
}
# The same for sources whose pages hold awards.
AWARD_PARSERS: dict[tuple[str, str], Callable[[DataFrame, str], DataFrame]] = {
    ("awards", "list"): parse_awards,
}


def _records(cells_of: Callable[[Column], DataFrame], as_of: Column, base_url: str,
             parsers: dict[tuple[str, str], Parser] | None, dropped: bool = False) -> DataFrame:
    parts = []
    for (source, kind), parser in (parsers or PARSERS).items():
        mine = (F.col("source_key") == source) & (F.col("kind") == kind)
        parts.append(parser(cells_of(mine).filter("error IS NULL"), as_of, base_url, *[True] * dropped))
    return reduce(DataFrame.unionByName, parts)


def _awards(cells_of: Callable[[Column], DataFrame], base_url: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        parser(cells_of((F.col("source_key") == source) & (F.col("kind") == kind)).filter("error IS NULL"), base_url)
        for (source, kind), parser in AWARD_PARSERS.items()])


def parse_payloads(payloads: DataFrame, as_of: Column, base_url: str = "",
                   parsers: dict[tuple[str, str], Parser] | None = None) -> ParseResult:
    """Parse every payload with the projection registered for its source and kind.

    Payloads are split by source and kind before they are tokenized, so each is
    tokenized once and the archive's partitions are pruned. A payload that
    cannot be read lands in ``failures`` and stops nothing. Callers that write
    both outputs should tokenize once and use :func:`parse_cells`."""
    cells_of = lambda mine: tokenized(payloads.filter(mine))
    return ParseResult(_records(cells_of, as_of, base_url, parsers), failures(tokenized(payloads)),
                       _awards(cells_of, base_url))


def parse_cells(cells: DataFrame, as_of: Column, base_url: str = "",
                parsers: dict[tuple[str, str], Parser] | None = None) -> ParseResult:
    """As :func:`parse_payloads`, from stored or checkpointed :func:`tokenized` rows."""
    return ParseResult(_records(cells.filter, as_of, base_url, parsers), failures(cells),
                       _awards(cells.filter, base_url))


PAGE_COUNTS = ("source_key string, pages long, bytes long, started_at timestamp, parse_failures long, rows_kept long, "
               "rows_header long, rows_demonstration long")


def parse_counted(payloads: DataFrame, as_of: Column, base_url: str = "",
                  parsers: dict[tuple[str, str], Parser] | None = None) -> tuple[ParseResult, DataFrame]:
    """The parse of a batch, and what it counted per source on the way (``PAGE_COUNTS``).

    Payloads are tokenized once and rows are parsed once, each into a table that all
    outputs share; the counts are observed in these two passes, so nothing is read
    to count. They are kept by registered source: their number does not grow with the
    data. Payloads of any other source have no parser, and are counted by a pass of
    their own when there are some."""
    known = sorted({s for s, _ in [*(parsers or PARSERS), *AWARD_PARSERS]})
    mine = {s: F.col("source_key") == s for s in known}
    pages, failed, rows = Observation("pages"), Observation("failed"), Observation("rows")
    size = F.length("content").cast("long")
    seen = payloads.observe(
        pages, F.collect_set(F.when(~F.col("source_key").isin(known), F.col("source_key"))).alias("others"),
        *[m for i, s in enumerate(known) for m in (
            F.count_if(mine[s]).alias(f"pages_{i}"), F.sum(F.when(mine[s], size)).alias(f"bytes_{i}"),
            F.min(F.when(mine[s], F.col("fetched_at"))).alias(f"first_{i}"))])
    cells = written(tokenized(seen).observe(failed, *[
        F.count_if(mine[s] & F.col("error").isNotNull()).alias(f"failed_{i}") for i, s in enumerate(known)]))
    on_list = F.col("kind") == "list"
    parsed = written(_records(cells.filter, as_of, base_url, parsers, True).observe(rows, *[m for i, s in enumerate(known) for m in (
        F.count_if(mine[s] & on_list & F.col("dropped").isNull()).alias(f"kept_{i}"),
        F.count_if(mine[s] & on_list & (F.col("dropped") == HEADER)).alias(f"header_{i}"),
        F.count_if(mine[s] & (F.col("dropped") == DEMONSTRATION)).alias(f"demo_{i}"))]))
    p, f, r = pages.get, failed.get, rows.get
    counts = cells.sparkSession.createDataFrame(
        [(s, p[f"pages_{i}"], p[f"bytes_{i}"], p[f"first_{i}"], f[f"failed_{i}"], r[f"kept_{i}"], r[f"header_{i}"], r[f"demo_{i}"])
         for i, s in enumerate(known) if p[f"pages_{i}"]], PAGE_COUNTS)
    if p["others"]:
        none = [F.lit(0).cast("long").alias(n) for n in ("rows_kept", "rows_header", "rows_demonstration")]
        bad = cells.filter(F.col("error").isNotNull()).groupBy("source_key").agg(F.count("*").alias("bad"))
        more = payloads.filter(~F.col("source_key").isin(known)).groupBy("source_key").agg(
            F.count("*").alias("pages"), F.sum(size).alias("bytes"), F.min("fetched_at").alias("started_at"))
        counts = counts.unionByName(more.join(bad, "source_key", "left").select(
            "source_key", "pages", "bytes", "started_at", F.coalesce("bad", F.lit(0)).alias("parse_failures"), *none))
    records = parsed.filter(F.col("dropped").isNull()).drop("dropped")
    return ParseResult(records, failures(cells), _awards(cells.filter, base_url)), counts


def failures(cells: DataFrame) -> DataFrame:
    """Dead letters, with the payload id that lets a fixed parser replay them."""
    return (cells.filter(F.col("error").isNotNull())
            .select("raw_document_id", "source_key", "url", "fetched_at",
                    truncated(F.col("error"), 2000).alias("error"),
                    F.lit(None).cast("timestamp").alias("resolved_at")))


def probe(payloads: DataFrame, as_of: Column, n: int = 3, base_url: str = "",
          parsers: dict[tuple[str, str], Parser] | None = None) -> DataFrame:
    """Parse without writing: record count per payload and its first n records."""
    records = parse_payloads(payloads, as_of, base_url, parsers).records
    counts = records.groupBy("raw_document_id").agg(F.count("*").alias("records"))
    w = Window.partitionBy("raw_document_id").orderBy("external_ref")
    samples = (records.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
               .groupBy("raw_document_id")
               .agg(F.sort_array(F.collect_list(F.struct("external_ref", "title"))).alias("samples")))
    return counts.join(samples, "raw_document_id", "left")
