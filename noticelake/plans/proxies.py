"""The library's tables derived from the test tables.

Every rule is deterministic and covers whole tables; :mod:`noticelake.plans.oracle`
states the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticelake.session import tune

AS_OF = "1998-01-01 00:00:00"        # clock of the order-based tables
EVENTS_AS_OF = "2024-01-31 00:00:00"  # clock of the event-based tables
MODEL = "emb-64"

NATURE_OF_SEGMENT = {"BUILDING": "works", "MACHINERY": "goods", "FURNITURE": "goods",
                     "HOUSEHOLD": "services"}
NATURE_OF_LANG = {"en": "goods", "fr": "works", "de": "services"}


def choose(c: Column, table: dict[str, str], default: str) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out.otherwise(default)


def days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def hours(n: Column) -> Column:
    return F.make_dt_interval(hours=n.cast("int"))


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


class Tables:
    """Lazy access to the test tables of one scale factor and their derivations."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = tune(spark)
        self.dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ------------------------------------------------------------- notices

    def notices(self) -> DataFrame:
        o = (self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
             .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")))
        k, date = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
        key = k.cast("string")
        first_seen = date + hours(k % 24)
        return o.select(
            k.alias("id"),
            F.when(k % 5 == 0, "offline").otherwise("etender").alias("source_key"),
            key.alias("external_ref"),
            F.when(k % 997 == 0, "This is an Invalid Tender").otherwise(
                F.concat("c_mktsegment", F.lit(" "), "o_orderpriority", F.lit(" supply for "),
                         "c_name")).alias("title"),
            F.when(k % 6 != 0, F.concat(F.lit("Lot "), key, F.lit(" of "), F.lower("c_mktsegment"),
                                        F.lit(" delivery"))).alias("description"),
            F.when(k % 11 == 0, "spare parts and tools").when(k % 4 == 0, F.concat(
                F.lit("PKG-"), key, F.lit("/"), F.col("o_custkey").cast("string"))).alias("package_no"),
            F.concat(F.lit("REF/"), F.col("o_custkey").cast("string"), F.lit("/"), key)
            .alias("reference_no"),
            F.col("c_name").alias("organization_path"),
            F.when(k % 10 != 0, F.col("n_name")).alias("district"),
            choose(F.col("c_mktsegment"), NATURE_OF_SEGMENT, "other").alias("procurement_nature"),
            F.when(k % 4 == 0, "ICT").otherwise("NCT").alias("procurement_type"),
            F.substring("o_orderpriority", 1, 1).alias("procurement_method"),
            F.when(k % 7 != 0, F.floor(F.col("o_totalprice") * 2).cast("decimal(18,2)"))
            .alias("tender_security"),
            F.when(k % 50 != 0, ((k % 50) * 100).cast("decimal(18,2)")).alias("document_price"),
            date.alias("published_at"),
            F.when(k % 23 != 0, date + days(k % 100 + 10) + hours(F.lit(9))).alias("closing_at"),
            F.when(k % 29 == 0, "cancelled").when(F.col("o_orderstatus") == "O", "live")
            .when(F.col("o_orderstatus") == "F", "closed").otherwise("awarded").alias("status"),
            first_seen.alias("first_seen_at"), (first_seen + days(k % 40)).alias("last_seen_at"),
            F.when(k % 3 != 0, first_seen + hours(F.lit(1))).alias("detail_fetched_at"),
            F.when(k % 8 == 0, F.concat(F.lit("Project "), F.col("c_nationkey").cast("string")))
            .alias("project_name"))

    def corpus(self) -> DataFrame:
        """Notices with long texts, from the documents."""
        k, at = F.col("doc_id"), F.lit(AS_OF).cast("timestamp")
        return self.raw("documents").select(
            k.alias("id"), k.cast("string").alias("external_ref"),
            F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"),
            F.lit(None).cast("string").alias("package_no"),
            F.concat(F.lit("DOC/"), k.cast("string")).alias("reference_no"),
            F.concat(F.lit("Office "), "source").alias("organization_path"),
            F.when(k % 10 != 0, F.col("source")).alias("district"),
            choose(F.col("lang"), NATURE_OF_LANG, "other").alias("procurement_nature"),
            F.when(k % 3 == 0, "OTM").when(k % 3 == 1, "LTM").otherwise("RFQ")
            .alias("procurement_method"),
            F.when(k % 7 != 0, (F.col("n_chars") * 100).cast("decimal(18,2)")).alias("tender_security"),
            (at - days(k % 365)).alias("published_at"),
            F.when(k % 23 != 0, at + days(k % 120 - 20) + hours(F.lit(12))).alias("closing_at"),
            F.when(k % 9 == 0, "closed").otherwise("live").alias("status"),
            F.lit(None).cast("string").alias("project_name"))

    def notice_vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"), "embedding", F.lit(MODEL).alias("model"))

    # ------------------------------------------------------------ profiles

    def profiles(self) -> DataFrame:
        """Users with a written description, from the benchmark texts."""
        k = F.col("item_id")
        src = lambda n: F.concat(F.lit("src"), (n % 20).cast("string"))
        money = "decimal(18,2)"
        return self.raw("benchmark").select(
            k.alias("user_id"), F.col("text").alias("business_description"),
            F.when(k % 4 != 0, F.array_distinct(F.array(src(k), src(k * 7), src(k + 5))))
            .otherwise(strings()).alias("district_names"),
            F.when(k % 3 != 0, strings("goods", "works")).otherwise(strings())
            .alias("procurement_natures"),
            F.when(k % 5 == 0, strings("OTM")).otherwise(strings()).alias("procurement_methods"),
            F.when(k % 6 == 1, F.lit(20000).cast(money)).alias("min_security"),
            F.when(k % 6 == 2, F.lit(300000).cast(money)).alias("max_security"),
            F.when(k % 2 == 0, strings("thon", "erbl")).otherwise(strings()).alias("category_keywords"),
            strings("class A").alias("enlistment_categories"),
            F.lit(None).cast("string").alias("experience_summary"))

    def profile_vectors(self) -> DataFrame:
        return self.raw("benchmark").join(
            self.raw("embeddings"), F.col("item_id") == F.col("vec_id")).select(
            F.col("item_id").alias("user_id"), "embedding")

    def customer_profiles(self) -> DataFrame:
        """Many users with hard constraints only, from the customers."""
        c = self.raw("customer").join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        k, money = F.col("c_custkey"), "decimal(18,2)"
        return c.select(
            k.alias("user_id"),
            F.when(k % 4 != 0, F.array("n_name")).otherwise(strings()).alias("district_names"),
            F.when(k % 3 != 0, F.array(choose(F.col("c_mktsegment"), NATURE_OF_SEGMENT, "other")))
            .otherwise(strings()).alias("procurement_natures"),
            F.when(k % 5 == 0, strings("1", "2")).otherwise(strings()).alias("procurement_methods"),
            F.when(k % 6 == 1, F.lit(200000).cast(money)).alias("min_security"),
            F.when(k % 6 == 2, F.lit(600000).cast(money)).alias("max_security"))

    # -------------------------------------------- accounts, alerts, events

    def users(self) -> DataFrame:
        e = self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
        k = F.col("user_id")
        per = e.groupBy("user_id").agg(
            F.min("ts").alias("created_at"), F.max("ts").alias("_last"),
            F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("_click"))
        return per.select(
            "user_id", (F.col("created_at") + days(k % 29)).alias("created_at"),
            F.when(k % 7 != 0, F.col("_click")).alias("verified_at"),
            F.when(k % 10 == 0, F.col("_last")).alias("unsubscribed_at"),
            F.when(k % 17 != 0, F.concat(F.lit("User"), k.cast("string"), F.lit("@Mail.Example")))
            .alias("email"))

    def alerts(self) -> DataFrame:
        k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
        return self.raw("events").select(
            k.alias("alert_id"), "user_id",
            F.when(k % 3 == 0, "push").otherwise("email").alias("channel"),
            F.array(k, k + 1, k + 2).alias("notice_ids"), ts.alias("created_at"),
            F.when(F.col("event_type") != "error", ts).alias("sent_at"),
            F.when(F.col("event_type") == "click", ts + hours(F.lit(1))).alias("opened_at"))

    def matches(self) -> DataFrame:
        k = F.col("o_orderkey")
        by = F.when(k % 3 == 0, "both").when(k % 3 == 1, "semantic").otherwise("keyword")
        return self.raw("orders").select(
            (F.col("o_custkey") % 150).alias("user_id"), k.alias("notice_id"),
            (((k * 7919) % 10007).cast("double") / 10007).alias("score"),
            F.struct(by.alias("matched_by")).alias("reasons"))

    def feedback(self) -> DataFrame:
        return (self.raw("events").filter(F.col("event_type").isin("purchase", "error")).select(
            "user_id", F.get_json_object("props", "$.k").cast("long").alias("notice_id"),
            F.when(F.col("event_type") == "purchase", "up").otherwise("down").alias("verdict"),
            F.col("ts").cast("timestamp").alias("created_at")))

    def sends(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.concat(F.lit("ep-"), F.col("user_id").cast("string")).alias("endpoint"),
            F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
            F.when(kind == "signup", "subscribe").when(kind == "click", "ok")
            .when((kind == "purchase") & (F.col("value") > 150), "gone").otherwise("error")
            .alias("outcome"))

    def runs(self) -> DataFrame:
        """A run per source and six hours; items found are its events."""
        block = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600)
        g = (self.raw("events").groupBy(block.alias("b"), F.col("event_type").alias("source_key"))
             .agg(F.count("*").alias("n"), F.min("event_id").alias("run_id")))
        b, start = F.col("b"), F.timestamp_seconds(F.col("b") * 21600)
        found = F.when(b % 11 == 0, F.floor(F.col("n") / 4)).otherwise(F.col("n"))
        return g.select(
            "run_id", "source_key", start.alias("started_at"),
            (start + F.make_dt_interval(mins=F.lit(10))).alias("finished_at"),
            F.when(b % 13 == 0, "failed").when(b % 7 == 0, "partial").otherwise("ok").alias("status"),
            found.alias("items_found"), (b % 5 != 0).alias("is_full_sweep"),
            (b % 3).alias("parse_failures"))

    def failures(self) -> DataFrame:
        k = F.col("event_id")
        return self.raw("events").filter(F.col("event_type") == "error").select(
            k.alias("raw_document_id"), F.when(k % 3 != 0, F.col("ts").cast("timestamp"))
            .alias("resolved_at"))

    def sources(self) -> DataFrame:
        return self.notices().select("source_key").distinct().select(
            "source_key", F.concat(F.lit("Source "), "source_key").alias("name"))

    # ------------------------------------------------- versions and awards

    def versions(self) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("l_orderkey").orderBy(
            "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        n, qty, tax = F.row_number().over(w), F.col("l_quantity"), F.col("l_tax")
        # Every order is read; a version's shape follows from its line.
        change = lambda old, new: F.struct(old.cast("string").alias("old"), new.cast("string").alias("new"))
        one = lambda name, old: F.map_from_arrays(F.array(F.lit(name)), F.array(change(old, qty)))
        empty = F.map_from_arrays(strings(), F.array().cast("array<struct<old:string,new:string>>"))
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("notice_id"), n.alias("version_no"),
            F.col("l_shipdate").cast("timestamp").alias("observed_at"),
            F.when(qty < 10, empty).when(tax < 0.03, one("district", F.lit(None)))
            .otherwise(one("closing_at", F.col("l_linenumber"))).alias("changed_fields"),
            F.when(F.col("l_returnflag") == "A", "corrigendum")
            .when(F.col("l_returnflag") == "R", "extension")
            .when(tax < 0.05, "enrichment").otherwise("cancellation").alias("change_type"))

    def awards(self) -> DataFrame:
        l = (self.raw("lineitem").join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
             .join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
             .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")))
        line = F.col("l_linenumber")
        return l.select(
            F.lit("awards").alias("source_key"),
            # Awards also name notices from before the corpus.
            F.when(line == 7, F.concat(F.lit("old-"), F.col("l_orderkey").cast("string")))
            .otherwise(F.col("l_orderkey").cast("string")).alias("tender_external_ref"),
            F.when(line != 3, line.cast("string")).alias("pkg_lot_id"),
            F.col("c_name").alias("procuring_entity"),
            F.substring("o_orderpriority", 1, 1).alias("procurement_method"),
            F.concat(F.lit("D"), F.col("c_nationkey").cast("string")).alias("district_name"),
            F.col("s_name").alias("winner"),
            F.when(F.col("l_quantity") > 2, F.floor("l_extendedprice").cast("decimal(18,4)"))
            .alias("value_crore"),
            F.col("o_orderdate").cast("timestamp").alias("advertised_at"),
            F.col("l_shipdate").cast("timestamp").alias("contract_signed_at"),
            F.lit(None).cast("long").alias("raw_document_id"))

    # -------------------------------------------------------- observations

    def observations(self) -> DataFrame:
        """Four observations per order: list sweeps and detail pages that differ."""
        o = self.raw("orders").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
        k, key = F.col("k"), F.col("o_orderkey")
        date = F.col("o_orderdate").cast("timestamp")
        detail = (key + k) % 4 == 2
        money = "decimal(18,2)"
        return o.select(
            F.when(key % 5 == 0, "offline").otherwise("etender").alias("source_key"),
            key.cast("string").alias("external_ref"),
            F.when(detail, "detail").otherwise("list").alias("kind"),
            (date + days(k)).alias("observed_at"),
            F.when(detail, F.concat(F.lit("Order "), key.cast("string")))
            .when(key % 3 == 0, F.concat(F.lit("order "), key.cast("string"))).alias("title"),
            F.when(key % 6 == k, F.concat(F.lit("PKG/"), key.cast("string"))).alias("package_no"),
            F.concat(F.lit("REF/"), F.col("o_custkey").cast("string")).alias("reference_no"),
            F.when((key + k) % 7 == 0, "").otherwise(F.concat(
                F.lit("Supply "), (key % 9 + F.when(k == 3, 1).otherwise(0)).cast("string")))
            .alias("description"),
            F.when(detail, F.concat(F.lit("D"), (key % 25).cast("string"))).alias("district"),
            F.lit("goods").alias("procurement_nature"),
            F.when(detail & (key % 2 == 0), F.floor("o_totalprice").cast(money)).alias("tender_security"),
            F.when(detail, F.lit(500).cast(money)).alias("document_price"),
            date.alias("published_at"),
            F.when(key % 8 != 0, date + days(F.lit(20) + F.when((key + k) % 5 == 0, 7).otherwise(0)))
            .alias("closing_at"),
            F.when((key % 31 == 0) & (k >= 2), "cancelled").otherwise("live").alias("status"),
            (key * 4 + k).alias("raw_document_id"))

    # ------------------------------------------------------- HTML payloads

    def _payloads(self, rows: DataFrame, source: str, kind: str) -> DataFrame:
        """Pack (page, pos, html) rows, at most a page's worth each, into payloads.

        Pages are dealt over as many tasks as their size asks for, a core's worth at least:
        parsing costs far more per byte than a shuffle does."""
        pages = rows.repartition("page").groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
            F.struct("pos", "html"))), lambda x: x["html"]), "").alias("html"))
        return pages.select(
            F.lit(source).alias("source_key"), F.col("page").alias("run_id"),
            F.concat(F.lit("page-"), F.col("page").cast("string")).alias("url"),
            F.lit(kind).alias("kind"), F.lit(AS_OF).cast("timestamp").alias("fetched_at"),
            F.lit("text/html").alias("content_type"), F.encode("html", "UTF-8").alias("content"),
            F.create_map(F.lit("page_no"), F.col("page").cast("string")).alias("meta"))

    def _local(self, c: Column, pattern: str = "dd-MMM-yyyy HH:mm") -> Column:
        return F.date_format(F.from_utc_timestamp(c, "Asia/Dhaka"), pattern)

    def _described(self, demonstration: int | None) -> DataFrame:
        """Notices, every so many of them described as demonstration data."""
        n = self.notices()
        return n if demonstration is None else n.withColumn("description", F.when(
            F.col("id") % demonstration == 0, F.lit("This is an invalid tender")).otherwise(F.col("description")))

    def list_payloads(self, demonstration: int | None = None) -> DataFrame:
        n = self._described(demonstration)
        row = F.concat(
            F.lit("<tr class='r'><td>1</td><td>"), "external_ref", F.lit(",<br/>"), "reference_no",
            F.lit(",<br/><label>"), F.initcap("status"), F.lit("</label></td><td>"),
            F.initcap("procurement_nature"), F.lit(",<br /><a href='#'><span><p>"),
            F.coalesce(F.concat("package_no", F.lit("<br />\n")), F.lit("")),
            F.coalesce("description", F.lit("Pipes &amp; fittings")),
            F.lit("</p>\n</span></a></td><td>"),
            F.when(F.col("id") % 2 == 0, F.lit("Ministry of Trade, Industry,<br/> Division A,<br/> "))
            .otherwise(""), F.lit("Agency B,<br/> "), "organization_path", F.lit("</td><td>"),
            "procurement_type", F.lit(",<br /> Open Tendering Method (OTM)</td><td>"),
            self._local(F.col("published_at")), F.lit(",<br />"),
            F.coalesce(self._local(F.col("closing_at")), F.lit("-")), F.lit("</td></tr>"))
        return self._payloads(n.select(F.floor(F.col("id") / 10).alias("page"),
                                       F.col("id").alias("pos"), row.alias("html")), "etender", "list")

    def offline_payloads(self, demonstration: int | None = None) -> DataFrame:
        n = self._described(demonstration)
        row = F.concat(
            F.lit("<tr><td>1</td><td>"), "external_ref", F.lit("<br/>"), "reference_no",
            F.lit("</td><td>"), F.initcap("procurement_nature"),
            F.lit("<br/><a href='ViewTenderWithoutPQ.jsp?p=AB"), "external_ref",
            F.lit("' class='link'>"), F.coalesce("description", F.lit("Desk &quot;large&quot;")),
            F.lit("</a></td><td>Ministry C<br/>"), "organization_path",
            F.lit("<br/>MD PERSON</td><td>NCT<br/>Direct Procurement</td><td>"),
            self._local(F.col("published_at"), "dd-MMM-yyyy"), F.lit("<br/>"),
            F.coalesce(self._local(F.col("closing_at"), "dd-MMM-yyyy"), F.lit("")),
            F.lit("</td><td><a href='x'>View</a></td></tr>"))
        return self._payloads(n.select(F.floor(F.col("id") / 20).alias("page"),
                                       F.col("id").alias("pos"), row.alias("html")), "offline", "list")

    def detail_payloads(self) -> DataFrame:
        n = self.notices()
        pair = lambda label, value: F.concat(
            F.lit(f"<td>{label} :</td><td>"), F.coalesce(value, F.lit("")), F.lit("</td>"))
        lot = lambda no, amount: F.concat(
            F.lit(f"<tr><td>{no}</td><td>Lot  {no}</td><td>Sadar</td><td>"),
            F.coalesce(amount.cast("string"), F.lit("-")),
            F.lit("</td><td>01-Jan-1999</td><td>01-Jun-1999</td></tr>"))
        html = F.concat(
            F.lit("<html><body><table><tr><td><table>"),
            F.lit("<tr>"), pair("Ministry", F.lit("Ministry C")),
            pair("Procuring Entity Name", F.col("organization_path")), F.lit("</tr><tr>"),
            pair("Procuring Entity<br/>District", F.col("district")),
            pair("Tender/Proposal ID", F.col("external_ref")), F.lit("</tr><tr>"),
            pair("Tender/Proposal Package No. and Description", F.concat(
                F.coalesce(F.concat("package_no", F.lit("<br/>")), F.lit("")),
                F.coalesce("description", F.lit("Pipes &amp; fittings")))),
            pair("Procurement Nature", F.initcap("procurement_nature")), F.lit("</tr><tr>"),
            pair("Category", F.lit("Works; Roads , Bridges;")),
            pair("Tender/Proposal Document Price (In BDT)", F.col("document_price").cast("string")),
            F.lit("</tr><tr>"),
            pair("Tender/Proposal Closing<br/>Date and Time", self._local(F.col("closing_at"))),
            pair("Procurement Method", F.lit("Limited Tendering Method (LTM)")),
            F.lit("</tr></table></td></tr></table><table>"),
            lot(1, F.col("tender_security")), lot(2, F.col("document_price")),
            F.lit("</table></body></html>"))
        return self._payloads(n.select(F.col("id").alias("page"), F.col("id").alias("pos"),
                                       html.alias("html")), "etender", "detail")

    def award_payloads(self) -> DataFrame:
        a = self.raw("lineitem").join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        key, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
        row = F.concat(
            F.lit("<tr><td>1</td><td>Ministry D<br/>Division E</td><td><a href=\"/v.jsp?pkgLotId="), line,
            F.lit("&tenderid="), key, F.lit("\">"), key, F.lit(", REF,"), line,
            F.lit("</a><br/> <span class='more'> Supply  of part "), F.col("l_partkey").cast("string"),
            F.lit(" </span> Date: "), F.date_format("l_shipdate", "dd/MM/yyyy"),
            F.lit("</td><td>Entity "), (F.col("l_orderkey") % 7).cast("string"),
            F.lit("<br/> RFQ</td><td>Dist</td><td>"), F.date_format("l_shipdate", "dd-MMM-yyyy"),
            F.lit("</td><td>"), F.when(F.col("l_quantity") > 1, F.col("s_name")).otherwise(""),
            F.lit("</td><td>"), F.when(F.col("l_returnflag") == "A", "N/A").otherwise(
                F.format_number(F.floor("l_extendedprice"), 0)), F.lit("</td></tr>"))
        pos = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
        return self._payloads(a.select(F.col("l_orderkey").alias("page"), pos.alias("pos"),
                                       row.alias("html")), "awards", "list")

    def page_payloads(self) -> DataFrame:
        """The raw web pages as payloads, fetched one per minute."""
        k = F.col("page_id")
        return self.raw("pages").select(
            F.concat(F.lit("site"), (k % 3).cast("string")).alias("source_key"),
            (k % 7).alias("run_id"), "url", F.lit("document").alias("kind"),
            F.timestamp_seconds(k * 60 + 883612800).alias("fetched_at"),
            F.lit("text/html").alias("content_type"), F.encode("html", "UTF-8").alias("content"),
            F.create_map(F.lit("page"), k.cast("string")).alias("meta"))

    # -------------------------------------------------------------- signups

    def signups(self) -> DataFrame:
        k = F.col("c_custkey")
        digits = F.lpad(k.cast("string"), 8, "0")
        return self.raw("customer").select(
            k.alias("signup_id"),
            F.when(k % 9 == 0, "12345").when(k % 4 == 0, F.concat(
                F.lit("+880 1"), (k % 8 + 2).cast("string"), F.lit("-"), digits))
            .otherwise(F.concat(F.lit("01"), (k % 8 + 2).cast("string"), digits)).alias("phone"),
            F.when(k % 7 == 0, "bad address").otherwise(F.concat(
                F.lit(" c"), k.cast("string"), F.lit("@mail.example "))).alias("email"),
            F.repeat(F.lit("we supply "), (k % 12).cast("int")).alias("business_description"),
            F.when(k % 5 == 0, "2,000").otherwise("").alias("min_security"),
            F.when(k % 10 == 0, "1,500").when(k % 3 == 0, "x").otherwise("9,000").alias("max_security"),
            F.array(F.lit("goods"), F.lower("c_mktsegment")).alias("natures"))
