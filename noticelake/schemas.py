"""Explicit schemas. Nothing in the library infers a schema at run time."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
CRORE = T.DecimalType(18, 4)

ORGANIZATION = T.StructType([
    T.StructField("ministry", T.StringType()),
    T.StructField("division", T.StringType()),
    T.StructField("agency", T.StringType()),
    T.StructField("procuring_entity", T.StringType()),
])

LOT = T.StructType([
    T.StructField("lot_no", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("security_amount", MONEY),
    T.StructField("start_date", T.TimestampType()),
    T.StructField("completion_date", T.TimestampType()),
])

# Fields a repeated observation of a notice carries, in storage order.
VALUE_FIELDS: dict[str, T.DataType] = {
    "title": T.StringType(),
    "title_bn": T.StringType(),
    "package_no": T.StringType(),
    "reference_no": T.StringType(),
    "description": T.StringType(),
    "organization": ORGANIZATION,
    "district": T.StringType(),
    "upazila": T.StringType(),
    "procurement_nature": T.StringType(),
    "procurement_type": T.StringType(),
    "procurement_method": T.StringType(),
    "estimated_value": MONEY,
    "tender_security": MONEY,
    "document_price": MONEY,
    "published_at": T.TimestampType(),
    "closing_at": T.TimestampType(),
    "opening_at": T.TimestampType(),
    "document_last_selling_at": T.TimestampType(),
    "status": T.StringType(),
    "categories": T.ArrayType(T.StringType()),
    "lots": T.ArrayType(LOT),
    "eligibility_text": T.StringType(),
    "project_name": T.StringType(),
    "app_id": T.StringType(),
    "detail_url": T.StringType(),
    "document_urls": T.ArrayType(T.StringType()),
}

# The fields whose change makes a new version of a notice.
HASH_FIELDS = (
    "title", "package_no", "reference_no", "description", "district", "upazila",
    "procurement_nature", "procurement_type", "procurement_method",
    "estimated_value", "tender_security", "document_price",
    "published_at", "closing_at", "opening_at", "status",
)

# The closed vocabularies of the data model.
ENUMS = {
    "procurement_nature": ("goods", "works", "services", "other"),
    "status": ("live", "closed", "cancelled", "awarded"),
    "run_status": ("running", "ok", "partial", "failed"),
    "change_type": ("new", "corrigendum", "cancellation", "extension", "enrichment"),
    "channel": ("email", "sms", "push"),
    "verdict": ("up", "down"),
}
AMENDMENT_TYPES = ("corrigendum", "cancellation", "extension")

KEY = ["source_key", "external_ref"]

OBSERVATION = T.StructType(
    [T.StructField("source_key", T.StringType(), False),
     T.StructField("external_ref", T.StringType(), False),
     T.StructField("kind", T.StringType(), False),
     T.StructField("observed_at", T.TimestampType(), False)]
    + [T.StructField(n, t) for n, t in VALUE_FIELDS.items()]
    + [T.StructField("raw_document_id", T.LongType())]
)

NOTICE = T.StructType(
    [T.StructField("source_key", T.StringType(), False),
     T.StructField("external_ref", T.StringType(), False)]
    + [T.StructField(n, t) for n, t in VALUE_FIELDS.items()]
    + [T.StructField("canonical_hash", T.StringType()),
       T.StructField("version_no", T.IntegerType()),
       T.StructField("first_seen_at", T.TimestampType()),
       T.StructField("last_seen_at", T.TimestampType()),
       T.StructField("detail_fetched_at", T.TimestampType())]
)

CHANGE = T.StructType([T.StructField("old", T.StringType()),
                       T.StructField("new", T.StringType())])
VERSION = T.StructType([
    T.StructField("source_key", T.StringType(), False),
    T.StructField("external_ref", T.StringType(), False),
    T.StructField("version_no", T.IntegerType()),
    T.StructField("change_type", T.StringType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("canonical_hash", T.StringType()),
    T.StructField("changed_fields", T.MapType(T.StringType(), CHANGE)),
    T.StructField("raw_document_id", T.LongType()),
])

PAYLOAD = T.StructType([
    T.StructField("source_key", T.StringType(), False),
    T.StructField("run_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("kind", T.StringType(), False),
    T.StructField("fetched_at", T.TimestampType(), False),
    T.StructField("content_type", T.StringType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])

RUN = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("source_key", T.StringType(), False),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("items_found", T.LongType()),
    T.StructField("items_new", T.LongType()),
    T.StructField("items_changed", T.LongType()),
    T.StructField("pages_fetched", T.LongType()),
    T.StructField("parse_failures", T.LongType()),
    T.StructField("is_full_sweep", T.BooleanType()),
    T.StructField("yield_anomaly", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

AWARD = T.StructType([
    T.StructField("source_key", T.StringType(), False),
    T.StructField("tender_external_ref", T.StringType()),
    T.StructField("pkg_lot_id", T.StringType()),
    T.StructField("reference_no", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("ministry", T.StringType()),
    T.StructField("procuring_entity", T.StringType()),
    T.StructField("procurement_method", T.StringType()),
    T.StructField("district_name", T.StringType()),
    T.StructField("winner", T.StringType(), False),
    T.StructField("value_crore", CRORE),
    T.StructField("advertised_at", T.TimestampType()),
    T.StructField("contract_signed_at", T.TimestampType()),
    T.StructField("detail_url", T.StringType()),
    T.StructField("raw_document_id", T.LongType()),
])

TABLES = {"notices": NOTICE, "versions": VERSION, "payloads": PAYLOAD,
          "runs": RUN, "awards": AWARD, "observations": OBSERVATION}
