"""Corrections of stored tables, each a projection or an anti join, never a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticelake.functions.records import first_fill
from noticelake.operators.filters import exclude_test_records, stale, timestamp


def repair_stale_status(notices: DataFrame, as_of: str, source_key: str = "offline") -> DataFrame:
    """Close undated offline notices that are too old to still be open."""
    return notices.withColumn("status", F.when(stale(timestamp(as_of), source_key), "closed")
                              .otherwise(F.col("status")))


def repair_package_no(notices: DataFrame) -> DataFrame:
    """Prose stored as a package number moves to an empty description."""
    prose = F.coalesce(F.contains("package_no", F.lit(" ")), F.lit(False))
    empty = F.coalesce(F.col("description") == "", F.lit(True))
    return notices.withColumns({
        "description": F.when(prose & empty, F.col("package_no")).otherwise(F.col("description")),
        "package_no": F.when(~prose, F.col("package_no"))})


def _phantom():
    return (F.col("version_no") > 1) & (F.cardinality("changed_fields") == 0)


def drop_phantom_versions(versions: DataFrame) -> DataFrame:
    """Versions that record no change are not amendments."""
    return versions.filter(~_phantom())


def latest_versions(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The current version per notice once phantoms are ignored."""
    cols = [c for c in versions.columns if c not in keys]
    return (drop_phantom_versions(versions).groupBy(*keys)
            .agg(F.max_by(F.struct(*cols), "version_no").alias("_v")).select(*keys, "_v.*"))


def repoint_current(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Notices whose newest version is a phantom, with the version to point to."""
    newest = versions.groupBy(*keys).agg(F.max("version_no").alias("phantom_version"))
    real = drop_phantom_versions(versions).groupBy(*keys).agg(F.max("version_no").alias("version_no"))
    return (newest.join(real, keys, "left")
            .filter(~F.col("version_no").eqNullSafe(F.col("phantom_version"))))


def reclassify_enrichment(versions: DataFrame) -> DataFrame:
    """Corrigenda that only filled in unknown fields become enrichments."""
    learned = ((F.col("change_type") == "corrigendum") & (F.cardinality("changed_fields") > 0)
               & first_fill(F.col("changed_fields")))
    return versions.withColumn("change_type", F.when(learned, "enrichment")
                               .otherwise(F.col("change_type")))


def delete_test_records(notices: DataFrame) -> DataFrame:
    return exclude_test_records(notices)


def cascade_delete(deleted: DataFrame, key: str, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every child table without the rows of the deleted ids."""
    gone = deleted.select(key).distinct()
    return {name: child.join(gone, key, "left_anti") for name, child in children.items()}
