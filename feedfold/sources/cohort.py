"""Cohort manifest: which app/storefront feeds to read, and its seeding into dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedfold.operators.expect import check_rule

# The seven required manifest fields.
MANIFEST_SCHEMA = T.StructType([
    T.StructField("app_id", T.StringType()),
    T.StructField("app_name", T.StringType()),
    T.StructField("vertical", T.StringType()),
    T.StructField("storefront", T.StringType()),
    T.StructField("expected_language", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("notes", T.StringType()),
])

# Settings used when the manifest does not name them.
DEFAULT_SETTINGS = {"max_pages_per_app": 2, "timeout_seconds": 15.0, "retry_count": 3, "delay_seconds": 1.0}


def cohort_manifest(raw: DataFrame) -> DataFrame:
    """Typed manifest; storefront and language are lower-cased, a missing field is an error."""
    missing = sorted(set(MANIFEST_SCHEMA.names) - set(raw.columns))
    if missing:
        raise ValueError(f"manifest is missing fields: {', '.join(missing)}")
    lowered = {"storefront", "expected_language"}
    return raw.select(*[
        (F.lower(F.col(f.name)) if f.name in lowered else F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in MANIFEST_SCHEMA
    ])


def settings(spark: SparkSession, values: dict | None = None) -> DataFrame:
    merged = {**DEFAULT_SETTINGS, **(values or {})}
    row = (int(merged["max_pages_per_app"]), float(merged["timeout_seconds"]),
           int(merged["retry_count"]), float(merged["delay_seconds"]))
    return spark.createDataFrame(
        [row], "max_pages_per_app int, timeout_seconds double, retry_count int, delay_seconds double")


def settings_rules() -> dict[str, Column]:
    return {
        "max_pages_per_app": F.col("max_pages_per_app").between(1, 10),
        "timeout_seconds": F.col("timeout_seconds") > 0,
        "retry_count": F.col("retry_count") >= 1,
        "delay_seconds": F.col("delay_seconds") >= 0,
    }


def settings_violations(frame: DataFrame) -> DataFrame:
    return check_rule(frame, "settings", settings_rules(), F.lit("settings"))


def cohort_filter(manifest: DataFrame, app_ids: list[str] | DataFrame | None = None,
                  storefront: str | None = None, strict: bool = False) -> DataFrame:
    """Enabled feeds, optionally limited to ids (a list or a table with ``app_id``) and a storefront."""
    kept = manifest.filter("enabled")
    if isinstance(app_ids, DataFrame):
        kept = kept.join(app_ids.select("app_id"), "app_id", "left_semi")
    elif app_ids:
        kept = kept.filter(F.col("app_id").isin(*app_ids))
    if storefront:
        kept = kept.filter(F.col("storefront") == storefront.lower())
    if strict and kept.isEmpty():
        raise ValueError("no enabled feed matches the filters")
    return kept


def dimension_upsert(manifest_versions: DataFrame, platform: str, max_pages: int) -> dict[str, DataFrame]:
    """Fold manifest versions into verticals, apps and storefronts.

    ``manifest_versions`` is the manifest plus ``version``; a vertical is kept once it was seen, an
    app or storefront takes the values of its latest version.
    """
    versions = manifest_versions.withColumn("source_platform", F.lit(platform))
    verticals = versions.select(F.col("vertical").alias("vertical_name")).distinct()
    apps = (
        versions.groupBy("source_platform", F.col("app_id").alias("source_app_id"))
        .agg(F.max_by(F.struct("app_name", F.col("vertical").alias("vertical_name"),
                               F.col("enabled").alias("is_active")),
                      F.struct("version", "storefront")).alias("latest"))
        .select("source_platform", "source_app_id", "latest.*")
    )
    storefronts = (
        versions.groupBy(F.col("app_id").alias("source_app_id"), "storefront")
        .agg(F.max_by(F.struct("expected_language", F.col("enabled").alias("is_active")),
                      F.col("version")).alias("latest"))
        .select("source_app_id", "storefront", "latest.*", F.lit(max_pages).alias("max_pages_per_run"))
    )
    return {"verticals": verticals, "apps": apps, "storefronts": storefronts}


def dimension_counts(dims: dict[str, DataFrame]) -> DataFrame:
    counted = [
        dims[name].select(F.lit(name).alias("dimension")).groupBy("dimension").agg(F.count("*").alias("row_count"))
        for name in ("verticals", "apps", "storefronts")
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def app_context(requests: DataFrame, storefronts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested feeds found among the seeded storefronts, and those that were never seeded."""
    key = ["source_app_id", "storefront"]
    seeded = storefronts.select(*key)
    return requests.join(seeded, key, "left_semi"), requests.join(seeded, key, "left_anti")
