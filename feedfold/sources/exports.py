"""Sinks: training export, feature export with a content digest, JSON reports, annotation reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The training export's columns, in order.
TRAINING_COLUMNS = (
    "review_id", "source_platform", "source_review_id", "source_app_id", "app_name", "vertical_name",
    "storefront", "rating", "title", "body", "app_version", "published_at", "detected_language",
    "body_char_count", "body_token_estimate", "vote_count", "vote_sum", "first_seen_at", "last_seen_at",
    "first_seen_run_id", "last_seen_run_id", "first_raw_feed_page_id", "last_raw_feed_page_id",
    "has_error_flag",
)

# Reviewer identity that no training or feature output may carry.
IDENTITY_COLUMNS = ("reviewer_id", "author_label", "author_uri", "author_fingerprint")


def require_no_identity(df: DataFrame) -> DataFrame:
    leaked = sorted(set(df.columns) & set(IDENTITY_COLUMNS))
    if leaked:
        raise ValueError(f"identity columns in an identity-free output: {leaked}")
    return df


def training_export(training_view: DataFrame, english_only: bool = False) -> DataFrame:
    """The allow-listed columns; rows stay unordered so that only the sink pays for a global sort."""
    kept = training_view.select(*TRAINING_COLUMNS)
    if english_only:
        kept = kept.filter((F.col("detected_language") == "en") & (F.col("has_error_flag") == 0))
    return require_no_identity(kept)


def write_training_csv(export: DataFrame, path: str) -> None:
    """Newest first across the part files (a range shuffle, done at the sink only)."""
    (export.orderBy(F.col("published_at").desc(), "review_id")
     .write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"'))


def write_ordered_csv(export: DataFrame, path: str, newest: str = "published_at", tie: str = "review_id", parts: int | None = None) -> None:
    """Newest first over the part files: range-partitioned parts, and a manifest that tells their order and span.

    The parts' names follow their ranges; a reader that wants the newest rows opens the first parts only. Without ``parts`` Spark chooses their number.
    """
    order = [F.col(newest).desc_nulls_last(), F.col(tie)]
    ranged = export.repartitionByRange(parts, *order) if parts else export.repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order)
    ordered.write.mode("overwrite").csv(f"{path}/rows", header=True, quoteAll=True, escape='"', emptyValue="",
                                        timestampFormat="yyyy-MM-dd'T'HH:mm:ss'Z'", ignoreLeadingWhiteSpace=False,
                                        ignoreTrailingWhiteSpace=False)
    landed = export.sparkSession.read.csv(f"{path}/rows", header=True, schema=_text_schema(export.columns), multiLine=True, escape='"')
    manifest = landed.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).groupBy("file").agg(
        F.count("*").alias("row_count"), F.max(newest).alias("newest"), F.min(newest).alias("oldest"))
    manifest.orderBy("file").coalesce(1).write.mode("overwrite").csv(f"{path}/manifest", header=True)


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_ordered_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of an ordered export as text, with ``part`` (the file's place in the manifest) and ``line`` (the row's place in it)."""
    manifest = spark.read.csv(f"{path}/manifest", header=True, schema="file string, row_count long, newest string, oldest string")
    names = [r.file for r in manifest.orderBy("file").collect()]  # one row per part file
    rows = spark.read.csv(f"{path}/rows", header=True, schema=_text_schema(columns), multiLine=True, escape='"')
    rows = rows.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.monotonically_increasing_id().alias("row_no"))
    first = rows.groupBy("file").agg(F.min("row_no").alias("first_no"))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("file")) if names else F.lit(0)
    return rows.join(F.broadcast(first), "file").select(*columns, place.alias("part"), (F.col("row_no") - F.col("first_no")).alias("line"))


def content_digest(df: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """Order-independent digest of a table: row digests are folded per bucket, then over buckets.

    Each row digest contributes four 60-bit numbers that are summed exactly as DECIMAL, so the fold
    combines before the shuffle and no bucket is ever collected.
    """
    row_digest = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    rows = df.select(
        F.pmod(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("bigint"),
               F.lit(buckets)).alias("bucket"),
        row_digest.alias("digest"))
    words = [F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    per_bucket = rows.groupBy("bucket").agg(
        F.count("*").alias("row_count"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    whole = per_bucket.agg(
        F.sum("row_count").alias("row_count"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(4)])
    return whole.select(
        F.col("row_count"), F.sha2(F.concat_ws("|", *[F.col(f"w{i}").cast("string") for i in range(4)]), 256)
        .alias("content_digest"))


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def export_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def write_export(df: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """Write an export in buckets of its key (a power of two of them), with a Merkle tree of digests over the buckets.

    A leaf adds its rows' digests up as exact numbers, so it does not depend on their order and combines before the
    shuffle; a node is the digest of its two children. The tree has twice as many rows as there are buckets.
    """
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    named = df.withColumn("bucket", export_bucket(key, buckets))
    named.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    words = [F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    full = named.select("bucket", row_digest(df.columns).alias("digest")).groupBy("bucket").agg(
        F.count("*").alias("row_count"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    leaves = every.join(full, "bucket", "left").select(
        F.lit(0).alias("level"), F.col("bucket").alias("node"), F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("string") for i in range(4)]), 256).alias("digest"))
    level = 0
    leaves.coalesce(1).write.parquet(f"{path}/tree/depth=0")
    while buckets >> level > 1:
        below = df.sparkSession.read.parquet(f"{path}/tree/depth={level}")
        level += 1
        below.groupBy((F.col("node").bitwiseAND(-2) / 2).cast("int").alias("node")).agg(
            F.sum("row_count").alias("row_count"),
            F.sha2(F.concat(F.min_by("digest", "node"), F.max_by("digest", "node")), 256).alias("digest")).select(
            F.lit(level).alias("level"), "node", "row_count", "digest").coalesce(1).write.parquet(f"{path}/tree/depth={level}")


def export_root(spark: SparkSession, path: str) -> DataFrame:
    """The root of an export's tree: equal for equal rows."""
    tree = spark.read.parquet(f"{path}/tree")
    return tree.orderBy(F.desc("level")).limit(1).select("row_count", F.col("digest").alias("content_digest"))


def differing_buckets(spark: SparkSession, old: str, new: str) -> list[int]:
    """Buckets whose digests differ, found from the roots down: equal subtrees are not entered."""
    trees = [spark.read.parquet(f"{path}/tree") for path in (old, new)]
    top = [t.agg(F.max("level")).first()[0] for t in trees]
    if top[0] != top[1]:
        raise ValueError("the exports have different numbers of buckets")
    nodes = [0]
    for level in range(top[0], -1, -1):
        one, two = (t.filter((F.col("level") == level) & F.col("node").isin(nodes)).select("node", "digest") for t in trees)
        changed = [r.node for r in one.join(two.withColumnRenamed("digest", "other"), "node").filter("digest <> other").collect()]
        if level == 0 or not changed:
            return sorted(changed)
        nodes = [child for n in changed for child in (2 * n, 2 * n + 1)]
    return []


def export_diff(spark: SparkSession, old: str, new: str, key: str) -> DataFrame:
    """Rows (key, change, changed_columns) that were added, removed or changed; only buckets that differ are read."""
    buckets = differing_buckets(spark, old, new)

    def opened(path: str) -> DataFrame:
        schema = spark.read.parquet(f"{path}/rows").drop("bucket").schema
        present = {r.node for r in spark.read.parquet(f"{path}/tree").filter("level = 0 AND row_count > 0").select("node").collect()}
        paths = [f"{path}/rows/bucket={b}" for b in buckets if b in present]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    one, two = opened(old), opened(new)
    columns = [c for c in two.columns if c != key]
    one = one.select(F.col(key), F.struct(*[F.col(c) for c in columns]).alias("old"))
    two = two.select(F.col(key), F.struct(*[F.col(c) for c in columns]).alias("new"))
    both = one.join(two, key, "full")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in sorted(columns)]))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size("differing") > 0, "changed")
    return both.withColumn("differing", differs).withColumn("change", change).filter("change IS NOT NULL").select(
        key, "change", F.when(F.col("change") == "changed", F.array_join("differing", "|")).otherwise("").alias("changed_columns"))


def json_report(df: DataFrame, key: str) -> DataFrame:
    """One JSON document per report row."""
    return df.select(key, F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("report"))


def write_json_report(report: DataFrame, path: str) -> None:
    report.select("report").write.mode("overwrite").text(path)


def trim_cells(table: DataFrame) -> DataFrame:
    """Strip every cell and a byte-order mark left on the first header."""
    return table.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.lstrip("﻿"))
                          for c in table.columns])


def read_annotations(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Annotation CSV with every cell as trimmed text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return trim_cells(spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"',
                                     encoding="UTF-8", enforceSchema=True))


def audit_input_check(features: DataFrame) -> DataFrame:
    """Rows that break the audit's input rules: missing column, empty input, repeated review id."""
    # Columns the audit needs.
    required = ("review_id", "app_name", "vertical_name", "weak_label", "weak_label_needs_review",
                "weak_label_noise_reasons")
    missing = sorted(set(required) - set(features.columns))
    if missing:
        raise ValueError(f"audit input is missing columns: {missing}")
    repeated = (features.groupBy("review_id").agg(F.count("*").alias("n")).filter("n > 1")
                .select(F.lit("duplicate_review_id").alias("problem"), F.col("review_id").alias("detail"), "n"))
    empty = (features.agg(F.count("*").alias("n")).filter("n = 0")
             .select(F.lit("empty_input").alias("problem"), F.lit("").alias("detail"), "n"))
    return repeated.unionByName(empty)
