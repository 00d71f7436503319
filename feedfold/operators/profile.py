"""Profiling of the feature table.

Exact percentiles keep one counter per distinct value, so their memory is bounded by the number of
different ratings or lengths and not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedfold.functions.stats import share
from feedfold.functions.text import redact_text
from feedfold.operators.features import WEAK_LABELS
from feedfold.operators.flags import FLAG_TYPES
from feedfold.sources.lexicon import ISSUE_SIGNALS

FLAG_COLUMNS = [f"quality_flag_{t}" for t in FLAG_TYPES]
ISSUE_COLUMNS = [f"issue_{s}" for s in ISSUE_SIGNALS]


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, missing and distinct values (NULL counts as a value) per column.

    The exact form turns every cell into a (column, value) pair and counts distinct pairs in two
    combined steps; long texts are replaced by their digest. ``approximate`` needs a single pass.
    """
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    if approximate:
        cells = df.agg(*[F.struct(
            F.count_if(F.col(c).isNull()).alias("missing_count"),
            (F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias("unique_values")).alias(c)
            for c in df.columns])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("m")) for c in df.columns]))
        return cells.select(pairs.alias("x")).select(
            "x.column_name", F.element_at(types, F.col("x.column_name")).alias("dtype"), "x.m.*")

    def value(field: T.StructField) -> Column:
        text = F.col(field.name).cast("string")
        return F.sha2(text, 256) if isinstance(field.dataType, T.StringType) else text

    pair = F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), value(f).alias("value")) for f in df.schema])).alias("x")
    distinct = df.select(pair).select("x.*").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    return distinct.groupBy("column_name").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
        F.count("*").alias("unique_values"),
    ).withColumn("dtype", F.element_at(types, F.col("column_name")))


def value_shares(features: DataFrame) -> DataFrame:
    """Count and share of every rating, and of every label (labels without rows included)."""
    counts = features.groupBy("rating", "weak_label").agg(F.count("*").alias("n"))  # at most a few rows
    total = counts.agg(F.sum("n")).scalar()
    ratings = counts.groupBy(F.col("rating").cast("string").alias("value")).agg(F.sum("n").alias("row_count")).select(
        F.lit("rating").alias("variable"), "value", "row_count")
    labels = counts.agg(*[F.coalesce(F.sum(F.when(F.col("weak_label") == l, F.col("n"))), F.lit(0)).alias(l)
                          for l in WEAK_LABELS]).unpivot([], list(WEAK_LABELS), "value", "row_count").select(
        F.lit("weak_label").alias("variable"), "value", "row_count")
    return ratings.unionByName(labels).withColumn("share", share(F.col("row_count"), total))


def label_shares(features: DataFrame, key: str) -> DataFrame:
    """Share of each weak label within every value of ``key``."""
    return features.groupBy(key).agg(*[
        F.avg((F.col("weak_label") == l).cast("double")).alias(f"label_share_{l}") for l in WEAK_LABELS])


def rating_stats(features: DataFrame, key: str) -> DataFrame:
    return features.groupBy(key).agg(
        F.count("rating").alias("review_count"), F.avg("rating").alias("rating_mean"),
        F.median("rating").alias("rating_median"),
        *[F.avg((F.col("weak_label") == l).cast("double")).alias(f"label_share_{l}") for l in WEAK_LABELS])


def length_describe(features: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of both lengths per label."""
    parts = [features.groupBy("weak_label").agg(
        F.lit(c).alias("variable"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.max(c).cast("double").alias("max")) for c in ("body_char_count", "body_word_count")]
    return parts[0].unionByName(parts[1]).select(
        "weak_label", "variable", "n", "mean", "std", "min",
        *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("p25", "p50", "p75"))], "max")


def clipped_box_stats(features: DataFrame, column: str = "body_char_count", clip_at: float = 0.99) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers per label after clipping at a global percentile."""
    limit = features.agg(F.percentile(column, clip_at)).scalar()
    clipped = features.select("weak_label", F.least(F.col(column).cast("double"), limit).alias("x"))
    quartiles = clipped.groupBy("weak_label").agg(
        F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    quartiles = quartiles.select("weak_label", *[
        F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside_low, inside_high = F.col("x") >= F.col("q1") - reach, F.col("x") <= F.col("q3") + reach
    return clipped.join(F.broadcast(quartiles), "weak_label").groupBy("weak_label", "q1", "median", "q3").agg(
        F.min(F.when(inside_low, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside_high, F.col("x"))).alias("whisker_high"))  # three labels


def flag_share(features: DataFrame, key: str, flag: str, name: str) -> DataFrame:
    """Share of rows without and with a 0/1 flag per value of ``key``."""
    return features.groupBy(key).agg(
        F.avg(1.0 - F.col(flag)).alias(f"no_{name}_share"), F.avg(F.col(flag).cast("double")).alias(f"{name}_share"))


def time_range(features: DataFrame) -> DataFrame:
    return features.agg(F.min("published_at").alias("earliest"), F.max("published_at").alias("latest"),
                        F.count_if(F.col("published_at").isNull()).alias("unparsable"))


def month_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("published_year", "published_month").agg(F.count("*").alias("reviews"))


def weekday_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("published_day_of_week").agg(F.count("*").alias("reviews"))


def indicator_totals(features: DataFrame) -> DataFrame:
    columns = [*FLAG_COLUMNS, *ISSUE_COLUMNS]
    return features.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]).unpivot(
        [], columns, "indicator", "reviews")


def issue_overlap(features: DataFrame) -> DataFrame:
    return features.groupBy(F.col("issue_signal_count").alias("issue_signals_per_review")).agg(
        F.count("*").alias("reviews"))


def label_diagnostics(features: DataFrame) -> DataFrame:
    """Largest label and app shares, review load, overlaps and signals that never match."""
    def largest(key: str, name: str) -> DataFrame:
        counts = features.groupBy(key).agg(F.count("*").alias("n"))
        return counts.agg(share(F.max("n"), F.sum("n")).alias("value")).select(F.lit(name).alias("diagnostic"), "value")

    facts = features.agg(
        F.sum("weak_label_needs_review").cast("double").alias("reviews_needing_label_review"),
        F.avg("weak_label_needs_review").alias("label_review_share"),
        F.count_if(F.col("issue_signal_count") > 1).cast("double").alias("reviews_with_multiple_issue_signals"),
        *[F.sum(c).alias(c) for c in ISSUE_COLUMNS])
    silent = sum((F.when(F.col(c) == 0, 1.0).otherwise(0.0) for c in ISSUE_COLUMNS), F.lit(0.0))
    names = ["reviews_needing_label_review", "label_review_share", "reviews_with_multiple_issue_signals",
             "issue_signals_with_zero_matches"]
    long = facts.withColumn(names[3], silent).unpivot([], names, "diagnostic", "value").select("diagnostic", "value")
    return long.unionByName(largest("weak_label", "largest_label_share")).unionByName(
        largest("app_name", "largest_app_share"))


def mismatch_by_app(features: DataFrame) -> DataFrame:
    flag = "quality_flag_rating_text_mismatch"
    return features.groupBy("app_name").agg(F.sum(flag).alias("mismatches"), F.avg(flag).alias("mismatch_share"))


def noise_examples(features: DataFrame, per_reason: int = 2, total: int = 12) -> DataFrame:
    """The first rows of every reason combination, redacted; pruned per task before the shuffle."""
    order = W.partitionBy("weak_label_noise_reasons").orderBy("app_name", "rating", "review_id")
    picked = (features.filter(F.col("weak_label_needs_review") == 1)
              .select("review_id", "app_name", "vertical_name", "rating", "weak_label", "weak_label_noise_reasons", "body")
              .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_reason)
              .orderBy("weak_label_noise_reasons", "place").limit(total))
    return picked.select("app_name", "vertical_name", "rating", "weak_label", "weak_label_noise_reasons", "place",
                         redact_text("body").alias("body_excerpt"))
