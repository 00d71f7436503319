"""The training view and the health reports over the canonical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedfold.session import join_dimension
from feedfold.sources.exports import TRAINING_COLUMNS


def training_view(reviews: DataFrame, flags: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Reviews with app, vertical and storefront names, 24 columns and no identity."""
    apps = dims["apps"].select("source_platform", "source_app_id", "app_name", "vertical_name")
    named = join_dimension(reviews, apps, ["source_platform", "source_app_id"])
    named = join_dimension(named, dims["verticals"].select("vertical_name"), ["vertical_name"])
    named = join_dimension(named, dims["storefronts"].select("source_app_id", "storefront"),
                           ["source_app_id", "storefront"])
    errors = (flags.filter(F.col("flag_severity") == "error").select("review_id").distinct()
              .withColumn("has_error_flag", F.lit(1)))
    marked = named.join(errors, "review_id", "left").withColumn(
        "has_error_flag", F.coalesce("has_error_flag", F.lit(0)))
    return marked.select(*TRAINING_COLUMNS)


def clean(view: DataFrame) -> DataFrame:
    return view.filter((F.col("detected_language") == "en") & (F.col("has_error_flag") == 0))


def latest_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(n).select(
        "run_id", "run_status", "started_at", "completed_at", "apps_attempted", "pages_fetched",
        "reviews_parsed", "reviews_inserted", "reviews_updated", "reviews_rejected")


def count_by(df: DataFrame, *keys: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def reviews_by_vertical_app(view: DataFrame) -> DataFrame:
    return view.groupBy("vertical_name", "app_name", "storefront").agg(
        F.count("*").alias("review_count"), F.min("published_at").alias("earliest_review_at"),
        F.max("published_at").alias("latest_review_at"))


def language_distribution(reviews: DataFrame) -> DataFrame:
    return count_by(reviews.withColumn("detected_language", F.coalesce("detected_language", F.lit("unknown"))),
                    "detected_language", name="review_count")


def missing_reviewer(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_if(F.col("author_fingerprint").isNull()).alias("reviews_without_reviewer"))


def duplicate_bodies(reviews: DataFrame, n: int = 50) -> DataFrame:
    """The bodies shared by most reviews of a feed; grouped by digest so no key carries the text."""
    grouped = reviews.groupBy("source_app_id", "storefront", F.sha2("body", 256).alias("body_digest")).agg(
        F.count("*").alias("duplicate_count"), F.min("review_id").alias("sample_review_id"))
    top = (grouped.filter("duplicate_count > 1")
           .orderBy(F.col("duplicate_count").desc(), "source_app_id", "storefront", "body_digest").limit(n))
    bodies = reviews.select(F.col("review_id").alias("sample_review_id"), "body")
    return bodies.join(F.broadcast(top), "sample_review_id").select(  # at most n rows
        "source_app_id", "storefront", "body", "duplicate_count")


def latest(view: DataFrame, n: int, *columns: str) -> DataFrame:
    """Newest n rows, ties by review id."""
    return view.orderBy(F.col("published_at").desc(), "review_id").limit(n).select(*columns)


def review_sample(view: DataFrame, n: int = 5) -> DataFrame:
    return latest(view, n, "app_name", "rating", "title", F.left("body", F.lit(140)).alias("body_excerpt"),
                  "published_at")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()])


def reviews_by_app(apps: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review count per app, apps without reviews included."""
    counts = reviews.groupBy("source_platform", "source_app_id").agg(F.count("*").alias("review_count"))
    return apps.join(counts, ["source_platform", "source_app_id"], "left").select(
        "source_app_id", "app_name", "vertical_name", F.coalesce("review_count", F.lit(0)).alias("review_count"))


def latest_run_outcomes(counters: DataFrame) -> DataFrame:
    return counters.filter(F.col("run_id") == counters.agg(F.max("run_id")).scalar())
