"""Reports as one nested document each, with bounded lists and a count of what a list leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedfold.operators import comparison
from feedfold.operators.accounting import COUNTERS

MOST_RUNS = 50
MOST_FEEDS = 200
MOST_PAGES = 50


def bounded_list(rows: DataFrame, keys: list[str], order: list[str], item: Column, most: int, name: str) -> DataFrame:
    """Per group the first ``most`` items as an array ``name`` in order, and how many it leaves out (``name``_left_out).

    The rank limit prunes each task's rows before the shuffle, so that a group of any size sends ``most`` rows a task.
    """
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    first = rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_place") <= most)
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", item.alias("_item")))).alias("_items"))
    return total.join(listed, keys).select(
        *keys, F.transform("_items", lambda x: x["_item"]).alias(name), (F.col("_n") - F.size("_items")).alias(f"{name}_left_out"))


def run_documents(runs: DataFrame, counters: DataFrame, pages: DataFrame) -> DataFrame:
    """(run_id, report): a run's totals, its feeds and their pages as one JSON document per run."""
    feed = ["run_id", "source_app_id", "storefront"]
    page = F.struct("entry_count", "page_number", "parse_error", "parse_status", "response_hash")
    paged = bounded_list(pages, feed, ["page_number", "response_hash"], page, MOST_PAGES, "pages")
    feeds = counters.join(paged, feed, "left").withColumns({
        "pages": F.coalesce("pages", F.array().cast(paged.schema["pages"].dataType)),
        "pages_left_out": F.coalesce("pages_left_out", F.lit(0).cast("bigint"))})
    one = F.struct("pages", "pages_left_out", "run_status", "source_app_id", "stats", "storefront")
    feeds = feeds.withColumn("stats", F.struct(*sorted(COUNTERS)))
    listed = bounded_list(feeds, ["run_id"], ["source_app_id", "storefront"], one, MOST_FEEDS, "feeds")
    whole = runs.select("run_id", F.col("run_status").alias("status"), F.struct("apps_attempted", *sorted(COUNTERS)).alias("stats"))
    return whole.join(listed, "run_id", "left").select("run_id", F.to_json(
        F.struct("feeds", "feeds_left_out", "run_id", "stats", "status"), {"ignoreNullFields": "false"}).alias("report"))


def validation_document(reviews: DataFrame, view: DataFrame, runs: DataFrame, flag_maps: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: the validation report over all runs (gates, duplicates, export, flags, window changes, latest runs) as JSON."""
    def named(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))

    def facts(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct(*sorted(df.columns)).alias(name))

    gates = comparison.acceptance_gates(view, runs)
    quality = comparison.dataset_quality(reviews).unionByName(
        comparison.clean_export_count(view), allowMissingColumns=True).unionByName(
        comparison.verticals_represented(view), allowMissingColumns=True)
    quality = quality.agg(*[F.max(c).alias(c) for c in quality.columns])
    window = changes.agg(F.count(F.lit(1)).alias("changed_pages"), F.count_if("response_hash_changed").alias("hash_changed"),
                         F.count_if("review_window_changed").alias("window_changed"))
    latest = bounded_list(runs.withColumn("_all", F.lit(0)).withColumn("_last", -F.col("run_id")), ["_all"], ["_last"],
                          F.struct("failed_requests", "reviews_inserted", "run_id", "run_status"), MOST_RUNS, "runs").drop("_all")
    parts = [named(gates.filter("gate <> 'ready_for_ds'"), "gate", "passed", "acceptance_gates"),
             facts(comparison.duplicate_behavior(reviews, runs), "duplicate_behavior"), facts(quality, "export"),
             named(comparison.flags_over_runs(flag_maps), "flag_type", "observed_count", "quality_flags_by_type"),
             gates.filter("gate = 'ready_for_ds'").select(F.col("passed").alias("ready_for_ds")), latest, facts(window, "window_changes")]
    stacked = parts[0]
    for part in parts[1:]:  # one row each: stacked, then the value that is there
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    row = stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])
    return row.select(F.to_json(F.struct(*sorted(row.columns)), {"ignoreNullFields": "false"}).alias("report"))
