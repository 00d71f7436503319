"""Repeated-run validation: raw observations, window changes, quality of the result, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedfold.operators.accounting import COUNTERS, FEED_RUN
from feedfold.operators.entries import page_facts
from feedfold.sources.pages import PAGE_KEY

# The acceptance gates and their thresholds.
MIN_VERTICALS = 6
MIN_REVIEWS = 1000


def raw_observations(raw_pages: DataFrame) -> DataFrame:
    """Pages re-parsed from their stored bodies: hash, non-empty ids, entry count, parse error.

    A page's id list is bounded by the page itself; pages without entries stay.
    """
    return page_facts(raw_pages).select(
        *PAGE_KEY, "response_hash", F.coalesce("review_ids", F.array().cast("array<string>")).alias("review_ids"),
        F.when(~F.col("is_json"), F.lit("invalid JSON")).alias("parse_error")
    ).withColumn("entry_count", F.size("review_ids").cast("bigint"))


def window_changes(observations: DataFrame) -> DataFrame:
    """Pages seen more than once whose hash or id set differs between runs."""
    ids = F.sha2(F.array_join(F.array_sort("review_ids"), ","), 256)
    grouped = observations.select("source_app_id", "storefront", "page_number", "run_id", "response_hash",
                                  ids.alias("ids"), "entry_count").groupBy("source_app_id", "storefront", "page_number")
    changed = grouped.agg(
        F.count("*").alias("observation_count"),
        (F.min("response_hash") != F.max("response_hash")).alias("response_hash_changed"),
        (F.min("ids") != F.max("ids")).alias("review_window_changed"),
        F.array_sort(F.collect_list(F.struct("run_id", "entry_count"))).alias("runs"))
    return changed.filter((F.col("observation_count") > 1)
                          & (F.col("response_hash_changed") | F.col("review_window_changed")))


def run_summary(runs: DataFrame, counters: DataFrame, observations: DataFrame) -> DataFrame:
    """Per run and feed: its counters next to the run's, and what its stored pages hold."""
    pages = observations.groupBy(*FEED_RUN).agg(
        F.count("*").alias("stored_pages"), F.sum("entry_count").alias("stored_entries"),
        F.count_if(F.col("parse_error").isNotNull()).alias("unreadable_pages"))
    totals = runs.select("run_id", *[F.col(c).alias(f"run_{c}") for c in COUNTERS],
                         F.col("run_status").alias("overall_status"))
    return (counters.join(pages, FEED_RUN, "left").fillna(0, ["stored_pages", "stored_entries", "unreadable_pages"])
            .join(totals, "run_id"))


def run_pages(observations: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of every run as rows: what their stored body holds and whether they loaded."""
    status = pages.select(*PAGE_KEY, "parse_status", F.col("parse_error").alias("load_error"))
    return observations.join(status, PAGE_KEY).select(
        *PAGE_KEY, "response_hash", "entry_count", "parse_status", F.coalesce("parse_error", "load_error").alias("parse_error"))


def dataset_quality(reviews: DataFrame) -> DataFrame:
    invalid = (F.col("source_review_id").isNull() | F.col("rating").isNull() | F.col("body").isNull()
               | (F.length(F.trim("body")) == 0) | F.col("published_at").isNull())
    totals = reviews.agg(F.count("*").alias("total_reviews"), F.count_if(invalid).alias("invalid_required"))
    return _one_row(totals,
                    _distinct(reviews, "unique_source_keys", "source_platform", "source_app_id", "storefront",
                              "source_review_id"),
                    _distinct(reviews, "apps_represented", "source_platform", "source_app_id"))


def _distinct(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Distinct count as a two-step aggregation, combined before each shuffle."""
    return df.select(*keys).dropna().distinct().agg(F.count("*").alias(name))


def _one_row(*facts: DataFrame) -> DataFrame:
    """Put one-row frames side by side by stacking them and taking the value that is there."""
    names = [c for f in facts for c in f.columns]
    stacked = facts[0]
    for fact in facts[1:]:
        stacked = stacked.unionByName(fact, allowMissingColumns=True)
    return stacked.agg(*[F.max(n).alias(n) for n in names])


def verticals_represented(view: DataFrame) -> DataFrame:
    return _distinct(view, "verticals_represented", "vertical_name")


def clean_export_count(view: DataFrame) -> DataFrame:
    return view.agg(F.count_if((F.col("detected_language") == "en") & (F.col("has_error_flag") == 0))
                    .alias("english_without_error_rows"))


def flags_over_runs(flag_maps: DataFrame) -> DataFrame:
    """Sum of the per-run flag maps."""
    return (flag_maps.select(F.explode("flag_counts").alias("flag_type", "n"))
            .groupBy("flag_type").agg(F.sum("n").alias("observed_count")))


def duplicate_behavior(reviews: DataFrame, runs: DataFrame) -> DataFrame:
    return _one_row(reviews.agg(F.count("*").alias("canonical_reviews")),
                    _distinct(reviews, "unique_source_keys", "source_platform", "source_app_id", "storefront",
                              "source_review_id"),
                    runs.agg(F.sum("reviews_updated").alias("repeated_observation_updates")))


def acceptance_gates(view: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per gate, and ``ready_for_ds`` when all pass.

    Apps represented are compared with the largest number of feeds any run attempted.
    """
    last = runs.agg(F.max_by(F.struct("run_status", "failed_requests"), "run_id").alias("last"),
                    F.max("apps_attempted").alias("expected_apps"))
    facts = _one_row(dataset_quality(view), verticals_represented(view), last.select(
        "expected_apps",
        ((F.col("last.run_status") == "completed") & (F.col("last.failed_requests") == 0)).alias("last_run_clean")))
    gates = facts.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("all_configured_apps_represented", "at_least_six_verticals",
                                     "at_least_1000_unique_reviews", "no_duplicate_source_keys",
                                     "no_invalid_required_fields", "final_run_has_no_app_or_request_failures")]),
        F.array(F.col("apps_represented") >= F.col("expected_apps"), F.col("verticals_represented") >= MIN_VERTICALS,
                F.col("unique_source_keys") >= MIN_REVIEWS, F.col("total_reviews") == F.col("unique_source_keys"),
                F.col("invalid_required") == 0, F.col("last_run_clean")))).alias("gate", "passed"))
    return gates.unionByName(gates.agg(F.bool_and("passed").alias("passed")).select(
        F.lit("ready_for_ds").alias("gate"), "passed"))
