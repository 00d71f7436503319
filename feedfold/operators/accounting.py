"""Run and feed counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedfold.operators.fold import first_seen

FEED_RUN = ["run_id", "source_app_id", "storefront"]

# Counters of a run, in output order.
COUNTERS = ("pages_fetched", "reviews_parsed", "reviews_inserted", "reviews_updated", "reviews_rejected",
            "flags_created", "failed_requests")


def page_errors(pages: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Every failed request and every page that did not load, with its class."""
    requests = fetch_log.filter(F.col("error").isNotNull()).select(
        *FEED_RUN, "page_number", F.lit("request").alias("error_class"), F.col("error").alias("message"))
    broken = pages.filter(F.col("parse_status") == "parse_error").select(
        *FEED_RUN, "page_number", F.lit("page").alias("error_class"),
        F.concat(F.lit("page "), F.col("page_number"), F.lit(": "), F.col("parse_error")).alias("message"))
    return requests.unionByName(broken)


def error_summary(errors: DataFrame) -> DataFrame:
    """Errors grouped by class and feed; message lists are never gathered."""
    return errors.groupBy(*FEED_RUN, "error_class").agg(
        F.count("*").alias("error_count"), F.min("page_number").alias("first_page"),
        F.min_by("message", F.struct("page_number", "message")).alias("first_message"))


def feed_counters(requests: DataFrame, pages: DataFrame, observations: DataFrame, loaded: DataFrame,
                  rejects: DataFrame, flags: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Counters per run and feed.

    A review counts as inserted where its first observation was loaded and as updated for every other one, so the
    updates are the loaded rows less the inserted ones.

    Each input is reduced to one row per feed and measure before anything is joined; ``requests``
    names the feeds that were asked for, so a feed without a single page keeps its row.
    """
    def count(df: DataFrame, **measures) -> DataFrame:
        counted = df.groupBy(*FEED_RUN).agg(*[m.alias(n) for n, m in measures.items()])
        return counted.select(*FEED_RUN, *[
            (F.col(c) if c in measures else F.lit(0)).cast("bigint").alias(c) for c in COUNTERS],
            (F.col("with_errors") if "with_errors" in measures else F.lit(False)).alias("with_errors"))

    one = F.count("*")
    parts = [
        count(requests, failed_requests=F.lit(0)),
        count(pages, pages_fetched=one, with_errors=F.bool_or(F.col("parse_status") == "parse_error")),
        count(observations, reviews_parsed=one),
        count(loaded, reviews_updated=one),
        count(first_seen(loaded).withColumn("run_id", F.col("first_seq.run_id")), reviews_inserted=one, reviews_updated=-one),
        count(rejects, reviews_rejected=one),
        count(flags.withColumnRenamed("created_run_id", "run_id"), flags_created=one),
        count(fetch_log.filter(F.col("error").isNotNull()), failed_requests=one, with_errors=F.lit(True)),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    folded = stacked.groupBy(*FEED_RUN).agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.bool_or("with_errors").alias("with_errors"))
    return folded.select(
        *FEED_RUN, *COUNTERS,
        F.when(F.col("with_errors"), "completed_with_errors").otherwise("completed").alias("run_status"))


def feed_details(requests: DataFrame, fetch_log: DataFrame, pages: DataFrame, observed_flags: DataFrame) -> DataFrame:
    """Per run and feed: pages asked for, time of the last fetch, and the observed flags as a JSON map.

    The map has at most one entry per flag type.
    """
    asked = fetch_log.groupBy(*FEED_RUN).agg(F.count("*").alias("pages_requested"))
    times = pages.groupBy(*FEED_RUN).agg(F.max("fetched_at").alias("completed_at"))
    per_type = counted_flags(observed_flags).groupBy(*FEED_RUN, "flag_type").agg(F.count("*").alias("n"))
    maps = per_type.groupBy(*FEED_RUN).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("flag_type", "n"))))).alias("flag_counts"))
    feeds = requests.select(*FEED_RUN).distinct()
    return (feeds.join(asked, FEED_RUN, "left").join(times, FEED_RUN, "left").join(maps, FEED_RUN, "left")
            .select(*FEED_RUN, F.coalesce("pages_requested", F.lit(0)).alias("pages_requested"), "completed_at",
                    F.coalesce("flag_counts", F.lit("{}")).alias("flag_counts")))


def run_counters(feeds: DataFrame) -> DataFrame:
    return feeds.groupBy("run_id").agg(
        F.count_distinct("source_app_id", "storefront").alias("apps_attempted"),
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.max("run_status").alias("run_status"))


def run_status(feeds: DataFrame, fatal_runs: DataFrame | None = None) -> DataFrame:
    """completed, completed_with_errors or failed (runs named in ``fatal_runs``)."""
    status = feeds.groupBy("run_id").agg(
        F.count_if(F.col("run_status") == "completed_with_errors").alias("feeds_with_errors"),
        F.max("run_status").alias("run_status"))
    if fatal_runs is not None:
        fatal = fatal_runs.select("run_id", F.lit(True).alias("fatal")).distinct()
        status = status.join(fatal, "run_id", "left").withColumn(
            "run_status", F.when(F.col("fatal"), "failed").otherwise(F.col("run_status"))).drop("fatal")
    return status


def counted_flags(observed: DataFrame) -> DataFrame:
    """Flags that a run counts: all of loaded pages, and on a rolled-back page those before the failure."""
    return observed.filter(F.col("failed_pos").isNull() | (F.col("entry_pos") < F.col("failed_pos")))


def flag_counts(observed: DataFrame, created: DataFrame) -> DataFrame:
    """Observed and first-created flags per run and type."""
    seen = counted_flags(observed).groupBy("run_id", "flag_type").agg(F.count("*").alias("observed_count"))
    new = (created.groupBy(F.col("created_run_id").alias("run_id"), "flag_type")
           .agg(F.count("*").alias("created_count")))
    return seen.join(new, ["run_id", "flag_type"], "left").select(
        "run_id", "flag_type", "observed_count", F.coalesce("created_count", F.lit(0)).alias("created_count"))


def flag_count_map(counts: DataFrame) -> DataFrame:
    """Per run, the observed counts as a map (at most one entry per flag type)."""
    return counts.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("flag_type", "observed_count")))).alias("flag_counts"))


def dry_run_summary(page_facts: DataFrame, fetch_log: DataFrame, requests: DataFrame) -> DataFrame:
    """Feeds, pages, entries and failures without storing anything."""
    names = ("apps_attempted", "pages_fetched", "reviews_parsed", "failed_requests")

    def measured(df: DataFrame, **values) -> DataFrame:
        return df.agg(*[(values[n] if n in values else F.lit(0)).cast("bigint").alias(n) for n in names])

    parts = [
        measured(requests.select(*FEED_RUN).distinct(), apps_attempted=F.count("*")),
        measured(page_facts, pages_fetched=F.count("*"), reviews_parsed=F.sum("entry_count")),
        measured(fetch_log, failed_requests=F.count_if(F.col("error").isNotNull())),
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stacked.agg(*[F.sum(n).alias(n) for n in names])
