"""Streaming twins: the same landed pages, arriving as files in several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedfold.operators import accounting
from feedfold.operators.fold import REVIEW_KEY
from feedfold.plans.catalog import register
from feedfold.plans.feed import Feed
from feedfold.plans.oracle import iso
from feedfold.session import TEXT_CODEC, fresh_path, shuffles_dropped
from feedfold.sources import landing
from feedfold.streaming import ingest
from feedfold.streaming.keyed import KeyedState, upsert_changed

ORACLE_REVIEWERS = f"""SELECT source_platform, author_fingerprint, author_uri, author_label,
    {iso('created')} AS created_at, {iso('fetched_at')} AS updated_at
    FROM (SELECT *, first_value(fetched_at) OVER (PARTITION BY author_fingerprint ORDER BY seq) AS created,
        row_number() OVER (PARTITION BY author_fingerprint ORDER BY seq DESC) AS back FROM good
        WHERE author_fingerprint IS NOT NULL) WHERE back = 1"""
_COLUMNS = ["run_id", "source_app_id", "storefront", "page_number", "source_platform", "source_endpoint",
            "source_review_id", "rating", "title", "body", "author_label", "author_uri", "app_version", "review_url",
            "vote_count", "vote_sum", "raw_record", "raw_payload_hash", "raw_feed_page_id", "detected_language",
            "body_char_count", "body_token_estimate", "author_fingerprint", "parser_fallback_used"]
_TIMES = ["published_at", "fetched_at"]


# Every batch may rewrite all buckets of the state, so the batches of one drain stay few however many files have landed; the
# buckets grow with the landed bytes instead, so that the work on one of them stays small.
FILES_PER_BATCH, MOST_BATCHES, BUCKET_BYTES, FEWEST_BUCKETS, MOST_BUCKETS = 8, 4, 64 << 20, 8, 512


def files_per_batch(files: int) -> int:
    return max(FILES_PER_BATCH, -(-files // MOST_BATCHES))


def state_buckets(size: int) -> int:
    return min(MOST_BUCKETS, max(FEWEST_BUCKETS, -(-size // BUCKET_BYTES)))


def _landing(f: Feed) -> str:
    """Folder of the raw pages, split by run; written by the first caller."""
    def land(path: str) -> None:
        with shuffles_dropped(f.spark):
            f.raw_pages.write.option("compression", TEXT_CODEC).partitionBy("run_id").parquet(path)

    return f.once("landed", land)


def _landed(f: Feed):
    """The landed raw pages as a stream."""
    path = _landing(f)
    files, _ = ingest.landed_size(f.spark, path)
    return ingest.stream_page_table(f.spark, path, f.raw_pages.schema, files_per_batch(files))


def _buckets(f: Feed) -> int:
    return state_buckets(ingest.landed_size(f.spark, _landing(f))[1])


def _ingested(f: Feed):
    """Observations of the landed JSON files."""
    target = fresh_path(f.spark, "observed")
    files = ingest.stream_page_files(f.spark, f.page_files, newline=True)
    ingest.run_batches(landing.landed_pages(files, f.feed_orders), ingest.ingest_batch(target), fresh_path(f.spark, "checkpoint"))
    return f.spark.read.parquet(target).select(
        *_COLUMNS, *_TIMES, F.array_join("reasons", "|").alias("reasons"))


def _upserted(f: Feed):
    target = fresh_path(f.spark, "state")
    ingest.run_batches(_landed(f), ingest.upsert_batch(target, _buckets(f)), fresh_path(f.spark, "checkpoint"))
    return ingest.read_state(f.spark, target).drop("first_seen_at", "last_seen_at", *REVIEW_KEY)


def _tables(f: Feed) -> str:
    """The whole state after all batches, built once."""
    return f.once("tables", lambda path: ingest.run_batches(
        _landed(f), ingest.tables_batch(path, _buckets(f)), fresh_path(f.spark, "checkpoint")))


def _compacted(f: Feed):
    compacted = fresh_path(f.spark, "compacted")
    ingest.compact_state(f.spark, _tables(f), compacted)
    return ingest.read_state(f.spark, compacted).drop("first_seen_at", "last_seen_at", *REVIEW_KEY)


def _looked_up(f: Feed):
    """Canonical reviews of the keys that have a duplicate flag, from their buckets alone."""
    wanted = ingest.read_flags(f.spark, _tables(f)).filter(F.col("flag_type") == ingest.DUPLICATE)
    return ingest.read_state(f.spark, _tables(f), wanted.select(*REVIEW_KEY)).drop("first_seen_at", "last_seen_at", *REVIEW_KEY)


def _counted(f: Feed):
    """A streaming aggregation in update mode: each batch upserts the runs that it changed."""
    state = KeyedState(f.spark, fresh_path(f.spark, "counts"), {"runs": ["run_id"]}, buckets=2)
    counts = ingest.stream_run_counts(_landed(f))
    query = (counts.writeStream.outputMode("update").foreachBatch(upsert_changed(state, "runs"))
             .option("checkpointLocation", fresh_path(f.spark, "checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    return state.read("runs").drop("batch")


def _feed_counters(f: Feed):
    return ingest.read_counters(f.spark, _tables(f), f.requests, f.fetch_log)


register("stream_ingest", f"""SELECT {', '.join(_COLUMNS)}, {', '.join(f'{iso(c)} AS {c}' for c in _TIMES)},
    array_to_string(reasons, '|') AS reasons FROM obs""")(_ingested)
_STATE = f"""SELECT review_id, rating, title, body, review_url, source_endpoint,
    {iso('published_at')} AS published_at, detected_language, body_char_count, body_token_estimate, author_fingerprint,
    app_version, vote_count, vote_sum, raw_payload_hash, first_raw_feed_page_id, last_raw_feed_page_id,
    first_seen_run_id, last_seen_run_id FROM reviews"""
register("stream_upsert", _STATE)(_upserted)
register("stream_compacted", _STATE)(_compacted)
register("stream_reviewers", ORACLE_REVIEWERS)(lambda f: ingest.read_reviewers(f.spark, _tables(f)))
register("stream_rejects", """SELECT run_id, raw_feed_page_id, source_app_id, storefront, source_review_id,
    reasons[1] AS rejection_reason, raw_payload_hash FROM marked WHERE NOT valid AND failed_pos IS NULL""")(
    lambda f: ingest.read_table(f.spark, _tables(f), "rejects").select(
        "run_id", "raw_feed_page_id", "source_app_id", "storefront", "source_review_id", "rejection_reason", "raw_payload_hash"))
_COUNTS = ", ".join(accounting.COUNTERS)
register("stream_counters", f"SELECT run_id, source_app_id, storefront, {_COUNTS}, run_status FROM counters")(_feed_counters)
register("stream_run_counters", f"SELECT run_id, apps_attempted, {_COUNTS}, run_status FROM runs")(
    lambda f: accounting.run_counters(_feed_counters(f)))
_FLAGS = "review_id, source_app_id, storefront, source_review_id, flag_type, flag_severity, flag_details, created_run_id"
register("stream_flags", f"SELECT {_FLAGS} FROM flags")(
    lambda f: ingest.read_flags(f.spark, _tables(f)).select(*_FLAGS.split(", ")))
register("stream_flags_created", "SELECT created_run_id, flag_type, count(*) AS flags_created FROM flags GROUP BY ALL")(
    lambda f: ingest.read_flags(f.spark, _tables(f)).groupBy("created_run_id", "flag_type").agg(F.count("*").alias("flags_created")))
register("stream_lookup", _STATE + " WHERE review_id IN (SELECT review_id FROM flags WHERE flag_type = 'duplicate_text_within_app')")(
    _looked_up)
register("stream_pages", """SELECT run_id, source_app_id, storefront, page_number, parse_status, COALESCE(parse_error, '') AS parse_error
    FROM pages_done""")(lambda f: ingest.read_table(f.spark, _tables(f), "pages").select(
    "run_id", "source_app_id", "storefront", "page_number", "parse_status", F.coalesce("parse_error", F.lit("")).alias("parse_error")))
register("stream_run_stats", """SELECT run_id, count(*) AS pages_fetched,
    sum(CASE WHEN page_is_json THEN entry_count ELSE 0 END)::BIGINT AS reviews_parsed,
    count(*) FILTER (NOT page_is_json) AS unreadable_pages FROM page_parts GROUP BY run_id""")(_counted)
