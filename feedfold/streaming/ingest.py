"""Repeated polling as Structured Streaming.

New pages arrive as files; each micro-batch is parsed once by the batch operators and folded into a keyed state (``keyed.py``). All folds
are ordered by ``seq`` and never by arrival, so batches in any order give the rows that one batch run gives: canonical reviews,
reviewers, rejects, quality flags and run counters. Texts are appended once and fetched for the winners when reviews are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedfold.operators import accounting, flags, fold, normalise
from feedfold.operators.entries import extract_entries, extract_with_facts, page_facts
from feedfold.session import TEXT_CODEC, passing_tables, shuffles_dropped, written
from feedfold.sources.pages import PAGE_KEY, page_files
from feedfold.streaming.keyed import Batch, KeyedState


def stream_page_files(spark: SparkSession, path: str, files_per_batch: int | None = None, newline: bool = False) -> DataFrame:
    """One row per newly landed JSON file."""
    reader = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return page_files(reader.load(path), newline)


def stream_page_table(spark: SparkSession, path: str, schema: T.StructType,
                      files_per_batch: int | None = None) -> DataFrame:
    """Landed pages appended as parquet files (many pages per file)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def landed_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and bytes of the data files below ``path``, from the file system's listing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
    files = size = 0
    while listed.hasNext():
        status = listed.next()
        if not status.getPath().getName().startswith(("_", ".")):
            files, size = files + 1, size + status.getLen()
    return files, size


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that has landed, batch by batch, and stop."""
    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def observe(pages: DataFrame) -> DataFrame:
    """Landed pages to validated observations, for batches and streams alike."""
    return normalise.validate(normalise.normalise(extract_entries(pages)))


def observe_with_facts(pages: DataFrame) -> DataFrame:
    """``observe``, with the facts of the pages out of the same parse (``entries.extract_with_facts``)."""
    return normalise.validate(normalise.normalise(extract_with_facts(pages)))


def ingest_batch(target: str) -> Callable[[DataFrame, int], None]:
    """Write the batch's observations under its id."""
    def handle(pages: DataFrame, batch_id: int) -> None:
        with shuffles_dropped(pages.sparkSession):
            observe(pages).write.mode("overwrite").option("compression", TEXT_CODEC).parquet(f"{target}/batch={batch_id}")
    return handle


# Key columns of the state's tables. ``bodies`` has a row per feed, body and review, all others follow the review, page, feed or reviewer.
KEYS = {
    "reviews": fold.REVIEW_KEY, "texts": fold.REVIEW_KEY, "triggers": fold.REVIEW_KEY, "bodies": [*fold.FEED_KEY, "body_key"],
    "reviewers": ["source_platform", "author_fingerprint"], "pages": PAGE_KEY, "rejects": ["raw_feed_page_id"],
    "counters": ["run_id", *fold.FEED_KEY]}
DUPLICATE = "duplicate_text_within_app"
_TEXTS = ("title", "body")
_ADDED = ("pages_fetched", "reviews_parsed", "reviews_loaded", "reviews_rejected", "reviews_inserted", "flags_created", "broken_pages")


def feed_state(spark: SparkSession, target: str, buckets: int = 8) -> KeyedState:
    return KeyedState(spark, target, KEYS, buckets)


def upsert_batch(target: str, buckets: int = 8, whole: bool = False) -> Callable[[DataFrame, int], None]:
    """Fold a batch of pages into the state below ``target``; a batch or page that it has already is skipped.

    The state holds canonical reviews; a ``whole`` one also reviewers, rejects, flags and counters.
    """
    def handle(pages: DataFrame, batch_id: int) -> None:
        state = feed_state(pages.sparkSession, target, buckets)
        with passing_tables(state.spark), state.batch(batch_id) as batch:
            if batch:
                _ingest(state, batch, pages, whole)
    return handle


def tables_batch(target: str, buckets: int = 8) -> Callable[[DataFrame, int], None]:
    return upsert_batch(target, buckets, whole=True)


def _ingest(state: KeyedState, batch: Batch, pages: DataFrame, whole: bool) -> None:
    """Fold the batch's pages, whose files are there to be read again, into the state.

    The texts are read, cleaned, tested and digested in the one pass that stores the observations; all that follows reads narrow columns of these,
    but for the texts of first observations and the payloads of rejects. The stored tables go with the batch.
    """
    pages = new_pages(pages, state.read("pages"))
    parsed = written(fold.with_keys(flags.with_mismatch(normalise.reject_payloads(observe_with_facts(pages)))), f"batch-{batch.id}", TEXT_CODEC)
    marked = normalise.mark_rollback(parsed.filter("is_entry").drop("page", "is_entry"))
    log = fold.without_texts(marked)
    loaded, rejected = normalise.split_valid(normalise.committed(log))

    seen = parsed.filter("page IS NOT NULL").select(*[c for c in pages.columns if c != "response_body"], "page.*")
    facts = written(normalise.page_status(seen, normalise.rolled_back_pages(log)), f"facts-{batch.id}")
    batch.append("pages", facts)

    partial = written(narrow_partials(loaded), f"partials-{batch.id}")
    reviews, before = batch.fold("reviews", partial, _merged_reviews)
    valid = normalise.split_valid(normalise.committed(marked))[0]
    batch.append("texts", first_texts(valid, partial, batch.id))
    if not whole:
        return

    batch.append("rejects", normalise.rejected_records(marked))
    batch.fold("reviewers", written(fold.partial_reviewers(loaded), f"reviewers-{batch.id}"), _merged_reviewers)
    triggers = _intrinsic(loaded).unionByName(_duplicates(batch, loaded, reviews, before))
    flagged, flagged_before = batch.fold("triggers", written(triggers, f"triggers-{batch.id}"), _merged_triggers)

    feed = ["run_id", *fold.FEED_KEY]
    changes = [
        _counted(facts, "pages_fetched", 1), _counted(facts.filter("parse_status = 'parse_error'"), "broken_pages", 1),
        _counted(log, "reviews_parsed", 1), _counted(loaded, "reviews_loaded", 1), _counted(rejected, "reviews_rejected", 1)]
    for rows, sign in ((reviews, 1), (before, -1)):
        if rows is not None:
            changes.append(_counted(rows.select(F.col("first.run_id").alias("run_id"), *fold.FEED_KEY), "reviews_inserted", sign))
    for rows, sign in ((flagged, 1), (flagged_before, -1)):
        if rows is not None:
            changes.append(_counted(created_flags(rows).withColumnRenamed("created_run_id", "run_id"), "flags_created", sign))
    changed = reduce(DataFrame.unionByName, changes).groupBy(*feed).agg(*[F.sum(c).alias(c) for c in _ADDED])
    batch.fold("counters", written(changed, f"changes-{batch.id}"), lambda rows: rows.groupBy("bucket", *feed).agg(
        *[F.sum(c).alias(c) for c in _ADDED]).drop("bucket"))


def new_pages(pages: DataFrame, taken: DataFrame | None) -> DataFrame:
    """Pages that are not in the state yet, each once: of several landings of a page the first one counts.

    Names tell which pages come again, here or from the state; only these pages' bodies are compared, and only their names are joined with the pages.
    """
    name = ["fetched_at", "raw_file_path"] if "raw_file_path" in pages.columns else ["fetched_at"]
    names = pages.select(*PAGE_KEY)
    again = written(names.groupBy(*PAGE_KEY).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "landed-again")
    kept = pages
    if not again.isEmpty():
        landing = F.struct(*name, F.xxhash64("response_body").alias("content"))
        several = pages.join(again, PAGE_KEY, "left_semi").withColumn("landing", landing)
        first = written(several.groupBy(*PAGE_KEY).agg(F.min("landing").alias("first")), "landed-first")
        one = several.join(first, PAGE_KEY).filter(F.col("landing").eqNullSafe(F.col("first"))).drop("landing", "first")
        kept = pages.join(again, PAGE_KEY, "left_anti").unionByName(one.dropDuplicates(PAGE_KEY))  # files that agree in all of these are one page
    if taken is None:
        return kept
    known = written(names.distinct().join(taken.select(*PAGE_KEY), PAGE_KEY, "left_semi"), "taken")
    return kept if known.isEmpty() else kept.join(known, PAGE_KEY, "left_anti")


def first_texts(valid: DataFrame, partial: DataFrame, number: int) -> DataFrame:
    """Texts of the batch's first observations by their place, which a reader compares again.

    So they are picked by a digest of key and place: these numbers are few bytes, by which Spark broadcasts them rather than shuffle every text.
    """
    first = written(partial.select(F.xxhash64(*fold.REVIEW_KEY, F.col("first.seq")).alias("picked")), f"first-{number}")
    texts = valid.select(*fold.REVIEW_KEY, fold.place().alias("place"), *_TEXTS)
    return texts.withColumn("picked", F.xxhash64(*fold.REVIEW_KEY, "place")).join(first, "picked", "left_semi").drop("picked")


def narrow_partials(loaded: DataFrame) -> DataFrame:
    """First and last observation per review without texts; the body goes by its digest."""
    first = F.struct(fold.place().alias("seq"), *[c for c in fold.FIRST_WINS if c not in _TEXTS], "body_key", *fold.LINEAGE)
    last = F.struct(fold.place().alias("seq"), *fold.LAST_WINS, *fold.LINEAGE)
    return loaded.groupBy(*fold.REVIEW_KEY).agg(F.min_by(first, fold.place()).alias("first"), F.max_by(last, fold.place()).alias("last"))


def _merged_reviews(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", *fold.REVIEW_KEY).agg(
        F.min_by("first", F.col("first.seq")).alias("first"), F.max_by("last", F.col("last.seq")).alias("last")).drop("bucket")


def _merged_reviewers(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", *KEYS["reviewers"]).agg(
        F.min("first").alias("first"), F.max_by("last", F.col("last.seq")).alias("last")).drop("bucket")


# --- quality flags --------------------------------------------------------------------------------
# A trigger is the first observation of a review that raises a flag. The duplicate flag has a trigger per body of the review, as each is tested
# in the bucket of its body; a trigger without ``seq`` takes an earlier one back, when a late batch changed what was stored first.
_TRIGGER = ["flag_type", "body_key", "flag_severity", "flag_details", "seq", "version"]


def _intrinsic(loaded: DataFrame) -> DataFrame:
    """First triggers of the flags that need no other review."""
    seen = flags.observed_flags(loaded.withColumn("duplicate_text", F.lit(False)))
    first = seen.groupBy(*fold.REVIEW_KEY, "flag_type").agg(F.min_by(F.struct("flag_severity", "flag_details", "seq"), "seq").alias("first"))
    return first.select(*fold.REVIEW_KEY, "flag_type", F.lit("").alias("body_key"), "first.*", F.lit(0).cast("long").alias("version"))


def _duplicates(batch: Batch, loaded: DataFrame, reviews: DataFrame, before: DataFrame | None) -> DataFrame:
    """Changed triggers of the duplicate flag.

    A row of ``bodies`` tells when a review was seen with a body, and since when it is stored with it (null: it is stored with another one).
    Buckets that the batch touches are tested anew: a review's trigger is its first sighting after another review was stored.
    """
    key = [*fold.FEED_KEY, "body_key", "source_platform", "source_review_id"]
    none = F.lit(None).cast(loaded.schema["seq"].dataType)

    def statement(rows: DataFrame, stored: Column, version: int, seen: Column) -> DataFrame:
        return rows.select(*key, stored.alias("stored"), F.lit(version).cast("long").alias("stated"), seen.alias("seen"), none.alias("trigger"))

    def stored_bodies(rows: DataFrame) -> DataFrame:
        seq = F.struct(*[F.col(f"first.seq.{c}").alias(c) for c in ("run_id", "app_order", "page_number", "entry_pos")])
        return rows.select(*fold.REVIEW_KEY, F.col("first.body_key").alias("body_key"), seq.alias("at"))

    now = stored_bodies(reviews)
    nothing = F.array().cast(f"array<{loaded.schema['seq'].dataType.simpleString()}>")
    sightings = loaded.groupBy(*key).agg(F.sort_array(F.collect_set("seq")).alias("seen"))  # a review is seen once a run
    parts = [statement(sightings, none, -1, F.col("seen"))]
    if before is None:
        parts.append(statement(now, F.col("at"), batch.id, nothing))
    else:
        was = stored_bodies(before)
        moved = now.join(was.withColumnsRenamed({"body_key": "old_key", "at": "old_at"}), fold.REVIEW_KEY, "left")
        fresh = moved.filter(F.col("old_at").isNull() | (F.col("old_at") != F.col("at")))
        parts.append(statement(fresh, F.col("at"), batch.id, nothing))
        gone = fresh.filter(F.col("old_key") != F.col("body_key")).drop("body_key").withColumnRenamed("old_key", "body_key")
        parts.append(statement(gone, none, batch.id, nothing))

    def tested(rows: DataFrame) -> DataFrame:
        latest = F.max_by(F.struct("stored"), "stated")["stored"]
        merged = rows.groupBy("bucket", *key).agg(
            latest.alias("stored"), F.max("stated").alias("stated"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"), F.max("trigger").alias("before"))
        group = ["bucket", *fold.FEED_KEY, "body_key"]
        order = Window.partitionBy(*group).orderBy("stored", "source_platform", "source_review_id")
        two = (merged.filter("stored IS NOT NULL").select(*group, "source_platform", "source_review_id", "stored")
               .withColumn("place", F.row_number().over(order)).filter("place <= 2"))
        at = {n: F.col("place") == n for n in (1, 2)}
        earliest = two.groupBy(*group).agg(
            F.max(F.when(at[1], F.struct("source_platform", "source_review_id"))).alias("first_id"),
            F.max(F.when(at[1], F.col("stored"))).alias("first_at"), F.max(F.when(at[2], F.col("stored"))).alias("second_at"))
        other = F.when(F.col("first_id") == F.struct("source_platform", "source_review_id"), F.col("second_at")).otherwise(F.col("first_at"))
        return merged.join(earliest, group, "left").withColumn("other", other).select(
            *key, "stored", "stated", "seen", F.get(F.filter("seen", lambda s: s > F.col("other")), F.lit(0)).alias("trigger"),
            "before").drop("bucket")

    bodies, _ = batch.fold("bodies", written(reduce(DataFrame.unionByName, parts).withColumn("before", none), f"bodies-{batch.id}"),
                           lambda rows: tested(rows))
    changed = bodies.filter(~F.col("trigger").eqNullSafe(F.col("before")))
    return changed.select(*fold.REVIEW_KEY, F.lit(DUPLICATE).alias("flag_type"), "body_key", F.lit(flags.SEVERITY[DUPLICATE]).alias("flag_severity"),
                          F.lit(flags.DUPLICATE_DETAIL).alias("flag_details"), F.col("trigger").alias("seq"),
                          F.lit(batch.id + 1).cast("long").alias("version"))


def _merged_triggers(rows: DataFrame) -> DataFrame:
    """The newest statement per body for duplicates, the earliest trigger for the other flags."""
    first = F.min_by(F.struct("flag_severity", "flag_details", "seq", "version"), F.struct(-F.col("version"), "seq"))
    return rows.groupBy("bucket", *fold.REVIEW_KEY, "flag_type", "body_key").agg(first.alias("row")).select(
        *fold.REVIEW_KEY, "flag_type", "body_key", "row.*")


def created_flags(triggers: DataFrame) -> DataFrame:
    """One row per review and flag type, from its first trigger."""
    live = triggers.filter("seq IS NOT NULL").groupBy(*fold.REVIEW_KEY, "flag_type").agg(
        F.min_by(F.struct("flag_severity", "flag_details", F.col("seq.run_id").alias("run_id")), "seq").alias("first"))
    return live.select(fold.review_id().alias("review_id"), *fold.REVIEW_KEY, "flag_type", "first.flag_severity", "first.flag_details",
                       F.col("first.run_id").alias("created_run_id"))


def _counted(rows: DataFrame, measure: str, sign: int) -> DataFrame:
    counted = rows.groupBy("run_id", *fold.FEED_KEY).agg((F.count("*") * sign).alias(measure))
    return counted.select("run_id", *fold.FEED_KEY, *[(F.col(c) if c == measure else F.lit(0)).cast("long").alias(c) for c in _ADDED])


# --- reading the state ----------------------------------------------------------------------------
def read_state(spark: SparkSession, target: str, keys: DataFrame | None = None) -> DataFrame:
    """Canonical reviews of all batches; with ``keys`` (review keys) only theirs, from their buckets alone."""
    state = feed_state(spark, target, _buckets(spark, target))
    if keys is not None:
        keys = written(keys.select(*fold.REVIEW_KEY).distinct(), "wanted")
    rows, texts = (state.lookup(t, keys) if keys is not None else state.read(t) for t in ("reviews", "texts"))
    found = rows.join(texts, fold.REVIEW_KEY).filter(F.col("first.seq").eqNullSafe(F.col("place")))
    first = F.struct(*[F.col(c) if c in _TEXTS else F.col(f"first.{c}").alias(c) for c in (*fold.FIRST_WINS, *fold.LINEAGE)])
    return fold.reviews_from_partials(found.withColumn("first", first))


def _buckets(spark: SparkSession, target: str) -> int:
    return feed_state(spark, target).manifest()["buckets"]


def read_table(spark: SparkSession, target: str, name: str) -> DataFrame:
    return feed_state(spark, target).read(name)


def read_reviewers(spark: SparkSession, target: str) -> DataFrame:
    return fold.reviewers_from_partials(read_table(spark, target, "reviewers"))


def read_flags(spark: SparkSession, target: str) -> DataFrame:
    """Flags created so far, as ``fold.flag_dedup`` gives them."""
    return created_flags(read_table(spark, target, "triggers"))


def read_counters(spark: SparkSession, target: str, requests: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Counters per run and feed, as ``accounting.feed_counters`` gives them."""
    feed = ["run_id", *fold.FEED_KEY]
    failed = fetch_log.filter(F.col("error").isNotNull()).groupBy(*feed).agg(F.count("*").alias("failed_requests"))
    rows = requests.select(*feed).distinct().join(read_table(spark, target, "counters"), feed, "left").join(failed, feed, "left")
    rows = rows.fillna(0, [*_ADDED, "failed_requests"])
    return rows.withColumn("reviews_updated", F.col("reviews_loaded") - F.col("reviews_inserted")).select(
        *feed, *accounting.COUNTERS, F.when(F.col("broken_pages") + F.col("failed_requests") > 0, "completed_with_errors")
        .otherwise("completed").alias("run_status"))


def compact_state(spark: SparkSession, target: str, compacted: str) -> None:
    """The state as one version of every bucket, in a new folder; a reader switches to it when it is complete."""
    buckets = _buckets(spark, target)
    old, new = feed_state(spark, target, buckets), feed_state(spark, compacted, buckets)
    manifest = old.manifest()
    with new.batch(manifest["batch"]) as batch:
        for table in manifest["schemas"]:
            batch.append(table, old.read(table, manifest=manifest))


def stream_run_counts(pages: DataFrame) -> DataFrame:
    """Pages and parsed entries per run as a streaming aggregation (update or complete mode)."""
    return page_facts(pages).groupBy("run_id").agg(
        F.count("*").alias("pages_fetched"), F.sum("entry_count").alias("reviews_parsed"),
        F.count_if(~F.col("is_json")).alias("unreadable_pages"))
