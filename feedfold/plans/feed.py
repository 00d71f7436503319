"""The review plan: landed entries to canonical tables, features and counters.

Each attribute is a lazily built DataFrame. ``stored`` tables (reviews, flags, features) are written
once per application and set of inputs to the shared folder, as the feature table is an artefact that profiling and
audits read back with column pruning instead of recomputing the fold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedfold.operators import accounting, features, flags, fold, health, normalise, sketches
from feedfold.session import fresh_path, join_dimension, written
from feedfold.sources import landing
from feedfold.sources.cohort import cohort_manifest, dimension_upsert
from feedfold.sources.lexicon import ISSUE_TERMS, Lexicon
from feedfold.sources.pages import land_page_files

# By application, inputs (source files, lexicon, entries) and name.
_STORED: dict[tuple[str, str, str], DataFrame] = {}
_FOLDERS: dict[tuple[str, str, str], str] = {}
SOURCE_TABLES = ("documents", "events", "labels")


class Feed:
    def __init__(self, spark: SparkSession, source: str, entries: DataFrame | None = None,
                 lexicon: Lexicon = ISSUE_TERMS) -> None:
        self.spark, self.source, self.lexicon = spark, source, lexicon
        self._entries = entries

    @cached_property
    def inputs(self) -> str:
        """Digest of all that stored tables depend on: the source files (listed, not read), the lexicon, given entries."""
        files = self.spark.read.format("binaryFile").load([f"{self.source}/{t}.parquet" for t in SOURCE_TABLES])
        seen = files.agg(F.count("*"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()
        given = self._entries.semanticHash() if self._entries is not None else None
        return hashlib.sha256(repr((self.source, tuple(seen), sorted(self.lexicon.items()), given)).encode()).hexdigest()

    def stored(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> DataFrame:
        """The table of that name, written by the first caller; pass a callable if building it runs jobs."""
        key = (self.spark.sparkContext.applicationId, self.inputs, name)
        if key not in _STORED:
            _STORED[key] = written(df if isinstance(df, DataFrame) else df(), name)
        return _STORED[key]

    # --- dimensions -------------------------------------------------------------------------
    @cached_property
    def cohort(self) -> DataFrame:
        return cohort_manifest(landing.cohort(self.spark, self.source))

    @cached_property
    def dims(self) -> dict[str, DataFrame]:
        return dimension_upsert(self.cohort.withColumn("version", F.lit(1)), landing.PLATFORM, 10)

    @cached_property
    def requests(self) -> DataFrame:
        return landing.requests(self.spark, self.source).drop("app_no")

    @cached_property
    def fetch_log(self) -> DataFrame:
        return landing.fetch_log(self.spark, self.source)

    # --- observation log --------------------------------------------------------------------
    @cached_property
    def raw_pages(self) -> DataFrame:
        return landing.raw_pages(self.spark, self.source)

    @cached_property
    def page_files(self) -> str:
        """Folder of the landed pages, a JSON file each; written by the first caller.

        Pages without a name share a file with those of their task, so which task a page is in shows in the files: it does not follow its range.
        """
        return self.once("page-files", lambda path: land_page_files(landing.raw_pages(self.spark, self.source, by_range=False), path))

    @cached_property
    def feed_orders(self) -> DataFrame:
        return written(landing.feed_orders(self.spark, self.source), "feed-orders")

    def once(self, name: str, build: Callable[[str], None]) -> str:
        """A folder that ``build`` fills, once per application and set of inputs."""
        key = (self.spark.sparkContext.applicationId, self.inputs, name)
        if key not in _FOLDERS:
            path = fresh_path(self.spark, name)
            build(path)
            _FOLDERS[key] = path
        return _FOLDERS[key]

    @cached_property
    def entries(self) -> DataFrame:
        return self._entries if self._entries is not None else landing.entries(self.spark, self.source)

    @cached_property
    def validated(self) -> DataFrame:
        """Normalised observations with their texts (payloads of rejects only), written once: the documents are read and cleaned for this only."""
        return self.stored("validated", normalise.reject_payloads(normalise.validate(normalise.normalise(self.entries))))

    @cached_property
    def marked(self) -> DataFrame:
        return normalise.mark_rollback(self.validated)

    @cached_property
    def valid(self) -> DataFrame:
        """Loaded observations with their texts."""
        return normalise.split_valid(normalise.committed(self.marked))[0]

    @cached_property
    def log(self) -> DataFrame:
        """All observations without texts, written once: everything but the reviews reads this."""
        return self.stored("log", fold.narrow_log(flags.with_mismatch(self.marked)))

    @cached_property
    def loaded(self) -> DataFrame:
        return normalise.split_valid(normalise.committed(self.log))[0]

    @cached_property
    def rejects(self) -> DataFrame:
        return normalise.rejected_records(self.marked)

    @cached_property
    def rejected_log(self) -> DataFrame:
        """Rejected observations without their payloads."""
        return normalise.split_valid(normalise.committed(self.log))[1].withColumn(
            "rejection_reason", F.get("reasons", F.lit(0)))

    @cached_property
    def pages(self) -> DataFrame:
        return normalise.page_status(landing.pages(self.spark, self.source),
                                     normalise.rolled_back_pages(self.log))

    # --- folds ------------------------------------------------------------------------------
    @cached_property
    def labels(self) -> DataFrame:
        return fold.label_inserts(self.loaded)

    @cached_property
    def checked(self) -> DataFrame:
        return fold.duplicate_text(self.loaded)

    @cached_property
    def observed_flags(self) -> DataFrame:
        undone = fold.duplicate_text_undone(normalise.split_valid(self.log)[0])
        return flags.observed_flags(self.checked).unionByName(flags.observed_flags(undone))

    @cached_property
    def flags(self) -> DataFrame:
        return fold.flag_dedup(flags.observed_flags(self.checked))

    @cached_property
    def reviewers(self) -> DataFrame:
        return fold.reviewer_upsert(self.loaded)

    def narrow_reviews(self, *columns: str) -> DataFrame:
        """Canonical reviews carrying only the named values."""
        return fold.narrow_reviews(self.loaded, *columns)

    @cached_property
    def reviews(self) -> DataFrame:
        return self.stored("reviews", fold.review_upsert(self.valid))

    @cached_property
    def review_flags(self) -> DataFrame:
        return self.stored("flags", self.flags)

    # --- counters ---------------------------------------------------------------------------
    @cached_property
    def feed_counters(self) -> DataFrame:
        return accounting.feed_counters(self.requests, self.pages, self.log, self.loaded, self.rejected_log,
                                        self.review_flags, self.fetch_log)

    @cached_property
    def stored_counters(self) -> DataFrame:
        return self.stored("counters", self.feed_counters)

    @cached_property
    def runs(self) -> DataFrame:
        """Run rows; a run starts with its day and ends with its last fetch."""
        times = self.pages.groupBy("run_id").agg(F.min("fetched_at").alias("started_at"),
                                                 F.max("fetched_at").alias("completed_at"))
        return accounting.run_counters(self.stored_counters).join(times, "run_id")

    # --- views ------------------------------------------------------------------------------
    @cached_property
    def training_view(self) -> DataFrame:
        return health.training_view(self.reviews, self.review_flags, self.dims)

    @cached_property
    def features(self) -> DataFrame:
        return self.stored("features", features.review_features(self.training_view, self.review_flags, self.lexicon))

    @cached_property
    def column_sketches(self) -> DataFrame:
        """Stored per run that saw a review first; later runs only add their own."""
        return self.stored("column-sketches", lambda: sketches.column_sketches(self._by_run, "first_seen_run_id"))

    @cached_property
    def length_sketches(self) -> DataFrame:
        return self.stored("length-sketches", lambda: sketches.quantile_sketches(
            self._by_run, ["first_seen_run_id", "weak_label"], ["body_char_count", "body_word_count"]))

    @property
    def _by_run(self) -> DataFrame:
        return self.features.join(self.reviews.select("review_id", "first_seen_run_id"), "review_id")

    def with_names(self, df: DataFrame) -> DataFrame:
        names = self.dims["apps"].select("source_app_id", "app_name", "vertical_name")
        return join_dimension(df, names, ["source_app_id"])
