"""Canonical tables as folds over the observation log.

Every fold is ordered by ``seq`` and never by arrival, so replays in any order give the same rows.
Folds combine before the shuffle; a key seen very often costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedfold.functions.text import ascii_fold
from feedfold.session import join_popular

REVIEW_KEY = ["source_platform", "source_app_id", "storefront", "source_review_id"]
FEED_KEY = ["source_app_id", "storefront"]

# Columns that keep their first value, and columns that take their latest.
FIRST_WINS = ("rating", "title", "body", "review_url", "source_endpoint", "published_at",
              "detected_language", "body_char_count", "body_token_estimate")
LAST_WINS = ("author_fingerprint", "app_version", "vote_count", "vote_sum", "raw_payload_hash")
LINEAGE = ("raw_feed_page_id", "run_id", "fetched_at")


def seq() -> Column:
    return F.struct("run_id", "app_order", "page_number", "entry_pos")


def review_id() -> Column:
    """Readable surrogate made of the natural key, unique without any global numbering."""
    return F.concat_ws("/", *REVIEW_KEY)


def place() -> Column:
    """``seq``, and for an entry that was landed more than once when and with what."""
    return F.struct("run_id", "app_order", "page_number", "entry_pos", "fetched_at", "raw_payload_hash")


def partial_reviews(valid: DataFrame) -> DataFrame:
    """First and last observation per review; the output folds again with itself."""
    first = F.struct(place().alias("seq"), *FIRST_WINS, *LINEAGE)
    last = F.struct(place().alias("seq"), *LAST_WINS, *LINEAGE)
    return valid.groupBy(*REVIEW_KEY).agg(
        F.min_by(first, place()).alias("first"), F.max_by(last, place()).alias("last"))


def merge_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*REVIEW_KEY).agg(
        F.min_by("first", F.col("first.seq")).alias("first"), F.max_by("last", F.col("last.seq")).alias("last"))


def reviews_from_partials(partials: DataFrame) -> DataFrame:
    return partials.select(
        review_id().alias("review_id"), *REVIEW_KEY,
        *[F.col(f"first.{c}").alias(c) for c in FIRST_WINS],
        *[F.col(f"last.{c}").alias(c) for c in LAST_WINS],
        F.col("first.raw_feed_page_id").alias("first_raw_feed_page_id"),
        F.col("last.raw_feed_page_id").alias("last_raw_feed_page_id"),
        F.col("first.run_id").alias("first_seen_run_id"), F.col("last.run_id").alias("last_seen_run_id"),
        F.col("first.fetched_at").alias("first_seen_at"), F.col("last.fetched_at").alias("last_seen_at"))


def review_upsert(valid: DataFrame) -> DataFrame:
    """Canonical reviews. The first and last observation of each review are found on narrow rows; only then are the
    texts of the first ones fetched. Pass a stored frame, as it is read three times (texts once).

    An entry that was landed more than once stays one observation: its first landing gives the first values, its last the latest.
    """
    placed = valid.withColumn("seq", seq())
    ends = placed.groupBy(*REVIEW_KEY).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))

    def at(end: str, columns: tuple[str, ...], pick) -> DataFrame:
        winners = ends.select(*REVIEW_KEY, F.col(f"{end}_seq").alias("seq"))
        found = placed.select(*REVIEW_KEY, "seq", place().alias("place"), F.struct(*columns, *LINEAGE).alias(end)).join(
            winners, [*REVIEW_KEY, "seq"])
        return found.groupBy(*REVIEW_KEY, "seq").agg(pick(end, "place").alias(end)).drop("seq")

    return reviews_from_partials(at("first", FIRST_WINS, F.min_by).join(at("last", LAST_WINS, F.max_by), REVIEW_KEY))


def narrow_reviews(valid: DataFrame, *columns: str) -> DataFrame:
    """Canonical reviews with only the named values, so a count by rating shuffles no texts."""
    chosen = {c: (F.min_by if c in FIRST_WINS else F.max_by)(c, place()).alias(c) for c in columns}
    return valid.groupBy(*REVIEW_KEY).agg(*chosen.values()).select(
        review_id().alias("review_id"), *REVIEW_KEY, *columns)


def first_last_seen(valid: DataFrame) -> DataFrame:
    """Lineage alone, without carrying text through the shuffle."""
    seen = F.struct(*LINEAGE)
    folded = valid.groupBy(*REVIEW_KEY).agg(
        F.min_by(seen, place()).alias("first"), F.max_by(seen, place()).alias("last"),
        F.count("*").alias("observation_count"))
    return folded.select(
        review_id().alias("review_id"),
        *[F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in LINEAGE],
        "observation_count")


def first_seen(valid: DataFrame) -> DataFrame:
    return valid.groupBy(*REVIEW_KEY).agg(F.min(seq()).alias("first_seq"))


def label_inserts(valid: DataFrame) -> DataFrame:
    """Each observation as ``inserted`` (first of its key) or ``updated``.

    The first ``seq`` per key is a combined minimum and is joined back; the commonest keys are joined
    through a broadcast, so a key with very many observations fills no task.
    """
    narrow = valid.select(*REVIEW_KEY, "run_id", "app_order", "page_number", "entry_pos")
    first = seq() == F.col("first_seq")
    return join_popular(narrow, first_seen(valid), REVIEW_KEY).withColumn(
        "action", F.when(first, "inserted").otherwise("updated")).drop("first_seq")


def partial_reviewers(valid: DataFrame) -> DataFrame:
    """First and last observation per reviewer; the output folds again with itself."""
    known = valid.filter(F.col("author_fingerprint").isNotNull())
    return known.groupBy("source_platform", "author_fingerprint").agg(
        F.min(F.struct(seq().alias("seq"), F.col("fetched_at").alias("at"))).alias("first"),
        F.max_by(F.struct(seq().alias("seq"), "author_uri", "author_label", F.col("fetched_at").alias("at")), seq()).alias("last"))


def reviewers_from_partials(partials: DataFrame) -> DataFrame:
    folded = partials.groupBy("source_platform", "author_fingerprint").agg(
        F.min("first").alias("first"), F.max_by("last", F.col("last.seq")).alias("last"))
    return folded.select("source_platform", "author_fingerprint", "last.author_uri", "last.author_label",
                         F.col("first.at").alias("created_at"), F.col("last.at").alias("updated_at"))


def reviewer_upsert(valid: DataFrame) -> DataFrame:
    return reviewers_from_partials(partial_reviewers(valid))


def body_key() -> Column:
    return F.sha2(ascii_fold("body"), 256)


def _earliest_two(stored: DataFrame, group: list[str]) -> DataFrame:
    """The two earliest reviews per group of equal bodies.

    ``row_number() <= 2`` prunes inside each task before the shuffle, so a body that holds a third of
    all rows still sends two rows per task.
    """
    order = W.partitionBy(*group).orderBy("first_seq", "source_review_id")
    two = (stored.select(*group, "first_seq", "source_review_id")
           .withColumn("place", F.row_number().over(order)).filter("place <= 2"))
    at = {n: F.col("place") == n for n in (1, 2)}
    return two.groupBy(*group).agg(
        F.max(F.when(at[1], F.col("source_review_id"))).alias("first_id"),
        F.max(F.when(at[1], F.col("first_seq"))).alias("first_at"),
        F.max(F.when(at[2], F.col("first_seq"))).alias("second_at"))


def _seen_before(observed: DataFrame, stored: DataFrame, group: list[str], name: str) -> DataFrame:
    """Add ``name``: another review of the group was stored before the observation's ``seq``."""
    other_at = F.when(F.col("first_id") == F.col("source_review_id"), F.col("second_at")).otherwise(F.col("first_at"))
    return (join_popular(observed, _earliest_two(stored, group), group, "left")
            .withColumn(name, F.coalesce(other_at < F.col("seq"), F.lit(False)))
            .drop("first_id", "first_at", "second_at"))


def _stored_bodies(narrow: DataFrame, *extra: str) -> DataFrame:
    return narrow.groupBy(*extra, *REVIEW_KEY).agg(
        F.min("seq").alias("first_seq"), F.min_by("body_key", "seq").alias("body_key"))


def with_keys(observations: DataFrame) -> DataFrame:
    """Observations with the body's digest and ``seq``."""
    return observations.select("*", body_key().alias("body_key"), seq().alias("seq"))


def without_texts(keyed: DataFrame) -> DataFrame:
    return keyed.drop("body", "title", "raw_record")


def narrow_log(observations: DataFrame) -> DataFrame:
    """Observations without their texts: the body by its digest, plus ``seq``; all later steps that
    need no text run on this."""
    return without_texts(with_keys(observations))


def duplicate_text(narrow: DataFrame) -> DataFrame:
    """Mark loaded observations whose body another, already loaded review of the same feed holds.

    The stored body is a review's first one, while the tested body is the observation's own.
    """
    return _seen_before(narrow, _stored_bodies(narrow), [*FEED_KEY, "body_key"], "duplicate_text")


def duplicate_text_undone(narrow: DataFrame) -> DataFrame:
    """The same mark for the entries a rolled-back page had processed before its failure.

    They see the loaded reviews and what their own page had inserted before them, and are never seen
    by entries of other pages.
    """
    stored = _stored_bodies(narrow.filter(F.col("failed_pos").isNull()))
    undone = narrow.filter(F.col("entry_pos") < F.col("failed_pos"))
    fresh = (_stored_bodies(undone, "raw_feed_page_id")
             .join(stored.select(*REVIEW_KEY, F.col("first_seq").alias("loaded_seq")), REVIEW_KEY, "left")
             .filter(F.col("loaded_seq").isNull() | (F.col("loaded_seq") > F.col("first_seq"))))
    marked = _seen_before(undone, stored, [*FEED_KEY, "body_key"], "before_page")
    marked = _seen_before(marked, fresh, ["raw_feed_page_id", "body_key"], "on_page")
    return marked.withColumn("duplicate_text", F.col("before_page") | F.col("on_page")).drop("before_page", "on_page")


def flag_dedup(observed_flags: DataFrame) -> DataFrame:
    """First trigger of each (review, flag type) wins."""
    return (observed_flags.groupBy(*REVIEW_KEY, "flag_type")
            .agg(F.min_by(F.struct("flag_severity", "flag_details", "run_id"), "seq").alias("first"))
            .select(review_id().alias("review_id"), *REVIEW_KEY, "flag_type", "first.flag_severity",
                    "first.flag_details", F.col("first.run_id").alias("created_run_id")))


def storefront_success(pages: DataFrame) -> DataFrame:
    """Latest fetch time among the pages of a feed that were parsed."""
    return (pages.filter(F.col("parse_status") == "parsed").groupBy(*FEED_KEY)
            .agg(F.max("fetched_at").alias("last_successful_ingestion_at")))
