"""Parsed entries to typed observations, hard validation and page atomicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedfold.functions import text as tx
from feedfold.session import join_dimension, written
from feedfold.sources.pages import PAGE_KEY, raw_page_id

# Hard validation reasons, in the order they are reported.
REASONS = ("missing_review_id", "missing_or_invalid_rating", "rating_out_of_range", "empty_body",
           "invalid_timestamp", "broken_record_structure")


def payload_hash(canonical: Column | str = "raw_record") -> Column:
    return F.sha2(canonical, 256)


# Optional text fields: parsed field, normalised field.
_OPTIONAL = {"id_raw": "source_review_id", "title_raw": "title", "author_label_raw": "author_label",
             "author_uri_raw": "author_uri", "app_version_raw": "app_version", "review_url_raw": "review_url"}


def normalise(entries: DataFrame) -> DataFrame:
    """Typed columns for every parsed entry; lineage columns pass through unchanged.

    ``raw_record`` must already be canonical JSON, as the entry parser yields it. Cleaning comes
    first and whatever is derived from cleaned text comes after, so no text is cleaned twice.
    """
    lineage = [c for c in entries.columns if not c.endswith("_raw")]
    cleaned = entries.select(
        *lineage,
        *[tx.clean_text(raw).alias(name) for raw, name in _OPTIONAL.items()],
        tx.clean_text("body_raw").alias("body"),
        tx.safe_int("rating_raw").alias("rating"),
        tx.parse_timestamp("published_raw").alias("published_at"),
        tx.safe_int("vote_count_raw").alias("vote_count"),
        tx.safe_int("vote_sum_raw").alias("vote_sum"),
        payload_hash().alias("raw_payload_hash"),
    )
    typed = cleaned.withColumns({name: F.nullif(name, F.lit("")) for name in _OPTIONAL.values()})
    typed = typed.withColumns({
        "spoken_text": F.concat_ws(" ", "title", F.nullif("body", F.lit(""))),  # both without outer whitespace
        "flat_body": tx.flat_text("body")})
    return typed.withColumns({
        "detected_language": tx.detect_language("spoken_text"),
        "body_char_count": F.length("body").cast("bigint"),
        "body_token_estimate": tx.token_estimate("flat_body").cast("bigint"),
        "author_fingerprint": tx.author_fingerprint("source_platform", "author_uri", "author_label"),
        "raw_feed_page_id": raw_page_id(),
    }).drop("spoken_text", "flat_body")


def attach_cohort(observations: DataFrame, cohort: DataFrame) -> DataFrame:
    """App name and vertical of the feed each observation came from."""
    names = cohort.select(F.col("app_id").alias("source_app_id"), "storefront", "app_name", "vertical")
    return join_dimension(observations, names, ["source_app_id", "storefront"])


def validation_reasons() -> Column:
    rating = F.col("rating")
    rules = [
        F.col("source_review_id").isNull() | (F.col("source_review_id") == ""),
        rating.isNull(),
        rating.isNotNull() & ~rating.between(1, 5),
        F.col("body") == "",  # cleaned text has no outer whitespace
        F.col("published_at").isNull(),
        F.col("raw_record").isNull() | ~F.startswith(F.col("raw_record"), F.lit("{")),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in zip(rules, REASONS)]))


def validate(observations: DataFrame) -> DataFrame:
    """Add ``reasons``. The one-element explode keeps later filters on the result of the rules, where
    pushing them further down would clean every text a second time."""
    return observations.select("*", F.explode(F.array(validation_reasons())).alias("reasons"))


def reject_payloads(validated: DataFrame) -> DataFrame:
    """Observations whose ``raw_record`` is kept for rejects only: nothing later reads the payload of a valid one, and it holds the texts once more."""
    return validated.withColumn("raw_record", F.when(F.size("reasons") > 0, F.col("raw_record")))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.filter(F.size("reasons") == 0), validated.filter(F.size("reasons") > 0)


def negative_votes() -> Column:
    return (F.coalesce(F.col("vote_count"), F.lit(0)) < 0) | (F.coalesce(F.col("vote_sum"), F.lit(0)) < 0)


def breaks_constraint() -> Column:
    """A valid entry the review table would refuse: a negative vote number."""
    return negative_votes() & (F.size("reasons") == 0)


def rolled_back_pages(validated: DataFrame) -> DataFrame:
    """Pages that are rolled back as a whole, with the position of the first refused entry."""
    return (validated.filter(breaks_constraint()).groupBy(*PAGE_KEY)
            .agg(F.min("entry_pos").alias("failed_pos")))


def mark_rollback(validated: DataFrame) -> DataFrame:
    """Add ``failed_pos`` (NULL on pages that load).

    The refused pages are written first, so that Spark knows their bytes and broadcasts them below its own threshold
    instead of shuffling every text. Pass a stored frame: its narrow columns are all that finding them reads.
    """
    return validated.join(written(rolled_back_pages(validated), "rolled-back"), PAGE_KEY, "left")


def committed(marked: DataFrame) -> DataFrame:
    """Entries of pages that load, rejects included."""
    return marked.filter(F.col("failed_pos").isNull())


def rejected_records(marked: DataFrame) -> DataFrame:
    """Reject table: first reason, all reasons as JSON, payload and lineage."""
    return split_valid(committed(marked))[1].select(
        "run_id", "raw_feed_page_id", "source_app_id", "storefront", "entry_pos", "source_review_id",
        F.get("reasons", F.lit(0)).alias("rejection_reason"),
        F.to_json("reasons").alias("rejection_details"),
        "raw_payload_hash", F.col("raw_record").alias("raw_payload"))


def page_status(pages: DataFrame, rolled_back: DataFrame) -> DataFrame:
    """parsed / parse_error per landed page; ``pages`` carries the page key and ``is_json``."""
    status = pages.join(rolled_back, PAGE_KEY, "left")
    bad_json, refused = ~F.col("is_json"), F.col("failed_pos").isNotNull()
    return status.withColumns({
        "parse_status": F.when(bad_json | refused, "parse_error").otherwise("parsed"),
        "parse_error": F.when(bad_json, "invalid JSON").when(refused, "constraint failed"),
    }).drop("failed_pos")
