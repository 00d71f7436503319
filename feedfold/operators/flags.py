"""Soft quality flags."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedfold.functions.text import SPACE_CLASS, holds_any
from feedfold.operators.fold import REVIEW_KEY
from feedfold.sources.lexicon import NEGATIVE_TERMS, POSITIVE_TERMS

# Flag types in output order, their severity, and the shortest body not flagged.
SEVERITY = {
    "non_english_or_unknown_language": "info",
    "too_short_review": "info",
    "duplicate_text_within_app": "warning",
    "rating_text_mismatch": "warning",
    "missing_author_metadata": "info",
    "parser_fallback_used": "info",
}
FLAG_TYPES = tuple(SEVERITY)
MIN_BODY_CHARS = 12

# Detail texts.
DUPLICATE_DETAIL = "Same normalized body exists for another source review id"
AUTHOR_DETAIL = "Both author label and URI are absent"
FALLBACK_DETAIL = "Feed entry was supplied as an object instead of a list"
HIGH_DETAIL = "High rating with strongly negative keyword"
LOW_DETAIL = "Low rating with strongly positive keyword"

# A word as the mismatch rule sees it: between whitespace, without edge punctuation.
_EDGE = r""".,!?;:'"()\[\]{}"""


def has_word(body: Column | str, words: tuple[str, ...]) -> Column:
    """True when a whitespace token of ``body``, stripped of edge punctuation, is one of ``words``.

    Only the start of the text and its whitespace start a search, which a look at the word's first letter ends in most places; plain letters
    are ruled out as whitespace by one test. A text without any of the words is not searched at all.
    """
    text = F.lower(F.col(body) if isinstance(body, str) else body)
    starts = "".join(sorted({word[0] for word in words}))
    space = rf"[[^{string.ascii_lowercase}]&&[{SPACE_CLASS}]]"
    found = F.concat(F.lit(" "), text).rlike(rf"{space}[{_EDGE}]*+(?=[{starts}])(?:{'|'.join(words)})[{_EDGE}]*+(?![^{SPACE_CLASS}])")
    held = holds_any(text, set(words)) if all(word.isalnum() for word in words) else None
    return found if held is None else held & found


def is_non_english() -> Column:
    return ~F.col("detected_language").eqNullSafe("en")


def is_short() -> Column:
    return F.col("body_char_count") < MIN_BODY_CHARS


def lacks_author() -> Column:
    return F.col("author_label").isNull() & F.col("author_uri").isNull()


def mismatch_detail(body: Column | str = "body") -> Column:
    """Detail text when rating and body words point in opposite directions, else NULL.

    The words' direction (1 where only positive ones occur, -1 where only negative ones do) stands here once, so no text is searched twice.
    """
    rating = F.col("rating")
    words = has_word(body, POSITIVE_TERMS).cast("int") - has_word(body, NEGATIVE_TERMS).cast("int")
    side = F.when(rating >= 4, 1).when(rating <= 2, -1)
    return F.when(side.isNotNull() & (words == -side), F.when(rating >= 4, F.lit(HIGH_DETAIL)).otherwise(F.lit(LOW_DETAIL)))


def with_mismatch(valid: DataFrame) -> DataFrame:
    """Evaluate the text rule next to the scan, so that no text has to travel for it."""
    return valid.withColumn("mismatch_detail", mismatch_detail())


def build_flags() -> Column:
    """Ordered array of (type, severity, details) structs."""

    def flag(kind: str, when: Column, details: Column | str) -> Column:
        text = F.lit(details) if isinstance(details, str) else details
        return F.when(when, F.struct(F.lit(kind).alias("flag_type"), F.lit(SEVERITY[kind]).alias("flag_severity"),
                                     text.cast("string").alias("flag_details")))

    return F.array_compact(F.array(
        flag("non_english_or_unknown_language", is_non_english(), F.col("detected_language")),
        flag("too_short_review", is_short(), F.concat(F.lit("body_char_count="), F.col("body_char_count"))),
        flag("duplicate_text_within_app", F.col("duplicate_text"), DUPLICATE_DETAIL),
        flag("missing_author_metadata", lacks_author(), AUTHOR_DETAIL),
        flag("parser_fallback_used", F.col("parser_fallback_used"), FALLBACK_DETAIL),
        flag("rating_text_mismatch", F.col("mismatch_detail").isNotNull(), F.col("mismatch_detail")),
    ))


def observed_flags(checked: DataFrame) -> DataFrame:
    """One row per flag of each observation; ``checked`` went through the duplicate test."""
    return checked.select(
        *REVIEW_KEY, "run_id", "seq", "entry_pos", "failed_pos", F.explode(build_flags()).alias("flag")
    ).select(*REVIEW_KEY, "run_id", "seq", "entry_pos", "failed_pos", "flag.*")
