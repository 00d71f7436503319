"""Feature table and rating-derived weak labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedfold.functions import text as tx
from feedfold.operators.flags import FLAG_TYPES
from feedfold.sources.exports import require_no_identity
from feedfold.sources.lexicon import (ISSUE_SIGNALS, ISSUE_TERMS, NEGATIVE_TERMS, POSITIVE_TERMS, Lexicon,
                                      check_lexicon)

WEAK_LABEL_SOURCE = "rating_v1"
# Labels, and noise reasons in output order.
WEAK_LABELS = ("negative", "neutral", "positive")
NOISE_REASONS = ("rating_text_mismatch", "mixed_sentiment_keywords", "neutral_rating", "too_short_review",
                 "non_english_or_unknown_language")

# The feature table's 39 columns, in order.
FEATURE_COLUMNS = (
    "review_id", "source_review_id", "app_name", "vertical_name", "storefront", "rating", "title", "body",
    "detected_language", "published_at", "title_char_count", "body_char_count", "body_word_count",
    "question_mark_count", "exclamation_mark_count", "published_year", "published_month",
    "published_day_of_week", "published_hour",
    *(f"quality_flag_{flag}" for flag in FLAG_TYPES), "quality_flag_count", "has_any_quality_flag",
    *(f"issue_{signal}" for signal in ISSUE_SIGNALS), "issue_signal_count",
    "weak_label", "weak_label_source", "weak_label_needs_review", "weak_label_noise_reasons",
)


def weak_label(rating: Column | str = "rating", strict: bool = True) -> Column:
    rating = F.col(rating) if isinstance(rating, str) else rating
    bad = F.raise_error(F.concat(F.lit("rating must be an integer from 1 to 5, received "),
                                 F.coalesce(rating.cast("string"), F.lit("null")))) if strict else F.lit(None)
    return (F.when(rating.isin(1, 2), "negative").when(rating == 3, "neutral")
            .when(rating.isin(4, 5), "positive").otherwise(bad.cast("string")))


def time_features(published: Column | str = "published_at") -> dict[str, Column]:
    return {
        "published_year": F.year(published), "published_month": F.month(published),
        "published_day_of_week": F.date_format(published, "EEEE"), "published_hour": F.hour(published),
    }


def combined_text() -> Column:
    return tx.strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))))


def with_combined_text(rows: DataFrame) -> DataFrame:
    """Add ``combined_text`` and ``folded_text``, each a projection of its own, so that no term makes them again."""
    return rows.withColumn("combined_text", combined_text()).withColumn("folded_text", tx.folded("combined_text"))


def issue_signals(text: Column, lexicon: Lexicon = ISSUE_TERMS, low: Column | None = None) -> dict[str, Column]:
    check_lexicon(lexicon)
    return {f"issue_{s}": tx.has_term(text, lexicon[s], low).cast("int") for s in ISSUE_SIGNALS}


def sentiment_presence(text: Column, low: Column | None = None) -> dict[str, Column]:
    return {"has_positive": tx.has_term(text, POSITIVE_TERMS, low), "has_negative": tx.has_term(text, NEGATIVE_TERMS, low)}


def text_features(text: Column) -> dict[str, Column]:
    body = F.coalesce("body", F.lit(""))
    return {
        "title_char_count": F.length(F.coalesce("title", F.lit(""))),
        "body_char_count": F.length(body),
        "body_word_count": tx.word_count(body),
        "question_mark_count": tx.occurrences(text, "?"),
        "exclamation_mark_count": tx.occurrences(text, "!"),
    }


def noise_reasons(text: Column, low: Column | None = None) -> Column:
    """Ordered reasons joined by ``|``; needs rating, detected_language and the flag columns."""
    present = sentiment_presence(text, low)
    rules = [
        F.col("quality_flag_rating_text_mismatch") == 1,
        present["has_positive"] & present["has_negative"],
        F.col("rating") == 3,
        F.col("quality_flag_too_short_review") == 1,
        ~F.col("detected_language").eqNullSafe("en") | (F.col("quality_flag_non_english_or_unknown_language") == 1),
    ]
    return F.array_join(F.array_compact(F.array(*[
        F.when(rule, F.lit(name)) for rule, name in zip(rules, NOISE_REASONS)])), "|")


def flag_one_hot(flags: DataFrame, strict: bool = True) -> DataFrame:
    """One row per flagged review with a 0/1 column per flag type; an unknown type is an error."""
    known = F.col("flag_type").isin(*FLAG_TYPES)
    kind = F.when(known, F.col("flag_type")).otherwise(
        F.raise_error(F.concat(F.lit("unsupported quality flag "), F.col("flag_type"))) if strict else F.lit(None))
    return flags.withColumn("flag_type", kind).groupBy("review_id").agg(*[
        F.max(F.when(F.col("flag_type") == t, 1).otherwise(0)).alias(f"quality_flag_{t}") for t in FLAG_TYPES])


def review_features(view: DataFrame, flags: DataFrame, lexicon: Lexicon = ISSUE_TERMS) -> DataFrame:
    """The 39-column feature table: one join, then column expressions only."""
    flag_columns = [f"quality_flag_{t}" for t in FLAG_TYPES]
    base = view.select("review_id", "source_review_id", "app_name", "vertical_name", "storefront", "rating",
                       "title", "body", "detected_language", "published_at")
    joined = base.join(flag_one_hot(flags), "review_id", "left").fillna(0, flag_columns)
    joined = with_combined_text(joined)
    text, low = F.col("combined_text"), F.col("folded_text")
    rows = joined.withColumns({
        **text_features(text), **time_features(), **issue_signals(text, lexicon, low),
        "quality_flag_count": sum((F.col(c) for c in flag_columns[1:]), F.col(flag_columns[0])),
        "weak_label": weak_label(), "weak_label_source": F.lit(WEAK_LABEL_SOURCE),
        "weak_label_noise_reasons": noise_reasons(text, low),
    })
    signal_columns = [f"issue_{s}" for s in ISSUE_SIGNALS]
    rows = rows.withColumns({
        "has_any_quality_flag": (F.col("quality_flag_count") > 0).cast("int"),
        "issue_signal_count": sum((F.col(c) for c in signal_columns[1:]), F.col(signal_columns[0])),
        "weak_label_needs_review": (F.col("weak_label_noise_reasons") != "").cast("int"),
        "detected_language": F.coalesce("detected_language", F.lit("unknown")),
        "title": F.coalesce("title", F.lit("")), "body": F.coalesce("body", F.lit("")),
    })
    return require_no_identity(rows.select(*FEATURE_COLUMNS))


def feature_summary(features: DataFrame) -> DataFrame:
    """Long-form summary (section, item, value): totals, labels, flags, signals, reasons.

    One pass collects everything that is a sum; only the distinct counts need their own grouping.
    """
    sums = {
        ("totals", "rows"): F.count("*"),
        ("totals", "needs_review_rows"): F.sum("weak_label_needs_review"),
        **{("weak_label", l): F.count_if(F.col("weak_label") == l) for l in WEAK_LABELS},
        **{("quality_flag", t): F.sum(f"quality_flag_{t}") for t in FLAG_TYPES},
        **{("issue_signal", s): F.sum(f"issue_{s}") for s in ISSUE_SIGNALS},
        **{("noise_reason", r): F.count_if(F.array_contains(F.split("weak_label_noise_reasons", r"\|"), r))
           for r in NOISE_REASONS},
    }
    one = features.agg(*[F.coalesce(e, F.lit(0)).cast("double").alias(f"{a}.{b}") for (a, b), e in sums.items()])
    one = one.withColumn("totals.needs_review_share",
                         F.coalesce(F.try_divide(F.col("`totals.needs_review_rows`"), F.col("`totals.rows`")), F.lit(0.0)))
    names = one.columns
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(n.split(".")[0]).alias("section"), F.lit(n.split(".")[1]).alias("item"),
                 F.col(f"`{n}`").alias("value")) for n in names])).alias("x")).select("x.*")
    for column, item in (("review_id", "unique_review_ids"), ("app_name", "apps"), ("vertical_name", "verticals")):
        long = long.unionByName(features.select(column).distinct()
                                .agg(F.count("*").cast("double").alias("value")).select(
                                    F.lit("totals").alias("section"), F.lit(item).alias("item"), "value"))
    return long
