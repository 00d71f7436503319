"""Features, weak labels and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedfold.functions.text import has_term
from feedfold.operators import features as fe
from feedfold.operators import profile, sketches
from feedfold.operators.flags import FLAG_TYPES
from feedfold.plans.catalog import register
from feedfold.plans.oracle import iso, terms
from feedfold.sources import exports
from feedfold.sources.lexicon import ISSUE_SIGNALS

FLAGS = [f"quality_flag_{t}" for t in FLAG_TYPES]
ISSUES = [f"issue_{s}" for s in ISSUE_SIGNALS]


def _sql(columns) -> str:
    return ", ".join(f"{iso(c)} AS {c}" if c == "published_at" else c for c in columns)


# --- features and labels --------------------------------------------------------------------------
register("weak_label", "SELECT review_id, rating, weak_label FROM features")(
    lambda f: f.narrow_reviews("rating").select("review_id", "rating", fe.weak_label().alias("weak_label")))

_TIME = ["published_year", "published_month", "published_day_of_week", "published_hour"]
register("time_features", f"SELECT review_id, {', '.join(_TIME)} FROM features")(
    lambda f: f.narrow_reviews("published_at").select("review_id", *[c.alias(n) for n, c in fe.time_features().items()]))

register("term_match", "SELECT doc_id, " + ", ".join(
    f"{terms('text', [t])} AS has_{i}" for i, t in enumerate(("version", "the", "of the", "license", "und der"))) + " FROM documents")(
    lambda f: f.spark.read.parquet(f"{f.source}/documents.parquet").select("doc_id", *[
        has_term("text", [t]).alias(f"has_{i}") for i, t in enumerate(("version", "the", "of the", "license", "und der"))]))

register("issue_signals", f"SELECT review_id, {', '.join(ISSUES)} FROM features")(
    lambda f: fe.with_combined_text(f.reviews).select("review_id", *[
        c.alias(n) for n, c in fe.issue_signals(F.col("combined_text"), f.lexicon, F.col("folded_text")).items()]))

register("sentiment_presence", "SELECT review_id, has_positive, has_negative FROM features")(
    lambda f: fe.with_combined_text(f.reviews).select("review_id", *[
        c.alias(n) for n, c in fe.sentiment_presence(F.col("combined_text"), F.col("folded_text")).items()]))

register("noise_reasons", "SELECT review_id, weak_label_noise_reasons FROM features")(
    lambda f: fe.with_combined_text(f.training_view.join(fe.flag_one_hot(f.review_flags), "review_id", "left").fillna(0, FLAGS)).select(
        "review_id", fe.noise_reasons(F.col("combined_text"), F.col("folded_text")).alias("weak_label_noise_reasons")))

register("flag_one_hot", f"SELECT review_id, {', '.join(FLAGS)} FROM hot")(lambda f: fe.flag_one_hot(f.review_flags))

_TEXT = ["title_char_count", "body_char_count", "body_word_count", "question_mark_count", "exclamation_mark_count"]
register("text_features", f"SELECT review_id, {', '.join(_TEXT)} FROM features")(
    lambda f: f.reviews.withColumn("combined_text", fe.combined_text()).select(
        "review_id", *[c.alias(n) for n, c in fe.text_features(F.col("combined_text")).items()]))

register("review_features", f"SELECT {_sql(fe.FEATURE_COLUMNS)} FROM features")(
    lambda f: fe.review_features(f.training_view, f.review_flags, f.lexicon))

_SUMMARY = " UNION ALL ".join([
    "SELECT 'totals' AS section, 'rows' AS item, count(*)::DOUBLE AS value FROM features",
    "SELECT 'totals', 'needs_review_rows', sum(weak_label_needs_review)::DOUBLE FROM features",
    "SELECT 'totals', 'needs_review_share', round(avg(weak_label_needs_review), 9) FROM features",
    "SELECT 'totals', 'unique_review_ids', count(DISTINCT review_id)::DOUBLE FROM features",
    "SELECT 'totals', 'apps', count(DISTINCT app_name)::DOUBLE FROM features",
    "SELECT 'totals', 'verticals', count(DISTINCT vertical_name)::DOUBLE FROM features",
    *[f"SELECT 'weak_label', '{x}', count(*) FILTER (weak_label = '{x}')::DOUBLE FROM features" for x in fe.WEAK_LABELS],
    *[f"SELECT 'quality_flag', '{x}', sum(quality_flag_{x})::DOUBLE FROM features" for x in FLAG_TYPES],
    *[f"SELECT 'issue_signal', '{x}', sum(issue_{x})::DOUBLE FROM features" for x in ISSUE_SIGNALS],
    *[f"SELECT 'noise_reason', '{x}', count(*) FILTER (contains(weak_label_noise_reasons, '{x}'))::DOUBLE FROM features"
      for x in fe.NOISE_REASONS]])
register("feature_summary", _SUMMARY)(lambda f: fe.feature_summary(f.features))

_SORTED = sorted(fe.FEATURE_COLUMNS)
_ROW_JSON = "'{'||concat_ws(',', " + ", ".join(
    f"'\"{c}\":'||to_json({iso(c) if c == 'published_at' else c})::VARCHAR" for c in _SORTED) + ")||'}'"
_WORDS = ", ".join(f"sum(('0x'||substr(d, {1 + 15 * i}, 15))::BIGINT)::HUGEINT::VARCHAR" for i in range(4))
register("feature_export_digest", f"""SELECT count(*) AS row_count, sha256(concat_ws('|', {_WORDS})) AS content_digest
    FROM (SELECT sha256({_ROW_JSON}) AS d FROM features)""")(
    lambda f: exports.content_digest(f.features.withColumn("published_at", F.date_format(
        "published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "review_id"))

_EDITED = """SELECT * REPLACE (CASE WHEN storefront = 'fr' AND rating = 1 THEN body_word_count + 1 ELSE body_word_count END AS body_word_count,
    CASE WHEN app_name = 'App 3' THEN NULL ELSE published_hour END AS published_hour) FROM features WHERE app_name <> 'App 4'"""
_CHANGED = ", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in sorted(("body_word_count", "published_hour")))
register("feature_export_diff", f"""SELECT * FROM (SELECT COALESCE(a.review_id, b.review_id) AS review_id,
    CASE WHEN b.review_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
    CASE WHEN b.review_id IS NULL THEN '' ELSE concat_ws('|', {_CHANGED}) END AS changed_columns
    FROM features a LEFT JOIN edited b ON a.review_id = b.review_id) WHERE change = 'removed' OR changed_columns <> ''""",
         {"edited": _EDITED})(lambda f: exports.export_diff(f.spark, _exported(f, False), _exported(f, True), "review_id"))


def _exported(f, edited: bool) -> str:
    """The feature table as a bucketed export; the edited one has other word counts and hours and lacks an app."""
    rows = f.features
    if edited:
        french = (F.col("storefront") == "fr") & (F.col("rating") == 1)
        rows = rows.filter(F.col("app_name") != "App 4").withColumns({
            "body_word_count": F.when(french, F.col("body_word_count") + 1).otherwise(F.col("body_word_count")),
            "published_hour": F.when(F.col("app_name") != "App 3", F.col("published_hour"))})
    return f.once(f"export-{edited}", lambda path: exports.write_export(rows, path, "review_id", 64))


# --- profiling ------------------------------------------------------------------------------------
_SPARK_TYPES = {**{c: "string" for c in fe.FEATURE_COLUMNS}, "rating": "bigint", "published_at": "timestamp",
                **{c: "int" for c in [*FLAGS, *ISSUES, *_TEXT, "quality_flag_count", "has_any_quality_flag",
                                      "issue_signal_count", "weak_label_needs_review", "published_year",
                                      "published_month", "published_hour"]}}
register("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{_SPARK_TYPES[c]}' AS dtype, count(*) FILTER ({c} IS NULL) AS missing_count, "
    f"count(DISTINCT {c}) + max(({c} IS NULL)::INTEGER) AS unique_values FROM features" for c in fe.FEATURE_COLUMNS))(
    lambda f: profile.column_profile(f.features))

_MERGED = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{_SPARK_TYPES[c]}' AS dtype, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS missing_count, "
    f"count(DISTINCT {c}) + max(({c} IS NULL)::INTEGER) AS n FROM features" for c in fe.FEATURE_COLUMNS)
register("column_profile_merged", f"""SELECT column_name, dtype, row_count, missing_count,
    CASE WHEN n <= {sketches.FEW_VALUES} THEN n END AS few_values FROM ({_MERGED})""")(
    lambda f: sketches.merged_columns(f.column_sketches).drop("unique_estimate"))

register("length_range_merged", " UNION ALL ".join(f"""SELECT weak_label, '{c}' AS variable, count({c}) AS n, min({c})::BIGINT AS min,
    max({c})::BIGINT AS max FROM features GROUP BY weak_label""" for c in ("body_char_count", "body_word_count")))(
    lambda f: sketches.merged_quantiles(f.length_sketches, ["weak_label"], {}))

register("value_shares", " UNION ALL ".join([
    """SELECT 'rating' AS variable, rating::VARCHAR AS value, count(*) AS row_count,
        round(count(*)::DOUBLE / (SELECT count(*) FROM features), 9) AS share FROM features GROUP BY rating""",
    *[f"""SELECT 'weak_label', '{x}', count(*) FILTER (weak_label = '{x}'),
        round(count(*) FILTER (weak_label = '{x}')::DOUBLE / count(*), 9) FROM features""" for x in fe.WEAK_LABELS]]))(
    lambda f: profile.value_shares(f.features))

_SHARES = ", ".join(f"round(avg((weak_label = '{x}')::INTEGER), 9) AS label_share_{x}" for x in fe.WEAK_LABELS)
register("label_share_by_app", f"""SELECT 'app' AS level, app_name AS name, {_SHARES} FROM features GROUP BY app_name
    UNION ALL SELECT 'vertical', vertical_name, {_SHARES} FROM features GROUP BY vertical_name""")(
    lambda f: profile.label_shares(f.features, "app_name").withColumnRenamed("app_name", "name").withColumn("level", F.lit("app"))
    .unionByName(profile.label_shares(f.features, "vertical_name").withColumnRenamed("vertical_name", "name")
                 .withColumn("level", F.lit("vertical"))))

register("rating_stats_by_app", f"""SELECT app_name, count(rating) AS review_count, round(avg(rating), 9) AS rating_mean,
    round(median(rating), 9) AS rating_median, {_SHARES} FROM features GROUP BY app_name""")(
    lambda f: profile.rating_stats(f.features, "app_name"))

register("length_describe", " UNION ALL ".join(f"""SELECT weak_label, '{c}' AS variable, count({c}) AS n, round(avg({c}), 9) AS mean,
    round(stddev_samp({c}), 9) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 9) AS p25,
    round(quantile_cont({c}, 0.5), 9) AS p50, round(quantile_cont({c}, 0.75), 9) AS p75, max({c})::DOUBLE AS max
    FROM features GROUP BY weak_label""" for c in ("body_char_count", "body_word_count")))(
    lambda f: profile.length_describe(f.features))

_BOX = {
    "clipped": """SELECT weak_label, least(body_char_count::DOUBLE, (SELECT quantile_cont(body_char_count, 0.99) FROM features)) AS x
        FROM features""",
    "boxes": """SELECT weak_label, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
        FROM clipped GROUP BY weak_label"""}
register("clipped_box_stats", """SELECT weak_label, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3,
    round(min(x) FILTER (x >= q1 - 1.5*(q3 - q1)), 9) AS whisker_low, round(max(x) FILTER (x <= q3 + 1.5*(q3 - q1)), 9) AS whisker_high
    FROM clipped JOIN boxes USING (weak_label) GROUP BY weak_label, q1, median, q3""", _BOX)(
    lambda f: profile.clipped_box_stats(f.features))

register("short_share_by_rating", """SELECT rating, round(avg(1 - quality_flag_too_short_review), 9) AS no_short_share,
    round(avg(quality_flag_too_short_review), 9) AS short_share FROM features GROUP BY rating""")(
    lambda f: profile.flag_share(f.features, "rating", "quality_flag_too_short_review", "short"))

register("time_range", f"""SELECT {iso('min(published_at)')} AS earliest, {iso('max(published_at)')} AS latest,
    count(*) FILTER (published_at IS NULL) AS unparsable FROM features""")(lambda f: profile.time_range(f.features))
register("month_counts", "SELECT published_year, published_month, count(*) AS reviews FROM features GROUP BY ALL")(
    lambda f: profile.month_counts(f.features))
register("weekday_counts", "SELECT published_day_of_week, count(*) AS reviews FROM features GROUP BY ALL")(
    lambda f: profile.weekday_counts(f.features))
register("indicator_totals", " UNION ALL ".join(
    f"SELECT '{c}' AS indicator, sum({c})::BIGINT AS reviews FROM features" for c in [*FLAGS, *ISSUES]))(
    lambda f: profile.indicator_totals(f.features))
register("issue_overlap", """SELECT issue_signal_count AS issue_signals_per_review, count(*) AS reviews
    FROM features GROUP BY ALL""")(lambda f: profile.issue_overlap(f.features))

register("label_diagnostics", f"""SELECT 'reviews_needing_label_review' AS diagnostic, sum(weak_label_needs_review)::DOUBLE AS value FROM features
    UNION ALL SELECT 'label_review_share', round(avg(weak_label_needs_review), 9) FROM features
    UNION ALL SELECT 'reviews_with_multiple_issue_signals', count(*) FILTER (issue_signal_count > 1)::DOUBLE FROM features
    UNION ALL SELECT 'issue_signals_with_zero_matches', ({' + '.join(f"(sum({c}) = 0)::INTEGER" for c in ISSUES)})::DOUBLE FROM features
    UNION ALL SELECT 'largest_label_share', round(max(n)::DOUBLE / sum(n), 9) FROM (SELECT count(*) AS n FROM features GROUP BY weak_label)
    UNION ALL SELECT 'largest_app_share', round(max(n)::DOUBLE / sum(n), 9) FROM (SELECT count(*) AS n FROM features GROUP BY app_name)""")(
    lambda f: profile.label_diagnostics(f.features))

register("mismatch_by_app", """SELECT app_name, sum(quality_flag_rating_text_mismatch)::BIGINT AS mismatches,
    round(avg(quality_flag_rating_text_mismatch), 9) AS mismatch_share FROM features GROUP BY app_name""")(
    lambda f: profile.mismatch_by_app(f.features))
register("mismatch_by_label", """SELECT weak_label, round(avg(1 - quality_flag_rating_text_mismatch), 9) AS no_mismatch_share,
    round(avg(quality_flag_rating_text_mismatch), 9) AS mismatch_share FROM features GROUP BY weak_label""")(
    lambda f: profile.flag_share(f.features, "weak_label", "quality_flag_rating_text_mismatch", "mismatch"))

register("noise_examples", r"""SELECT app_name, vertical_name, rating, weak_label, weak_label_noise_reasons, place::INTEGER AS place,
    CASE WHEN length(t) > 180 THEN left(t, 180)||'…' ELSE t END AS body_excerpt FROM (SELECT *, trim(regexp_replace(
        regexp_replace(regexp_replace(body, 'https?://\S+|www\.\S+', '[URL]', 'g'),
        '(^|[^\p{L}\p{N}_])[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}', '\1[EMAIL]', 'g'), '\s+', ' ', 'g')) AS t
    FROM (SELECT *, row_number() OVER (PARTITION BY weak_label_noise_reasons ORDER BY app_name, rating, review_id) AS place
        FROM features WHERE weak_label_needs_review = 1) WHERE place <= 2 ORDER BY weak_label_noise_reasons, place LIMIT 12)""")(
    lambda f: profile.noise_examples(f.features))
