"""Upserts, lineage, duplicate test, flags and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedfold.operators import accounting, fold
from feedfold.operators.expect import check_rule, expect, foreign_key_rule, not_null_rule, unique_rule
from feedfold.operators.flags import build_flags, is_non_english, is_short, lacks_author
from feedfold.plans.catalog import register
from feedfold.plans.oracle import iso
from feedfold.sources import cohort as co
from feedfold.sources import landing
from feedfold.sources.pages import PAGE_KEY

_KEY = "source_app_id, storefront, source_review_id"
KEY = [c.strip() for c in _KEY.split(",")]

_REVIEW = """review_id, source_platform, source_app_id, storefront, source_review_id, rating, title, body, review_url,
    source_endpoint, detected_language, body_char_count, body_token_estimate, author_fingerprint, app_version, vote_count,
    vote_sum, raw_payload_hash, first_raw_feed_page_id, last_raw_feed_page_id, first_seen_run_id, last_seen_run_id"""
register("review_upsert", f"""SELECT {_REVIEW}, {iso('published_at')} AS published_at, {iso('first_seen_at')} AS first_seen_at,
    {iso('last_seen_at')} AS last_seen_at FROM reviews""")(lambda f: fold.review_upsert(f.valid))

register("insert_update_label", f"""SELECT {_KEY}, run_id, page_number, entry_pos,
    CASE WHEN place = 1 THEN 'inserted' ELSE 'updated' END AS action FROM placed""")(
    lambda f: f.labels.select(*KEY, "run_id", "page_number", "entry_pos", "action"))

register("first_last_seen", f"""SELECT r.review_id, first_raw_feed_page_id, first_seen_run_id AS first_run_id,
    {iso('first_seen_at')} AS first_fetched_at, last_raw_feed_page_id, last_seen_run_id AS last_run_id,
    {iso('last_seen_at')} AS last_fetched_at, (SELECT count(*) FROM good g WHERE g.source_app_id = r.source_app_id
        AND g.storefront = r.storefront AND g.source_review_id = r.source_review_id) AS observation_count FROM reviews r""")(
    lambda f: fold.first_last_seen(f.loaded))

register("reviewer_upsert", f"""SELECT source_platform, author_fingerprint, author_uri, author_label,
    {iso('created')} AS created_at, {iso('fetched_at')} AS updated_at
    FROM (SELECT *, first_value(fetched_at) OVER (PARTITION BY author_fingerprint ORDER BY seq) AS created,
        row_number() OVER (PARTITION BY author_fingerprint ORDER BY seq DESC) AS back FROM good
        WHERE author_fingerprint IS NOT NULL) WHERE back = 1""")(lambda f: f.reviewers)


def _versions(f):
    """Two manifest versions: the second renames and moves every app with an even number."""
    number = F.substring("app_id", 5, 10).cast("bigint")
    second = f.cohort.withColumns({
        "app_name": F.when(number % 2 == 0, F.concat("app_name", F.lit(" 2"))).otherwise(F.col("app_name")),
        "vertical": F.when(number % 2 == 0, F.lit("v9")).otherwise(F.col("vertical")),
        "version": F.lit(2)})
    return f.cohort.withColumn("version", F.lit(1)).unionByName(second)


register("dimension_upsert", """SELECT source_app_id, app_name||CASE WHEN app_no % 2 = 0 THEN ' 2' ELSE '' END AS app_name,
    CASE WHEN app_no % 2 = 0 THEN 'v9' ELSE vertical_name END AS vertical_name,
    (SELECT count(DISTINCT vertical_name) + 1 FROM feeds) AS vertical_count, count(*) AS storefront_count
    FROM feeds GROUP BY ALL""")(
    lambda f: (lambda d: d["apps"].select("source_app_id", "app_name", "vertical_name").join(
        d["storefronts"].groupBy("source_app_id").agg(F.count("*").alias("storefront_count")), "source_app_id").withColumn(
        "vertical_count", d["verticals"].agg(F.count("*")).scalar()))(co.dimension_upsert(_versions(f), landing.PLATFORM, 10)))

register("app_context_lookup", """SELECT 'seeded' AS state, run_id, source_app_id, storefront FROM requests
    UNION ALL SELECT 'missing', run_id, 'x-'||source_app_id, storefront FROM requests""")(
    lambda f: (lambda found: found[0].withColumn("state", F.lit("seeded")).unionByName(
        found[1].withColumn("state", F.lit("missing"))))(co.app_context(
            f.requests.unionByName(f.requests.withColumn("source_app_id", F.concat(F.lit("x-"), "source_app_id"))),
            f.dims["storefronts"])))

register("duplicate_text", f"SELECT {_KEY}, run_id, entry_pos, duplicate_text FROM tested WHERE failed_pos IS NULL")(
    lambda f: f.checked.select(*KEY, "run_id", "entry_pos", "duplicate_text"))

register("flag_dedup", "SELECT review_id, flag_type, flag_severity, flag_details, created_run_id FROM flags")(
    lambda f: f.flags.select("review_id", "flag_type", "flag_severity", "flag_details", "created_run_id"))

register("storefront_success", f"""SELECT source_app_id, storefront, {iso('max(fetched_at)')} AS last_successful_ingestion_at
    FROM pages_done WHERE parse_status = 'parsed' GROUP BY ALL""")(lambda f: fold.storefront_success(f.pages))

# --- flags on loaded observations -----------------------------------------------------------------
for _name, _rule, _sql in (
    ("flag_language", is_non_english, "detected_language <> 'en'"),
    ("flag_short", is_short, "body_char_count < 12"),
    ("flag_author", lacks_author, "author_label IS NULL AND author_uri IS NULL"),
    ("flag_fallback", lambda: F.col("parser_fallback_used"), "parser_fallback_used"),
    ("flag_mismatch", lambda: F.col("mismatch_detail").isNotNull(), "mismatch_detail IS NOT NULL"),
):
    register(_name, f"SELECT {_KEY}, run_id, {_sql} AS flagged FROM good")(
        lambda f, rule=_rule: f.loaded.select(*KEY, "run_id", rule().alias("flagged")))

register("flag_duplicate", f"SELECT {_KEY}, run_id, duplicate_text AS flagged FROM tested WHERE failed_pos IS NULL")(
    lambda f: f.checked.select(*KEY, "run_id", F.exists(
        build_flags(), lambda x: x["flag_type"] == "duplicate_text_within_app").alias("flagged")))

register("quality_flags", f"SELECT {_KEY}, run_id, flag_type, flag_severity, flag_details FROM seen_flags")(
    lambda f: f.observed_flags.select(*KEY, "run_id", "flag_type", "flag_severity", "flag_details"))


# --- constraints ----------------------------------------------------------------------------------
# The observation log is where constraints of the review table do break.
register("expect_unique", """
    SELECT 'observations' AS table_name, 'unique' AS rule, 'source_app_id,storefront,source_review_id' AS subject,
        concat_ws('|', source_app_id, storefront, source_review_id) AS violating_key, count(*) AS n
    FROM obs WHERE source_review_id IS NOT NULL GROUP BY source_app_id, storefront, source_review_id HAVING count(*) > 1""")(
    lambda f: expect(
        unique_rule(f.log, "observations", KEY),
        unique_rule(f.reviews, "reviews", fold.REVIEW_KEY),
        unique_rule(f.review_flags, "review_quality_flags", ["review_id", "flag_type"]),
        unique_rule(f.reviewers, "reviewers", ["source_platform", "author_fingerprint"]),
        unique_rule(f.dims["verticals"], "verticals", ["vertical_name"]),
        unique_rule(f.dims["apps"], "apps", ["source_platform", "source_app_id"]),
        unique_rule(f.dims["storefronts"], "app_storefronts", ["source_app_id", "storefront"]),
        unique_rule(f.stored_counters, "ingestion_run_app_stats", ["run_id", "source_app_id", "storefront"]),
        unique_rule(f.pages, "raw_feed_pages", PAGE_KEY)))

register("expect_foreign_key", """
    SELECT 'observations' AS table_name, 'foreign_key' AS rule, 'author_fingerprint' AS subject,
        author_fingerprint AS violating_key, count(*) AS n FROM obs
    WHERE author_fingerprint IS NOT NULL AND author_fingerprint NOT IN
        (SELECT author_fingerprint FROM good WHERE author_fingerprint IS NOT NULL) GROUP BY ALL
    UNION ALL SELECT 'observations', 'foreign_key', 'source_app_id,storefront,source_review_id',
        concat_ws('|', source_app_id, storefront, source_review_id), count(*) FROM obs o
    WHERE source_review_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.source_app_id = o.source_app_id
        AND r.storefront = o.storefront AND r.source_review_id = o.source_review_id)
    GROUP BY source_app_id, storefront, source_review_id""")(
    lambda f: expect(
        foreign_key_rule(f.log, "observations", ["author_fingerprint"], f.reviewers, ["author_fingerprint"]),
        foreign_key_rule(f.log, "observations", KEY, f.reviews, KEY),
        foreign_key_rule(f.dims["apps"], "apps", ["vertical_name"], f.dims["verticals"], ["vertical_name"]),
        foreign_key_rule(f.dims["storefronts"], "app_storefronts", ["source_app_id"], f.dims["apps"], ["source_app_id"]),
        foreign_key_rule(f.reviews, "reviews", ["source_app_id", "storefront"], f.dims["storefronts"],
                         ["source_app_id", "storefront"]),
        foreign_key_rule(f.reviews, "reviews", ["author_fingerprint"], f.reviewers, ["author_fingerprint"]),
        foreign_key_rule(f.review_flags, "review_quality_flags", ["review_id"], f.reviews, ["review_id"]),
        foreign_key_rule(f.rejected_log, "rejected_review_records", ["source_app_id", "storefront"],
                         f.dims["storefronts"], ["source_app_id", "storefront"])))

register("expect_check", """
    SELECT 'observations' AS table_name, 'check' AS rule, x.subject, concat_ws('|', raw_feed_page_id, entry_pos) AS violating_key,
        1::BIGINT AS n FROM obs, (VALUES ('rating'), ('body'), ('vote_count'), ('vote_sum'), ('page_number')) x(subject)
    WHERE (x.subject = 'rating' AND rating NOT BETWEEN 1 AND 5) OR (x.subject = 'body' AND length(trim(body)) = 0)
        OR (x.subject = 'vote_count' AND vote_count < 0) OR (x.subject = 'vote_sum' AND vote_sum < 0)""")(
    lambda f: expect(
        check_rule(f.validated, "observations", {
            "rating": F.col("rating").between(1, 5), "body": F.length(F.trim("body")) > 0,
            "body_char_count": F.col("body_char_count") >= 0, "body_token_estimate": F.col("body_token_estimate") >= 0,
            "vote_count": F.col("vote_count") >= 0, "vote_sum": F.col("vote_sum") >= 0,
            "page_number": F.col("page_number") >= 1},
            F.concat_ws("|", "raw_feed_page_id", "entry_pos")),
        check_rule(f.pages, "raw_feed_pages", {
            "page_number": F.col("page_number") >= 1,
            "parse_status": F.col("parse_status").isin("pending", "parsed", "parse_error", "skipped")},
            F.concat_ws("/", *PAGE_KEY)),
        check_rule(f.review_flags, "review_quality_flags",
                   {"flag_severity": F.col("flag_severity").isin("info", "warning", "error")}, F.col("review_id")),
        check_rule(f.dims["storefronts"], "app_storefronts",
                   {"max_pages_per_run": F.col("max_pages_per_run").between(1, 10)}, F.col("source_app_id"))))

_REQUIRED = ("source_review_id", "rating", "published_at", "title", "author_fingerprint", "body", "storefront")
register("expect_not_null", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'observations' AS table_name, 'not_null' AS rule, '{c}' AS subject, '' AS violating_key, "
    f"count(*) FILTER ({c} IS NULL) AS n FROM obs" for c in _REQUIRED) + ") WHERE n > 0")(
    lambda f: expect(
        not_null_rule(f.validated, "observations", list(_REQUIRED)),
        not_null_rule(f.reviews, "reviews", ["source_review_id", "rating", "body", "source_endpoint", "published_at",
                                             "first_raw_feed_page_id", "last_raw_feed_page_id", "first_seen_run_id",
                                             "last_seen_run_id", "first_seen_at", "last_seen_at"])))


# --- constraints of the run tables, on copies with one kind of damage per app or storefront ---------------
_COUNT_CHECKS = list(accounting.COUNTERS)


def _damaged(f):
    app, store = F.col("source_app_id"), F.col("storefront")
    pages = f.pages.withColumns({
        "run_id": F.when(app == "app-1", F.col("run_id") + 90).otherwise(F.col("run_id")),
        "parse_status": F.when(app == "app-2", "odd").otherwise(F.col("parse_status")),
        "fetched_at": F.when(app != "app-3", F.col("fetched_at"))})
    feeds = f.stored_counters.withColumns({
        "run_id": F.when(app == "app-1", F.col("run_id") + 90).otherwise(F.col("run_id")),
        "run_status": F.when(app == "app-4", "odd").otherwise(F.col("run_status")),
        "reviews_parsed": F.when(app == "app-5", -1 - F.col("reviews_parsed")).otherwise(F.col("reviews_parsed"))})
    runs = f.runs.withColumns({
        "run_status": F.when(F.col("run_id") == 3, "odd").otherwise(F.col("run_status")),
        "started_at": F.when(F.col("run_id") != 2, F.col("started_at")),
        "pages_fetched": F.when(F.col("run_id") == 3, -1 - F.col("pages_fetched")).otherwise(F.col("pages_fetched"))})
    rejects = f.rejected_log.withColumns({
        "raw_feed_page_id": F.when(store == "de", F.concat(F.lit("x/"), "raw_feed_page_id")).otherwise(F.col("raw_feed_page_id")),
        "rejection_reason": F.when(store != "fr", F.col("rejection_reason"))})
    reviews = f.reviews.withColumns({
        "last_seen_run_id": F.when(store == "es", F.col("last_seen_run_id") + 90).otherwise(F.col("last_seen_run_id")),
        "first_raw_feed_page_id": F.when(store == "es", F.concat(F.lit("x/"), "first_raw_feed_page_id"))
        .otherwise(F.col("first_raw_feed_page_id"))})
    flags = f.review_flags.withColumn("flag_details", F.when(F.col("flag_severity") != "warning", F.col("flag_details")))
    return pages, feeds, runs, rejects, reviews, flags


def _run_tables(f):
    pages, feeds, runs, rejects, reviews, flags = _damaged(f)
    known = f.pages.select(F.concat_ws("/", *PAGE_KEY).alias("page"))
    status = F.col("run_status").isin("running", "completed", "completed_with_errors", "failed")
    counters = {c: F.col(c) >= 0 for c in _COUNT_CHECKS}
    return expect(
        foreign_key_rule(pages, "raw_feed_pages", ["run_id"], f.runs, ["run_id"]),
        foreign_key_rule(pages, "raw_feed_pages", ["source_app_id", "storefront"], f.dims["storefronts"], ["source_app_id", "storefront"]),
        foreign_key_rule(feeds, "ingestion_run_app_stats", ["run_id"], f.runs, ["run_id"]),
        foreign_key_rule(rejects, "rejected_review_records", ["run_id"], f.runs, ["run_id"]),
        foreign_key_rule(rejects, "rejected_review_records", ["raw_feed_page_id"], known, ["page"]),
        *[foreign_key_rule(reviews, "reviews", [c], f.runs, ["run_id"]) for c in ("first_seen_run_id", "last_seen_run_id")],
        *[foreign_key_rule(reviews, "reviews", [c], known, ["page"]) for c in ("first_raw_feed_page_id", "last_raw_feed_page_id")],
        check_rule(pages, "raw_feed_pages", {
            "parse_status": F.col("parse_status").isin("pending", "parsed", "parse_error", "skipped"),
            "page_number": F.col("page_number") >= 1}, F.concat_ws("/", *PAGE_KEY)),
        check_rule(feeds, "ingestion_run_app_stats", {"run_status": status, **counters}, F.concat_ws("/", "run_id", "source_app_id", "storefront")),
        check_rule(runs, "ingestion_runs", {"run_status": status, **counters}, F.col("run_id")),
        not_null_rule(pages, "raw_feed_pages", [*PAGE_KEY, "fetched_at", "parse_status"]),
        not_null_rule(runs, "ingestion_runs", ["run_id", "run_status", "started_at"]),
        not_null_rule(rejects, "rejected_review_records", ["run_id", "source_app_id", "rejection_reason"]),
        not_null_rule(flags, "review_quality_flags", ["review_id", "flag_type", "flag_severity", "flag_details"]),
        not_null_rule(f.dims["apps"], "apps", ["source_app_id", "app_name", "vertical_name"]),
        not_null_rule(f.dims["storefronts"], "app_storefronts", ["source_app_id", "storefront"]))


_FK, _CK, _NN = "'foreign_key' AS rule", "'check' AS rule", "'not_null' AS rule"
register("expect_run_tables", f"""
    SELECT 'raw_feed_pages' AS table_name, {_FK}, 'run_id' AS subject, (run_id + 90)::VARCHAR AS violating_key, count(*) AS n
        FROM pages_done WHERE source_app_id = 'app-1' GROUP BY run_id
    UNION ALL SELECT 'ingestion_run_app_stats', {_FK}, 'run_id', (run_id + 90)::VARCHAR, count(*) FROM counters
        WHERE source_app_id = 'app-1' GROUP BY run_id
    UNION ALL SELECT 'rejected_review_records', {_FK}, 'raw_feed_page_id', 'x/'||raw_feed_page_id, count(*) FROM marked
        WHERE NOT valid AND failed_pos IS NULL AND storefront = 'de' GROUP BY raw_feed_page_id
    UNION ALL SELECT 'reviews', {_FK}, 'last_seen_run_id', (last_seen_run_id + 90)::VARCHAR, count(*) FROM reviews
        WHERE storefront = 'es' GROUP BY last_seen_run_id
    UNION ALL SELECT 'reviews', {_FK}, 'first_raw_feed_page_id', 'x/'||first_raw_feed_page_id, count(*) FROM reviews
        WHERE storefront = 'es' GROUP BY first_raw_feed_page_id
    UNION ALL SELECT 'raw_feed_pages', {_CK}, 'parse_status', concat_ws('/', run_id, source_app_id, storefront, page_number), 1
        FROM pages_done WHERE source_app_id = 'app-2'
    UNION ALL SELECT 'ingestion_run_app_stats', {_CK}, 'run_status', concat_ws('/', run_id, source_app_id, storefront), 1
        FROM counters WHERE source_app_id = 'app-4'
    UNION ALL SELECT 'ingestion_run_app_stats', {_CK}, 'reviews_parsed', concat_ws('/', run_id, source_app_id, storefront), 1
        FROM counters WHERE source_app_id = 'app-5'
    UNION ALL SELECT 'ingestion_runs', {_CK}, s, run_id::VARCHAR, 1 FROM runs, (VALUES ('run_status'), ('pages_fetched')) v(s) WHERE run_id = 3
    UNION ALL SELECT * FROM (SELECT 'raw_feed_pages', {_NN}, 'fetched_at', '', count(*) AS n FROM pages_done WHERE source_app_id = 'app-3') WHERE n > 0
    UNION ALL SELECT * FROM (SELECT 'ingestion_runs', {_NN}, 'started_at', '', count(*) AS n FROM runs WHERE run_id = 2) WHERE n > 0
    UNION ALL SELECT * FROM (SELECT 'rejected_review_records', {_NN}, 'rejection_reason', '', count(*) AS n FROM marked
        WHERE NOT valid AND failed_pos IS NULL AND storefront = 'fr') WHERE n > 0
    UNION ALL SELECT * FROM (SELECT 'review_quality_flags', {_NN}, 'flag_details', '', count(*) AS n FROM flags
        WHERE flag_severity = 'warning') WHERE n > 0""")(_run_tables)

# Limits a manifest may set, checked for what every feed of every run would have needed.
register("settings_bounds", """SELECT 'settings' AS table_name, 'check' AS rule, s AS subject,
    concat_ws('/', run_id, source_app_id, storefront) AS violating_key, 1::BIGINT AS n
    FROM counters, (VALUES ('max_pages_per_app'), ('timeout_seconds'), ('retry_count'), ('delay_seconds')) v(s)
    WHERE CASE s WHEN 'max_pages_per_app' THEN pages_fetched NOT BETWEEN 1 AND 10 WHEN 'timeout_seconds' THEN reviews_parsed <= 0
        WHEN 'retry_count' THEN failed_requests < 1 ELSE reviews_inserted < reviews_updated END""")(
    lambda f: check_rule(f.stored_counters.select(
        F.concat_ws("/", "run_id", "source_app_id", "storefront").alias("feed"), F.col("pages_fetched").alias("max_pages_per_app"),
        F.col("reviews_parsed").cast("double").alias("timeout_seconds"), F.col("failed_requests").alias("retry_count"),
        (F.col("reviews_inserted") - F.col("reviews_updated")).cast("double").alias("delay_seconds")),
        "settings", co.settings_rules(), F.col("feed")))
