"""Run accounting, the training view, health reports and the repeated-run report."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedfold.operators import accounting, comparison, health, reports
from feedfold.plans.catalog import register
from feedfold.plans.oracle import iso
from feedfold.sources import exports

_COUNTS = ", ".join(accounting.COUNTERS)

# --- accounting ---------------------------------------------------------------------------------
register("run_stats", f"SELECT run_id, apps_attempted, {_COUNTS}, run_status FROM runs")(
    lambda f: accounting.run_counters(f.feed_counters))

register("run_app_stats", f"SELECT run_id, source_app_id, storefront, {_COUNTS}, run_status FROM counters")(
    lambda f: f.feed_counters)

_FEED_RUN = "run_id, source_app_id, storefront"
_FEED_MAP = "'{'||string_agg('\"'||flag_type||'\":'||n, ',' ORDER BY flag_type)||'}'"
register("run_app_details", f"""SELECT c.{_FEED_RUN.replace(', ', ', c.')}, pages_fetched + failed_requests AS pages_requested,
    {iso('done')} AS completed_at, COALESCE(flag_counts, '{{}}') AS flag_counts FROM counters c
    LEFT JOIN (SELECT {_FEED_RUN}, max(fetched_at) AS done FROM pages_flat GROUP BY ALL) USING ({_FEED_RUN})
    LEFT JOIN (SELECT {_FEED_RUN}, {_FEED_MAP} AS flag_counts FROM (SELECT {_FEED_RUN}, flag_type, count(*) AS n FROM seen_flags
        GROUP BY ALL) GROUP BY ALL) USING ({_FEED_RUN})""")(
    lambda f: accounting.feed_details(f.requests, f.fetch_log, f.pages, f.observed_flags))

register("flag_counts_by_run", """SELECT run_id, flag_type, count(*) AS observed_count,
    (SELECT count(*) FROM flags c WHERE c.created_run_id = s.run_id AND c.flag_type = s.flag_type) AS created_count
    FROM seen_flags s GROUP BY run_id, flag_type""")(lambda f: accounting.flag_counts(f.observed_flags, f.review_flags))

register("run_status_failed", """SELECT run_id, count(*) FILTER (run_status = 'completed_with_errors') AS feeds_with_errors,
    CASE WHEN run_id IN (SELECT run_id FROM pages_done WHERE parse_error = 'constraint failed') THEN 'failed'
        ELSE max(run_status) END AS run_status FROM counters GROUP BY run_id""")(
    lambda f: accounting.run_status(f.stored_counters, f.pages.filter("parse_error = 'constraint failed'")))

register("run_status", """SELECT run_id, count(*) FILTER (run_status = 'completed_with_errors') AS feeds_with_errors,
    max(run_status) AS run_status FROM counters GROUP BY run_id""")(lambda f: accounting.run_status(f.stored_counters))

register("error_summary", """WITH e AS (SELECT run_id, source_app_id, storefront, 9999999 AS page_number, 'request' AS error_class,
        error AS message FROM failures
    UNION ALL SELECT run_id, source_app_id, storefront, page_number, 'page', 'page '||page_number||': '||parse_error
        FROM pages_done WHERE parse_status = 'parse_error')
    SELECT run_id, source_app_id, storefront, error_class, count(*) AS error_count, min(page_number) AS first_page,
        arg_min(message, page_number) AS first_message FROM e GROUP BY ALL""".replace("WITH e AS (", "SELECT * FROM (WITH e AS (") + ")")(
    lambda f: accounting.error_summary(accounting.page_errors(f.pages, f.fetch_log)))

_ERROR_ROWS = """SELECT run_id, source_app_id, storefront, 9999999 AS page_number, 'request' AS error_class, error AS message
    FROM failures UNION ALL SELECT run_id, source_app_id, storefront, page_number, 'page', 'page '||page_number||': '||parse_error
    FROM pages_done WHERE parse_status = 'parse_error'"""
register("error_rows", _ERROR_ROWS)(lambda f: accounting.page_errors(f.pages, f.fetch_log))

# --- training view and exports --------------------------------------------------------------------
_VIEW = ", ".join(c if c not in ("published_at", "first_seen_at", "last_seen_at", "source_app_id") else
                  ("source_app_id" if c == "source_app_id" else f"{iso(c)} AS {c}") for c in exports.TRAINING_COLUMNS)
register("training_view", f"SELECT {_VIEW} FROM view")(lambda f: f.training_view)
_PLACED = f"""SELECT review_id, row_number() OVER (ORDER BY published_at DESC, review_id) AS place, {iso('published_at')} AS published_at, body
    FROM view WHERE detected_language = 'en' AND has_error_flag = 0"""


def _ordered_csv(f):
    """The training CSV read back: every row with its place over all part files."""
    path = f.once("training-csv", lambda path: exports.write_ordered_csv(exports.training_export(f.training_view, english_only=True), path))
    rows = exports.read_ordered_csv(f.spark, path, list(exports.TRAINING_COLUMNS))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(
        F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))  # a row per part file
    return rows.join(F.broadcast(before), "part").select(
        "review_id", (F.col("before") + F.col("line") + 1).alias("place"), "published_at", "body")


register("training_csv", _PLACED)(_ordered_csv)
register("training_export", f"SELECT {_VIEW} FROM view WHERE detected_language = 'en' AND has_error_flag = 0")(
    lambda f: exports.training_export(f.training_view, english_only=True))

# No rule of this library yields severity error, so one is raised here for part of the reviews.
_ERRONEOUS = "(v.rating = 1 AND v.body_char_count % 2 = 0)"


def _with_errors(f):
    raised = f.reviews.filter("rating = 1 AND body_char_count % 2 = 0").select("review_id", F.lit("error").alias("flag_severity"))
    return health.training_view(f.reviews, f.review_flags.select("review_id", "flag_severity").unionByName(raised), f.dims)


register("training_view_errors", f"SELECT * REPLACE ({_ERRONEOUS}::INTEGER AS has_error_flag) FROM (SELECT {_VIEW} FROM view) v")(_with_errors)
register("training_export_errors", f"SELECT {_VIEW} FROM view v WHERE detected_language = 'en' AND NOT {_ERRONEOUS}")(
    lambda f: exports.training_export(_with_errors(f), english_only=True))
register("clean_export_count_errors", f"""SELECT count(*) FILTER (detected_language = 'en' AND NOT {_ERRONEOUS})
    AS english_without_error_rows FROM view v""")(lambda f: comparison.clean_export_count(_with_errors(f)))

# --- health -------------------------------------------------------------------------------------
register("latest_runs", f"""SELECT run_id, run_status, {iso('started_at')} AS started_at, {iso('completed_at')} AS completed_at,
    apps_attempted, pages_fetched, reviews_parsed, reviews_inserted, reviews_updated, reviews_rejected
    FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 20""")(lambda f: health.latest_runs(f.runs))

register("app_outcomes", f"""SELECT c.run_id, c.storefront, app_name, vertical_name, run_status, {_COUNTS}
    FROM counters c JOIN feeds USING (source_app_id, storefront)""")(
    lambda f: f.with_names(f.stored_counters).select(
        "run_id", "storefront", "app_name", "vertical_name", "run_status", *accounting.COUNTERS))

register("parse_status_counts", "SELECT parse_status, count(*) AS page_count FROM pages_done GROUP BY ALL")(
    lambda f: health.count_by(f.pages, "parse_status", name="page_count"))

register("rejects_by_reason", """SELECT reasons[1] AS rejection_reason, count(*) AS rejected_count FROM marked
    WHERE NOT valid AND failed_pos IS NULL GROUP BY ALL""")(
    lambda f: health.count_by(f.rejected_log, "rejection_reason", name="rejected_count"))

register("reviews_by_vertical_app", f"""SELECT vertical_name, app_name, storefront, count(*) AS review_count,
    {iso('min(published_at)')} AS earliest_review_at, {iso('max(published_at)')} AS latest_review_at FROM view GROUP BY ALL""")(
    lambda f: health.reviews_by_vertical_app(f.training_view))

register("rating_distribution", "SELECT rating, count(*) AS review_count FROM reviews GROUP BY ALL")(
    lambda f: health.count_by(f.narrow_reviews("rating"), "rating", name="review_count"))

register("language_distribution", """SELECT COALESCE(detected_language, 'unknown') AS detected_language, count(*) AS review_count
    FROM reviews GROUP BY ALL""")(lambda f: health.language_distribution(f.narrow_reviews("detected_language")))

register("flags_by_type", "SELECT flag_type, flag_severity, count(*) AS flag_count FROM flags GROUP BY ALL")(
    lambda f: health.count_by(f.flags, "flag_type", "flag_severity", name="flag_count"))

register("missing_reviewer", """SELECT count(*) FILTER (author_fingerprint IS NULL) AS reviews_without_reviewer FROM reviews""")(
    lambda f: health.missing_reviewer(f.narrow_reviews("author_fingerprint")))

register("duplicate_bodies", """SELECT source_app_id, storefront, body, duplicate_count FROM (SELECT source_app_id, storefront, body,
    sha256(body) AS digest, count(*) AS duplicate_count FROM reviews GROUP BY ALL HAVING count(*) > 1)
    ORDER BY duplicate_count DESC, source_app_id, storefront, digest LIMIT 50""")(
    lambda f: health.duplicate_bodies(f.reviews))

_SAMPLE = ["review_id", "source_review_id", "app_name", "vertical_name", "storefront", "rating", "title", "body",
           "published_at", "detected_language"]
_SAMPLE_SQL = ", ".join(c if c != "published_at" else f"{iso(c)} AS {c}" for c in _SAMPLE)


def _newest(name: str, columns: str, where: str, n: int, order: str = "v.published_at DESC, review_id") -> str:
    return f"SELECT {columns} FROM view v {where} ORDER BY {order} LIMIT {n}"


register("training_sample", _newest("training_sample", _SAMPLE_SQL,
                                    "WHERE detected_language = 'en' AND has_error_flag = 0", 100))(
    lambda f: health.latest(health.clean(f.training_view), 100, *_SAMPLE))

register("table_counts", """SELECT 'apps' AS table_name, count(DISTINCT source_app_id) AS row_count FROM feeds
    UNION ALL SELECT 'storefronts', count(*) FROM feeds UNION ALL SELECT 'ingestion_runs', count(*) FROM runs
    UNION ALL SELECT 'raw_pages', count(*) FROM pages_flat UNION ALL SELECT 'valid_reviews', count(*) FROM reviews
    UNION ALL SELECT 'rejected_records', count(*) FROM marked WHERE NOT valid AND failed_pos IS NULL
    UNION ALL SELECT 'quality_flags', count(*) FROM flags""")(
    lambda f: health.table_counts({
        "apps": f.dims["apps"], "storefronts": f.dims["storefronts"], "ingestion_runs": f.runs, "raw_pages": f.pages,
        "valid_reviews": f.reviews, "rejected_records": f.rejected_log, "quality_flags": f.review_flags}))

register("reviews_by_app_left", """SELECT a.source_app_id, a.app_name, a.vertical_name, count(r.review_id) AS review_count
    FROM (SELECT DISTINCT source_app_id, app_name, vertical_name FROM feeds) a LEFT JOIN reviews r
    ON r.source_app_id = a.source_app_id AND r.rating <= 2 GROUP BY ALL""")(
    lambda f: health.reviews_by_app(f.dims["apps"], f.narrow_reviews("rating").filter("rating <= 2")))

register("latest_run_outcomes", f"""SELECT run_id, source_app_id, storefront, {_COUNTS}, run_status FROM counters
    WHERE run_id = (SELECT max(run_id) FROM counters)""")(lambda f: health.latest_run_outcomes(f.stored_counters))

register("review_sample", _newest("review_sample", f"""app_name, rating, title, left(body, 140) AS body_excerpt,
    {iso('published_at')} AS published_at""", "", 5))(lambda f: health.review_sample(f.training_view))

register("recent_training", f"""SELECT review_id, app_name, rating, {iso('published_at')} AS published_at FROM view
    WHERE detected_language = 'en' AND has_error_flag = 0""")(
    lambda f: health.clean(f.training_view).select("review_id", "app_name", "rating", "published_at"))

register("rating_by_vertical", """SELECT vertical_name, rating, count(*) AS review_count FROM view
    WHERE detected_language = 'en' GROUP BY ALL""")(
    lambda f: health.count_by(f.training_view.filter("detected_language = 'en'"), "vertical_name", "rating",
                              name="review_count"))

register("recent_negatives", _newest("recent_negatives", f"""review_id, app_name, rating, title, body,
    {iso('published_at')} AS published_at""", "WHERE rating <= 2 AND detected_language = 'en'", 100))(
    lambda f: health.latest(f.training_view.filter("rating <= 2 AND detected_language = 'en'"), 100,
                            "review_id", "app_name", "rating", "title", "body", "published_at"))

# --- repeated-run report --------------------------------------------------------------------------
_STORED = """stored AS (SELECT run_id, source_app_id, storefront, count(*) AS stored_pages,
    sum(CASE WHEN page_is_json THEN id_count ELSE 0 END)::BIGINT AS stored_entries,
    count(*) FILTER (NOT page_is_json) AS unreadable_pages FROM page_parts GROUP BY run_id, source_app_id, storefront)"""
register("run_summary", f"""SELECT c.run_id, c.source_app_id, c.storefront, {', '.join('c.' + x for x in accounting.COUNTERS)},
    c.run_status, COALESCE(stored_pages, 0) AS stored_pages, COALESCE(stored_entries, 0) AS stored_entries,
    COALESCE(unreadable_pages, 0) AS unreadable_pages, {', '.join(f'r.{x} AS run_{x}' for x in accounting.COUNTERS)},
    r.run_status AS overall_status FROM counters c JOIN runs r USING (run_id) LEFT JOIN stored USING (run_id, source_app_id, storefront)""",
         {"stored": _STORED[len("stored AS ("):-1]})(
    lambda f: comparison.run_summary(f.runs, f.stored_counters, comparison.raw_observations(f.raw_pages)))

register("run_pages", """SELECT run_id, source_app_id, storefront, page_number, sha256(response_body) AS response_hash,
    CASE WHEN page_is_json THEN id_count ELSE 0 END AS entry_count, parse_status,
    CASE WHEN NOT page_is_json THEN 'invalid JSON' ELSE parse_error END AS parse_error
    FROM page_body JOIN (SELECT run_id, source_app_id, storefront, page_number, parse_status, parse_error FROM pages_done)
    USING (run_id, source_app_id, storefront, page_number)""")(
    lambda f: comparison.run_pages(comparison.raw_observations(f.raw_pages), f.pages))

register("dataset_quality", """SELECT count(*) AS total_reviews, count(DISTINCT review_id) AS unique_source_keys,
    count(*) FILTER (source_review_id IS NULL OR rating IS NULL OR body IS NULL OR length(trim(body)) = 0
        OR published_at IS NULL) AS invalid_required, count(DISTINCT source_app_id) AS apps_represented FROM reviews""")(
    lambda f: comparison.dataset_quality(f.reviews))

register("clean_export_count", """SELECT count(*) FILTER (detected_language = 'en' AND has_error_flag = 0)
    AS english_without_error_rows FROM view""")(lambda f: comparison.clean_export_count(f.training_view))

register("verticals_represented", "SELECT count(DISTINCT vertical_name) AS verticals_represented FROM view")(
    lambda f: comparison.verticals_represented(f.training_view))

register("flags_over_runs", "SELECT flag_type, count(*) AS observed_count FROM seen_flags GROUP BY ALL")(
    lambda f: comparison.flags_over_runs(accounting.flag_count_map(accounting.flag_counts(f.observed_flags, f.review_flags))))

register("duplicate_behavior", """SELECT (SELECT count(*) FROM reviews) AS canonical_reviews,
    (SELECT count(DISTINCT review_id) FROM reviews) AS unique_source_keys,
    (SELECT count(*) FROM placed WHERE place > 1) AS repeated_observation_updates""")(
    lambda f: comparison.duplicate_behavior(f.reviews, f.runs))

_GATES = """q AS (SELECT count(*) AS total, count(DISTINCT review_id) AS keys, count(DISTINCT source_app_id) AS apps,
    count(DISTINCT vertical_name) AS verticals FROM view)"""
_GATE_ROWS = """SELECT 'all_configured_apps_represented' AS gate, apps >= (SELECT max(apps_attempted) FROM runs) AS passed FROM q
    UNION ALL SELECT 'at_least_six_verticals', verticals >= 6 FROM q
    UNION ALL SELECT 'at_least_1000_unique_reviews', keys >= 1000 FROM q
    UNION ALL SELECT 'no_duplicate_source_keys', keys = total FROM q
    UNION ALL SELECT 'no_invalid_required_fields', (SELECT count(*) FROM view WHERE source_review_id IS NULL
        OR rating IS NULL OR body IS NULL OR length(trim(body)) = 0 OR published_at IS NULL) = 0 FROM q
    UNION ALL SELECT 'final_run_has_no_app_or_request_failures', (SELECT run_status = 'completed' AND failed_requests = 0
        FROM runs ORDER BY run_id DESC LIMIT 1) FROM q"""
register("acceptance_gates", "SELECT * FROM gates UNION ALL SELECT 'ready_for_ds', bool_and(passed) FROM gates",
         {"q": _GATES[len("q AS ("):-1], "gates": _GATE_ROWS})(
    lambda f: comparison.acceptance_gates(f.training_view, f.runs))

_REPORT = """'{"apps_attempted":'||apps_attempted||',"failed_requests":'||failed_requests||',"flags_created":'||flags_created||
    ',"pages_fetched":'||pages_fetched||',"reviews_inserted":'||reviews_inserted||',"reviews_parsed":'||reviews_parsed||
    ',"reviews_rejected":'||reviews_rejected||',"reviews_updated":'||reviews_updated||',"run_id":'||run_id||
    ',"run_status":"'||run_status||'"}'"""
register("run_report_json", f"SELECT run_id, {_REPORT} AS report FROM runs")(
    lambda f: exports.json_report(f.runs.drop("started_at", "completed_at"), "run_id"))

_STATS = ", ".join(f"{c} := {{0}}{c}" for c in sorted(accounting.COUNTERS))
_PAGED = f"""SELECT run_id, source_app_id, storefront, list(struct_pack(entry_count := entry_count, page_number := page_number,
    parse_error := parse_error, parse_status := parse_status, response_hash := response_hash) ORDER BY page_number, response_hash) AS items
    FROM (SELECT p.run_id, p.source_app_id, p.storefront, p.page_number, sha256(response_body) AS response_hash,
        CASE WHEN page_is_json THEN id_count ELSE 0 END AS entry_count, parse_status,
        CASE WHEN NOT page_is_json THEN 'invalid JSON' ELSE parse_error END AS parse_error
        FROM page_body p JOIN (SELECT run_id, source_app_id, storefront, page_number, parse_status, parse_error FROM pages_done) d
        USING (run_id, source_app_id, storefront, page_number)) GROUP BY ALL"""
_FEEDS = f"""SELECT run_id, list(struct_pack(pages := COALESCE(items, [])[1:{reports.MOST_PAGES}],
    pages_left_out := greatest(len(COALESCE(items, [])) - {reports.MOST_PAGES}, 0), run_status := c.run_status, source_app_id := source_app_id,
    stats := struct_pack({_STATS.format('c.')}), storefront := storefront) ORDER BY source_app_id, storefront) AS items
    FROM counters c LEFT JOIN paged USING (run_id, source_app_id, storefront) GROUP BY run_id"""
register("run_documents", f"""SELECT run_id, to_json(struct_pack(feeds := items[1:{reports.MOST_FEEDS}],
    feeds_left_out := greatest(len(items) - {reports.MOST_FEEDS}, 0), run_id := run_id,
    stats := struct_pack(apps_attempted := apps_attempted, {_STATS.format('r.')}), status := r.run_status))::VARCHAR AS report
    FROM runs r LEFT JOIN listed USING (run_id)""", {"paged": _PAGED, "listed": _FEEDS})(
    lambda f: reports.run_documents(f.runs, f.stored_counters, comparison.run_pages(comparison.raw_observations(f.raw_pages), f.pages)))

_CHANGED = """SELECT count(*) AS n, count(*) FILTER (h > 1) AS hashes, count(*) FILTER (w > 1) AS windows FROM (
    SELECT count(DISTINCT sha256(response_body)) AS h, count(DISTINCT CASE WHEN page_is_json THEN COALESCE(ids, '') ELSE '' END) AS w
    FROM page_body GROUP BY source_app_id, storefront, page_number) WHERE h > 1 OR w > 1"""
_INVALID = "source_review_id IS NULL OR rating IS NULL OR body IS NULL OR length(trim(body)) = 0 OR published_at IS NULL"
_FACTS = f"""SELECT (SELECT '{{'||string_agg('"'||gate||'":'||passed::VARCHAR, ',' ORDER BY gate)||'}}' FROM gates) AS gates,
    (SELECT to_json(struct_pack(canonical_reviews := count(*), repeated_observation_updates := (SELECT count(*) FROM placed WHERE place > 1),
        unique_source_keys := count(DISTINCT review_id)))::VARCHAR FROM reviews) AS duplicates,
    (SELECT to_json(struct_pack(apps_represented := count(DISTINCT source_app_id),
        english_without_error_rows := (SELECT count(*) FROM view WHERE detected_language = 'en' AND has_error_flag = 0),
        invalid_required := count(*) FILTER ({_INVALID}), total_reviews := count(*), unique_source_keys := count(DISTINCT review_id),
        verticals_represented := (SELECT count(DISTINCT vertical_name) FROM view)))::VARCHAR FROM reviews) AS export,
    (SELECT '{{'||COALESCE(string_agg('"'||flag_type||'":'||n, ',' ORDER BY flag_type), '')||'}}' FROM (
        SELECT flag_type, count(*) AS n FROM seen_flags GROUP BY ALL)) AS flags, (SELECT bool_and(passed) FROM gates)::VARCHAR AS ready,
    (SELECT to_json(list(struct_pack(failed_requests := failed_requests, reviews_inserted := reviews_inserted, run_id := run_id,
        run_status := run_status) ORDER BY run_id DESC)[1:{reports.MOST_RUNS}])::VARCHAR FROM runs) AS latest,
    (SELECT greatest(count(*) - {reports.MOST_RUNS}, 0) FROM runs) AS more,
    (SELECT to_json(struct_pack(changed_pages := n, hash_changed := hashes, window_changed := windows))::VARCHAR FROM changed) AS changes"""
register("validation_document", """SELECT '{"acceptance_gates":'||gates||',"duplicate_behavior":'||duplicates||',"export":'||export||
    ',"quality_flags_by_type":'||flags||',"ready_for_ds":'||ready||',"runs":'||latest||',"runs_left_out":'||more||
    ',"window_changes":'||changes||'}' AS report FROM facts""",
         {"q": _GATES[len("q AS ("):-1], "gates": _GATE_ROWS, "changed": _CHANGED, "facts": _FACTS})(
    lambda f: reports.validation_document(
        f.reviews, f.training_view, f.runs, accounting.flag_count_map(accounting.flag_counts(f.observed_flags, f.review_flags)),
        comparison.window_changes(comparison.raw_observations(f.raw_pages))))
