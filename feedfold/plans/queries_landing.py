"""Sources, parsing, scalar normalisation and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedfold.functions import json_text
from feedfold.functions import text as tx
from feedfold.operators import accounting, audit_sample, comparison, entries, normalise
from feedfold.plans.catalog import register
from feedfold.plans.oracle import iso, terms
from feedfold.sources import cohort as co
from feedfold.sources import landing, lexicon, pages

PAGE = pages.PAGE_KEY
_PAGE = ", ".join(PAGE)
_ID = f"{_PAGE}, entry_pos"


# --- sources ------------------------------------------------------------------------------------
register("cohort_manifest", """SELECT source_app_id AS app_id, app_name, vertical_name AS vertical, storefront,
    storefront AS expected_language, NOT (app_no = 9 AND storefront = 'es') AS enabled, 'from documents' AS notes FROM feeds""")(
    lambda f: f.cohort)

register("cohort_filter", """SELECT source_app_id AS app_id, app_name, vertical_name AS vertical, storefront FROM feeds
    WHERE NOT (app_no = 9 AND storefront = 'es') AND app_no IN (1, 4, 9) AND storefront = 'es'""")(
    lambda f: co.cohort_filter(f.cohort, ["app-1", "app-4", "app-9"], "ES").select(
        "app_id", "app_name", "vertical", "storefront"))

register("raw_page_source", """SELECT source_app_id, storefront, page_number,
    strftime(fetched_at, '%Y%m%dT%H%M%S%fZ') AS fetch_stamp, length(response_body) AS body_length FROM page_body""")(
    lambda f: pages.read_page_files(f.spark, f.page_files, newline=True).drop("raw_file_path").withColumn(
        "body_length", F.length("response_body").cast("bigint")).drop("response_body"))

register("landed_page_rows", f"""SELECT {_PAGE}, app_order, {iso('fetched_at')} AS fetched_at, 'app_store' AS source_platform, source_endpoint,
    sha256(response_body) AS response_hash FROM page_body""")(
    lambda f: landing.landed_pages(pages.read_page_files(f.spark, f.page_files, newline=True), f.feed_orders).select(
        *PAGE, "app_order", "fetched_at", "source_platform", "source_endpoint", pages.page_hash().alias("response_hash")))

register("page_hash", f"SELECT {_PAGE}, sha256(response_body) AS response_hash FROM page_body")(
    lambda f: f.raw_pages.select(*PAGE, pages.page_hash().alias("response_hash")))

_RAW = ", ".join(landing._RAW_COLUMNS)
register("entry_extract", f"SELECT {_PAGE}, {_RAW} FROM entry WHERE page_is_json")(
    lambda f: entries.extract_entries(f.raw_pages).select(*PAGE, *landing._RAW_COLUMNS))

register("entry_fallback", f"""SELECT {_PAGE}, parser_fallback_used, entry_count + CASE WHEN parser_fallback_used THEN 0 ELSE 2 END
    AS element_count FROM page_parts WHERE page_is_json""")(
    lambda f: entries.with_document(f.raw_pages).filter(F.col("document").isNotNull()).select(
        *PAGE, entries.is_single_object(F.col("document")).alias("parser_fallback_used"),
        F.size(entries.entry_list(F.col("document"))).cast("bigint").alias("element_count")))

register("entry_filter", f"""SELECT {_PAGE}, entry_count AS review_elements,
    CASE WHEN parser_fallback_used THEN 0 ELSE 2 END::BIGINT AS other_elements FROM page_parts WHERE page_is_json""")(
    lambda f: entries.explode_entries(f.raw_pages).groupBy(*PAGE).agg(
        F.count_if(entries.is_review(F.col("entry"))).alias("review_elements"),
        F.count_if(~entries.is_review(F.col("entry"))).alias("other_elements")))

register("label_unwrap", f"SELECT {_PAGE}, id_raw, title_raw, rating_raw, body_raw FROM entry WHERE page_is_json")(
    lambda f: entries.explode_entries(f.raw_pages).filter(entries.is_review(F.col("entry"))).select(
        *PAGE, *[entries.label_text(F.col("entry"), entries.LABELLED_FIELDS[c]).alias(c)
                 for c in ("id_raw", "title_raw", "rating_raw", "body_raw")]))

register("attr_extract", f"SELECT {_PAGE}, id_raw, review_url_raw FROM entry WHERE page_is_json")(
    lambda f: entries.explode_entries(f.raw_pages).filter(entries.is_review(F.col("entry"))).select(
        *PAGE, entries.label_text(F.col("entry"), "$.id").alias("id_raw"),
        entries.attribute_text(F.col("entry"), "link", "href").alias("review_url_raw")))

_NEXT = "(page_is_json AND NOT parser_fallback_used AND page_number % 3 <> 0)"
register("has_next_page", f"SELECT {_PAGE}, {_NEXT} AS has_next FROM page_parts")(
    lambda f: entries.page_facts(f.raw_pages).select(*PAGE, "has_next"))

register("page_truncation", f"""SELECT {_PAGE} FROM page_parts p WHERE NOT EXISTS (SELECT 1 FROM page_parts q
    WHERE (q.run_id, q.source_app_id, q.storefront) = (p.run_id, p.source_app_id, p.storefront)
    AND q.page_number < p.page_number AND NOT {_NEXT.replace('page_', 'q.page_')})""")(
    lambda f: pages.truncate_pagination(entries.page_facts(f.raw_pages).select(
        *PAGE, (F.col("has_next") & (F.col("entry_count") > 0) & F.col("is_json")).alias("continues"))).select(*PAGE))

register("fetch_failures", """SELECT run_id, source_app_id, storefront, count(*) AS failed_requests, min(error) AS first_error
    FROM failures GROUP BY ALL""")(lambda f: pages.fetch_failures(f.fetch_log))

register("lexicon_table", " UNION ALL ".join(
    f"""SELECT '{lexicon.LEXICON_VERSION}' AS version, '{s}' AS signal, '{t}' AS term, {i} AS position,
    count(*) FILTER ({terms('combined', [t])}) AS review_count FROM featured""" for s, listed in lexicon.ISSUE_TERMS.items()
    for i, t in enumerate(listed)))(
    lambda f: audit_sample.term_usage(f.features, lexicon.lexicon_table(f.spark), f.lexicon))

register("dry_run_summary", """SELECT (SELECT count(*) FROM requests) AS apps_attempted,
    (SELECT count(*) FROM page_parts) AS pages_fetched, (SELECT count(*) FROM entry WHERE page_is_json) AS reviews_parsed,
    (SELECT count(*) FROM failures) AS failed_requests""")(
    lambda f: accounting.dry_run_summary(entries.page_facts(f.raw_pages), f.fetch_log, f.requests))

# --- scalar normalisation -----------------------------------------------------------------------
register("clean_text", f"SELECT {_ID}, title AS title_clean, body AS body_clean FROM obs_text")(
    lambda f: f.entries.select(*PAGE, "entry_pos", tx.clean_text("title_raw", True).alias("title_clean"),
                               tx.clean_text("body_raw").alias("body_clean")))

register("safe_int", f"SELECT {_ID}, rating, vote_count, vote_sum FROM obs_text")(
    lambda f: f.entries.select(*PAGE, "entry_pos", tx.safe_int("rating_raw").alias("rating"),
                               tx.safe_int("vote_count_raw").alias("vote_count"),
                               tx.safe_int("vote_sum_raw").alias("vote_sum")))

register("normalize_timestamp", f"SELECT {_ID}, {iso('published_at')} AS published_at FROM obs_text")(
    lambda f: f.entries.select(*PAGE, "entry_pos", tx.parse_timestamp("published_raw").alias("published_at")))

register("detect_language", f"SELECT {_ID}, detected_language FROM obs")(
    lambda f: f.validated.select(*PAGE, "entry_pos", "detected_language"))

register("canonical_json", f"SELECT {_PAGE}, id_raw, raw_record FROM entry WHERE page_is_json")(
    lambda f: entries.extract_entries(f.raw_pages).select(
        *PAGE, "id_raw", json_text.canonical_json("raw_record").alias("raw_record")))

# Every line as a payload with floats from 1e-13 to 1e18, whole numbers beyond 64 bits, a repeated key and keys out of order.
register("canonical_numbers", """SELECT l_orderkey, l_linenumber, '{"Big":1'||l_orderkey||'00000000000000000000,"huge":'
    ||(l_extendedprice * 1e13)::VARCHAR||',"nested":{"discount":'||l_discount::VARCHAR||',"price":'||l_extendedprice::VARCHAR
    ||'},"tiny":['||(l_extendedprice * 1e-9)::VARCHAR||','||(-l_discount * 1e-9)::VARCHAR||']}' AS payload FROM lineitem""")(
    lambda f: landing.canonical_payloads(f.spark, f.source))

register("payload_hash", f"SELECT {_PAGE}, id_raw, sha256(raw_record) AS raw_payload_hash FROM entry WHERE page_is_json")(
    lambda f: entries.extract_entries(f.raw_pages).select(
        *PAGE, "id_raw", normalise.payload_hash().alias("raw_payload_hash")))

register("char_count", f"SELECT {_ID}, length(body) AS body_char_count FROM obs_text")(
    lambda f: f.entries.select(*PAGE, "entry_pos", F.length(tx.clean_text("body_raw")).cast("bigint").alias("body_char_count")))

register("token_estimate", f"SELECT {_ID}, body_token_estimate FROM obs")(
    lambda f: f.entries.withColumn("flat", tx.flat_text(tx.clean_text("body_raw"))).select(
        *PAGE, "entry_pos", tx.token_estimate("flat").cast("bigint").alias("body_token_estimate")))

_NORMAL = """source_platform, source_endpoint, storefront, source_app_id, source_review_id, review_url, author_label,
    author_uri, rating, title, body, app_version, vote_count, vote_sum, raw_payload_hash, detected_language,
    body_char_count, body_token_estimate, parser_fallback_used, author_fingerprint, run_id, page_number"""
register("normalize_review", f"""SELECT {_NORMAL}, app_name, vertical_name AS vertical, {iso('published_at')} AS published_at,
    {iso('fetched_at')} AS ingested_at FROM obs JOIN feeds USING (source_app_id, storefront)""")(
    lambda f: normalise.attach_cohort(normalise.normalise(entries.extract_entries(f.raw_pages.drop("raw_file_path"))), f.cohort)
    .select(*[c.strip() for c in _NORMAL.split(",")], "app_name", "vertical", "published_at",
            F.col("fetched_at").alias("ingested_at")))

register("author_fingerprint", f"SELECT {_ID}, author_fingerprint FROM obs")(
    lambda f: f.entries.select(*PAGE, "entry_pos", tx.author_fingerprint(
        "source_platform", tx.clean_text("author_uri_raw", True), tx.clean_text("author_label_raw", True))
        .alias("author_fingerprint")))

_REDACTED = r"""regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', '[URL]', 'g'),
    '(^|[^\p{L}\p{N}_])[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}', '\1[EMAIL]', 'g')"""
register("redact_text", rf"""SELECT doc_id, CASE WHEN length(t) > 180 THEN left(t, 180)||'…' ELSE t END AS excerpt FROM (
    SELECT doc_id, trim(regexp_replace({_REDACTED}, '\s+', ' ', 'g')) AS t FROM documents)""")(
    lambda f: landing.read_table(f.spark, f.source, "documents").select("doc_id", tx.redact_text("text").alias("excerpt")))

# --- hard validation ----------------------------------------------------------------------------
register("validation_reasons", f"SELECT {_ID}, array_to_string(reasons, '|') AS reasons FROM obs")(
    lambda f: f.validated.select(*PAGE, "entry_pos", F.array_join("reasons", "|").alias("reasons")))

register("valid_split", f"""SELECT run_id, source_app_id, storefront, count(*) FILTER (valid) AS valid_count,
    count(*) FILTER (NOT valid) AS invalid_count FROM obs GROUP BY ALL""")(
    lambda f: f.validated.groupBy("run_id", "source_app_id", "storefront").agg(
        F.count_if(F.size("reasons") == 0).alias("valid_count"), F.count_if(F.size("reasons") > 0).alias("invalid_count")))

register("rejected_records", """SELECT run_id, raw_feed_page_id, source_app_id, storefront, entry_pos, source_review_id,
    reasons[1] AS rejection_reason, '["'||array_to_string(reasons, '","')||'"]' AS rejection_details, raw_payload_hash,
    raw_record AS raw_payload FROM marked WHERE NOT valid AND failed_pos IS NULL""")(lambda f: f.rejects)

register("page_atomicity", f"""SELECT {_PAGE}, failed_pos IS NOT NULL AS rolled_back, count(*) AS entry_count
    FROM marked GROUP BY ALL""")(
    lambda f: f.log.groupBy(*PAGE).agg(F.bool_or(F.col("failed_pos").isNotNull()).alias("rolled_back"),
                                          F.count("*").alias("entry_count")))

register("page_status", f"SELECT {_PAGE}, parse_status, parse_error FROM pages_done")(
    lambda f: f.pages.select(*PAGE, "parse_status", "parse_error"))

# --- raw observations and run comparison over stored bodies ---------------------------------------
register("raw_observations", f"""SELECT {_PAGE}, sha256(response_body) AS response_hash,
    CASE WHEN page_is_json THEN COALESCE(ids, '') ELSE '' END AS review_ids,
    CASE WHEN NOT page_is_json THEN 'invalid JSON' END AS parse_error,
    CASE WHEN page_is_json THEN id_count ELSE 0 END AS entry_count FROM page_body""")(
    lambda f: comparison.raw_observations(f.raw_pages).withColumn(
        "review_ids", F.array_join(F.array_sort("review_ids"), ",")))

register("window_changes", """SELECT source_app_id, storefront, page_number, count(*) AS observation_count,
    count(DISTINCT sha256(response_body)) > 1 AS response_hash_changed, count(DISTINCT idset) > 1 AS review_window_changed,
    string_agg(run_id||':'||n, ',' ORDER BY run_id) AS entry_counts
    FROM (SELECT *, CASE WHEN page_is_json THEN COALESCE(ids, '') ELSE '' END AS idset,
        CASE WHEN page_is_json THEN id_count ELSE 0 END AS n FROM page_body)
    GROUP BY source_app_id, storefront, page_number
    HAVING count(*) > 1 AND (count(DISTINCT sha256(response_body)) > 1 OR count(DISTINCT idset) > 1)""")(
    lambda f: comparison.window_changes(comparison.raw_observations(f.raw_pages)).withColumn(
        "entry_counts", F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["run_id"], r["entry_count"])), ","))
    .drop("runs"))
