"""DuckDB SQL twins of the registered queries: shared common table expressions.

The twin starts from the flat tables, so the JSON path of the Spark side is really tested.
"""

from __future__ import annotations

import re
import string

from feedfold.functions.text import ENGLISH_MARKERS
from feedfold.operators.flags import (AUTHOR_DETAIL, DUPLICATE_DETAIL, FALLBACK_DETAIL, FLAG_TYPES, HIGH_DETAIL,
                                      LOW_DETAIL)
from feedfold.sources.landing import EVENT_SENTENCES, SENTIMENT_WORDS
from feedfold.sources.lexicon import BROAD_TERMS, ISSUE_SIGNALS, ISSUE_TERMS, NEGATIVE_TERMS, POSITIVE_TERMS


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean(x: str) -> str:
    x = f"replace(replace({x}, chr(13)||chr(10), chr(10)), chr(13), chr(10))"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    return strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10)||chr(10), 'g')")


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"


def terms(x: str, words) -> str:
    escaped = "|".join(r"\s+".join(w.split()) for w in words)
    return rf"regexp_matches({x}, '(?i)(^|[^\p{{L}}\p{{N}}_])({escaped})($|[^\p{{L}}\p{{N}}_])')"


def words(x: str, listed) -> str:
    edge = "'.,!?;:''()[]{}' || chr(34)"
    return (f"CASE WHEN regexp_matches(lower({x}), '{'|'.join(listed)}') THEN list_has_any([trim(w, {edge}) "
            f"for w in regexp_split_to_array(lower({x}), '\\s+')], [{quoted(listed)}]) ELSE FALSE END")


def language(x: str) -> str:
    letters = rf"length(regexp_replace({x}, '[^\p{{L}}]+', '', 'g'))"
    plain = rf"length(regexp_replace({x}, '[^A-Za-z]+', '', 'g'))"
    marked = " OR ".join(f"contains(' '||lower({x})||' ', ' {m} ')" for m in ENGLISH_MARKERS)
    return (f"CASE WHEN {letters} > 0 AND {plain}::DOUBLE / greatest({letters}, 1) >= 0.9 "
            f"AND ({letters} >= 12 OR {marked}) THEN 'en' ELSE 'unknown' END")


def wilson(hits: str, n: str, prefix: str = "") -> str:
    z = "1.96::DOUBLE"
    p = f"({hits})::DOUBLE/({n})"
    centre = f"({p} + {z}*{z}/(2*({n})))"
    half = f"({z} * sqrt(({p}*(1-{p}) + {z}*{z}/(4*({n})))/({n})))"
    scale = f"(1 + {z}*{z}/({n}))"
    return f"""({hits})::BIGINT AS {prefix}successes, ({n})::BIGINT AS {prefix}total,
        CASE WHEN ({n}) = 0 THEN 0 ELSE round({p}, 9) END AS {prefix}estimate,
        CASE WHEN ({n}) = 0 THEN 0 ELSE round(greatest(0, ({centre} - {half})/{scale}), 9) END AS {prefix}lower,
        CASE WHEN ({n}) = 0 THEN 0 ELSE round(least(1, ({centre} + {half})/{scale}), 9) END AS {prefix}upper"""


_EVENT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SENTENCES.items()) + " ELSE '' END"
_MOOD = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in SENTIMENT_WORDS.items()) + " ELSE '' END"
_FEED = "source_app_id, storefront"
_KEY = "source_app_id, storefront, source_review_id"
_PAGE = "run_id, source_app_id, storefront, page_number"


def _label(name: str, field: str, before: str = "") -> str:
    return (f"CASE WHEN {field} IS NOT NULL THEN '\"{name}\":{{{before}\"label\":'||to_json({field})::VARCHAR||'}}' END")


_AUTHOR = ("CASE WHEN author_label_raw IS NOT NULL OR author_uri_raw IS NOT NULL THEN '\"author\":{'||concat_ws(',', "
           + _label("name", "author_label_raw") + ", " + _label("uri", "author_uri_raw") + ")||'}' END")
_LINK = ("CASE WHEN review_url_raw IS NOT NULL THEN '\"link\":{\"attributes\":{\"href\":'||to_json(review_url_raw)::VARCHAR"
         "||',\"rel\":\"related\"}}' END")

CTES: dict[str, str] = {
    "docs": """SELECT doc_id, text, COALESCE(documents.n_chars, length(text), 0) AS n_chars, lang AS storefront, substr(source, 4)::BIGINT % 10 AS app_no,
        COALESCE(list_position(['de','en','es','fr'], lang), 0) AS lang_no,
        'app-'||(substr(source, 4)::BIGINT % 10) AS source_app_id, COALESCE(ts, TIMESTAMP '2026-01-01') AS ts,
        COALESCE(user_id, doc_id) AS user_id, COALESCE(event_type, 'none') AS event_type,
        COALESCE(floor(value)::BIGINT, 0) AS votes, COALESCE(props->>'k', '0') AS k, (doc_id*31 + COALESCE(documents.n_chars, length(text), 0)) % 10 AS arrival
        FROM documents LEFT JOIN events ON doc_id = event_id""",
    "seen": """SELECT d.*, r.run_id, app_no*8 + lang_no AS app_order, doc_id % 41 = 7 AS parser_fallback_used,
        CASE WHEN doc_id % 41 = 7 THEN 1000000 + doc_id ELSE doc_id // 250 + 1 END AS page_number,
        CASE WHEN doc_id % 41 = 7 THEN 0 ELSE doc_id % 250 END AS entry_pos,
        NOT (doc_id % 41 = 7 AND r.run_id = 3 AND doc_id % 5 = 3) AS page_is_json,
        TIMESTAMP '2026-01-01' + to_days(r.run_id::INTEGER) + to_minutes(app_no*8 + lang_no) AS fetched_at
        FROM docs d JOIN (SELECT unnest([1::BIGINT, 2, 3]) AS run_id) r ON arrival BETWEEN r.run_id - 1 AND 4 + 2*r.run_id""",
    "based": """SELECT *, 1 + (doc_id*7 + n_chars) % 5 AS rating_1 FROM seen""",
    "raw": f"""SELECT *,
        CASE WHEN doc_id % 37 <> 23 THEN 'r-'||doc_id END AS id_raw,
        CASE WHEN run_id >= 2 AND doc_id % 13 = 4 THEN 1 + rating_1 % 5 ELSE rating_1 END AS true_rating,
        CASE WHEN doc_id % 37 = 11 THEN '7' WHEN doc_id % 37 = 31 THEN 'five'
             WHEN doc_id % 4 = 1 THEN ' '||true_rating||' ' ELSE true_rating::VARCHAR END AS rating_raw,
        CASE WHEN doc_id % 6 = 1 THEN chr(9)||'  '||replace(text, chr(10), chr(13)||chr(10))||'  '||chr(10)
             WHEN doc_id % 6 = 2 THEN replace(text, '. ', '.  '||chr(9))
             WHEN doc_id % 6 = 3 THEN replace(text, chr(10), repeat(chr(10), 4)) ELSE text END AS padded,
        CASE WHEN doc_id % 37 IN (5, 31) THEN ' '||chr(9)||chr(10)||' '
             WHEN doc_id % 19 = 4 THEN CASE WHEN doc_id % 2 = 0 THEN 'Great!!' ELSE 'terrible' END
             ELSE padded||{_EVENT}||{_MOOD}||CASE WHEN run_id = 3 AND doc_id % 11 = 6 THEN chr(10)||'edited later.' ELSE '' END
             END AS body_raw,
        CASE WHEN doc_id % 19 = 4 OR doc_id % 37 IN (5, 31) THEN text WHEN doc_id % 23 = 9 THEN NULL WHEN doc_id % 23 = 10 THEN ''
             ELSE left(split_part(text, chr(10), 1), 60) END AS title_1,
        title_1||CASE WHEN run_id >= 2 AND doc_id % 5 = 2 THEN ' (edited)' ELSE '' END AS title_raw,
        CASE WHEN doc_id % 37 <> 29 AND doc_id % 8 <> 3 THEN 'reader '||user_id END AS author_label_raw,
        CASE WHEN doc_id % 37 <> 29 AND doc_id % 4 <> 0 THEN 'https://feed.example/id'||user_id END AS author_uri_raw,
        CASE WHEN doc_id % 37 = 17 THEN 'soon' WHEN doc_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
             WHEN doc_id % 3 = 1 THEN strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S')||'-07:00'
             ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS published_raw,
        CASE WHEN doc_id % 17 <> 3 THEN '1.'||k||'.'||run_id END AS app_version_raw,
        CASE WHEN doc_id % 6 <> 5 THEN 'https://feed.example/review?id='||doc_id END AS review_url_raw,
        CASE WHEN run_id = 2 AND doc_id % 997 = 500 THEN '-1'
             WHEN doc_id % 29 <> 8 THEN (votes + run_id)::VARCHAR END AS vote_count_raw,
        (votes // 2)::VARCHAR AS vote_sum_raw,
        'https://feed.example/'||storefront||'/page='||page_number||'/id='||source_app_id AS source_endpoint
        FROM based""",
    "entry": f"""SELECT *, '{{'||concat_ws(',', {_AUTHOR},
        {_label("content", "body_raw", '"attributes":{"type":"text"},')}, {_label("id", "id_raw")},
        {_label("im:rating", "rating_raw")}, {_label("im:version", "app_version_raw")},
        {_label("im:voteCount", "vote_count_raw")}, {_label("im:voteSum", "vote_sum_raw")}, {_LINK},
        {_label("title", "title_raw")}, {_label("updated", "published_raw")})||'}}' AS raw_record FROM raw""",
    "page_parts": f"""SELECT {_PAGE}, app_order, fetched_at, source_endpoint, page_is_json, parser_fallback_used,
        string_agg(raw_record, ',' ORDER BY entry_pos) AS joined, count(*) AS entry_count,
        string_agg(id_raw, ',' ORDER BY id_raw) AS ids, count(id_raw) AS id_count
        FROM entry GROUP BY ALL""",
    "page_body": """SELECT *, '{"feed":{"author":{"name":{"label":"Store"}},"entry":'||
        CASE WHEN parser_fallback_used THEN joined
             ELSE '[{"id":{"label":"feed-meta"},"title":{"label":"Not a review"}},"note",'||joined||']' END||
        ',"link":'||CASE WHEN parser_fallback_used THEN '{"attributes":{"rel":"self","href":"'||source_endpoint||'"}}'
             ELSE '[{"attributes":{"rel":"self","href":"'||source_endpoint||'"}}'||
             CASE WHEN page_number % 6 = 0 THEN '' ELSE ',{"attributes":{"rel":"next","href":"'||
             CASE WHEN page_number % 3 <> 0 THEN source_endpoint||'&next' ELSE '' END||'"}}' END||']' END||
        ',"title":{"label":"Customer reviews"}}}' AS whole,
        CASE WHEN page_is_json THEN whole ELSE substr(whole, 1, length(whole) - 2) END AS response_body
        FROM page_parts""",
    "obs_text": f"""SELECT {_PAGE}, doc_id, app_order, fetched_at, entry_pos, 'app_store' AS source_platform, source_endpoint,
        parser_fallback_used, raw_record, sha256(raw_record) AS raw_payload_hash, id_raw AS source_review_id,
        CASE WHEN doc_id % 37 = 11 THEN 7 WHEN doc_id % 37 = 31 THEN NULL ELSE true_rating END AS rating,
        nullif({clean("title_raw")}, '') AS title, {clean("body_raw")} AS body,
        author_label_raw AS author_label, author_uri_raw AS author_uri,
        CASE WHEN doc_id % 37 <> 17 THEN date_trunc('second', ts) END AS published_at,
        app_version_raw AS app_version, review_url_raw AS review_url,
        vote_count_raw::BIGINT AS vote_count, vote_sum_raw::BIGINT AS vote_sum,
        concat_ws('/', run_id, source_app_id, storefront, page_number) AS raw_feed_page_id,
        run_id*100000000000000000 + app_order*100000000000000 + page_number*10000 + entry_pos AS seq
        FROM entry WHERE page_is_json""",
    "obs": f"""SELECT *, {strip("COALESCE(title, '')||' '||body")} AS spoken,
        {language("spoken")} AS detected_language, length(body) AS body_char_count,
        len([w for w in regexp_split_to_array(body, '\\s+') if w <> '']) AS body_token_estimate,
        CASE WHEN COALESCE(author_uri, author_label) IS NOT NULL
             THEN sha256(source_platform||'|'||COALESCE(author_uri, author_label)) END AS author_fingerprint,
        [x for x in [CASE WHEN source_review_id IS NULL THEN 'missing_review_id' END,
            CASE WHEN rating IS NULL THEN 'missing_or_invalid_rating' END,
            CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating_out_of_range' END,
            CASE WHEN body = '' THEN 'empty_body' END,
            CASE WHEN published_at IS NULL THEN 'invalid_timestamp' END] if x IS NOT NULL] AS reasons,
        len(reasons) = 0 AS valid,
        translate(trim(body), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS body_fold,
        CASE WHEN rating >= 4 AND {words("body", NEGATIVE_TERMS)} AND NOT {words("body", POSITIVE_TERMS)} THEN '{HIGH_DETAIL}'
             WHEN rating <= 2 AND {words("body", POSITIVE_TERMS)} AND NOT {words("body", NEGATIVE_TERMS)} THEN '{LOW_DETAIL}'
             END AS mismatch_detail
        FROM obs_text""",
    "undone_pages": f"""SELECT {_PAGE}, min(entry_pos) AS failed_pos FROM obs
        WHERE valid AND (vote_count < 0 OR vote_sum < 0) GROUP BY ALL""",
    "marked": f"""SELECT obs.*, failed_pos FROM obs LEFT JOIN undone_pages USING ({_PAGE})""",
    "good": """SELECT * FROM marked WHERE valid AND failed_pos IS NULL""",
    "placed": f"""SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY seq) AS place,
        row_number() OVER (PARTITION BY {_KEY} ORDER BY seq DESC) AS place_back FROM good""",
    "reviews": f"""SELECT concat_ws('/', a.source_platform, a.source_app_id, a.storefront, a.source_review_id) AS review_id,
        a.doc_id, a.source_platform, a.source_app_id, a.storefront, a.source_review_id, a.rating, a.title, a.body, a.review_url,
        a.source_endpoint, a.published_at, a.detected_language, a.body_char_count, a.body_token_estimate, a.body_fold,
        b.author_fingerprint, b.app_version, b.vote_count, b.vote_sum, b.raw_payload_hash,
        a.raw_feed_page_id AS first_raw_feed_page_id, b.raw_feed_page_id AS last_raw_feed_page_id,
        a.run_id AS first_seen_run_id, b.run_id AS last_seen_run_id, a.fetched_at AS first_seen_at,
        b.fetched_at AS last_seen_at, a.seq AS first_seq
        FROM placed a JOIN placed b USING ({_KEY}) WHERE a.place = 1 AND b.place_back = 1""",
    "tested": f"""SELECT o.*, EXISTS (SELECT 1 FROM reviews r WHERE r.source_app_id = o.source_app_id
            AND r.storefront = o.storefront AND r.body_fold = o.body_fold
            AND r.source_review_id <> o.source_review_id AND r.first_seq < o.seq)
        OR (o.failed_pos IS NOT NULL AND EXISTS (SELECT 1 FROM marked u WHERE u.raw_feed_page_id = o.raw_feed_page_id
            AND u.valid AND u.body_fold = o.body_fold AND u.source_review_id <> o.source_review_id AND u.seq < o.seq
            AND NOT EXISTS (SELECT 1 FROM reviews k WHERE k.source_app_id = u.source_app_id AND k.storefront = u.storefront
                AND k.source_review_id = u.source_review_id AND k.first_seq < u.seq))) AS duplicate_text
        FROM marked o WHERE o.valid AND (o.failed_pos IS NULL OR o.entry_pos < o.failed_pos)""",
    "seen_flags": f"""SELECT {_KEY}, run_id, seq, failed_pos, 'non_english_or_unknown_language' AS flag_type,
            'info' AS flag_severity, detected_language AS flag_details FROM tested WHERE detected_language <> 'en'
        UNION ALL SELECT {_KEY}, run_id, seq, failed_pos, 'too_short_review', 'info', 'body_char_count='||body_char_count
            FROM tested WHERE body_char_count < 12
        UNION ALL SELECT {_KEY}, run_id, seq, failed_pos, 'duplicate_text_within_app', 'warning', '{DUPLICATE_DETAIL}'
            FROM tested WHERE duplicate_text
        UNION ALL SELECT {_KEY}, run_id, seq, failed_pos, 'missing_author_metadata', 'info', '{AUTHOR_DETAIL}'
            FROM tested WHERE author_label IS NULL AND author_uri IS NULL
        UNION ALL SELECT {_KEY}, run_id, seq, failed_pos, 'parser_fallback_used', 'info', '{FALLBACK_DETAIL}'
            FROM tested WHERE parser_fallback_used
        UNION ALL SELECT {_KEY}, run_id, seq, failed_pos, 'rating_text_mismatch', 'warning', mismatch_detail
            FROM tested WHERE mismatch_detail IS NOT NULL""",
    "flags": f"""SELECT concat_ws('/', 'app_store', {_KEY}) AS review_id, {_KEY}, flag_type, flag_severity, flag_details,
        run_id AS created_run_id FROM seen_flags WHERE failed_pos IS NULL
        QUALIFY row_number() OVER (PARTITION BY {_KEY}, flag_type ORDER BY seq) = 1""",
    "feeds": """SELECT DISTINCT substr(source, 4)::BIGINT % 10 AS app_no, lang AS storefront,
        'app-'||(substr(source, 4)::BIGINT % 10) AS source_app_id, 'App '||(substr(source, 4)::BIGINT % 10) AS app_name,
        'v'||(substr(source, 4)::BIGINT % 10 % 6) AS vertical_name FROM documents""",
    "requests": """SELECT unnest([1::BIGINT, 2, 3]) AS run_id, * FROM feeds""",
    "failures": """SELECT run_id, source_app_id, storefront, 'HTTP 503 for '||source_app_id AS error FROM requests
        WHERE (app_no*7 + run_id*3 + length(storefront)) % 5 = 0""",
    "pages_flat": f"""SELECT {_PAGE}, app_order, fetched_at, page_is_json, count(*) AS document_count FROM seen GROUP BY ALL""",
    "pages_done": f"""SELECT p.*, CASE WHEN NOT page_is_json OR failed_pos IS NOT NULL THEN 'parse_error' ELSE 'parsed' END
        AS parse_status, CASE WHEN NOT page_is_json THEN 'invalid JSON' WHEN failed_pos IS NOT NULL THEN 'constraint failed' END
        AS parse_error FROM pages_flat p LEFT JOIN undone_pages USING ({_PAGE})""",
    "counters": f"""SELECT q.run_id, q.source_app_id, q.storefront,
        (SELECT count(*) FROM pages_done x WHERE (x.run_id, x.source_app_id, x.storefront) = (q.run_id, q.source_app_id, q.storefront)) AS pages_fetched,
        (SELECT count(*) FROM obs x WHERE (x.run_id, x.source_app_id, x.storefront) = (q.run_id, q.source_app_id, q.storefront)) AS reviews_parsed,
        (SELECT count(*) FROM placed x WHERE place = 1 AND (x.run_id, x.source_app_id, x.storefront) = (q.run_id, q.source_app_id, q.storefront)) AS reviews_inserted,
        (SELECT count(*) FROM placed x WHERE place > 1 AND (x.run_id, x.source_app_id, x.storefront) = (q.run_id, q.source_app_id, q.storefront)) AS reviews_updated,
        (SELECT count(*) FROM marked x WHERE NOT valid AND failed_pos IS NULL AND (x.run_id, x.source_app_id, x.storefront) = (q.run_id, q.source_app_id, q.storefront)) AS reviews_rejected,
        (SELECT count(*) FROM flags x WHERE (x.created_run_id, x.source_app_id, x.storefront) = (q.run_id, q.source_app_id, q.storefront)) AS flags_created,
        (SELECT count(*) FROM failures x WHERE (x.run_id, x.source_app_id, x.storefront) = (q.run_id, q.source_app_id, q.storefront)) AS failed_requests,
        CASE WHEN EXISTS (SELECT 1 FROM failures x WHERE (x.run_id, x.source_app_id, x.storefront) = (q.run_id, q.source_app_id, q.storefront))
            OR EXISTS (SELECT 1 FROM pages_done x WHERE parse_status = 'parse_error'
            AND (x.run_id, x.source_app_id, x.storefront) = (q.run_id, q.source_app_id, q.storefront))
            THEN 'completed_with_errors' ELSE 'completed' END AS run_status
        FROM requests q""",
    "runs": """SELECT run_id, count(*) AS apps_attempted, sum(pages_fetched)::BIGINT AS pages_fetched,
        sum(reviews_parsed)::BIGINT AS reviews_parsed, sum(reviews_inserted)::BIGINT AS reviews_inserted,
        sum(reviews_updated)::BIGINT AS reviews_updated, sum(reviews_rejected)::BIGINT AS reviews_rejected,
        sum(flags_created)::BIGINT AS flags_created, sum(failed_requests)::BIGINT AS failed_requests,
        max(run_status) AS run_status, (SELECT min(fetched_at) FROM pages_flat p WHERE p.run_id = c.run_id) AS started_at,
        (SELECT max(fetched_at) FROM pages_flat p WHERE p.run_id = c.run_id) AS completed_at FROM counters c GROUP BY run_id""",
    "view": """SELECT r.*, f.app_name, f.vertical_name, 0 AS has_error_flag
        FROM reviews r JOIN feeds f USING (source_app_id, storefront)""",
    "hot": "SELECT review_id, " + ", ".join(
        f"max((flag_type = '{t}')::INTEGER) AS quality_flag_{t}" for t in FLAG_TYPES) + " FROM flags GROUP BY review_id",
    "featured": "SELECT v.doc_id, v.review_id, v.source_review_id, app_name, vertical_name, storefront, rating, "
        "COALESCE(title, '') AS title, COALESCE(body, '') AS body, detected_language, published_at, "
        + strip("COALESCE(title, '')||chr(10)||COALESCE(body, '')") + " AS combined, "
        + ", ".join(f"COALESCE(quality_flag_{t}, 0) AS quality_flag_{t}" for t in FLAG_TYPES)
        + " FROM view v LEFT JOIN hot USING (review_id)",
    "signalled": "SELECT *, " + ", ".join(
        f"{terms('combined', ISSUE_TERMS[s])}::INTEGER AS issue_{s}" for s in ISSUE_SIGNALS) + ", "
        + ", ".join(f"{terms('combined', [t])}::INTEGER AS term_{t}" for t in BROAD_TERMS)
        + f", {terms('combined', POSITIVE_TERMS)} AS has_positive, {terms('combined', NEGATIVE_TERMS)} AS has_negative FROM featured",
    "features": r"""SELECT *, length(title)::INTEGER AS title_char_count, length(body)::INTEGER AS body_char_count,
        len(regexp_extract_all(body, '[\p{L}\p{N}_'']*[\p{L}\p{N}_][\p{L}\p{N}_'']*'))::INTEGER AS body_word_count,
        (length(combined) - length(replace(combined, '?', '')))::INTEGER AS question_mark_count,
        (length(combined) - length(replace(combined, '!', '')))::INTEGER AS exclamation_mark_count,
        year(published_at)::INTEGER AS published_year, month(published_at)::INTEGER AS published_month,
        dayname(published_at) AS published_day_of_week, hour(published_at)::INTEGER AS published_hour,
        """ + "+".join(f"quality_flag_{t}" for t in FLAG_TYPES) + """ AS quality_flag_count,
        (quality_flag_count > 0)::INTEGER AS has_any_quality_flag,
        """ + "+".join(f"issue_{s}" for s in ISSUE_SIGNALS) + """ AS issue_signal_count,
        CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END AS weak_label,
        'rating_v1' AS weak_label_source,
        concat_ws('|', CASE WHEN quality_flag_rating_text_mismatch = 1 THEN 'rating_text_mismatch' END,
            CASE WHEN has_positive AND has_negative THEN 'mixed_sentiment_keywords' END,
            CASE WHEN rating = 3 THEN 'neutral_rating' END,
            CASE WHEN quality_flag_too_short_review = 1 THEN 'too_short_review' END,
            CASE WHEN detected_language <> 'en' OR quality_flag_non_english_or_unknown_language = 1
                 THEN 'non_english_or_unknown_language' END) AS weak_label_noise_reasons,
        (weak_label_noise_reasons <> '')::INTEGER AS weak_label_needs_review FROM signalled""",
}


def with_ctes(select: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``select`` with the CTEs it needs, in dependency order."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str, below: str | None = None) -> None:
        for name in known:
            if name != below and name not in needed and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(known[name], name)
                needed.append(name)

    visit(select)
    if not needed:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in needed) + "\n" + select
