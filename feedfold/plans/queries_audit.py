"""Audit sampling and scoring.

Scoring runs over every review as an annotated manifest row (sample role by the first digit of its
random rank), so its work grows with the tables; the sampling queries return the bounded sample.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedfold.functions.stats import stable_rank, wilson_columns
from feedfold.operators import audit_sample as sm
from feedfold.operators import audit_score as sc
from feedfold.operators.features import combined_text, with_combined_text
from feedfold.operators.term_index import indexed_terms, matched_by_index
from feedfold.plans.catalog import register
from feedfold.plans.oracle import iso, quoted, terms, wilson
from feedfold.session import fresh_path
from feedfold.sources import exports, landing
from feedfold.sources.lexicon import BROAD_TERMS, ISSUE_SIGNALS, ISSUE_TERMS, lexicon_table

SEED = sm.SEED
ISSUES = [f"issue_{s}" for s in ISSUE_SIGNALS]
_ISSUES = ", ".join(ISSUES)


def _matched_sql(text: str) -> str:
    parts = []
    for s in sorted(ISSUE_TERMS):
        listed = ", ".join(f"CASE WHEN {terms(text, [t])} THEN '\"{t}\"' END" for t in ISSUE_TERMS[s])
        parts.append(f"'\"{s}\":['||concat_ws(',', {listed})||']'")
    return "'{'||concat_ws(',', " + ", ".join(parts) + ")||'}'"


_GOALS = {
    **{f"reason:{r}": f"contains('|'||weak_label_noise_reasons||'|', '|{r}|')::INTEGER" for r in sm.REASON_TARGETS},
    **{f"signal:{s}": f"issue_{s}" for s in ISSUE_SIGNALS}, **{f"term:{t}": f"term_{t}" for t in BROAD_TERMS}}
_QUOTA = "CASE cell " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in sm.CORE_QUOTAS.items()) + " END"

SWAPS = 100


def _booster_sql() -> dict[str, str]:
    """The greedy choice row by row and the repair swap by swap, as one CTE each.

    ``goals`` has the 0/1 goals g0, g1, ...; ``pick<k>`` the core (turn 0) and the first k booster rows; ``swap<k>`` the same
    after k swaps at most, where a swap that gains nothing changes nothing.
    """
    names, ctes = list(sm.TARGETS), {}
    columns = [f"g{i}" for i in range(len(names))]
    ctes["goals"] = "SELECT review_id, app_name, cell, rank, " + ", ".join(
        f"({_GOALS[n]})::BIGINT AS {c}" for n, c in zip(names, columns)) + " FROM people"
    ctes["pick0"] = "SELECT *, 0 AS turn FROM goals WHERE review_id IN (SELECT review_id FROM floored)"
    sums = ", ".join(f"sum({c}) AS s_{c}" for c in columns)
    points = " + ".join(f"CASE WHEN s_{c} < {sm.TARGETS[n]} THEN {sm.RARE_POINTS.get(n, sm.POINTS[n.split(':')[0]])} * {c} ELSE 0 END"
                        for n, c in zip(names, columns))
    for k in range(1, sm.BOOSTER_SIZE + 1):
        ctes[f"pick{k}"] = f"""SELECT * FROM pick{k - 1} UNION ALL (SELECT g.*, {k} AS turn FROM goals g
            LEFT JOIN (SELECT app_name, count(*) AS held FROM pick{k - 1} GROUP BY app_name) a USING (app_name),
            (SELECT {sums} FROM pick{k - 1}) WHERE g.review_id NOT IN (SELECT review_id FROM pick{k - 1})
            ORDER BY {points} + CASE WHEN COALESCE(held, 0) < {sm.TOTAL_APP_FLOOR} THEN {sm.APP_POINTS} ELSE 0 END DESC, rank LIMIT 1)"""
    floor = sm.TOTAL_APP_FLOOR
    now = " + ".join(f"greatest(0, {sm.TARGETS[n]} - s_{c})" for n, c in zip(names, columns))
    then = " + ".join(f"greatest(0, {sm.TARGETS[n]} - (s_{c} - x.{c} + y.{c}))" for n, c in zip(names, columns))
    ctes["swap0"] = f"SELECT * FROM pick{sm.BOOSTER_SIZE}"
    for k in range(1, SWAPS + 1):
        old = f"swap{k - 1}"
        ctes[f"best{k}"] = f"""SELECT * FROM (SELECT y.*, x.turn AS turn, x.review_id AS gone,
            100 * ({then}) - (CASE WHEN COALESCE(v.held, 0) - (x.app_name = y.app_name)::INTEGER < {floor} THEN 1 ELSE 0 END)
                + (CASE WHEN u.held <= {floor} THEN 1 ELSE 0 END) AS cost, 100 * ({now}) AS cost_now
            FROM {old} x JOIN (SELECT app_name, count(*) AS held FROM {old} GROUP BY app_name) u USING (app_name), goals y
            LEFT JOIN (SELECT app_name, count(*) AS held FROM {old} GROUP BY app_name) v ON v.app_name = y.app_name,
            (SELECT {sums} FROM {old}) WHERE x.turn > 0 AND y.review_id NOT IN (SELECT review_id FROM {old})
            ORDER BY cost, y.review_id, x.turn LIMIT 1) WHERE cost < cost_now"""
        ctes[f"swap{k}"] = f"""SELECT * FROM {old} WHERE review_id NOT IN (SELECT gone FROM best{k})
            UNION ALL SELECT review_id, app_name, cell, rank, {', '.join(columns)}, turn FROM best{k}"""
    ctes["repaired"] = f"SELECT * FROM swap{SWAPS} WHERE turn > 0"
    return ctes


EXTRA = {
    "people": f"""SELECT *, sha256('{SEED}:'||review_id) AS rank,
        CASE WHEN weak_label = 'neutral' THEN 'neutral' ELSE weak_label||'|'||weak_label_needs_review END AS cell FROM features""",
    "core": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY rank) AS place FROM people)
        WHERE place <= {_QUOTA}""",
    "floored": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY turn, rank) AS spot FROM
        (SELECT *, CASE WHEN row_number() OVER (PARTITION BY app_name ORDER BY rank) <= 5 THEN 0 ELSE 1 END AS turn FROM people))
        WHERE spot <= {_QUOTA}""",
    **_booster_sql(),
    "picked": """SELECT p.*, 'core' AS sample_role FROM people p JOIN floored USING (review_id)
        UNION ALL SELECT p.*, 'booster' FROM people p JOIN repaired USING (review_id)""",
    "manifest": f"""SELECT *, printf('audit_v1_%03d', row_number() OVER (ORDER BY sample_role, rank)) AS sample_id,
        {_matched_sql('combined')} AS matched_issue_terms_json FROM picked""",
}


def _people(f):
    return f.stored("people", sm.population(f.features, f.lexicon))


def _core(f):
    return f.stored("audit-core", sm.coverage_floor(_people(f)))


def _booster(f, repair=True):
    return f.stored("audit-booster" if repair else "audit-greedy",
                    lambda: sm.booster_sample(_people(f), _core(f), f.lexicon, repair=repair))


def _manifest(f):
    return sm.audit_manifest(_core(f), _booster(f), f.features, f.lexicon)


# --- sampling -----------------------------------------------------------------------------------
register("audit_input_check", "SELECT 'duplicate_review_id' AS problem, review_id AS detail, 2::BIGINT AS n FROM features WHERE rating = 1")(
    lambda f: exports.audit_input_check(f.features.unionByName(f.features.filter("rating = 1"))))
register("matched_terms", f"SELECT review_id, {_matched_sql('combined')} AS matched FROM features")(
    lambda f: with_combined_text(f.features).select("review_id", F.to_json(
        sm.matched_terms(F.col("combined_text"), f.lexicon, F.col("folded_text"))).alias("matched")))
register("matched_terms_indexed", f"SELECT review_id, {_matched_sql('combined')} AS matched FROM features")(
    lambda f: matched_by_index(f.features, "review_id", combined_text(), lexicon_table(f.spark, f.lexicon)).select(
        "review_id", F.to_json("matched").alias("matched")))

# Phrases of three words of the benchmark items as a lexicon: thousands of terms, one join.
_PUNCTUATED = r"""regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]+', ' ' || chr(1) || ' ', 'g'), '\s+', ' ', 'g')"""
register("benchmark_phrases", rf"""SELECT phrase AS term, count(*) AS review_count
    FROM (SELECT DISTINCT ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS phrase FROM (
        SELECT unnest(range(1, len(ws) - 1)) AS i, ws FROM (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM benchmark)))
    JOIN (SELECT ' ' || {_PUNCTUATED.format(x="title || chr(10) || body")} || ' ' AS said FROM features) ON contains(said, ' ' || phrase || ' ')
    GROUP BY phrase""")(lambda f: _phrases(f))


def _phrases(f):
    words = landing.read_table(f.spark, f.source, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1).alias("ws"))
    phrases = words.select(F.explode(F.transform(F.slice("ws", 1, F.greatest(F.size("ws") - 2, F.lit(0))), lambda w, i: F.concat_ws(
        " ", w, F.get("ws", i + 1), F.get("ws", i + 2)))).alias("term")).distinct()
    table = phrases.select(F.lit("phrases").alias("signal"), "term", F.lit(0).alias("position"))
    return indexed_terms(f.features, "review_id", combined_text(), table).groupBy("term").agg(F.count("*").alias("review_count"))


register("stable_rank", f"SELECT review_id, sha256('{SEED}:'||review_id) AS rank FROM features")(
    lambda f: f.features.select("review_id", stable_rank("review_id", SEED).alias("rank")))
register("stratified_core", "SELECT review_id, cell, rank, app_name FROM core", EXTRA)(
    lambda f: sm.stratified_core(_people(f)).select("review_id", "cell", "rank", "app_name"))
register("coverage_floor", "SELECT review_id, cell, rank, app_name FROM floored", EXTRA)(
    lambda f: sm.coverage_floor(_people(f)).select("review_id", "cell", "rank", "app_name"))
register("booster_deficits", " UNION ALL ".join(
    f"""SELECT '{g}' AS goal, {sm.TARGETS[g]}::BIGINT AS target, COALESCE(sum({e}), 0)::BIGINT AS have,
    greatest(0, {sm.TARGETS[g]} - COALESCE(sum({e}), 0))::BIGINT AS deficit FROM floored""" for g, e in _GOALS.items()), EXTRA)(
    lambda f: sm.booster_deficits(_core(f), f.lexicon))
register("greedy_booster", f"SELECT review_id, app_name, cell, rank FROM pick{sm.BOOSTER_SIZE} WHERE turn > 0", EXTRA)(
    lambda f: _booster(f, repair=False).select("review_id", "app_name", "cell", "rank"))
register("swap_repair", "SELECT review_id, app_name, cell, rank FROM repaired", EXTRA)(
    lambda f: _booster(f).select("review_id", "app_name", "cell", "rank"))
register("audit_shortages", f"""SELECT 'cell' AS kind, c AS item, q - (SELECT count(*) FROM floored WHERE cell = c) AS missing
        FROM (VALUES {', '.join(f"('{c}', {n})" for c, n in sm.CORE_QUOTAS.items())}) v(c, q) WHERE missing > 0
    UNION ALL SELECT 'core_app', app_name, {sm.CORE_APP_FLOOR} - (SELECT count(*) FROM floored f WHERE f.app_name = p.app_name)
        FROM people p GROUP BY app_name HAVING (SELECT count(*) FROM floored f WHERE f.app_name = p.app_name) < {sm.CORE_APP_FLOOR}
    UNION ALL SELECT 'app', app_name, {sm.TOTAL_APP_FLOOR} - (SELECT count(*) FROM swap{SWAPS} f WHERE f.app_name = p.app_name)
        FROM people p GROUP BY app_name HAVING (SELECT count(*) FROM swap{SWAPS} f WHERE f.app_name = p.app_name) < {sm.TOTAL_APP_FLOOR}
    """ + "".join(f" UNION ALL SELECT 'target', '{g}', ({n} - sum(g{i}))::BIGINT FROM swap{SWAPS} HAVING sum(g{i}) < {n}"
                  for i, (g, n) in enumerate(sm.TARGETS.items())), EXTRA)(
    lambda f: sm.sample_shortages(_people(f), _core(f), _booster(f), f.lexicon))

_MANIFEST = f"""sample_id, sample_role, review_id, source_review_id, app_name, vertical_name, storefront, rating, title, body,
    detected_language, {iso('published_at')} AS published_at, weak_label, weak_label_needs_review, weak_label_noise_reasons,
    {_ISSUES}, issue_signal_count, matched_issue_terms_json, rank AS selection_rank"""
register("audit_manifest", f"SELECT {_MANIFEST} FROM manifest", EXTRA)(_manifest)
_BLANKS = ", ".join(f"'' AS {c}" for c in sm.ANSWER_COLUMNS)
register("annotation_template", f"""SELECT sample_id, app_name, vertical_name, title, body, detected_language,
    matched_issue_terms_json, {_BLANKS}, rating, weak_label, weak_label_needs_review, weak_label_noise_reasons, {_ISSUES}
    FROM manifest""", EXTRA)(lambda f: sm.annotation_template(_manifest(f)))
register("sample_metadata", " UNION ALL ".join([
    "SELECT 'size' AS section, sample_role AS item, count(*) AS n FROM manifest GROUP BY sample_role",
    "SELECT 'label', weak_label, count(*) FROM manifest GROUP BY weak_label",
    "SELECT 'flag', weak_label_needs_review::VARCHAR, count(*) FROM manifest GROUP BY weak_label_needs_review",
    "SELECT 'app', app_name, count(*) FROM manifest GROUP BY app_name",
    "SELECT 'vertical', vertical_name, count(*) FROM manifest GROUP BY vertical_name",
    """SELECT 'noise_reason', reason, count(*) FROM (SELECT unnest(string_split(weak_label_noise_reasons, '|')) AS reason
        FROM manifest) WHERE reason <> '' GROUP BY reason""",
    *[f"SELECT 'issue_signal', '{s}', sum(issue_{s})::BIGINT FROM manifest" for s in ISSUE_SIGNALS],
    "SELECT 'population_label', weak_label, count(*) FROM people GROUP BY weak_label",
    """SELECT 'population_label_flag', weak_label||'|'||weak_label_needs_review, count(*) FROM people
        GROUP BY weak_label, weak_label_needs_review"""]), EXTRA)(lambda f: sm.sample_metadata(_manifest(f), _people(f)))
register("recheck_sample", f"""SELECT sample_id, app_name, vertical_name, title, body, detected_language,
    matched_issue_terms_json, {_BLANKS} FROM (SELECT *, row_number() OVER (PARTITION BY weak_label
        ORDER BY sha256('{SEED + 1}:'||sample_id)) AS turn FROM manifest)
    WHERE turn <= CASE weak_label WHEN 'neutral' THEN 7 ELSE 8 END""", EXTRA)(lambda f: sm.recheck_sample(_manifest(f)))
register("holdout_exclusion", """SELECT review_id, weak_label FROM features
    WHERE review_id NOT IN (SELECT review_id FROM floored)""", EXTRA)(
    lambda f: sm.holdout_exclusion(f.features, _core(f)).select("review_id", "weak_label"))


# --- scoring ------------------------------------------------------------------------------------
def _scored(f):
    """Every review as a manifest row, without its text."""
    rows = with_combined_text(f.features.withColumn("rank", stable_rank("review_id", SEED)))
    return f.stored("scored", rows.select(
        F.concat(F.lit("audit_"), "review_id").alias("sample_id"),
        F.when(F.left("rank", F.lit(1)) < "c", "core").otherwise("booster").alias("sample_role"),
        "source_review_id", "app_name", "detected_language", "weak_label", "weak_label_needs_review",
        "weak_label_noise_reasons", *ISSUES,
        F.to_json(sm.matched_terms(F.col("combined_text"), f.lexicon, F.col("folded_text"))).alias("matched_issue_terms_json")))


def _answers(f, recheck: bool = False):
    answers = sc.canonical_answers(_scored(f), landing.annotations(f.spark, f.source, _scored(f), recheck))
    return f.stored("answers-again" if recheck else "answers", answers)


_REL = [*(f"issue_{s}_relevance" for s in ISSUE_SIGNALS), *(f"{t}_term_relevance" for t in BROAD_TERMS)]


def _annotated_sql(recheck: bool) -> str:
    changed = "f.doc_id % 10 = 3" if recheck else "FALSE"

    def answer(second: str, value: str) -> str:
        return f"CASE WHEN {changed} THEN '{second}' ELSE {value} END"

    def relevance(i: int) -> str:
        return answer("not_relevant", f"""CASE quality WHEN 1 THEN CASE WHEN (f.doc_id + {i}) % 4 = 0 THEN 'not_relevant' ELSE '1' END
            WHEN 0 THEN CASE WHEN (f.doc_id + {i}) % 4 < 2 THEN '0' ELSE 'Yes' END ELSE '' END""")

    sentiment = """CASE quality WHEN 1 THEN upper(weak_label) WHEN 0 THEN CASE f.doc_id % 3 WHEN 0 THEN 'mixed' WHEN 1 THEN 'neutral'
        ELSE '' END ELSE CASE WHEN f.doc_id % 4 = 0 THEN ' unclear ' ELSE weak_label END END"""
    agreement = "CASE quality WHEN 1 THEN CASE WHEN f.doc_id % 2 = 0 THEN '1' ELSE 'Yes' END WHEN 0 THEN 'disagree' ELSE '' END"
    return f"""SELECT 'audit_'||review_id AS sample_id, f.doc_id, weak_label, weak_label_needs_review, weak_label_noise_reasons,
        CASE WHEN left(sha256('{SEED}:'||review_id), 1) < 'c' THEN 'core' ELSE 'booster' END AS sample_role,
        {_ISSUES}, {', '.join(f'term_{t}' for t in BROAD_TERMS)},
        {answer('Mixed', sentiment)} AS apparent_sentiment, {answer('disagree', agreement)} AS rating_label_agreement,
        {answer('yes', "CASE toxic WHEN 1 THEN '1' WHEN 0 THEN 'no' ELSE '' END")} AS mixed_sentiment,
        CASE WHEN detected_language = 'en' THEN 'YES' ELSE '0' END AS appears_english,
        CASE WHEN toxic = 1 THEN 'no' ELSE '1' END AS text_interpretable,
        {', '.join(f'{relevance(i)} AS {c}' for i, c in enumerate(_REL))}, '' AS annotation_notes
        FROM features f LEFT JOIN labels l ON l.doc_id = f.doc_id"""


def _canonical_sql(source: str) -> str:
    def yes_no(c: str) -> str:
        return f"CASE lower(trim({c})) WHEN '1' THEN 'yes' WHEN '0' THEN 'no' WHEN '' THEN 'unclear' ELSE lower(trim({c})) END AS {c}"

    def relevance(c: str) -> str:
        fired = c[:-len("_relevance")] if c.startswith("issue_") else "term_" + c[:-len("_term_relevance")]
        return f"""CASE WHEN lower(trim({c})) IN ('1', 'yes', 'relevant') THEN 'relevant'
            WHEN lower(trim({c})) IN ('0', 'no', 'not_relevant') THEN CASE WHEN {fired} = 1 THEN 'not_relevant' ELSE 'not_triggered' END
            WHEN lower(trim({c})) = 'not_triggered' THEN 'not_triggered' ELSE 'unclear' END AS {c}"""

    return f"""SELECT sample_id, doc_id, sample_role, weak_label, weak_label_needs_review, weak_label_noise_reasons, {_ISSUES},
        {', '.join(f'term_{t}' for t in BROAD_TERMS)},
        CASE lower(trim(apparent_sentiment)) WHEN '' THEN 'unclear' ELSE lower(trim(apparent_sentiment)) END AS apparent_sentiment,
        CASE lower(trim(rating_label_agreement)) WHEN '1' THEN 'agree' WHEN 'yes' THEN 'agree' WHEN '0' THEN 'disagree'
            WHEN 'no' THEN 'disagree' WHEN '' THEN 'unclear' ELSE lower(trim(rating_label_agreement)) END AS rating_label_agreement,
        {yes_no('mixed_sentiment')}, {yes_no('appears_english')}, {yes_no('text_interpretable')},
        {', '.join(relevance(c) for c in _REL)} FROM {source}"""


_MIXED = "(mixed_sentiment = 'yes' OR apparent_sentiment = 'mixed')"
_AGREES = "rating_label_agreement = 'agree'"
SCORE = {
    "annotated": _annotated_sql(False), "answers": _canonical_sql("annotated"),
    "annotated_again": _annotated_sql(True), "answers_again": _canonical_sql("annotated_again"),
    "grid": """SELECT l.weak_label, f.flag FROM (VALUES ('negative'), ('neutral'), ('positive')) l(weak_label), (VALUES (0), (1)) f(flag)""",
    "strata": f"""SELECT g.weak_label, g.flag, count(a.sample_id) AS n, count(*) FILTER (a.{_AGREES}) AS agree_n,
        count(*) FILTER ({_MIXED}) AS mixed_n, count(*) FILTER (apparent_sentiment = 'unclear') AS unclear_n
        FROM grid g LEFT JOIN answers a ON a.weak_label = g.weak_label AND a.weak_label_needs_review = g.flag
            AND a.sample_role = 'core' GROUP BY ALL""",
    "weights": """SELECT s.*, CASE WHEN n > 0 THEN
        (SELECT count(*) FROM features x WHERE x.weak_label = s.weak_label AND x.weak_label_needs_review = s.flag)::DOUBLE /
        greatest(1, (SELECT count(*) FROM features x WHERE x.weak_label = s.weak_label)) ELSE 0 END AS weight FROM strata s""",
    "agreement": f"""SELECT weak_label, {wilson('sum(agree_n)', 'sum(n)', 'raw_')},
        sum(CASE WHEN n > 0 THEN weight * agree_n / n ELSE 0 END) AS exact_weighted,
        sum(weight) FILTER (flag = 0) AS exact_0, sum(weight) FILTER (flag = 1) AS exact_1,
        CASE WHEN sum(n) = 0 THEN 0 ELSE sum(mixed_n)::DOUBLE / sum(n) END AS exact_mixed,
        CASE WHEN sum(n) = 0 THEN 0 ELSE sum(unclear_n)::DOUBLE / sum(n) END AS exact_unclear FROM weights GROUP BY weak_label""",
    "signals": " UNION ALL ".join(f"""SELECT '{s}' AS signal, count(*) FILTER (issue_{s} = 1) AS fired,
        count(*) FILTER (issue_{s} = 1 AND issue_{s}_relevance = 'relevant') AS hits,
        count(*) FILTER (issue_{s} = 1 AND issue_{s}_relevance = 'not_relevant') AS not_relevant,
        count(*) FILTER (issue_{s} = 1 AND issue_{s}_relevance = 'unclear') AS unclear FROM answers""" for s in ISSUE_SIGNALS),
    "broad": " UNION ALL ".join(f"""SELECT '{t}' AS term, count(*) FILTER (term_{t} = 1) AS fired,
        count(*) FILTER (term_{t} = 1 AND {t}_term_relevance = 'relevant') AS hits,
        count(*) FILTER (term_{t} = 1 AND {t}_term_relevance = 'not_relevant') AS not_relevant,
        count(*) FILTER (term_{t} = 1 AND {t}_term_relevance = 'unclear') AS unclear FROM answers""" for t in BROAD_TERMS),
    "pairs": " UNION ALL ".join(f"SELECT '{c}' AS field, a.{c} AS one, b.{c} AS two FROM answers a JOIN answers_again b USING (sample_id)"
                                for c in [*sc.CORE_FIELDS, *_REL]),
    "kappas": """SELECT field, count(*) AS n, count(*) FILTER (one = two)::DOUBLE / count(*) AS observed,
        (SELECT sum(x.n * COALESCE(y.n, 0))::DOUBLE / (sum(x.n) * sum(x.n)) FROM
            (SELECT one AS answer, count(*) AS n FROM pairs q WHERE q.field = p.field GROUP BY one) x LEFT JOIN
            (SELECT two AS answer, count(*) AS n FROM pairs q WHERE q.field = p.field GROUP BY two) y USING (answer)) AS expected
        FROM pairs p GROUP BY field""",
    "scored_kappas": f"""SELECT field, CASE WHEN field IN ({quoted(sc.CORE_FIELDS)}) THEN 'core' ELSE 'relevance' END AS field_group,
        observed, CASE WHEN expected < 1 THEN (observed - expected) / (1 - expected) ELSE 1 END AS kappa, n FROM kappas""",
    "qc": """SELECT avg(observed) FILTER (field_group = 'core') AS core_mean, avg(observed) FILTER (field_group <> 'core') AS rel_mean,
        avg(kappa) FILTER (field_group <> 'core') AS kappa_mean,
        max(kappa) FILTER (field = 'rating_label_agreement') AS label_kappa FROM scored_kappas""",
    "gates": f"""SELECT 'class' AS gate, weak_label AS name, exact_weighted >= 0.8 AND exact_unclear <= 0.1 AS passed FROM agreement
        UNION ALL SELECT 'training_class', weak_label, n > 0 AND agree_n >= 0.8 * n AND mixed_n <= 0.2 * n FROM strata WHERE flag = 0
        UNION ALL SELECT 'signal', signal, fired > 0 AND hits >= 0.8 * fired FROM signals
        UNION ALL SELECT 'broad_term', term, fired > 0 AND hits >= 0.8 * fired FROM broad
        UNION ALL SELECT 'recheck', 'qc', core_mean >= 0.8 AND label_kappa >= 0.6 FROM qc""",
}

register("annotation_source", f"""SELECT sample_id, {', '.join(f'trim({c}) AS {c}' for c in sc.ANSWER_COLUMNS)} FROM annotated""", SCORE)(
    lambda f: _read_back(f))


def _read_back(f):
    """Write the annotations as CSV to the shared folder and read them as an annotation sheet."""
    path = fresh_path(f.spark, "annotations")
    sheet = landing.annotations(f.spark, f.source, _scored(f))
    sheet.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return exports.read_annotations(f.spark, path, sheet.columns)


register("canonical_answers", f"""SELECT sample_id, apparent_sentiment, rating_label_agreement, mixed_sentiment, appears_english,
    text_interpretable, {', '.join(_REL)} FROM answers""", SCORE)(
    lambda f: _answers(f).select("sample_id", *[c for c in sc.ANSWER_COLUMNS if c != "annotation_notes"]))


def _faulty(f):
    """Annotations with wrong, repeated, missing and unknown rows."""
    doc = F.substring_index("sample_id", "r-", -1).cast("bigint")
    sheet = landing.annotations(f.spark, f.source, _scored(f)).withColumn("doc_id", doc)
    sheet = sheet.withColumn("apparent_sentiment", F.when(F.col("doc_id") % 53 == 5, "bad").otherwise(F.col("apparent_sentiment")))
    kept = sheet.filter(F.col("doc_id") % 61 != 7).withColumn("sample_id", F.when(
        F.col("doc_id") % 67 == 8, F.concat(F.lit("x-"), "sample_id")).otherwise(F.col("sample_id")))
    return kept.unionByName(kept.filter(F.col("doc_id") % 59 == 6)).drop("doc_id")


register("annotation_validation", """SELECT 'repeated_id' AS problem,
        CASE WHEN doc_id % 67 = 8 THEN 'x-' ELSE '' END||sample_id AS sample_id FROM annotated WHERE doc_id % 59 = 6 AND doc_id % 61 <> 7
    UNION ALL SELECT 'unknown_id', 'x-'||sample_id FROM annotated WHERE doc_id % 67 = 8 AND doc_id % 61 <> 7
    UNION ALL SELECT 'missing_id', sample_id FROM annotated WHERE doc_id % 67 = 8 OR doc_id % 61 = 7
    UNION ALL SELECT 'invalid_apparent_sentiment', sample_id FROM annotated, (SELECT unnest([1, 2]) AS again)
        WHERE doc_id % 53 = 5 AND doc_id % 61 <> 7 AND doc_id % 67 <> 8 AND (again = 1 OR doc_id % 59 = 6)""", SCORE)(
    lambda f: sc.annotation_problems(_scored(f), _faulty(f)))

register("wilson_interval", f"""SELECT app_name, weak_label, {wilson('count(*) FILTER (weak_label_needs_review = 0)', 'count(*)')}
    FROM features GROUP BY app_name, weak_label""")(
    lambda f: f.features.groupBy("app_name", "weak_label").agg(
        F.count_if(F.col("weak_label_needs_review") == 0).alias("clean_n"), F.count("*").alias("n")).select(
        "app_name", "weak_label", *wilson_columns(F.col("clean_n"), F.col("n"))))


def _strata(f):
    return sc.class_strata(_answers(f))


def _agreement(f):
    return sc.class_agreement(_strata(f), sc.population_cells(f.features))


_RAW = "raw_successes, raw_total, raw_estimate, raw_lower, raw_upper"
register("class_agreement", f"""SELECT weak_label, {_RAW}, round(exact_weighted, 9) AS weighted_estimate, round(exact_0, 9) AS weight_0,
    round(exact_1, 9) AS weight_1, round(exact_mixed, 9) AS mixed_rate, round(exact_unclear, 9) AS unclear_rate FROM agreement""", SCORE)(
    _agreement)
register("stratum_agreement", f"""SELECT weak_label, flag, {wilson('agree_n', 'n', 'agree_')}, {wilson('mixed_n', 'n', 'mixed_')}
    FROM strata""", SCORE)(lambda f: sc.stratum_agreement(_strata(f)))
register("confusion_matrix", "SELECT weak_label, apparent_sentiment, count(*) AS n FROM answers GROUP BY ALL", SCORE)(
    lambda f: sc.confusion_matrix(_answers(f)))

_RULES = {
    "rating_text_mismatch": "rating_label_agreement = 'disagree'", "mixed_sentiment_keywords": _MIXED,
    "neutral_rating": f"(apparent_sentiment <> 'neutral' OR {_MIXED} OR NOT {_AGREES})",
    "too_short_review": "(text_interpretable = 'no' OR apparent_sentiment = 'unclear')",
    "non_english_or_unknown_language": "(appears_english = 'no' OR text_interpretable = 'no')"}
register("noise_validity", " UNION ALL ".join(
    f"SELECT '{r}' AS reason, {wilson(f'count(*) FILTER ({rule})', 'count(*)')} FROM answers "
    f"WHERE contains('|'||weak_label_noise_reasons||'|', '|{r}|')" for r, rule in _RULES.items()), SCORE)(
    lambda f: sc.noise_validity(_answers(f)))

_TROUBLE = f"(NOT {_AGREES} OR apparent_sentiment = 'unclear')"
register("flagged_comparison", f"""SELECT weak_label_needs_review::VARCHAR AS flag, {wilson(f'count(*) FILTER ({_TROUBLE})', 'count(*)')},
    (SELECT round(avg({_TROUBLE}::INTEGER) FILTER (weak_label_needs_review = 1) - avg({_TROUBLE}::INTEGER)
        FILTER (weak_label_needs_review = 0), 9) FROM answers WHERE sample_role = 'core') AS point_difference
    FROM answers WHERE sample_role = 'core' GROUP BY weak_label_needs_review""", SCORE)(
    lambda f: sc.flagged_comparison(_answers(f)))
register("signal_relevance", f"SELECT signal, {wilson('hits', 'fired')}, not_relevant, unclear FROM signals", SCORE)(
    lambda f: sc.signal_relevance(_answers(f)))
register("term_relevance", f"SELECT term, {wilson('hits', 'fired')}, not_relevant, unclear FROM broad", SCORE)(
    lambda f: sc.term_relevance(_answers(f)))


def _kappas(f):
    return sc.recheck_kappa(_answers(f), _answers(f, recheck=True))


def _gates(f):
    answers = _answers(f)
    return sc.decision_gates(_agreement(f), _strata(f), sc.signal_relevance(answers), sc.term_relevance(answers),
                             sc.recheck_overall(_kappas(f)))


register("recheck_kappa", """SELECT field, field_group, round(observed, 9) AS percent_agreement, round(kappa, 9) AS kappa, n
    FROM scored_kappas""", SCORE)(_kappas)
register("recheck_overall", """SELECT round(core_mean, 9) AS overall_percent_agreement,
    round(rel_mean, 9) AS relevance_overall_percent_agreement, round(kappa_mean, 9) AS relevance_kappa_mean,
    round(label_kappa, 9) AS label_kappa, core_mean >= 0.8 AND label_kappa >= 0.6 AS qc_pass FROM qc""", SCORE)(
    lambda f: sc.recheck_overall(_kappas(f)))
register("decision_gates", "SELECT gate, name, passed FROM gates", SCORE)(_gates)
register("training_rule", """SELECT CASE WHEN count(*) FILTER (passed) > 0 THEN 'Use English-interpretable, non-short '||
    string_agg(name, ', ' ORDER BY name) FILTER (passed)||' reviews with weak_label_needs_review=0; exclude the audit sample from training. Keep all failed classes in manual review until the rules are revised.'
    ELSE 'Do not use any weak-label class for automatic training yet; keep the audited rows as a validation set and revise the weak-label rules.'
    END AS recommended_training_rule FROM gates WHERE gate = 'training_class'""", SCORE)(lambda f: sc.training_rule(_gates(f)))
register("signal_verdict", """SELECT name, round(CASE WHEN fired = 0 THEN 0 ELSE hits::DOUBLE / fired END, 9) AS estimate,
    CASE WHEN fired > 0 AND hits >= 0.8 * fired THEN 'retain' WHEN fired > 0 AND hits >= 0.6 * fired THEN 'refine' ELSE 'remove' END AS verdict
    FROM (SELECT signal AS name, hits, fired FROM signals UNION ALL SELECT term, hits, fired FROM broad)""", SCORE)(
    lambda f: (lambda a: sc.signal_verdict(sc.signal_relevance(a), "signal").unionByName(
        sc.signal_verdict(sc.term_relevance(a), "term")))(_answers(f)))
