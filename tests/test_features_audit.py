import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedfold.functions.stats import wilson_columns
from feedfold.operators import audit_sample as sm
from feedfold.operators import audit_score as sc
from feedfold.operators import features as fe
from feedfold.operators import profile
from feedfold.sources.lexicon import BROAD_TERMS, ISSUE_SIGNALS


def view(spark, rows):
    data = [(f"id-{i}", f"s-{i}", "Example", "Testing", "us", rating, title, body, lang, "2026-07-14 02:43:05")
            for i, (rating, title, body, lang) in enumerate(rows)]
    return spark.createDataFrame(data, """review_id string, source_review_id string, app_name string, vertical_name string,
        storefront string, rating long, title string, body string, detected_language string, published_at string""").withColumn(
        "published_at", F.col("published_at").cast("timestamp"))


def flag_rows(spark, rows):
    return spark.createDataFrame(rows, "review_id string, flag_type string")


def test_feature_row(spark):
    table = fe.review_features(
        view(spark, [(3, "Great but terrible!", "bad?", "unknown"), (1, None, "The app crashes whenever I log in", "en"),
                     (5, "LOGIN", "after the latest version; it crashes. The menu is difficult   to use, but adaptation", None)]),
        flag_rows(spark, [("id-0", t) for t in ("rating_text_mismatch", "too_short_review", "non_english_or_unknown_language")]))
    assert tuple(table.columns) == fe.FEATURE_COLUMNS and len(fe.FEATURE_COLUMNS) == 39
    first, second, third = table.orderBy("review_id").collect()
    assert (first.published_year, first.published_month, first.published_day_of_week, first.published_hour) == (2026, 7, "Tuesday", 2)
    assert (first.quality_flag_count, first.weak_label, first.weak_label_needs_review) == (3, "neutral", 1)
    assert first.weak_label_noise_reasons == ("rating_text_mismatch|mixed_sentiment_keywords|neutral_rating|"
                                              "too_short_review|non_english_or_unknown_language")
    assert (first.question_mark_count, first.exclamation_mark_count, first.body_word_count) == (1, 1, 1)
    assert (second.issue_performance_crash, second.issue_login_account, second.weak_label, second.title) == (1, 1, "negative", "")
    assert (third.issue_login_account, third.issue_update_version, third.issue_usability_navigation, third.issue_ads) == (1, 1, 1, 0)
    assert (third.weak_label_noise_reasons, third.detected_language) == ("non_english_or_unknown_language", "unknown")
    summary = {(r.section, r.item): r.value for r in fe.feature_summary(table).collect()}
    assert summary[("totals", "rows")] == 3 and summary[("totals", "needs_review_share")] == round(2 / 3, 16)
    exact = {r.column_name: (r.missing_count, r.unique_values, r.dtype) for r in profile.column_profile(table).collect()}
    rough = {r.column_name: (r.missing_count, r.unique_values, r.dtype) for r in profile.column_profile(table, True).collect()}
    assert exact == rough and exact["rating"] == (0, 3, "bigint")


def test_bad_values_are_errors(spark):
    rating = spark.createDataFrame([(0,)], "rating long")
    with pytest.raises(Exception, match="1 to 5"):
        rating.select(fe.weak_label()).collect()
    assert rating.select(fe.weak_label(strict=False)).first()[0] is None
    with pytest.raises(Exception, match="unsupported"):
        fe.flag_one_hot(flag_rows(spark, [("id", "possible_spam")])).collect()


@pytest.mark.parametrize("hits,n,expected", [
    (0, 0, (0.0, 0.0, 0.0)), (35, 40, (0.875, 0.7388757932976187, 0.9454058022645873)),
    (30, 80, (0.375, 0.2769401625800477, 0.484514771486096)), (10, 10, (1.0, None, 1.0))])
def test_wilson(spark, hits, n, expected):
    row = spark.createDataFrame([(hits, n)], "h long, n long").select(*wilson_columns(F.col("h"), F.col("n"))).first()
    for got, want in zip((row.estimate, row.lower, row.upper), expected):
        assert want is None or got == pytest.approx(want, abs=1e-12)


def test_weighted_agreement_and_gates(spark):
    strata = spark.createDataFrame(
        [("negative", 0, 20, 19, 0, 0), ("negative", 1, 20, 16, 1, 0), ("neutral", 0, 0, 0, 0, 0), ("neutral", 1, 40, 22, 21, 2),
         ("positive", 0, 20, 20, 5, 0), ("positive", 1, 20, 5, 5, 9)],
        "weak_label string, flag int, n long, agree_n long, mixed_n long, unclear_n long")
    cells = spark.createDataFrame([("negative", 0, 607), ("negative", 1, 76), ("neutral", 1, 83), ("positive", 0, 452), ("positive", 1, 82)],
                                  "weak_label string, flag int, population_n long")
    rows = {r.weak_label: r for r in sc.class_agreement(strata, cells).collect()}
    assert rows["negative"].weighted_estimate == pytest.approx(0.9333089311859444, abs=1e-12)
    assert (rows["negative"].weight_0, rows["negative"].weight_1) == pytest.approx((0.8887262079062958, 0.11127379209370425))
    assert rows["neutral"].weighted_estimate == pytest.approx(0.55) and rows["neutral"].weight_0 == 0.0
    empty = spark.createDataFrame([("x", 0.7)], "signal string, estimate double")
    gates = sc.decision_gates(sc.class_agreement(strata, cells), strata, empty, empty.withColumnRenamed("signal", "term"))
    passed = {(r.gate, r.name): r.passed for r in gates.collect()}
    assert passed[("class", "negative")] and passed[("training_class", "negative")]
    assert not passed[("training_class", "neutral")] and not passed[("training_class", "positive")] and not passed[("signal", "x")]
    assert "non-short negative reviews" in sc.training_rule(gates).first()[0]
    assert "Do not use any" in sc.training_rule(gates.filter("NOT passed")).first()[0]
    assert sc.signal_verdict(empty, "signal").first().verdict == "refine"


def test_kappa(spark):
    fields = [*sc.CORE_FIELDS, *sc.RELEVANCE_FIELDS]
    schema = "sample_id string, " + ", ".join(f"{f} string" for f in fields)
    pairs = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15
    left = spark.createDataFrame([(str(i), p[0], *["x"] * 12) for i, p in enumerate(pairs)], schema)
    right = spark.createDataFrame([(str(i), p[1], *["x"] * 12) for i, p in enumerate(pairs)], schema)
    rows = {r.field: r for r in sc.recheck_kappa(left, right).collect()}
    assert rows["apparent_sentiment"].kappa == pytest.approx(0.4) and rows["apparent_sentiment"].n == 50
    assert rows["mixed_sentiment"].kappa == 1.0
    overall = sc.recheck_overall(sc.recheck_kappa(left, right)).first()
    assert overall.overall_percent_agreement == pytest.approx((0.7 + 2) / 3) and overall.qc_pass


def people_rows(n, seed, apps=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice(["negative", "negative", "positive", "positive", "neutral"])
        flag = 1 if label == "neutral" else rng.randrange(2)
        goals = [int(g == "reason:neutral_rating" and label == "neutral") or
                 int(rng.random() < (0.04 if g in sm.RARE_POINTS else 0.12)) for g in sm.TARGETS]
        cell = "neutral" if label == "neutral" else f"{label}|{flag}"
        app = "app0" if rng.random() < 0.5 else f"app{rng.randrange(apps)}"
        rows.append((f"id{i:04d}", app, "v", label, flag, "", cell, f"{rng.random():.12f}", *goals))
    return rows


def people_frame(spark, rows):
    goals = ", ".join(f"`{g}` int" for g in sm.TARGETS)
    return spark.createDataFrame(rows, f"""review_id string, app_name string, vertical_name string, weak_label string,
        weak_label_needs_review int, weak_label_noise_reasons string, cell string, rank string, {goals}""")


def missing(rows):
    return {g: max(0, n - sum(r[8 + i] for r in rows)) for i, (g, n) in enumerate(sm.TARGETS.items())}


def total_penalty(rows, apps):
    counts = Counter(r[1] for r in rows)
    return 100 * sum(missing(rows).values()) + sum(max(0, 8 - counts[a]) for a in apps)


@pytest.mark.parametrize("seed", [1, 2])
def test_booster_equals_brute_force(spark, seed):
    rows = people_rows(330, seed)
    frame = people_frame(spark, rows).cache()
    core_frame = sm.coverage_floor(frame)
    core_ids = {r.review_id for r in core_frame.collect()}
    core = [r for r in rows if r[0] in core_ids]
    assert len(core) == 120 and Counter(r[6] for r in core) == Counter(sm.CORE_QUOTAS)
    assert sm.core_shortages(core_frame).isEmpty() and sm.uncovered_apps(frame, core_frame, 5).isEmpty()

    booster = []
    for _ in range(30):
        short, counts = missing(core + booster), Counter(r[1] for r in core + booster)
        weight = {g: sm.RARE_POINTS.get(g, sm.POINTS[g.split(":")[0]]) for g in sm.TARGETS}
        rest = [r for r in rows if r not in core and r not in booster]
        booster.append(max(rest, key=lambda r: (
            sum(weight[g] for i, g in enumerate(sm.TARGETS) if r[8 + i] and short[g]) + (10 if counts[r[1]] < 8 else 0), -float(r[7]))))
    greedy = sm.booster_sample(frame, core_frame, repair=False)
    assert {r.review_id for r in greedy.collect()} == {r[0] for r in booster}

    apps = sorted({r[1] for r in rows})
    while (now := total_penalty(core + booster, apps)) > 0:
        options = []
        for place, old in enumerate(booster):
            kept = core + [r for r in booster if r != old]
            options += [(total_penalty(kept + [c], apps), c[0], place, c) for c in rows if c not in core and c not in booster]
        best = min(options, key=lambda o: o[:3])
        if best[0] >= now:
            break
        booster[best[2]] = best[3]
    repaired = sm.booster_sample(frame, core_frame)
    assert {r.review_id for r in repaired.collect()} == {r[0] for r in booster}


def test_repair_counts_every_app(spark):
    """25 apps: more than 150 rows can cover, and no list of apps is cut."""
    rows = people_rows(700, 4, apps=25)
    frame = people_frame(spark, rows).cache()
    core_ids = {r.review_id for r in sm.stratified_core(frame).collect()}
    core, apps = [r for r in rows if r[0] in core_ids], sorted({r[1] for r in rows})
    assert len(apps) == 25
    tally = sm._Tally(frame.filter(F.col("review_id").isin(*core_ids)).collect(), sm.ISSUE_TERMS)
    assert tally.penalty(len(apps)) == total_penalty(core, apps)
    greedy = {r.review_id for r in sm.booster_sample(frame, sm.stratified_core(frame), repair=False).collect()}
    booster = {r.review_id for r in sm.booster_sample(frame, sm.stratified_core(frame)).collect()}
    picked = [r for r in rows if r[0] in booster]
    assert total_penalty(core + picked, apps) <= total_penalty(core + [r for r in rows if r[0] in greedy], apps)
    now = total_penalty(core + picked, apps)
    rest = [r for r in rows if r[0] not in core_ids and r[0] not in booster]
    assert all(total_penalty(core + [p for p in picked if p != old] + [new], apps) >= now for old in picked[::7] for new in rest[::3])


def test_core_reports_short_cells(spark):
    frame = people_frame(spark, people_rows(60, 3))
    assert not sm.core_shortages(sm.stratified_core(frame)).isEmpty()
    with pytest.raises(ValueError):
        sm.booster_sample(frame, sm.stratified_core(frame), strict=True)


def test_annotation_rules(spark):
    manifest = spark.createDataFrame([("m1", 1, '{"update_version":["version"]}'), ("m2", 0, "{}")],
                                     "sample_id string, fired int, matched_issue_terms_json string")
    manifest = manifest.select("sample_id", "matched_issue_terms_json", *[F.col("fired").alias(f"issue_{s}") for s in ISSUE_SIGNALS])
    def sheet(ids, sentiment):
        return spark.createDataFrame([(i, sentiment) for i in ids], "sample_id string, s string").select(
            "sample_id", *[(F.col("s") if c == "apparent_sentiment" else F.lit("0")).alias(c) for c in sm.ANSWER_COLUMNS])
    good = {r.sample_id: r for r in sc.canonical_answers(manifest, sheet(["m1", "m2"], " Mixed ")).collect()}
    assert (good["m1"].apparent_sentiment, good["m1"].rating_label_agreement, good["m1"].mixed_sentiment) == ("mixed", "disagree", "no")
    assert good["m1"].issue_ads_relevance == "not_relevant" and good["m2"].issue_ads_relevance == "not_triggered"
    assert good["m1"].version_term_relevance == "not_relevant" and good["m1"].service_term_relevance == "not_triggered"
    sc.require_valid(sc.annotation_problems(manifest, sheet(["m1", "m2"], "")))
    problems = sorted((r.problem, r.sample_id) for r in sc.annotation_problems(manifest, sheet(["m1", "m1", "x"], "bad")).collect())
    assert problems == [("invalid_apparent_sentiment", "m1"), ("invalid_apparent_sentiment", "m1"), ("missing_id", "m2"),
                        ("repeated_id", "m1"), ("unknown_id", "x")]
    subset = sc.annotation_problems(manifest, sheet(["m1"], "neutral"), require_all=False)
    assert subset.isEmpty()
    with pytest.raises(ValueError):
        sc.require_valid(sc.annotation_problems(manifest, sheet(["m1"], "neutral")))
    assert set(BROAD_TERMS) == {"service", "account", "version"}
