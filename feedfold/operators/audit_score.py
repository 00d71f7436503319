"""Scoring of human annotations against the weak labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedfold.functions.stats import share, wilson_bounds, wilson_columns
from feedfold.operators.audit_sample import ANSWER_COLUMNS
from feedfold.operators.expect import unique_rule
from feedfold.operators.features import NOISE_REASONS, WEAK_LABELS
from feedfold.sources.lexicon import BROAD_TERMS, ISSUE_SIGNALS

# Spellings of each answer, and the answers allowed per field.
AGREEMENT = {"1": "agree", "yes": "agree", "agree": "agree", "0": "disagree", "no": "disagree",
             "disagree": "disagree", "": "unclear"}
YES_NO = {"1": "yes", "yes": "yes", "0": "no", "no": "no", "": "unclear"}
SENTIMENT = {"": "unclear"}
RELEVANT = ("1", "yes", "relevant")
NOT_RELEVANT = ("0", "no", "not_relevant")
DOMAINS = {
    "apparent_sentiment": ("negative", "neutral", "positive", "mixed", "unclear"),
    "rating_label_agreement": ("agree", "disagree", "unclear"),
    "mixed_sentiment": ("yes", "no", "unclear"),
    "appears_english": ("yes", "no", "unclear"),
    "text_interpretable": ("yes", "no", "unclear"),
}
CORE_FIELDS = ("apparent_sentiment", "rating_label_agreement", "mixed_sentiment")
RELEVANCE_FIELDS = (*(f"issue_{s}_relevance" for s in ISSUE_SIGNALS), *(f"{t}_term_relevance" for t in BROAD_TERMS))

# Decision thresholds.
MIN_AGREEMENT = 0.80
MAX_UNCLEAR = 0.10
MAX_MIXED = 0.20
MIN_RELEVANCE = 0.80
REFINE_RELEVANCE = 0.60
MIN_KAPPA = 0.60


def _canonical(answer: Column, spellings: dict[str, str]) -> Column:
    value = F.lower(answer)
    table = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    return F.coalesce(F.element_at(table, value), value)


def _relevance(answer: Column, triggered: Column) -> Column:
    value = F.lower(answer)
    return (F.when(value.isin(*RELEVANT), "relevant")
            .when(value.isin(*NOT_RELEVANT), F.when(triggered, "not_relevant").otherwise("not_triggered"))
            .when(value == "not_triggered", "not_triggered").otherwise("unclear"))


def triggers() -> dict[str, Column]:
    """Whether each relevance answer applies: the signal fired, or a signal matched the broad term."""
    matched = F.from_json("matched_issue_terms_json", "map<string,array<string>>")
    return {
        **{f"issue_{s}_relevance": F.col(f"issue_{s}").cast("string") == "1" for s in ISSUE_SIGNALS},
        **{f"{t}_term_relevance": F.array_contains(F.flatten(F.map_values(matched)), t) for t in BROAD_TERMS},
    }


def canonical_answers(manifest: DataFrame, annotations: DataFrame) -> DataFrame:
    """Manifest joined with its annotations, every answer in canonical spelling (annotation wins)."""
    answers = annotations.select("sample_id", *[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ANSWER_COLUMNS])
    joined = manifest.drop(*ANSWER_COLUMNS).join(answers, "sample_id")
    fires = triggers()
    return joined.withColumns({
        "apparent_sentiment": _canonical(F.col("apparent_sentiment"), SENTIMENT),
        "rating_label_agreement": _canonical(F.col("rating_label_agreement"), AGREEMENT),
        **{c: _canonical(F.col(c), YES_NO) for c in ("mixed_sentiment", "appears_english", "text_interpretable")},
        **{c: _relevance(F.col(c), fires[c]) for c in RELEVANCE_FIELDS},
    })


def annotation_problems(manifest: DataFrame, annotations: DataFrame, require_all: bool = True) -> DataFrame:
    """Every broken rule as a row (problem, sample_id): repeated, missing or unknown ids, bad answers."""
    absent = sorted(set(ANSWER_COLUMNS) - set(annotations.columns))
    if absent:
        raise ValueError(f"annotations are missing columns: {absent}")
    ids, known = annotations.select("sample_id"), manifest.select("sample_id")

    def problem(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("problem"), "sample_id")

    parts = [
        problem("repeated_id", unique_rule(ids, "annotations", ["sample_id"])
                .select(F.col("violating_key").alias("sample_id"))),
        problem("unknown_id", ids.distinct().join(known, "sample_id", "left_anti")),
    ]
    if require_all:
        parts.append(problem("missing_id", known.join(ids, "sample_id", "left_anti")))
    answers = canonical_answers(manifest, annotations)
    bad = F.array_compact(F.array(*[
        F.when(~F.col(c).isin(*allowed), F.lit(f"invalid_{c}")) for c, allowed in DOMAINS.items()]))
    parts.append(answers.select(F.explode(bad).alias("problem"), "sample_id"))
    return reduce(DataFrame.unionByName, parts)


def require_valid(problems: DataFrame) -> None:
    found = problems.orderBy("problem", "sample_id").limit(5).collect()
    if found:
        raise ValueError("annotations are invalid: " + "; ".join(f"{r.problem} {r.sample_id}" for r in found))


def is_mixed() -> Column:
    return (F.col("mixed_sentiment") == "yes") | (F.col("apparent_sentiment") == "mixed")


def agrees() -> Column:
    return F.col("rating_label_agreement") == "agree"


def is_unclear() -> Column:
    return F.col("apparent_sentiment") == "unclear"


def population_cells(features: DataFrame) -> DataFrame:
    return features.groupBy("weak_label", F.col("weak_label_needs_review").cast("int").alias("flag")).agg(
        F.count("*").alias("population_n"))


def class_strata(answers: DataFrame) -> DataFrame:
    """Core counts per label and flag; all six cells are present, empty ones with zeros."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(l).alias("weak_label"), F.lit(f).alias("flag")) for l in WEAK_LABELS for f in (0, 1)]))
    spark = answers.sparkSession
    grid = spark.range(1).select(cells.alias("x")).select("x.*")
    core = answers.filter(F.col("sample_role") == "core").groupBy(
        "weak_label", F.col("weak_label_needs_review").cast("int").alias("flag")).agg(
        F.count("*").alias("n"), F.count_if(agrees()).alias("agree_n"), F.count_if(is_mixed()).alias("mixed_n"),
        F.count_if(is_unclear()).alias("unclear_n"))
    return grid.join(core, ["weak_label", "flag"], "left").fillna(0)


def class_agreement(strata: DataFrame, cells: DataFrame) -> DataFrame:
    """Per label: raw agreement with interval, population-weighted agreement, mixed and unclear rates.

    Weights are population shares of the flag strata; a stratum without sampled rows contributes
    nothing and the others are not scaled up for it.
    """
    weighted = strata.join(cells, ["weak_label", "flag"], "left").fillna(0, ["population_n"])
    totals = weighted.groupBy("weak_label").agg(F.sum("population_n").alias("population_total"))
    weighted = weighted.join(totals, "weak_label").withColumn(
        "weight", F.when(F.col("n") > 0, share(F.col("population_n"), F.col("population_total"))).otherwise(0.0))
    by_label = weighted.groupBy("weak_label").agg(
        *[F.sum(c).alias(c) for c in ("n", "agree_n", "mixed_n", "unclear_n")],
        F.sum(F.col("weight") * share(F.col("agree_n"), F.col("n"))).alias("weighted_estimate"),
        *[F.sum(F.when(F.col("flag") == f, F.col("weight"))).alias(f"weight_{f}") for f in (0, 1)])
    n = F.col("n")
    return by_label.select(
        "weak_label", *wilson_columns(F.col("agree_n"), n, "raw_"), "weighted_estimate", "weight_0", "weight_1",
        wilson_bounds(F.col("mixed_n"), n)[0].alias("mixed_rate"),
        wilson_bounds(F.col("unclear_n"), n)[0].alias("unclear_rate"))


def stratum_agreement(strata: DataFrame) -> DataFrame:
    return strata.select("weak_label", "flag", *wilson_columns(F.col("agree_n"), F.col("n"), "agree_"),
                         *wilson_columns(F.col("mixed_n"), F.col("n"), "mixed_"))


def confusion_matrix(answers: DataFrame) -> DataFrame:
    return answers.groupBy("weak_label", "apparent_sentiment").agg(F.count("*").alias("n"))


def noise_validity(answers: DataFrame) -> DataFrame:
    """How often each warning was right, judged by a rule of its own."""
    interpretable, sentiment = F.col("text_interpretable"), F.col("apparent_sentiment")
    # Fixed order of reasons; every reason keeps its row, also without any flagged review.
    rules = dict(zip(NOISE_REASONS, (
        F.col("rating_label_agreement") == "disagree",
        is_mixed(),
        (sentiment != "neutral") | is_mixed() | ~agrees(),
        (interpretable == "no") | is_unclear(),
        (F.col("appears_english") == "no") | (interpretable == "no"),
    )))
    reasons = F.split("weak_label_noise_reasons", r"\|")
    return _successes(answers, "reason", {
        r: (F.array_contains(reasons, r), rule) for r, rule in rules.items()})


def _successes(answers: DataFrame, name: str, cases: dict[str, tuple[Column, Column]],
               also: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """One pass of conditional counts, unpivoted to one Wilson row per case."""
    also = also or {}
    measures = []
    for case, (applies, success) in cases.items():
        measures += [F.count_if(applies).alias(f"{case}.total"), F.count_if(applies & success).alias(f"{case}.hits")]
        measures += [F.count_if(applies & cond).alias(f"{case}.{label}") for label, cond in also.get(case, {}).items()]
    labels = sorted({label for extra in also.values() for label in extra})
    one = answers.agg(*measures)
    rows = one.select(F.explode(F.array(*[F.struct(
        F.lit(case).alias(name), F.col(f"`{case}.hits`").alias("hits"), F.col(f"`{case}.total`").alias("n"),
        *[F.col(f"`{case}.{label}`").alias(label) for label in labels]) for case in cases])).alias("x")).select("x.*")
    return rows.select(name, *wilson_columns(F.col("hits"), F.col("n")), *labels)


def flagged_comparison(answers: DataFrame) -> DataFrame:
    """Disagreement-or-unclear rate by flag, and the difference flagged minus unflagged."""
    core = answers.filter(F.col("sample_role") == "core")
    trouble = ~agrees() | is_unclear()
    by_flag = _successes(core, "flag", {
        str(f): (F.col("weak_label_needs_review").cast("int") == f, trouble) for f in (0, 1)})
    gap = by_flag.agg(
        F.max(F.when((F.col("flag") == "1") & (F.col("total") > 0), F.col("estimate"))).alias("one"),
        F.max(F.when((F.col("flag") == "0") & (F.col("total") > 0), F.col("estimate"))).alias("zero"))
    return by_flag.withColumn("point_difference", gap.select(F.col("one") - F.col("zero")).scalar())


def _relevance_table(answers: DataFrame, name: str, fields: dict[str, tuple[Column, str]]) -> DataFrame:
    return _successes(
        answers, name, {k: (fired, F.col(field) == "relevant") for k, (fired, field) in fields.items()},
        {k: {v: F.col(field) == v for v in ("not_relevant", "unclear")} for k, (_, field) in fields.items()})


def signal_relevance(answers: DataFrame) -> DataFrame:
    fires = triggers()
    return _relevance_table(answers, "signal", {s: (fires[f"issue_{s}_relevance"], f"issue_{s}_relevance")
                                                for s in ISSUE_SIGNALS})


def term_relevance(answers: DataFrame) -> DataFrame:
    fires = triggers()
    return _relevance_table(answers, "term", {t: (fires[f"{t}_term_relevance"], f"{t}_term_relevance")
                                              for t in BROAD_TERMS})


def recheck_kappa(answers: DataFrame, recheck: DataFrame) -> DataFrame:
    """Agreement and Cohen's kappa per field between two annotations of the same rows."""
    fields = [*CORE_FIELDS, *RELEVANCE_FIELDS]

    second = recheck.select("sample_id", *[F.col(f).alias(f"again_{f}") for f in fields])
    both = answers.select("sample_id", *fields).join(second, "sample_id")
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("left"), F.col(f"again_{f}").alias("right"))
                               for f in fields])).alias("x")
    pairs = both.select(pair).select("x.*").groupBy("field", "left", "right").agg(
        F.count("*").alias("n"))  # at most fields x answers x answers rows
    observed = pairs.groupBy("field").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("left") == F.col("right"), F.col("n"))), F.lit(0)).alias("same"))
    left = pairs.groupBy("field", F.col("left").alias("answer")).agg(F.sum("n").alias("left_n"))
    right = pairs.groupBy("field", F.col("right").alias("answer")).agg(F.sum("n").alias("right_n"))
    products = left.join(right, ["field", "answer"]).groupBy("field").agg(
        F.sum(F.col("left_n") * F.col("right_n")).alias("products"))
    scored = observed.join(products, "field", "left").fillna(0, ["products"]).withColumn(
        "percent_agreement", share(F.col("same"), F.col("n"))).withColumn(
        "expected", share(F.col("products"), F.col("n") * F.col("n")))
    kappa = F.when(F.col("expected") < 1, F.try_divide(F.col("percent_agreement") - F.col("expected"),
                                                       1 - F.col("expected"))).otherwise(1.0)
    return scored.select("field", F.when(F.col("field").isin(*CORE_FIELDS), "core").otherwise("relevance").alias("field_group"),
                         "percent_agreement", kappa.alias("kappa"), "n")


def recheck_overall(kappas: DataFrame) -> DataFrame:
    """Means over the core and the relevance fields, and whether the quality check passes."""
    core = F.col("field_group") == "core"
    return kappas.agg(
        F.avg(F.when(core, F.col("percent_agreement"))).alias("overall_percent_agreement"),
        F.avg(F.when(~core, F.col("percent_agreement"))).alias("relevance_overall_percent_agreement"),
        F.avg(F.when(~core, F.col("kappa"))).alias("relevance_kappa_mean"),
        F.max(F.when(F.col("field") == "rating_label_agreement", F.col("kappa"))).alias("label_kappa"),
    ).withColumn("qc_pass", (F.col("overall_percent_agreement") >= MIN_AGREEMENT) & (F.col("label_kappa") >= MIN_KAPPA))


def decision_gates(agreement: DataFrame, strata: DataFrame, signals: DataFrame, terms: DataFrame,
                   qc: DataFrame | None = None) -> DataFrame:
    """(gate, name, passed): classes, training classes, signals, broad terms and the recheck."""
    def gate(name: str, df: DataFrame, item: str, passed: Column) -> DataFrame:
        return df.select(F.lit(name).alias("gate"), F.col(item).alias("name"), passed.alias("passed"))

    mixed = share(F.col("mixed_n"), F.col("n"))
    parts = [
        gate("class", agreement, "weak_label",
             (F.col("weighted_estimate") >= MIN_AGREEMENT) & (F.col("unclear_rate") <= MAX_UNCLEAR)),
        gate("training_class", strata.filter("flag = 0"), "weak_label",
             (F.col("n") > 0) & (share(F.col("agree_n"), F.col("n")) >= MIN_AGREEMENT) & (mixed <= MAX_MIXED)),
        gate("signal", signals, "signal", F.col("estimate") >= MIN_RELEVANCE),
        gate("broad_term", terms, "term", F.col("estimate") >= MIN_RELEVANCE),
    ]
    if qc is not None:
        parts.append(qc.select(F.lit("recheck").alias("gate"), F.lit("qc").alias("name"), F.col("qc_pass").alias("passed")))
    return reduce(DataFrame.unionByName, parts)


def training_rule(gates: DataFrame) -> DataFrame:
    """The recommendation as text: which labels may be used for training."""
    passing = gates.filter((F.col("gate") == "training_class") & F.col("passed")).agg(
        F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("labels"))  # at most three labels
    # Wording of the recommendation.
    return passing.select(F.when(F.col("labels") != "", F.concat(
        F.lit("Use English-interpretable, non-short "), F.col("labels"),
        F.lit(" reviews with weak_label_needs_review=0; exclude the audit sample from training. "
              "Keep all failed classes in manual review until the rules are revised.")))
        .otherwise("Do not use any weak-label class for automatic training yet; keep the audited rows as a "
                   "validation set and revise the weak-label rules.").alias("recommended_training_rule"))


def signal_verdict(relevance: DataFrame, name: str) -> DataFrame:
    """retain, refine or remove by relevance."""
    estimate = F.col("estimate")
    return relevance.select(F.col(name).alias("name"), "estimate", F.when(estimate >= MIN_RELEVANCE, "retain")
                            .when(estimate >= REFINE_RELEVANCE, "refine").otherwise("remove").alias("verdict"))
