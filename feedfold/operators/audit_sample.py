"""Audit sampling: stratified core, app coverage, targeted booster, manifest and templates.

The random order is a digest of seed and review id. All selection runs on a narrow population frame;
texts are joined only for the selected rows (at most 150).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedfold.functions.stats import stable_rank
from feedfold.functions.text import has_term
from feedfold.operators.features import combined_text, with_combined_text
from feedfold.session import join_dimension, written
from feedfold.sources.lexicon import BROAD_TERMS, ISSUE_SIGNALS, ISSUE_TERMS, Lexicon

# Seed, sizes, quotas per cell, coverage floors.
SEED = 20260730
CORE_QUOTAS = {"negative|0": 20, "negative|1": 20, "positive|0": 20, "positive|1": 20, "neutral": 40}
CORE_SIZE = sum(CORE_QUOTAS.values())
BOOSTER_SIZE = 30
CORE_APP_FLOOR = 5
TOTAL_APP_FLOOR = 8
RECHECK_QUOTAS = {"negative": 8, "neutral": 7, "positive": 8}

# How many sampled rows should show each reason, signal and broad term.
REASON_TARGETS = {"mixed_sentiment_keywords": 14, "rating_text_mismatch": 12, "neutral_rating": 40,
                  "too_short_review": 15, "non_english_or_unknown_language": 12}
SIGNAL_TARGET = 8
TERM_TARGET = 8
# Signals whose matched terms count towards a broad term's target.
TERM_SIGNALS = ("update_version", "login_account", "delivery_service")

# Points of an unmet target in the greedy choice, and of an app below its floor.
POINTS = {"reason": 150, "signal": 100, "term": 100}
RARE_POINTS = {"reason:mixed_sentiment_keywords": 3000, "signal:performance_crash": 500,
               "signal:usability_navigation": 500, "term:version": 500}
APP_POINTS = 10

TARGETS = {
    **{f"reason:{r}": n for r, n in REASON_TARGETS.items()},
    **{f"signal:{s}": SIGNAL_TARGET for s in ISSUE_SIGNALS},
    **{f"term:{t}": TERM_TARGET for t in BROAD_TERMS},
}


def term_hits(text: Column, lexicon: Lexicon = ISSUE_TERMS, low: Column | None = None) -> dict[str, Column]:
    """1 when a broad term is a lexicon term and occurs in the text."""
    listed = {t for terms in lexicon.values() for t in terms}
    return {t: (has_term(text, (t,), low) if t in listed else F.lit(False)).cast("int") for t in BROAD_TERMS}


def matched_terms(text: Column, lexicon: Lexicon = ISSUE_TERMS, low: Column | None = None) -> Column:
    """MAP signal -> matched terms in lexicon order; terms are tried only where the signal fires."""
    names = sorted(lexicon)
    none = F.array().cast("array<string>")
    found = [F.when(F.col(f"issue_{s}") == 1, F.array_compact(F.array(*[
        F.when(has_term(text, (t,), low), F.lit(t)) for t in lexicon[s]]))).otherwise(none) for s in names]
    return F.map_from_arrays(F.array(*[F.lit(s) for s in names]), F.array(*found))


def term_usage(features: DataFrame, terms: DataFrame, lexicon: Lexicon = ISSUE_TERMS) -> DataFrame:
    """Every row of a lexicon table with the number of reviews in which its term occurs."""
    found = with_combined_text(features).select(
        F.explode(matched_terms(F.col("combined_text"), lexicon, F.col("folded_text"))).alias("signal", "found"))
    used = found.select("signal", F.explode("found").alias("term")).groupBy("signal", "term").agg(F.count("*").alias("review_count"))
    return terms.join(used, ["signal", "term"], "left").select(
        "version", "signal", "term", "position", F.coalesce("review_count", F.lit(0)).alias("review_count"))


def population(features: DataFrame, lexicon: Lexicon = ISSUE_TERMS, seed: int = SEED) -> DataFrame:
    """Narrow frame of everything the selection looks at."""
    reasons = F.split("weak_label_noise_reasons", r"\|")
    wanted = {
        **{f"reason:{r}": F.array_contains(reasons, r).cast("int") for r in REASON_TARGETS},
        **{f"signal:{s}": F.col(f"issue_{s}") for s in ISSUE_SIGNALS},
        **{f"term:{t}": hit for t, hit in term_hits(F.col("combined_text"), lexicon, F.col("folded_text")).items()},
    }
    cell = F.when(F.col("weak_label") == "neutral", "neutral").otherwise(
        F.concat_ws("|", "weak_label", "weak_label_needs_review"))
    return with_combined_text(features).select(
        "review_id", "app_name", "vertical_name", "weak_label", "weak_label_needs_review", "weak_label_noise_reasons",
        cell.alias("cell"), stable_rank("review_id", seed).alias("rank"), *[c.alias(n) for n, c in wanted.items()])


def _first(df: DataFrame, n: int, by: list[str], *order: Column | str) -> DataFrame:
    """First ``n`` rows per group, pruned within each task before the shuffle."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def _quota(cell: Column, quotas: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), cell)


def _within(df: DataFrame, quotas: dict[str, int], column: str, *order: Column | str) -> DataFrame:
    known = df.filter(F.col(column).isin(*quotas))
    return _first(known, max(quotas.values()), [column], *order).filter(
        F.col("place") <= _quota(F.col(column), quotas)).drop("place")


def stratified_core(people: DataFrame, quotas: dict[str, int] = CORE_QUOTAS) -> DataFrame:
    """The best-ranked rows of every label x flag cell."""
    return _within(people, quotas, "cell", "rank")


def coverage_floor(people: DataFrame, quotas: dict[str, int] = CORE_QUOTAS, floor: int = CORE_APP_FLOOR) -> DataFrame:
    """Core sample that first reserves each app's ``floor`` best-ranked rows, then fills the cells.

    Reserved rows and each cell's head are the only rows that can be chosen, so the second ranking
    sees a handful of rows per app and cell.
    """
    reserved = _first(people, floor, ["app_name"], "rank").select("review_id", F.lit(0).alias("turn"))
    heads = _first(people, max(quotas.values()), ["cell"], "rank").select("review_id", F.lit(1).alias("turn"))
    turns = reserved.unionByName(heads).groupBy("review_id").agg(F.min("turn").alias("turn"))
    return _within(people.join(turns, "review_id"), quotas, "cell", "turn", "rank").drop("turn")


def core_shortages(core: DataFrame, quotas: dict[str, int] = CORE_QUOTAS) -> DataFrame:
    """Cells that could not be filled."""
    counts = core.agg(*[F.count_if(F.col("cell") == c).alias(c) for c in quotas])
    return counts.unpivot([], [f"`{c}`" for c in quotas], "cell", "n").select(
        F.replace("cell", F.lit("`"), F.lit("")).alias("cell"), "n").withColumn(
        "missing", _quota(F.col("cell"), quotas) - F.col("n")).filter("missing > 0")


def uncovered_apps(people: DataFrame, sample: DataFrame, floor: int) -> DataFrame:
    """Apps with fewer than ``floor`` sampled rows."""
    have = sample.groupBy("app_name").agg(F.count("*").alias("n"))
    return (people.select("app_name").distinct().join(have, "app_name", "left")
            .select("app_name", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < floor))


def sample_shortages(people: DataFrame, core: DataFrame, booster: DataFrame, lexicon: Lexicon = ISSUE_TERMS) -> DataFrame:
    """(kind, item, missing): unfilled cells, apps below a floor in the core or the whole sample, unmet targets."""
    sample = core.unionByName(booster, allowMissingColumns=True)

    def apps(kind: str, rows: DataFrame, floor: int) -> DataFrame:
        return uncovered_apps(people, rows, floor).select(
            F.lit(kind).alias("kind"), F.col("app_name").alias("item"), (F.lit(floor) - F.col("n")).cast("bigint").alias("missing"))

    cells = core_shortages(core).select(F.lit("cell").alias("kind"), F.col("cell").alias("item"), F.col("missing").cast("bigint"))
    targets = booster_deficits(sample, lexicon).filter("deficit > 0").select(
        F.lit("target").alias("kind"), F.col("goal").alias("item"), F.col("deficit").cast("bigint").alias("missing"))
    return (cells.unionByName(apps("core_app", core, CORE_APP_FLOOR)).unionByName(apps("app", sample, TOTAL_APP_FLOOR))
            .unionByName(targets))


def require_complete(shortages: DataFrame) -> None:
    """Raise if the audit sample misses a quota, a floor or a target (a few dozen rows and one per app at most)."""
    found = [f"{r['kind']} {r['item']}: {r['missing']}" for r in shortages.toLocalIterator()]
    if found:
        raise ValueError("the audit sample is short: " + "; ".join(found))


def booster_deficits(sample: DataFrame, lexicon: Lexicon = ISSUE_TERMS) -> DataFrame:
    """Remaining need per reason, signal and broad term."""
    counted = {t for s in TERM_SIGNALS for t in lexicon[s]}
    sums = sample.agg(*[
        (F.lit(0) if g.startswith("term:") and g[5:] not in counted else F.coalesce(F.sum(f"`{g}`"), F.lit(0)))
        .cast("bigint").alias(g) for g in TARGETS])
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("goal"), F.lit(n).cast("bigint").alias("target"),
                                        F.col(f"`{g}`").alias("have")) for g, n in TARGETS.items()]))
    return sums.select(rows.alias("x")).select("x.*").withColumn(
        "deficit", F.greatest(F.lit(0), F.col("target") - F.col("have")))


class _Tally:
    """Counts of the sample under construction (at most 150 rows and 15 goals)."""

    def __init__(self, rows: list[Row], lexicon: Lexicon) -> None:
        listed = {t for s in TERM_SIGNALS for t in lexicon[s]}
        self.goals = [g for g in TARGETS if not g.startswith("term:") or g[5:] in listed]
        self.unreachable = sum(n for g, n in TARGETS.items() if g not in self.goals)
        self.have = {g: sum(r[g] for r in rows) for g in self.goals}
        self.apps: dict[str, int] = {}
        for r in rows:
            self.apps[r.app_name] = self.apps.get(r.app_name, 0) + 1

    def move(self, row: Row, step: int) -> None:
        for g in self.goals:
            self.have[g] += step * row[g]
        self.apps[row.app_name] = self.apps.get(row.app_name, 0) + step

    def unmet(self) -> list[str]:
        """Goals still short; one that the lexicon cannot reach stays short for ever."""
        return [g for g in TARGETS if g not in self.have or self.have[g] < TARGETS[g]]

    def covered(self) -> list[str]:
        return sorted(a for a, n in self.apps.items() if n >= TOTAL_APP_FLOOR)

    def penalty(self, app_count: int) -> int:
        """100 x missing targets, and the rows that all ``app_count`` apps lack for their floor."""
        missing = sum(max(0, TARGETS[g] - n) for g, n in self.have.items()) + self.unreachable
        present = sum(min(TOTAL_APP_FLOOR, n) for n in self.apps.values())
        return 100 * missing + TOTAL_APP_FLOOR * app_count - present


def _points(goals: list[str]) -> Column:
    total = F.lit(0)
    for g in goals:
        total = total + F.col(f"`{g}`") * RARE_POINTS.get(g, POINTS[g.split(":")[0]])
    return total


def _app_bonus(covered: list[str], bonus: int) -> Column:
    return F.when(F.col("app_name").isin(*covered), 0).otherwise(bonus) if covered else F.lit(bonus)


def booster_candidates(people: DataFrame, core: DataFrame, rounds: int = BOOSTER_SIZE) -> DataFrame:
    """The rows outside the core that any selection step could reach.

    Rows with the same goals and app score alike, so of each such group only the ``rounds`` best
    ranks matter for the greedy choice, and for the repair the smallest ids, one more than a booster
    can hold. This keeps the result exact while the loop reads a small table.
    """
    outside = people.join(F.broadcast(core.select("review_id")), "review_id", "left_anti")  # at most 120 rows
    alike = ["app_name", *[f"`{g}`" for g in TARGETS]]
    by_rank = _first(outside, rounds, alike, "rank").drop("place")
    by_id = _first(outside, rounds + 1, alike, "review_id").drop("place")
    return by_rank.unionByName(by_id).dropDuplicates(["review_id"])


def greedy_booster(candidates: DataFrame, core_rows: list[Row], lexicon: Lexicon = ISSUE_TERMS,
                   rounds: int = BOOSTER_SIZE) -> list[Row]:
    """Row after row, the one with most points under the targets still unmet; ties by rank.

    The order only changes when a target or an app floor is met, so one distributed top-k serves all
    rounds in between.
    """
    tally, chosen = _Tally(core_rows, lexicon), []
    while len(chosen) < rounds:
        state = (tally.unmet(), tally.covered())
        score = _points(state[0]) + _app_bonus(state[1], APP_POINTS)
        free = candidates.filter(~F.col("review_id").isin(*[r.review_id for r in chosen])) if chosen else candidates
        head = free.orderBy(score.desc(), "rank").limit(rounds - len(chosen)).collect()  # at most 30 rows
        if not head:
            raise ValueError("not enough rows for the booster sample")
        for row in head:
            chosen.append(row)
            tally.move(row, 1)
            if (tally.unmet(), tally.covered()) != state:
                break
    return chosen


def swap_repair(candidates: DataFrame, core_rows: list[Row], booster: list[Row], app_count: int,
                lexicon: Lexicon = ISSUE_TERMS, swaps: int = 100) -> list[Row]:
    """Best one-for-one booster swaps while they lower 100 x missing targets + missing app rows.

    Dropping a booster row leaves fixed weights, under which every candidate's gain is one expression;
    a single scan evaluates the at most 30 drops side by side for each candidate.
    """
    booster = list(booster)
    for _ in range(swaps):
        tally = _Tally([*core_rows, *booster], lexicon)
        penalty = tally.penalty(app_count)
        if penalty == 0:
            break
        trials = []
        for index, old in enumerate(booster):
            tally.move(old, -1)
            gain = sum((100 * F.col(f"`{g}`") for g in tally.unmet() if g in tally.have), F.lit(0))
            rest = tally.penalty(app_count) - gain - _app_bonus(tally.covered(), 1)
            trials.append(F.struct(rest.alias("penalty"), F.lit(index).alias("index")))
            tally.move(old, 1)
        free = candidates.filter(~F.col("review_id").isin(*[r.review_id for r in booster]))
        best = (free.withColumn("trial", F.array_min(F.array(*trials)))
                .orderBy("trial.penalty", "review_id").limit(1).collect())  # one row
        if not best or best[0].trial.penalty >= penalty:
            break
        booster[best[0].trial["index"]] = best[0]
    return booster


def booster_sample(people: DataFrame, core: DataFrame, lexicon: Lexicon = ISSUE_TERMS, repair: bool = True,
                   strict: bool = False) -> DataFrame:
    """Greedy booster, optionally repaired; ``strict`` raises when a target stays unmet."""
    core_rows = core.limit(CORE_SIZE + 1).collect()  # the core is bounded by its quotas
    app_count = people.agg(F.count_distinct("app_name")).first()[0]
    candidates = written(booster_candidates(people, core), "booster-candidates")
    rows = greedy_booster(candidates, core_rows, lexicon)
    if repair:
        rows = swap_repair(candidates, core_rows, rows, app_count, lexicon)
    tally = _Tally([*core_rows, *rows], lexicon)
    if strict and tally.penalty(app_count):
        raise ValueError(f"booster targets are unmet: {tally.unmet()}")
    chosen = people.sparkSession.createDataFrame([(r.review_id,) for r in rows], "review_id string")
    return people.join(F.broadcast(chosen), "review_id")


def audit_manifest(core: DataFrame, booster: DataFrame, features: DataFrame,
                   lexicon: Lexicon = ISSUE_TERMS) -> DataFrame:
    """Sampled rows with review context, matched terms and numbered ids (booster first, then by rank)."""
    picked = core.select("review_id", "rank", F.lit("core").alias("sample_role")).unionByName(
        booster.select("review_id", "rank", F.lit("booster").alias("sample_role")))
    rows = features.join(F.broadcast(picked), "review_id")  # at most 150 rows
    numbered = rows.withColumn("number", F.row_number().over(W.orderBy("sample_role", "rank")))
    return numbered.select(
        F.format_string("audit_v1_%03d", "number").alias("sample_id"), "sample_role", "review_id", "source_review_id",
        "app_name", "vertical_name", "storefront", "rating", "title", "body", "detected_language", "published_at",
        "weak_label", "weak_label_needs_review", "weak_label_noise_reasons", *[f"issue_{s}" for s in ISSUE_SIGNALS],
        "issue_signal_count", F.to_json(matched_terms(combined_text(), lexicon)).alias("matched_issue_terms_json"),
        F.col("rank").alias("selection_rank"))


# The answers an annotator gives, in sheet order.
ANSWER_COLUMNS = ("apparent_sentiment", "rating_label_agreement", "mixed_sentiment", "appears_english",
                  "text_interpretable", *(f"issue_{s}_relevance" for s in ISSUE_SIGNALS),
                  *(f"{t}_term_relevance" for t in BROAD_TERMS), "annotation_notes")
CONTEXT_COLUMNS = ("sample_id", "app_name", "vertical_name", "title", "body", "detected_language",
                   "matched_issue_terms_json")


def annotation_template(manifest: DataFrame, with_rating: bool = True) -> DataFrame:
    """Context, blank answers, and only then the rating columns."""
    after = ("rating", "weak_label", "weak_label_needs_review", "weak_label_noise_reasons",
             *(f"issue_{s}" for s in ISSUE_SIGNALS)) if with_rating else ()
    return manifest.select(*CONTEXT_COLUMNS, *[F.lit("").alias(c) for c in ANSWER_COLUMNS], *after)


def sample_metadata(manifest: DataFrame, people: DataFrame) -> DataFrame:
    """Long-form (section, item, n): sample sizes and counts, and the population's label cells."""
    def counted(df: DataFrame, section: str, item: Column) -> DataFrame:
        return df.groupBy(item.alias("item")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "item", "n")

    reasons = manifest.select(F.explode(F.split("weak_label_noise_reasons", r"\|")).alias("reason")).filter("reason <> ''")
    signals = manifest.agg(*[F.coalesce(F.sum(f"issue_{s}"), F.lit(0)).alias(s) for s in ISSUE_SIGNALS]).unpivot(
        [], list(ISSUE_SIGNALS), "item", "n").select(F.lit("issue_signal").alias("section"), "item", "n")
    label_flag = F.concat_ws("|", "weak_label", "weak_label_needs_review")
    parts = [
        counted(manifest, "size", F.col("sample_role")), counted(manifest, "label", F.col("weak_label")),
        counted(manifest, "flag", F.col("weak_label_needs_review").cast("string")),
        counted(manifest, "app", F.col("app_name")), counted(manifest, "vertical", F.col("vertical_name")),
        counted(reasons, "noise_reason", F.col("reason")), signals,
        counted(people, "population_label", F.col("weak_label")), counted(people, "population_label_flag", label_flag),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def recheck_sample(manifest: DataFrame, seed: int = SEED, quotas: dict[str, int] = RECHECK_QUOTAS) -> DataFrame:
    """Second-look sheet: a fixed number of rows per label in a new random order, answers blank."""
    ranked = manifest.withColumn("recheck_rank", stable_rank("sample_id", seed + 1))
    return annotation_template(_within(ranked, quotas, "weak_label", "recheck_rank"), with_rating=False)


def holdout_exclusion(features: DataFrame, sample: DataFrame) -> DataFrame:
    """Audited reviews stay out of training data."""
    return join_dimension(features, sample.select("review_id"), ["review_id"], "left_anti")
