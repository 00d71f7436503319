import datetime
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from feedfold.functions import text as tx
from feedfold.operators import flags


def values(spark, inputs, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_text(spark):
    assert values(spark, ["  a \t b\r\n\r\n\r\n\r\nc  ", "x\ry", "    ", None, "a\n\nb", "\x1ca\x1f"], tx.clean_text) == [
        "a b\n\nc", "x\ny", "", "", "a\n\nb", "a"]
    assert values(spark, [" ", None, "a"], lambda c: tx.clean_text(c, True)) == [None, None, "a"]


def test_safe_int(spark):
    assert values(spark, [" 5 ", "5.0", "", None, "five", "-3", "+4", "1_0", "1__0", "99999999999999999999"], tx.safe_int) == [
        5, None, None, None, None, -3, 4, 10, None, None]


@pytest.mark.parametrize("given,expected", [
    ("2026-06-25T10:00:00-07:00", "2026-06-25 17:00:00"), ("2026-06-24T08:30:00Z", "2026-06-24 08:30:00"),
    ("2026-06-24 08:30", "2026-06-24 08:30:00"), ("2026-06-24", "2026-06-24 00:00:00"),
    ("20260624T083000Z", "2026-06-24 08:30:00"), ("2026-06-24T08:30:15.987654+0530", "2026-06-24 03:00:15"),
    ("2026-06-24T08+02", "2026-06-24 06:00:00"), ("  2026-06-24T08:30:00Z ", "2026-06-24 08:30:00"),
    ("2026", None), ("2026-06", None), ("2026-6-5", None), ("T08:30", None), ("soon", None), ("", None),
    ("2026-13-01", None), ("2026-06-24T25:00:00Z", None), (None, None)])
def test_timestamp(spark, given, expected):
    got = values(spark, [given], tx.parse_timestamp)[0]
    assert (got and got.strftime("%Y-%m-%d %H:%M:%S")) == expected


def test_week_dates_and_digits_of_other_scripts(spark):
    given = ["2026-W26-3T08:30:00Z", "2026W263", "2026-W26", "2026W26T10", "2020-W53-7", "2021-W53-1", "2026-W00-1", "2026-W26-8",
             "2026-W263", "2026W26-3", "2026-W26-30", "2009-W01-1", "2026-W27 08:30+02:00", "W26"]
    def python(text):
        try:
            parsed = datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError:
            return None
        return parsed.replace(tzinfo=parsed.tzinfo or datetime.UTC).astimezone(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")
    got = [v and v.strftime("%Y-%m-%d %H:%M:%S") for v in values(spark, given, tx.parse_timestamp)]
    assert got == [python(x) for x in given] and sum(x is not None for x in got) == 7
    digits = ["٤٢", "-१२", "４_２", "𝟗", "5٤", "²", "Ⅳ", "٤.٢"]
    assert values(spark, digits, tx.safe_int) == [42, -12, 42, 9, 54, None, None, None]


def test_language(spark):
    assert values(spark, ["I love this app", "good", "it is ok", "12345 !!", "", "прекрасное приложение", "äöüßäöüß abc defg",
                          "naïve resume of a long text", "Abcdefghijkl"], tx.detect_language) == [
        "en", "en", "en", "unknown", "unknown", "unknown", "unknown", "en", "en"]


def test_counts(spark):
    tokens = values(spark, ["a b\nc", "", "one two", " x  \n y ", "日本 語"], lambda c: tx.token_estimate(tx.flat_text(c)))
    assert tokens == [3, 0, 2, 2, 2]
    assert values(spark, ["don't stop", "'quoted' x'", "''", "a_b 3", "日本語 é"], tx.word_count) == [2, 2, 0, 2, 2]


def test_redaction(spark):
    assert values(spark, ["see https://x.y/z and  www.a.b\nmail me.you+x@mail.example.com now", "a" * 200], tx.redact_text) == [
        "see [URL] and [URL] mail [EMAIL] now", "a" * 180 + "…"]


def test_terms(spark):
    hit = lambda terms: values(spark, ["LOGIN after the latest   version", "adaptation", "éad ad-free", "c++ rocks"],
                               lambda c: tx.has_term(c, terms))
    assert hit(["login"]) == [True, False, False, False]
    assert hit(["latest version"]) == [True, False, False, False]
    assert hit(["ad", "ads"]) == [False, False, True, False]
    assert hit(["c++"]) == [False, False, False, True]
    assert hit(["", "  "]) == [False] * 4


def test_fold_and_fingerprint(spark):
    assert values(spark, [" ÀBC ", "ABC", "\tA"], tx.ascii_fold) == ["Àbc", "abc", "\ta"]
    df = spark.createDataFrame([("u", "l"), (None, "l"), (None, None)], "uri string, label string")
    prints = [r[0] for r in df.select(tx.author_fingerprint(F.lit("p"), "uri", "label")).collect()]
    assert prints[2] is None and len({prints[0], prints[1]}) == 2 and len(prints[0]) == 64


ROUGH = ["a\tb", "a \tb", "\t\ta  b\t", "a\u2003b \u3000c d", "é\n\n\nb\tc", "x\n\n\n\ny", "\u00a0a\u00a0", "a\x1cb", " ", "", None, "plain text", "ü  ü"]


def test_cleaning_and_flattening_equal_plain_python(spark):
    def clean(text):
        text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
        return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", text)).strip()
    assert values(spark, ROUGH, tx.clean_text) == [clean(x) for x in ROUGH]
    assert values(spark, ROUGH, tx.flat_text) == [x if x is None else " ".join(x.split()) for x in ROUGH]


def test_only_texts_that_change_are_cleaned(spark):
    """The pattern runs behind a plain look for what it replaces."""
    plan = spark.createDataFrame([("a",)], "x string").select(tx.clean_text("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan or "contains(" in plan.lower()


def test_words_of_the_mismatch_rule_equal_plain_python(spark):
    given = ["great", "so (great), really", "great-ish", "a.great", "greatly", "'\"great\"'!", "x\u2003GREAT\u00a0y", "greats great.", "7great", "ingreat great7",
             "...", "great\ufdd0", "\U0001f600great", "\U0001f600 [great]\U0001f600", "GREAT", "", None, "gréat great]"]
    def python(text):
        return None if text is None else any(w.strip(".,!?;:'\"()[]{}") == "great" for w in text.lower().split())
    assert values(spark, given, lambda c: flags.has_word(c, ("great", "perfect"))) == [python(x) for x in given]


def test_terms_are_looked_for_before_the_pattern_runs(spark):
    """Whatever the pattern takes for a letter of a term, in any script and case, the plain look takes for it too."""
    letters = "".join(map(chr, range(ord("a"), ord("z") + 1)))
    twins = [c for c in map(chr, range(128, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (set(c.lower() + c.upper()) & set(letters + letters.upper()))]
    assert {"İ", "ı", "ſ", "K"} <= set(twins)
    given = [f"x {a}{c}{b} y" for c in twins for a in ("", "i") for b in ("", "i")] + [None, "", "SIKS", "ſiks", "sİKs", "sıKs", "siKS's", "asiks", "si ks"]
    terms = [*letters, *(f"i{x}" for x in letters), *(f"{x}i" for x in letters), "siks", "si  KS"]
    for term in (letters[0], "i", "k", "s", "ii", "ik", "is", "ki", "si", "siks", "si  KS"):
        assert term in terms
        assert values(spark, given, lambda c: tx.has_term(c, (term,), tx.folded(c))) == values(spark, given, lambda c: c.rlike(tx.term_pattern((term,)))), term
    plan = lambda c: spark.createDataFrame([("a",)], "x string").select(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan(tx.has_term("x", ("crash", "new version"), F.col("x"))) and "Contains(" in plan(flags.has_word("x", ("great",)))
    assert "Contains(" not in plan(tx.has_term("x", ("größe", "crash"), F.col("x")))
    assert "Contains(" not in plan(tx.has_term("x", tuple(f"word{a}{b}" for a in letters for b in letters), F.col("x")))


def test_mismatch_rule_searches_a_text_once(spark):
    texts = ["great", "terrible", "great but terrible", "fine", "", None]
    rows = [(i * 10 + (r or 0), t, r) for i, t in enumerate(texts) for r in (None, 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "i int, body string, rating bigint").select("i", flags.mismatch_detail().alias("y"))
    def python(text, rating):
        if rating in (4, 5) and text == "terrible":
            return flags.HIGH_DETAIL
        return flags.LOW_DETAIL if rating in (1, 2) and text == "great" else None
    assert [r.y for r in df.orderBy("i").collect()] == [python(t, r) for _, t, r in sorted(rows, key=lambda x: x[0])]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 2


def test_language_counts_letters_once_and_flattening_spares_the_wide_pattern(spark):
    """The marker words are not looked for in every text, each kind of letter is counted once; results equal plain Python."""
    given = ["ünder the änd", "é", "日本 語 the app", "naïve", "aaaaaaaaaé", "aaaaaaaaéé", "ééé bad", "x — y", "— …", "\U0001d400abcdefghijk", "abcdefghijké good",
             "a b — c", "é\u0085  x", "ü —  　y", "é  \x1c x", "", None]

    def language(text):
        if text is None:
            return "unknown"
        letters = [c for c in text if unicodedata.category(c).startswith("L")]
        plain = sum(c.isascii() for c in letters)
        marked = any(f" {w} " in f" {text.lower()} " for w in tx.ENGLISH_MARKERS)
        return "en" if letters and plain / len(letters) >= 0.9 and (len(letters) >= 12 or marked) else "unknown"
    assert values(spark, given, tx.detect_language) == [language(x) for x in given]
    assert values(spark, given, tx.flat_text) == [x if x is None else " ".join(x.split()) for x in given]
    plan = lambda c: spark.createDataFrame([("a",)], "x string").select(c.alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(tx.detect_language("x")).count(r"\P{L}") == 1 and r"\p{ASCII}" in plan(tx.flat_text("x"))


def test_a_word_is_a_token_without_its_edge_punctuation(spark):
    rng, edge = random.Random(9), ".,!?;:'\"()[]{}"
    parts = ["great", "love", "Great", "a", "9", " ", " ", "\n", "\x85", "\u2003", *edge]
    texts = ["", "great", *["".join(rng.choice(parts) for _ in range(rng.randrange(10))) for _ in range(3000)]]
    frame = spark.createDataFrame([(t,) for t in texts], "body string")
    words = ("great", "love")
    want = {t: any(token.strip(edge) in words for token in t.lower().split()) for t in texts}
    assert {r.body: r.found for r in frame.withColumn("found", flags.has_word("body", words)).collect()} == want


def test_flat_text_of_every_kind_of_space(spark):
    rng = random.Random(10)
    texts = ["", " ", "a", *["".join(rng.choice(["a", "é", " ", "  ", *tx.SPACES]) for _ in range(rng.randrange(8))) for _ in range(3000)]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.flat_text("t").alias("flat")).collect()
    assert {r.t: r.flat for r in got} == {t: " ".join(t.split()) for t in texts}
