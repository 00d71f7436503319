"""The lexicon index against one pattern per term, bucketed exports and their trees, the ordered CSV."""

import datetime
import random

from pyspark.sql import functions as F

from feedfold.functions.text import has_term
from feedfold.operators.term_index import indexed_terms, matched_by_index
from feedfold.sources import exports

TERMS = ["log in", "crash", "Can't open", "rock  & roll", "c++", "#tag", "é", "x_1", "two\tthree", "a b c d", "e-mail", "ad", "99"]
TEXTS = ["I cannot log   in, it CRASHed", "log-in Crash!", "can't open; Rock & ROLL c++ #tag", "É éad x_1 x_12 ads ad", "two three a b c d e-mail",
         "two, three a b c d e mail", "log\nin log. in", "", None, "99 099 c++x", "rock&roll rock &roll", "crash crash crash"]


def test_index_finds_what_patterns_find(spark):
    table = spark.createDataFrame([(f"s{i % 3}", t, i) for i, t in enumerate(TERMS)] + [("s1", "crash", 50)], "signal string, term string, position int")
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    found = {(r.id, r.signal, r.term) for r in indexed_terms(rows, "id", F.col("text"), table).collect()}
    want = {(r.id, s, t) for s, t in [(r.signal, r.term) for r in table.collect()]
            for r in rows.filter(has_term("text", (t,))).collect()}
    assert found == want and len(want) > 12
    matched = {r.id: r.matched for r in matched_by_index(rows, "id", F.col("text"), table).collect()}
    assert len(matched) == len(TEXTS) and matched[11] == {"s0": [], "s1": ["crash", "crash"], "s2": []} and matched[7] == {"s0": [], "s1": [], "s2": []}


def test_only_lengths_of_terms_are_cut(spark):
    """Three-word phrases are looked for among runs of three words; single words and pairs are not sent to the join."""
    table = spark.createDataFrame([("s", "one two three", 0), ("s", "c d e", 1)], "signal string, term string, position int")
    rows = spark.createDataFrame([(1, "zero one  Two three"), (2, "one two, three c d e f"), (3, "one two"), (4, None)], "id int, text string")
    found = indexed_terms(rows, "id", F.col("text"), table)
    assert sorted((r.id, r.term) for r in found.collect()) == [(1, "one two three"), (2, "c d e")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("transform(slice(") == 1


def test_large_lexicon_is_one_join(spark):
    table = spark.range(100_000).select(F.lit("s").alias("signal"), F.concat(F.lit("word"), "id").alias("term"), F.lit(0).alias("position"))
    rows = spark.createDataFrame([(1, "word7 and word99999 but word100000")], "id int, text string")
    hits = indexed_terms(rows, "id", F.col("text"), table)
    assert sorted(r.term for r in hits.collect()) == ["word7", "word99999"]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("join") == 1 and len(plan) < 6000
    assert indexed_terms(rows, "id", F.col("text"), table.limit(0)).collect() == []


def test_diff_reads_only_buckets_that_differ(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 == 0, "x").alias("w"))
    changed = rows.filter("key != 'k9'").withColumn("v", F.when(F.col("key") == "k17", 100).otherwise(F.col("v"))).withColumn(
        "w", F.when(F.col("key") == "k17", "y").otherwise(F.col("w"))).unionByName(
        spark.createDataFrame([("new", 1, None)], "key string, v long, w string"))
    one, two, again = (str(tmp_path / n) for n in ("one", "two", "again"))
    for path, df in ((one, rows), (two, changed), (again, rows.repartition(7).orderBy(F.rand(3)))):
        exports.write_export(df, path, "key", 64)
    assert exports.export_root(spark, one).first() == exports.export_root(spark, again).first()
    assert exports.export_root(spark, one).first().row_count == 500 and exports.differing_buckets(spark, one, again) == []
    buckets = exports.differing_buckets(spark, one, two)
    assert 1 <= len(buckets) <= 3
    diff = exports.export_diff(spark, one, two, "key")
    assert sorted(map(tuple, diff.collect())) == [("k17", "changed", "v|w"), ("k9", "removed", ""), ("new", "added", "")]
    assert {f.rpartition("/")[0].rpartition("=")[2] for f in diff.inputFiles()} == set(map(str, buckets))
    assert exports.export_diff(spark, one, again, "key").collect() == []


def test_ordered_csv_is_newest_first_across_files(spark, tmp_path):
    rng = random.Random(4)
    day = datetime.datetime(2026, 1, 1)
    rows = [(f"r{i:04}", day + datetime.timedelta(hours=rng.randrange(900)), rng.choice(["plain", "two\nlines", 'say "x", y', " padded ", ""])) for i in range(600)]
    frame = spark.createDataFrame(rows, "review_id string, published_at timestamp, body string").repartition(5)
    exports.write_ordered_csv(frame, str(tmp_path / "csv"), parts=4)
    back = exports.read_ordered_csv(spark, str(tmp_path / "csv"), frame.columns).orderBy("part", "line").collect()
    want = sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))
    assert [r.review_id for r in back] == [r[0] for r in want] and [r.body or "" for r in back] == [r[2] for r in want]
    manifest = spark.read.csv(str(tmp_path / "csv" / "manifest"), header=True).orderBy("file").collect()
    assert len(manifest) > 1 and all(a.oldest >= b.newest for a, b in zip(manifest, manifest[1:]))
