import json

from pyspark.sql import functions as F

from feedfold.operators import reports, sketches

SF = "/root/testdata/sf0.1"


def test_merged_sketches_stay_within_their_error(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.pmod("l_orderkey", F.lit(5)).alias("run"), "l_orderkey", "l_partkey", "l_returnflag",
        F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("gappy"), F.lit(None).cast("string").alias("nothing"))
    kept = sketches.column_sketches(rows, "run").cache()
    assert kept.count() == 5 * 5
    got = {r.column_name: r for r in sketches.merged_columns(kept).collect()}
    exact = rows.agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(c) for c in rows.columns[1:]],
                     F.count_if(F.col("gappy").isNull()).alias("gaps")).first()
    for name, r in got.items():
        want = exact[name] + (name in ("gappy", "nothing"))
        assert r.row_count == exact.n and abs(r.unique_estimate - want) <= max(0, 0.04 * want if want > 100 else 0)
        assert r.few_values == (want if want <= 100 else None)
    assert got["gappy"].missing_count == exact.gaps and got["nothing"].few_values == 1
    # parts may come in any order and grouping
    some = sketches.merged_columns(kept.filter("part < 2").unionByName(kept.filter("part >= 2")).repartition(7))
    assert {r.column_name: r.row_count for r in some.collect()} == {c: exact.n for c in got}


def test_merged_quantiles_have_the_rank_they_claim(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.pmod("l_orderkey", F.lit(5)).alias("run"), "l_returnflag", F.col("l_partkey").cast("bigint").alias("x"),
        F.when(F.col("l_linenumber") < 0, F.lit(1)).alias("never"))
    kept = sketches.quantile_sketches(rows, ["run", "l_returnflag"], ["x", "never"])
    ranks = {"p25": 0.25, "p50": 0.5, "p99": 0.99}
    got = {(r.l_returnflag, r.variable): r for r in sketches.merged_quantiles(kept, ["l_returnflag"], ranks).collect()}
    for flag, group in ((f, rows.filter(F.col("l_returnflag") == f)) for f in ("A", "N", "R")):
        r, none = got[flag, "x"], got[flag, "never"]
        low, high, n = group.agg(F.min("x"), F.max("x"), F.count("x")).first()
        assert (r.n, r.min, r.max) == (n, low, high) and (none.n, none.min, none.p50) == (0, None, None)
        for name, rank in ranks.items():
            below, upto = group.agg(F.count_if(F.col("x") < r[name]), F.count_if(F.col("x") <= r[name])).first()
            assert below / n - 0.004 <= rank <= upto / n + 0.004


def test_nothing_to_sketch(spark):
    empty = spark.createDataFrame([], "run int, a string, b bigint")
    assert sketches.merged_columns(sketches.column_sketches(empty, "run")).collect() == []
    assert sketches.merged_quantiles(sketches.quantile_sketches(empty, ["run"], ["b"]), [], {"p50": 0.5}).collect() == []


def test_lists_are_bounded_and_tell_what_they_leave_out(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = reports.bounded_list(rows, ["k"], ["id"], F.struct("id"), 5, "items").orderBy("k").collect()
    assert [[x.id for x in r["items"]] for r in got] == [[k + 3 * i for i in range(5)] for k in range(3)]
    assert [r.items_left_out for r in got] == [329, 328, 328]


def test_reports_are_documents(spark):
    from feedfold.plans import catalog
    catalog.load()
    row, = catalog.QUERIES["validation_document"](spark, "/root/testdata/sf0.001").collect()
    document = json.loads(row.report)
    assert document["ready_for_ds"] == all(document["acceptance_gates"].values()) and document["runs_left_out"] == 0
    assert document["window_changes"]["changed_pages"] >= document["window_changes"]["window_changed"]
