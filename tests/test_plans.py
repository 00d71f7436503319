"""Stored tables, source completeness and joins on hot keys."""

import pytest
from pyspark.sql import functions as F

from feedfold.operators import flags, fold, normalise
from feedfold.plans.feed import Feed
from feedfold.session import join_popular, size_shuffles
from feedfold.sources import landing
from feedfold.sources.lexicon import ISSUE_TERMS, lexicon_from_table, lexicon_table

SF = "/root/testdata/sf0.001"


def test_stored_tables_follow_their_inputs(spark):
    usual = Feed(spark, SF).features.agg(F.sum("issue_ads")).first()[0]
    other = Feed(spark, SF, lexicon={**ISSUE_TERMS, "ads": ("nosuchterm",)}).features.agg(F.sum("issue_ads")).first()[0]
    again = Feed(spark, SF).features.agg(F.sum("issue_ads")).first()[0]
    assert usual > 0 and other == 0 and again == usual
    part = landing.entries(spark, SF).filter("entry_pos < 10")
    assert Feed(spark, SF, entries=part).log.count() == part.count() < Feed(spark, SF).log.count()


def test_every_text_is_in_some_entry(spark):
    docs = landing.read_table(spark, SF, "documents")
    spoken = landing.entries(spark, SF).select(
        F.regexp_replace(F.concat_ws(" ", "title_raw", "body_raw"), r"\s+", "").alias("said"), F.substring("review_url_raw", 33, 20).alias("u"),
        F.get_json_object("raw_record", "$.id.label").alias("id"))
    found = spoken.select(F.regexp_extract("id", r"r-(\d+)", 1).cast("long").alias("doc_id"), "said").filter("doc_id is not null")
    flat = docs.select("doc_id", F.regexp_replace("text", r"\s+", "").alias("text"))
    seen = found.join(flat, "doc_id").withColumn("whole", F.contains("said", "text")).groupBy("doc_id").agg(F.max("whole").alias("whole"))
    assert seen.filter("not whole").collect() == [] and seen.count() > 100


def test_documents_without_event_take_part(spark, tmp_path):
    for name in ("documents", "events", "labels"):
        df = landing.read_table(spark, SF, name)
        (df.filter("event_id % 3 != 0") if name == "events" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    whole, part = (landing.entries(spark, d).select("source_app_id", "page_number", "entry_pos", "run_id") for d in (SF, str(tmp_path)))
    assert sorted(whole.collect()) == sorted(part.collect())


def test_lexicon_round_trip(spark):
    assert lexicon_from_table(lexicon_table(spark)) == ISSUE_TERMS


@pytest.mark.parametrize("how", ["inner", "left"])
def test_popular_keys_join_as_usual(spark, how):
    rows = spark.createDataFrame([(None if i % 11 == 0 else 1 if i % 3 == 0 else i, i) for i in range(1500)], "k long, v long")
    groups = spark.createDataFrame([(k, k * 10) for k in range(0, 900)], "k long, w long")
    want = sorted(map(tuple, rows.join(groups, "k", how).select("k", "v", "w").collect()), key=repr)
    assert sorted(map(tuple, join_popular(rows, groups, ["k"], how, most=5).select("k", "v", "w").collect()), key=repr) == want


def test_a_body_in_a_third_of_the_rows_fills_no_task(spark):
    """The hot body is joined by broadcast: the rows that are shuffled for the duplicate test do not hold it."""
    entries = landing.entries(spark, SF).withColumn("body_raw", F.expr("CASE WHEN entry_pos % 3 = 0 THEN 'One body for all of them' ELSE body_raw END"))
    log = fold.narrow_log(flags.with_mismatch(normalise.mark_rollback(normalise.validate(normalise.normalise(entries))))).cache()
    marked = fold.duplicate_text(log)
    plain = log.filter(F.size("reasons") == 0)
    assert marked.count() == log.count()
    hot = marked.join(log.groupBy("body_key").count().orderBy(F.desc("count")).limit(1), "body_key")
    assert hot.count() >= log.count() / 4 and hot.filter("duplicate_text").count() > 0
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3 and plain.count() > 0


def test_shuffles_grow_with_the_input(spark):
    """More input gives more partitions, not larger ones; a setting of the application itself stays."""
    keys = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    before = [spark.conf.get(k, None) for k in keys]
    try:
        counts = []
        for size in (0, 1 << 30, 6 << 30):
            size_shuffles(spark, size)
            counts.append(int(spark.conf.get(keys[1])))
        assert counts == [int(spark.conf.get("spark.sql.shuffle.partitions")), 512, 3072] and spark.conf.get(keys[0]) == "8388608b"
    finally:
        for key, value in zip(keys, before):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
