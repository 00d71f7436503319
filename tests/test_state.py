"""The stream's keyed state: any order of batches, replays, crashes between write and switch, buckets, late data."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedfold import session
from feedfold.operators import entries, flags, fold, normalise
from feedfold.plans import queries_streaming
from feedfold.sources import landing, pages
from feedfold.streaming import ingest
from feedfold.streaming.keyed import VERSIONS, KeyedState, upsert_changed
from tests.conftest import label, page_body, review
from tests.test_feed import loaded

BODIES = ["same text here", "Same Text here", "other text here", "third", "This is an excellent and amazing app"]


def random_pages(seed, runs=4, per_run=4):
    rng = random.Random(seed)
    rows = []
    for run in range(1, runs + 1):
        for page in range(1, per_run + 1):
            items = [review(rng.randrange(9), rng.choice("125"), rng.choice(BODIES), **({"author": None} if rng.random() < .2 else {}))
                     for _ in range(rng.randrange(1, 4))]
            if rng.random() < .15:
                items.append(review(20, **{"im:voteCount": label("-1")}))
            rows.append((run, 0, rng.choice("ab"), page, page_body(items) if rng.random() > .1 else "broken"))
    return rows


def batch_twin(frame):
    marked, valid = loaded(frame)
    log = fold.narrow_log(flags.with_mismatch(marked))
    good = normalise.split_valid(normalise.committed(log))[0]
    created = fold.flag_dedup(flags.observed_flags(fold.duplicate_text(good)))
    return fold.review_upsert(valid), created, fold.reviewer_upsert(good), normalise.rejected_records(marked)


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_state_equals_one_batch_in_any_order_and_under_replays(spark, make_pages, tmp_path):
    rows = random_pages(1)
    order = list(range(len(rows)))
    random.Random(11).shuffle(order)
    handle = ingest.tables_batch(str(tmp_path / "state"), buckets=2)
    parts = [make_pages([rows[i] for i in order[k::3]]) for k in range(3)]
    for batch, part in enumerate(parts):
        handle(part, batch)
    handle(parts[2], 2)  # replayed under its id
    handle(make_pages(rows), 3)  # every page landed once more
    target = str(tmp_path / "state")
    reviews, created, reviewers, rejects = batch_twin(make_pages(rows))
    assert rows_of(ingest.read_state(spark, target)) == rows_of(reviews)
    assert rows_of(ingest.read_flags(spark, target)) == rows_of(created)
    assert "duplicate_text_within_app" in {r.flag_type for r in created.collect()}
    assert rows_of(ingest.read_reviewers(spark, target)) == rows_of(reviewers)
    assert rows_of(ingest.read_table(spark, target, "rejects")) == rows_of(rejects)
    requests = make_pages(rows).select("run_id", "source_app_id", "storefront")
    log = spark.createDataFrame([], "run_id long, source_app_id string, storefront string, page_number long, error string")
    got = {(r.run_id, r.source_app_id): (r.reviews_inserted, r.flags_created) for r in ingest.read_counters(spark, target, requests, log).collect()}
    inserted, flagged = ({(r.run, r.source_app_id): r["count"] for r in df.groupBy(F.col(c).alias("run"), "source_app_id").count().collect()}
                         for df, c in ((reviews, "first_seen_run_id"), (created, "created_run_id")))
    assert got == {k: (inserted.get(k, 0), flagged.get(k, 0)) for k in got} and sum(inserted.values()) == sum(v[0] for v in got.values())


def test_late_batch_takes_a_duplicate_flag_back(spark, make_pages, tmp_path):
    """Review 1 was stored with its second body until its first observation arrived late."""
    late = (1, 0, "a", 1, page_body([review(1, "5", "quite another body")]))
    early = [(2, 0, "a", 1, page_body([review(1, "5", "one body for two")])), (3, 0, "a", 1, page_body([review(2, "5", "one body for two")]))]
    handle, target = ingest.tables_batch(str(tmp_path / "s"), buckets=2), str(tmp_path / "s")
    handle(make_pages(early), 0)
    duplicates = lambda: [r.source_review_id for r in ingest.read_flags(spark, target).filter("flag_type LIKE 'dup%'").collect()]
    assert duplicates() == ["review-2"]
    handle(make_pages([late]), 1)
    assert duplicates() == [] == batch_twin(make_pages([late, *early]))[1].filter("flag_type LIKE 'dup%'").collect()


def keyed(spark, path, buckets=4):
    return KeyedState(spark, str(path), {"t": ["k"]}, buckets)


def total(rows):
    return rows.groupBy("bucket", "k").agg(F.sum("v").alias("v")).drop("bucket")


def test_batch_that_dies_before_the_switch_changes_nothing(spark, tmp_path):
    state = keyed(spark, tmp_path / "s")
    with state.batch(0) as batch:
        batch.fold("t", spark.range(20).selectExpr("id AS k", "1L AS v"), total)
    with pytest.raises(RuntimeError):
        with state.batch(1) as batch:
            batch.fold("t", spark.range(20).selectExpr("id AS k", "5L AS v"), total)
            raise RuntimeError("lost after writing")
    assert state.manifest()["batch"] == 0 and {r.v for r in state.read("t").collect()} == {1}
    with state.batch(1) as batch:  # the retry overwrites what was left behind
        batch.fold("t", spark.range(5).selectExpr("id AS k", "2L AS v"), total)
    assert sorted(r.v for r in state.read("t").collect()) == [1] * 15 + [3] * 5
    with state.batch(1) as batch:
        assert batch is None


def test_batch_rewrites_and_readers_open_only_their_buckets(spark, tmp_path):
    state = keyed(spark, tmp_path / "s")
    with state.batch(0) as batch:
        batch.fold("t", spark.range(40).selectExpr("id AS k", "1L AS v"), total)
    one = spark.createDataFrame([(7,)], "k long")
    place = str(one.select(state.bucket("t")).first()[0])
    with state.batch(1) as batch:
        batch.fold("t", one.withColumn("v", F.lit(9).cast("long")), total)
    versions = state.manifest()["tables"]["t"]
    assert versions[place] == [1] and all(v == [0] for b, v in versions.items() if b != place) and len(versions) == 4
    found = state.read("t", [int(place)])
    assert all(f"/bucket={place}/" in f for f in found.inputFiles()) and found.inputFiles()
    assert [(r.k, r.v) for r in state.lookup("t", one).collect()] == [(7, 10)]
    state.vacuum(keep=1)
    assert state.read("t").count() == 40 and len(list((tmp_path / "s" / "manifest").glob("*.json"))) == 1
    assert not (tmp_path / "s" / "t" / "version=0" / f"bucket={place}").exists()


def test_appended_buckets_become_one_version(spark, tmp_path):
    state = keyed(spark, tmp_path / "s", buckets=1)
    for i in range(VERSIONS + 2):
        with state.batch(i) as batch:
            batch.append("t", spark.createDataFrame([(i, i)], "k long, v long"))
    assert sorted(r.k for r in state.read("t").collect()) == list(range(VERSIONS + 2))
    assert state.manifest()["tables"]["t"]["0"] == [VERSIONS, VERSIONS + 1]


def test_update_mode_upserts_changed_groups(spark, tmp_path):
    state = keyed(spark, tmp_path / "s")
    sink = upsert_changed(state, "t")
    sink(spark.createDataFrame([(1, 5), (2, 6)], "k long, v long"), 0)
    sink(spark.createDataFrame([(2, 8)], "k long, v long"), 1)
    sink(spark.createDataFrame([(2, 99)], "k long, v long"), 1)  # replay
    assert sorted((r.k, r.v) for r in state.read("t").collect()) == [(1, 5), (2, 8)]


def test_page_landed_twice_two_platforms_and_large_numbers(spark, make_pages):
    body = page_body([review(1), review(2, "1", "Terrible app. It crashes every time.")])
    frame = make_pages([(1, 0, "a", 1, body), (1, 0, "a", 1, body)])
    assert fold.review_upsert(loaded(frame)[1]).count() == 2
    twice = frame.unionByName(frame.withColumn("source_platform", F.lit("other")))
    reviews = fold.review_upsert(loaded(twice)[1])
    assert reviews.count() == 4 == reviews.select("review_id").distinct().count()
    entries = loaded(make_pages([(1, 0, "a", 1, page_body([review(1, "5", "early body")])), (1, 0, "a", 2, page_body([review(1, "4", "late body")]))]))[1]
    big = entries.withColumn("entry_pos", F.when(F.col("page_number") == 1, F.lit(3_000_000)).otherwise(F.lit(0)).cast("long")).withColumn(
        "page_number", F.col("page_number") * 10**12)
    assert [r.body for r in fold.review_upsert(big).collect()] == ["early body"]
    assert ingest.new_pages(frame, None).count() == 1 and ingest.new_pages(frame, frame).count() == 0


def test_page_files_are_read_as_they_were_landed(spark, tmp_path):
    raw = landing.raw_pages(spark, "/root/testdata/sf0.001")
    pages.land_page_files(raw, str(tmp_path / "files"))
    files = pages.read_page_files(spark, str(tmp_path / "files"), newline=True)
    names = ["run_id", "source_app_id", "storefront", "page_number", "app_order", "fetched_at", "source_platform", "source_endpoint", "response_body"]
    again = landing.landed_pages(files, landing.feed_orders(spark, "/root/testdata/sf0.001"))
    assert rows_of(again.select(*names)) == rows_of(raw.select(*names)) and raw.count() > 50


def test_documents_without_a_length_take_part(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in ("documents", "events"):
        df = landing.read_table(spark, source, name)
        (df.withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars"))) if name == "documents" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    columns = ["run_id", "source_app_id", "page_number", "entry_pos", "rating_raw"]
    whole, part = (landing.entries(spark, d).select(*columns) for d in (source, str(tmp_path)))
    assert rows_of(whole) == rows_of(part)


def test_batches_stay_few_and_buckets_grow_with_what_landed(spark, make_pages, tmp_path):
    """However many files have landed, a drain rewrites the state a bounded number of times, over buckets of bounded size."""
    for files in (1, 8, 33, 600, 20_000):
        assert -(-files // queries_streaming.files_per_batch(files)) <= queries_streaming.MOST_BATCHES
    assert queries_streaming.state_buckets(1) == 8 and queries_streaming.state_buckets(10 << 30) == 160
    landed = str(tmp_path / "landed")
    frame = make_pages([(1, 0, "a", page, page_body([review(page)])) for page in range(1, 41)])
    frame.repartition(40, "page_number").write.option("maxRecordsPerFile", 1).parquet(landed)
    files, size = ingest.landed_size(spark, landed)
    assert files == len(list((tmp_path / "landed").glob("*.parquet"))) == 40 and size > 0
    ids, target, checkpoint = [], str(tmp_path / "state"), str(tmp_path / "checkpoint")
    handle = ingest.upsert_batch(target)
    stream = ingest.stream_page_table(spark, landed, frame.schema, queries_streaming.files_per_batch(files))
    ingest.run_batches(stream, lambda pages, batch: (ids.append(batch), handle(pages, batch)), checkpoint)
    assert len(ids) == queries_streaming.MOST_BATCHES and ingest.read_state(spark, target).count() == 40


def test_stored_observations_keep_payloads_of_rejects_only(spark, make_pages):
    observed = ingest.observe(make_pages([(1, 0, "a", 1, page_body([review(1), review(2, "7")]))]))
    kept = {r.source_review_id: r.raw_record for r in normalise.reject_payloads(observed).collect()}
    assert kept["review-1"] is None and '"7"' in kept["review-2"]


def test_small_pages_share_files_and_all_are_read_as_landed(spark, tmp_path):
    """The files that land follow the bytes, not the pages; bodies that are no JSON, large pages and files put there by others are read alike."""
    odd = {1: "", 2: "\n", 3: 'no "JSON"\n\n', 4: "a\x1eb\x1a0c\x1a1\x1a\x1e", 5: "é" * pages.BUNDLED_BYTES, 6: "x\r\ny"}
    rows = [(run, f"raw/app_a_us_page_{page}_2026010{run}T000000000000Z.json", odd.get(page, f'{{"page": {page}}}'))
            for run in (1, 2) for page in range(1, 601)]
    frame = spark.createDataFrame(rows, "run_id long, raw_file_path string, response_body string").coalesce(2)
    folder = tmp_path / "files"
    pages.land_page_files(frame, str(folder))
    alone = folder / "run_id=3" / "app_a_us_page_7_20260103T000000000000Z.json"
    alone.parent.mkdir()
    alone.write_text("by itself\x1e", encoding="utf-8")
    files = [f for f in folder.rglob("*") if f.is_file() and not f.name.startswith((".", "_"))]
    assert len(files) <= 1 + 2 * 2 * 4
    want = sorted([(run, int(path.split("_")[4]), f"2026010{run}T000000000000Z", body) for run, path, body in rows]
                  + [(3, 7, "20260103T000000000000Z", "by itself\x1e")])

    def seen(df):
        run = F.regexp_extract("raw_file_path", r"/run_id=(\d+)/", 1).cast("long").alias("run")
        return sorted(map(tuple, df.select(run, "page_number", "fetch_stamp", "response_body").collect()))

    assert seen(pages.read_page_files(spark, str(folder), newline=True)) == want
    streamed = []
    ingest.run_batches(ingest.stream_page_files(spark, str(folder), newline=True), lambda df, _: streamed.extend(seen(df)), str(tmp_path / "checkpoint"))
    assert sorted(streamed) == want


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}

    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = kept(), spark.conf.get(session.SHUFFLE_CLEANUP)
    assert session.written(rows, "counted").filter("count > 0").toLocalIterator().__next__()["count"] > 100
    deadline = time.time() + 20
    while (left := {f for f in kept() - before if f.endswith(".data")}) and time.time() < deadline:
        time.sleep(0.5)
    assert not left and spark.conf.get(session.SHUFFLE_CLEANUP) == setting


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_leaves_the_state_alone(spark, make_pages, tmp_path):
    """What a batch stores for itself goes when it ends, also when it dies; of shuffle files nothing stays either."""
    def stored():
        folder = Path(session.work_dir(spark).removeprefix("file://")) / "feedfold"
        return {x.name for x in folder.iterdir()} if folder.exists() else set()

    before, handle = stored(), ingest.tables_batch(str(tmp_path / "s"), buckets=2)
    handle(make_pages(random_pages(3)), 0)
    with pytest.raises(Exception, match="nowhere"):
        handle(make_pages(random_pages(4)).withColumn("response_body", F.raise_error(F.lit("nowhere"))), 1)
    assert stored() == before and ingest.read_state(spark, str(tmp_path / "s")).count() > 3
    kept = session.written(make_pages(random_pages(3)), "kept")
    assert kept.count() > 3 and len(stored()) == len(before) + 1


def test_one_parse_gives_entries_and_facts(spark, make_pages):
    other, odd = {"id": label("meta")}, "a string"
    bodies = [page_body([review(1), review(2, "7")]), page_body([other, odd, review(3)]), page_body([]), page_body([other]), page_body(review(4)),
              "broken", "", page_body([odd]), page_body(None), page_body([review(5)], links=[])]
    frame = make_pages([(1, 0, "a", number, body) for number, body in enumerate(bodies)])
    parsed = entries.extract_with_facts(frame)
    assert rows_of(parsed.filter("is_entry").drop("page", "is_entry")) == rows_of(entries.extract_entries(frame))
    facts = parsed.filter("page IS NOT NULL").select(*[c for c in frame.columns if c != "response_body"], "page.*")
    assert rows_of(facts) == rows_of(entries.page_facts(frame).drop("review_ids")) and facts.count() == len(bodies)


def test_first_texts_go_without_a_shuffle_of_all(spark, make_pages):
    valid = loaded(make_pages(random_pages(5, runs=6)))[1]
    kept = session.written(fold.with_keys(flags.with_mismatch(valid)), "valid")
    partial = ingest.narrow_partials(fold.without_texts(kept))
    texts = ingest.first_texts(kept, partial, 0)
    assert "Exchange hashpartitioning" not in plan_of(texts)
    want = kept.join(partial.select(*fold.REVIEW_KEY, F.col("first.seq").alias("place")), fold.REVIEW_KEY).filter(fold.place() == F.col("place"))
    columns = [*fold.REVIEW_KEY, "place", "title", "body"]
    assert rows_of(texts.select(*columns)) == rows_of(want.select(*columns)) and texts.count() < kept.count()


def test_keys_looked_up_are_broadcast_by_their_size_only(spark, tmp_path):
    state = keyed(spark, tmp_path / "s")
    with state.batch(0) as batch:
        batch.fold("t", spark.range(40).selectExpr("id AS k", "1L AS v"), total)
    wanted = session.written(spark.range(5, 9).toDF("k"), "wanted")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = state.lookup("t", wanted)
        assert "BroadcastHashJoin" not in plan_of(found) and sorted(r.k for r in found.collect()) == [5, 6, 7, 8]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bodies_of_pages_that_come_once_are_not_compared(spark, make_pages):
    """Which pages come again is told by their names, so neither the bodies nor the pages are shuffled for it."""
    rows = [(1, 0, "a", page, page_body([review(page)])) for page in range(1, 9)]
    frame = session.written(make_pages(rows), "pages")
    taken = session.written(make_pages([(2, 0, "a", 1, "x")]), "taken")
    assert "Exchange" not in plan_of(ingest.new_pages(frame, None)) and "Exchange" not in plan_of(ingest.new_pages(frame, taken))
    late = make_pages([(1, 0, "a", 3, page_body([review(30)])), rows[4]]).withColumn("fetched_at", F.timestamp_add("DAY", F.lit(1), F.col("fetched_at")))
    several = frame.unionByName(late).unionByName(make_pages(rows[6:7]))
    assert rows_of(ingest.new_pages(several, None)) == rows_of(frame)
    assert rows_of(ingest.new_pages(several, frame.filter("page_number > 2"))) == rows_of(frame.filter("page_number <= 2"))


def test_a_document_travels_once_for_all_its_runs(spark):
    """Documents are shuffled to their range of pages before they become the entries of each run; pages are as the parser's entries say."""
    source = "/root/testdata/sf0.001"
    raw = landing.raw_pages(spark, source)
    assert not [line for line in plan_of(raw).splitlines() if "Exchange hashpartitioning" in line and "run_id" in line]
    columns = ["run_id", "source_app_id", "storefront", "page_number", "entry_pos"]
    read = entries.extract_entries(raw).groupBy(*columns[:4]).count()
    assert rows_of(read) == rows_of(landing.entries(spark, source).groupBy(*columns[:4]).count())


def test_page_files_are_compressed(spark, tmp_path):
    frame = spark.createDataFrame([(1, f"raw/app_a_us_page_{n}_20260101T000000000000Z.json", "{" + " " * size + "}") for n, size in ((1, 9), (2, pages.BUNDLED_BYTES))],
                                  "run_id long, raw_file_path string, response_body string")
    pages.land_page_files(frame, str(tmp_path / "files"))
    files = [f for f in (tmp_path / "files").rglob("*") if f.is_file() and not f.name.startswith((".", "_"))]
    assert len(files) == 2 and all(f.name.endswith(".gz") and f.stat().st_size < 4000 for f in files)
    read = pages.read_page_files(spark, str(tmp_path / "files"), newline=True)
    assert sorted((r.page_number, len(r.response_body)) for r in read.collect()) == [(1, 11), (2, pages.BUNDLED_BYTES + 2)]
