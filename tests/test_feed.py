import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import label, page_body, review
from feedfold.operators import accounting, comparison, entries, flags, fold, health, normalise
from feedfold.sources import cohort as co
from feedfold.sources import exports, landing, lexicon, pages
from feedfold.streaming import ingest

METADATA = {"id": label("meta"), "title": label("Not a customer review")}


def loaded(pages_df):
    marked = normalise.mark_rollback(ingest.observe(pages_df))
    return marked, normalise.split_valid(normalise.committed(marked))[0]


def test_reviews_are_kept_and_metadata_dropped(make_pages):
    second = review(2, "1", "Terrible app. It crashes every time.", link=None, author={"name": label("Second")})
    body = page_body([review(1), second, METADATA, "text", 3, None])
    rows = entries.extract_entries(make_pages([(1, 0, "a", 1, body)])).orderBy("entry_pos").collect()
    assert [r.id_raw for r in rows] == ["review-1", "review-2"]
    assert rows[1].review_url_raw is None and rows[1].author_uri_raw is None
    first = normalise.normalise(entries.extract_entries(make_pages([(1, 0, "a", 1, body)]))).orderBy("entry_pos").first()
    assert first.rating == 5 and str(first.published_at) == "2026-06-25 17:00:00" and first.detected_language == "en"
    assert first.body == "I love this app. It works perfectly!"


def test_single_object_null_keys_and_odd_values(make_pages):
    odd = {"id": "plain", "im:rating": label(5.0), "content": None, "title": label(True), "im:voteCount": label(7)}
    rows = entries.extract_entries(make_pages([
        (1, 0, "a", 1, page_body(review(1))), (1, 0, "a", 2, page_body([odd])), (1, 0, "a", 3, "not json"),
        (1, 0, "a", 4, page_body("text")), (1, 0, "a", 5, json.dumps({"feed": 3}))])).orderBy("page_number").collect()
    assert [r.parser_fallback_used for r in rows] == [True, False]
    assert (rows[1].id_raw, rows[1].rating_raw, rows[1].title_raw, rows[1].vote_count_raw) == ("plain", "5.0", "True", "7")
    assert rows[1].body_raw is None


def test_next_page_and_truncation(make_pages):
    link = lambda rel, href: {"attributes": {"rel": rel, "href": href}}
    bodies = [page_body([review(1)]), page_body([review(1)], link("next", "x")), page_body([review(1)], [link("next", "")]),
              page_body([review(1)], [link("next", ""), link("next", "y")]), page_body([review(1)], "text")]
    facts = entries.page_facts(make_pages([(1, 0, "a", i + 1, b) for i, b in enumerate(bodies)])).orderBy("page_number")
    assert [r.has_next for r in facts.collect()] == [True, True, False, False, False]
    kept = pages.truncate_pagination(facts.withColumn("continues", F.col("has_next")))
    assert sorted(r.page_number for r in kept.collect()) == [1, 2, 3]
    assert sorted(r.page_number for r in pages.truncate_pagination(facts.withColumn("continues", F.col("has_next")), 2).collect()) == [1, 2]


def test_four_reasons_and_rejects(make_pages):
    bad = review(1, "7", " \n ", id=None, updated=label("x"))
    marked, valid = loaded(make_pages([(1, 0, "a", 1, page_body([bad, review(2), review(3, "five")]))]))
    rejects = normalise.rejected_records(marked).orderBy("entry_pos").collect()
    assert json.loads(rejects[0].rejection_details) == ["missing_review_id", "rating_out_of_range", "empty_body", "invalid_timestamp"]
    assert [r.rejection_reason for r in rejects] == ["missing_review_id", "missing_or_invalid_rating"]
    assert json.loads(rejects[0].raw_payload)["im:rating"] == {"label": "7"} and valid.count() == 1


def test_all_six_flags(make_pages):
    twin = review(1, "5", "terrible", author=None)
    _, valid = loaded(make_pages([(1, 0, "a", 1, page_body([twin])), (1, 0, "a", 2, page_body(dict(twin, id=label("other"), title=None))),
                                  (1, 0, "a", 3, page_body([review(9, "1", "This is an excellent and amazing app")]))]))
    checked = fold.duplicate_text(fold.narrow_log(flags.with_mismatch(valid)))
    found = {}
    for r in flags.observed_flags(checked).collect():
        found.setdefault(r.source_review_id, []).append(r.flag_type)
    assert found["other"] == ["non_english_or_unknown_language", "too_short_review", "duplicate_text_within_app",
                              "missing_author_metadata", "parser_fallback_used", "rating_text_mismatch"]
    assert "duplicate_text_within_app" not in found["review-1"] and found["review-9"] == ["rating_text_mismatch"]


def two_runs():
    first = [review(1), review(2, "1", "Terrible app. It crashes every time."), METADATA]
    second = [dict(review(1), id=label("review-new")), first[1], METADATA]
    return [(run, order, app, 1, page_body(body, links)) for run, body, links in (
        (1, first, None), (2, second, [{"attributes": {"rel": "self", "href": "a"}}])) for order, app in enumerate(("a", "b"))]


def test_two_runs_insert_update_and_change_the_window(spark, make_pages):
    frame = make_pages(two_runs())
    _, valid = loaded(frame)
    counts = {(r.run_id, r.action): r["count"] for r in fold.label_inserts(valid).groupBy("run_id", "action").count().collect()}
    assert counts == {(1, "inserted"): 4, (2, "inserted"): 2, (2, "updated"): 2}
    reviews = fold.review_upsert(valid)
    assert comparison.dataset_quality(reviews).first().asDict() == {
        "total_reviews": 6, "unique_source_keys": 6, "invalid_required": 0, "apps_represented": 2}
    changes = comparison.window_changes(comparison.raw_observations(frame)).collect()
    assert len(changes) == 2 and all(c.review_window_changed and c.response_hash_changed for c in changes)


def test_failed_feed_is_isolated(spark, make_pages):
    frame = make_pages(two_runs()).filter("run_id = 1 AND source_app_id = 'b'")
    log = spark.createDataFrame([(1, "a", "us", 1, "fixture failure"), (1, "b", "us", 1, None)],
                                "run_id long, source_app_id string, storefront string, page_number long, error string")
    marked, valid = loaded(frame)
    status = normalise.page_status(frame.withColumn("is_json", F.lit(True)), normalise.rolled_back_pages(marked))
    checked = fold.duplicate_text(fold.narrow_log(flags.with_mismatch(valid)))
    counters = accounting.feed_counters(log.select("run_id", "source_app_id", "storefront"), status, marked, valid,
                                        normalise.rejected_records(marked), fold.flag_dedup(flags.observed_flags(checked)), log)
    rows = {r.source_app_id: r for r in counters.collect()}
    assert (rows["a"].run_status, rows["a"].failed_requests, rows["a"].pages_fetched) == ("completed_with_errors", 1, 0)
    assert (rows["b"].run_status, rows["b"].reviews_inserted) == ("completed", 2)
    assert pages.fetch_failures(log).first().first_error == "fixture failure"
    failed = spark.createDataFrame([(1,)], "run_id long")
    assert accounting.run_status(counters, failed).first().run_status == "failed"


def test_first_and_last_values_and_arrival_order(spark, make_pages):
    rows = [(1, 0, "a", 1, page_body([review(1, "5", "first body here", **{"im:voteCount": label("1")})])),
            (2, 0, "a", 1, page_body([review(1, "1", "second body here", **{"im:voteCount": None, "im:version": label("9")})])),
            (1, 0, "a", 2, page_body([review(2)]))]
    results = []
    for order in itertools.permutations(rows):
        partials = [fold.partial_reviews(loaded(make_pages([r]))[1]) for r in order[:1]]
        rest = fold.partial_reviews(loaded(make_pages(list(order[1:])))[1])
        merged = fold.reviews_from_partials(fold.merge_partials(partials[0].unionByName(rest)))
        results.append(sorted(map(str, merged.collect())))
        if len(results) == 3:
            break
    assert results[0] == results[1] == results[2] == sorted(map(str, fold.review_upsert(loaded(make_pages(rows))[1]).collect()))
    one = fold.review_upsert(loaded(make_pages(rows))[1]).filter("source_review_id = 'review-1'").first()
    assert (one.rating, one.body, one.vote_count, one.app_version) == (5, "first body here", None, "9")
    assert (one.first_seen_run_id, one.last_seen_run_id) == (1, 2)


def test_page_with_refused_entry_rolls_back_as_a_whole(make_pages):
    bad = review(2, **{"im:voteCount": label("-1")})
    marked, valid = loaded(make_pages([(1, 0, "a", 1, page_body([review(1), bad])), (1, 0, "a", 2, page_body([review(3)]))]))
    assert [r.source_review_id for r in valid.collect()] == ["review-3"]
    undone = fold.duplicate_text_undone(normalise.split_valid(fold.narrow_log(flags.with_mismatch(marked)))[0])
    assert [(r.source_review_id, r.duplicate_text) for r in undone.collect()] == [("review-1", False)]


def test_duplicates_equal_a_sequential_replay(spark, make_pages):
    rng = random.Random(7)
    observed = [(run, page, rng.randrange(6), rng.choice(["same text here", "Same Text here", "other text here", "third"]))
                for run in (1, 2, 3) for page in (1, 2, 3, 4)]
    frame = make_pages([(run, 0, "a", page, page_body([review(number, "5", body)])) for run, page, number, body in observed])
    got = {(r.run_id, r.page_number): r.duplicate_text
           for r in fold.duplicate_text(fold.narrow_log(loaded(frame)[1])).collect()}
    stored = {}
    for run, page, number, body in observed:
        key = body.lower()
        assert got[(run, page)] == any(k != number and b == key for k, b in stored.items()), (run, page)
        stored.setdefault(number, key)


def test_cohort_and_lexicon(spark):
    raw = spark.createDataFrame([("1", "A", "V", "US", "EN", True, ""), ("2", "B", "V", "de", "de", False, "")], co.MANIFEST_SCHEMA)
    manifest = co.cohort_manifest(raw)
    assert [r.app_id for r in co.cohort_filter(manifest, storefront="US").collect()] == ["1"]
    with pytest.raises(ValueError):
        co.cohort_filter(manifest, ["2"], strict=True)
    with pytest.raises(ValueError):
        co.cohort_manifest(raw.drop("notes"))
    bad = co.settings(spark, {"max_pages_per_app": 11, "delay_seconds": -1.0})
    assert sorted(r.subject for r in co.settings_violations(bad).collect()) == ["delay_seconds", "max_pages_per_app"]
    assert co.settings_violations(co.settings(spark)).isEmpty()
    assert lexicon.lexicon_from_table(lexicon.lexicon_table(spark)) == lexicon.ISSUE_TERMS
    with pytest.raises(ValueError):
        lexicon.check_lexicon({"ads": ("ad",)})


def test_page_files_stream_and_batch_agree(spark, make_pages, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for run, order, app, page, body in two_runs():
        (folder / f"app_{app}_us_page_{page}_2026010{run}T000000000000Z.json").write_text(body, encoding="utf-8")
    files = pages.read_page_files(spark, str(folder))
    assert sorted({(r.source_app_id, r.storefront, r.page_number) for r in files.collect()}) == [("a", "us", 1), ("b", "us", 1)]

    def as_pages(df):
        return df.select(F.substring("fetch_stamp", 8, 1).cast("long").alias("run_id"), F.lit(0).cast("long").alias("app_order"),
                         "source_app_id", "storefront", "page_number", F.lit(None).cast("timestamp").alias("fetched_at"),
                         F.lit("store").alias("source_platform"), F.lit("x").alias("source_endpoint"), "response_body")

    target = str(tmp_path / "state")
    handle = ingest.upsert_batch(target)
    seen = []

    def once_more(df, batch_id):
        handle(as_pages(df), batch_id)
        handle(as_pages(df), batch_id)  # a replayed batch must not change anything
        seen.append(batch_id)

    ingest.run_batches(ingest.stream_page_files(spark, str(folder), 1), once_more, str(tmp_path / "checkpoint"))
    batch = fold.review_upsert(loaded(as_pages(files))[1])
    streamed = ingest.read_state(spark, target)
    assert len(seen) == 4 and sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    ingest.compact_state(spark, target, str(tmp_path / "compacted"))
    assert sorted(map(str, ingest.read_state(spark, str(tmp_path / "compacted")).collect())) == sorted(map(str, batch.collect()))


def test_identity_stays_out(spark):
    assert not set(exports.TRAINING_COLUMNS) & set(exports.IDENTITY_COLUMNS)
    with pytest.raises(ValueError):
        exports.require_no_identity(spark.createDataFrame([("x",)], "author_uri string"))
    assert health.training_view is not None and landing.PLATFORM
