"""Packing, archives, resampling and the whole pipeline."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from feedfold.llm import packing, quality, warc
from feedfold.llm.hashing import Hasher

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("length, targets, whole", [(64, None, 1 << 20), (16, {"src0": 3, "src1": 1}, 0), (2048, {"src2": 1.0}, 1 << 20)])
def test_packing(make_docs, odd_pairs, monkeypatch, length, targets, whole):
    monkeypatch.setattr(packing, "WHOLE_CHARS", whole)
    pairs = [p for p in odd_pairs if p[0] not in (9, None)]
    docs = make_docs(pairs, lambda i: None if i % 7 == 0 else f"src{i % 3}")
    tokens = packing.tokenize(docs, JSON, public_tokenizers.PATTERN)
    rows = packing.pack(tokens, length, targets).collect()
    per_doc, per_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append(r)
        per_sequence[r.sequence_id].append(r)
    for i, t in pairs:
        pieces = sorted(per_doc[i], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert ids == ids_of(t)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    sizes = []
    for number in sorted(per_sequence):
        pieces = sorted(per_sequence[number], key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        sizes.append(sum(r.length for r in pieces))
    assert sorted(per_sequence) == list(range(len(sizes)))
    total = sum(sizes)
    assert sizes[:total // length] == [length] * (total // length)
    assert all(s & (s - 1) == 0 for s in sizes)


def test_windows_keep_the_mixture(spark):
    totals = {"a": 60_000, "b": 30_000, "c": 10_000}
    docs = spark.createDataFrame([(i, " the" * 99, s) for s, n in totals.items() for i in range(n // 100)], "doc_id long, text string, source string")
    tokens = packing.tokenize(docs.repartition(7), JSON, public_tokenizers.PATTERN)
    windows = packing.pack(tokens, 1024).groupBy("sequence_id").pivot("source").sum("length").collect()
    for w in [w for w in windows if w.sequence_id < 97]:
        assert abs(w.a - 614.4) <= 3 and abs(w.b - 307.2) <= 3 and abs(w.c - 102.4) <= 3
    skewed = packing.pack(tokens, 1024, {"a": 1, "b": 1, "c": 2}).groupBy("sequence_id").pivot("source").sum("length").collect()
    early = [w for w in skewed if w.sequence_id < 15]
    assert all(abs(w.a - 256) <= 2 and abs(w.b - 256) <= 2 and abs(w.c - 512) <= 2 for w in early)
    assert packing.pack(tokens.limit(0), 1024).collect() == []


def test_schedule_serves_every_token_once():
    plan = packing.Schedule(np.array([50, 7, 200]), np.array([3 << 15, 1 << 14, 5 << 15]), 16)
    sources, begins, sizes = np.array([0, 0, 1, 2, 2]), np.array([0, 20, 0, 0, 150]), np.array([20, 30, 7, 150, 50])
    doc, start, length, sequence, offset = plan.pieces(sources, begins, sizes)
    slots = sorted((s, o + k) for s, o, n in zip(sequence, offset, length) for k in range(n))
    assert slots == [(i // 16, i % 16) for i in range(256)] + [(16, 0)]
    assert np.bincount(doc, length).tolist() == sizes.tolist()


def test_every_window_keeps_the_mixture_of_many_sources(spark):
    rows = [(i, " the" * 99, "a" if i < 300 else f"s{i % 600}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(packing.tokenize(docs.repartition(5), JSON, public_tokenizers.PATTERN), 256).collect()
    share = collections.Counter()
    for r in pieces:
        share[r.sequence_id] += r.length * (r.source == "a")
    assert sum(r.length for r in pieces) == 90_000
    assert all(abs(share[w] - 256 / 3) <= 11 for w in range(90_000 // 256))


@pytest.mark.parametrize("n, even", [(1, False), (3, False), (13, False), (40, True), (300, False), (700, True)])
def test_schedule_with_queues_that_run_dry(n, even):
    rng = np.random.default_rng(n)
    totals = rng.integers(1, 400, n)
    weights = totals if even else rng.choice([0.01, 0.5, 1.0, 3.0], n)
    plan, length = packing.Schedule(totals, weights, 32), 32
    half = totals // 2
    source, begin = np.repeat(np.arange(n), 2), np.stack([np.zeros(n, np.int64), half], 1).ravel()
    size = np.stack([half, totals - half], 1).ravel()
    source, begin, size = source[size > 0], begin[size > 0], size[size > 0]
    doc, start, taken, sequence, offset = plan.pieces(source, begin, size)
    full = totals.sum() // length
    slots = sorted((s, o + k) for s, o, m in zip(sequence, offset, taken) for k in range(m))
    assert slots[:full * length] == [(i // length, i % length) for i in range(full * length)]
    assert len(slots) == len(set(slots)) == totals.sum() and np.bincount(doc, taken).tolist() == size.tolist()
    before = {}
    for d, s, m, w in zip(doc.tolist(), start.tolist(), taken.tolist(), sequence.tolist()):
        assert before.get(int(source[d]), (-1, 0)) <= (w, begin[d] + s)
        before[int(source[d])] = (w, begin[d] + s)
    served = np.zeros((full, n))
    whole = sequence < full
    np.add.at(served, (sequence[whole], source[doc[whole]]), taken[whole])
    served = np.cumsum(served, axis=0)
    times = np.sort(totals / weights)
    for w in range(full):  # the time at which all have served so much, and what each should have by then
        low, high = 0.0, times[-1]
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if np.minimum(totals, middle * weights).sum() < (w + 1) * length else (low, middle)
        assert np.abs(served[w] - np.minimum(totals, high * weights)).max() <= 1 + np.log2(n)


def test_exact_division_of_long_products():
    rng = np.random.default_rng(3)
    a, c = rng.integers(-1 << 43, 1 << 43, 999), rng.integers(1, 1 << 43, 999)
    b = rng.integers(0, c + 1)
    assert packing.times_divided(a, b, c).tolist() == [int(x) * int(y) // int(z) for x, y, z in zip(a, b, c)]


def pages_table(spark):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 900 + "</p>"
    rows = [(1, "http://a.com/", big), (2, "http://b.com/x y\r\nX: 1", big), (3, None, big), (4, "u", "small"), (5, "u", "small"),
            (6, "", None), (7, "u", ""), (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000),
            (11, "u", "y" * 1000), (None, "n", "y" * 1000), (None, None, None)]
    return rows, spark.createDataFrame([(*r, "k", 5) for r in rows], "page_id long, url string, html string, sha string, copy int")


@pytest.mark.parametrize("segment_bytes", [100, 16384])
def test_archives_round_trip(spark, segment_bytes):
    rows, pages = pages_table(spark)
    path = warc.write_archives(pages, segment_bytes=segment_bytes)
    records = warc.read_archives(spark, path).cache()
    payloads = collections.Counter((r.page_id, bytes(r.payload)) for r in records.collect() if r.record_type == "response")
    assert set(payloads) <= {(i, (h or "").encode()) for i, _, h in rows}
    assert all(r.complete for r in records.collect())
    assert (max(r.n_segments for r in records.collect()) > 1) == (segment_bytes == 100) or segment_bytes > 100
    got = warc.resolved(records).collect()
    assert all(r.intact for r in got)
    facts = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data and j is not None]
        largest = max(same, default=None)
        revisit = len(data) >= 1000 and i != largest
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", largest if revisit else None] += 1
    twice = (11, 1000, hashlib.sha1(b"y" * 1000).hexdigest())
    want[(*twice, "response", None)] -= 1
    want[(*twice, "revisit", 11)] += 1
    assert facts == +want
    assert warc.resolved(warc.read_archives(spark, warc.write_archives(pages.limit(0)))).collect() == []


def test_damaged_segments_are_told(spark):
    def record(kind, name, number, block, origin="", total=""):
        extra = (f"WARC-Segment-Origin-ID: {origin}\r\n" if origin else "") + (f"WARC-Segment-Total-Length: {total}\r\n" if total else "")
        return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nWARC-Segment-Number: {number}\r\n{extra}"
                f"Content-Length: {len(block)}\r\n\r\n{block}")
    body = warc.HTTP_HEAD + "5\r\nhello\r\n0\r\n\r\n"
    cut = [body[:40], body[40:80], body[80:]]
    rows = [record("continuation", "<c>", 3, cut[2], "<a>", len(body)), record("response", "<a>", 1, cut[0]),
            record("continuation", "<b>", 2, cut[1], "<a>"),
            record("response", "<d>", 1, cut[0]), record("continuation", "<e>", 3, cut[2], "<d>", len(body)),
            record("response", "<f>", 1, cut[0]), record("continuation", "<g>", 2, cut[1], "<f>", len(body)),
            record("continuation", "<h>", 2, cut[1], "<lost>", 9)]
    path = warc.fresh_path(spark, "damaged")
    spark.createDataFrame([(r,) for r in rows], "value string").repartition(4).write.option("lineSep", "\r\n\r\n").text(path)
    got = {r.record_id: (r.complete, r.payload and bytes(r.payload)) for r in warc.read_archives(spark, path).collect()}
    assert got == {"<a>": (True, b"hello"), "<d>": (False, None), "<f>": (False, None), "<h>": (False, None)}


def test_chunked_framing():
    assert warc.unchunk(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    head = warc.HTTP_HEAD.encode()
    assert warc.unchunk(head + b"3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    assert warc.unchunk(head + b"5\r\nab") is None and warc.unchunk(b"no head") is None


def brute_ngrams(hasher, text):
    return [set(g.tolist()) for _, g in quality.ngrams(hasher, pa.array([text], pa.string()))]


def test_log_weights_equal_brute_force(spark, make_docs, prose, monkeypatch):
    monkeypatch.setattr(quality, "SLOTS", 1 << 17)
    good = {i: " ".join(prose(i, 60)) for i in range(60)}
    bad = {100 + i: " ".join([*prose(100 + i, 50), "idiot", "scum", "*** ***", "w w w w w"]) for i in range(30)}
    pairs = [*good.items(), *bad.items(), (200, None), (201, "")]
    docs = make_docs(pairs).select("doc_id", "text").withColumn("row_key", F.col("doc_id"))
    targets = np.arange(0, 60, 2)
    counts = quality.fit_counts(docs, targets)
    hasher = Hasher(quality.SEED)
    grams = {i: brute_ngrams(hasher, t) for i, t in pairs}
    tables = np.zeros((2, quality.ORDERS, quality.COPIES, quality.SLOTS))
    for i, found in grams.items():
        for order, one in enumerate(found):
            for copy in range(quality.COPIES):
                for g in one:
                    slot = (g >> (24 * copy)) % quality.SLOTS
                    tables[1, order, copy, slot] += 1
                    tables[0, order, copy, slot] += i in targets
    assert (counts == tables).all()
    scales = quality.model_scales(counts)
    assert (scales > 0).all() and (scales < 0.6).all()
    settings = [(1.0, 0.5), (0.3, 0.0)]
    model = spark.sparkContext.broadcast((counts, scales))
    got = {r.doc_id: r.weights for r in quality.log_weights(docs, model, settings).collect()}
    for i, found in grams.items():
        for k, (pseudo, least) in enumerate(settings):
            want = 0.0
            for order, one in enumerate(found):
                for g in one:
                    a, b = (math.log((tables[0, order, c, s] + pseudo) / (tables[1, order, c, s] * scales[order, c] + pseudo))
                            for c, s in ((c, (g >> (24 * c)) % quality.SLOTS) for c in range(2)))
                    a, b = (x if abs(x) >= least else 0 for x in (a, b))
                    want += (a if abs(a) < abs(b) else b) if a * b > 0 else 0
            assert got[i][k] == pytest.approx(want, abs=1e-3)


def test_every_distinct_ngram_has_a_count_of_its_own(make_docs, prose, monkeypatch):
    monkeypatch.setattr(quality, "SLOTS", 1 << 8)  # as full as the old tables were at many GB
    monkeypatch.setattr(quality, "HELD_GRAMS", 300)
    good = {i: " ".join(prose(i, 60)) for i in range(120)}
    bad = {200 + i: " ".join([*prose(200 + i, 50), "idiot", "scum", "w w w w w"]) for i in range(60)}
    pairs = [*good.items(), *bad.items(), (300, None), (301, ""), (302, good[1]), (302, good[1])]
    docs = make_docs(pairs)
    labels = docs.sparkSession.createDataFrame([(i, 1, 0) for i in good] + [(i, 0, 1) for i in bad], "doc_id long, quality int, toxic int")
    rows = quality.importance_sample(docs, labels, temperature=0.0).collect()
    left = collections.Counter(r.doc_id for r in rows)
    assert not set(bad) & set(left) and set(good) <= set(left) and left[302] == 2
    hasher, labelled = Hasher(quality.SEED), quality.labelled_sample(labels)
    keyed = quality.identified(docs.select("doc_id", "text"))
    ranges = quality.Ranges(6, 48)
    counts = quality.count_ngrams(keyed, labelled.good, ranges, 1)
    scales = quality.target_scales(counts)
    grams = [(i, brute_ngrams(hasher, t)) for i, t in pairs]
    tables = [[collections.Counter(g >> 17 for i, one in grams if not t or i in labelled.good for g in one[o]) for o in range(2)] for t in (1, 0)]
    settings = [(1.0, 0.5), (0.3, 0.0)]
    got = quality.weigh(keyed, quality.ngram_weights(counts, scales, settings, ranges), 2, ranges).collect()
    got = {r.doc_id: (r.weights, r.copies) for r in got}
    assert got[302][1] == 2 and len(got) == len(pairs) - 1
    for i, found in grams:
        for k, (pseudo, lowest) in enumerate(settings):
            ratios = [math.log((tables[0][o][g >> 17] + pseudo) / (tables[1][o][g >> 17] * scales[o] + pseudo)) for o in range(2) for g in found[o]]
            assert got[i][0][k] == pytest.approx(sum(x for x in ratios if abs(x) >= lowest), abs=1e-5)


def test_gumbel_top_k_is_exact_and_repeatable(spark):
    rows = spark.createDataFrame([(i, i, float(i % 5), 1) for i in range(2000)] + [(5000, 5000, 2.0, k) for k in range(1, 9)],
                                 "row_key long, doc_id long, log_weight double, occurrence int")
    every = sorted((r.sampling_key for r in quality.gumbel_top_k(rows, 5000).collect()), reverse=True)
    assert len(every) == 2008
    for k in (0, 1, 700, 2008):
        one, two = ([(r.row_key, r.occurrence, r.sampling_key) for r in quality.gumbel_top_k(f, k).collect()] for f in (rows, rows.repartition(5)))
        assert sorted(one) == sorted(two) and sorted((x[2] for x in one), reverse=True) == every[:k]
    noisy = quality.gumbel_top_k(rows, 400, temperature=50.0).agg(F.countDistinct("log_weight")).first()[0]
    assert noisy == 5


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    shown = labels.filter("doc_id % 5 != 0")
    kept = {r.doc_id for r in quality.importance_sample(docs, shown).collect()}
    hidden = labels.filter("doc_id % 5 = 0").collect()
    good = [r.doc_id in kept for r in hidden if r.quality == 1 and r.toxic == 0]
    bad = [r.doc_id in kept for r in hidden if r.quality == 0 or r.toxic == 1]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.6, (np.mean(good), np.mean(bad))


def test_resampling_odd_input(make_docs, odd_pairs, spark):
    docs = make_docs(odd_pairs)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    left = quality.keep_sampled(docs, labels)
    assert left.columns == docs.columns and left.count() == len(odd_pairs)
    assert quality.keep_sampled(docs.limit(0), labels).collect() == []


def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    left = {r.doc_id for r in rows}
    assert left < set(docs) and len(left) > 100
    folded = [(docs[i].text or "").lower() for i in left]
    assert len(folded) == len(set(folded))
    assert len(corpus_pipeline.STAGES) == 5
    whole = collections.Counter()
    for r in rows:
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in rows)
    plain = [i for i in left if not any(c in docs[i].text for c in "0123456789@=:")]
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i in plain[:25]:
        ids = np.array(ids_of(docs[i].text), "<u4")
        assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in by_doc[i])


def test_a_cut_archive_ends_in_an_incomplete_record(spark, tmp_path):
    rows = [(i, f"http://a.com/{i}", "x" * 300) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages)
    files = [bytes(r.content).decode() for r in spark.read.format("binaryFile").load(path).collect()]
    data = next(x for x in files if x)
    last = data.rindex("WARC/1.1")
    name = data.index("WARC-Record-ID", last)
    for cut in (last + 3, name + 4, name + 70, data.index("\r\n\r\n", last) + 40, len(data) - 60):
        (tmp_path / str(cut)).mkdir()
        (tmp_path / str(cut) / "cut.warc").write_bytes(data[:cut].encode())
        got = [(r.complete, r.payload and bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path / str(cut))).collect()]
        assert sorted(got, key=str)[-2:] == [(True, b"x" * 300)] * 2
        assert [x for x in got if not x[0]] == [(False, None)] * (cut > name + 60) and len(got) == 2 + (cut > name + 60)
    assert warc.unchunk(warc.HTTP_HEAD.encode() + b"zz\r\nab\r\n0\r\n\r\n") is None


def test_rows_of_one_id_and_payload_are_numbered_in_slices(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLICE_ROWS", 16)
    rows = spark.range(0, 600, 1, 4).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("page_id"), F.lit("u").alias("url"), (F.col("id") % 2).cast("string").alias("sha"))
    got = collections.defaultdict(list)
    for r in warc._numbered(rows).collect():
        got[r.page_id, r.sha].append(r.copy)
    assert sum(map(len, got.values())) == 600 and len(got) == 16
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())


@pytest.mark.parametrize("whole", [1 << 20, 0])
def test_special_tokens_in_a_text_are_read_as_the_library_does(make_docs, monkeypatch, whole):
    monkeypatch.setattr(packing, "WHOLE_CHARS", whole)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "plain <|endoftext", None, "", "two\n<|endoftext|>\n"]
    library = Tokenizer.from_file(JSON)
    rows = packing.tokenize(make_docs(list(enumerate(texts))), JSON, public_tokenizers.PATTERN).collect()
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in rows}
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert 50256 in got[0]
