"""Line deduplication, source divergence and hard negatives against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedfold.llm import divergence, hard_negatives, line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- lines ----------------------------------------------------------------------------------------

def brute_lines(pairs, min_chars, min_docs):
    holders = defaultdict(set)
    order = {p: (p[0] is not None, p[0] or 0) for p in set(pairs)}
    for p in set(pairs):
        for line in (p[1] or "").split("\n"):
            holders[line.strip(" \t\n\v\f\r").translate(LOWER)].add(p)
    out = []
    for p in pairs:
        kept, dropped = [], []
        lines = (p[1] or "").split("\n")
        for i, line in enumerate(lines):
            key = line.strip(" \t\n\v\f\r").translate(LOWER)
            common = len(key) >= min_chars and len(holders[key]) >= min_docs
            if common and max(holders[key], key=order.get) != p:
                dropped.append(i)
            else:
                kept.append(line)
        out.append((p[0], len(lines), len(dropped), dropped, "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def line_pairs():
    rng = random.Random(5)
    common = [f"Shared line {i} that says {'é' * (i % 4)} the same thing everywhere" for i in range(60)]
    short = [f"short {i}" for i in range(5)]
    pairs = []
    for doc in range(120):
        lines = [rng.choice(["", "  ", "\t"]) + rng.choice(common).translate(LOWER if doc % 3 else {}) + rng.choice(["", " \r", "\v"])
                 for _ in range(rng.randrange(6))]
        lines += [rng.choice(short) for _ in range(rng.randrange(3))] + [f"line of {doc} alone, {rng.random()}, nowhere else to be found"]
        lines += [common[0]] * (doc % 3 == 0)  # a third of all documents
        rng.shuffle(lines)
        pairs.append((doc, "\n".join(lines)))
    pairs += [(500, None), (501, ""), (502, "\n\n"), (503, common[1]), (504, "x" * 300_000 + "\n" + common[2]), (505, common[0].upper())]
    return pairs


@pytest.mark.parametrize("room", [1 << 20, 600, 0])
def test_lines_equal_brute_force_however_many_arrays_are_sent(make_docs, line_pairs, room):
    got = line_dedup.drop_repeated_lines(make_docs(line_pairs), broadcast_bytes=room).collect()
    rows = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.dropped, r.kept_text) for r in got), key=repr)
    assert rows == brute_lines(line_pairs, 40, 5)


def test_lines_with_other_bounds_repeated_rows_and_null_ids(make_docs, line_pairs):
    pairs = line_pairs[:40] + line_pairs[30:40] + [(None, line_pairs[3][1]), (None, None), (None, line_pairs[3][1])]
    for room in (1 << 20, 0):
        got = line_dedup.drop_repeated_lines(make_docs(pairs), min_chars=6, min_docs=2, broadcast_bytes=room).collect()
        rows = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.dropped, r.kept_text) for r in got), key=repr)
        assert rows == brute_lines(pairs, 6, 2)
    assert line_dedup.drop_repeated_lines(make_docs(pairs).limit(0)).collect() == []


def test_perfect_hash_numbers_every_key_once():
    rng = np.random.default_rng(3)
    one, two = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    one[:50] = one[0]  # equal first halves must part by the second
    sizes, bits, order = line_dedup._perfect_hash(one, two)
    assert sorted(order.tolist()) == list(range(5000)) and bits.sum() == 5000 and len(sizes) < 40
    prints = two[order].view(np.uint8).reshape(-1, 8)[:, :3].tobytes()
    shard = line_dedup._shard(one, 1)
    assert not shard.any()
    row = (0, sizes.tobytes(), np.packbits(bits).tobytes(), prints, np.arange(5000).tobytes(), np.arange(5000).tobytes())
    index = line_dedup.LineIndex.of([row], 1, 3)
    assert index.probe(one[order], two[order]).tolist() == list(range(5000))
    strange = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    assert (index.probe(*strange) >= 0).sum() <= 3


# --- divergence -----------------------------------------------------------------------------------

def brute_divergence(rows, min_docs, top):
    docs, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for i, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            term = term.translate(LOWER)
            docs[lang, term].add(i)
            counts[lang, source][term] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), held in docs.items() if x == lang and len(held) >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def chance(n, all_n):
            return 1 + 10**9 * (n + 1) // (all_n + len(kept))

        def price(p, q):
            return (p - q) * (p - q) // q

        for s in sources:
            pairs = [(o, sum(price(chance(counts[lang, s][t], total[s]), chance(counts[lang, o][t], total[o])) for t in kept))
                     for o in sources if o != s]
            terms = []
            for t in kept:
                p, q = chance(counts[lang, s][t], total[s]), chance(whole[t], sum(total.values()))
                if counts[lang, s][t] and p > q:
                    terms.append((t, price(p, q)))
            for part, found, last in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(found[:last], 1)]
    return sorted(out)


@pytest.mark.parametrize("leaves, at_once, top", [(1 << 19, 128, 200), (300, 3, 200), (1 << 19, 128, 4)])
def test_divergence_equals_brute_force(spark, monkeypatch, leaves, at_once, top):
    monkeypatch.setattr(divergence, "BLOCK_LEAVES", leaves)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("Alpha", "beta", "Größe", "naïve", "日本") for b in "abcdefghijklmnop"]
    rows = []
    for doc in range(300):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "s1", "s2", "s3", None, ""])
        words = rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randrange(30))
        rows.append((lang, source, "".join(w + rng.choice([" ", "_", "1", "\n", "@"]) for w in words)))
    rows += [("en", "empty", None), ("en", "empty", ""), ("xx", "a", "once"), ("xx", "b", "twice"), ("de", "s1", "Wort " * 5000),
             ("yy", "only", "w w w")] + [("en", "s1", "repeated row")] * 4
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows],
                                 "lang string, source string, text string, n long, docs long, term string, part string").repartition(3)
    got = divergence.source_divergence(docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, 3, top)
    assert divergence.source_divergence(docs.limit(0)).collect() == []


def test_equal_subtrees_are_one_node_and_pairs_are_carried_on_once():
    leaves = np.array([[1, 2, 1, 2, 0, 0, 0, 0], [1, 2, 0, 0, 1, 2, 0, 0], [0] * 8])
    forest = divergence.Forest(leaves)
    assert [len(left) for left, _ in forest.children] == [2, 3, 3]  # (1,2) and (0,0) serve all trees
    which, one, two, times = forest.pairs(np.array([0, 1]), np.array([2, 0]))
    assert {(w, a, b): n for w, a, b, n in zip(*map(np.ndarray.tolist, (which, one, two, times)))} == {
        (0, 0, 0): 4, (0, 1, 0): 2, (0, 2, 0): 2, (1, 1, 1): 1, (1, 2, 2): 1, (1, 0, 1): 1, (1, 0, 2): 1, (1, 1, 0): 1, (1, 2, 0): 1, (1, 0, 0): 2}
    place, leaf = forest.places(1, np.array([False, True, True]))
    assert dict(zip(place.tolist(), leaf.tolist())) == {0: 1, 1: 2, 4: 1, 5: 2}


def test_chances_are_exact_for_counts_beyond_64_bits():
    assert divergence._probabilities(np.array([10**12]), 10**15, 10**9).tolist() == [1 + 10**9 * (10**12 + 1) // (10**15 + 10**9)]
    values, times = np.array([10**18, 10**18 - 1]), np.array([9, 7])
    assert divergence._summed(np.array([0, 0]), values, times, 1) == [9 * 10**18 + 7 * (10**18 - 1)]


# --- hard negatives -------------------------------------------------------------------------------

def brute_negatives(rows, positives=5, negatives=3):
    usable = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in vector])
        if any(abs(256 * float(np.float32(x))) > hard_negatives.LARGEST for x in vector):
            continue
        usable[vec_id] = min(usable.get(vec_id, row), row)
    out = []
    for anchor, (label, vector) in usable.items():
        if anchor % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(vector, v)), i, x) for i, (x, v) in usable.items() if i != anchor and len(v) == len(vector)]
        scored.sort()
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fine = [s for s in scored if s[2] != label and -50 * score <= -100 * s[0] <= -95 * score][:negatives]
            out += [(anchor, positive, rank, i, -score, -s) for rank, (s, i, _) in enumerate(fine, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 0.15, (6, 20))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.08, 20)).tolist(), int((i // 3) % 3) if i % 4 else 0) for i in range(900)]
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(30)]  # ties
    rows += [(2000, None, 1), (2050, [None] * 20, 1), (2100, [float("nan")] * 20, 1), (2150, [float("inf")] * 20, 2), (2200, rows[0][1], None),
             (None, rows[0][1], 1), (2250, [0.0] * 20, 1), (2300, [1e30] * 20, 1), (2350, [0.1, 0.2], 1), (2351, [0.1, 0.3], 1), (2352, [0.1, 0.15], 2),
             (2400, [], 1), (2450, [-0.2] * 20, 1), (2500, rows[7][1], 2)]
    return rows


@pytest.mark.parametrize("segment, anchors, step", [(16_384, 4_096, 8), (60, 3, 1), (60, 3, 64)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, vector_rows, segment, anchors, step):
    for name, value in (("SEGMENT_ROWS", segment), ("ANCHOR_ROWS", anchors), ("STEP", step)):
        monkeypatch.setattr(hard_negatives, name, value)
    repeated = step == 1
    rows = vector_rows + (vector_rows[:60] + [(100, vector_rows[3][1], 2), (100, vector_rows[3][1], 0)] if repeated else [])
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows],
                                  "vec_id long, embedding array<float>, label int, segment long, rank int, ids string").repartition(3)
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    if repeated:
        assert hard_negatives.hard_negatives(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_scan_leaves_out_candidates_before_all_dimensions_are_read(monkeypatch):
    rng = np.random.default_rng(2)
    values = rng.integers(-200, 200, (64, 3000)).astype(np.int32)
    values[:, :5] = 150
    row = {"ids": np.arange(3000).tobytes(), "columns": values.tobytes(), "dims": 64}
    segment, query = hard_negatives.Segment(row, np.float64), np.full(64, 100.0)
    sizes = []

    def needed(lower, upper):
        sizes.append(len(lower))
        return upper >= np.partition(lower, -5)[-5]

    rows, score = segment.scan(query, np.arange(3000), needed)
    assert set(range(5)) <= set(rows.tolist()) and score[rows < 5].tolist() == [64 * 150 * 100] * 5
    assert sizes[-1] < 100 and len(sizes) == 8
    assert pa.array(score).type == pa.int64()
