"""Exact groups, the Jaccard join and the vector forest against brute force."""

import collections
import hashlib
import math
import random
import re
import string

import pytest

from feedfold.llm import exact_dedup, graph, ngram_join, vector_dedup
from feedfold.llm.common import spread_join

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.mark.parametrize("block_bytes", [4, 1024])
def test_exact_groups(make_docs, odd_pairs, block_bytes):
    got = exact_dedup.exact_groups(make_docs(odd_pairs), block_bytes=block_bytes).collect()
    groups = collections.defaultdict(list)
    for i, t in odd_pairs:
        groups[(t or "").translate(FOLD)].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_groups_hot_and_empty(spark, make_docs):
    pairs = [(i, "same text " * 30 if i % 3 == 0 else f"text {i}") for i in range(900)]
    got = exact_dedup.exact_groups(make_docs(pairs), block_bytes=16).filter("kept").collect()
    assert sorted(r.group_size for r in got) == [1] * 600 + [300]
    assert exact_dedup.exact_groups(make_docs(pairs).limit(0)).collect() == []


def test_drop_exact_copies_keeps_columns(make_docs, odd_pairs):
    docs = make_docs(odd_pairs)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    texts = [(r.text or "").translate(FOLD) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(FOLD) for _, t in odd_pairs})


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_classes(pairs, similar):
    rows = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""))
    links = [[j for j in range(len(rows)) if j != i and similar(rows[i][1], rows[j][1])] for i in range(len(rows))]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            low = min([root[i], *(root[j] for j in near)])
            if low < root[i]:
                root[i], changed = low, True
    return collections.Counter((rows[i][0], rows[root[i]][0], len(links[i])) for i in range(len(rows)))


def test_near_duplicates(make_docs, odd_pairs, prose):
    rng = random.Random(3)
    pairs = list(odd_pairs)
    for g in range(6):
        base = prose(100 + g, 200)
        for c in range(8):
            words = list(base)
            for _ in range(rng.randrange(0, 7)):
                words[rng.randrange(200)] = f"edit{rng.randrange(10**6)}"
            pairs.append((1000 + 10 * g + c, " ".join(words)))
    sets = {t: shingle_set(t) for _, t in pairs}

    def similar(a, b):
        x, y = sets[a], sets[b]
        return bool(x) and len(x & y) >= 0.8 * len(x | y) - 1e-9

    docs = make_docs(pairs)
    got = ngram_join.near_duplicates(docs).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(pairs, similar)
    left = ngram_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == sum(r.kept for r in got)
    assert ngram_join.near_duplicates(docs.limit(0)).collect() == []


def test_large_nodes_split_and_blocks_cover_all_pairs(spark, make_docs, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    monkeypatch.setattr(ngram_join, "MEMBERS_PER_TASK", 10)
    monkeypatch.setattr(ngram_join, "ELEMENTS_PER_TASK", 2000)
    base = prose(5, 300)
    pairs = [(i, " ".join([*base[:i * 7], f"edit{i}", *base[i * 7 + 1:]])) for i in range(40)]
    got = ngram_join.near_duplicates(make_docs(pairs)).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 39)}


def test_meeting_chance_sets_the_runs():
    assert ngram_join._meeting_chance(1) == pytest.approx(1 - math.exp(-1))
    assert ngram_join._meeting_chance(3) < ngram_join._meeting_chance(2) < 0.5


def cosine(a, b):
    usable = [v for v in (a, b) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    if len(usable) < 2 or len(a) != len(b):
        return 0.0
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def vector_rows():
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(120)]
    for g in range(10):
        rows += [(200 + 10 * g + c, [x + rng.gauss(0, 0.1) for x in rows[g][1]]) for c in range(6)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, [2 * x for x in rows[1][1]]), (403, None), (404, []), (405, [0.0] * 12),
             (406, [None, *rows[0][1][1:]]), (407, [float("nan")] * 12), (408, [float("inf")] * 12), (409, rows[0][1][:6]),
             (410, [-0.0, 1.0] + [0.0] * 10), (411, [0.0, 1.0] + [0.0] * 10)]
    return rows


@pytest.mark.parametrize("cell, leaf", [(8192, 1024), (40, 16)])
def test_near_vectors(spark, monkeypatch, cell, leaf):
    monkeypatch.setattr(vector_dedup, "CELL", cell)
    monkeypatch.setattr(vector_dedup, "LEAF", leaf)
    monkeypatch.setattr(vector_dedup, "TREES", 16)
    monkeypatch.setattr(vector_dedup, "SAMPLED_LEVELS", 1)
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "2 AS rep", "3 AS cell")
    got = vector_dedup.near_vectors(table).collect()
    assert collections.Counter((r.vec_id, r.component_id, r.n_links) for r in got) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def brute_vectors(rows):
    links = {i: {j for j, w in rows if j != i and cosine(v, w) >= 0.95} for i, v in rows}
    root = {i: i for i, _ in rows}
    for _ in rows:
        for i, near in links.items():
            root[i] = min([root[i], *(root[j] for j in near)])
    return collections.Counter((i, root[i], len(links[i])) for i, _ in rows)


def test_near_vectors_hot_cluster_repeats_and_empty(spark):
    rows = [(i, [1.0, 0.0, 0.0]) if i % 3 == 0 else (i, [math.cos(i), math.sin(i), float(i % 7)]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(table).collect()}
    assert all(got[i].component_id == 0 and got[i].n_links >= 99 for i in range(0, 300, 3))
    assert vector_dedup.near_vectors(table.limit(0)).collect() == []
    repeated = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<double>")
    found = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_vectors(repeated).collect())
    assert found == {(1, 2, None): 2, (None, 2, None): 1, (2, 0, 2): 1}


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200} == got


def test_spread_join_equals_join(spark):
    rows = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(3000)], "k long, v long")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n").filter("k % 5 != 1")
    for how in ("inner", "left"):
        assert sorted(map(tuple, spread_join(rows, groups, ["k"], "n", how).select("k", "v", "n").collect()), key=repr) == \
            sorted(map(tuple, rows.join(groups, "k", how).select("k", "v", "n").collect()), key=repr)
