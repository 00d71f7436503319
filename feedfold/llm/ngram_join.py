"""Jaccard join of texts on word shingles by chosen paths.

Sets are embedded by min-wise hashing. In each run a tree splits them recursively: a node picks some coordinates at
random and puts every set into a child per picked coordinate and value, so similar sets share a path. Small nodes
are compared by brute force. Runs are repeated until pairs at the threshold meet with the target probability for the depth
the trees reached. Sets that meet are grouped, and all pairs of a group are verified on the whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedfold.llm.common import carried, identified, release, slices, spread_join
from feedfold.llm.graph import components, local_roots, pair_tasks
from feedfold.llm.hashing import Hasher, mix
from feedfold.session import written

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 128
# Sets that share a leaf are compared by one bit per coordinate. At the threshold 115 of 128 bits agree, give or take 3.4, so
# this many lie 4.5 standard deviations below, while unrelated sets agree in 64 give or take 5.7.
MEET_BITS = 100
RECALL = 0.999
RUNS_AT_ONCE = 8
# Nodes up to this size are compared by brute force, larger ones split while there is depth left and compared in blocks below that.
LEAF = 4096
DEPTH = 4
MEMBERS_PER_TASK = 50_000
# Elements of all sets in a verification task; a set counts as SET_WEIGHT elements more, which bounds the sets in a task.
ELEMENTS_PER_TASK = 1 << 18
SET_WEIGHT = 128
SEED = 5
# Bytes of text hashed at a time.
SLICE_BYTES = 1 << 19


def shingles(hasher: Hasher, texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a batch by text, and the number of each text's; fewer words make one shingle."""
    words = hasher.words(texts)
    h, doc, _ = hasher.windows(words, length)
    short = np.nonzero((words.counts > 0) & (words.counts < length))[0]
    if len(short):
        first = words.first[short]
        whole = mix(hasher.runs(words.hashes, first, first + words.counts[short]) + np.uint64(1))
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts))


def _signatures(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEED)
        factors = np.random.default_rng(SEED).integers(1, 1 << 31, (COORDINATES, 2), dtype=np.int64).astype(np.uint32) * 2 + 1
        for batch in slices(batches, "text", SLICE_BYTES):
            h, counts = shingles(hasher, batch.column(1), length)
            full = np.nonzero(counts)[0]
            if not len(full):
                continue
            at = (np.cumsum(counts) - counts)[full]
            low = mix(h).astype(np.uint32)
            minima = np.empty((len(full), COORDINATES), "<u2")
            for i, (a, b) in enumerate(factors):
                least = np.minimum.reduceat(low * a + b, at)
                minima[:, i] = (mix(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
            bits = np.packbits((minima & 1).astype(np.uint8), axis=1).view("<i8")
            digests = [np.add.reduceat(mix(h + np.uint64(s)), at).view(np.int64) for s in (11, 12)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(full)), *map(pa.array, digests), pa.array(counts[full].astype(np.int32)),
                 pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array([m.tobytes() for m in minima])],
                ["row_key", "d1", "d2", "n_shingles", "b1", "b2", "minima"])
            release()
    return run


def _pick(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, coordinate) of the coordinates that nodes pick, each with chance 1 / (SIMILARITY * COORDINATES)."""
    every = mix(node[:, None] * np.uint64(COORDINATES + 1) + np.arange(1, COORDINATES + 1, dtype=np.uint64))
    return np.nonzero(every < np.uint64(int((1 << 64) / (SIMILARITY * COORDINATES))))


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (node, rep, b1, b2, minima) go to a child per picked coordinate."""
    for batch in slices(batches, "minima", 1 << 18):
        node = batch.column(0).to_numpy().view(np.uint64)
        minima = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u2").reshape(len(node), COORDINATES)
        row, i = _pick(node)
        child = mix(mix(node[row] + i.astype(np.uint64)) + minima[row, i].astype(np.uint64) + np.uint64(1))
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(batch.column(c).take(at) for c in (1, 2, 3))],
                                         ["node", "rep", "b1", "b2"])


def _agree(bits: np.ndarray, left, right) -> np.ndarray:
    return COORDINATES - np.bitwise_count(bits[left] ^ bits[right]).sum(axis=-1) >= MEET_BITS


def _close(members: pa.Table) -> pa.Table:
    """Brute force in every node of a task: members whose bits agree enough, linked to the smallest they reach."""
    members = members.sort_by([("node", "ascending"), ("rep", "ascending")])
    node, rep, own = (members.column(c).to_numpy() for c in ("node", "rep", "own"))
    across = members.column("block").to_numpy() != members.column("other").to_numpy()
    bits = np.stack([members.column(c).to_numpy().view(np.uint64) for c in ("b1", "b2")], axis=1)
    cuts = np.nonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))[0]
    few = 8
    pairs = []
    for step in range(1, few):  # small nodes, all at once
        i = np.nonzero(node[step:] == node[:-step])[0]
        i = i[_agree(bits, i, i + step)]
        pairs.append((i, i + step))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for start in range(a, b - few, 256):
            rows = np.arange(start, min(start + 256, b - few))
            i, j = np.nonzero(_agree(bits, rows[:, None], np.arange(start + few, b)[None, :]))
            i, j = rows[i], j + start + few
            far = j - i >= few
            pairs.append((i[far], j[far]))
    left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
    meet = ~across[left] | (own[left] != own[right])
    left, right = left[meet], right[meet]
    root = local_roots(len(rep), left, right)
    linked = np.nonzero(root != np.arange(len(rep)))[0]
    return pa.table({"rep": pa.array(rep[linked]), "root": pa.array(rep[root[linked]])}).group_by(["rep", "root"]).aggregate([])


def _meeting_chance(depth: int) -> float:
    """Chance that a pair at the threshold shares a leaf of one run at this depth (a critical branching process)."""
    chance = 1.0
    for _ in range(depth):
        chance = 1 - math.exp(-chance)
    return chance


def chosen_path_links(reps: DataFrame, n: int, recall: float = RECALL) -> DataFrame:
    """Links (rep, root) between the n sets of the stored table (rep, b1, b2, minima) that met in a leaf and look similar."""
    found, runs, depth = [], 0, 1
    schema = "node long, rep long, b1 long, b2 long"
    while (need := math.ceil(math.log(1 - recall) / math.log(1 - _meeting_chance(depth)))) > runs:
        fresh = max(need, RUNS_AT_ONCE) - runs
        roots = F.explode(F.array(*[F.xxhash64(F.lit(f"run {runs + i}")) for i in range(fresh)])).alias("node")
        members = reps.select(roots, "rep", "b1", "b2", "minima").mapInArrow(_children, schema)
        runs += fresh
        tasks, level = max(1, n * fresh * 2 // MEMBERS_PER_TASK), 1
        while True:
            large = written(members.groupBy("node").count().filter(F.col("count") > LEAF).select("node"), "large-nodes")
            done = large.isEmpty()
            leaves = members if done else members.join(large, "node", "left_anti")
            plain = leaves.withColumns({"task": F.pmod("node", F.lit(tasks)), **{c: F.lit(0) for c in ("block", "other", "own")}})
            found.append(plain.groupBy("task").applyInArrow(_close, "rep long, root long"))
            if done:
                break
            large = written(members.join(large, "node", "left_semi"), "large-members")
            if level == DEPTH:
                blocks = pair_tasks(large, "node", "rep", F.lit(1), LEAF)
                found.append(blocks.groupBy("task").applyInArrow(_close, "rep long, root long"))
                break
            level += 1
            depth = max(depth, level)
            members = written(large.join(reps.select("rep", "minima"), "rep").select("node", "rep", "b1", "b2", "minima")
                              .mapInArrow(_children, schema), "paths")
    return reduce(DataFrame.unionByName, found)


def _sets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEED)
        for batch in slices(batches, "text", SLICE_BYTES):
            h, counts = shingles(hasher, batch.column(batch.schema.get_field_index("text")), length)
            sets = [x.tobytes() for x in np.split(h, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(counts.astype(np.int32)),
                                              pa.array(sets, pa.binary())], ["component", "rep", "copies", "elements", "shingles"])
            release()
    return run


def _verified(similarity: float):
    """All pairs of the components in a task: per set the copies linked to it and a link to the smallest set it reaches."""
    def run(members: pa.Table) -> pa.Table:
        members = members.sort_by([("component", "ascending"), ("rep", "ascending")])
        comp, rep, own, copies, size = (members.column(c).to_numpy() for c in ("component", "rep", "own", "copies", "elements"))
        block, other = (members.column(c).to_numpy() for c in ("block", "other"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for column in members.column("shingles").chunks for s in column]
        linked = np.zeros(len(rep), np.int64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cuts = np.nonzero(np.concatenate([[True], comp[1:] != comp[:-1], [True]]))[0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            one = np.arange(a, b)
            two = one
            if block[a] != other[a]:
                one, two = one[own[a:b] == block[a]], one[own[a:b] == other[a]]
            shared = _intersections([sets[i] for i in one], [sets[i] for i in two])
            ok = shared >= similarity * (size[one][:, None] + size[two][None, :] - shared) - 1e-9
            i, j = np.nonzero(ok)
            i, j = one[i], two[j]
            if block[a] == other[a]:
                i, j = i[i < j], j[i < j]
            np.add.at(linked, i, copies[j])
            np.add.at(linked, j, copies[i])
            left.append(i)
            right.append(j)
        root = local_roots(len(rep), np.concatenate(left), np.concatenate(right))
        some = np.nonzero(linked)[0]
        return pa.table({"rep": pa.array(rep[some]), "linked": pa.array(linked[some]), "root": pa.array(rep[root[some]])})
    return run


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set (sorted, without repeats)."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64)
    values, column, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    shared = times[column] > 1
    used = np.cumsum(times > 1) - 1
    order = np.argsort(used[column[shared]], kind="stable")
    row, column = row[shared][order], used[column[shared]][order]
    total, width = np.zeros((len(left), len(right)), np.float32), max(64, (2 << 20) // (len(left) + len(right)))
    for start in range(0, int((times > 1).sum()), width):
        i, j = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(left) + len(right), width), np.float32)
        part[row[i:j], column[i:j] - start] = 1
        total += part[:len(left)] @ part[len(left):].T
    return np.rint(total).astype(np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE,
                    similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Per row: row_key, doc_id, class_id, n_links, kept.

    Rows link if the Jaccard similarity of their sets of ``length``-word shingles (words as between spaces, unchanged; a
    shorter text is one shingle) is at least ``similarity``. n_links counts the other rows linked directly, class_id is the smallest
    id reached by links (null ids are smallest), and that row is kept. Texts with equal sets are joined once and counted as often as they
    occur. Null texts and texts without words link with nothing. Rows that agree in id and text are links of each
    other; one is kept. An empty table gives an empty result; other columns are not read.
    """
    rows = identified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    signed = written(rows.select("row_key", "text").mapInArrow(
        _signatures(length), "row_key long, d1 long, d2 long, n_shingles int, b1 long, b2 long, minima binary"), "signatures")
    classes = written(signed.groupBy("d1", "d2", "n_shingles").agg(F.min("row_key").alias("rep"), F.count(F.lit(1)).alias("copies")),
                      "set-classes")
    reps = signed.select(F.col("row_key").alias("rep"), "b1", "b2", "minima").join(classes.select("rep", "copies"), "rep")
    reps = written(reps.dropDuplicates(["rep"]), "representatives")
    met = components(chosen_path_links(reps, reps.count(), recall), "rep", "root")
    members = written(met.withColumnRenamed("node", "rep").join(reps.select("rep", "copies"), "rep"), "met-groups")
    texts = rows.select(F.col("row_key").alias("rep"), "text").join(members, "rep").select("component", "rep", "copies", "text")
    sets = written(texts.mapInArrow(_sets(length), "component long, rep long, copies long, elements int, shingles binary")
                   .dropDuplicates(["rep"]), "sets")
    tasks = pair_tasks(sets, "component", "rep", F.col("elements") + SET_WEIGHT, ELEMENTS_PER_TASK)
    links = written(tasks.groupBy("task").applyInArrow(_verified(similarity), "rep long, linked long, root long"), "verified")
    linked = links.groupBy("rep").agg(F.sum("linked").alias("linked"))
    groups = components(links.filter("rep != root"), "rep", "root").withColumnRenamed("node", "rep")
    owners = rows.select(F.col("row_key").alias("class_key"), F.col("doc_id").alias("class_id")).distinct()
    classes = written(
        classes.join(linked, "rep", "left").join(groups, "rep", "left")
        .withColumn("class_key", F.coalesce("component", "rep")).join(owners, "class_key")
        .select("d1", "d2", "n_shingles", "copies", "class_key", "class_id",
                (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    judged = spread_join(signed.select("row_key", "d1", "d2", "n_shingles"), classes, ["d1", "d2", "n_shingles"], "copies")
    judged = judged.select("row_key", "class_key", "class_id", "n_links").dropDuplicates(["row_key"])
    plain = rows.groupBy("row_key", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("n")).join(judged, "row_key", "left")
    return plain.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        "row_key", "doc_id", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.col("class_key").isNull() | ((F.col("class_key") == F.col("row_key")) & (F.col("copy") == 1))).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    judged = near_duplicates(docs, id_col, text_col).groupBy("row_key").agg(F.max("kept").alias("kept"), F.max("n_links").alias("n"))
    judged = written(judged, "near-copies")
    rows, unique = carried(docs, id_col, text_col)
    left = rows.join(judged.filter("not kept").select("row_key"), "row_key", "left_anti")
    if unique:
        return left.select("row.*")
    single = written(judged.filter("n > 0").select("row_key"), "once")
    return (left.join(single, "row_key", "left_semi").dropDuplicates(["row_key"])
            .unionByName(left.join(single, "row_key", "left_anti"))).select("row.*")
