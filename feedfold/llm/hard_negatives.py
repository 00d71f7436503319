"""Hard-negative mining by BOND vertical scans.

Rows are stored in segments of one label, dimension by dimension, with each dimension's smallest and largest value. An anchor reads a
segment's dimensions in descending order of its own magnitudes. After every few of them the extremes of the remaining ones bound each
candidate's score; the bitmap of candidates shrinks to those that may still be among the best, or may still fall into a window, until
the scores are exact. Anchors, the stated query set, meet all segments in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedfold.llm.common import release
from feedfold.session import written

POSITIVES, NEGATIVES = 5, 3
# Negatives score from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 50, 95
# Rows of a segment, anchors of a block, and dimensions read between two looks at the bounds.
SEGMENT_ROWS, ANCHOR_ROWS, STEP = 16_384, 4_096, 8
# Components are whole numbers up to this size, so that scores are exact in 64 bits.
LARGEST = 1 << 24
PARTS = "segment long, label int, dims int, ids binary, columns binary"
FOUND = "anchor_id long, row_id long, score long"
NEGATIVE = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def _columnar(rows: pa.Table) -> pa.Table:
    """A segment or a block of anchors as one row: ids, and the components by dimension."""
    rows = rows.sort_by("vec_id")
    dims = rows.column("dims")[0].as_py()
    values = np.array(rows.column("vector").combine_chunks().flatten(), np.int32).reshape(-1, dims)
    return pa.table({"segment": rows.column("segment").slice(0, 1), "label": rows.column("label").slice(0, 1),
                     "dims": rows.column("dims").slice(0, 1), "ids": pa.array([rows.column("vec_id").to_numpy().tobytes()]),
                     "columns": pa.array([np.ascontiguousarray(values.T).tobytes()])})


def columnar(rows: DataFrame, at_most: int, label: str) -> DataFrame:
    """A stored table of the rows in segments of one label and length, of about ``at_most`` rows; a commoner label has more segments."""
    sizes = rows.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("_n"))
    sizes = written(sizes.withColumn("_k", F.ceil(F.col("_n") / at_most)), "segment-sizes")
    part = F.pmod(F.xxhash64("vec_id"), F.col("_k"))
    named = rows.join(sizes, ["label", "dims"]).withColumn("segment", F.xxhash64("label", "dims", part))
    return written(named.select("segment", "label", "dims", "vec_id", "vector").groupBy("segment").applyInArrow(_columnar, PARTS), label)


class Segment:
    """Columns of a segment with their extremes."""

    def __init__(self, row: dict, exact: type) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.columns = np.frombuffer(row["columns"], np.int32).reshape(row["dims"], -1).astype(exact)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, needed) -> tuple[np.ndarray, np.ndarray]:
        """The candidates left and their exact scores.

        ``needed(lower, upper)`` flags those whose score, which lies between the bounds, may still matter.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        anchor = anchor[order]
        low, high = anchor * self.least[order], anchor * self.most[order]
        below, above = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (np.minimum(low, high), np.maximum(low, high)))
        score = np.zeros(len(candidates), self.columns.dtype)
        for start in range(0, len(order), STEP):
            if not len(candidates):
                break
            read = self.columns[order[start:start + STEP]]
            score = score + anchor[start:start + STEP] @ (read if len(candidates) == read.shape[1] else read[:, candidates])
            end = min(start + STEP, len(order))
            left = needed(score + below[end], score + above[end])
            if not left.all():
                candidates, score = candidates[left], score[left]
        return candidates, score.astype(np.int64)


def _opened(segments: pa.Table, anchors: pa.Table):
    """A segment and a block of anchors (their ids and one row of components each)."""
    segment, block = segments.to_pylist()[0], anchors.to_pylist()[0]
    queries = np.frombuffer(block["columns"], np.int32).reshape(block["dims"], -1)
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(np.frombuffer(segment["columns"], np.int32)).max(initial=0)) * segment["dims"]
    exact = np.float64 if largest < 1 << 53 else np.int64  # whole numbers either way, the first is faster
    return Segment(segment, exact), np.frombuffer(block["ids"], np.int64), np.ascontiguousarray(queries.T).astype(exact), block


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _positives(k: int):
    """The best k rows of a segment for each anchor of a block, itself aside."""
    def run(segments: pa.Table, anchors: pa.Table) -> pa.Table:
        if not segments.num_rows or not anchors.num_rows:
            return pa.table({c.split()[0]: pa.array([], pa.int64()) for c in FOUND.split(", ")})
        segment, ids, queries, _ = _opened(segments, anchors)

        def needed(lower, upper):
            if len(lower) <= k:
                return np.ones(len(lower), bool)
            return upper >= np.partition(lower, -k)[-k]

        found = []
        for anchor, query in zip(ids, queries, strict=True):
            rows, score = segment.scan(query, np.nonzero(segment.ids != anchor)[0], needed)
            best = _best(segment.ids[rows], score, k)
            found.append((np.full(len(best), anchor), segment.ids[rows][best], score[best]))
        release()
        columns = map(np.concatenate, zip(*found, strict=True))
        return pa.table(dict(zip(("anchor_id", "row_id", "score"), map(pa.array, columns), strict=True)))
    return run


def _negatives(k: int, low: int, high: int):
    """The best k rows of a segment in the window of each positive of each anchor of a block."""
    def run(segments: pa.Table, anchors: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in NEGATIVE.split(", ")]
        if not segments.num_rows or not anchors.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        segment, ids, queries, block = _opened(segments, anchors)
        of, positive, reach = (np.array(block[c], np.int64) for c in ("of", "positive_ids", "positive_scores"))
        first, last = -(-low * reach // 100), high * reach // 100
        found = []
        for anchor, query in zip(ids, queries, strict=True):
            mine = np.nonzero((of == anchor) & (first <= last))[0]
            if not len(mine):
                continue
            least, most = first[mine], last[mine]

            def needed(lower, upper):
                some = np.zeros(len(lower), bool)
                for a, b in zip(least, most, strict=True):
                    inside = lower[(lower >= a) & (upper <= b)]
                    if len(inside) >= k:  # so many are sure to be in the window, lower ones don't matter
                        a = np.partition(inside, -k)[-k]
                    some |= (upper >= a) & (lower <= b)
                return some

            rows, score = segment.scan(query, np.arange(len(segment.ids)), needed)
            for w, a, b in zip(mine, least, most, strict=True):
                inside = np.nonzero((score >= a) & (score <= b))[0]
                best = inside[_best(segment.ids[rows[inside]], score[inside], k)]
                n = len(best)
                found.append((np.full(n, anchor), np.full(n, positive[w]), segment.ids[rows[best]], np.full(n, reach[w]), score[best]))
        release()
        columns = map(np.concatenate, zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(names, map(pa.array, columns), strict=True)))
    return run


def _met(segments: DataFrame, blocks: DataFrame, same_label: bool, work, schema: str) -> DataFrame:
    """Every block of anchors with every segment of its length that has the same label, or another one."""
    label = F.col("s.label") == F.col("a.label")
    meet = segments.select("segment", "label", "dims").alias("s").join(
        blocks.select(F.col("segment").alias("block"), "label", "dims").alias("a"),
        (F.col("s.dims") == F.col("a.dims")) & (label if same_label else ~label)).select("segment", "block")
    meet = written(meet, "meetings")
    left = segments.join(meet, "segment")
    right = blocks.withColumnRenamed("segment", "block").join(meet, "block")
    return left.groupBy("segment", "block").cogroup(right.groupBy("segment", "block")).applyInArrow(work, schema)


def _first(rows: DataFrame, group: list[str], score: str, row: str, k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(score), row)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(vec_id, label, dims, vector of whole numbers) of the rows that take part, one per id."""
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * 256))
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) <= LARGEST))
    taken = rows.filter(F.col(id_col).isNotNull() & label.isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(vector_col) > 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("int").alias("label"), scaled.cast("array<int>").alias("vector"))
    n, distinct = taken.agg(F.count("vec_id"), F.count_distinct("vec_id")).first()
    if n != distinct:
        taken = taken.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")
    return taken.select("vec_id", "label", F.size("vector").alias("dims"), "vector")


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(256 * x), scores are whole inner products; higher ones come first, ties by smaller id. An anchor (a row for
    which ``is_anchor``, a condition on ``vec_id``, holds) has as positives its first ``positives`` other rows of its label; for each of them
    the first ``negatives`` rows of other labels follow that score from ``low`` to ``high`` hundredths of the positive's score.

    Rows with a null id, label or vector, an empty vector, a null or non-finite component, or one beyond LARGEST / 256 in size take no part. Of
    rows that share an id one takes part: the one with the smallest label, then the smallest vector. Vectors of different
    lengths never meet. An empty table gives an empty result; other columns are not read.
    """
    label = F.col(label) if isinstance(label, str) else label
    vectors = written(usable_vectors(rows, id_col, vector_col, label), "vectors")
    segments = columnar(vectors, SEGMENT_ROWS, "segments")
    blocks = columnar(vectors.filter(is_anchor), ANCHOR_ROWS, "anchors")
    near = _first(_met(segments, blocks, True, _positives(positives), FOUND), ["anchor_id"], "score", "row_id", positives)
    near = written(near.select("anchor_id", "row_id", "score"), "positives")
    home = F.xxhash64("label", "dims", F.pmod(F.xxhash64("vec_id"), F.col("_k")))
    sizes = vectors.filter(is_anchor).groupBy("label", "dims").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_k", F.ceil(F.col("_n") / ANCHOR_ROWS))
    homes = vectors.filter(is_anchor).select("vec_id", "label", "dims").join(sizes, ["label", "dims"]).select(
        F.col("vec_id").alias("anchor_id"), home.alias("segment"))
    # a block's anchors have a few positives each
    goals = near.join(homes, "anchor_id").groupBy("segment").agg(F.collect_list(F.struct("anchor_id", "row_id", "score")).alias("_g")).select(
        "segment", F.col("_g.anchor_id").alias("of"), F.col("_g.row_id").alias("positive_ids"), F.col("_g.score").alias("positive_scores"))
    found = _met(segments, written(blocks.join(goals, "segment"), "goals"), False, _negatives(negatives, low, high), NEGATIVE)
    best = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
