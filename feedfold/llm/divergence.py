"""Source divergence audit: hash-consed segment trees over term ids, traversed two at a time.

Terms of a language are dealt to blocks; a term's id is its place in its block. In every block each source has a segment tree over the
counts of the ids, and so has the language. Equal subtrees are one node, whichever trees they are in. Two trees are
traversed from their roots: a pair of nodes that comes up several times is carried on once with its multiplicity, down to pairs of
counts, each priced once. Spark counts the terms, adds the blocks' prices up and ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedfold.llm.common import release, slices
from feedfold.session import written

MIN_DOCS, TOP_TERMS = 3, 200
SCALE = 1_000_000_000
SLICE_BYTES = 1 << 20
# Counted (group, term) entries that a task holds before it sends them.
HELD_ENTRIES = 1 << 18
# Leaves of all trees of a block, and pairs of trees traversed at once.
BLOCK_LEAVES = 1 << 19
PAIRS_AT_ONCE = 128
COUNTED = "lang string, source string, term string, n long, docs long"
PRICED = "lang string, source string, part string, item string, value decimal(38,0)"
# Letters A-Z, a-z and bytes of other scripts make terms.
_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in a row, and the text that each is in; a null text has none."""
    texts = texts.cast(pa.string()) if pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _TERM[data]
    turn = np.ones(len(data) + 1, bool)
    turn[1:-1] = inside[1:] != inside[:-1]
    turn[offsets] = True
    start, end = np.nonzero(turn[:-1] & inside)[0], np.nonzero(turn[1:] & inside)[0] + 1
    bounds = np.append(0, np.cumsum(end - start)).astype(np.int32)
    packed = pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[inside]]))
    return packed, np.searchsorted(offsets, start, side="right") - 1


def _merged(parts: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return whole.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term per group, and the documents of the group that hold it, added up within the task."""
    held, n = [], 0
    for batch in slices(batches, "text", SLICE_BYTES):
        terms, text = terms_of(batch.column(2))
        codes = terms.dictionary_encode()
        code, size = codes.indices.to_numpy(), max(1, len(codes.dictionary))
        group, first = np.unique(_pair_codes(batch.column(0), batch.column(1)), return_inverse=True)[1], None
        _, first = np.unique(group, return_index=True)
        in_text, times = np.unique(text * size + code, return_counts=True)  # one entry per text and term
        key = group[in_text // size] * size + in_text % size
        entry, at = np.unique(key, return_inverse=True)
        rows = pa.array(first[entry // size])
        held.append(pa.table({
            "lang": batch.column(0).take(rows), "source": batch.column(1).take(rows),
            "term": codes.dictionary.take(pa.array(entry % size)),
            "n": pa.array(np.bincount(at, times, len(entry)).astype(np.int64)),
            "docs": pa.array(np.bincount(at, minlength=len(entry)).astype(np.int64))}))
        n += len(entry)
        if n > HELD_ENTRIES:
            held = [_merged(held)]
            n = held[0].num_rows
            if n > HELD_ENTRIES // 2:
                yield from held[0].to_batches(1 << 16)
                held, n = [], 0
        release()
    if n:
        yield from _merged(held).to_batches(1 << 16)


def _pair_codes(a: pa.Array, b: pa.Array) -> np.ndarray:
    one, two = a.dictionary_encode(), b.dictionary_encode()
    return one.indices.to_numpy().astype(np.int64) * max(1, len(two.dictionary)) + two.indices.to_numpy()


class Forest:
    """Segment trees of equal width over rows of leaves; equal subtrees of all rows are one node."""

    def __init__(self, leaves: np.ndarray) -> None:
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        nodes = leaves
        while nodes.shape[1] > 1:
            left, right = nodes[:, ::2].astype(np.int64), nodes[:, 1::2].astype(np.int64)
            width = int(nodes.max()) + 1
            known, nodes = np.unique(left * width + right, return_inverse=True)
            nodes = nodes.reshape(left.shape)
            self.children.append((known // width, known % width))
        self.roots = nodes[:, 0]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each two trees (rows a[i] and b[i]): i, the pairs of leaves that share a place, and how many places have them."""
        which, one, two = np.arange(len(a)), self.roots[a], self.roots[b]
        times = np.ones(len(a), np.int64)
        for left, right in reversed(self.children):
            which = np.concatenate([which, which])
            one, two = np.concatenate([left[one], right[one]]), np.concatenate([left[two], right[two]])
            width = int(max(one.max(), two.max())) + 1
            seen, at = np.unique((which * width + one) * width + two, return_inverse=True)
            times = np.bincount(at, np.concatenate([times, times]), len(seen)).astype(np.int64)
            which, one, two = seen // width // width, seen // width % width, seen % width
        return which, one, two, times

    def places(self, row: int, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and leaves of a tree below which any of the flagged leaves is; other subtrees are not entered."""
        wanted = [leaf]
        for left, right in self.children:
            wanted.append(wanted[-1][left] | wanted[-1][right])
        place, node = np.zeros(1, np.int64), self.roots[row:row + 1]
        for depth in range(len(self.children), 0, -1):
            some = wanted[depth][node]
            place, node = place[some], node[some]
            left, right = self.children[depth - 1]
            place, node = np.concatenate([2 * place, 2 * place + 1]), np.concatenate([left[node], right[node]])
        some = leaf[node]
        return place[some], node[some]


def _probabilities(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for counts of any size."""
    whole = total + terms
    return np.array([1 + SCALE * (int(c) + 1) // whole for c in counts], np.int64)


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q  # probabilities are at most 1 + SCALE, their squares fit


def _summed(groups: np.ndarray, values: np.ndarray, times: np.ndarray, n: int) -> list[int]:
    """Exact sums of values * times per group, by halves."""
    high, low = values >> 30, values & ((1 << 30) - 1)
    parts = []
    for half in (high, low):
        sums = np.zeros(n, np.int64)
        np.add.at(sums, groups, half * times)
        parts.append(sums.tolist())
    return [(h << 30) + x for h, x in zip(*parts, strict=True)]


def _audited(top: int):
    """Prices of a block: of every ordered pair of sources, and each source's best terms against the language."""
    def run(rows: pa.Table) -> pa.Table:
        lang = rows.column("lang")[0].as_py()
        is_group = rows.column("term").is_null()
        groups = rows.filter(is_group).sort_by("source")
        entries = rows.filter(pc.invert(is_group))
        sources, totals = groups.column("source").to_pylist(), groups.column("total").to_pylist()
        n_terms = groups.column("terms")[0].as_py()
        totals.append(sum(totals))
        terms = pc.unique(entries.column("term"))
        column = pc.index_in(entries.column("term"), terms).to_numpy()
        row = pc.index_in(entries.column("source"), pa.array(sources, pa.string())).to_numpy()
        n = entries.column("n").to_numpy()
        whole = np.zeros(len(terms), np.int64)
        np.add.at(whole, column, n)
        by_count = np.argsort(-whole, kind="stable")  # similar counts lie side by side and share more
        ids = np.empty(len(terms), np.int64)
        ids[by_count] = np.arange(len(terms))
        counts = np.zeros((len(totals), len(terms)), np.int64)
        counts[row, ids[column]] = n
        counts[-1] = whole[by_count]
        known, leaves = np.unique(counts, return_inverse=True)
        width = 1 << max(0, (len(terms) - 1).bit_length())
        padded = np.full((len(totals), width), len(known))  # a leaf of its own beyond the last id, priced 0
        padded[:, :len(terms)] = leaves.reshape(counts.shape)
        forest = Forest(padded)
        p = np.stack([np.append(_probabilities(known, t, n_terms), 1) for t in totals]) if n_terms else np.ones((len(totals), 1), np.int64)
        out: list[tuple] = []
        left, right = np.triu_indices(len(sources), 1)
        for start in range(0, len(left), PAIRS_AT_ONCE):
            a, b = left[start:start + PAIRS_AT_ONCE], right[start:start + PAIRS_AT_ONCE]
            which, one, two, times = forest.pairs(a, b)
            pa_, pb = p[a[which], one], p[b[which], two]
            for x, y, values in ((a, b, _price(pa_, pb)), (b, a, _price(pb, pa_))):
                sums = _summed(which, values, times, len(a))
                out += [(sources[i], "pair", sources[j], v) for i, j, v in zip(x.tolist(), y.tolist(), sums, strict=True)]
        names = terms.take(pa.array(by_count)).to_pylist()
        occurs = np.append(known > 0, False)
        for i, source in enumerate(sources):
            place, leaf = forest.places(i, occurs)
            if not len(place):
                continue
            mine, base = p[i, leaf], p[-1, padded[-1, place]]
            above = np.nonzero(mine > base)[0]
            value = _price(mine[above], base[above])
            if len(value) > top:  # ties at the end stay, the ranks decide
                least = np.partition(value, -top)[-top]
                above, value = above[value >= least], value[value >= least]
            out += [(source, "term", names[j], v) for j, v in zip(place[above].tolist(), value.tolist(), strict=True)]
        release()
        source, part, item, value = zip(*out, strict=True) if out else ([],) * 4
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(source, pa.string()),
                         "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()),
                         "value": pa.array([Decimal(v) for v in value], pa.decimal128(38, 0))})
    return run


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """A stored table (lang, source, term, n) of the terms that ``min_docs`` documents of the language hold.

    Counts are added up within tasks first; the shuffle by language and term serves the sums and the test of documents.
    """
    counted = docs.select("lang", "source", "text").mapInArrow(_count_terms, COUNTED)
    summed = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    in_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return written(summed.withColumn("in_lang", in_lang).filter(F.col("in_lang") >= min_docs).select("lang", "source", "term", "n"),
                   "term-counts")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how each group (lang, source) departs from others.

    Null text, lang and source count as ''. Terms are runs of letters A-Z, a-z and characters beyond ASCII, only A-Z lower-cased; a
    language keeps the terms in at least ``min_docs`` of its documents (rows). Part ``pair`` prices every other source of the
    language over all kept terms, part ``term`` the ``top`` kept terms that the group uses more than its language. Ranks go by value
    descending, then by item in UTF-8 order. Repeated rows count as often as they occur. Very long texts are read whole. A language without
    kept terms prices its pairs at 0; an empty table gives an empty result; other columns are not read. Values beyond 64 bits are null.

    A block has at most about BLOCK_LEAVES counts of all its sources' trees. The result has a row per two sources of a language, so these are few.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = term_counts(rows, min_docs)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = counts.groupBy("lang").agg(F.count_distinct("term").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")),
                     "groups")
    leaves = F.first("terms") * (F.count(F.lit(1)) + 1)
    langs = written(groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(leaves / BLOCK_LEAVES)).cast("int").alias("blocks")), "languages")
    heads = groups.join(langs, "lang").select("lang", "source", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                                              F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", "terms")
    entries = counts.join(langs, "lang").select(
        "lang", "source", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "term", "n",
        F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("terms"))
    priced = heads.unionByName(entries).groupBy("lang", "block").applyInArrow(_audited(top), PRICED)
    whole = written(priced.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "prices")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs, terms = (whole.filter(F.col("part") == part).withColumn("rank", F.row_number().over(order)) for part in ("pair", "term"))
    # a limit on ranks alone is pushed below the shuffle
    return pairs.unionByName(terms.filter(F.col("rank") <= top)).select(
        "lang", "source", "part", "item", F.expr("try_cast(value AS BIGINT)").alias("value"), "rank")
