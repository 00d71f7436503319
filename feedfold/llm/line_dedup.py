"""Line deduplication: documents probe arrays behind a sharded minimal perfect hash instead of joining their lines.

The 128-bit hashes of the lines are counted per shard, a task sending each of its lines once. Over the distinct hashes that occur in
enough documents every shard gets a minimal perfect hash (levels of bit arrays, a key taking the first bit that it has to
itself), whose numbers index compact fingerprints, document counts and the document that keeps the line.
The arrays of the commonest lines, as many as fit into ``BROADCAST_BYTES``, are sent to the tasks, which probe them and cut the texts in one pass.
Only if some lines do not fit are the other lines' hashes routed to the shards; as these lines are rare, no shard is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedfold.llm.common import identified, release, slices, unique_ids
from feedfold.llm.hashing import Hasher, mix
from feedfold.session import written

MIN_CHARS, MIN_DOCS = 40, 5
# Bytes of text hashed at a time and per shard, and lines that a task holds before it sends them.
SLICE_BYTES = 1 << 20
SHARD_BYTES = 8 << 20
HELD_LINES = 1 << 18
# Bytes of arrays that are sent to every task at most.
BROADCAST_BYTES = 32 << 20
# Bits of the arrays per key and level: the more, the fewer levels.
ROOM = 2
# The expected number of lines wrongly taken for a common one stays below 2**-SAFE_BITS.
SAFE_BITS = 8
SEEDS = (31, 32)
COUNTS = "shard int, lines binary, docs binary, keepers binary"
INDEX = "shard int, sizes binary, bits binary, prints binary, docs binary, keepers binary"
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def line_keys(hashers: tuple[Hasher, Hasher], texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line whose key has ``min_chars`` code points: its text's number, its number in the text, and two hashes of the key.

    Also the number of lines of each text, a null text having one.
    """
    texts = texts.cast(pa.string()) if pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    breaks = np.nonzero(data == 10)[0]
    ends = np.searchsorted(breaks, offsets)
    n_lines = np.diff(ends) + 1
    text = np.repeat(np.arange(len(n_lines)), n_lines)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    start, end = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    first = number == 0
    start[first] = offsets[:-1]
    start[~first] = breaks + 1
    last = np.append(first[1:], True)[:len(first)]
    end[last] = offsets[1:]
    end[~last] = breaks
    solid = np.nonzero(~_BLANK[data])[0]  # outer blanks go
    left, right = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = right > left
    text, number, left, right = text[some], number[some], left[some], right[some]
    start, end = solid[left], solid[right - 1] + 1
    chars = np.cumsum(np.append(0, (data & 0xC0) != 0x80))
    long = chars[end] - chars[start] >= min_chars
    start, end = start[long], end[long]
    one, two = (h.spans(data, start, end, fold_case=True) for h in hashers)
    return np.stack([text[long], number[long]]), one, two, n_lines


def _grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash, and where each distinct hash begins in it."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return order, np.nonzero(new)[0]


def _combined(one, two, docs, keepers):
    """Counts of equal hashes added up, the largest keeper standing for them."""
    order, at = _grouped(one, two)
    if not len(at):
        return one, two, docs, keepers
    return one[order][at], two[order][at], np.add.reduceat(docs[order], at), np.maximum.reduceat(keepers[order], at)


def _shard(one: np.ndarray, shards: int) -> np.ndarray:
    return ((one >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _count_lines(min_chars: int, shards: int):
    """Per task and shard the lines with the number of documents and the largest document that hold each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers, held, n = tuple(map(Hasher, SEEDS)), [], 0
        for batch in slices(batches, "text", SLICE_BYTES):
            (text, _), one, two, _ = line_keys(hashers, batch.column(1), min_chars)
            order = np.lexsort((two, one, text))
            text, one, two = text[order], one[order], two[order]
            new = np.ones(len(text), bool)  # a document counts once for all its equal lines
            new[1:] = (text[1:] != text[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            held.append(_combined(one[new], two[new], np.ones(int(new.sum()), np.int64), batch.column(0).to_numpy()[text[new]]))
            n += len(held[-1][0])
            if n > HELD_LINES:
                held = [_combined(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                if n > HELD_LINES // 2:
                    yield send(held[0])
                    held, n = [], 0
            release()
        if n:
            yield send(_combined(*map(np.concatenate, zip(*held, strict=True))))

    def send(lines) -> pa.RecordBatch:
        one, two, docs, keepers = lines  # in the order of their first hashes, hence of shards
        shard = _shard(one, shards)
        at = np.nonzero(np.append(True, shard[1:] != shard[:-1]))[0]
        rows = [(int(shard[i]), np.stack([one[i:j], two[i:j]]).tobytes(), docs[i:j].tobytes(), keepers[i:j].tobytes())
                for i, j in zip(at, np.append(at[1:], len(shard)), strict=True)]
        return _rows(rows, COUNTS)
    return run


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _unpacked(lines: bytes, docs: bytes, keepers: bytes):
    one, two = np.frombuffer(lines, np.uint64).reshape(2, -1)
    return one, two, np.frombuffer(docs, np.int64), np.frombuffer(keepers, np.int64)


def _common_lines(min_docs: int):
    """The lines of a shard that enough documents hold."""
    def run(parts: pa.Table) -> pa.Table:
        found = _combined(*map(np.concatenate, zip(*(_unpacked(*p) for p in zip(
            *(parts.column(c).to_pylist() for c in ("lines", "docs", "keepers")), strict=True)), strict=True)))
        some = found[2] >= min_docs
        one, two, docs, keepers = (x[some] for x in found)
        rows = [(parts.column("shard")[0].as_py(), np.stack([one, two]).tobytes(), docs.tobytes(), keepers.tobytes())] if some.any() else []
        return pa.Table.from_batches([_rows(rows, COUNTS)])
    return run


def _place(one: np.ndarray, two: np.ndarray, level: int, size: np.ndarray) -> np.ndarray:
    """A key's bit in a level of ``size`` bits."""
    return ((mix(mix(one + np.uint64(level)) + two) >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64)


def _perfect_hash(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sizes of the levels, their bits, and the order of the keys by their numbers."""
    rest, sizes, bits, order = np.arange(len(one)), [], [], []
    while len(rest):
        size = -(-max(64, ROOM * len(rest)) // 64) * 64
        place = _place(one[rest], two[rest], len(sizes), np.uint64(size))
        alone = np.bincount(place, minlength=size) == 1
        mine = alone[place]
        order.append(rest[mine][np.argsort(place[mine])])
        rest = rest[~mine]
        sizes.append(size)
        bits.append(alone)
    return np.array(sizes, np.uint64), np.concatenate(bits), np.concatenate(order)


def _indexed(print_bytes: int, chosen):
    """Arrays over the lines of each shard whose document count is chosen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, *packed = (batch.column(c)[row].as_py() for c in range(4))
                found = _unpacked(*packed)
                some = chosen(found[2])
                if some.any():
                    one, two, docs, keepers = (x[some] for x in found)
                    sizes, bits, order = _perfect_hash(one, two)
                    prints = np.ascontiguousarray(two[order]).view(np.uint8).reshape(-1, 8)[:, :print_bytes]
                    yield _rows([(shard, sizes.tobytes(), np.packbits(bits).tobytes(), prints.tobytes(),
                                  docs[order].tobytes(), keepers[order].tobytes())], INDEX)
    return run


@dataclass
class LineIndex:
    """The arrays of some shards behind each other; all shards are probed at once."""

    shards: int
    print_bytes: int
    sizes: np.ndarray  # by shard and level
    first_bit: np.ndarray
    bits: np.ndarray
    rank: np.ndarray  # set bits before each byte
    prints: np.ndarray
    docs: np.ndarray
    keepers: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], shards: int, print_bytes: int) -> LineIndex:
        """From INDEX rows."""
        rows = sorted(rows, key=lambda r: r[0])
        levels = [np.frombuffer(r[1], np.uint64) for r in rows]
        sizes = np.zeros((shards, max(map(len, levels), default=0)), np.uint64)
        for row, level in zip(rows, levels, strict=True):
            sizes[row[0], :len(level)] = level
        before = np.cumsum(sizes.ravel()) - sizes.ravel()
        bits = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        rank = np.cumsum(np.append(0, np.bitwise_count(bits).astype(np.int64)))
        prints, docs, keepers = (np.frombuffer(b"".join(r[i] for r in rows), kind) for i, kind in ((3, np.uint8), (4, np.int64), (5, np.int64)))
        return cls(shards, print_bytes, sizes, before.reshape(sizes.shape).astype(np.int64), bits, rank,
                   prints.reshape(-1, print_bytes), docs, keepers)

    def probe(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each line in the arrays, -1 where it is not in them."""
        out = np.full(len(one), -1)
        rest, shard = np.arange(len(one)), _shard(one, self.shards)
        for level in range(self.sizes.shape[1]):
            rest = rest[self.sizes[shard[rest], level] > 0]
            if not len(rest):
                break
            bit = self.first_bit[shard[rest], level] + _place(one[rest], two[rest], level, self.sizes[shard[rest], level])
            byte, inside = self.bits[bit >> 3], (bit & 7).astype(np.uint8)
            hit = (byte >> (7 - inside)) & 1 > 0
            before = np.bitwise_count(byte[hit] >> (8 - inside[hit]).astype(np.uint8))
            out[rest[hit]] = self.rank[bit[hit] >> 3] + before
            rest = rest[~hit]
        found = np.nonzero(out >= 0)[0]
        mine = np.ascontiguousarray(two[found]).view(np.uint8).reshape(-1, 8)[:, :self.print_bytes]
        out[found[(self.prints[out[found]] != mine).any(axis=1)]] = -1
        return out


def _cut(shared, shards: int, print_bytes: int, min_chars: int, routed: bool):
    """Probe the broadcast arrays and leave lines out; ``routed`` rows bring the numbers of other lines to drop."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers, index = tuple(map(Hasher, SEEDS)), LineIndex.of(shared.value, shards, print_bytes)
        for batch in slices(batches, "text", SLICE_BYTES):
            (text, number), one, two, n_lines = line_keys(hashers, batch.column(2), min_chars)
            slot = index.probe(one, two)
            gone = np.nonzero(slot >= 0)[0]
            gone = gone[index.keepers[slot[gone]] != batch.column(0).to_numpy()[text[gone]]]
            drop: dict[int, list[int]] = {}
            for t, line in zip(text[gone].tolist(), number[gone].tolist(), strict=True):
                drop.setdefault(t, []).append(line)
            if routed:
                for t, parts in enumerate(batch.column(3).to_pylist()):
                    if parts:
                        drop[t] = sorted(drop.get(t, []) + np.frombuffer(b"".join(parts), np.int32).tolist())
            kept = batch.column(2).to_pylist()
            for t, lines in drop.items():
                left, skip = kept[t].split("\n"), set(lines)
                kept[t] = "\n".join(line for i, line in enumerate(left) if i not in skip)
            dropped = [drop.get(t, []) for t in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(n_lines, pa.int64()), pa.array([len(d) for d in dropped], pa.int64()),
                 pa.array(dropped, pa.list_(pa.int32())), pa.array([k or "" for k in kept], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "dropped", "kept_text"])
            release()
    return run


def _routed_probes(shared, shards: int, print_bytes: int, min_chars: int):
    """The lines that the broadcast arrays don't hold, by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers, index = tuple(map(Hasher, SEEDS)), LineIndex.of(shared.value, shards, print_bytes)
        for batch in slices(batches, "text", SLICE_BYTES):
            (text, number), one, two, _ = line_keys(hashers, batch.column(1), min_chars)
            rest = np.nonzero(index.probe(one, two) < 0)[0]
            rest = rest[np.argsort(_shard(one[rest], shards), kind="stable")]
            shard = _shard(one[rest], shards)
            at = np.nonzero(np.append(True, shard[1:] != shard[:-1])[:len(shard)])[0]
            keys = batch.column(0).to_numpy()
            yield _rows([(int(shard[i]), None, np.stack([one[r], two[r]]).tobytes(), None, keys[text[r]].tobytes(),
                          number[r].astype(np.int64).tobytes())
                         for i, r in zip(at, np.split(rest, at[1:])[:len(at)], strict=True)], INDEX)
    return run


def _answered(shards: int, print_bytes: int):
    """Probes of a shard against its arrays: per document the numbers of lines to drop."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        index = LineIndex.of([tuple(r.values()) for r in rows if r["sizes"] is not None], shards, print_bytes)
        found = []
        for row in rows:
            if row["sizes"] is None:
                one, two = np.frombuffer(row["bits"], np.uint64).reshape(2, -1)
                key, number = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["keepers"], np.int64)
                slot = index.probe(one, two)
                gone = np.nonzero(slot >= 0)[0]
                gone = gone[index.keepers[slot[gone]] != key[gone]]
                found.append((key[gone], number[gone].astype(np.int32)))
        key, number = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.lexsort((number, key))
        key, number = key[order], number[order]
        new = np.ones(len(key), bool)  # equal rows send equal probes
        new[1:] = (key[1:] != key[:-1]) | (number[1:] != number[:-1])
        key, number = key[new], number[new]
        at = np.nonzero(np.append(True, key[1:] != key[:-1])[:len(key)])[0]
        parts = [x.tobytes() for x in np.split(number, at[1:])[:len(at)]]
        return pa.table({"row_key": pa.array(key[at], pa.int64()), "lines": pa.array(parts, pa.binary())})
    return run


def _least_count(common: DataFrame, room: int) -> int:
    """The least document count such that the lines with so many are at most ``room``; counts go by eighths of powers of two."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs in batch.column(0).to_pylist():
                step, n = np.unique(np.floor(8 * np.log2(np.frombuffer(docs, np.int64))).astype(np.int64), return_counts=True)
                yield _rows(list(zip(step.tolist(), n.tolist(), strict=True)), "step int, n long")

    steps = common.select("docs").mapInArrow(counted, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    total, least = 0, None
    for row in sorted(steps, key=lambda r: -r.step):
        total += row.n
        if total > room:
            return least if least is not None else 1 << 62
        least = math.ceil(2 ** (row.step / 8))
    return 0


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                        min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, dropped (numbers of the dropped lines from 0) and kept_text.

    Texts are split at \\n. A line's key is the line without outer blanks (space, \\t to \\r), A-Z lower-cased. Keys of at
    least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines but those in the document with the largest id
    (null ids are smallest, ties go by a digest of the text). Rows that agree in id and text are one document: they keep and lose the same lines.
    A null or empty text is one empty line; a text that loses all lines becomes empty. Very long texts and lines are hashed and cut
    whole. An empty table gives an empty result; other columns are not read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = identified(plain).select("row_key", "doc_id", "text")
    once = rows.select("row_key", "text") if unique_ids(plain, "doc_id") else rows.select("row_key", "text").dropDuplicates(["row_key"])
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, -(-size // SHARD_BYTES))
    print_bytes = min(8, math.ceil((max(1, size // min_chars).bit_length() + SAFE_BITS) / 8))
    counts = once.mapInArrow(_count_lines(min_chars, shards), COUNTS).groupBy("shard")
    common = written(counts.applyInArrow(_common_lines(min_docs), COUNTS), "common-lines")
    # some three bits a key tell its number, the counts and keepers take eight bytes each
    least = _least_count(common, broadcast_bytes // (print_bytes + 17))
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in common.mapInArrow(
        _indexed(print_bytes, lambda n: n >= least), INDEX).toLocalIterator()])
    routed = least > min_docs
    rows = rows.withColumn("parts", F.lit(None).cast("array<binary>")) if not routed else _with_answers(
        rows, common.mapInArrow(_indexed(print_bytes, lambda n: n < least), INDEX), sent, shards, print_bytes, min_chars)
    return rows.select("row_key", "doc_id", "text", "parts").mapInArrow(
        _cut(sent, shards, print_bytes, min_chars, routed),
        "doc_id long, n_lines long, n_dropped long, dropped array<int>, kept_text string")


def _with_answers(rows: DataFrame, rare: DataFrame, sent, shards: int, print_bytes: int, min_chars: int) -> DataFrame:
    """Rows with the numbers of the lines to drop that the broadcast arrays don't tell."""
    probes = rows.select("row_key", "text").mapInArrow(_routed_probes(sent, shards, print_bytes, min_chars), INDEX)
    answers = rare.unionByName(probes).groupBy("shard").applyInArrow(_answered(shards, print_bytes), "row_key long, lines binary")
    parts = answers.groupBy("row_key").agg(F.collect_list("lines").alias("parts"))
    return rows.join(parts, "row_key", "left")
