"""Importance resampling: documents are sampled by how much more likely target text makes them than raw text.

Both texts have a generative model over n-grams (does a document contain an n-gram). A document's log weight
is the sum of the log ratios of its n-grams; Gumbel noise on the log weights and a global top-k make a weighted
sample without replacement. The raw model counts every document, the target model a bounded sample of labelled ones.

Every distinct n-gram has a count of its own, by a hash that gets wider with the input. Tasks send partial sums to ranges of hashes, where they are
added and stay; the n-grams of the documents go to the same ranges to be weighed. ``fit_counts`` and ``log_weights`` are the
same model over a fixed number of slots, for corpora of known size; ``importance_sample`` does not use them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedfold.llm.common import carried, identified, release, slices
from feedfold.llm.hashing import BY_KIND, Hasher, mix
from feedfold.session import written

SLOTS = 1 << 20
# Single words and pairs have tables of their own, each of them two, as an n-gram counts by the weaker of its two slots.
ORDERS, COPIES = 2, 2
BLOCK = 1 << 16
# At most so many labelled documents (those with the smallest hashes of their ids) are used.
LABELLED = 200_000
# Settings to choose from on held-out labels: counts added to both models, and the log ratio below which an n-gram is
# taken for sampling noise. The first suits large corpora, the others find rarer words in small ones.
SETTINGS = ((3.0, 1.3), (1.0, 1.3), (0.5, 1.0), (0.3, 0.7))
# Gumbel noise is scaled by this: the smaller, the closer the sample comes to the k heaviest documents.
TEMPERATURE = 0.05
SEED = 17
# Bytes of text hashed at a time.
SLICE_BYTES = 1 << 19
# Documents that an n-gram is in, at least, to count as common.
COMMON = 5
LONGEST_RUN = 4
# Bytes of text per range of hashes, n-grams that a task holds before it sends them, and commonest n-grams by order that set
# the scale of the target model.
RANGE_BYTES = 4 << 20
HELD_GRAMS = 1 << 19
COMMONEST = 2000
# Less than one n-gram in 2**SAFE_BITS shares its hash with another, at any size of the input.
SAFE_BITS = 20
# Bits of a hash that name its place in the filter of n-grams with a weight; log ratios are added up in units of 1/UNIT.
FILTER_BITS = 27
UNIT = 1 << 32
GRAMS = "part int, keys binary, targets binary, raws binary, docs binary"


def ngrams(hasher: Hasher, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order the (document, hash) of its distinct n-grams; runs of one word count as n-grams of their length."""
    words = hasher.words(texts, BY_KIND, fold_case=True)
    doc, h = np.repeat(np.arange(len(words.counts)), words.counts), words.hashes
    inside = doc[1:] == doc[:-1]
    same = np.zeros(len(h), bool)
    same[1:] = inside & (h[1:] == h[:-1])
    count = np.cumsum(same)
    run = count - np.maximum.accumulate(np.where(same, 0, count))
    long = run >= 2
    singles = np.concatenate([doc, doc[long]]), np.concatenate([h, mix(np.minimum(run[long], LONGEST_RUN).astype(np.uint64))])
    pairs = doc[1:][inside], mix(h[:-1] * np.uint64(3) + h[1:])[inside]
    out = []
    for d, g in (singles, pairs):
        order = np.lexsort((g, d))
        d, g = d[order], g[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
        out.append((d[new], g[new]))
    return out


def _slots(grams: np.ndarray, copy: int) -> np.ndarray:
    return ((grams >> np.uint64(24 * copy)) % np.uint64(SLOTS)).astype(np.int64)


def _count(shared):
    """Documents per slot of a partition, in target text and in all text, as blocks of byte planes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, targets = Hasher(SEED), shared.value
        counts = np.zeros((2, ORDERS, COPIES, SLOTS), np.int32)
        seen = False
        for batch in slices(batches, "text", SLICE_BYTES):
            seen = True
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = np.isin(ids, targets)
            for order, (doc, grams) in enumerate(ngrams(hasher, batch.column(1))):
                for copy in range(COPIES):
                    slot = _slots(grams, copy)
                    counts[0, order, copy] += np.bincount(slot[found[doc]], minlength=SLOTS).astype(np.int32)
                    counts[1, order, copy] += np.bincount(slot, minlength=SLOTS).astype(np.int32)
        for block, part in enumerate(counts.reshape(-1, BLOCK) if seen else []):  # a block at a time, to hold no copies
            planes = np.ascontiguousarray(part.view(np.uint8).reshape(BLOCK, 4).T).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([planes])], ["block", "counts"])
    return run


def _add(tables: pa.Table) -> pa.Table:
    """One row per block, 64-bit sums in byte planes."""
    total = np.zeros(BLOCK, np.int64)
    for data in tables.column("counts"):
        planes = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, BLOCK)
        total += sum(plane.astype(np.int64) << (8 * i) for i, plane in enumerate(planes))
    planes = np.ascontiguousarray(total.view(np.uint8).reshape(BLOCK, 8).T)
    return pa.table({"block": tables.column("block").slice(0, 1), "counts": pa.array([planes.tobytes()])})


def _total(tables: pa.Table) -> pa.Table:
    """One row per block, its sums as 32-bit floats."""
    planes = np.frombuffer(_add(tables).column("counts")[0].as_buffer(), np.uint8).reshape(8, BLOCK)
    sums = np.ascontiguousarray(planes.T).view(np.int64).ravel().astype("<f4")
    return pa.table({"block": tables.column("block").slice(0, 1), "counts": pa.array([sums.tobytes()])})


def fit_counts(docs: DataFrame, targets: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Documents by model (target, raw), order, copy and slot. Only these tables, whose size is fixed, come to the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(targets))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 63)).alias("id"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count(sent), "block int, counts binary").withColumn("part", F.floor(F.spark_partition_id() / 64))
    schema = "block int, counts binary"
    few = counts.groupBy("block", "part").applyInArrow(_add, schema)
    whole = np.zeros((2 * ORDERS * COPIES * SLOTS // BLOCK, BLOCK), np.float32)
    for row in few.groupBy("block").applyInArrow(_total, schema).coalesce(8).toLocalIterator():
        whole[row.block] = np.frombuffer(row.counts, "<f4")
    sent.destroy()
    return whole.reshape(2, ORDERS, COPIES, SLOTS)


def model_scales(counts: np.ndarray) -> np.ndarray:
    """By order and copy, the share of raw documents that makes both models agree on the commonest n-grams."""
    scales = np.zeros((ORDERS, COPIES))
    for order in range(ORDERS):
        for copy in range(COPIES):
            target, raw = counts[:, order, copy]
            common = np.argpartition(-raw, 2000)[:2000]
            common = common[raw[common] >= COMMON]
            middle = float(np.median(target[common] / raw[common])) if len(common) else 0.0
            scales[order, copy] = middle or target.sum() / max(1, raw.sum())
    return scales


def log_ratio(target: np.ndarray, raw: np.ndarray, scale: float | np.ndarray, pseudo_count: float, least_ratio: float) -> np.ndarray:
    if np.all(scale <= 0):
        return np.zeros(len(raw))
    found = np.log((target + pseudo_count) / (raw * scale + pseudo_count))
    return np.where(np.abs(found) >= least_ratio, found, 0)


def log_weights(docs: DataFrame, model, settings: list[tuple[float, float]]) -> DataFrame:
    """(row_key, doc_id, weights) of every whole text, a log weight per setting; null and empty texts weigh 0.

    ``model`` is a broadcast of (counts, scales), 32 MB whatever the input.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (counts, scales) = Hasher(SEED), model.value
        for batch in slices(batches, "text", SLICE_BYTES):
            weights = np.zeros((batch.num_rows, len(settings)))
            for order, (doc, grams) in enumerate(ngrams(hasher, batch.column(2))):
                found = [counts[:, order, copy, _slots(grams, copy)] for copy in range(COPIES)]
                for i, setting in enumerate(settings):
                    a, b = (log_ratio(*found[copy], scales[order, copy], *setting) for copy in range(COPIES))
                    weaker = np.where(a * b > 0, np.where(np.abs(a) < np.abs(b), a, b), 0)
                    weights[:, i] += np.bincount(doc, weaker, minlength=batch.num_rows)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(settings)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(weights.ravel()))],
                ["row_key", "doc_id", "weights"])

    return docs.select("row_key", "doc_id", "text").mapInArrow(run, "row_key long, doc_id long, weights array<double>")


@dataclass(frozen=True)
class Ranges:
    """Keys of ``width`` bits, of which the first ``bits`` name the range."""

    bits: int
    width: int

    @classmethod
    def of(cls, size: int) -> Ranges:
        """For texts of so many bytes, which have no more distinct n-grams than that."""
        bits = min(FILTER_BITS - 3, (max(64, -(-size // RANGE_BYTES)) - 1).bit_length())
        return cls(bits, min(63, max(48, size.bit_length() + SAFE_BITS)))

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(self.width - self.bits)).astype(np.int64)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Places in the filter."""
        return (keys >> np.uint64(self.width - FILTER_BITS)).astype(np.int64)

    def keys(self, hasher: Hasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(document, key) of the distinct n-grams; the last bit of a key is the order."""
        found, cut = ngrams(hasher, texts), np.uint64(65 - self.width)
        return (np.concatenate([d for d, _ in found]),
                np.concatenate([(g >> cut << np.uint64(1)) | np.uint64(order) for order, (_, g) in enumerate(found)]))


def _narrow(values: np.ndarray) -> bytes:
    """Integers from 0 on as byte planes, as many as the largest one needs."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, :width].T.tobytes()


def _widen(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _key_planes(keys: np.ndarray) -> bytes:
    """Rising keys as the first one and planes of the steps."""
    return keys[:1].tobytes() + _narrow(np.diff(keys)) if len(keys) else b""


def _unkey_planes(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1), _widen(data[8:]).view(np.uint64)]), dtype=np.uint64)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _parts(keys: np.ndarray, ranges: Ranges) -> Iterator[tuple[int, slice]]:
    """The ranges of rising keys: the number and place of each that has some."""
    part = ranges.part(keys)
    first = np.nonzero(np.append(True, part[1:] != part[:-1])[:len(part)])[0]
    for i, j in zip(first, np.append(first[1:], len(part)), strict=True):
        yield int(part[i]), slice(i, j)


def _summed(keys: np.ndarray, targets: np.ndarray, raws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.nonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])[0]
    if not len(first):
        return keys, targets, raws
    return keys[first], np.add.reduceat(targets[order], first, dtype=targets.dtype), np.add.reduceat(raws[order], first, dtype=raws.dtype)


def _partial_sums(shared, ranges: Ranges):
    """Per task and range the documents with each n-gram, in target text and in all text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, chosen, held, n = Hasher(SEED), shared.value, [], 0
        for batch in slices(batches, "text", SLICE_BYTES):
            target = np.isin(batch.column(0).to_numpy(zero_copy_only=False), chosen)
            doc, keys = ranges.keys(hasher, batch.column(1))
            held.append(_summed(keys, target[doc].astype(np.int32), np.ones(len(keys), np.int32)))
            n += len(held[-1][0])
            if n > HELD_GRAMS:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                n = len(held[0][0])
                if n > HELD_GRAMS // 2:
                    yield send(held)
                    held, n = [], 0
            release()
        if n:
            yield send([_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))])
            release()

    def send(held) -> pa.RecordBatch:
        keys, targets, raws = held[0]
        return _batch([(part, _key_planes(keys[at]), _narrow(targets[at]), _narrow(raws[at]), None)
                       for part, at in _parts(keys, ranges)], GRAMS)
    return run


def _whole_sums(least: int):
    """The counts of a range, of n-grams in target text or in ``least`` documents; and by order the sums of all of them."""
    def run(tables: pa.Table) -> pa.Table:
        keys, targets, raws = _summed(np.concatenate([_unkey_planes(b) for b in tables.column("keys").to_pylist()]), *(
            np.concatenate([_widen(b).astype(np.int32) for b in tables.column(c).to_pylist()]).astype(np.int64) for c in ("targets", "raws")))
        order = (keys & np.uint64(1)).astype(np.int64)
        sums = np.array([[x[order == o].sum() for x in (targets, raws)] for o in range(ORDERS)], "<i8")
        some = (targets > 0) | (raws >= least)
        out = _batch([(tables.column("part")[0].as_py(), _key_planes(keys[some]), _narrow(targets[some]),
                       _narrow(raws[some]), sums.tobytes())], GRAMS)
        return pa.Table.from_batches([out])
    return run


def count_ngrams(docs: DataFrame, targets: np.ndarray, ranges: Ranges, least: int) -> DataFrame:
    """A stored table of the counts, a row per range of hashes; no range and no count comes to the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(targets))
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-1 << 63)).alias("id"), "text")
    out = written(rows.mapInArrow(_partial_sums(sent, ranges), GRAMS).groupBy("part").applyInArrow(_whole_sums(least), GRAMS), "ngrams")
    sent.destroy()
    return out


def target_scales(counts: DataFrame) -> list[float]:
    """By order, the share of raw documents that makes both models agree on the commonest n-grams."""
    def commonest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a range at a time, to hold no more
                row = batch.slice(i, 1).to_pylist()[0]
                keys, (targets, raws) = _unkey_planes(row["keys"]), (_widen(row[c]) for c in ("targets", "raws"))
                for order in range(ORDERS):
                    mine = np.nonzero((keys & np.uint64(1) == order) & (raws >= COMMON))[0]
                    mine = mine[np.lexsort((keys[mine], -raws[mine]))[:COMMONEST]]
                    yield _batch([(order, int(k), int(t), int(r)) for k, t, r in zip(
                        keys[mine].view(np.int64), targets[mine], raws[mine], strict=True)], top)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(o, int(t), int(r)) for b in batch.column(0).to_pylist()
                          for o, (t, r) in enumerate(np.frombuffer(b, "<i8").reshape(ORDERS, 2))], "ord int, target long, raw long")

    top = "ord int, key long, target long, raw long"
    rows = counts.mapInArrow(commonest, top)
    sums = {r.ord: (r.t, r.r) for r in counts.select("docs").mapInArrow(total, "ord int, target long, raw long")
            .groupBy("ord").agg(F.sum("target").alias("t"), F.sum("raw").alias("r")).collect()}
    scales = []
    for order in range(ORDERS):
        found = rows.filter(F.col("ord") == order).orderBy(F.desc("raw"), "key").limit(COMMONEST).collect()
        middle = float(np.median([r.target / r.raw for r in found])) if found else 0.0
        whole = sums.get(order, (0, 0))
        scales.append(middle or whole[0] / max(1, whole[1]))
    return scales


def least_weighed(scale: float) -> int:
    """Documents, at least, that an n-gram outside of target text is in, if any setting gives it a log ratio."""
    return max(1, math.ceil(min(pseudo * (math.exp(ratio) - 1) for pseudo, ratio in SETTINGS) / max(scale, 1e-9)))


def ngram_weights(counts: DataFrame, scales: list[float], settings: list[tuple[float, float]], ranges: Ranges) -> DataFrame:
    """A stored table of the n-grams that any setting gives a log ratio: per range their keys, the log ratios (in ``targets``) and
    the range's part of a filter (in ``raws``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a range at a time, to hold no more
                row = batch.slice(i, 1).to_pylist()[0]
                keys, (targets, raws) = _unkey_planes(row["keys"]), (_widen(row[c]) for c in ("targets", "raws"))
                scale = np.array(scales)[(keys & np.uint64(1)).astype(np.int8)]
                units = np.stack([np.rint(np.where(scale > 0, log_ratio(targets, raws, scale, *setting), 0) * UNIT).astype("<i8")
                                  for setting in settings], axis=1)
                some = units.any(axis=1)
                keys, units = keys[some], units[some]
                known = np.zeros(1 << (FILTER_BITS - ranges.bits), np.uint8)
                inside = ranges.place(keys) - row["part"] * len(known)
                known[inside] = 1
                yield _batch([(row["part"], _key_planes(keys), units.tobytes(), np.packbits(known).tobytes(), None)], GRAMS)
    return written(counts.mapInArrow(run, GRAMS), "ngram-weights")


def _candidates(shared, ranges: Ranges):
    """Per task and range the (key, row) pairs whose n-gram may have a log ratio."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known, held, n = Hasher(SEED), np.frombuffer(shared.value, np.uint8), [], 0
        for batch in slices(batches, "text", SLICE_BYTES):
            doc, keys = ranges.keys(hasher, batch.column(1))
            place = ranges.place(keys)
            some = (known[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0
            held.append((keys[some], batch.column(0).to_numpy()[doc[some]]))
            n += int(some.sum())
            if n > HELD_GRAMS:
                yield send(held)
                held, n = [], 0
                release()
        if n:
            yield send(held)
            release()

    def send(held) -> pa.RecordBatch:
        keys, docs = (np.concatenate(x) for x in zip(*held, strict=True))
        part = ranges.part(keys)
        order = np.lexsort((keys, docs, part))
        keys, docs, part = keys[order], docs[order], part[order]
        first = np.nonzero(np.append(True, part[1:] != part[:-1]))[0]
        return _batch([(int(part[i]), _narrow(keys[i:j]), None, None,
                        docs[i:i + 1].tobytes() + _narrow(np.diff(docs[i:j])))
                       for i, j in zip(first, np.append(first[1:], len(part)), strict=True)], GRAMS)
    return run


def _weighed(n_settings: int):
    """The log ratios of a range added up by row."""
    def run(tables: pa.Table) -> pa.Table:
        keys, docs, units, known = [], [], np.zeros((0, n_settings), np.int64), np.zeros(0, np.uint64)
        for row in tables.to_pylist():
            if row["docs"] is None:
                known, units = _unkey_planes(row["keys"]), np.frombuffer(row["targets"], "<i8").reshape(-1, n_settings)
            else:
                keys.append(_widen(row["keys"]).view(np.uint64))
                docs.append(np.cumsum(np.append(np.frombuffer(row["docs"], np.int64, 1), _widen(row["docs"][8:]))))
        if not keys or not len(known):
            return pa.table({"row_key": pa.array([], pa.int64()), "units": pa.array([], pa.list_(pa.int64()))})
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        docs, at = docs[hit], at[hit]
        order = np.argsort(docs, kind="stable")
        docs, at = docs[order], at[order]
        first = np.nonzero(np.append(True, docs[1:] != docs[:-1])[:len(docs)])[0]
        sums = np.add.reduceat(units[at], first, axis=0) if len(first) else np.zeros((0, n_settings), np.int64)
        offsets = np.arange(len(first) + 1, dtype=np.int32) * n_settings
        return pa.table({"row_key": pa.array(docs[first]), "units": pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))})
    return run


def weigh(docs: DataFrame, weights: DataFrame, n_settings: int, ranges: Ranges) -> DataFrame:
    """(row_key, doc_id, weights, copies) of every whole text, a log weight per setting; null and empty texts weigh 0.

    The n-grams come from the stored table of ``ngram_weights`` by a shuffle; only a filter of 2**FILTER_BITS bits is sent to the tasks,
    which spares the shuffle those without a log ratio. Sums are of integers, so no order of rows changes a weight.
    """
    known = bytearray(1 << (FILTER_BITS - 3))
    for row in weights.select("part", "raws").toLocalIterator():
        known[row.part * len(row.raws):(row.part + 1) * len(row.raws)] = row.raws
    sent = docs.sparkSession.sparkContext.broadcast(bytes(known))
    rows = docs.select("row_key", "text").mapInArrow(_candidates(sent, ranges), GRAMS).unionByName(weights.withColumn("raws", F.lit(None).cast("binary")))
    found = rows.groupBy("part").applyInArrow(_weighed(n_settings), "row_key long, units array<long>")
    found = found.groupBy("row_key").agg(*[F.sum(F.col("units")[i]).alias(f"w{i}") for i in range(n_settings)])
    copies = docs.groupBy("row_key", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    # equal rows have their n-grams added up once each
    each = [F.coalesce(F.col(f"w{i}") / F.col("copies") / float(UNIT), F.lit(0.0)) for i in range(n_settings)]
    return written(copies.join(found, "row_key", "left").select("row_key", "doc_id", F.array(*each).alias("weights"), "copies"), "weighed")


def gumbel_top_k(weighted: DataFrame, k: int, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The k rows with the largest log_weight + temperature * Gumbel noise; noise and ties follow from row_key and seed.

    The k-th key is found exactly by radix selection (at most 65,536 counts a step reach the driver); there is no global sort.
    """
    noise = F.xxhash64(F.lit(seed), "row_key", "occurrence")
    uniform = (F.shiftrightunsigned(noise, 12) + 0.5) / float(1 << 52)
    value = F.col("log_weight") - temperature * F.log(-F.log(uniform))
    whole = F.least(F.greatest(F.floor((value + 4.0e6) * 65536), F.lit(0)), F.lit((1 << 40) - 1))
    rank = F.shiftleft(whole, 23) + F.shiftrightunsigned(F.xxhash64(noise), 41)
    rows = written(weighted.withColumn("sampling_key", value).withColumn("rank", rank), "sampling-keys")
    if k <= 0:
        return rows.limit(0).drop("rank")
    prefix, need = 0, k
    for shift in (48, 32, 16, 0):
        inside = rows.filter(F.shiftright("rank", shift + 16) == F.lit(prefix)) if shift < 48 else rows
        counts = sorted(inside.groupBy(F.shiftright("rank", shift).alias("p")).count().collect(), reverse=True)
        for p, n in counts:
            if n >= need:
                prefix = p
                break
            need -= n
        else:
            return rows.drop("rank")
    ties = rows.filter(F.col("rank") == F.lit(prefix)).orderBy("row_key", "occurrence").limit(need)
    return rows.filter(F.col("rank") > F.lit(prefix)).unionByName(ties).drop("rank")


@dataclass
class Labelled:
    """A bounded sample of labelled ids; a fifth is held out."""

    good: np.ndarray
    held_good: np.ndarray
    held_bad: np.ndarray


def labelled_sample(labels: DataFrame, bound: int = LABELLED) -> Labelled:
    """Ids of labelled documents; good ones have quality 1 and are not toxic. Ids with contradicting labels are bad, nulls are void."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").dropna()
    rows = rows.groupBy("id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    rows = rows.withColumn("h", F.xxhash64("id")).orderBy("h").limit(bound).toPandas()
    held = (rows.h % 5 == 0).to_numpy()
    ids, good = rows.id.to_numpy(np.int64), rows.good.to_numpy(bool)
    return Labelled(ids[good & ~held], ids[good & held], ids[~good & held])


def choose_setting(docs: DataFrame, counts: DataFrame, scales: list[float], ranges: Ranges, labelled: Labelled,
                   cost: float = 5.0) -> tuple[tuple[float, float], float]:
    """The setting and the least log weight that part the held-out documents best.

    A good document lost costs ``cost`` bad ones kept; without held-out documents of both kinds nothing is parted.
    """
    held = np.concatenate([labelled.held_good, labelled.held_bad])
    if not len(labelled.held_good) or not len(labelled.held_bad):
        return SETTINGS[0], -math.inf
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in held], "doc_id long")
    weights = ngram_weights(counts, scales, list(SETTINGS), ranges)
    rows = weigh(docs.join(F.broadcast(ids), "doc_id", "left_semi"), weights, len(SETTINGS), ranges)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "weights").toPandas()
    if not len(rows):
        return SETTINGS[0], -math.inf
    good = np.isin(rows.doc_id.to_numpy(np.int64), labelled.held_good)
    best = (math.inf, SETTINGS[0], -math.inf)
    for i, setting in enumerate(SETTINGS):
        weight = np.array([w[i] for w in rows.weights], float)
        levels = np.unique(weight)
        between = (levels[1:] + levels[:-1]) / 2
        marks = np.concatenate([[-math.inf], between[between <= 0]])
        lost = [cost * (weight[good] < m).sum() + (weight[~good] >= m).sum() for m in marks]
        least = int(np.argmin(lost))
        if lost[least] < best[0]:
            best = (lost[least], setting, float(marks[least]))
    return best[1], best[2]


def importance_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      temperature: float = TEMPERATURE, bound: int = LABELLED) -> DataFrame:
    """The sampled rows: row_key, doc_id, log_weight, sampling_key, occurrence.

    ``labels`` has doc_id, quality and toxic. k is the number of documents whose log weight reaches the least one of the model chosen
    on held-out labels, so documents unlike the target go and the others stay. Null and empty texts weigh 0; rows that
    agree in id and text are sampled one by one; ids may be null; without usable labels all rows stay; an empty table gives an
    empty result; other columns are not read.
    """
    rows = identified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    labelled = labelled_sample(labels, bound)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = Ranges.of(size)
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in labelled.good], "doc_id long")
    share = rows.join(F.broadcast(ids), "doc_id", "left_semi").count() / max(1, rows.count())
    least = min(COMMON, least_weighed(1.25 * share))
    counts = count_ngrams(rows, labelled.good, ranges, least)
    scales = target_scales(counts)
    if least > least_weighed(max(scales)):
        counts = count_ngrams(rows, labelled.good, ranges, least_weighed(max(scales)))
    setting, lowest = choose_setting(rows, counts, scales, ranges, labelled)
    weighted = weigh(rows, ngram_weights(counts, scales, [setting], ranges), 1, ranges)
    weighted = weighted.withColumn("log_weight", F.col("weights")[0]).withColumn(
        "occurrence", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "row_key", "doc_id", "log_weight", "occurrence")
    weighted = written(weighted, "weighted")
    k = weighted.filter(F.col("log_weight") >= F.lit(lowest)).count()
    return gumbel_top_k(weighted, k, temperature)


def keep_sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``importance_sample`` keeps, with all their columns."""
    kept = importance_sample(docs, labels, id_col, text_col).groupBy("row_key").agg(F.count(F.lit(1)).alias("kept_rows"))
    keyed, unique = carried(docs, id_col, text_col)
    if unique:
        return keyed.join(kept, "row_key", "left_semi").select("row.*")
    numbered = keyed.withColumn("place", F.row_number().over(Window.partitionBy("row_key").orderBy(F.lit(1))))
    return numbered.join(kept, "row_key").filter("place <= kept_rows").select("row.*")
