"""Substring deduplication: repeated windows of words are removed after their first occurrence.

Every window of fixed length is hashed in rolling (Rabin-Karp) form. Spark shuffles the hashes by value; each bucket
finds the hashes that occur twice and keeps the earliest occurrence. The start positions go back to their documents, where overlapping
and adjacent windows merge into maximal intervals of words to remove.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedfold.llm.common import identified, slices
from feedfold.llm.hashing import Hasher

WINDOW_WORDS = 20
# Bytes of text hashed at a time, and per bucket of hashes (over a million windows, some 12 MB).
SLICE_BYTES = 3 << 19
BUCKET_BYTES = 8 << 20
WORD_BYTES = 6
# The hash grows with the input so that the expected number of windows wrongly taken for equal stays below 2**-SAFE_BITS.
SAFE_BITS = 8
BLOB = "bucket int, keys binary, steps binary, docs binary, runs binary"


def _planes(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Integers as byte planes, which compress well."""
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T).tobytes()


def _unplanes(data: bytes, kind: str = "<u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel().astype(np.int64)


def _pack(doc: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(doc, start) pairs in that order as steps between starts, the documents and their runs."""
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    at = np.nonzero(new)[0]
    steps = np.diff(start, prepend=0)
    steps[at] = start[at]
    return _planes(steps), _planes(np.diff(doc[at], prepend=0), "<i8"), _planes(np.diff(at, append=len(doc)))


def _unpack(steps: bytes, docs: bytes, runs: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, docs, runs = _unplanes(steps), np.cumsum(_unplanes(docs, "<i8")), _unplanes(runs)
    total = np.cumsum(steps)
    at = np.cumsum(runs) - runs
    return np.repeat(docs, runs), total - np.repeat(total[at] - steps[at], runs)


def _hash_windows(length: int, buckets: int, key_bytes: int):
    """Per batch and bucket the earliest occurrence of each hash; later ones in the batch go on as known repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = [Hasher(seed) for seed in range(1 if key_bytes * 8 + math.log2(buckets) <= 64 else 2)]
        for batch in slices(batches, "text", SLICE_BYTES):
            key, rows = np.unique(batch.column(0).to_numpy(), return_index=True)
            if len(rows) < batch.num_rows:  # rows that share a key are one document
                batch = batch.take(pa.array(np.sort(rows)))
            key = batch.column(0).to_numpy()
            found = [f.windows(f.words(batch.column(1)), length) for f in families]
            doc, start = key[found[0][1]], found[0][2]
            hashes = [f[0] for f in found]
            if not len(doc):
                continue
            if (np.diff(key) < 0).any():
                order = np.argsort(doc, kind="stable")
                doc, start, hashes = doc[order], start[order], [h[order] for h in hashes]
            order = np.argsort(hashes[0], kind="stable") if len(hashes) == 1 else np.lexsort(hashes[::-1])
            new = np.concatenate([[True], np.any([h[order[1:]] != h[order[:-1]] for h in hashes], axis=0)])
            repeats = np.sort(order[~new])
            firsts = np.sort(order[new])
            bucket = (hashes[0][firsts] % np.uint64(buckets)).astype(np.int32)
            firsts = firsts[np.argsort(bucket, kind="stable")]
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            keys = np.stack([hashes[0][firsts] // np.uint64(buckets), *(h[firsts] for h in hashes[1:])], axis=1)
            keys = keys.view(np.uint8)[:, :key_bytes]
            rows = [(b, keys[i:j].tobytes(), *_pack(doc[firsts[i:j]], start[firsts[i:j]]))
                    for b, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if j > i]
            if len(repeats):
                rows.append((int(doc[repeats[0]] % buckets), None, *_pack(doc[repeats], start[repeats])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], BLOB.replace(",", "").split()[::2])
    return run


def _later_occurrences(key_bytes: int):
    """All (document, starts) of a bucket whose hash occurs earlier."""
    def run(bucket: pa.Table) -> pa.Table:
        known, rest, keys = [], [], []
        for key, *packed in zip(*(c.to_pylist() for c in bucket.columns[1:]), strict=True):
            (known if key is None else rest).append(_unpack(*packed))
            if key is not None:
                wide = np.zeros((len(key) // key_bytes, 16), np.uint8)
                wide[:, :key_bytes] = np.frombuffer(key, np.uint8).reshape(-1, key_bytes)
                keys.append(wide.view(np.uint64))
        if rest:
            doc, start = (np.concatenate(x) for x in zip(*rest, strict=True))
            low, high = np.concatenate(keys).T
            order = np.lexsort((low, high)) if high.any() else np.argsort(low)
            low, high = low[order], high[order]
            same = (low[1:] == low[:-1]) & (high[1:] == high[:-1])
            twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            doc, start, low, high = doc[order][twice], start[order][twice], low[twice], high[twice]
            order = np.lexsort((start, doc, low, high))
            doc, start, low, high = doc[order], start[order], low[order], high[order]
            new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[:len(doc)]
            lead = np.nonzero(new)[0][np.cumsum(new) - 1]
            later = (doc != doc[lead]) | (start != start[lead])
            known.append((doc[later], start[later]))
        doc, start = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order].astype(np.int32)
        at = np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[:len(doc)])[0]
        parts = [x.tobytes() for x in np.split(start, at[1:])][:len(at)]
        return pa.table({"row_key": pa.array(doc[at], pa.int64()), "starts": pa.array(parts, pa.binary())})
    return run


def _cut(length: int):
    """Merge the starts of every document into intervals and leave their words out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                kept, spans, at = [], [], 0
                starts = np.unique(np.frombuffer(b"".join(parts or []), np.int32))
                if len(starts):
                    gap = np.nonzero(np.diff(starts) > length)[0]
                    for s, e in zip(starts[np.append(0, gap + 1)].tolist(),
                                    (starts[np.append(gap, len(starts) - 1)] + length).tolist(), strict=True):
                        kept += words[at:s]
                        spans.append({"first": s, "end": e})
                        at = e
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), spans, b" ".join(kept).decode()))
            columns = zip(*out, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             ["doc_id", "n_words", "n_removed", "removed", "kept_text"])
    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            length: int = WINDOW_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, removed (intervals of word numbers, end excluded) and kept_text.

    Words are runs of characters other than space and \\t to \\r. A word goes if a window of ``length`` words that covers it also
    starts earlier: in a row with a smaller id (null ids first, ties by a digest of the text) or earlier in the same
    row. Rows that agree in id and text are one document: they lose the same words, and none to each other. A null or short text loses nothing;
    an empty table gives an empty result; other columns are not read.
    """
    rows = identified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, -(-size // BUCKET_BYTES))
    bits = 2 * math.log2(max(2, size / WORD_BYTES)) + SAFE_BITS - math.log2(buckets)
    key_bytes = min(16, max(1, math.ceil(bits / 8)))
    hashed = rows.select("row_key", "text").mapInArrow(_hash_windows(length, buckets, key_bytes), BLOB)
    later = hashed.groupBy("bucket").applyInArrow(_later_occurrences(key_bytes), "row_key long, starts binary")
    starts = later.groupBy("row_key").agg(F.collect_list("starts").alias("parts"))
    return rows.join(starts, "row_key", "left").select("doc_id", "text", "parts").mapInArrow(
        _cut(length), "doc_id long, n_words long, n_removed long, removed array<struct<first:int,end:int>>, kept_text string")
