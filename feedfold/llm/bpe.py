"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

Every regular-expression match is merged on its own. A segment tree over its byte positions keeps the leftmost
minimum of all pair ranks in its root; a merge rewrites the pair's leaf, the leaf of the live left neighbour and
the leaf that dies, and climbs to the root from each. Short matches go through the trees of a whole batch in
lockstep (one array row per match), long ones through one tree each, so a match of n bytes costs n log n steps.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedfold.llm.common import slices

NEVER = np.int64(1) << 60
# Matches up to this many bytes are merged in lockstep.
LOCKSTEP_BYTES = 256
# Distinct matches remembered by a task before it starts afresh.
REMEMBERED = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Token bytes by id, and an open-addressing table from adjacent token ids to the id they merge into."""

    tokens: list[bytes]
    whole: dict[bytes, int]
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ids: np.ndarray

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs, -1 where a pair does not merge."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = _slot(key, len(self.pair_keys))
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            seen = self.pair_keys[slot]
            hit = seen == key[todo]
            out[todo[hit]] = self.pair_ids[slot[hit]]
            on = ~hit & (seen >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.pair_keys) - 1)
        return out


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    shift = np.uint64(64 - size.bit_length() + 1)
    return ((key.astype(np.uint64) * _MIX) >> shift).astype(np.int64)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        whole = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
    tokens = [b""] * (max(whole.values()) + 1)
    for token, rank in whole.items():
        tokens[rank] = token
    pairs = [(whole[t[:i]], whole[t[i:]], r) for t, r in whole.items() for i in range(1, len(t))
             if t[:i] in whole and t[i:] in whole]
    keys = np.array([(a << 32) | b for a, b, _ in pairs], np.int64)
    ids = np.array([r for _, _, r in pairs], np.int64)
    size = 1 << (4 * len(pairs)).bit_length()
    pair_keys, pair_ids = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    slot, todo = _slot(keys, size), np.arange(len(keys))
    while len(todo):  # each round settles one key per free slot
        free = pair_keys[slot] < 0
        first = np.zeros(len(todo), bool)
        first[np.unique(slot, return_index=True)[1]] = True
        put = free & first
        pair_keys[slot[put]], pair_ids[slot[put]] = keys[todo[put]], ids[todo[put]]
        todo, slot = todo[~put], np.where(free[~put], slot[~put], (slot[~put] + 1) & (size - 1))
    return Vocabulary(tokens, whole, np.array([whole[bytes([b])] for b in range(256)], np.int64), pair_keys, pair_ids)


def _merge_lockstep(vocab: Vocabulary, pieces: list[bytes], width: int) -> list[np.ndarray]:
    """Token ids of pieces of at most ``width`` (a power of two) bytes, merging all pieces step by step together."""
    n = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    place = np.arange(width)
    live = place < size[:, None]
    token = np.where(live, vocab.byte_ids[raw], -1)
    after = np.where(place + 1 < size[:, None], place + 1, width) + np.zeros((n, 1), np.int64)
    after = np.concatenate([after, np.full((n, 1), width)], axis=1)
    before = np.concatenate([np.broadcast_to(place - 1, (n, width)), np.zeros((n, 1), np.int64)], axis=1)
    token = np.concatenate([token, np.full((n, 1), -1)], axis=1)
    tree = np.full((n, 2 * width), NEVER)

    def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank * width + place, so that the minimum is the leftmost pair of the lowest rank."""
        nxt = after[rows, at]
        rank = vocab.merged(token[rows, at], np.maximum(token[rows, nxt], 0))
        return np.where((nxt < width) & (rank >= 0), rank * width + at, NEVER)

    r, c = np.nonzero(place + 1 < size[:, None])
    tree[r, width + c] = leaf(r, c)
    node = width
    while node > 1:
        half = node // 2
        tree[:, half:node] = np.minimum(tree[:, node:2 * node:2], tree[:, node + 1:2 * node:2])
        node = half
    rows = np.nonzero(tree[:, 1] < NEVER)[0]
    while len(rows):
        rank, at = np.divmod(tree[rows, 1], width)
        dead = after[rows, at]
        following = after[rows, dead]
        token[rows, at], after[rows, at] = rank, following
        token[rows, dead] = -1
        before[rows, following] = at
        left = before[rows, at]
        has_left = left >= 0
        tree[rows, width + dead] = NEVER
        tree[rows, width + at] = leaf(rows, at)
        tree[rows[has_left], width + left[has_left]] = leaf(rows[has_left], left[has_left])
        spots = np.stack([width + dead, width + at, width + np.where(has_left, left, at)])
        while spots[0, 0] > 1:
            spots >>= 1
            tree[rows, spots] = np.minimum(tree[rows, 2 * spots], tree[rows, 2 * spots + 1])
        rows = rows[tree[rows, 1] < NEVER]
    token = token[:, :width]
    flat, counts = token[token >= 0], (token >= 0).sum(axis=1)
    return np.split(flat, np.cumsum(counts)[:-1])


def _longs(values: np.ndarray) -> array:
    """Machine integers that Python reads and writes one by one faster than numpy's, at eight bytes each."""
    return array("q", values.astype(np.int64).tobytes())


def _merge_long(vocab: Vocabulary, piece: bytes) -> np.ndarray:
    """Token ids of one long piece through its own tree."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    token = vocab.byte_ids[np.frombuffer(piece, np.uint8)]
    ranks = vocab.merged(token[:-1], token[1:])
    leaves = np.full(width, NEVER)
    leaves[:n - 1] = np.where(ranks >= 0, ranks * width + np.arange(n - 1), NEVER)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = _longs(np.concatenate([[NEVER], *reversed(levels)]))
    del leaves, levels
    ids, after, before = _longs(np.append(token, -1)), _longs(np.append(np.arange(1, n + 1), n)), _longs(np.append(np.arange(-1, n - 1), n - 1))
    never, tokens, whole = int(NEVER), vocab.tokens, vocab.whole

    def update(at: int, value: int) -> None:
        node = width + at
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

    def leaf(at: int) -> int:
        nxt = after[at]
        rank = whole.get(tokens[ids[at]] + tokens[ids[nxt]], -1) if nxt < n else -1
        return rank * width + at if rank >= 0 else never

    while tree[1] < never:
        rank, at = divmod(tree[1], width)
        dead = after[at]
        after[at], ids[at], ids[dead] = after[dead], rank, -1
        before[after[dead]] = at
        update(dead, never)
        update(at, leaf(at))
        if before[at] >= 0:
            update(before[at], leaf(before[at]))
    kept = np.frombuffer(ids, np.int64)
    return kept[kept >= 0]


def merge_pieces(vocab: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Token ids of every piece."""
    out: list[np.ndarray | None] = [None] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if piece in vocab.whole:
            out[i] = np.array([vocab.whole[piece]])
        elif len(piece) > LOCKSTEP_BYTES:
            out[i] = _merge_long(vocab, piece)
        else:
            by_width.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(i)
    for width, members in by_width.items():
        step = max(1, (1 << 18) // width)
        for k in range(0, len(members), step):
            some = members[k:k + step]
            for i, ids in zip(some, _merge_lockstep(vocab, [pieces[j] for j in some], width), strict=True):
                out[i] = ids
    return out


class PieceStore:
    """Ids of the pieces met so far, as one flat array with a start and a length per piece."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.length = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int32)

    def add(self, names: list[str], ids: list[np.ndarray]) -> None:
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        need, have = self.used + int(counts.sum()), len(self.index)
        while len(self.flat) < need:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.start) < have + len(names):
            self.start, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length))
        self.flat[self.used:need] = np.concatenate(ids)
        self.start[have:have + len(names)] = self.used + np.cumsum(counts) - counts
        self.length[have:have + len(names)] = counts
        self.index.update(zip(names, range(have, have + len(names)), strict=True))
        self.used = need


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


def encode_texts(texts: list[str], split, merge, store: PieceStore) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and the end of each text in them. ``merge`` gives the ids of new pieces."""
    found = [split(t) for t in texts]
    pieces = [p for one in found for p in one]
    new = list(set(pieces).difference(store.index))
    if new:
        store.add(new, merge(new))
    at = np.fromiter(map(store.index.__getitem__, pieces), np.int64, len(pieces))
    lengths = store.length[at]
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return (gather(store.flat, store.start[at], lengths),
            ends[np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))] if found else np.zeros(0, np.int64))


def encode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, without special tokens.

    Null and empty texts have no ids; a null id is kept; repeated rows are encoded each; an empty table gives an
    empty result; other columns are not read. The vocabulary (a few MB) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(load_vocabulary(vocab_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, store, vocab = regex.compile(pattern), PieceStore(), Vocabulary(**shared.value)
        for batch in slices(batches, "text", 2 << 20):
            if len(store.index) > REMEMBERED:
                store = PieceStore()
            ids, ends = encode_texts([t or "" for t in batch.column(1).to_pylist()], words.findall,
                                     lambda new: merge_pieces(vocab, [p.encode() for p in new]), store)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """Add ``decoded``, the bytes that ``ids`` stand for, to the (doc_id, ids) rows of ``encode``."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocab_path).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        start = np.cumsum(length) - length
        for batch in slices(batches, "ids", 1 << 19):
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            per_id = length[ids]
            data = gather(flat, start[ids], per_id)
            ends = np.concatenate([[0], np.cumsum(per_id)])
            counts = np.array([n or 0 for n in lists.value_lengths().to_pylist()])
            offsets = np.concatenate([[0], ends[np.cumsum(counts)]]).astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, out], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
