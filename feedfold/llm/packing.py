"""Mixture-controlled packing of token streams into sequences by deficit round-robin over source queues.

Each source is a queue of tokens. In every round, which is one window of tokens for any number of sources, a source serves
its share of the window, as many whole tokens as its credit covers, and carries the rest (its deficit) on; a dry queue
leaves its slots to the others. The shares are dealt down a balanced tree over the sources: of the first k tokens of a
node, its left child has a number that follows from k alone. So the tokens that any source has served before any window take as
many steps as the tree has levels, no matter how many sources there are: partitions work on their own, carry the same
deficits, and agree on every position.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedfold.llm.bpe import REMEMBERED, PieceStore, encode_texts
from feedfold.llm.common import slices
from feedfold.session import fresh_path, written

LENGTH = 2048
END_ID = 1
# A source of weight 0 is served when all others are dry.
LEAST_WEIGHT = 1e-12
# Longer texts do not go through tiktoken at once.
WHOLE_CHARS = 1 << 20


def times_divided(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """floor(a * b / c) for 64-bit integers, exactly, where c > 0 and the result is below 2**53."""
    guess = np.floor(a.astype(float) * b / c).astype(np.int64)
    return guess + (a * b - guess * c) // c  # both products may wrap, their difference does not


@dataclass
class Schedule:
    """Totals and weights by source, in serving order, as a tree that tells how each node's tokens part.

    Node 1 is the root, node i has the children 2i and 2i + 1, and the sources are the leaves. While no queue below a
    node runs dry its tokens part in a fixed proportion, so a node has a table of (tokens, tokens of its left child) with a row per
    time at which one does. In between, the first k tokens from a row on have floor(k * left / all) of the left child.
    """

    totals: np.ndarray
    weights: np.ndarray
    length: int

    def __post_init__(self) -> None:
        n = len(self.totals)
        self.depth = (n - 1).bit_length()
        dry = self.totals / self.weights
        source = np.arange(n)
        firsts, tokens, lefts = [np.zeros(2, np.int64)], [], []  # node 0 does not exist
        rows = 0
        for level in range(self.depth):
            node = source >> (self.depth - level)
            is_left = (source >> (self.depth - level - 1)) % 2 == 0
            order = np.lexsort((dry, node))
            at, time = node[order], dry[order]
            begin = np.searchsorted(at, np.arange(1 << level))
            own = begin[at]

            def served(mine: np.ndarray) -> np.ndarray:
                """Tokens of such sources of the node served when each of its sources runs dry."""
                done = np.concatenate([[0], np.cumsum(np.where(mine, self.totals, 0)[order])])
                rate = np.concatenate([[0], np.cumsum(np.where(mine, self.weights, 0)[order])])
                base = done[own]
                done, whole = done[1:] - base, np.append(done[begin], done[-1])[at + 1] - base
                going = np.maximum(np.append(rate[begin], rate[-1])[at + 1] - rate[1:], 0)
                found = np.clip(np.rint(done + time * going).astype(np.int64), done, whole)
                last = np.append(at[1:] != at[:-1], True)
                found[last] = whole[last]
                return np.maximum.accumulate(found + base) - base  # the base keeps the nodes apart

            left = served(is_left)
            every = left + served(~is_left)
            new = np.append((at[1:] != at[:-1]) | (time[1:] != time[:-1]), True)  # the last source of each time
            at, left, every = at[new], left[new], every[new]
            more = every > np.where(np.append(True, at[1:] != at[:-1]), 0, np.append(0, every[:-1]))
            at, left, every = at[more], left[more], every[more]
            counts = np.bincount(at, minlength=1 << level) + 1  # each table begins with a row of zeros
            starts = np.cumsum(counts) - counts
            place = starts[at] + 1 + np.arange(len(at)) - (starts - np.arange(1 << level))[at]
            whole_rows = [np.zeros(int(counts.sum()), np.int64) for _ in range(2)]
            whole_rows[0][place], whole_rows[1][place] = every, left
            tokens.append(whole_rows[0])
            lefts.append(whole_rows[1])
            firsts.append(rows + starts)
            rows += int(counts.sum())
        self.first = np.concatenate([firsts[0][:1], *firsts[1:], [rows]])
        self.all = np.concatenate([np.zeros(0, np.int64), *tokens])
        self.left = np.concatenate([np.zeros(0, np.int64), *lefts])
        self.right = self.all - self.left

    def _row(self, node: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Per node the last row of its table, but for the very last one, whose value is at most the wanted one."""
        low, high = self.first[node], np.maximum(self.first[node + 1] - 2, self.first[node])
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            fits = values[middle] <= wanted
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    def windows(self, window: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that a source has served before and after a window, and those of the sources before it in the window."""
        total = int(self.totals.sum())
        before, after = np.minimum(window * self.length, total), np.minimum((window + 1) * self.length, total)
        earlier = np.zeros(len(window), np.int64)
        for level in range(self.depth):
            node = (1 << level) + (source >> (self.depth - level))
            bounds = []
            for k in (before, after):
                row = self._row(node, self.all, k)
                last = np.minimum(row + 1, self.first[node + 1] - 1)
                size = np.maximum(self.all[last] - self.all[row], 1)
                bounds.append(self.left[row] + times_divided(k - self.all[row], self.left[last] - self.left[row], size))
            right = (source >> (self.depth - level - 1)) % 2 == 1
            earlier += np.where(right, bounds[1] - bounds[0], 0)
            before, after = (np.where(right, k - b, b) for k, b in zip((before, after), bounds, strict=True))
        return before, after, earlier

    def window_of(self, source: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The window in which the tokens of the sources are served."""
        place = token
        for level in reversed(range(self.depth)):
            node = (1 << level) + (source >> (self.depth - level))
            right = (source >> (self.depth - level - 1)) % 2 == 1
            found = np.zeros(len(place), np.int64)
            for side in (False, True):
                mine = np.nonzero(right == side)[0]
                at, i = node[mine], place[mine]
                child = self.right if side else self.left
                row = self._row(at, child, i)
                last = np.minimum(row + 1, self.first[at + 1] - 1)
                part, size = np.maximum(child[last] - child[row], 1), self.all[last] - self.all[row]
                i = i - child[row]
                inside = times_divided(i, size, part) if side else -times_divided(-(i + 1), size, part) - 1
                found[mine] = self.all[row] + inside
            place = found
        return place // self.length

    def pieces(self, source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut documents (runs of their source's queue) by window and by sequence.

        Returns document number, start in the document, length, sequence and offset, ordered by document and start.
        """
        first, last = self.window_of(source, begin), self.window_of(source, begin + size - 1)
        # a document with fewer tokens than windows between its ends is looked up by token
        thin = last - first + 1 > size
        count = np.where(thin, size, last - first + 1)
        doc = np.repeat(np.arange(len(source)), count)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        window = first[doc] + step
        rare = np.nonzero(thin[doc])[0]
        window[rare] = self.window_of(source[doc[rare]], begin[doc[rare]] + step[rare])
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (window[1:] != window[:-1])
        doc, window = doc[new], window[new]
        before, after, earlier = self.windows(window, source[doc])
        low = np.maximum(begin[doc], before)
        high = np.minimum((begin + size)[doc], after)
        place = window * self.length + earlier + low - before
        start, left = low - begin[doc], high - low
        out = []
        while len(doc):
            some = left > 0
            doc, start, place, left = doc[some], start[some], place[some], left[some]
            sequence, offset, room = self.locate(place)
            take = np.minimum(left, room)
            out.append((doc, start, take, sequence, offset))
            start, place, left = start + take, place + take, left - take
        found = [np.concatenate(x) for x in zip(*out, strict=True)]
        order = np.lexsort((found[1], found[0]))
        return tuple(x[order] for x in found)

    def locate(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset and room left at places of the whole stream; what does not fill a window goes into powers of two."""
        full, tail = divmod(int(self.totals.sum()), self.length)
        ends = np.cumsum([0] + [1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1])
        rest = place - full * self.length
        part = np.maximum(np.searchsorted(ends, rest, "right") - 1, 0)
        inside = rest < 0
        last = np.minimum(part + 1, len(ends) - 1)
        return (np.where(inside, place // self.length, full + part),
                np.where(inside, place % self.length, rest - ends[part]),
                np.where(inside, self.length - place % self.length, ends[last] - rest))


def rank_table(tokenizer_json: str, pattern: str) -> dict[bytes, int] | None:
    """Ranks by token, if a byte-level BPE file merges in the order of its ids, so that tiktoken gives the same ids much faster."""
    spec = json.loads(tokenizer_json)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
             and not split.get("add_prefix_space") and not spec["normalizer"] and not model.get("dropout"))
    if not plain:
        return None
    # a byte is spelled by its own character if that can be printed, else by one of those from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [ranks[bytes(byte[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
    if merged != sorted(set(merged)) or len(merged) + 256 != len(ranks):
        return None
    return ranks


def spelled_tokens(tokenizer_json: str) -> dict[str, int] | None:
    """Ids of the added tokens that the library reads wherever a text spells them out; None if some depend on what is around them."""
    added = json.loads(tokenizer_json)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    return {t["content"]: t["id"] for t in added}


def tokenize(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = END_ID, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A stored table of documents as ids and of their places in the queues.

    Columns: doc_id, source, queue (a non-null name), part and local_start (tokens of the queue before the document in its part),
    n_tokens and ids (little-endian unsigned, 2 bytes each if the vocabulary allows, else 4); ``end_id`` ends every
    document. Ids are those of the tokenizers library, which adds no special tokens but reads those that a text spells out. Where the file is a rank table in
    disguise, tiktoken makes them; other files and texts over WHOLE_CHARS are encoded by the library, each match of ``pattern`` once per task.
    """
    spark = docs.sparkSession
    whole = Tokenizer.from_file(tokenizer_path)
    spec = whole.to_str()
    shared = spark.sparkContext.broadcast((spec, rank_table(spec, pattern), spelled_tokens(spec)))
    width = 2 if whole.get_vocab_size() <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, ranks, added = Tokenizer.from_str(shared.value[0]), *shared.value[1:]
        tokenizer.encode_special_tokens = added is not None
        # the longest first, as the library reads them
        spelled = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        quick = ranks and tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        words, store, part, served = regex.compile(pattern), PieceStore(), TaskContext.get().partitionId(), {}

        def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """All ids in a row, and the end of each text in them."""
            if added is None:
                found = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.int64) for t in texts]
                return np.concatenate(found), np.cumsum([len(f) for f in found])
            if spelled and any(map(spelled.search, texts)):
                cut = [spelled.split(t) for t in texts]  # every second part is an added token
                ids, ends = encoded([p for one in cut for p in one[::2]])
                runs = iter(np.split(ids, ends[:-1]))
                found = [np.concatenate([[added[p]] if i % 2 else next(runs) for i, p in enumerate(one)]) for one in cut]
                return np.concatenate(found), np.cumsum([len(f) for f in found])
            if quick and max(map(len, texts)) <= WHOLE_CHARS:
                found = [quick.encode_to_numpy(t) for t in texts]
                return np.concatenate(found), np.cumsum([len(f) for f in found])
            return encode_texts(texts, words.findall, lambda new: [
                e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)], store)

        for batch in slices(batches, "text", 2 << 20):
            if len(store.index) > REMEMBERED:
                store = PieceStore()
            texts = [t or "" for t in batch.column(2).to_pylist()]
            ids, ends = encoded(texts)
            counts = np.diff(ends, prepend=0) + 1
            stops = np.cumsum(counts)
            all_ids = np.full(int(stops[-1]), end_id, f"<u{width}")
            keep = np.ones(len(all_ids), bool)
            keep[stops - 1] = False
            all_ids[keep] = ids
            queues, starts = batch.column(3).to_pylist(), []
            for queue, n in zip(queues, counts.tolist(), strict=True):
                starts.append(served.get(queue, 0))
                served[queue] = starts[-1] + n
            offsets = np.concatenate([[0], stops * width]).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(all_ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(np.full(len(counts), part, np.int32)),
                 pa.array(starts, pa.int64()), pa.array(counts), blobs],
                ["doc_id", "source", "queue", "part", "local_start", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.col(text_col).alias("text"),
                       F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("queue"))
    schema = "doc_id long, source string, queue string, part int, local_start long, n_tokens long, ids binary"
    path = fresh_path(spark, "tokens")
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def pack(tokens: DataFrame, length: int = LENGTH, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Pack the table of ``tokenize`` into sequences of ``length`` (a power of two) tokens.

    Returns per piece: doc_id, source, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    ``targets`` weighs the sources (those not named count 0.01); without it each source gets its share of all tokens, so that
    all queues run dry together. Every token is packed once; the mixture shifts to the other sources only when a queue is dry. All
    sequences but those of the last window are full; that window's tokens fill sequences of powers of two, so there is no
    padding. Documents may be cut anywhere. Null sources are a queue of their own, null and empty texts only
    have the end id, ids may be null or repeat, and an empty table gives no pieces. The totals (a row per source) and
    the tree over them are all that the driver sees.
    """
    parts = tokens.groupBy("queue", "source", "part").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0))), "queue-parts")
    sums = sorted(parts.groupBy("queue", "source").agg(F.sum("n").alias("n")).collect())
    schema = ("doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    if not sums:
        return tokens.sparkSession.createDataFrame([], schema)
    totals = np.array([r.n for r in sums], np.int64)
    weights = totals if targets is None else np.array([targets.get(r.source, 0.01) for r in sums], float)
    shared = tokens.sparkSession.sparkContext.broadcast(
        (Schedule(totals, totals if targets is None else np.maximum(weights / weights.sum(), LEAST_WEIGHT), length),
         {r.queue: i for i, r in enumerate(sums)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, number = shared.value
        for batch in slices(batches, "ids", 2 << 20):
            doc_id, source, queue, begin, size, blobs = batch.columns
            size = size.to_numpy()
            doc, start, taken, sequence, offset = plan.pieces(
                np.array([number[q] for q in queue.to_pylist()]), begin.to_numpy(), size)
            raw = b"".join(blobs.to_pylist())
            ids = np.frombuffer(raw, f"<u{len(raw) // int(size.sum())}").astype("<u4")
            offsets = np.concatenate([[0], np.cumsum(taken) * 4]).astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [doc_id.take(at), source.take(at), pa.array(start), pa.array(taken), out, pa.array(size[doc]),
                 pa.array(sequence), pa.array(offset)],
                ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return (tokens.join(parts.select("queue", "part", "base"), ["queue", "part"])
            .select("doc_id", "source", "queue", (F.col("base") + F.col("local_start")).alias("begin"), "n_tokens", "ids")
            .mapInArrow(run, schema))
