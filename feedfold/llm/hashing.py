"""Hashes of words and rolling Rabin-Karp hashes of word windows over Arrow text columns, in numpy.

A word is read in chunks of eight bytes; each is mixed with a secret of its place and the results are added up. A window is a
polynomial in its words modulo the prime 2**61 - 1, under two random bases: any run is a difference of prefix sums times an
inverse power, so all windows of a batch take a few array operations, whatever the window length. Two different windows
of n words agree under a base with chance below n / 2**61, whatever the text looks like. Results are mixed, so any bits may be used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# 0 separates, runs of equal non-zero classes are words
BY_SPACE = np.ones(256, np.int8)
BY_SPACE[[0x20, *range(0x09, 0x0E)]] = 0
# letters, digits and bytes of other scripts are words, runs of other signs too
BY_KIND = np.array([0 if b <= 0x20 or b == 0x7F else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], np.int8)

PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
# Masks of the first 0 to 8 bytes of a little-endian word.
_HEAD = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo the prime, of any 64-bit values."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of values below it, by halves of 31 and 30 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0
    middle += a0 * b1
    total = a1 * b1
    total <<= np.uint64(1)
    total += middle >> np.uint64(30)
    total += (middle & np.uint64((1 << 30) - 1)) << half
    total += a0 * b0
    return _reduced(total)


class Powers:
    """Powers of a base and of its inverse modulo the prime, as many as were asked for so far."""

    def __init__(self, base: int) -> None:
        self.bases = (base, pow(base, -1, PRIME))
        self.up = self.down = np.ones(1, np.uint64)

    def _table(self, base: int, size: int) -> np.ndarray:
        table = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            more = min(filled, size - filled)
            table[filled:filled + more] = multiplied(table[:more], np.full(1, pow(base, filled, PRIME), np.uint64))
            filled += more
        return table

    def runs(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """sum of values[start + t] * base**t modulo the prime over each run."""
        if len(self.up) < len(values):
            self.up, self.down = (self._table(b, max(len(values), 1 << 14)) for b in self.bases)
        terms = multiplied(_reduced(values), self.up[:len(values)])
        sums = np.zeros(len(values) + 1, np.uint64)
        high = np.cumsum(terms >> np.uint64(31), dtype=np.uint64)
        sums[1:] = _reduced(_reduced((high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << np.uint64(31)))
                            + _reduced(np.cumsum(terms & np.uint64((1 << 31) - 1), dtype=np.uint64)))
        return multiplied(_reduced(sums[end] + (_P - sums[start])), self.down[start])


@dataclass
class Words:
    """Words of all texts of a batch in a row: their hashes, and per text the number of words and the first one."""

    hashes: np.ndarray
    counts: np.ndarray
    first: np.ndarray


class Hasher:
    """One family of hashes, fixed by its seed; keep one per task, as it holds its powers."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.secret = np.uint64(rng.integers(1 << 62, (1 << 63) - 1))
        self.bases = tuple(Powers(int(rng.integers(1 << 32, PRIME - 1))) for _ in range(2))

    def words(self, texts: pa.Array, classes: np.ndarray = BY_SPACE, fold_case: bool = False) -> Words:
        """Words are runs of one class of bytes (by default of all but space and \\t to \\r); a null text has none."""
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        kind = classes[data]
        turn = np.ones(len(data) + 1, bool)
        turn[1:-1] = kind[1:] != kind[:-1]
        turn[offsets] = True
        start, end = np.nonzero(turn[:-1] & (kind > 0))[0], np.nonzero(turn[1:] & (kind > 0))[0] + 1
        first = np.searchsorted(start, offsets)
        return Words(self.spans(data, start, end, fold_case), np.diff(first), first[:-1])

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool = False) -> np.ndarray:
        """A 64-bit hash of each non-empty span of bytes."""
        if not len(start):
            return np.zeros(0, np.uint64)
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[:len(data)] = data
        if fold_case:
            padded[:len(data)][(data >= 65) & (data <= 90)] += 32
        eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
        length = end - start
        chunks = (length + 7) >> 3
        after = np.cumsum(chunks)
        place = np.arange(after[-1]) - np.repeat(after - chunks, chunks)
        left = np.minimum(np.repeat(length, chunks) - 8 * place, 8)
        chunk = eights[np.repeat(start, chunks) + 8 * place] & _HEAD[left]
        chunk ^= mix(self.secret + place.astype(np.uint64))
        return mix(np.add.reduceat(mix(chunk), after - chunks) + length.astype(np.uint64))

    def runs(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each run of values, from its polynomials under both bases."""
        one, two = (powers.runs(values, start, end) for powers in self.bases)
        return mix(mix(one) + two)

    def windows(self, words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text number and start of every window of ``length`` words, by text and start."""
        per_text = np.maximum(words.counts - length + 1, 0)
        text = np.repeat(np.arange(len(per_text)), per_text)
        start = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        at = words.first[text] + start
        return self.runs(words.hashes, at, at + length), text, start
