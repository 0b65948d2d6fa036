"""Words of a batch of texts as 64-bit hashes, and hashes of runs of words, by whole-array steps.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. Word hashes mix the word's bytes eight at a time; the hash of a run of words is the
Rabin-Karp polynomial of its word hashes modulo 2**64, from prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
#: The multiplier of the Rabin-Karp polynomial (odd, so it has an inverse), one for each variant.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """Words of an Arrow string column: hashes, byte ranges, and the documents' word ranges.

    hash[i], start[i], end[i]: of word i; first[d] to first[d + 1]: the words of row d.
    """

    def __init__(self, column: pa.Array, fold: bool = False, seed: int = 0):
        column = column.cast(pa.large_string())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = column.buffers()[2]
        low, high = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(raw, dtype=np.uint8)[low:high] if raw is not None and high > low else np.zeros(0, np.uint8)
        offsets = offsets - low
        if fold:
            data = FOLD[data]
        self.data = data
        self.offsets = offsets
        inside = ~SPACE[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes(seed)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def again(self, seed: int) -> np.ndarray:
        """The words' hashes by another seed: after another mixing of every eight bytes, not of the first hash."""
        return self._hashes(seed, U64(0x8CB92BA72F3D8DD7))

    def _hashes(self, seed: int, step: np.uint64 = GOLDEN) -> np.ndarray:
        length = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        at = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        out = mix(length.astype(U64) * GOLDEN + U64(seed))
        which, place, left = np.arange(len(length)), self.start, length
        while len(which):
            out[which] = mix((out[which] ^ (at[place] & MASKS[np.minimum(left, 8)])) * U64(2 * seed + 1) + step)
            more = left > 8
            which, place, left = which[more], place[more] + 8, left[more] - 8
        return out

    def runs(self, size: int, variant: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of `size` words that lies within one row."""
        start = starts_within(self.first, size)
        return start, polynomial(self.hash, size, variant)[start] if len(start) else np.zeros(0, U64)


def starts_within(first: np.ndarray, size: int) -> np.ndarray:
    """The words at which a run of `size` words of the same row starts."""
    total = int(first[-1])
    if total < size:
        return np.zeros(0, np.int64)
    fits = np.ones(total, dtype=bool)
    fits[total - size + 1 :] = False
    for back in range(1, size):  # the last size - 1 words of each row start no run
        last = first[1:] - back
        fits[last[last >= first[:-1]]] = False
    return np.flatnonzero(fits)


def polynomial(hashes: np.ndarray, size: int, variant: int = 0) -> np.ndarray:
    """Rabin-Karp: hash of hashes[i : i + size] for each i, mixed; equal runs have equal hashes."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, U64)
    base = BASES[variant]
    powers = np.full(n, base, dtype=U64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    inverse = np.full(n, pow(base, -1, 1 << 64), dtype=U64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    prefix = np.zeros(n + 1, dtype=U64)
    np.cumsum(hashes * powers, out=prefix[1:])
    return mix((prefix[size:] - prefix[:-size]) * inverse[: n - size + 1])


def sliding_argmin(values: np.ndarray, size: int) -> np.ndarray:
    """For each i the leftmost place of the least of values[i : i + size]."""
    n = len(values) - size + 1
    best, place = values[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, size):
        less = values[k : k + n] < best
        best[less] = values[k : k + n][less]
        place[less] = k
    return place + np.arange(n)
