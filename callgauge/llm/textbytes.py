"""Words and word hashes of Arrow string columns, vectorised over their UTF-8 bytes.

A word is a maximal run of ASCII letters and digits and of bytes from 0x80 on, with A-Z
lower-cased: the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over lower-cased text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = True
_IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes that are hashed at once; a slice ends after a byte that is in no word.
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1_000_003)) * U64(0x9E3779B97F4A7C15)) | U64(1)


_BYTE = constants(256, 11)[_LOWER]
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = [np.ones(0, U64), np.ones(0, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLICE + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(n, U64(b))
            p[0] = U64(1)
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(p)
    return _powers


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its n + 1 offsets into them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[col.offset: col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


class Words:
    """The words of each text: ``hashes`` (64 bits), ``starts`` and ``ends`` (byte positions)
    of all, and ``first`` (n + 1 offsets into these, one range a text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        self.data, self.offsets = data, offsets
        lo, hi = int(offsets[0]), int(offsets[-1])
        body = data[lo:hi]
        inside = _IS_WORD[body]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        cuts = offsets[(offsets > lo) & (offsets < hi)] - lo  # a word ends with its text
        before[cuts] = False
        self.starts = np.flatnonzero(inside & ~before) + lo
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[cuts - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + lo + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash() if hashed else None

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=U64)
        k = 0
        with np.errstate(over="ignore"):
            while k < len(out):
                at = self.starts[k]
                j = max(int(np.searchsorted(self.ends, at + SLICE, "right")), k + 1)  # whole words only
                n = int(self.ends[j - 1] - at)
                power, inverse = _power_tables(n + 1)
                sums = np.zeros(n + 1, dtype=U64)
                np.cumsum(_BYTE[self.data[at: at + n]] * power[:n], out=sums[1:])
                s = self.starts[k:j] - at
                out[k:j] = mix((sums[self.ends[k:j] - at] - sums[s]) * inverse[s] + (self.ends[k:j] - at - s).astype(U64))
                k = j
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j (exclusive), lower-cased, with single spaces."""
        return b" ".join(_LOWER[self.data[s:e]].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j]))


class HashSet:
    """A sorted set of hashes; finds its members among many hashes."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.sorted, self.shift = np.unique(hashes), U64(64 - bits)
        self.filter = np.zeros(1 << bits, dtype=bool)
        self.filter[self.sorted >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` and their places in the sorted set."""
        at = np.flatnonzero(self.filter[hashes >> self.shift])
        k = np.searchsorted(self.sorted, hashes[at])
        k[k == len(self.sorted)] = 0
        same = self.sorted[k] == hashes[at] if len(self.sorted) else np.zeros(len(at), bool)
        return at[same], k[same]


def windows(hashes: np.ndarray, first: np.ndarray, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words and the n + 1 offsets of each text's; a text of fewer
    than k words has none."""
    n = len(hashes) - k + 1
    counts = np.maximum(np.diff(first) - k + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if n <= 0 or not bounds[-1]:
        return np.zeros(0, U64), np.zeros(len(first), np.int64)
    c = constants(k, seed)
    with np.errstate(over="ignore"):
        total = hashes[:n] * c[0]
        for j in range(1, k):
            total += hashes[j: n + j] * c[j]
        total = mix(total)
    keep = np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    return total[keep], bounds
