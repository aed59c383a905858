"""Words and word shingles of whole Arrow columns as numpy arrays, without a Python object per word.

A word is a run of bytes other than space and tab to carriage return, as in
``[^\\x20\\x09-\\x0D]+`` on UTF-8. Hashes are 64 bits; equal words have equal hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_33 = np.uint64(33)

_is_space = np.zeros(256, bool)
_is_space[[32, 9, 10, 11, 12, 13]] = True
_same = np.arange(256, dtype=np.uint8)
_lower = np.where((_same >= 65) & (_same <= 90), _same + 32, _same).astype(np.uint8)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; distinct values stay distinct."""
    h = h ^ (h >> _33)
    h = h * _M1
    h ^= h >> _33
    h *= _M2
    h ^= h >> _33
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        ramp = np.full(size, _BASE), np.full(size, _INVERSE)
        for r in ramp:
            r[0] = 1
        tables = tuple(np.multiply.accumulate(r) for r in ramp)
        if size > 1 << 24:  # a single very long text: not worth keeping
            return tables
        _powers[size] = tables
    return _powers[size]


@dataclass
class Words:
    """Words of several texts: ``first[d]:first[d + 1]`` are those of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    bounds: np.ndarray

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """Of every text, the kept words joined by one space."""
        n = len(self.data)
        inside = np.zeros(n + 1, np.int8)
        inside[self.start[keep]] += 1
        inside[self.end[keep]] -= 1  # a word never begins where another ends
        taken = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
        # The byte after a kept word becomes the space behind it, if its text goes on.
        inner = np.zeros(n + 1, bool)
        inner[self.bounds] = True
        behind = self.end[keep]
        behind = behind[~inner[behind]]
        taken[behind] = True
        data = self.data.copy()
        data[behind] = 32
        places = np.concatenate([[0], np.cumsum(taken)])[self.bounds]
        out = data[taken].tobytes()
        return [out[a:b].rstrip(b" ") for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]


def scan(array: pa.Array, lower: bool) -> Words:
    """Words of a text column; null counts as empty. ``lower`` maps A-Z to a-z first."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    bounds = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1]
    bounds = bounds.astype(np.int64) if len(array) else np.zeros(1, np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if lower:
        data = _lower[data]
    n = len(data)
    inside = ~_is_space[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= cut[1:n] | ~inside[:-1]
        closes[:-1] &= cut[1:n] | ~inside[1:]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start])
    return Words(data, start, end, hashes, np.searchsorted(start, bounds), bounds)


def runs_of(words: Words, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from every word on, and how many words of its text begin there.

    Where fewer than ``n`` words are left the hash means nothing.
    """
    h = words.hash
    counts = np.diff(words.first)
    left = np.repeat(words.first[1:], counts) - np.arange(len(h))
    odd = np.uint64(2 * seed + 0x2545F4914F6CDD1D)
    out = np.zeros(len(h), np.uint64)
    for k in range(n):
        out *= odd
        out[: len(h) - k] += h[k:]
    return mix(out + np.uint64(n)), left


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of every text.

    A text with fewer words has its whole sequence as the one shingle; one without words has none.
    """
    full, left = runs_of(words, n)
    out = []
    for d in range(len(words.first) - 1):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        elif b > a:
            part = 0
            for h in words.hash[a:b].tolist():
                part = (part * 0x9E3779B97F4A7C15 + h) % (1 << 64)
            out.append(mix(np.array([(part + b - a) % (1 << 64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
