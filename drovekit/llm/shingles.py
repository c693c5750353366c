"""Word-shingle sets of text batches as flat hash arrays, and their PartEnum signatures.

Everything is numpy over whole batches; it runs inside Arrow-batched Spark tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .flat import word_hashes

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_M3 = np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts): each row's sorted distinct 64-bit shingle hashes, and how many.

    A row of fewer than ``width`` words is one shingle, a row without words has none.
    """
    h, words = word_hashes(data, offsets)
    h = mix(h + np.uint64(seed) * _M1 + _M2)
    counts = np.where(words == 0, 0, np.maximum(1, words - width + 1))
    own = np.repeat(np.minimum(words, width), counts)  # words of each shingle: part of its hash
    at = spread(bounds(words)[:-1], counts)
    h = np.append(h, np.zeros(width, np.uint64))
    values = own.astype(np.uint64) * _M3
    for j in range(width):
        new = mix(values * _M2 + h[at + j])
        values = new if j == 0 else np.where(j < own, new, values)
    edges = bounds(counts)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[edges[:-1][counts > 0]] = True
    left = bounds(fresh)
    return values[fresh], left[edges[1:]] - left[edges[:-1]]


def set_keys(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set, as signed integers."""
    edges = bounds(counts)

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        return sums[edges[1:]] - sums[edges[:-1]]

    n = counts.astype(np.uint64)
    return mix(total(mix(values ^ _M1)) + n * _M3).view(np.int64), mix(total(mix(values + _M2)) + n).view(np.int64)


def odd_sketches(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A bit array of each set: bit i tells whether an odd number of its features hash to i.

    It has 1 to 2 bits per feature, a power of two and 64 at least. The bits in which two sketches
    differ are never more than the features in which the sets differ.
    """
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64))
    base = bounds(bits)
    where = (mix(values + _M3) & np.repeat(bits - 1, counts).astype(np.uint64)).astype(np.int64) + np.repeat(base[:-1], counts)
    packed = np.packbits((np.bincount(where, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little")
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)]


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch made as short as a sketch of ``size`` bytes."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


@dataclass(frozen=True)
class PartEnum:
    """Signatures such that sets with Jaccard similarity >= num/den share one.

    A set signs in its size band, and in each larger band that a linked set could be in, so that
    of a linked pair both sign in the larger set's band. There their symmetric difference is at
    most k. The feature domain is hashed into ``first`` partitions of ``subs`` sub-partitions.

    * subs = 3: over floor(k / 2) partitions, so at least first - floor(k / 2) of them differ in
      one feature or none; a signature is made for each two of the three sub-partitions, of which
      one pair agrees.
    * subs = 1: over k partitions, so at least first - k of them agree whole; a signature each.

    ``margin`` makes more partitions than needed, so that many agree. Then signatures of fewer than
    ``least`` features (empty ones, or a piece of a passage that many texts share) aren't needed
    by a set that has fewer partitions with such signatures than partitions that must agree; other
    sets make all signatures, so that none of the links is lost.
    """

    num: int
    den: int
    subs: int = 3
    margin: float = 1.15
    least: int = 3
    ratio: float = 1.235

    def band(self, label: int) -> tuple[int, int]:
        return _band(label, self.ratio)

    def labels(self, size: int) -> tuple[tuple[int, int, int], ...]:
        """(label, partitions, partitions that agree at least) of each band in which a set of this size signs."""
        return _labels(self, size)

    def signatures(self, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, row): signed 64-bit signatures of the sets and the row of each."""
        todo = [(row, *x) for row, n in enumerate(counts.tolist()) if n for x in self.labels(n)]
        if not todo:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        row, label, first, agree = np.array(todo, np.int64).T
        n = counts[row]
        v = values[spread(bounds(counts)[row], n)]
        salt = mix(label.astype(np.uint64) * _M3 + _M1)
        cells = first * self.subs
        base = bounds(cells)
        where = (mix(v + np.repeat(salt, n)) % np.repeat(cells.astype(np.uint64), n)).astype(np.int64) + np.repeat(base[:-1], n)
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, where, mix(v ^ _M3))
        held = np.bincount(where, minlength=base[-1])
        who = np.repeat(np.arange(len(row)), cells)
        cell = np.arange(base[-1]) - base[who]
        tag = mix(salt[who] + cell.astype(np.uint64) * _M2)
        if self.subs == 3:
            a, b = (base[who] + cell // 3 * 3 + (cell + s) % 3 for s in (1, 2))
            features = held[a] + held[b]
            out = mix(mix(sums[a] * _M1 + sums[b]) + tag)
            thin = (features < self.least).reshape(-1, 3).any(axis=1)
            poor = np.bincount(who[::3][thin], minlength=len(row))
        else:
            features = held
            out = mix(mix(sums * _M1) + tag)
            poor = np.bincount(who[features < self.least], minlength=len(row))
        keep = (features >= self.least) | (poor >= agree)[who]
        return out[keep].view(np.int64), row[who[keep]]


@lru_cache(maxsize=4096)
def _band(label: int, ratio: float) -> tuple[int, int]:
    lo = 1 if label == 0 else _band(label - 1, ratio)[1] + 1
    return lo, max(lo + 1, int(lo * ratio)) - 1


@lru_cache(maxsize=1 << 17)
def _labels(p: PartEnum, size: int) -> tuple[tuple[int, int, int], ...]:
    label = 0
    while _band(label, p.ratio)[1] < size:
        label += 1
    out, largest = [], size * p.den // p.num  # |A and B| <= size, hence |A or B| <= size * den / num
    while _band(label, p.ratio)[0] <= largest:
        # J >= t: a symmetric difference of at most (1 - t) / (1 + t) * (|A| + |B|)
        k = (p.den - p.num) * 2 * _band(label, p.ratio)[1] // (p.den + p.num)
        worst = k // 2 if p.subs == 3 else k
        first = max(worst + 1, int(worst * p.margin) + 1)
        out.append((label, first, first - worst))
        label += 1
    return tuple(out)
