"""Text columns as flat byte arrays: white-space handling and word hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def spans(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows in them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ASCII white space within a row as one space."""
    if not len(data):
        return data, offsets
    space = SPACE[data]
    again = np.empty_like(space)
    again[0] = False
    again[1:] = space[1:] & space[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    again[heads] = False
    if not again.any() and not (space & (data != 32)).any():
        return data, offsets
    out = np.where(space, np.uint8(32), data)[~again]
    gone = np.concatenate(([0], np.cumsum(again)))
    return out, offsets - gone[offsets]


_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(4095, _BASE, np.uint64))))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, _BASE, np.uint64))))
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased, ASCII white space splits) and the words of each row."""
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    word = ~SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = word[heads]
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    counts = np.diff(np.searchsorted(at, offsets))
    position = np.cumsum(word)  # the number of word bytes up to here
    first = position[at] - 1
    lengths = np.diff(np.append(first, position[-1]))
    power = powers(int(lengths.max()))
    within = np.arange(position[-1]) - np.repeat(first, lengths)
    return np.add.reduceat(_TABLE[LOWER[data[word]]] * power[within], first), counts
