"""Words of Arrow text batches as 64-bit hashes, in numpy; the work of a task between two Spark shuffles.

A word is a run of bytes that are not white space (blank, 09 to 0D); A-Z count as a-z unless told otherwise. Texts are read whole: a batch is
cut into blocks of a few megabytes, and a longer text at white space into pieces whose words are joined again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.arange(1, 257, dtype=np.uint64)
_LOWER = _PLAIN.copy()
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)
_MULTIPLIERS = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(1, 9)], np.uint64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a hash over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        grown = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            grown.append(np.cumprod(steps, dtype=np.uint64))
        _powers = tuple(grown)
    return _powers


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets of the rows in them) of a text column, nulls as empty texts."""
    column = pa.array(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word ends with its text."""
    solid = ~_SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER if fold else _PLAIN)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def hashed_words(column: pa.Array, fold: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, index of each row's first word, with the end) for the blocks of a text column.

    Without ``fold`` A-Z differ from a-z.
    """
    for first, rows, data, offsets in blocks(column):
        if len(data) <= 2 * BLOCK:
            starts, ends = word_spans(data, offsets)
            yield first, _hashes(data, starts, ends, fold), np.searchsorted(starts, offsets)
            continue
        parts, at = [], 0  # one long text, in pieces that end at white space
        while at < len(data):
            stop = min(len(data), at + BLOCK)
            while stop < len(data):
                space = np.flatnonzero(_SPACE[data[stop : stop + BLOCK]])
                if len(space):
                    stop += int(space[0])
                    break
                stop = min(len(data), stop + BLOCK)
            piece = data[at:stop]
            starts, ends = word_spans(piece, np.array([0, len(piece)]))
            parts.append(_hashes(piece, starts, ends, fold))
            at = stop
        words = np.concatenate(parts)
        yield first, words, np.array([0, len(words)])


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, of the whole as one run; none of none."""
    if len(words) == 0:
        return words
    n = min(size, len(words))
    count = len(words) - n + 1
    total = np.full(count, np.uint64(n))
    for j in range(n):
        total = total + words[j : j + count] * _MULTIPLIERS[j]
    return mix(total)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each text."""
    for first, words, index in hashed_words(column):
        for row in range(len(index) - 1):
            yield first + row, np.unique(runs(words[index[row] : index[row + 1]], size))
