"""Counts per text that the quality operators share, for a slice of rows at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm.textops import _TABLES, U64, Words, between, mix, prefix, text_buffers

SYMBOLS = b"#*$%&|<>"


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``mask`` between row bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[bounds])


def repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items (key, row) in order: how often each occurs in its row, and whether it occurred before."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    _, first, inverse, count = np.unique(mix(key + mix(row.astype(U64))), return_index=True, return_inverse=True, return_counts=True)
    return count[inverse], first[inverse] != np.arange(len(key))


class TextStats:
    """Words, characters, lines and repetition of each text of a column."""

    def __init__(self, column: pa.Array):
        self.data, self.bounds = data, bounds = text_buffers(column)
        self.words = w = Words(data, bounds)
        self.n_words = w.count.astype(np.int64)
        heads = (data & 0xC0) != 0x80  # one per code point
        upto = np.concatenate([[0], np.cumsum(heads, dtype=np.int64)])
        self.n_chars = np.diff(upto[bounds])
        self.lengths = upto[w.end] - upto[w.start]
        self.word_chars = self._sum(self.lengths)
        self.n_symbols = per_row(byte_set(SYMBOLS)[data], bounds)
        self._lines()
        self._triples()

    def _sum(self, values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[self.words.first])

    def _lines(self) -> None:
        data, bounds = self.data, self.bounds
        rows = np.flatnonzero(bounds[1:] > bounds[:-1])
        cut = np.flatnonzero(data == 10)
        begin = np.sort(np.concatenate([bounds[rows], cut + 1]))
        owner = np.searchsorted(bounds, begin, "right") - 1
        # a line feed that ends a text opens an empty line, which holds no word
        ends = np.sort(np.concatenate([cut, bounds[rows + 1]]))
        begin, ends, owner = begin[: len(ends)], ends[: len(begin)], owner[: len(ends)]
        wordy = np.searchsorted(self.words.start, ends) > np.searchsorted(self.words.start, begin)
        begin, ends, owner = begin[wordy], ends[wordy], owner[wordy]
        key = between(prefix(_TABLES[2][data], 2), begin, ends, 2)
        _, again = repeats(key, owner)
        n = len(bounds) - 1
        self.n_lines = np.bincount(owner, minlength=n)
        self.n_dup_lines = np.bincount(owner[again], minlength=n)

    def _triples(self) -> None:
        w = self.words
        h = w.hashes(0)
        at = np.arange(len(h))
        start = at[at + 3 <= w.first[1:][w.row]] if len(h) else at
        key = between(prefix(h, 1), start, start + 3, 1)
        count, _ = repeats(key, w.row[start])
        step = np.zeros(len(h) + 1, np.int64)
        twice = start[count >= 2]
        np.add.at(step, twice, 1)
        np.add.at(step, np.minimum(twice + 3, len(h)), -1)
        self.n_repeat_words = self._sum(np.cumsum(step)[: len(h)] > 0)
        _, again = repeats(h, w.row)
        self.n_distinct_words = self._sum(~again)
        self.hashes = h
