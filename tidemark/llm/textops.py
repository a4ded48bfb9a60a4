"""Whole-column text work on Arrow buffers: words, fingerprints, and the Arrow map that feeds them.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return.  Fingerprints are 64-bit polynomial hashes with fixed tables, so every task on every
machine gives a word the same number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
SPACES = (9, 10, 11, 12, 13, 32)
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20

_TABLES = np.random.default_rng(20240607).integers(0, 2**64, (4, 256), dtype=U64)
_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x2545F4914F6CDD1D]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = 1 << max(n, 1024).bit_length()
        out = []
        for base in (_BASES[seed], pow(_BASES[seed], -1, 2**64)):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 4 * SLICE_BYTES:  # a longer text is rare: its table isn't kept
            _POWERS[seed] = have
    return have


def prefix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums of ``values`` weighted by powers of the base; ``between`` reads range hashes off."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _powers(len(values) + 1, seed)[0][: len(values)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Fingerprints of the value ranges [start, end), equal for equal content wherever it stands."""
    inverse = _powers(len(sums), seed)[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


class Words:
    """The words of a slice of rows: byte spans, the row of each, and each row's first word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = IS_WORD[data]
        opening = inside[1:-1] & ~inside[:-2]
        closing = inside[1:-1] & ~inside[2:]
        filled = bounds[:-1][bounds[1:] > bounds[:-1]]
        opening[filled] = inside[filled + 1]
        last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        closing[last] = inside[last + 1]
        self.data, self.bounds = data, bounds
        self.start = np.flatnonzero(opening)
        self.end = np.flatnonzero(closing) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(bounds) - 1), self.count)

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return between(prefix(_TABLES[seed][data], seed), self.start, self.end, seed)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row bounds of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if values is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``max_bytes`` of text; one long text is a slice of its own."""
    lengths = np.diff(text_buffers(batch.column(column))[1])
    total, begin = np.cumsum(lengths), 0
    while begin < len(lengths):
        done = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, done + max_bytes, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def map_slices(df: DataFrame, text: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema,
               max_bytes: int = SLICE_BYTES) -> DataFrame:
    """``work`` over slices of rows whose ``text`` is bounded in bytes, so memory doesn't follow the
    number of rows in a batch."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, text, max_bytes):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
