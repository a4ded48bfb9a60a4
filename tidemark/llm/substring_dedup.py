"""Exact removal of long passages that repeat across documents, by recompression.

Every document is a sequence of words.  Rounds rename it: a *run* of one symbol becomes one symbol,
then every *pair* of neighbours (a, b) with a in the left and b in the right half of that round's
alphabet becomes one symbol.  Names are fingerprints of what they stand for, and the halves are read
off the fingerprints, so a name is global: all tasks agree without exchanging a dictionary.  Each
symbol carries the stretch of words that decided it (itself and the neighbours looked at); equal
stretches hold equal symbols wherever they occur.

A window of ``WINDOW`` words is filed under one symbol decided wholly inside it: a long one of a high
level if it has one (levels up to ``LEVEL``, lengths of ``LONG``), else of the highest level that has
any (a word is a symbol of level 0), and among those the one of least fingerprint.  Equal windows are thus filed under equal symbols, and consecutive windows share
theirs.  A record is one symbol with its block of consecutive windows, about 20 at a time.

Spark then finds the symbols that two documents share.  A block equal to that of an earlier document
is removed as a whole; of blocks that differ but share the symbol, one representative each is spelled
out into windows, which are compared by two fingerprints (128 bits).  Hot passages shrink by partial
aggregation before each shuffle: copies of a block are one row per task.

Defined results: null or empty text has no words; rows that repeat a doc_id are separate rows of that
document; rows with a null doc_id keep all their words and remove none elsewhere; other columns are
ignored, so clashing names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bitmap import likely
from tidemark.llm.textops import U64, Words, between, map_slices, mix, prefix, signed, text_buffers
from tidemark.plans.staging import stage

WINDOW = 50
LEVEL = 5
LONG = (6, 4, 4, 3, 2)


class Symbols:
    """One level of names: word span [s, e) and the deciding stretch [cl, cr) of each symbol."""

    def __init__(self, name, s, e, cl, cr, first):
        self.name, self.s, self.e, self.cl, self.cr, self.first = name, s, e, cl, cr, first

    def __len__(self):
        return len(self.name)


FAR = 1 << 40


def words_level(words: np.ndarray, row: np.ndarray) -> Symbols:
    at = np.arange(len(words))
    first = np.ones(len(words), bool)
    first[1:] = row[1:] != row[:-1]
    return Symbols(words, at, at + 1, at, at + 1, first)


def _neighbours(x: Symbols):
    """Left and right stretch limits of each symbol's neighbours; none beyond a document's edge."""
    n = len(x)
    before, after = np.full(n, -FAR), np.full(n, FAR)
    before[1:] = np.where(x.first[1:], -FAR, x.cl[:-1])
    after[:-1] = np.where(x.first[1:], FAR, x.cr[1:])
    return before, after


def name_runs(x: Symbols, words: np.ndarray) -> Symbols:
    """Runs of one symbol become one.  That a neighbour differs shows in one word, unless that agrees."""
    n = len(x)
    if not n:
        return x
    same = np.zeros(n + 1, bool)
    same[1:-1] = (x.name[1:] == x.name[:-1]) & ~x.first[1:]
    heads = np.flatnonzero(~same[:-1])
    tails = np.flatnonzero(~same[1:])
    before, after = _neighbours(x)
    s, e = x.s[heads], x.e[tails]
    left_word = words[np.maximum(s - 1, 0)] != words[x.e[heads] - 1]
    right_word = words[np.minimum(e, len(words) - 1)] != words[x.s[tails]]
    last = np.append(x.first[1:], True)
    cl = np.where(x.first[heads], -FAR, np.where(left_word, s - 1, before[heads]))
    cr = np.where(last[tails], FAR, np.where(right_word, e + 1, after[tails]))
    length = (tails - heads + 1).astype(U64)
    name = np.where(length > 1, mix(x.name[heads] + length * U64(0x9E3779B97F4A7C15)), x.name[heads])
    return Symbols(name, s, e, np.minimum(cl, x.cl[heads]), np.maximum(cr, x.cr[tails]), x.first[heads])


def name_pairs(x: Symbols, level: int) -> Symbols:
    """Pairs from the left half of the alphabet to the right half become one symbol."""
    n = len(x)
    if not n:
        return x
    right = (mix(x.name ^ U64(level * 0x5851F42D4C957F2D % 2**64)) >> U64(63)).astype(bool)
    joins = np.zeros(n, bool)
    joins[:-1] = ~right[:-1] & right[1:] & ~x.first[1:]
    joined = np.zeros(n, bool)
    joined[1:] = joins[:-1]
    heads = np.flatnonzero(~joined)
    tails = heads + joins[heads]
    before, after = _neighbours(x)
    pair = tails > heads
    cl = np.where(~pair & right[heads], np.minimum(before[heads], x.cl[heads]), x.cl[heads])
    cr = np.where(~pair & ~right[heads], np.maximum(after[heads], x.cr[heads]), x.cr[tails])
    name = np.where(pair, mix(x.name[heads] * U64(0xD1342543DE82EF95) + x.name[tails] + U64(level)), x.name[heads])
    return Symbols(name, x.s[heads], x.e[tails], cl, cr, x.first[heads])


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least value in each index range [lo, hi); leftmost on ties; ranges are not empty."""
    best, width, out = np.arange(len(values)), 1, np.empty(len(lo), np.int64)
    span = hi - lo
    while True:
        now = (span >= width) & (span < 2 * width)
        a, b = best[lo[now]], best[hi[now] - width]
        out[now] = np.where(values[b] < values[a], b, a)
        if not (span >= 2 * width).any():
            return out
        a, b = best[: len(best) - width], best[width:]
        best = np.where(values[b] < values[a], b, a)
        width *= 2


def _tiers(reached: int, level: int) -> list[tuple[int, int]]:
    """(level, least words of a symbol) in order of preference: a long symbol is rarely shared by chance."""
    order = [(level - k, words) for k, words in enumerate(LONG)] + [(k, 1) for k in range(level, -1, -1)]
    return [(k, words) for k, words in order if 0 <= k <= reached]


def file_windows(words: np.ndarray, row: np.ndarray, starts: np.ndarray, window: int = WINDOW, level: int = LEVEL):
    """For each window start: the name that it is filed under and the position of that symbol."""
    levels = [words_level(words, row)]
    for k in range(1, level + 1):
        x = name_pairs(name_runs(levels[-1], words), k)
        levels.append(x)
        if not ((x.cr - x.cl) <= window).any():
            break
    name, at = np.zeros(len(starts), U64), np.full(len(starts), -1)
    todo = np.arange(len(starts))
    for k, least_words in _tiers(len(levels) - 1, level):
        x = levels[k]
        ok = ((x.cr - x.cl) <= window) & (x.e - x.s >= least_words)
        cl, cr, nm, s = x.cl[ok], x.cr[ok], x.name[ok], x.s[ok]
        lo = np.searchsorted(cl, starts[todo])
        hi = np.searchsorted(cr, starts[todo] + window, "right")
        found = hi > lo
        if found.any():
            pick = _least(nm, lo[found], hi[found])
            name[todo[found]], at[todo[found]] = mix(nm[pick] + U64(k)), s[pick]
        todo = todo[~found]
        if not len(todo):
            break
    return name, at


def window_starts(w: Words, window: int) -> np.ndarray:
    start = np.zeros(len(w.row), bool)
    end_of_row = w.first[1:][w.row] if len(w.row) else w.row
    start[:] = np.arange(len(w.row)) + window <= end_of_row
    return np.flatnonzero(start)


def blocks_of(batch: pa.RecordBatch, window: int, level: int) -> pa.RecordBatch | None:
    w = Words(*text_buffers(batch.column("text")))
    starts = window_starts(w, window)
    if not len(starts):
        return None
    words = w.hashes(0)
    name, at = file_windows(words, w.row, starts, window, level)
    new = np.ones(len(starts), bool)
    new[1:] = (name[1:] != name[:-1]) | (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    s0, count = starts[head], np.diff(np.append(head, len(starts)))
    sums = prefix(words, 1)
    block = mix(between(sums, s0, s0 + count + window - 1, 1) + mix((at[head] - s0).astype(U64)))
    row = w.row[s0]
    return pa.RecordBatch.from_arrays([
        pa.array(signed(name[head])), pa.array(signed(block)),
        batch.column("doc_id").take(pa.array(row)), batch.column("copy").take(pa.array(row)),
        pa.array((s0 - w.first[row]).astype(np.int32)), pa.array(count.astype(np.int32)),
    ], names=["symbol", "block", "doc_id", "copy", "at", "n"])


def windows_of(batch: pa.RecordBatch, window: int) -> pa.RecordBatch | None:
    """Two fingerprints of each window in the blocks that a row was given."""
    w = Words(*text_buffers(batch.column("text")))
    if not len(w.row):
        return None
    spans = batch.column("spans")
    per_row = np.diff(spans.offsets.to_numpy())
    packed = spans.flatten().to_numpy()
    base = np.repeat(w.first[:-1], per_row) + (packed >> 32)
    count = packed & 0xFFFFFFFF
    starts = np.repeat(base - np.cumsum(count) + count, count) + np.arange(count.sum())
    sums = [prefix(w.hashes(k), k + 1) for k in (0, 1)]
    one, two = (between(sums[k], starts, starts + window, k + 1) for k in (0, 1))
    row = w.row[starts]
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([
        pa.array(signed(one)), pa.array(signed(two)), batch.column("doc_id").take(take),
        batch.column("copy").take(take), pa.array((starts - w.first[row]).astype(np.int32)),
    ], names=["one", "two", "doc_id", "copy", "at"])


def covered(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """What is left of each row once the words under its marked windows are gone."""
    data, bounds = text_buffers(batch.column("text"))
    w = Words(data, bounds)
    spans = batch.column("spans")
    filled = spans.fill_null([])
    per_row = np.diff(filled.offsets.to_numpy())
    packed = filled.flatten().to_numpy()
    base = np.repeat(w.first[:-1], per_row) + (packed >> 32)
    step = np.zeros(len(w.row) + 1, np.int64)
    np.add.at(step, base, 1)
    np.add.at(step, base + (packed & 0xFFFFFFFF) + window - 1, -1)
    gone = np.cumsum(step)[: len(w.row)] > 0
    kept_text, shas, removed = [], [], np.zeros(batch.num_rows, np.int64)
    np.add.at(removed, w.row[gone], 1)
    raw = data.tobytes()
    for i in range(batch.num_rows):
        lo, hi = w.first[i], w.first[i + 1]
        words = raw[bounds[i] : bounds[i + 1]].split()
        if removed[i]:
            words = [x for x, g in zip(words, gone[lo:hi], strict=True) if not g]
        joined = b" ".join(words)
        kept_text.append(joined)
        shas.append(hashlib.sha256(joined).hexdigest())
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(removed), pa.array(shas),
        pa.array(kept_text, pa.binary()).cast(pa.string()),
    ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, level: int = LEVEL) -> DataFrame:
    """Blocks of windows that an earlier document holds too: doc_id, copy, at (first word), n (windows)."""
    blocks = stage(map_slices(docs.filter("doc_id IS NOT NULL"), "text", lambda b: blocks_of(b, window, level),
                              "symbol long, block long, doc_id long, copy int, at int, n int"), "blocks")
    # the tables that blocks and windows are joined with are written first: a join of two plain exchanges
    # is one that adaptive execution can split when a symbol is hot
    shared = blocks.groupBy("symbol").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    common = stage(blocks.join(stage(shared.select("symbol"), "shared"), "symbol"), "common")
    one = common.groupBy("symbol", "block").agg(F.min("doc_id").alias("least"))
    kinds = one.groupBy("symbol").agg(F.count("*").alias("kinds"))
    known = stage(one.join(kinds, "symbol").select("symbol", "block", "least", (F.col("kinds") > 1).alias("mixed")), "known")
    met = stage(common.join(known, ["symbol", "block"]).filter("least < doc_id OR mixed")
                .select("doc_id", "copy", "at", "n", (F.col("least") < F.col("doc_id")).alias("whole")), "met")
    pack = F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")
    asked = met.filter("NOT whole").groupBy("doc_id", "copy").agg(F.collect_list(pack).alias("spans"))
    singles = map_slices(likely(docs, asked).join(asked.hint("shuffle_hash"), ["doc_id", "copy"]), "text", lambda b: windows_of(b, window),
                         "one long, two long, doc_id long, copy int, at int")
    singles = stage(singles, "windows")
    firsts = singles.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    firsts = stage(firsts.select("one", "two", "least"), "firsts")
    late = (singles.join(firsts, ["one", "two"]).filter("least < doc_id")
            .select("doc_id", "copy", "at", F.lit(1).alias("n")))
    return met.filter("whole").select("doc_id", "copy", "at", "n").unionByName(late)


def remove_repeats(docs: DataFrame, window: int = WINDOW, level: int = LEVEL) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and kept_text, the words that
    no earlier document's passage of ``window`` words covers, joined by single spaces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("copy", F.hash("text"))
    pack = F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")
    spans = repeated_spans(rows, window, level).groupBy("doc_id", "copy").agg(F.collect_list(pack).alias("spans"))
    spans = stage(spans, "spans")
    touched = likely(rows, spans).join(spans.hint("shuffle_hash"), ["doc_id", "copy"], "left")
    clean = likely(rows, spans, keep=False).withColumn("spans", F.lit(None).cast("array<bigint>"))
    return map_slices(touched.unionByName(clean), "text", lambda b: covered(b, window),
                      "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
