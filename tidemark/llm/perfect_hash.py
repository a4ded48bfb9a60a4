"""Minimal perfect hashing of a bounded set of 64-bit keys, built by Spark bucket by bucket.

Keys are dealt by hash into buckets of about ``BUCKET_KEYS``.  Inside one, level by level, every key marks a
place in a bit array of ``GAMMA`` times as many places; keys alone on their place are done, the others go on to the
next level.  A key's number is the count of marks before its own, over all buckets, so numbers run from 0 to
n - 1 without gaps, at about 4 bits a key.  Stored keys verify a look-up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textops import U64, mix, signed

BUCKET_KEYS = 1 << 15
GAMMA = 2
_SEEDS = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(U64) ^ _SEEDS[level])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_spread(keys, 255) % U64(buckets)).astype(np.int64)


def place(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of all levels for distinct keys, and the keys in the order of their numbers."""
    marks, done, left = [], [], keys
    while len(left):
        size = GAMMA * len(left)
        at = (_spread(left, len(marks)) % U64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        done.append(left[own][np.argsort(at[own])])
        marks.append(alone)
        left = left[~own]
    return marks, np.concatenate(done) if done else keys


@dataclass(frozen=True)
class PerfectHash:
    """``first``, ``size``: where each bucket's levels (rows) begin in the bits and how long they are (0: no such level)."""

    first: np.ndarray
    size: np.ndarray
    words: np.ndarray
    before: np.ndarray  # marks before each word
    keys: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 for keys outside the set."""
        out = np.full(len(keys), -1)
        todo, bucket = np.arange(len(keys)), bucket_of(keys, len(self.first)) if len(self.keys) else np.zeros(0, np.int64)
        for level in range(self.first.shape[1] if len(self.keys) else 0):
            size = self.size[bucket, level]
            todo, bucket, size = todo[size > 0], bucket[size > 0], size[size > 0]
            if not len(todo):
                break
            at = self.first[bucket, level] + (_spread(keys[todo], level) % size.astype(U64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            number = self.before[at >> 6] + np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
            out[todo[hit]] = number[hit]
            todo, bucket = todo[~hit], bucket[~hit]
        if len(self.keys):
            out[(out < 0) | (self.keys[out] != keys)] = -1
        return out


def assemble(rows: list[tuple[int, bytes, list[int], bytes]], buckets: int) -> PerfectHash:
    """From (bucket, packed bits, level sizes, keys) of every bucket that has keys."""
    rows = sorted(rows)
    levels = max((len(r[2]) for r in rows), default=0)
    first, size = np.zeros((buckets, levels), np.int64), np.zeros((buckets, levels), np.int64)
    bits, total = [], 0
    for b, packed, sizes, _ in rows:
        size[b, : len(sizes)] = sizes
        first[b, : len(sizes)] = total + np.cumsum([0, *sizes[:-1]])
        bits.append(np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(sizes), bitorder="little"))
        total += sum(sizes)
    flat = np.concatenate([*bits, np.zeros(-total % 64 + 64, np.uint8)])
    words = np.packbits(flat, bitorder="little").view(U64)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
    return PerfectHash(first, size, words, before, np.frombuffer(b"".join(r[3] for r in rows), np.int64))


def build(keys: DataFrame, column: str, n: int) -> PerfectHash:
    """Of the ``n`` distinct non-null longs in ``column``; the caller has checked that n is small enough for the driver."""
    buckets = max(-(-n // BUCKET_KEYS), 1)

    def deal(batches):
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bucket_of(k, buckets))], names=["k", "b"])

    def levels(group: pa.Table) -> pa.Table:
        marks, order = place(np.sort(group["k"].to_numpy()))
        packed = np.packbits(np.concatenate(marks), bitorder="little").tobytes()
        return pa.table({"b": group["b"].slice(0, 1), "bits": pa.array([packed], pa.binary()), "sizes": pa.array([[len(m) for m in marks]], pa.list_(pa.int64())), "k": pa.array([signed(order.view(U64)).tobytes()], pa.binary())})
    rows = keys.select(F.col(column).cast("long").alias("k")).mapInArrow(deal, "k long, b long").groupBy("b").applyInArrow(levels, "b long, bits binary, sizes array<long>, k binary").collect()
    return assemble([(r.b, bytes(r.bits), list(r.sizes), bytes(r.k)) for r in rows], buckets)
