"""Text quality by kernel ridge regression on document statistics, calibrated.

Seventeen statistics of the whole text (lengths, character classes, repetition, lines) are
standardised and mapped by random Fourier features, ``sqrt(2/D) cos(Wx + b)``, whose inner products
approximate a Gaussian kernel.  Each task adds up the normal equations of its labelled rows; Spark sums
the parts by matrix entry, so the driver gets one matrix of fixed size whatever the number of rows.
The ridge scores of the labelled rows, counted in fixed bins, are made monotone by pooling adjacent
violators; the calibrated score interpolates between the pools.

Labels come only from rows outside the held-out fold, crc32(doc_id as text) mod 3 = 1.

Defined results: null text counts as empty and is scored like any text; a null doc_id is not held out and
has no label; several labels of a doc_id are averaged; null labels are ignored; without any label every
score is 0.5; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textops import map_slices
from tidemark.llm.textstats import TextStats, byte_set, per_row
from tidemark.plans.staging import stage

WIDTH = 256
GAMMA = 0.05
RIDGE = 1.0
BINS = 2000
FEATURES = 17


def statistics(column: pa.Array) -> np.ndarray:
    """(rows x FEATURES) statistics of whole texts."""
    s = TextStats(column)
    data, bounds, w = s.data, s.bounds, s.words
    chars, words = np.maximum(s.n_chars, 1), np.maximum(s.n_words, 1)
    share = lambda chars_: per_row(byte_set(chars_)[data], bounds) / chars
    mean = s.word_chars / words
    square = s._sum(s.lengths * s.lengths) / words
    capital = byte_set(bytes(range(65, 91)))
    opening = s._sum(capital[data[w.start]])
    last = data[w.end - 1] if len(w.end) else data[:0]
    return np.column_stack([
        np.log1p(s.n_words), np.minimum(mean, 40), np.minimum(np.sqrt(np.maximum(square - mean * mean, 0)), 40),
        s.n_symbols / chars, share(bytes(range(65, 91))), share(b"0123456789"), share(b".,;:?'\"()-"), share(b"!"), share(b"|"),
        share(b" \t\n\r\x0b\x0c"), per_row(data >= 128, bounds) / chars, s.n_distinct_words / words, s.n_repeat_words / words,
        s.n_dup_lines / np.maximum(s.n_lines, 1), np.log1p(words / np.maximum(s.n_lines, 1)), opening / words,
        s._sum(byte_set(b".?!")[last]) / words,
    ]).astype(float)


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    x = statistics(batch.column("text"))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.reshape(-1)))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.turn + self.phase)
        return np.column_stack([f, np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.map(x) @ self.weight, self.knots, self.levels), 0, 1)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _equations(model: Model):
    """Upper triangle of F'F and F'y of a task's rows, as (entry, value) rows."""
    size = WIDTH + 1

    def run(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            f = model.map(_matrix(batch.column("x")))
            total[:, :size] += f.T @ f
            total[:, size] += f.T @ batch.column("y").to_numpy()
        at = np.flatnonzero(np.triu(np.ones((size, size + 1)), 0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["entry", "value"])
    return run


def _solve(rows) -> np.ndarray:
    size = WIDTH + 1
    m = np.zeros(size * (size + 1))
    for r in rows:
        m[r.entry] = r.value
    m = m.reshape(size, size + 1)
    a, b = np.triu(m[:, :size]), m[:, size]
    a = a + np.triu(a, 1).T + RIDGE * np.diag(np.append(np.ones(WIDTH), 1e-6))
    return np.linalg.solve(a, b)


def pooled(position: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling adjacent violators: pool centres and means, both ascending."""
    pools: list[list[float]] = []
    for p, n, t in zip(position, weight, total, strict=True):
        pools.append([p * n, n, t])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def fold(doc_id="doc_id"):
    """The held-out flag: crc32 of the id's decimal text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _labels(labels: DataFrame) -> DataFrame:
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"))
            .filter("doc_id IS NOT NULL AND q IS NOT NULL").groupBy("doc_id").agg(F.avg("q").alias("y")))


def fit(features: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """Fit on the labelled rows of ``features`` (doc_id, x) outside the held-out fold."""
    marked = stage(features.filter(~fold()).join(_labels(labels), "doc_id").select("x", "y"), "marked")
    moments = features.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(FEATURES) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(FEATURES)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(FEATURES)])
    rng = np.random.default_rng(seed)
    none = np.zeros(0)
    model = Model(mean, scale, rng.normal(0, np.sqrt(2 * GAMMA), (FEATURES, WIDTH)), rng.uniform(0, 2 * np.pi, WIDTH), np.zeros(WIDTH + 1), none, none)
    parts = marked.mapInArrow(_equations(model), "entry long, value double")
    model = Model(**{**model.__dict__, "weight": _solve(parts.groupBy("entry").agg(F.sum("value").alias("value")).collect())})

    def binned(batches):
        for batch in batches:
            s = model.map(_matrix(batch.column("x"))) @ model.weight
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((s + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)), batch.column("y")], names=["bin", "y"])
    bins = sorted(marked.mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("t")).collect())
    if not bins:
        return model
    b, n, t = (np.array(c, float) for c in zip(*bins, strict=True))
    knots, levels = pooled((b + 0.5) / BINS * 2 - 0.5, n, t)
    return Model(**{**model.__dict__, "knots": np.concatenate([[-0.6], knots, [1.6]]), "levels": np.concatenate([[levels[0] / 2], levels, [(1 + levels[-1]) / 2]])})


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """The statistics of ``docs`` (doc_id, x), and the model fitted on those with a label."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    features = stage(map_slices(texts, "text", _features, "doc_id long, x array<double>"), "features")
    return features, fit(features, labels)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (score >= 0.5)."""
    features, model = fitted(docs, labels)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], names=["doc_id", "score"])
    return features.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that the classifier rejects; no text crosses an exchange."""
    _, model = fitted(docs, labels)
    return map_slices(docs, "text", lambda b: b.filter(pa.array(model.score(statistics(b.column("text"))) >= 0.5)), docs.schema)
