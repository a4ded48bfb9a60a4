"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor.

Entries become integers (``floor(64 c) + 1000000``), so n and the sums per dimension are exact; a centred
entry is the exact integer ``n x - S`` divided by n.  Tasks sum outer products of centred vectors; Spark adds the
d * d entries of all tasks.  Only that matrix (8 d**2 bytes, whatever the number of vectors) reaches the driver.
There ``P' V P = L L'`` by Cholesky with diagonal pivoting, and plane rotations from the right make the
columns of L orthogonal, many disjoint pairs at a time: squared column norms are the eigenvalues, normalised
columns (rows put back in order) the components.  The factor is never multiplied out, which keeps small
eigenvalues accurate.

Defined results: vectors that are null, empty, or hold null, non-finite or oversized entries (|c| of 2**40 and
more, whose integers a double can't tell apart) are left out of fit and result; so are vectors of another length
than the most frequent one (the longer of two as frequent).  Repeated rows and rows without an id count each.
Components are numbered from 1 by falling eigenvalue; there are no more than the rank of the scatter, so one
vector, or equal vectors only, give no rows.  A component's largest entry is positive.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**40
BLOCK_VALUES = 1 << 20
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def columns_of(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Blocks of integer vectors (rows) of this length, with their ids; what the module leaves out is gone."""
    rows = max(BLOCK_VALUES // max(length, 1), 1)
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        part = part.filter(pc.fill_null(pc.equal(pc.list_value_length(part.column("v")), length), False))
        if not part.num_rows:
            continue
        c = pc.list_flatten(part.column("v")).to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)
        good = (np.abs(c) < LARGEST).all(axis=1)  # false for nan, which nulls become
        yield np.floor(SCALE * c[good]).astype(np.int64) + SHIFT, part.column("id").filter(pa.array(good))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x minus the mean, from the exact integers n x - S."""
    return exact_deviations(x, n, sums).astype(float) / n


def exact_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    wide = float(n) * float(max(np.abs(x).max(initial=0), 1)) >= 2.0**62
    return x.astype(object) * n - sums.astype(object) if wide else n * x - sums


def squared_length(d: np.ndarray) -> list[int]:
    """Exact sums of squares per row."""
    if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 2.0**62:
        d = d.astype(object)
    return [int(v) for v in (d * d).sum(axis=1)]


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (d x rank) and the order of the pivots: a[order][:, order] = L L'.  Stops where what is left is rounding."""
    a, d = a.copy(), len(a)
    order, low = np.arange(d), np.zeros((d, d))
    least = np.finfo(float).eps * d * max(a.diagonal().max(initial=0), 0)
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if not a[p, p] > least:
            return low[:, :k], order
        for m in (a, low, order):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        low[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, order


def rounds(r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of r columns in rounds of disjoint pairs (a round-robin tournament)."""
    m = r + r % 2
    ring = np.arange(m)
    for _ in range(m - 1):
        p, q = ring[: m // 2], ring[m // 2 :][::-1]
        real = (p < r) & (q < r)
        yield np.minimum(p, q)[real], np.maximum(p, q)[real]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def one_sided_jacobi(low: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``low`` times the rotations that make its columns orthogonal."""
    u, close = low.copy(), 4 * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p, q in rounds(u.shape[1]):
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            act = np.abs(ab) > close * np.sqrt(aa * bb)
            if not act.any():
                continue
            turned = True
            p, q, a, b, aa, bb, ab = p[act], q[act], a[:, act], b[:, act], aa[act], bb[act], ab[act]
            zeta = (bb - aa) / (2 * ab)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            u[:, p], u[:, q] = c * a - c * t * b, c * t * a + c * b
        if not turned:
            break
    return u


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: vectors' length and number, sums, eigenvalues of the covariance (falling), and components as columns."""

    length: int
    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.components / np.sqrt(self.values)


def _plain(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))


def _summed(rows: DataFrame, length: int, products) -> np.ndarray:
    """The sum over all tasks of a matrix that ``products`` makes of a block of integer vectors."""
    def work(batches):
        total = None
        for batch in batches:
            for x, _ in columns_of(batch, length):
                m = products(x)
                total = m if total is None else total + m
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i * len(total) + j), pa.array(total[i, j])], names=["at", "s"])
    sums = rows.mapInArrow(work, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    at, s = sums["at"].to_numpy(), sums["s"].to_numpy()
    d = int(np.sqrt(at.max(initial=-1) + 1) + 0.5)
    out = np.zeros((d, d))
    out[at // max(d, 1), at % max(d, 1)] = s
    return out + np.triu(out, 1).T


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """The transform of all vectors ``rows`` (id, v); None where there are none or all are equal."""
    whole = F.forall("v", lambda c: F.coalesce((F.abs(c) < LARGEST) & ~F.isnan(c), F.lit(False)))
    length = rows.filter(whole).groupBy(F.size("v").alias("k")).count().filter("k > 0").orderBy(F.desc("count"), F.desc("k")).limit(1).collect()
    if not length:
        return None
    length = length[0].k

    def count(batches):
        n, s = 0, np.zeros(length, np.int64)
        for batch in batches:
            for x, _ in columns_of(batch, length):
                n, s = n + len(x), s + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, length)), pa.array(np.concatenate([[n], s]))], names=["at", "s"])
    total = {r.at: int(r.s) for r in rows.mapInArrow(count, "at long, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n, sums = total[-1], np.array([total[i] for i in range(length)], object)
    sums = sums.astype(np.int64) if max(map(abs, sums)) < 2**62 else sums

    def scatter(x):
        z = centred(x, n, sums)
        return z.T @ z
    v = _summed(rows, length, scatter) / n
    low, order = pivoted_cholesky(v)
    u = one_sided_jacobi(low)
    norms = np.sqrt((u * u).sum(axis=0))
    by = np.argsort(-norms, kind="stable")[:components]
    if not len(by):
        return None
    comp = np.zeros((length, len(by)))
    comp[order] = u[:, by] / norms[by]
    comp *= np.sign(comp[np.abs(comp).argmax(axis=0), np.arange(len(by))])
    return Whitening(length, n, sums, norms[by] ** 2, comp, float(np.trace(v)))


def whiten(vectors: DataFrame, components: int = 32, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation (exact), whitened, explained and identity_error."""
    rows, spark = _plain(vectors, id_column, column), vectors.sparkSession
    model = fit(rows, components)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    shipped = spark.sparkContext.broadcast(model)

    def square(x):
        w = shipped.value.project(x)  # the centred entries sum to 0, and so do these
        return w.T @ w
    error = float(np.abs(_summed(rows, model.length, square) / model.n - np.eye(len(model.values))).max())

    def work(batches):
        m, k = shipped.value, len(shipped.value.values)
        step = max(BLOCK_VALUES // 8 // k, 1)
        for batch in batches:
            for block, ids in columns_of(batch, m.length):
                for i in range(0, len(block), step):
                    x = block[i : i + step]
                    own = pa.array(squared_length(exact_deviations(x, m.n, m.sums)), pa.decimal128(38, 0))
                    each = pa.array(np.repeat(np.arange(len(x)), k))
                    columns = [ids.slice(i, len(x)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, m.n)), own.take(each),
                               pa.array(m.project(x).ravel()), pa.array(np.tile(m.values / m.trace, len(x))), pa.array(np.full(len(x) * k, error))]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(work, SCHEMA)
