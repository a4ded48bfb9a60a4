"""First-order linear recurrences ``y = q*y_prev + a*x`` as a parallel scan.

EMA, Wilder averages, RSI, MACD, ATR and KDJ are all of this form.  A seed that is the mean of
the first n samples is the same recurrence with those samples entered at weight
``q**(rn - seed_rn) / n`` (at most e**2 / n, so no overflow).  The series is cut into runs of
``RUN`` rows: inside a run a windowed sum gives the local value, one aggregate per run gives its
contribution to the next, and those contributions are folded in arrays of at most ``FAN`` runs.
No task ever holds a series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = 256
FAN = 1024


@dataclass(frozen=True)
class Recurrence:
    """``x`` is first defined at row ``start``; the seed is the mean of ``n`` samples, or the
    constant ``seed`` one row before ``start`` when that is given."""

    x: Column
    n: int
    q: float
    a: float
    start: int = 1
    seed: float | None = None

    @property
    def first(self) -> int:
        return self.start if self.seed is not None else self.start + self.n - 1

    def entry(self) -> Column:
        rn, x = F.col("rn"), self.x
        if self.seed is not None:
            steady = x * self.a
            return (F.when(rn < self.start, 0.0)
                    .when(rn == self.start, steady + self.q * self.seed).otherwise(steady))
        if self.n == 1:
            return F.when(rn < self.start, 0.0).otherwise(x)
        warm = x / self.n * F.pow(F.lit(self.q), rn - self.first)
        return F.when(rn < self.start, 0.0).when(rn <= self.first, warm).otherwise(x * self.a)


def ema(x: Column, n: int, start: int = 1) -> Recurrence:
    return Recurrence(x, n, (n - 1) / (n + 1), 2 / (n + 1), start)


def wilder(x: Column, n: int, start: int = 1) -> Recurrence:
    return Recurrence(x, n, (n - 1) / n, 1 / n, start)


def smooth(x: Column, m: int, start: int, seed: float) -> Recurrence:
    return Recurrence(x, 1, (m - 1) / m, 1 / m, start, seed)


def linear_scan(
    df: DataFrame, keys: list[str], specs: dict[str, Recurrence], run: int = RUN, fan: int = FAN,
) -> DataFrame:
    """Add one column per recurrence, NULL before its first defined row."""
    names = list(specs)
    q = {k: s.q for k, s in specs.items()}
    base = df.withColumns({
        "_run": F.floor((F.col("rn") - 1) / F.lit(run)).cast("bigint"),
        "_j": ((F.col("rn") - 1) % F.lit(run)).cast("int"),
        **{f"_z_{k}": s.entry() for k, s in specs.items()},
    })

    def power(k: str, e: Column) -> Column:
        return F.lit(1.0) if q[k] == 1.0 else (F.when(e == 0, 1.0).otherwise(0.0) if q[k] == 0.0
                                               else F.pow(F.lit(q[k]), e))

    # 1. what each run adds to the value at its end, had it started from zero
    ends = base.groupBy(*keys, "_run").agg(
        *[F.sum(F.col(f"_z_{k}") * power(k, run - 1 - F.col("_j"))).alias(k) for k in names])

    # 2. fold the run ends, first inside groups of FAN runs, then over the groups
    def fold(values: Column, decay: float) -> Column:
        return F.aggregate(
            values, F.array(F.lit(0.0)),
            lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) * F.lit(decay) + v)))

    def running(table: DataFrame, by: list[str], pos: str, decay: dict[str, float]) -> DataFrame:
        """Value carried into each row of ``table`` (``_i`` counts from 0 inside ``by``)."""
        rows = table.groupBy(*by).agg(
            F.array_sort(F.collect_list(F.struct(pos, *names))).alias("_rows"))
        zipped = F.arrays_zip(
            F.col("_rows").getField(pos).alias("p"),
            *[fold(F.col("_rows").getField(k), decay[k]).alias(k) for k in names])
        return (rows.select(*by, F.posexplode(zipped).alias("_i", "_r"))
                .select(*by, "_i", F.col("_r.p").alias(pos),
                        *[F.col(f"_r.{k}").alias(f"_c_{k}") for k in names]))

    per_run = {k: q[k] ** run for k in names}
    per_group = {k: q[k] ** (run * fan) for k in names}
    grouped = ends.withColumn("_grp", F.floor(F.col("_run") / F.lit(fan)).cast("bigint"))
    inner = running(grouped, [*keys, "_grp"], "_run", per_run)
    # the entry past the last run of a group (NULL position) is the group's own end value
    group_ends = inner.filter(F.col("_run").isNull()).select(
        *keys, "_grp", *[F.col(f"_c_{k}").alias(k) for k in names])
    outer = running(group_ends, keys, "_grp", per_group).filter(F.col("_grp").isNotNull()).select(
        *keys, "_grp", *[F.col(f"_c_{k}").alias(f"_g_{k}") for k in names])
    carry = (
        inner.filter(F.col("_run").isNotNull()).join(outer, [*keys, "_grp"])
        .select(*keys, "_run", *[
            (F.col(f"_c_{k}") + F.pow(F.lit(per_run[k]), F.col("_i")) * F.col(f"_g_{k}")).alias(f"_c_{k}")
            for k in names])
    )

    # 3. inside a run: local value plus the decayed carry
    w = (Window.partitionBy(*keys, "_run").orderBy("rn")
         .rowsBetween(Window.unboundedPreceding, 0))
    j = F.col("_j")
    local = {}
    for k in names:
        z = F.col(f"_z_{k}")
        local[f"_l_{k}"] = z if q[k] == 0.0 else F.sum(z * F.pow(F.lit(q[k]), -j)).over(w) * power(k, j)
    joined = base.withColumns(local).join(carry, [*keys, "_run"])
    return joined.select(
        *[c for c in df.columns if c not in specs],
        *[F.when(F.col("rn") >= specs[k].first,
                 F.col(f"_l_{k}") + F.col(f"_c_{k}") * power(k, j + 1)).alias(k) for k in names])
