"""Prefix scans over ordered series without a single-task sort.

A window such as ``sum(x) OVER (PARTITION BY symbol ORDER BY t)`` sends a whole symbol to one
task.  Here every series is cut into chunks of bounded length; the window runs per
(series, chunk), one small aggregate gives the totals of each chunk, and a window over that
totals table (rows / chunk length) gives what each chunk inherits.  The join back is on
(series, chunk), the same keys as the local window, so it adds no shuffle of the large side.

The input is read twice: pass a table or a staged frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 16384
_CHUNK = "_chunk"


def rn_chunk(rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a row-numbered series."""
    return F.floor((F.col("rn") - 1) / F.lit(rows)).cast("bigint")


def time_chunk(ts: str | Column, span: int | Column) -> Column:
    """Chunk number by clock: rows of one series per chunk are bounded by span / bar length."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    span = span if isinstance(span, Column) else F.lit(span)
    return F.floor(ts / span).cast("bigint")


def scan(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column,
    specs: dict[str, tuple[str, Column | str]], exclusive: bool = False,
) -> DataFrame:
    """Add one column per spec ``name -> (op, value)``.

    ``sum``, ``count``, ``max``, ``min`` and ``last`` (last non-NULL) cover the rows up to and
    including the current one, or up to the one before with ``exclusive``; ``lag`` and ``lead``
    read the neighbouring row; ``overall`` is the maximum of the whole series.  ``order`` must be ascending and unique within a series for a
    deterministic result.
    """
    part = [*keys, _CHUNK]
    values = {f"_v_{name}": F.col(v) if isinstance(v, str) else v for name, (_, v) in specs.items()}
    base = df.withColumn(_CHUNK, chunk).withColumns(values)

    ordered = Window.partitionBy(*part).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    # plain columns keep the totals in a hash aggregate; only a composite order needs a struct
    pos = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(o) for o in order])
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)

    local, totals, carried, out = {}, [], [], {}
    for name, (op, _) in specs.items():
        v, t, c, here = F.col(f"_v_{name}"), f"_t_{name}", f"_c_{name}", f"_l_{name}"
        mine, inherited = F.col(here), F.col(c)
        if op in ("sum", "count"):
            agg = F.sum if op == "sum" else F.count
            local[here] = agg(v).over(upto)
            totals.append(agg(v).alias(t))
            carried.append(F.sum(t).over(before).alias(c))
            out[name] = F.coalesce(mine, F.lit(0)) + F.coalesce(inherited, F.lit(0))
        elif op in ("max", "min"):
            agg = F.max if op == "max" else F.min
            local[here] = agg(v).over(upto)
            totals.append(agg(v).alias(t))
            carried.append(agg(t).over(before).alias(c))
            out[name] = F.greatest(mine, inherited) if op == "max" else F.least(mine, inherited)
        elif op == "last":
            local[here] = F.last(v, ignorenulls=True).over(upto)
            totals.append(F.max_by(v, F.when(v.isNotNull(), pos)).alias(t))
            carried.append(F.last(t, ignorenulls=True).over(before).alias(c))
            out[name] = F.coalesce(mine, inherited)
        elif op in ("lag", "lead"):
            # a neighbour that holds NULL is not the same as no neighbour in this chunk
            shift, edge = (F.lag, F.max_by) if op == "lag" else (F.lead, F.min_by)
            local[here] = shift(v).over(ordered)
            local[f"_has_{op}"] = shift(F.lit(1)).over(ordered)
            totals.append(edge(v, pos).alias(t))
            carried.append(shift(t).over(across).alias(c))
            out[name] = F.when(F.col(f"_has_{op}").isNull(), inherited).otherwise(mine)
        elif op == "overall":
            totals.append(F.max(v).alias(t))
            carried.append(F.max(t).over(Window.partitionBy(*keys)).alias(c))
            out[name] = inherited
        else:
            raise ValueError(op)

    carry = base.groupBy(*part).agg(*totals).select(*part, *carried)
    joined = base.withColumns(local).join(carry, part)
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[col.alias(name) for name, col in out.items()])
