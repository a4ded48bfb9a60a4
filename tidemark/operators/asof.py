"""As-of joins on one clock or on both clocks of a bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.chunks import scan, time_chunk
from tidemark.plans.staging import stage

SPAN = 30 * 86400  # clock span of one scan chunk: at most 43,200 one-minute bars per series


def asof(
    left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
    payload: list[str], out: str = "hit", direction: str = "backward",
    right_order: str | None = None, span: int = SPAN,
) -> DataFrame:
    """Attach to each left row the last right row with ``right_ts <= left_ts`` (equal counts).

    ``direction="forward"`` takes the first right row with ``right_ts >= left_ts``.  The result
    column is a struct of ``payload``, NULL without a match.  Both sides are interleaved and
    scanned in chunks, so nothing is broadcast and no series is sorted in one task.  Both inputs
    are read twice; pass tables or staged frames.
    """
    sign = -1 if direction == "forward" else 1
    seq = F.col(right_order) * sign if right_order else F.lit(0)
    mine = left.select(*keys, (F.col(left_ts) * sign).alias("_ts"), F.lit(1).alias("_side"),
                       F.lit(0).cast("bigint").alias("_seq"), F.struct(*left.columns).alias("_l"))
    theirs = right.filter(F.col(right_ts).isNotNull()).select(
        *keys, (F.col(right_ts) * sign).alias("_ts"), F.lit(0).alias("_side"),
        seq.cast("bigint").alias("_seq"), F.struct(*payload).alias("_r"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    found = scan(both, keys, ["_ts", "_side", "_seq"], time_chunk("_ts", span), {out: ("last", "_r")})
    return found.filter("_side = 1").select("_l.*", out)


def asof_known(
    left: DataFrame, right: DataFrame, values: list[str], out: str = "ref",
    latest: list[str] | None = None, latest_out: str = "latest", span: int = SPAN,
) -> DataFrame:
    """What a bar may read from another timeframe of its symbol.

    A row of the other timeframe is visible when it has closed by my label **and** had been
    emitted when I was emitted.  Both clocks are monotonic in the row number, so the visible row
    is the smaller of the two as-of row numbers, fetched with one equi-join.  ``latest`` columns
    are taken by emission alone (what had been evaluated last).
    """
    keys = ["symbol"]
    keep = ["rn", *(latest or [])]
    first = stage(asof(left, right, keys, "emit_ts", "emit_ts", keep, "_e", right_order="rn", span=span), "asof")
    both = asof(first, right.select("symbol", "rn", "close_ts"), keys, "close_ts", "close_ts", ["rn"], "_c", span=span)
    visible = F.when(F.col("_e").isNotNull() & F.col("_c").isNotNull(), F.least("_e.rn", "_c.rn"))
    looked = right.select("symbol", F.col("rn").alias("_rn"), F.struct(*values).alias(out))
    joined = both.withColumn("_rn", visible).join(looked, ["symbol", "_rn"], "left")
    extra = [F.struct(*[F.col(f"_e.{c}").alias(c) for c in latest]).alias(latest_out)] if latest else []
    return joined.select(*left.columns, out, *extra)


def align_by_close(bars: DataFrame, ref: DataFrame, values: list[str], out: str = "ref") -> DataFrame:
    """Chart overlay: align another timeframe by ``close_ts`` alone."""
    return asof(bars, ref, ["symbol"], "close_ts", "close_ts", values, out)


def bars_by_role(triggers: DataFrame, bars: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Map of role -> ``close_ts`` of the last visible bar of that role's timeframe."""
    df = stage(triggers, "roles")
    cols: dict[str, Column] = {}
    for tf in sorted(set(roles.values())):
        name = f"_tf_{tf}"
        df = stage(asof_known(df, bars.filter(F.col("timeframe") == tf), ["close_ts"], name), "roles")
        cols[tf] = F.col(name)["close_ts"]
    pairs = F.map_from_arrays(
        F.array(*[F.lit(r) for r in roles]), F.array(*[cols[tf] for tf in roles.values()]))
    return df.select(*triggers.columns, F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("role_bars"))
