"""Label signals with what happened after them: stop, target, horizon."""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof
from tidemark.plans.blocks import to_blocks
from tidemark.schema import KEYS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BPS = 1e-4


@dataclass(frozen=True)
class OutcomeParams:
    horizon_bars: int = 20
    stop_pct: float = 0.005
    target_pct: float = 0.01
    cost_bps: float = 0.0
    entry_on_next_open: bool = True
    atr_key: str | None = "atr14"
    stop_atr: float = 1.5
    target_atr: float = 3.0

    def __post_init__(self):
        if self.horizon_bars < 1:
            raise ValueError("horizon_bars must be at least 1")


def sign_of(direction: Column) -> Column:
    return F.when(direction == "short", -1.0).otherwise(1.0)


def atr_from_context(params: OutcomeParams, context: str = "context") -> Column:
    if not params.atr_key:
        return F.lit(None).cast("double")
    return F.try_element_at(F.col(context), F.lit(params.atr_key))


def exit_basis(atr: Column) -> Column:
    return F.when(atr > 0, "atr").otherwise("pct")


def risk_distances(atr: Column, entry: Column, params: OutcomeParams) -> tuple[Column, Column]:
    use = atr > 0
    return (F.when(use, atr * params.stop_atr).otherwise(entry * params.stop_pct),
            F.when(use, atr * params.target_atr).otherwise(entry * params.target_pct))


def locate(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Find each signal's base bar: the last bar of its series with ``close_ts <= fired_at``."""
    found = asof(signals, bars.select(*KEYS, "close_ts", "rn", "next_open", "next_close_ts"),
                 KEYS, "fired_at", "close_ts", ["rn", "next_open", "next_close_ts"], "_b")
    return found.select(*signals.columns, F.col("_b.rn").alias("base_rn"),
                        F.col("_b.next_open").alias("next_open"),
                        F.col("_b.next_close_ts").alias("next_close_ts"))


# ------------------------------------------------------------------ the first bar that crosses a barrier

BLOCK_ROWS = 4096
FIELDS = ["_entry", "_sign", "_usable", "_stop", "_target"]


class Extremes:
    """Lows and highs of a run of bars as a sparse table: minima and maxima of every stretch of 2**k bars."""

    def __init__(self, low: np.ndarray, high: np.ndarray, longest: int):
        self.low, self.high = [low], [high]
        for k in range(max(longest, 1).bit_length() - 1):
            half = 1 << k
            lo, hi = self.low[-1], self.high[-1]
            if len(lo) <= half:
                break
            self.low.append(np.minimum(lo[:-half], lo[half:]))
            self.high.append(np.maximum(hi[:-half], hi[half:]))

    def first(self, start: np.ndarray, end: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
        """First bar of [start, end) whose low reaches ``below`` or whose high reaches ``above``; ``end`` if none does.
        Descent: the longest stretch without a crossing, by falling powers of two."""
        at = start.copy()
        for k in range(len(self.low) - 1, -1, -1):
            fits = at + (1 << k) <= end
            i = np.where(fits, at, 0)
            at = np.where(fits & (self.low[k][i] > below) & (self.high[k][i] < above), at + (1 << k), at)
        return at

    def between(self, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least low and greatest high of [start, last], from two overlapping stretches."""
        k = np.frexp((last - start + 1).astype(float))[1] - 1
        lo, hi = np.empty(len(start)), np.empty(len(start))
        for j in np.unique(k):
            m = k == j
            a, b = start[m], last[m] - (1 << int(j)) + 1
            lo[m], hi[m] = np.minimum(self.low[j][a], self.low[j][b]), np.maximum(self.high[j][a], self.high[j][b])
        return lo, hi


def _sides(entries: DataFrame, bars: DataFrame, params: OutcomeParams, keep: list[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Entries with their barriers, and bars with ``horizon_bars`` rows of look-ahead, under one evenly spread key (series, block)."""
    h = params.horizon_bars
    width = max(block_rows, 2 * h)
    entry = F.col("next_open") if params.entry_on_next_open else F.col("trigger_price")
    e = entries.withColumns({"_entry": entry, "_sign": sign_of(F.col("direction")),
                             "_usable": F.coalesce(F.col("next_close_ts").isNotNull() & (entry > 0), F.lit(False)),
                             "_blk": F.floor(F.coalesce("base_rn", F.lit(0)) / F.lit(width)).cast("bigint")})
    stop_d, target_d = risk_distances(F.col("atr"), F.col("_entry"), params)
    e = e.withColumns({"_stop": F.col("_entry") - F.col("_sign") * stop_d, "_target": F.col("_entry") + F.col("_sign") * target_d})
    # as new columns: entries are often bars themselves, and the two sides of a cogroup must not share a column
    e = e.select(*[F.col(c).alias(c) for c in dict.fromkeys([*KEYS, "_blk", *keep, "base_rn", *FIELDS, "next_close_ts", "atr"])])
    b = to_blocks(bars.select(*KEYS, "rn", "high", "low", "close", "close_ts"), 0, h, width).select(
        *[F.col(c).alias(c) for c in (*KEYS, "_blk", "rn", "high", "low", "close", "close_ts")])
    return e, b


def _numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t[c].to_numpy().astype(float) for c in names]


def _exits(e: pa.Table, b: pa.Table, h: int):
    """Of the usable entries ``own`` of a block: (own, sorted bars, extremes, first bar, end, exit bar, hit, stopped)."""
    b = b.sort_by("rn")
    own = np.flatnonzero(e["_usable"].to_numpy(zero_copy_only=False)) if len(b) else np.zeros(0, np.int64)
    mine = e.take(pa.array(own))
    sign, stop, target = _numbers(mine, "_sign", "_stop", "_target")
    high, low = _numbers(b, "high", "low")
    table = Extremes(low, high, h)
    start = mine["base_rn"].to_numpy().astype(np.int64) + 1 - (b["rn"][0].as_py() if len(b) else 0)
    end = np.minimum(start + h, len(b))
    up = sign > 0
    at = table.first(start, end, np.where(up, stop, target), np.where(up, target, stop))
    hit = at < end
    at = np.where(hit, at, end - 1)
    stopped = hit & np.where(up, low[at] <= stop, high[at] >= stop)
    return own, b, table, start, end, at, hit, stopped


_LABELS = "_x_off bigint, _x_ts bigint, _x_price double, _x_why string, _x_mx double, _x_mn double"


def label(entries: DataFrame, bars: DataFrame, params: OutcomeParams, keep: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Outcome of each located entry (``base_rn``, ``next_open``, ``next_close_ts``, ``atr``,
    ``direction``, ``trigger_price``); ``keep`` columns are carried through.

    No (entry, bar) pair is formed: entries and bars of a block meet once, and every entry descends a table of extremes."""
    e, b = _sides(entries, bars, params, keep, block_rows)
    h, names = params.horizon_bars, e.columns

    def exits(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(names)
        own, bars_, table, start, _, at, hit, stopped = _exits(left, right, h)
        n = left.num_rows
        stop, target, close = *_numbers(left.take(pa.array(own)), "_stop", "_target"), *_numbers(bars_, "close")
        mn, mx = table.between(start, at)
        found = {"_x_off": (at - start + 1, pa.int64()), "_x_ts": (bars_["close_ts"].to_numpy()[at], pa.int64()),
                 "_x_price": (np.where(stopped, stop, np.where(hit, target, close[at])), pa.float64()),
                 "_x_why": (np.where(stopped, "stop", np.where(hit, "target", "horizon")).astype(object), pa.string()), "_x_mx": (mx, pa.float64()), "_x_mn": (mn, pa.float64())}
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        take = pa.array(place, mask=place < 0)
        for c, (v, kind) in found.items():
            left = left.append_column(c, pa.array(v, kind).take(take))
        return left
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in e.schema)
    done = e.groupBy(*KEYS, "_blk").cogroup(b.groupBy(*KEYS, "_blk")).applyInArrow(exits, f"{fields}, {_LABELS}")
    entry, sign, ok, price = F.col("_entry"), F.col("_sign"), F.col("_usable"), F.col("_x_price")
    gross = (price - entry) / entry * sign
    top, bottom = (F.col("_x_mx") - entry) / entry * sign, (F.col("_x_mn") - entry) / entry * sign
    zero = F.lit(0.0)

    def num(col: Column) -> Column:
        return F.when(ok, col).otherwise(zero)

    return done.select(
        *KEYS, *[c for c in keep if c not in KEYS],
        F.when(ok, F.col("next_close_ts")).otherwise(0).cast("bigint").alias("entry_ts"),
        num(entry).alias("entry_price"),
        F.when(ok, F.col("_x_ts")).otherwise(0).cast("bigint").alias("exit_ts"),
        num(price).alias("exit_price"),
        F.when(~ok, "no_data").otherwise(F.col("_x_why")).alias("reason"),
        num(gross - 2.0 * params.cost_bps * BPS).alias("ret"), num(gross).alias("gross_ret"),
        num(F.greatest(zero, top, bottom)).alias("mfe"), num(F.least(zero, top, bottom)).alias("mae"),
        F.when(ok, F.col("_x_off")).otherwise(0).cast("bigint").alias("bars_held"),
        F.when(ok, exit_basis(F.col("atr"))).otherwise("pct").alias("exit_basis"))


def evaluate(signals: DataFrame, bars: DataFrame, params: OutcomeParams | None = None) -> DataFrame:
    """Outcomes of a signal table on an indexed bar table."""
    params = params or OutcomeParams()
    located = locate(signals, bars).withColumn("atr", atr_from_context(params))
    return label(located, bars, params, ["rule_id", "symbol", "timeframe", "direction", "fired_at"])


def ladder_returns(entries: DataFrame, bars: DataFrame, params: OutcomeParams,
                   ladder: list[int], keep: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Returns of the same entries at every holding period of ``ladder``: the barrier is looked up once, at the
    longest one, and each shorter period only moves the time exit."""
    longest = replace(params, horizon_bars=max(ladder))
    e, b = _sides(entries, bars, longest, keep, block_rows)
    e = e.filter("_usable")
    h, names = longest.horizon_bars, e.columns

    def exits(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(names)
        _, bars_, _, start, end, at, hit, stopped = _exits(left, right, h)
        if not len(bars_):
            start = end = at = hit = stopped = np.zeros(0, np.int64)
            left = left.slice(0, 0)
        stop, target, close = *_numbers(left, "_stop", "_target"), *_numbers(bars_, "close")
        barrier = np.where(stopped, stop, target)
        prices = [np.where(hit & (at - start < k), barrier, close[np.minimum(start + k, end) - 1]) for k in ladder]
        flat = pa.array(np.stack(prices, axis=1).ravel() if len(left) else np.zeros(0))
        return left.append_column("_prices", pa.ListArray.from_arrays(pa.array(np.arange(len(left) + 1, dtype=np.int32) * len(ladder)), flat))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in e.schema)
    done = e.groupBy(*KEYS, "_blk").cogroup(b.groupBy(*KEYS, "_blk")).applyInArrow(exits, f"{fields}, _prices array<double>")
    long = done.select("*", F.posexplode("_prices").alias("_k", "_price"))
    periods, entry = F.array(*[F.lit(k).cast("bigint") for k in ladder]), F.col("_entry")
    return long.select(
        *KEYS, *[c for c in keep if c not in KEYS], F.get(periods, F.col("_k")).alias("bars"),
        ((F.col("_price") - entry) / entry * F.col("_sign") - 2.0 * params.cost_bps * BPS).alias("ret"))


__all__ = ["OutcomeParams", "atr_from_context", "evaluate", "exit_basis", "label", "ladder_returns",
           "locate", "risk_distances", "sign_of"]
