"""Fills, trades and position sizes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timekeys import market_of, utc_date, day_text
from tidemark.operators.outcomes import OutcomeParams, atr_from_context, risk_distances, sign_of


def with_notional(fills: DataFrame, symbols: DataFrame) -> DataFrame:
    """Entry price x quantity x multiplier; unknown when the symbol is not registered.  A zero
    multiplier in the dimension counts as one."""
    joined = fills.join(symbols.select(F.col("uid").alias("symbol"), "multiplier"), "symbol", "left")
    mult = F.when(F.coalesce("multiplier", F.lit(0.0)) == 0, F.when(F.col("multiplier").isNotNull(), 1.0)).otherwise(F.col("multiplier"))
    value = F.col("price") * F.col("qty") * mult
    return joined.withColumn("notional", F.when((F.col("kind") == "entry") & (value > 0), value)).drop("multiplier")


def pair_trades(fills: DataFrame) -> DataFrame:
    """One trade per signal: its first entry with its first exit at or after it.

    Open trades have no exit columns; exits without an entry are dropped.  Both steps are partially
    aggregated arg-mins, and the entry side of the join has one row per signal, so a signal with
    very many fills is split by the skew join and never gathered."""
    fill = F.struct("ts", "price", "side", "kind", "realized")
    entries = (
        fills.filter("kind = 'entry'").groupBy("signal_key", "symbol")
        .agg(F.min_by(F.struct("ts", "price", "side", "notional"), F.struct("ts", "price")).alias("e")))
    exits = fills.filter("kind <> 'entry'").join(
        entries.select("signal_key", "symbol", F.col("e.ts").alias("_from")), ["signal_key", "symbol"])
    first = exits.filter("ts >= _from").groupBy("signal_key", "symbol").agg(
        F.min_by(fill, F.struct("ts", "price")).alias("o"))
    g = entries.join(first, ["signal_key", "symbol"], "left")
    base = F.col("e.notional")
    return g.select(
        "signal_key", "symbol", F.col("e.side").alias("side"), F.col("e.ts").alias("entry_ts"),
        F.col("e.price").alias("entry_price"), F.col("o.ts").alias("exit_ts"), F.col("o.price").alias("exit_price"),
        F.col("o.kind").alias("exit_kind"), F.col("o").isNull().alias("open"), F.col("o.realized").alias("realized"),
        F.when(base > 0, F.col("o.realized") / base * 100.0).alias("pnl_pct"))


def fill_stats(fills: DataFrame) -> DataFrame:
    exit_, r = F.col("kind") != "entry", F.col("realized")
    return fills.agg(
        F.count_if(~exit_).alias("entries"), F.count_if(exit_).alias("exits"),
        F.count_if(exit_ & (r > 0)).alias("wins"), F.count_if(exit_ & (r < 0)).alias("losses"),
        F.avg(F.when(exit_ & (r > 0), r)).alias("avg_win"), F.sum("fee").alias("fees"),
        F.sum(F.when(exit_, r)).alias("realized"))


def exits_by_kind(fills: DataFrame) -> DataFrame:
    return fills.filter("kind <> 'entry'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def realized_by_day(fills: DataFrame) -> DataFrame:
    return fills.groupBy(day_text(utc_date("ts")).alias("day")).agg(
        F.sum("realized").alias("realized"), F.sum("fee").alias("fees"))


@dataclass(frozen=True)
class SizingParams:
    mode: str = "risk"  # risk | fixed | notional
    risk_per_trade: float = 0.005
    fixed_qty: float = 1.0
    notional_per_trade: float = 10_000.0
    default_lot: float = 0.0
    max_notional: float = 0.0
    max_risk: float = 0.0
    exits: OutcomeParams = field(default_factory=OutcomeParams)

    def __post_init__(self):
        if self.mode not in ("risk", "fixed", "notional"):
            raise ValueError(f"unknown sizing mode {self.mode!r}")
        if not 0 < self.risk_per_trade <= 0.5:
            raise ValueError("risk_per_trade must be in (0, 0.5]")
        if self.fixed_qty <= 0 or self.notional_per_trade <= 0:
            raise ValueError("fixed_qty and notional_per_trade must be positive")


def round_lot(qty: Column, lot: Column) -> Column:
    """Down to whole lots, so that risk never exceeds its budget."""
    return F.when(lot > 0, F.floor(qty / lot + 1e-9) * lot).otherwise(qty)


def size_positions(signals: DataFrame, equity: float | Column, p: SizingParams | None = None) -> DataFrame:
    """Order size, stop and target of each signal (columns ``multiplier`` and ``context`` given);
    neutral signals and sizes below one lot give no row."""
    p = p or SizingParams()
    equity = equity if isinstance(equity, Column) else F.lit(float(equity))
    price = F.col("trigger_price")
    df = signals.filter((F.col("direction") != "neutral") & (price > 0) & (equity > 0))
    stop_d, target_d = risk_distances(F.col("_atr"), price, p.exits)
    mult = F.when(F.coalesce("multiplier", F.lit(0.0)) == 0, 1.0).otherwise(F.col("multiplier"))
    df = df.withColumn("_atr", atr_from_context(p.exits)).withColumns({"_mult": mult, "_stop": stop_d, "_target": target_d})
    m, s = F.col("_mult"), F.col("_stop")
    raw = {
        "risk": F.coalesce(F.try_divide(equity * p.risk_per_trade, F.when(s * m > 0, s * m)), F.lit(0.0)),
        "fixed": F.lit(p.fixed_qty), "notional": F.lit(p.notional_per_trade) / (price * m),
    }[p.mode]
    capped = F.lit("")
    if p.max_notional > 0:
        cap = F.lit(p.max_notional) / (price * m)
        capped, raw = F.when(cap < raw, "notional").otherwise(capped), F.least(raw, cap)
    if p.max_risk > 0:
        cap = F.when(s > 0, F.lit(p.max_risk) / (s * m))
        capped, raw = F.when(cap < raw, "risk").otherwise(capped), F.least(raw, cap)  # least skips a NULL cap
    lot = F.lit(p.default_lot) if p.default_lot > 0 else F.when(market_of() == "CN", 1.0).otherwise(m)
    sign = sign_of(F.col("direction"))
    out = df.withColumns({"qty": round_lot(raw, lot), "capped_by": capped})
    return out.filter("qty > 0").select(
        F.col("dedup_key").alias("signal_key"), "rule_id", "symbol",
        F.when(F.col("direction") == "short", "sell").otherwise("buy").alias("side"), "qty",
        F.col("fired_at").alias("created_at"), price.alias("ref_price"), F.col("_mult").alias("multiplier"),
        (price - sign * s).alias("stop"), (price + sign * F.col("_target")).alias("target"), "capped_by", "timeframe")
