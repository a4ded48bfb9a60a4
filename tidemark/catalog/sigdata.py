"""Signals, outcomes and fills derived from the event bars, in Spark and as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.data import once, series
from tidemark.catalog.q_indicators import ATR
from tidemark.operators.outcomes import OutcomeParams, evaluate
from tidemark.operators.rules import Condition, Emit, Rule, book, run_trial, single_condition_signals
from tidemark.plans.staging import stage

ATR14 = {"atr14": lambda f: f.atr(14)}


def single_rules() -> list[Rule]:
    """Three one-condition rules: long breakouts, short breakouts, neutral inside bars."""
    return [
        Rule("bo20_long", (Condition("trig", "1h", lambda f: f.breakout(f.range(20), "up")),),
             Emit("long", priority="high"), context=ATR14),
        Rule("bo5_short", (Condition("trig", "1h", lambda f: f.breakout(f.range(5), "down")),),
             Emit("short"), context=ATR14),
        Rule("inside_flat", (Condition("trig", "1h", lambda f: f.inside_bar()),),
             Emit("neutral", priority="low"), context=ATR14),
    ]


def signals(spark, sf) -> DataFrame:
    def make():
        rules = single_rules()
        booked = book(series(spark, sf), rules)
        parts = []
        for r in rules:
            key = F.concat_ws(":", "symbol", F.lit(r.id), F.col("close_ts").cast("string"))
            parts.append(single_condition_signals(booked, r, key))
        return stage(reduce(DataFrame.unionByName, parts), "signals")
    return once(spark, ("signals", sf), make)


PARAMS = OutcomeParams(cost_bps=2.0)


def outcomes(spark, sf) -> DataFrame:
    return once(spark, ("outcomes", sf), lambda: stage(evaluate(signals(spark, sf), series(spark, sf), PARAMS), "outcomes"))


def demo_rule() -> Rule:
    return Rule(
        "demo",
        (Condition("trend", "4h", lambda f: f["close"] > f.ema("close", 20)),
         Condition("setup", "4h", lambda f: f.rsi(14) < 50, "window", 3),
         Condition("trig", "1h", lambda f: f.breakout(f.range(5), "up"), "event")),
        Emit("long", ttl_bars=6, cooldown_s=7200, priority="high", dedup_key="{symbol}:{rule}:{trend_bar_close_ts}"),
        context=ATR14, context_by_role={"trend": {"ema20": lambda f: f.ema("close", 20)}})


def demo_trial(spark, sf):
    return once(spark, ("demo", sf), lambda: run_trial(demo_rule(), series(spark, sf)))


def fills(spark, sf) -> DataFrame:
    """Entry and exit fills of the directional outcomes; some trades stay open, and some exits
    have lost their entry."""
    def make():
        o = outcomes(spark, sf).filter("reason <> 'no_data' AND direction <> 'neutral'")
        key = F.concat_ws(":", "symbol", "rule_id", F.col("fired_at").cast("string"))
        hour = F.floor(F.col("fired_at") / 3600)
        side = F.when(F.col("direction") == "long", "buy").otherwise("sell")
        back = F.when(F.col("direction") == "long", "sell").otherwise("buy")
        base = o.select(key.alias("signal_key"), "symbol", hour.alias("h"), side.alias("s"), back.alias("b"), "entry_price",
                        "entry_ts", "exit_price", "exit_ts", "reason", "gross_ret")
        qty, fee = F.lit(2.0), 0.001
        e = base.filter("h % 11 <> 0").select(
            "signal_key", "symbol", F.col("s").alias("side"), qty.alias("qty"), F.col("entry_price").alias("price"),
            F.col("entry_ts").alias("ts"), F.lit("entry").alias("kind"), (F.col("entry_price") * fee).alias("fee"), F.lit(0.0).alias("realized"))
        x = base.filter("h % 7 <> 0").select(
            "signal_key", "symbol", F.col("b").alias("side"), qty.alias("qty"), F.col("exit_price").alias("price"),
            F.col("exit_ts").alias("ts"), F.col("reason").alias("kind"), (F.col("exit_price") * fee).alias("fee"),
            (F.col("gross_ret") * F.col("entry_price") * 2.0 - F.col("exit_price") * fee).alias("realized"))
        return stage(e.unionByName(x), "fills")
    return once(spark, ("fills", sf), make)


# ------------------------------------------------------------------ SQL twins

SIG = f"""{ATR},
rr AS (SELECT s.*, CASE WHEN rn > 20 THEN max(high) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS rh,
  CASE WHEN rn > 5 THEN min(low) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS rl,
  lag(high) OVER (PARTITION BY symbol ORDER BY rn) AS ph, lag(low) OVER (PARTITION BY symbol ORDER BY rn) AS pl FROM s),
sg AS (SELECT 'bo20_long' AS rule_id, 'long' AS direction, 'high' AS priority, symbol, rn FROM rr WHERE close > rh
  UNION ALL SELECT 'bo5_short', 'short', 'normal', symbol, rn FROM rr WHERE close < rl
  UNION ALL SELECT 'inside_flat', 'neutral', 'low', symbol, rn FROM rr WHERE high <= ph AND low >= pl),
sig AS MATERIALIZED (SELECT rule_id, symbol, direction, '1h' AS timeframe, s.close_ts AS fired_at, s.close AS trigger_price,
  symbol || ':' || rule_id || ':' || s.close_ts AS dedup_key, atr.y AS atr14, s.volume AS volume, priority, rn AS base_rn, next_open, next_close_ts
  FROM sg JOIN s USING (symbol, rn) LEFT JOIN atr USING (symbol, rn))"""


def outcome_cte(src: str, name: str, h: int, cost: float, stop_pct=0.005, target_pct=0.01, stop_atr=1.5, target_atr=3.0, bars: str = "s") -> str:
    """CTEs that label ``src`` (base_rn, next_open, next_close_ts, atr14, direction) as ``name``."""
    p = name
    return f"""{p}_e AS (SELECT *, row_number() OVER () AS eid, next_open AS entry, CASE WHEN direction = 'short' THEN -1.0 ELSE 1.0 END::DOUBLE AS sgn,
  coalesce(next_close_ts IS NOT NULL AND next_open > 0, FALSE) AS ok FROM {src}),
{p}_l AS MATERIALIZED (SELECT *, entry - sgn * CASE WHEN atr14 > 0 THEN atr14 * {stop_atr} ELSE entry * {stop_pct} END AS stop,
  entry + sgn * CASE WHEN atr14 > 0 THEN atr14 * {target_atr} ELSE entry * {target_pct} END AS target FROM {p}_e),
{p}_f AS (SELECT e.eid, b.rn - e.base_rn AS off, b.close_ts AS ts, b.close AS c, b.high AS hi, b.low AS lo,
  CASE WHEN CASE WHEN sgn > 0 THEN b.low <= stop ELSE b.high >= stop END THEN 'stop' WHEN CASE WHEN sgn > 0 THEN b.high >= target ELSE b.low <= target END THEN 'target' END AS why
  FROM {p}_l e JOIN {bars} b ON b.symbol = e.symbol AND b.rn BETWEEN e.base_rn + 1 AND e.base_rn + {h} WHERE e.ok),
{p}_x AS (SELECT eid, coalesce(min(off) FILTER (why IS NOT NULL), max(off)) AS x FROM {p}_f GROUP BY eid),
{p}_m AS (SELECT f.eid, max(hi) AS mx, min(lo) AS mn, arg_max(ts, off) AS exit_ts, arg_max(c, off) AS c, max(why) FILTER (off = x) AS why, any_value(x) AS x
  FROM {p}_f f JOIN {p}_x USING (eid) WHERE off <= x GROUP BY f.eid),
{name} AS MATERIALIZED (SELECT rule_id, symbol, timeframe, direction, fired_at, CASE WHEN ok THEN next_close_ts ELSE 0 END AS entry_ts, CASE WHEN ok THEN entry ELSE 0 END AS entry_price,
  CASE WHEN ok THEN exit_ts ELSE 0 END AS exit_ts, CASE WHEN ok THEN px ELSE 0 END AS exit_price, CASE WHEN ok THEN coalesce(why, 'horizon') ELSE 'no_data' END AS reason,
  CASE WHEN ok THEN (px - entry) / entry * sgn - 2 * {cost} * 1e-4 ELSE 0 END AS ret, CASE WHEN ok THEN (px - entry) / entry * sgn ELSE 0 END AS gross_ret,
  CASE WHEN ok THEN greatest(0, (mx - entry) / entry * sgn, (mn - entry) / entry * sgn) ELSE 0 END AS mfe,
  CASE WHEN ok THEN least(0, (mx - entry) / entry * sgn, (mn - entry) / entry * sgn) ELSE 0 END AS mae,
  CASE WHEN ok THEN x ELSE 0 END AS bars_held, CASE WHEN ok AND atr14 > 0 THEN 'atr' ELSE 'pct' END AS exit_basis
  FROM (SELECT l.*, m.*, CASE why WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE c END AS px FROM {p}_l l LEFT JOIN {p}_m m ON m.eid = l.eid))"""


OUT = f"{SIG}, {outcome_cte('sig', 'o', 20, 2.0)}"

FILLS = f"""{OUT}, fb AS (SELECT symbol || ':' || rule_id || ':' || fired_at AS signal_key, symbol, fired_at // 3600 AS h, direction, entry_price, entry_ts, exit_price, exit_ts, reason, gross_ret
  FROM o WHERE reason <> 'no_data' AND direction <> 'neutral'),
fills AS MATERIALIZED (SELECT signal_key, symbol, CASE direction WHEN 'long' THEN 'buy' ELSE 'sell' END AS side, 2.0::DOUBLE AS qty, entry_price AS price, entry_ts AS ts, 'entry' AS kind, entry_price * 0.001::DOUBLE AS fee, 0.0::DOUBLE AS realized FROM fb WHERE h % 11 <> 0
  UNION ALL SELECT signal_key, symbol, CASE direction WHEN 'long' THEN 'sell' ELSE 'buy' END, 2.0, exit_price, exit_ts, reason, exit_price * 0.001::DOUBLE, gross_ret * entry_price * 2.0::DOUBLE - exit_price * 0.001::DOUBLE FROM fb WHERE h % 7 <> 0)"""
