"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query rebuilds what it measures from the Parquet tables or from the staged bar table named in
its group; results are fully materialised through the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import functions as F

    from tidemark.catalog import data as D
    from tidemark.catalog import sigdata as S
    from tidemark.operators import baseline as B
    from tidemark.operators import quality as Q
    from tidemark.operators import rules as R
    from tidemark.operators.asof import asof_known
    from tidemark.operators.bars import aggregate, bar_series
    from tidemark.operators.frame import Frame
    from tidemark.operators.outcomes import OutcomeParams, evaluate
    from tidemark.operators.shipped import stock_rules
    from tidemark.plans.staging import drop_staged, stage
    from tidemark.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    kept: dict[str, object] = {}

    def timed(name, fn):
        start = time.time()
        out = fn()
        if hasattr(out, "write"):
            out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        kept[name] = out
        return out

    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()  # start the executor threads

    # bars
    m1 = timed("ticks_to_minutes", lambda: stage(D.build_minutes(spark, sf), "m1"))
    timed("all_timeframes", lambda: aggregate(m1, D.DERIVED))
    bars = timed("bar_table_events", lambda: bar_series(m1, D.DERIVED, with_base=True))
    supply = timed("bar_table_lineitem", lambda: bar_series(stage(D.build_supply_minutes(spark, sf), "s"), ["1d"]))

    # indicators over 0.5 million daily bars
    def frame(**make):
        f = Frame(supply)
        return f.add(**{k: v(f) for k, v in make.items()}).build(keep=["symbol", "close_ts"])

    timed("sma_boll", lambda: frame(m=lambda f: f.sma("close", 20), u=lambda f: f.boll_upper(), w=lambda f: f.boll_width()))
    timed("ema", lambda: frame(e=lambda f: f.ema("close", 20)))
    timed("rsi_atr", lambda: frame(r=lambda f: f.rsi(14), a=lambda f: f.atr(14)))
    timed("macd", lambda: frame(d=lambda f: f.macd_dif(), s=lambda f: f.macd_dea(), h=lambda f: f.macd_hist()))
    timed("kdj", lambda: frame(k=lambda f: f.kdj_k(), d=lambda f: f.kdj_d()))
    timed("swings_double", lambda: frame(s=lambda f: f.swing_high(5), b=lambda f: f.double_bottom(5, 0.05)))
    timed("patterns", lambda: frame(b=lambda f: f.breakout(f.range(20)), e=lambda f: f.engulfing("up"), p=lambda f: f.pin_bar("up"), c=lambda f: f.consolidation(20, 0.5)))

    # as-of join of one-hour bars to four-hour values
    h1, h4 = bars.filter("timeframe = '1h'"), bars.filter("timeframe = '4h'")
    timed("asof_two_clocks", lambda: asof_known(h1, h4, ["close_ts", "close"]))

    # signals and outcomes on the daily bars: breakouts of every supplier
    rule = R.Rule("brk", (R.Condition("trig", "1d", lambda f: f.breakout(f.range(20), "up")),), R.Emit("long"), context={"atr14": lambda f: f.atr(14)})
    sig = timed("signals", lambda: stage(R.single_condition_signals(R.book(supply, [rule]), rule, F.concat_ws(":", "symbol", F.col("close_ts").cast("string"))), "sig"))
    params = OutcomeParams(cost_bps=2.0)
    outs = timed("outcomes", lambda: stage(evaluate(sig, supply, params), "outs"))
    timed("quality_report", lambda: Q.report(outs))
    atr = timed("baseline_atr", lambda: B.with_baseline_atr(supply))
    timed("weighted_baseline", lambda: B.weighted_baseline(outs, supply, params, 10, bars_atr=atr))
    timed("horizon_curve", lambda: B.horizon_curve(sig, supply, params, bars_atr=atr))
    timed("equity_curve", lambda: Q.equity_curve(outs))

    # rules end to end
    timed("demo_trial", lambda: R.run_trial(S.demo_rule(), bars).report)

    def stock():
        rules = stock_rules()
        frames = stage(R.trigger_frames(R.book(bars, rules), rules), "frames")
        return R.transitions(frames, rules)
    timed("stock_rules", stock)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
