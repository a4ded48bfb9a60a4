"""Outcome labels, reports, baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import sigdata as S
from tidemark.catalog.data import once, q6, series
from tidemark.catalog.q_indicators import H1, TR
from tidemark.catalog.q_signals import CHAIN
from tidemark.catalog.registry import query
from tidemark.catalog.util import recur, rounded, sel
from tidemark.operators import baseline as B
from tidemark.operators import quality as Q
from tidemark.operators.outcomes import OutcomeParams, evaluate
from tidemark.plans.staging import stage

OUT_KEYS = ["rule_id", "symbol", "direction", "fired_at", "entry_ts", "exit_ts", "reason", "exit_basis"]
OUT_NUM = ["entry_price", "exit_price", "ret", "gross_ret", "mfe", "mae"]


@query("jon05_outcomes", sel("o", [*OUT_KEYS, "bars_held"], OUT_NUM, S.OUT))
def _(spark, sf):
    return rounded(S.outcomes(spark, sf).select(*OUT_KEYS, "bars_held", *OUT_NUM))


@query("jon05_outcomes_pct_close_entry", sel("o", [*OUT_KEYS, "bars_held"], OUT_NUM, f"{S.SIG}, sc AS (SELECT * REPLACE (trigger_price AS next_open, CAST(NULL AS DOUBLE) AS atr14) FROM sig), {S.outcome_cte('sc', 'o', 7, 5.0, 0.3, 0.6)}"))
def _(spark, sf):
    p = OutcomeParams(horizon_bars=7, stop_pct=0.3, target_pct=0.6, cost_bps=5.0, entry_on_next_open=False, atr_key=None)
    return rounded(evaluate(S.signals(spark, sf), series(spark, sf), p).select(*OUT_KEYS, "bars_held", *OUT_NUM))


@query("p0_breakout_pays", f"""WITH {H1}, r AS (SELECT *, CASE WHEN rn > 20 THEN max(high) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS rh, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS m20 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 sig AS MATERIALIZED (SELECT 'breakout' AS rule_id, symbol, 'long' AS direction, timeframe, close_ts AS fired_at, close AS trigger_price, CAST(NULL AS DOUBLE) AS atr14, rn AS base_rn, next_open, next_close_ts FROM r WHERE close > rh AND close > m20), {S.outcome_cte('sig', 'o', 20, 0.0)}
 SELECT symbol, count(*) AS signals, count(*) FILTER (reason <> 'no_data') AS evaluated, count(*) FILTER (ret > 0) AS wins, {q6("coalesce(avg(ret) FILTER (reason <> 'no_data'), 0)")} AS avg_return FROM o GROUP BY symbol""")
def breakout_pays(spark, sf):
    """Ticks to one-hour bars to breakouts to outcomes to a summary per symbol."""
    from tidemark.operators.rules import Condition, Emit, Rule, book, single_condition_signals
    bars = series(spark, sf)
    rule = Rule("breakout", (Condition("trig", "1h", lambda f: f.breakout(f.range(20), "up") & (f["close"] > f.sma("close", 20))),), Emit("long"))
    sig = stage(single_condition_signals(book(bars, [rule]), rule, F.concat_ws(":", "symbol", F.col("close_ts").cast("string"))), "signals")
    out = evaluate(sig, bars, OutcomeParams(atr_key=None))
    return rounded(Q.summarize(out, ["symbol"]).select("symbol", "signals", "evaluated", "wins", "avg_return"))


_ST = {
    "win_rate": "coalesce(count(*) FILTER (d AND ret > 0) / nullif(count(*) FILTER (d), 0), 0)",
    "avg_return": "coalesce(avg(ret) FILTER (d), 0)", "median_return": "coalesce(median(ret) FILTER (d), 0)",
    "total_return": "coalesce(sum(ret) FILTER (d), 0)", "avg_win": "coalesce(avg(ret) FILTER (d AND ret > 0), 0)",
    "avg_loss": "coalesce(avg(ret) FILTER (d AND ret < 0), 0)",
    "payoff": "coalesce(abs(coalesce(avg(ret) FILTER (d AND ret > 0), 0) / nullif(coalesce(avg(ret) FILTER (d AND ret < 0), 0), 0)), 0)",
    "false_rate": "coalesce(count(*) FILTER (d AND reason = 'stop') / nullif(count(*) FILTER (d), 0), 0)",
    "target_rate": "coalesce(count(*) FILTER (d AND reason = 'target') / nullif(count(*) FILTER (d), 0), 0)",
    "horizon_rate": "coalesce(count(*) FILTER (d AND reason = 'horizon') / nullif(count(*) FILTER (d), 0), 0)",
    "avg_mfe": "coalesce(avg(mfe) FILTER (ev), 0)", "avg_mae": "coalesce(avg(mae) FILTER (ev), 0)",
    "avg_bars_held": "coalesce(avg(bars_held) FILTER (ev), 0)",
}
_CNT = "count(*) AS signals, count(*) FILTER (ev) AS evaluated, count(*) FILTER (d) AS directional, count(*) FILTER (d AND ret > 0) AS wins, count(*) FILTER (d AND ret < 0) AS losses"
_STATS = _CNT + ", " + ", ".join(f"{q6(f'CAST({e} AS DOUBLE)')} AS {n}" for n, e in _ST.items())
OD = f"{S.OUT}, od AS MATERIALIZED (SELECT *, reason <> 'no_data' AS ev, reason <> 'no_data' AND direction <> 'neutral' AS d, lpad(CAST(((fired_at + CASE WHEN symbol LIKE 'CRYPTO%' THEN 0 ELSE 28800 END) % 86400) // 3600 AS VARCHAR), 2, '0') AS hour FROM o)"


@query("agg04_outcome_summary", f"WITH RECURSIVE {OD} SELECT {_STATS} FROM od")
def _(spark, sf):
    return rounded(Q.summarize(S.outcomes(spark, sf), []))


REPORT = f"""{OD}, rep AS (SELECT CASE grouping(rule_id, symbol, hour, direction, exit_basis) WHEN 31 THEN 'overall' WHEN 15 THEN 'rule' WHEN 23 THEN 'symbol' WHEN 27 THEN 'hour' WHEN 29 THEN 'direction' ELSE 'basis' END AS dimension,
 coalesce(rule_id, symbol, hour, direction, exit_basis, '*') AS key, {_STATS} FROM od GROUP BY GROUPING SETS ((), (rule_id), (symbol), (hour), (direction), (exit_basis)))"""


@query("agg05_quality_report", f"WITH RECURSIVE {REPORT} SELECT * FROM rep")
def _(spark, sf):
    return rounded(Q.report(S.outcomes(spark, sf)))


# the demo rule's signals, labelled and reported: the whole trial as SQL
TRIAL = f"""{CHAIN}, a1 AS MATERIALIZED (SELECT *, {TR} AS tr FROM a), {recur('atr1', 'a1', 'tr', 14, 1 / 14)},
dsig AS MATERIALIZED (SELECT 'demo' AS rule_id, a.symbol, 'long' AS direction, '1h' AS timeframe, a.close_ts AS fired_at, a.close AS trigger_price, atr1.y AS atr14, a.rn AS base_rn, a.next_open, a.next_close_ts
  FROM ch JOIN a ON a.symbol = ch.symbol AND a.rn = ch.rn LEFT JOIN atr1 ON atr1.symbol = a.symbol AND atr1.rn = a.rn WHERE emitted),
{S.outcome_cte('dsig', 'o', 20, 0.0, bars='a')}, {REPORT.split(", od AS MATERIALIZED", 1)[1].join(["od AS MATERIALIZED", ""])}"""


@query("rul11_trial_report", f"WITH RECURSIVE {TRIAL} SELECT * FROM rep")
def _(spark, sf):
    return rounded(S.demo_trial(spark, sf).report)


@query("agg05_mixed_basis", f"WITH RECURSIVE {OD} SELECT count(DISTINCT exit_basis) > 1 AS mixed_basis, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT exit_basis || '=' || count(*) AS p FROM od GROUP BY exit_basis)) AS parts FROM od")
def _(spark, sf):
    return Q.mixed_basis(Q.report(S.outcomes(spark, sf), ["basis"]))


@query("srt04_top_groups", f"WITH RECURSIVE {REPORT} SELECT dimension, key, signals, pos FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY key) AS pos FROM rep) WHERE pos <= 4")
def _(spark, sf):
    return Q.top_groups(Q.report(S.outcomes(spark, sf)), 4).select("dimension", "key", "signals", "pos")


@query("win07_equity_curve", f"""WITH RECURSIVE {S.OUT}, e AS (SELECT rule_id, symbol, fired_at, entry_ts, sum(ret * 100) OVER (PARTITION BY rule_id ORDER BY entry_ts, symbol, fired_at ROWS UNBOUNDED PRECEDING) AS eq FROM o WHERE reason <> 'no_data'),
 p AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY rule_id ORDER BY entry_ts, symbol, fired_at ROWS UNBOUNDED PRECEDING)) AS pk FROM e)
 SELECT rule_id, symbol, fired_at, entry_ts, {q6('eq', 4)} AS equity, {q6('pk', 4)} AS peak, {q6('pk - eq', 4)} AS drawdown FROM p""")
def _(spark, sf):
    return rounded(Q.equity_curve(S.outcomes(spark, sf), ["rule_id"]), 4)


@query("win07_max_drawdown", f"""WITH RECURSIVE {S.OUT}, e AS (SELECT entry_ts, symbol, rule_id, fired_at, sum(ret * 100) OVER w AS eq FROM o WHERE reason <> 'no_data' WINDOW w AS (ORDER BY entry_ts, symbol, rule_id, fired_at ROWS UNBOUNDED PRECEDING))
 SELECT {q6('max(dd)', 4)} AS max_drawdown FROM (SELECT greatest(0, max(eq) OVER (ORDER BY entry_ts, symbol, rule_id, fired_at ROWS UNBOUNDED PRECEDING)) - eq AS dd FROM e)""")
def _(spark, sf):
    return rounded(Q.max_drawdown(Q.equity_curve(S.outcomes(spark, sf))), 4)


@query("agg15_return_histogram", f"""WITH RECURSIVE {S.OUT}, v AS (SELECT rule_id, ret * 100 AS v FROM o WHERE reason <> 'no_data'), z AS (SELECT rule_id, count(*) AS n, least(min(v), 0) AS lo, greatest(max(v), 0) AS hi FROM v GROUP BY rule_id HAVING count(*) >= 2),
 y AS (SELECT *, CAST(greatest(5, least(24, ceil(log2(n)) + 1)) AS BIGINT) AS bins FROM z)
 SELECT rule_id, bins, {q6('lo')} AS lo, {q6('hi')} AS hi, CAST(least(floor((v - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * bins), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM v JOIN y USING (rule_id) GROUP BY ALL""".replace("SELECT rule_id, count(*) AS n, least", "SELECT rule_id, count(*) AS n, least"))
def _(spark, sf):
    return rounded(Q.histogram(S.outcomes(spark, sf), ["rule_id"]))


# ------------------------------------------------------------------ baseline

def overlap_cte(src: str, name: str, by: str) -> str:
    """Overlap pairs by counting them directly (the brute-force twin)."""
    return (f"{name} AS MATERIALIZED (SELECT {by}, sum(c) AS pairs, count(*) AS n FROM (SELECT a.{by.replace(', ', ', a.')}, a.symbol AS sym, a.fired_at AS fa, a.eid AS ae, count(*) AS c FROM {src} a JOIN {src} b ON a.symbol = b.symbol"
            + "".join(f" AND a.{k} = b.{k}" for k in by.split(", ")) +
            f" AND b.entry_ts <= greatest(a.exit_ts, a.entry_ts) AND greatest(b.exit_ts, b.entry_ts) >= a.entry_ts GROUP BY ALL) GROUP BY {by})")


USED = f"{S.OUT}, u AS MATERIALIZED (SELECT *, row_number() OVER () AS eid FROM o WHERE reason <> 'no_data')"
EFF = f"{USED}, {overlap_cte('u', 'ov', 'rule_id')}, en AS (SELECT rule_id, n, CASE WHEN n < 2 THEN n::DOUBLE ELSE n / greatest(1.0, pairs / n) END AS n_eff FROM ov)"


@query("jon14_overlap_counts", f"WITH RECURSIVE {USED}, {overlap_cte('u', 'ov', 'rule_id, symbol')} SELECT rule_id, symbol, CAST(pairs AS BIGINT) AS pairs, n FROM ov")
def _(spark, sf):
    return B.overlap_totals(S.outcomes(spark, sf), ["rule_id"])


@query("agg09_effective_n", f"WITH RECURSIVE {EFF} SELECT rule_id, n, {q6('n_eff')} AS n_eff FROM en")
def _(spark, sf):
    return rounded(B.effective_n(S.outcomes(spark, sf), ["rule_id"]))


SE = f"{EFF}, se AS (SELECT rule_id, n, n_eff, CASE WHEN n >= 2 THEN sd / sqrt(greatest(1.0, n_eff)) END AS se FROM en JOIN (SELECT rule_id, stddev_samp(ret) AS sd FROM u GROUP BY rule_id) USING (rule_id))"


@query("agg10_standard_error", f"WITH RECURSIVE {SE} SELECT rule_id, {q6('se')} AS se FROM se")
def _(spark, sf):
    return rounded(B.standard_error(S.outcomes(spark, sf), ["rule_id"]).select("rule_id", "se"))


def _base_bars(spark, sf):
    return once(spark, ("base_atr", sf), lambda: B.with_baseline_atr(series(spark, sf, "1h")))


RAND = f"""{SE}, dirs AS (SELECT * FROM (VALUES ('long'), ('short')) t(direction)),
fk AS (SELECT '__random__' AS rule_id, s.symbol, direction, '1h' AS timeframe, s.close_ts AS fired_at, s.close AS trigger_price, atr.y AS atr14, s.rn AS base_rn, next_open, next_close_ts
  FROM s CROSS JOIN dirs LEFT JOIN atr ON atr.symbol = s.symbol AND atr.rn = s.rn WHERE (s.rn - 1) % 10 = 0),
{S.outcome_cte('fk', 'ro', 20, 2.0)}, ru AS MATERIALIZED (SELECT *, row_number() OVER () AS eid FROM ro WHERE reason <> 'no_data'),
{overlap_cte('ru', 'rov', 'symbol, direction')},
rx AS MATERIALIZED (SELECT symbol, direction, avg(ret) AS expectation, count(*) AS samples, stddev_samp(ret) AS sd FROM ru GROUP BY ALL),
re AS MATERIALIZED (SELECT symbol, direction, expectation, samples, CASE WHEN n >= 2 THEN sd / sqrt(greatest(1.0, n / greatest(1.0, pairs / n))) END AS se FROM rx JOIN rov USING (symbol, direction))""".replace("a.symbol, a.direction, a.symbol AS sym", "a.symbol, a.direction, a.symbol AS sym")


@query("agg08_random_entry", f"WITH RECURSIVE {RAND} SELECT symbol, direction, samples, {q6('expectation')} AS expectation, {q6('se')} AS se FROM re")
def _(spark, sf):
    wanted = series(spark, sf, "1h").select("symbol", "timeframe").distinct().withColumn("direction", F.explode(F.array(F.lit("long"), F.lit("short"))))
    out = B.random_entry_expectation(_base_bars(spark, sf), wanted, S.PARAMS, 10)
    return rounded(out.select("symbol", "direction", "samples", "expectation", "se"))


BASE = f"""{RAND}, pd AS (SELECT rule_id, symbol, direction, count(*) AS c, min(fired_at) AS seen FROM u GROUP BY ALL),
mj AS (SELECT rule_id, symbol, sum(c) AS n, arg_max(direction, (c, -seen)) AS direction FROM pd GROUP BY ALL), tt AS (SELECT rule_id, count(*) AS total FROM u GROUP BY ALL),
ws AS MATERIALIZED (SELECT mj.*, n / total AS w FROM mj JOIN tt USING (rule_id)),
bs AS (SELECT rule_id, sum(w * CASE WHEN direction = 'neutral' THEN 0 ELSE expectation END) AS baseline, CAST(sum(samples) AS BIGINT) AS samples, sqrt(sum((w * re.se) ** 2)) AS se_base FROM ws JOIN (SELECT * FROM re UNION ALL SELECT symbol, 'neutral', expectation, samples, se FROM re WHERE direction = 'long') re USING (symbol, direction) GROUP BY rule_id),
wb AS (SELECT rule_id, a.avg_return, baseline, samples, a.avg_return - baseline AS excess, se.se AS se_rule, se_base, sqrt(se.se ** 2 + se_base ** 2) AS se, se.n, n_eff FROM (SELECT rule_id, coalesce(avg(ret) FILTER (direction <> 'neutral'), 0) AS avg_return FROM u GROUP BY rule_id) a JOIN se USING (rule_id) JOIN bs USING (rule_id))"""
_WB = ", ".join(f"{q6(c)} AS {c}" for c in ("avg_return", "baseline", "excess", "se_rule", "se_base", "se"))


def _weighted(spark, sf):
    return once(spark, ("weighted", sf), lambda: stage(B.weighted_baseline(
        S.outcomes(spark, sf), series(spark, sf, "1h"), S.PARAMS, 10, bars_atr=_base_bars(spark, sf)), "weighted"))


@query("agg11_weighted_baseline", f"WITH RECURSIVE {BASE} SELECT rule_id, samples, {_WB} FROM wb")
def _(spark, sf):
    return rounded(_weighted(spark, sf).select("rule_id", "samples", "avg_return", "baseline", "excess", "se_rule", "se_base", "se"))


def _curve_sql():
    hs = B.HORIZON_LADDER
    ladder = ", ".join(f"({h})" for h in hs)
    def points(src, name, cols):
        return f"""{name}_p AS MATERIALIZED (SELECT {cols}, eid, base_rn, symbol AS sy, entry, sgn, stop, target FROM {src}_l WHERE ok),
 {name}_f AS MATERIALIZED (SELECT p.eid, b.rn - p.base_rn AS off, b.close AS c, CASE WHEN CASE WHEN sgn > 0 THEN b.low <= stop ELSE b.high >= stop END THEN stop WHEN CASE WHEN sgn > 0 THEN b.high >= target ELSE b.low <= target END THEN target END AS px FROM {name}_p p JOIN s b ON b.symbol = p.sy AND b.rn BETWEEN p.base_rn + 1 AND p.base_rn + 100),
 {name}_h AS (SELECT eid, min(off) FILTER (px IS NOT NULL) AS hit, arg_min(px, off) FILTER (px IS NOT NULL) AS hpx FROM {name}_f GROUP BY eid),
 {name}_c AS (SELECT f.eid, l.h, arg_max(c, off) AS c FROM {name}_f f JOIN lad l ON f.off <= l.h GROUP BY f.eid, l.h),
 {name} AS MATERIALIZED (SELECT p.*, c.h, (CASE WHEN hit <= c.h THEN hpx ELSE c.c END - entry) / entry * sgn - 2 * 2.0 * 1e-4 AS ret FROM {name}_p p JOIN {name}_h USING (eid) JOIN {name}_c c USING (eid))"""
    fk = "fk AS (SELECT '__random__' AS rule_id, s.symbol, direction, '1h' AS timeframe, s.close_ts AS fired_at, s.close AS trigger_price, atr.y AS atr14, s.rn AS base_rn, next_open, next_close_ts FROM s CROSS JOIN (VALUES ('long'), ('short'), ('neutral')) d(direction) LEFT JOIN atr ON atr.symbol = s.symbol AND atr.rn = s.rn WHERE (s.rn - 1) % 40 = 0)"
    return f"""{USED}, lad(h) AS (VALUES {ladder}), {points('o', 'mp', 'rule_id, symbol, direction')}, {fk}, {S.outcome_cte('fk', 'ro', 100, 2.0)}, {points('ro', 'rp', 'symbol, direction')},
 pd AS (SELECT rule_id, symbol, direction, count(*) AS c, min(fired_at) AS seen FROM u GROUP BY ALL), mj AS (SELECT rule_id, symbol, sum(c) AS n, arg_max(direction, (c, -seen)) AS direction FROM pd GROUP BY ALL),
 ws AS (SELECT mj.*, n / (SELECT count(*) FROM u WHERE u.rule_id = mj.rule_id) AS w FROM mj),
 own AS (SELECT rule_id, h, coalesce(avg(ret) FILTER (direction <> 'neutral'), 0) AS avg_return, count(*) AS evaluated FROM mp GROUP BY ALL),
 ex AS (SELECT symbol, direction, h, coalesce(avg(ret) FILTER (direction <> 'neutral'), 0) AS x FROM rp GROUP BY ALL),
 bl AS (SELECT rule_id, h, sum(w * x) AS baseline FROM ws JOIN ex USING (symbol, direction) GROUP BY ALL)"""


@query("agg12_horizon_curve", f"WITH RECURSIVE {_curve_sql()} SELECT rule_id, CAST(h AS BIGINT) AS bars, evaluated, {q6('avg_return')} AS avg_return, {q6('baseline')} AS baseline, {q6('avg_return - baseline')} AS excess FROM own JOIN bl USING (rule_id, h)")
def _(spark, sf):
    out = B.horizon_curve(S.signals(spark, sf), series(spark, sf, "1h"), S.PARAMS, bars_atr=_base_bars(spark, sf))
    return rounded(out.select("rule_id", "bars", "evaluated", "avg_return", "baseline", "excess"))


_VD = "CASE WHEN se IS NULL THEN 'unknown' WHEN excess - 2 * se <= 0 AND excess + 2 * se >= 0 THEN 'noise' WHEN excess > 0 THEN 'better' ELSE 'worse' END"


@query("agg13_excess_verdict", f"WITH RECURSIVE {BASE} SELECT rule_id, {_VD} AS verdict FROM wb")
def _(spark, sf):
    return _weighted(spark, sf).select("rule_id", B.verdict(F.col("excess"), F.col("se")).alias("verdict"))


@query("agg14_rule_parts", f"""WITH RECURSIVE {BASE} SELECT rule_id, symbol, direction, CAST(n AS BIGINT) AS n, samples, {q6("CASE WHEN direction = 'neutral' THEN 0 ELSE expectation END")} AS expectation
 FROM ws JOIN (SELECT * FROM re UNION ALL SELECT symbol, 'neutral', expectation, samples, se FROM re WHERE direction = 'long') re USING (symbol, direction)""")
def _(spark, sf):
    out = B.baseline_parts(S.outcomes(spark, sf), series(spark, sf, "1h"), S.PARAMS, 10, bars_atr=_base_bars(spark, sf))
    return rounded(out.select("rule_id", "symbol", "direction", "n", "samples", "expectation"))


@query("agg14_rule_evaluation", f"WITH RECURSIVE {BASE} SELECT rule_id, (SELECT count(*) FROM o WHERE o.rule_id = wb.rule_id) AS signals, (SELECT {q6("coalesce(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 0)")} FROM u WHERE u.rule_id = wb.rule_id AND direction <> 'neutral') AS win_rate, n, {q6('n_eff')} AS n_eff, {_WB}, {_VD} AS verdict FROM wb")
def _(spark, sf):
    out = B.evaluate_rules(S.signals(spark, sf), series(spark, sf, "1h"), S.PARAMS, 10)
    return rounded(out.select("rule_id", "signals", "win_rate", "n", "n_eff", "avg_return", "baseline", "excess", "se_rule", "se_base", "se", "verdict"))


