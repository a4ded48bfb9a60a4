"""As-of joins, rules, the chain, signals and their log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import sigdata as S
from tidemark.catalog.data import M1, q6, series, series_cte
from tidemark.catalog.q_indicators import H1
from tidemark.catalog.registry import query
from tidemark.catalog.util import recur, rounded
from tidemark.operators import asof as A
from tidemark.operators import conditions as C
from tidemark.operators import rules as R
from tidemark.operators import trades, views
from tidemark.operators.frame import Frame
from tidemark.operators.outcomes import OutcomeParams, atr_from_context, exit_basis, risk_distances
from tidemark.operators.shipped import stock_rules, zone_short
from tidemark.plans.staging import stage
from tidemark.schema import RANK, lookup
from tidemark.sources import logs

H14 = series_cte("1h", "4h")
TWO = f"""{H14}, a AS MATERIALIZED (SELECT * FROM s WHERE timeframe = '1h'), b AS MATERIALIZED (SELECT *, CASE WHEN count(close) OVER w = 5 THEN avg(close) OVER w END AS m5 FROM s WHERE timeframe = '4h' WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
be AS MATERIALIZED (SELECT symbol, emit_ts, max(rn) AS rn FROM b GROUP BY symbol, emit_ts),
v AS MATERIALIZED (SELECT a.symbol, a.rn, a.close_ts, a.emit_ts, a.close, CASE WHEN c.rn IS NOT NULL AND e.rn IS NOT NULL THEN least(c.rn, e.rn) END AS vis, e.rn AS erow, c.rn AS crow
  FROM a ASOF LEFT JOIN b c ON a.symbol = c.symbol AND a.close_ts >= c.close_ts ASOF LEFT JOIN be e ON a.symbol = e.symbol AND a.emit_ts >= e.emit_ts)"""


def _ref(spark, sf):
    f = Frame(series(spark, sf, "4h"))
    return stage(f.add(m5=f.sma("close", 5)).build(), "ref")


@query("jon01_at_timeframe", f"WITH {TWO} SELECT v.symbol, v.close_ts, b.close_ts AS ref_close_ts, {q6('b.close')} AS ref_close, {q6('b.m5')} AS ref_sma5 FROM v LEFT JOIN b ON b.symbol = v.symbol AND b.rn = v.vis")
def _(spark, sf):
    out = A.asof_known(series(spark, sf, "1h"), _ref(spark, sf), ["close_ts", "close", "m5"])
    return rounded(out.select("symbol", "close_ts", F.col("ref.close_ts").alias("ref_close_ts"), F.col("ref.close").alias("ref_close"), F.col("ref.m5").alias("ref_sma5")))


@query("exp10_at_expression", f"WITH {TWO} SELECT v.symbol, v.close_ts, v.close > b.m5 AS above_ref FROM v LEFT JOIN b ON b.symbol = v.symbol AND b.rn = v.vis")
def _(spark, sf):
    rule = R.Rule("above_ref", (R.Condition("trig", "1h", lambda f: f["close"] > f["m5_4h"]),), R.Emit("long"),
                  at={"m5_4h": ("4h", lambda f: f.sma("close", 5))})
    booked = R.book(series(spark, sf), [rule])
    return booked["1h"].select("symbol", "close_ts", F.col("raw__above_ref__trig").alias("above_ref"))


@query("jon02_overlay_alignment", f"WITH {TWO} SELECT v.symbol, v.close_ts, {q6('b.m5')} AS ref_sma5 FROM v LEFT JOIN b ON b.symbol = v.symbol AND b.rn = v.crow")
def _(spark, sf):
    out = views.reference_averages(series(spark, sf, "1h"), series(spark, sf, "4h"), [("sma", 5)])
    return rounded(out.select("symbol", "close_ts", F.col("sma5_close").alias("ref_sma5")))


@query("jon03_role_bars", f"""WITH {series_cte('1h', '4h', '1d')}, a AS MATERIALIZED (SELECT * FROM s WHERE timeframe = '1h'),
 b AS MATERIALIZED (SELECT * FROM s WHERE timeframe = '4h'), be AS (SELECT symbol, emit_ts, max(rn) AS rn FROM b GROUP BY ALL), d AS MATERIALIZED (SELECT * FROM s WHERE timeframe = '1d'), de AS (SELECT symbol, emit_ts, max(rn) AS rn FROM d GROUP BY ALL),
 v AS (SELECT a.symbol, a.close_ts, CASE WHEN c.rn IS NOT NULL AND e.rn IS NOT NULL THEN least(c.rn, e.rn) END AS r4, CASE WHEN f.rn IS NOT NULL AND g.rn IS NOT NULL THEN least(f.rn, g.rn) END AS rd
  FROM a ASOF LEFT JOIN b c ON a.symbol = c.symbol AND a.close_ts >= c.close_ts ASOF LEFT JOIN be e ON a.symbol = e.symbol AND a.emit_ts >= e.emit_ts
  ASOF LEFT JOIN d f ON a.symbol = f.symbol AND a.close_ts >= f.close_ts ASOF LEFT JOIN de g ON a.symbol = g.symbol AND a.emit_ts >= g.emit_ts)
 SELECT v.symbol, v.close_ts, b.close_ts AS trend_ts, d.close_ts AS day_ts FROM v LEFT JOIN b ON b.symbol = v.symbol AND b.rn = v.r4 LEFT JOIN d ON d.symbol = v.symbol AND d.rn = v.rd""")
def _(spark, sf):
    out = A.bars_by_role(series(spark, sf, "1h"), series(spark, sf), {"trend": "4h", "day": "1d"})
    get = lambda k: F.try_element_at("role_bars", F.lit(k))
    return out.select("symbol", "close_ts", get("trend").alias("trend_ts"), get("day").alias("day_ts"))


@query("jon04_latest_booked", f"WITH {TWO} SELECT v.symbol, v.close_ts, b.close > b.m5 AS trend_ok FROM v LEFT JOIN b ON b.symbol = v.symbol AND b.rn = v.erow")
def _(spark, sf):
    ref = _ref(spark, sf).withColumn("ok", F.col("close") > F.col("m5"))
    out = A.asof_known(series(spark, sf, "1h"), ref, ["close_ts"], latest=["ok"])
    return out.select("symbol", "close_ts", F.col("latest.ok").alias("trend_ok"))


# ------------------------------------------------------------------ the demo rule and its chain

_e20 = recur("e4", "b", "close", 20, 2 / 21)
DEMO = f"""{H14}, a AS MATERIALIZED (SELECT *, CASE WHEN rn > 5 THEN max(high) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS rh FROM s WHERE timeframe = '1h'),
b AS MATERIALIZED (SELECT *, greatest(close - prev_close, 0.0) AS g, greatest(prev_close - close, 0.0) AS l FROM s WHERE timeframe = '4h'),
{_e20}, {recur('ge', 'b', 'g', 14, 1 / 14, 2)}, {recur('le', 'b', 'l', 14, 1 / 14, 2)},
bb AS MATERIALIZED (SELECT b.*, e4.y AS ema20, b.close > e4.y AS trend, CASE WHEN ge.y IS NULL THEN NULL WHEN le.y = 0 THEN CASE WHEN ge.y > 0 THEN 100.0 ELSE 50.0 END ELSE 100.0 - 100.0 / (1.0 + ge.y / le.y) END < 50 AS dip
  FROM b LEFT JOIN e4 USING (symbol, rn) LEFT JOIN ge USING (symbol, rn) LEFT JOIN le USING (symbol, rn)),
bs AS MATERIALIZED (SELECT *, CASE WHEN coalesce(bool_or(dip) OVER w, FALSE) THEN TRUE WHEN count(*) FILTER (dip IS NULL) OVER w > 0 THEN NULL ELSE FALSE END AS setup
  FROM bb WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
ar AS (SELECT *, close > rh AS up FROM a),
ae AS (SELECT *, coalesce(up AND lag(up) OVER (PARTITION BY symbol ORDER BY rn) = FALSE, FALSE) AS edge FROM ar),
ax AS MATERIALIZED (SELECT *, CASE WHEN lead(emit_ts) OVER w = emit_ts THEN lead(edge) OVER w ELSE edge END AS trig FROM ae WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
be AS MATERIALIZED (SELECT symbol, emit_ts, max(rn) AS rn FROM b GROUP BY symbol, emit_ts),
fr AS MATERIALIZED (SELECT a.symbol, a.rn, a.close_ts, a.close, a.volume, eb.trend, eb.setup, a.trig, vb.close_ts AS trend_ts, vb.ema20
  FROM (SELECT ax.*, CASE WHEN c.rn IS NOT NULL AND e.rn IS NOT NULL THEN least(c.rn, e.rn) END AS vis, e.rn AS erow FROM ax
        ASOF LEFT JOIN b c ON ax.symbol = c.symbol AND ax.close_ts >= c.close_ts ASOF LEFT JOIN be e ON ax.symbol = e.symbol AND ax.emit_ts >= e.emit_ts) a
  LEFT JOIN bs eb ON eb.symbol = a.symbol AND eb.rn = a.erow LEFT JOIN bs vb ON vb.symbol = a.symbol AND vb.rn = a.vis)"""

def chain_cte(rule_id: str, ttl: int, cooldown: int, second_holds: bool) -> str:
    """The chain of a three-condition rule over ``fr(symbol, rn, close_ts, trend, setup, trig, trend_ts)``,
    one recursive step per trigger bar.  The first condition always holds the chain; the second one
    does when it is a state condition."""
    back = "CASE WHEN st1 >= 1 AND NOT s0 THEN 0" + (" WHEN st1 >= 2 AND NOT s1 THEN 1" if second_holds else "") + " END"
    step = f"""SELECT q.symbol, q.rn, q.t,
  CASE WHEN cooling THEN p_stage WHEN back IS NOT NULL THEN back WHEN expired THEN 1 WHEN c3 = 3 THEN 2 ELSE c3 END AS stage,
  CASE WHEN cooling THEN p_ttl WHEN back IS NOT NULL OR expired THEN 0 WHEN c3 = 3 AND NOT dup THEN 0 WHEN b2 = 2 AND st1 < 2 THEN {ttl} WHEN st1 = 2 THEN p_ttl - 1 ELSE p_ttl END AS ttl,
  CASE WHEN cooling THEN p_cd WHEN fired AND NOT dup THEN t + {cooldown} ELSE 0 END AS cd,
  CASE WHEN fired AND NOT dup THEN list_append(keys, key) ELSE keys END AS keys,
  CASE WHEN cooling THEN '' WHEN back IS NOT NULL THEN 'retreated' WHEN expired THEN 'expired' WHEN fired THEN 'fired' WHEN c3 > st1 THEN 'advanced' WHEN p_cd > 0 THEN 'cooled' ELSE '' END AS outcome,
  fired AND NOT dup AS emitted, CASE WHEN fired THEN key END AS key
 FROM (SELECT *, list_contains(keys, key) AS dup, NOT cooling AND back IS NULL AND NOT expired AND c3 = 3 AS fired FROM (SELECT *, CASE WHEN b2 = 2 AND s2 THEN 3 ELSE b2 END AS c3 FROM (
  SELECT *, CASE WHEN a1 = 1 AND s1 THEN 2 ELSE a1 END AS b2 FROM (SELECT *, CASE WHEN st1 = 0 AND s0 THEN 1 ELSE st1 END AS a1, back IS NULL AND st1 = 2 AND p_ttl - 1 < 0 AS expired FROM (
   SELECT *, {back} AS back FROM (SELECT f.symbol, f.rn, f.close_ts AS t, coalesce(f.trend, FALSE) AS s0, coalesce(f.setup, FALSE) AS s1, coalesce(f.trig, FALSE) AS s2,
    f.symbol || ':{rule_id}:' || f.trend_ts AS key, p.stage AS p_stage, p.ttl AS p_ttl, p.cd AS p_cd, p.keys, p.cd > 0 AND f.close_ts < p.cd AS cooling,
    CASE WHEN p.cd > 0 AND f.close_ts >= p.cd THEN 1 ELSE p.stage END AS st1
   FROM ch p JOIN fr f ON f.symbol = p.symbol AND f.rn = p.rn + 1)))))) q"""
    return f"""ch AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS t, 0 AS stage, 0 AS ttl, CAST(0 AS BIGINT) AS cd, CAST([] AS VARCHAR[]) AS keys, '' AS outcome, FALSE AS emitted, CAST(NULL AS VARCHAR) AS key FROM fr
 UNION ALL {step})"""


CHAIN = f"{DEMO}, {chain_cte('demo', 6, 7200, second_holds=False)}"


def _booked(spark, sf):
    from tidemark.catalog.data import once
    rule = S.demo_rule()
    return once(spark, ("demo_book", sf), lambda: R.book(series(spark, sf), [rule]))


@query("rul01_booking", f"""WITH RECURSIVE {DEMO} SELECT symbol, 'trend' AS role, '4h' AS timeframe, close_ts, trend AS raw, trend AS satisfied FROM bs
 UNION ALL SELECT symbol, 'setup', '4h', close_ts, dip, setup FROM bs UNION ALL SELECT symbol, 'trig', '1h', close_ts, up, edge FROM ae""")
def _(spark, sf):
    rows = R.booked_rows(_booked(spark, sf), S.demo_rule())
    return rows.select("symbol", "role", "timeframe", "close_ts", "raw", "satisfied")


@query("rul02_condition_modes", f"WITH RECURSIVE {DEMO} SELECT symbol, close_ts, trend AS state_ok, setup AS window_ok FROM bs")
def _(spark, sf):
    return _booked(spark, sf)["4h"].select("symbol", "close_ts", F.col("sat__demo__trend").alias("state_ok"), F.col("sat__demo__setup").alias("window_ok"))


@query("rul03_trigger_frame", f"WITH RECURSIVE {DEMO} SELECT symbol, close_ts, trend, setup, trig, trend_ts FROM fr")
def _(spark, sf):
    fr = R.trigger_frame(_booked(spark, sf), S.demo_rule())
    return fr.select("symbol", "close_ts", F.col("satisfied")[0].alias("trend"), F.col("satisfied")[1].alias("setup"),
                     F.col("satisfied")[2].alias("trig"), F.col("role_ts")[0].alias("trend_ts"))


def _moves(spark, sf):
    return S.demo_trial(spark, sf).moves


@query("rul04_chain_advance", f"WITH RECURSIVE {CHAIN} SELECT symbol, t AS close_ts, CAST(stage AS BIGINT) AS stage FROM ch WHERE outcome = 'advanced'")
def _(spark, sf):
    return _moves(spark, sf).filter("outcome = 'advanced'").select("symbol", "close_ts", "stage")


@query("rul05_retreats", f"WITH RECURSIVE {CHAIN} SELECT symbol, t AS close_ts, CAST(stage AS BIGINT) AS stage FROM ch WHERE outcome = 'retreated'")
def _(spark, sf):
    return _moves(spark, sf).filter("outcome = 'retreated'").select("symbol", "close_ts", "stage")


@query("rul06_expiries", f"WITH RECURSIVE {CHAIN} SELECT symbol, t AS close_ts, CAST(stage AS BIGINT) AS stage FROM ch WHERE outcome = 'expired'")
def _(spark, sf):
    return _moves(spark, sf).filter("outcome = 'expired'").select("symbol", "close_ts", "stage")


@query("rul07_cooldown_ends", f"WITH RECURSIVE {CHAIN} SELECT symbol, t AS close_ts, CAST(stage AS BIGINT) AS stage FROM ch WHERE outcome = 'cooled'")
def _(spark, sf):
    return _moves(spark, sf).filter("outcome = 'cooled'").select("symbol", "close_ts", "stage")


@query("rul08_dedup_in_chain", f"WITH RECURSIVE {CHAIN} SELECT symbol, t AS close_ts, key AS dedup_key, emitted FROM ch WHERE outcome = 'fired'")
def _(spark, sf):
    return _moves(spark, sf).filter("outcome = 'fired'").select("symbol", "close_ts", "dedup_key", "emitted")


@query("rul09_signal_snapshots", f"""WITH RECURSIVE {CHAIN} SELECT 'demo' AS rule_id, ch.symbol, t AS fired_at, key AS dedup_key, {q6('fr.close')} AS trigger_price, fr.volume AS volume,
 {q6('fr.ema20')} AS trend_ema20, fr.trend_ts AS trend_bar FROM ch JOIN fr ON fr.symbol = ch.symbol AND fr.rn = ch.rn WHERE emitted""")
def _(spark, sf):
    sig = S.demo_trial(spark, sf).signals
    ctx = lambda k: F.try_element_at("context", F.lit(k))
    return rounded(sig.select("rule_id", "symbol", "fired_at", "dedup_key", "trigger_price", ctx("volume").alias("volume"),
                              ctx("trend.ema20").alias("trend_ema20"), F.try_element_at("role_bars", F.lit("trend")).alias("trend_bar")))


@query("rul10_transition_log", f"WITH RECURSIVE {CHAIN} SELECT symbol, t AS close_ts, outcome, CAST(stage AS BIGINT) AS stage, emitted FROM ch WHERE outcome <> ''")
def _(spark, sf):
    return _moves(spark, sf).select("symbol", "close_ts", "outcome", "stage", "emitted")


@query("rul12_single_condition_rules", f"WITH RECURSIVE {S.SIG} SELECT rule_id, symbol, direction, fired_at, {q6('trigger_price')} AS trigger_price, dedup_key, {q6('atr14')} AS atr14, priority FROM sig")
def _(spark, sf):
    sig = S.signals(spark, sf)
    return rounded(sig.select("rule_id", "symbol", "direction", "fired_at", "trigger_price", "dedup_key", F.try_element_at("context", F.lit("atr14")).alias("atr14"), "priority"))


@query("rul13_stock_rules_run")
def _(spark, sf):
    """All five stock rules over all symbols: signals and transitions by rule."""
    rules = stock_rules()
    booked = R.book(series(spark, sf), rules)
    frames = stage(R.trigger_frames(booked, rules), "frames")
    moves = R.transitions(frames, rules)
    return moves.groupBy("rule_id", "symbol", "outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("emitted").alias("n_signals"))


_W20 = "(PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
ZONE = f"""{series_cte('5m', '1h')}, t5 AS MATERIALIZED (SELECT *, CASE WHEN rn > 20 THEN min(low) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS rl,
  CASE WHEN count(volume) OVER {_W20} = 20 THEN avg(volume) OVER {_W20} END AS v20 FROM s WHERE timeframe = '5m'),
h AS MATERIALIZED (SELECT *, CASE WHEN prev_close IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev_close), abs(low - prev_close)) END AS tr FROM s WHERE timeframe = '1h'),
{recur('e1', 'h', 'close', 20, 2 / 21)}, {recur('atr1', 'h', 'tr', 14, 1 / 14)},
hb AS MATERIALIZED (SELECT h.*, close < e1.y AND e1.y < lag(e1.y, 6) OVER (PARTITION BY symbol ORDER BY rn) AS trend, abs(close - e1.y) < atr1.y * 0.8 AS zone FROM h LEFT JOIN e1 USING (symbol, rn) LEFT JOIN atr1 USING (symbol, rn)),
tr1 AS (SELECT *, close < rl AND volume > v20 * 1.5 AS brk FROM t5), tr2 AS (SELECT *, coalesce(brk AND lag(brk) OVER (PARTITION BY symbol ORDER BY rn) = FALSE, FALSE) AS edge FROM tr1),
tx AS MATERIALIZED (SELECT *, CASE WHEN lead(emit_ts) OVER w = emit_ts THEN lead(edge) OVER w ELSE edge END AS trig FROM tr2 WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
he AS MATERIALIZED (SELECT symbol, emit_ts, max(rn) AS rn FROM h GROUP BY symbol, emit_ts),
fr AS MATERIALIZED (SELECT a.symbol, a.rn, a.close_ts, eb.trend, eb.zone AS setup, a.trig, vb.close_ts AS trend_ts
  FROM (SELECT tx.*, CASE WHEN c.rn IS NOT NULL AND e.rn IS NOT NULL THEN least(c.rn, e.rn) END AS vis, e.rn AS erow FROM tx
        ASOF LEFT JOIN h c ON tx.symbol = c.symbol AND tx.close_ts >= c.close_ts ASOF LEFT JOIN he e ON tx.symbol = e.symbol AND tx.emit_ts >= e.emit_ts) a
  LEFT JOIN hb eb ON eb.symbol = a.symbol AND eb.rn = a.erow LEFT JOIN hb vb ON vb.symbol = a.symbol AND vb.rn = a.vis), {chain_cte('zone_short', 48, 1800, second_holds=True)}"""


@query("rul13_stock_rule_zone_short", f"WITH RECURSIVE {ZONE} SELECT symbol, t AS close_ts, outcome, CAST(stage AS BIGINT) AS stage, emitted, key AS dedup_key FROM ch WHERE outcome <> ''")
def _(spark, sf):
    rules = [zone_short()]
    frames = stage(R.trigger_frames(R.book(series(spark, sf), rules), rules), "frames")
    return R.transitions(frames, rules).select("symbol", "close_ts", "outcome", "stage", "emitted", "dedup_key")


@query("win08_condition_bands", f"""WITH RECURSIVE {DEMO}, p AS (SELECT symbol, 'trend' AS role, rn, close_ts, CASE WHEN trend THEN 'true' WHEN trend IS NULL THEN 'unknown' ELSE '' END AS value FROM bs
 UNION ALL SELECT symbol, 'setup', rn, close_ts, CASE WHEN setup THEN 'true' WHEN setup IS NULL THEN 'unknown' ELSE '' END FROM bs UNION ALL SELECT symbol, 'trig', rn, close_ts, CASE WHEN edge THEN 'true' WHEN edge IS NULL THEN 'unknown' ELSE '' END FROM ae),
 g AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, role, value ORDER BY rn) AS grp FROM p)
 SELECT symbol, role, value, min(close_ts) AS from_ts, max(close_ts) AS to_ts, count(*) AS bars FROM g WHERE value <> '' GROUP BY symbol, role, value, grp""")
def _(spark, sf):
    return S.demo_trial(spark, sf).bands.select("symbol", "role", "value", "from_ts", "to_ts", "bars")


COUNTS = """cnt AS (SELECT symbol, role, count(*) FILTER (ok) AS n_true, count(*) FILTER (NOT ok) AS n_false, count(*) FILTER (ok IS NULL) AS n_unknown FROM (
 SELECT symbol, 'trend' AS role, trend AS ok FROM bs UNION ALL SELECT symbol, 'setup', setup FROM bs UNION ALL SELECT symbol, 'trig', edge FROM ae) GROUP BY symbol, role)"""


@query("agg06_condition_tally", f"WITH RECURSIVE {DEMO}, {COUNTS} SELECT * FROM cnt")
def _(spark, sf):
    return S.demo_trial(spark, sf).counts.select("symbol", "role", "n_true", "n_false", "n_unknown")


@query("agg07_blocked_stage", f"""WITH RECURSIVE {CHAIN}, {COUNTS}, n AS (SELECT symbol, count(*) FILTER (emitted) AS n_signals FROM ch GROUP BY symbol),
 c2 AS (SELECT *, n_true + n_false + n_unknown AS tot, CASE role WHEN 'trend' THEN 1 WHEN 'setup' THEN 2 ELSE 3 END::BIGINT AS pos FROM cnt),
 bl AS (SELECT symbol, arg_min(role, pos) FILTER (n_true = 0) AS blocked FROM c2 GROUP BY symbol)
 SELECT symbol, role, pos, n_true, CASE WHEN n_true = 0 AND n_unknown = tot THEN 'warm-up only' WHEN n_true = 0 THEN 'never true' WHEN n_true < tot * 0.02 THEN 'rare' ELSE '' END AS note, n_signals,
 CASE WHEN n_signals > 0 THEN 'fired' WHEN blocked IS NOT NULL THEN 'blocked at ' || blocked ELSE 'never in order' END AS verdict FROM c2 JOIN n USING (symbol) JOIN bl USING (symbol)""")
def _(spark, sf):
    t = S.demo_trial(spark, sf)
    d = C.diagnose(t.counts, ["trend", "setup", "trig"], t.signals)
    return d.select("symbol", "role", "pos", "n_true", "note", "n_signals", "verdict")


@query("jon15_symbols_without_data", f"WITH {M1} SELECT p_brand AS symbol FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand NOT IN (SELECT symbol FROM m1)")
def _(spark, sf):
    from tidemark.catalog.data import table
    asked = table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    return asked.join(series(spark, sf).select("symbol").distinct(), "symbol", "left_anti")


_ROLE_TF = {"1-URGENT": "1m", "2-HIGH": "15m", "3-MEDIUM": "1h", "4-NOT SPECIFIED": "4h", "5-LOW": "1d"}
_ROLE_SQL = ", ".join(f"('{p}', '{t}', {RANK[t]})" for p, t in _ROLE_TF.items())


@query("srt05_required_timeframes", f"""WITH tf(o_orderpriority, timeframe, rank) AS (VALUES {_ROLE_SQL})
 SELECT timeframe, CAST(rank AS BIGINT) AS rank, count(DISTINCT o_custkey) AS rules, count(*) AS conditions FROM orders JOIN tf USING (o_orderpriority) GROUP BY ALL""")
def _(spark, sf):
    """A table of conditions, one per order: its customer's rule and a timeframe by its priority."""
    from tidemark.catalog.data import table
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("rule_id"), lookup(F.col("o_orderpriority"), _ROLE_TF).alias("timeframe"))
    return R.timeframes_needed(rows)


@query("set01_symbols_to_follow", f"WITH RECURSIVE {S.SIG} SELECT symbol FROM sig UNION SELECT 'SUP.' || s_suppkey FROM supplier WHERE s_acctbal < 0")
def _(spark, sf):
    from tidemark.catalog.data import table
    pinned = table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("SUP."), F.col("s_suppkey").cast("string")).alias("symbol"))
    return S.signals(spark, sf).select("symbol").union(pinned).distinct()


# ------------------------------------------------------------------ the signal log

SINCE, UNTIL = 1704600000, 1706000000
_COLS = f"rule_id, symbol, direction, fired_at, dedup_key, {q6('trigger_price')} AS trigger_price"
_PICK = ["rule_id", "symbol", "direction", "fired_at", "dedup_key", "trigger_price"]


@query("src12_signal_scan", f"WITH RECURSIVE {S.SIG} SELECT {_COLS} FROM sig WHERE rule_id = 'bo20_long' AND fired_at BETWEEN {SINCE} AND {UNTIL}")
def _(spark, sf):
    return rounded(logs.in_order(logs.scan_signals(S.signals(spark, sf), rule_id="bo20_long", since=SINCE, until=UNTIL)).select(*_PICK))


@query("srt01_signal_page", f"WITH RECURSIVE {S.SIG} SELECT {_COLS} FROM sig ORDER BY fired_at DESC, rule_id DESC, symbol DESC, dedup_key DESC LIMIT 200 OFFSET 100")
def _(spark, sf):
    return rounded(logs.page(S.signals(spark, sf), 200, 100).select(*_PICK))


@query("agg21_page_metadata", f"WITH RECURSIVE {S.SIG} SELECT count(*) AS total, min(fired_at) AS first_at, max(fired_at) AS last_at, count(*) > 300 AS has_older FROM sig")
def _(spark, sf):
    return logs.page_info(S.signals(spark, sf), 200, 100)


@query("snk03_append_signals", f"WITH RECURSIVE {S.SIG} SELECT rule_id, symbol, dedup_key, fired_at, {q6('trigger_price')} AS trigger_price FROM sig WHERE fired_at >= {SINCE}")
def _(spark, sf):
    """Incoming rows twice, the second time fired later at another price, on top of a log that already
    holds the early part: the first of each key stays."""
    sig = S.signals(spark, sf)
    again = sig.withColumns({"fired_at": F.col("fired_at") + 5, "trigger_price": F.col("trigger_price") - 1})
    out = logs.append_signals(again.unionByName(sig), sig.filter(F.col("fired_at") < SINCE))
    return rounded(out.select("rule_id", "symbol", "dedup_key", "fired_at", "trigger_price"))


@query("win06_latest_by_symbol", f"WITH RECURSIVE {S.SIG} SELECT {_COLS} FROM sig QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fired_at DESC, rule_id, dedup_key) = 1")
def _(spark, sf):
    return rounded(views.latest_by_symbol(S.signals(spark, sf)).select(*_PICK))


_P = OutcomeParams()


@query("prj18_exit_basis", f"WITH RECURSIVE {S.SIG} SELECT dedup_key, CASE WHEN atr14 > 0 THEN 'atr' ELSE 'pct' END AS exit_basis FROM sig")
def _(spark, sf):
    return S.signals(spark, sf).select("dedup_key", exit_basis(atr_from_context(_P)).alias("exit_basis"))


@query("prj19_risk_distances", f"""WITH RECURSIVE {S.SIG} SELECT dedup_key, {q6('CASE WHEN atr14 > 0 THEN atr14 * 1.5 ELSE trigger_price * 0.005 END')} AS stop_d,
 {q6('CASE WHEN atr14 > 0 THEN atr14 * 3.0 ELSE trigger_price * 0.01 END')} AS target_d FROM sig""")
def _(spark, sf):
    stop, target = risk_distances(atr_from_context(_P), F.col("trigger_price"), _P)
    return rounded(S.signals(spark, sf).select("dedup_key", stop.alias("stop_d"), target.alias("target_d")))


def _sized_sql(raw, caps="''", extra=""):
    return f"""WITH RECURSIVE {S.SIG}, z AS (SELECT *, CASE WHEN atr14 > 0 THEN atr14 * 1.5 ELSE trigger_price * 0.005 END AS stop_d, CASE WHEN atr14 > 0 THEN atr14 * 3.0 ELSE trigger_price * 0.01 END AS target_d,
 CASE WHEN symbol LIKE 'CN.%' THEN 10.0 ELSE 0.01 END::DOUBLE AS m, CASE WHEN symbol LIKE 'CN.%' THEN 1.0 ELSE 0.01 END::DOUBLE AS lot, CASE direction WHEN 'short' THEN -1.0 ELSE 1.0 END::DOUBLE AS sgn FROM sig WHERE direction <> 'neutral' AND trigger_price > 0),
 y AS (SELECT *, {raw} AS raw FROM z), w AS (SELECT *, floor(raw / lot + 1e-9) * lot AS qty FROM y)
 SELECT dedup_key AS signal_key, CASE direction WHEN 'short' THEN 'sell' ELSE 'buy' END AS side, {q6('qty')} AS qty, {q6('trigger_price - sgn * stop_d')} AS stop, {q6('trigger_price + sgn * target_d')} AS target FROM w WHERE qty > 0"""


def _sized(spark, sf, p):
    sig = S.signals(spark, sf).withColumn("multiplier", F.when(F.col("symbol").startswith("CN."), 10.0).otherwise(0.01))
    return rounded(trades.size_positions(sig, 1_000_000.0, p).select("signal_key", "side", "qty", "stop", "target"))


@query("prj20_position_size_risk", _sized_sql("least(1000000.0::DOUBLE * 0.005 / (stop_d * m), 200000.0::DOUBLE / (trigger_price * m), 4000.0::DOUBLE / (stop_d * m))"))
def _(spark, sf):
    return _sized(spark, sf, trades.SizingParams("risk", max_notional=200_000.0, max_risk=4_000.0))


@query("prj20_position_size_notional", _sized_sql("10000.0::DOUBLE / (trigger_price * m)"))
def _(spark, sf):
    return _sized(spark, sf, trades.SizingParams("notional"))


@query("prj20_position_size_fixed", _sized_sql("3.0::DOUBLE"))
def _(spark, sf):
    return _sized(spark, sf, trades.SizingParams("fixed", fixed_qty=3.0))


@query("prj21_dedup_keys", f"WITH RECURSIVE {CHAIN} SELECT symbol, t AS fired_at, key AS dedup_key FROM ch WHERE emitted")
def _(spark, sf):
    return S.demo_trial(spark, sf).signals.select("symbol", "fired_at", "dedup_key")


_V4 = "CASE WHEN v = 0 THEN '0' ELSE printf('%.4g', v) END"
_TINY = "o_totalprice * 0.7310585786::DOUBLE / 1e{0}"


@query("prj22_small_values", " UNION ".join(f"SELECT o_orderkey, {k} AS digits, {_V4} AS text FROM (SELECT o_orderkey, {_TINY.format(k)}::DOUBLE AS v FROM orders)" for k in (4, 8, 9, 11, 14)))
def _(spark, sf):
    """Numbers on both sides of 1e-4, where the notation changes after rounding."""
    from tidemark.catalog.data import table
    o = table(spark, sf, "orders").withColumn("digits", F.explode(F.array(*map(F.lit, (4, 8, 9, 11, 14)))))
    v = F.col("o_totalprice") * 0.7310585786 / lookup(F.col("digits"), {k: float(f"1e{k}") for k in (4, 8, 9, 11, 14)})
    return o.select("o_orderkey", "digits", views.format_value(v).alias("text")).distinct()


_V = """CASE WHEN {0} IS NULL THEN '—' WHEN abs({0}) >= 1000 THEN format('{{:,.2f}}', {0}) ELSE printf('%.4g', {0}) END"""


@query("prj22_message_text", f"""WITH RECURSIVE {S.SIG} SELECT dedup_key, CASE direction WHEN 'long' THEN '▲ 多' WHEN 'short' THEN '▼ 空' ELSE '● 提示' END || ' ' || symbol || ' [1h]' || chr(10) || '规则: ' || rule_id || CASE WHEN rule_id = 'bo20_long' THEN ' — breakout of 20 bars' ELSE '' END || chr(10) || '时间: ' ||
 CASE WHEN symbol LIKE 'CRYPTO%' THEN strftime(to_timestamp(fired_at) AT TIME ZONE 'UTC', '%m-%d %H:%M') || ' UTC' ELSE strftime(to_timestamp(fired_at + 28800) AT TIME ZONE 'UTC', '%m-%d %H:%M') || ' CST' END || chr(10) ||
 '触发价: ' || {_V.format('trigger_price')} || chr(10) || '关键值:' || chr(10) || '  close = ' || {_V.format('trigger_price')} || chr(10) || '  volume = ' || {_V.format('volume')} || chr(10) || '  atr14 = ' || {_V.format('atr14')} AS text FROM sig""")
def _(spark, sf):
    return S.signals(spark, sf).select("dedup_key", views.format_signal(description=lookup(F.col("rule_id"), {"bo20_long": "breakout of 20 bars"}, "")).alias("text"))


@query("prj24_priority_rank", """SELECT p, n, CASE WHEN lower(trim(p)) IN ('low', 'normal', 'high') THEN lower(trim(p)) ELSE 'normal' END AS priority,
 CASE lower(trim(p)) WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END::BIGINT AS rank FROM (SELECT substr(o_orderpriority, 3) AS p, count(*) AS n FROM orders GROUP BY 1)""")
def _(spark, sf):
    from tidemark.catalog.data import table
    p = table(spark, sf, "orders").groupBy(F.expr("substring(o_orderpriority, 3)").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return p.select("p", "n", views.coerce_priority(F.col("p")).alias("priority"), views.priority_rank(F.col("p")).alias("rank"))


@query("prj25_representative", f"""WITH RECURSIVE {S.SIG}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, fired_at ORDER BY -CASE priority WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END, rule_id, dedup_key) AS pos FROM sig)
 SELECT symbol, fired_at, rule_id FROM k WHERE pos = 1""")
def _(spark, sf):
    best = S.signals(spark, sf).groupBy("symbol", "fired_at").agg(F.min(F.struct(*views.rank_key(), "rule_id")).alias("k"))
    return best.select("symbol", "fired_at", F.col("k.rule_id").alias("rule_id"))
