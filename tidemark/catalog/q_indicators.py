"""Indicators and patterns on one-hour bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.data import SUPPLY, series, supply_series
from tidemark.catalog.registry import query
from tidemark.catalog.util import H1, recur, rounded, sel
from tidemark.operators.frame import Frame, true_range

K2 = ["symbol", "close_ts"]


def _frame(spark, sf):
    return Frame(series(spark, sf, "1h"))


def _out(frame, **cols):
    return rounded(frame.add(**cols).build(keep=K2))


def _win(expr, n, full=None):
    full = full or "close"
    return f"CASE WHEN count({full}) OVER w{n} = {n} THEN {expr} OVER w{n} END"


def _w(*ns):
    return " WINDOW " + ", ".join(
        f"w{n} AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ns)


@query("ind01_sma", sel("s", K2, {"sma20": _win("avg(close)", 20), "vsma5": _win("avg(volume)", 5)}, H1) + _w(20, 5))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, sma20=f.sma("close", 20), vsma5=f.sma("volume", 5))


@query("ind02_ema", sel("s LEFT JOIN e USING (symbol, rn)", ["symbol", "s.close_ts"], {"ema20": "e.y"}, f"{H1}, {recur('e', 's', 'close', 20, 2 / 21)}"))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, ema20=f.ema("close", 20))


@query("ind02_ema_daily_supplier", sel("s LEFT JOIN e USING (symbol, rn)", ["symbol", "s.close_ts"], {"ema12": "e.y"}, f"{SUPPLY}, {recur('e', 's', 'close', 12, 2 / 13)}"))
def _(spark, sf):
    f = Frame(supply_series(spark, sf))
    return _out(f, ema12=f.ema("close", 12))


@query("ind03_wilder", sel("s LEFT JOIN e USING (symbol, rn)", ["symbol", "s.close_ts"], {"rma14": "e.y"}, f"{H1}, {recur('e', 's', 'close', 14, 1 / 14)}"))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, rma14=f.wilder("close", 14))


@query("ind04_stddev", sel("s", K2, {"std20": _win("stddev_pop(close)", 20)}, H1) + _w(20))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, std20=f.std("close", 20))


RSI = (f"{H1}, mv AS (SELECT symbol, rn, greatest(close - prev_close, 0.0) AS g, greatest(prev_close - close, 0.0) AS l FROM s), "
       f"{recur('ge', 'mv', 'g', 14, 1 / 14, 2)}, {recur('le', 'mv', 'l', 14, 1 / 14, 2)}")


@query("ind05_rsi", sel("s LEFT JOIN ge ON ge.symbol = s.symbol AND ge.rn = s.rn LEFT JOIN le ON le.symbol = s.symbol AND le.rn = s.rn", ["s.symbol", "s.close_ts"],
                        {"rsi14": "CASE WHEN ge.y IS NULL THEN NULL WHEN le.y = 0 THEN CASE WHEN ge.y > 0 THEN 100.0 ELSE 50.0 END ELSE 100.0 - 100.0 / (1.0 + ge.y / le.y) END"}, RSI))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, rsi14=f.rsi(14))


MACD = (f"{H1}, {recur('ef', 's', 'close', 12, 2 / 13)}, {recur('es', 's', 'close', 26, 2 / 27)}, "
        f"dif AS MATERIALIZED (SELECT symbol, rn, ef.y - es.y AS d FROM ef JOIN es USING (symbol, rn)), {recur('dea', 'dif', 'd', 9, 2 / 10, 26)}")


@query("ind06_macd", sel("s LEFT JOIN dea ON dea.symbol = s.symbol AND dea.rn = s.rn LEFT JOIN dif ON dif.symbol = dea.symbol AND dif.rn = dea.rn", ["s.symbol", "s.close_ts"],
                         {"dif": "dif.d", "dea": "dea.y", "hist": "2 * (dif.d - dea.y)"}, MACD))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, dif=f.macd_dif(), dea=f.macd_dea(), hist=f.macd_hist())


_mid, _sd = _win("avg(close)", 20), _win("stddev_pop(close)", 20)


@query("ind07_bollinger", sel("s", K2, {"mid": _mid, "upper": f"{_mid} + 2 * {_sd}", "lower": f"{_mid} - 2 * {_sd}", "width": f"CASE WHEN {_mid} = 0 THEN 0.0 ELSE 4 * {_sd} / {_mid} END"}, H1) + _w(20))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, mid=f.boll_mid(), upper=f.boll_upper(), lower=f.boll_lower(), width=f.boll_width())


TR = "CASE WHEN prev_close IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev_close), abs(low - prev_close)) END"


@query("ind08_true_range", sel("s", K2, {"tr": TR}, H1))
def _(spark, sf):
    return _out(_frame(spark, sf), tr=true_range())


ATR = f"{H1}, tr AS (SELECT symbol, rn, {TR} AS tr FROM s), {recur('atr', 'tr', 'tr', 14, 1 / 14)}"


@query("ind09_atr", sel("s LEFT JOIN atr USING (symbol, rn)", ["symbol", "s.close_ts"], {"atr14": "atr.y"}, ATR))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, atr14=f.atr(14))


KDJ = (f"{H1}, hl AS (SELECT symbol, rn, close, max(high) OVER w AS hi, min(low) OVER w AS lo, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)), "
       f"rsv AS MATERIALIZED (SELECT symbol, rn, CASE WHEN hi = lo THEN 50.0 ELSE (close - lo) / (hi - lo) * 100.0 END AS r FROM hl WHERE n = 9), "
       f"{recur('k', 'rsv', 'r', 1, 1 / 3, 9, 50.0)}, kk AS MATERIALIZED (SELECT * FROM k), {recur('d', 'kk', 'y', 1, 1 / 3, 9, 50.0)}")


@query("ind10_kdj", sel("s LEFT JOIN kk ON kk.symbol = s.symbol AND kk.rn = s.rn LEFT JOIN d ON d.symbol = s.symbol AND d.rn = s.rn", ["s.symbol", "s.close_ts"],
                        {"k": "kk.y", "d": "d.y", "j": "3 * kk.y - 2 * d.y"}, KDJ))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, k=f.kdj_k(), d=f.kdj_d(), j=f.kdj_j())


@query("ind11_rolling_sum_mean", sel("s", K2, {"sum10": _win("sum(volume)", 10), "mean10": _win("avg(volume)", 10)}, H1) + _w(10))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, sum10=f.rolling_sum("volume", 10), mean10=f.sma("volume", 10))


# ------------------------------------------------------------------ patterns

RNG = (f"{H1}, r AS MATERIALIZED (SELECT *, CASE WHEN rn > 20 THEN max(high) OVER w END AS rh, CASE WHEN rn > 20 THEN min(low) OVER w END AS rl FROM s "
       "WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))")


@query("pat01_range", sel("r", K2, {"range_high": "rh", "range_low": "rl"}, RNG))
def _(spark, sf):
    f = _frame(spark, sf)
    box = f.range(20)
    return _out(f, range_high=box["high"], range_low=box["low"])


@query("pat02_range_width_mid", sel("r", K2, {"width": "rh - rl", "mid": "(rh + rl) / 2"}, RNG))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, width=f.range_width(f.range(20)), mid=f.range_mid(f.range(20)))


@query("pat03_breakout", f"WITH {RNG} SELECT symbol, close_ts, close > rh AS up, close < rl AS down FROM r")
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, up=f.breakout(f.range(20), "up"), down=f.breakout(f.range(20), "down"))


@query("pat04_highest_lowest", f"""WITH {H1}, x AS (SELECT symbol, close_ts, rn, {_win('max(high)', 20, 'high')} AS hi, {_win('min(low)', 20, 'low')} AS lo FROM s {_w(20)})
 SELECT symbol, close_ts, hi, lo, lag(hi) OVER (PARTITION BY symbol ORDER BY rn) AS prev_hi, lag(lo) OVER (PARTITION BY symbol ORDER BY rn) AS prev_lo FROM x""")
def _(spark, sf):
    f = _frame(spark, sf)
    hi, lo = f.highest("high", 20), f.lowest("low", 20)
    return _out(f, hi=hi, lo=lo, prev_hi=f.prev(hi), prev_lo=f.prev(lo))


def _pivot_sql(n):
    w = f"(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING)"
    return f"""pv AS MATERIALIZED (SELECT symbol, rn, high, low, count(*) OVER {w} = {2 * n + 1} AND high = max(high) OVER {w} AS ph, count(*) OVER {w} = {2 * n + 1} AND low = min(low) OVER {w} AS pl FROM s),
 sh AS MATERIALIZED (SELECT symbol, rn AS prn, rn + {n} AS rn, high AS price, lag(high) OVER (PARTITION BY symbol ORDER BY rn) AS prev, lag(rn) OVER (PARTITION BY symbol ORDER BY rn) AS prev_rn FROM pv WHERE ph),
 sl AS MATERIALIZED (SELECT symbol, rn AS prn, rn + {n} AS rn, low AS price, lag(low) OVER (PARTITION BY symbol ORDER BY rn) AS prev, lag(rn) OVER (PARTITION BY symbol ORDER BY rn) AS prev_rn FROM pv WHERE pl)"""


@query("pat05_swings", f"""WITH {H1}, {_pivot_sql(5)} SELECT a.symbol, a.close_ts, sh.price AS swing_high, sh.prev AS prev_swing_high, sl.price AS swing_low, sl.prev AS prev_swing_low
 FROM s a ASOF LEFT JOIN sh ON a.symbol = sh.symbol AND a.rn >= sh.rn ASOF LEFT JOIN sl ON a.symbol = sl.symbol AND a.rn >= sl.rn""")
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, swing_high=f.swing_high(5), prev_swing_high=f.swing_high(5, back=1),
                swing_low=f.swing_low(5), prev_swing_low=f.swing_low(5, back=1))


_lag = "lag({0}) OVER (PARTITION BY symbol ORDER BY rn)"
PV = f"{H1}, p AS (SELECT *, {_lag.format('open')} AS po, {_lag.format('close')} AS pc, {_lag.format('high')} AS ph, {_lag.format('low')} AS pl FROM s)"


@query("pat06_gap", f"WITH {PV} SELECT symbol, close_ts, low > ph AS up, high < pl AS down FROM p")
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, up=f.gap("up"), down=f.gap("down"))


@query("pat07_engulfing", f"""WITH {PV} SELECT symbol, close_ts, CASE WHEN po IS NULL THEN NULL ELSE pc < po AND close > open AND close >= po AND open <= pc END AS up,
 CASE WHEN po IS NULL THEN NULL ELSE pc > po AND close < open AND close <= po AND open >= pc END AS down FROM p""")
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, up=f.engulfing("up"), down=f.engulfing("down"))


_body, _up, _lo = "abs(close - open)", "(high - greatest(open, close))", "(least(open, close) - low)"


@query("pat08_pin_bar", f"""WITH {H1} SELECT symbol, close_ts, CASE WHEN high = low THEN FALSE ELSE {_lo} >= 2 * {_body} AND {_up} <= {_lo} / 2 END AS up,
 CASE WHEN high = low THEN FALSE ELSE {_up} >= 2 * {_body} AND {_lo} <= {_up} / 2 END AS down FROM s""")
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, up=f.pin_bar("up"), down=f.pin_bar("down"))


@query("pat09_consolidation", f"""WITH {H1}, x AS (SELECT symbol, close_ts, {_win('max(high)', 3, 'high')} AS hi, {_win('min(low)', 3, 'low')} AS lo FROM s {_w(3)})
 SELECT symbol, close_ts, CASE WHEN (hi + lo) / 2 = 0 THEN NULL ELSE (hi - lo) / ((hi + lo) / 2) <= 1.2 END AS flat FROM x""")
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, flat=f.consolidation(3, 1.2))


@query("pat10_range_atr", sel(f"(SELECT symbol, rn, close_ts, {_win('max(high)', 20, 'high')} AS hi, {_win('min(low)', 20, 'low')} AS lo FROM s {_w(20)}) x LEFT JOIN atr USING (symbol, rn)",
                              ["symbol", "close_ts"], {"range_atr": "CASE WHEN atr.y > 0 THEN (hi - lo) / atr.y END"}, ATR))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, range_atr=f.range_atr(20))


@query("pat11_inside_bar", f"WITH {PV} SELECT symbol, close_ts, high <= ph AND low >= pl AS inside FROM p")
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, inside=f.inside_bar())


def _double_sql(side, n, tol):
    t, other, agg = ("sl", "high", "max") if side == "low" else ("sh", "low", "min")
    depth = "neck - greatest(price, prev)" if side == "low" else "least(price, prev) - neck"
    return f"""pr_{side} AS MATERIALIZED (SELECT t.symbol, t.rn, any_value(t.price) AS price, any_value(t.prev) AS prev, {agg}(b.{other}) AS neck FROM {t} t LEFT JOIN s b ON b.symbol = t.symbol AND b.rn > t.prev_rn AND b.rn < t.prn WHERE t.prev_rn IS NOT NULL GROUP BY t.symbol, t.rn),
 v_{side} AS (SELECT symbol, rn, CASE WHEN least(abs(price), abs(prev)) <= 0 THEN NULL WHEN abs(price - prev) / least(abs(price), abs(prev)) > {tol} THEN FALSE WHEN neck IS NULL THEN FALSE ELSE ({depth}) / least(abs(price), abs(prev)) >= {tol} END AS ok FROM pr_{side})"""


@query("pat12_double_bottom_top", f"""WITH {H1}, {_pivot_sql(3)}, {_double_sql('low', 3, 0.2)}, {_double_sql('high', 3, 0.2)}
 SELECT a.symbol, a.close_ts, vl.ok AS bottom, vh.ok AS top FROM s a ASOF LEFT JOIN v_low vl ON a.symbol = vl.symbol AND a.rn >= vl.rn ASOF LEFT JOIN v_high vh ON a.symbol = vh.symbol AND a.rn >= vh.rn""")
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, bottom=f.double_bottom(3, 0.2), top=f.double_top(3, 0.2))


# ------------------------------------------------------------------ expression scalars

EX = f"{H1}, x AS (SELECT symbol, close_ts, rn, open, high, low, close, volume, prev_close, {_win('avg(close)', 5)} AS m5, {_win('avg(close)', 10)} AS m10 FROM s {_w(5, 10)})"


@query("exp01_arithmetic", sel("x", K2, {"a": "close - m5", "b": "-(close + m5) * 2", "c": "+high * low"}, EX))
def _(spark, sf):
    f = _frame(spark, sf)
    m5 = f.sma("close", 5)
    return _out(f, a=f["close"] - m5, b=-(f["close"] + m5) * 2, c=f["high"] * f["low"])


@query("exp02_division", sel("x", K2, {"r": "CASE WHEN high - low = 0 THEN NULL ELSE (close - low) / (high - low) END"}, EX))
def _(spark, sf):
    from tidemark.functions.scalars import div
    f = _frame(spark, sf)
    return _out(f, r=div(f["close"] - f["low"], f["high"] - f["low"]))


@query("exp03_floor_mod", sel("x", K2, {"m": "CASE WHEN close - open = 0 THEN NULL ELSE close - (close - open) * floor(close / (close - open)) END"}, EX))
def _(spark, sf):
    from tidemark.functions.scalars import mod
    f = _frame(spark, sf)
    return _out(f, m=mod(f["close"], f["close"] - f["open"]))


@query("exp04_chained_comparison", f"""WITH {EX} SELECT symbol, close_ts, CASE WHEN (m10 < m5) IS NULL THEN NULL WHEN NOT (m10 < m5) THEN FALSE ELSE m5 < close END AS ordered,
 CASE WHEN (open <= close) IS NULL THEN NULL WHEN NOT (open <= close) THEN FALSE ELSE close != high END AS capped FROM x""")
def _(spark, sf):
    from tidemark.functions.scalars import chain
    f = _frame(spark, sf)
    return _out(f, ordered=chain(f.sma("close", 10), "<", f.sma("close", 5), "<", f["close"]),
                capped=chain(f["open"], "<=", f["close"], "!=", f["high"]))


@query("exp05_kleene_logic", f"WITH {EX} SELECT symbol, close_ts, (close > m10) AND (close > open) AS both_, (close > m10) OR (close > open) AS any_, NOT (close > m10) AS neg FROM x")
def _(spark, sf):
    f = _frame(spark, sf)
    a, b = f["close"] > f.sma("close", 10), f["close"] > f["open"]
    return _out(f, both_=a & b, any_=a | b, neg=~a)


@query("exp06_abs", sel("x", K2, {"a": "abs(close - m5)"}, EX))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, a=F.abs(f["close"] - f.sma("close", 5)))


@query("exp07_min_max", sel("x", K2, {"lo": "CASE WHEN m5 IS NULL OR m10 IS NULL THEN NULL ELSE least(m5, m10, close) END", "hi": "CASE WHEN m5 IS NULL OR m10 IS NULL THEN NULL ELSE greatest(m5, m10, close) END"}, EX))
def _(spark, sf):
    from tidemark.functions.scalars import smallest, largest
    f = _frame(spark, sf)
    xs = f.sma("close", 5), f.sma("close", 10), f["close"]
    return _out(f, lo=smallest(*xs), hi=largest(*xs))


@query("exp08_prev", sel("x", K2, {"p1": "lag(m5) OVER (PARTITION BY symbol ORDER BY rn)", "p7": "lag(close, 7) OVER (PARTITION BY symbol ORDER BY rn)"}, EX))
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, p1=f.prev(f.sma("close", 5)), p7=f.prev("close", 7))


@query("exp09_cross", f"""WITH {EX}, y AS (SELECT *, lag(m5) OVER (PARTITION BY symbol ORDER BY rn) AS pm FROM x)
 SELECT symbol, close_ts, CASE WHEN pm IS NOT NULL THEN prev_close <= pm AND close > m5 END AS up, CASE WHEN pm IS NOT NULL THEN prev_close >= pm AND close < m5 END AS down FROM y""")
def _(spark, sf):
    f = _frame(spark, sf)
    m = f.sma("close", 5)
    return _out(f, up=f.cross_up(f["close"], m), down=f.cross_down(f["close"], m))


@query("exp11_truth", f"WITH {EX} SELECT symbol, close_ts, (close - open) != 0 AS moved, m10 != 0 AS known FROM x")
def _(spark, sf):
    from tidemark.functions.scalars import truth
    f = _frame(spark, sf)
    return _out(f, moved=truth(f["close"] - f["open"]), known=truth(f.sma("close", 10)))


@query("exp12_bar_fields", f"WITH {EX} SELECT symbol, close_ts, round(open + high + low + close + 1e-9, 6) + 0.0 AS total, volume, 0.0::DOUBLE AS open_interest FROM x")
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, total=f["open"] + f["high"] + f["low"] + f["close"], volume=f["volume"], open_interest=f["open_interest"])


# ------------------------------------------------------------------ condition modes

ED = f"{EX}, c AS MATERIALIZED (SELECT symbol, close_ts, rn, close > m5 AS raw FROM x)"


@query("win09_edges", f"WITH {ED} SELECT symbol, close_ts, coalesce(raw AND lag(raw) OVER (PARTITION BY symbol ORDER BY rn) = FALSE, FALSE) AS edge FROM c")
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, edge=f.mode(f["close"] > f.sma("close", 5), "event"))


@query("win10_occurred_within", f"""WITH {ED} SELECT symbol, close_ts, CASE WHEN coalesce(bool_or(raw) OVER w, FALSE) THEN TRUE WHEN count(*) FILTER (raw IS NULL) OVER w > 0 THEN NULL ELSE FALSE END AS seen
 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    f = _frame(spark, sf)
    return _out(f, seen=f.mode(f["close"] > f.sma("close", 5), "window", 4))
