"""Literal bar tables for tests."""

from __future__ import annotations

from pyspark.sql import functions as F

FIELDS = ["open", "high", "low", "close"]


def minute_bars(spark, rows, symbol="T.X", day=None):
    """rows: (close_ts, open, high, low, close, volume[, trading_day])."""
    data = [(symbol, "1m", r[0] - 60, r[0], *[float(v) for v in r[1:6]], 0.0, 0.0, r[6] if len(r) > 6 else day, True, r[0]) for r in rows]
    return spark.createDataFrame(data, "symbol string, timeframe string, open_ts bigint, close_ts bigint, open double, high double, low double, close double, volume double, money double, open_interest double, trading_day string, closed boolean, emit_ts bigint")


def close_series(spark, closes, symbol="T.X", tf="1h", step=3600, spread=0.0):
    """An indexed series from closes alone."""
    rows, n = [], len(closes)
    for i, c in enumerate(closes):
        o = closes[i - 1] if i else c
        rows.append((symbol, tf, i * step, (i + 1) * step, float(o), float(max(o, c) + spread), float(min(o, c) - spread), float(c), 1.0, float(c), 0.0, None, True, (i + 1) * step,
                     i + 1, float(closes[i - 1]) if i else None, float(c) if i + 1 < n else None, (i + 2) * step if i + 1 < n else None))
    return spark.createDataFrame(rows, "symbol string, timeframe string, open_ts bigint, close_ts bigint, open double, high double, low double, close double, volume double, money double, open_interest double, trading_day string, closed boolean, emit_ts bigint, rn bigint, prev_close double, next_open double, next_close_ts bigint")


def ohlc_series(spark, bars, symbol="T.X", tf="1h", step=3600):
    """An indexed series from (open, high, low, close) rows."""
    rows, n = [], len(bars)
    for i, (o, h, lo, c) in enumerate(bars):
        rows.append((symbol, tf, i * step, (i + 1) * step, float(o), float(h), float(lo), float(c), 1.0, float(c), 0.0, None, True, (i + 1) * step, i + 1,
                     float(bars[i - 1][3]) if i else None, float(bars[i + 1][0]) if i + 1 < n else None, (i + 2) * step if i + 1 < n else None))
    return spark.createDataFrame(rows, close_series(spark, [1.0]).schema)


def column(df, name, order="rn"):
    return [r[0] for r in df.orderBy(order).select(F.col(name)).collect()]


def close_to(a, b, tol=1e-9):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        if x is None or y is None:
            assert x is None and y is None, (x, y)
        else:
            assert abs(x - y) <= tol * max(1.0, abs(y)), (x, y)
