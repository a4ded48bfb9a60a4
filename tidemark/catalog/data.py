"""Bars derived from the driver tables, and the same bars as SQL.

``events`` is the tick source: one symbol per event type, price = value, volume 1.  ``lineitem``
gives daily ticks per supplier: price = extendedprice / quantity, volume = quantity.
The derived bar tables are written once per application and read by every query, as a bar store
would be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import bar_series, calendar_bars, calendar_series, ticks_to_minutes
from tidemark.plans.staging import stage

FIXED = ["5m", "15m", "30m", "1h", "4h"]
DERIVED = [*FIXED, "1d", "1w", "1mon"]
_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def once(spark: SparkSession, key: tuple, make, by=None) -> DataFrame:
    """Build a staged table once per application; its files live in the shared folder.  A key that another
    builder (``make``, or ``by`` where that only wraps it) has used is refused."""
    full = (spark.sparkContext.applicationId, *key)
    code = (by or make).__code__
    builder = code.co_filename, code.co_firstlineno
    if full not in _TABLES:
        _TABLES[full] = make(), builder
    out, first = _TABLES[full]
    if first != builder:
        raise ValueError(f"two builders for {key}")
    return out


def symbol_of(event_type: Column) -> Column:
    return F.concat(F.when(event_type.isin("click", "view"), "CN.SIM.").otherwise("CRYPTO.SIM."), event_type)


def build_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return ticks_to_minutes(
        table(spark, sf, "events"), symbol_of(F.col("event_type")), F.col("ts"), F.col("value"),
        F.col("event_id"))


def minutes(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, ("minutes", sf), lambda: stage(build_minutes(spark, sf), "minutes"))


def series(spark: SparkSession, sf: str, *timeframes: str) -> DataFrame:
    """Indexed closed bars of every timeframe (or of those asked for)."""
    def make():
        return bar_series(minutes(spark, sf), DERIVED, with_base=True)
    df = once(spark, ("series", sf), make)
    return df.filter(F.col("timeframe").isin(*timeframes)) if timeframes else df


def _supply_ticks(spark: SparkSession, sf: str) -> dict:
    return {
        "ticks": table(spark, sf, "lineitem"), "symbol": F.concat(F.lit("SUP."), F.col("l_suppkey").cast("string")),
        "ts": F.col("l_shipdate"), "price": F.col("l_extendedprice") / F.col("l_quantity"),
        # order key, line and part as one number of at most 29 digits
        "tie": ((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(17,0)") * F.lit(10**11).cast("decimal(12,0)")
                + F.col("l_partkey")).cast("decimal(29,0)"),
        "volume": F.col("l_quantity"), "money": F.col("l_extendedprice")}


def build_supply_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return ticks_to_minutes(**_supply_ticks(spark, sf))


def supply_calendar(spark: SparkSession, sf: str, timeframes: list[str]) -> DataFrame:
    """Calendar bars per supplier, the unfinished last one included."""
    return calendar_bars(**_supply_ticks(spark, sf), timeframes=timeframes)


def supply_series(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed daily bars per supplier."""
    def make():
        return calendar_series(**_supply_ticks(spark, sf), timeframes=["1d"])
    return once(spark, ("supply", sf), make)


# ------------------------------------------------------------------ the same, as SQL

SECONDS = {"5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400}

M1 = """
ticks AS (
  SELECT CASE WHEN event_type IN ('click','view') THEN 'CN.SIM.' ELSE 'CRYPTO.SIM.' END || event_type AS symbol,
         epoch_us(ts) AS us, event_id AS tie, value AS price
  FROM events),
m1 AS MATERIALIZED (
  SELECT symbol, '1m' AS timeframe, ((us + 59999999) // 60000000) * 60 - 60 AS open_ts,
         ((us + 59999999) // 60000000) * 60 AS close_ts,
         first(price ORDER BY us, tie) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY us, tie) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(price) AS money
  FROM ticks GROUP BY symbol, ((us + 59999999) // 60000000) * 60)"""


def _bars_sql(tf: str) -> str:
    if tf in SECONDS:
        p = SECONDS[tf]
        key, close = f"((close_ts + {p - 1}) // {p}) * {p}", "bucket"
        open_ts, on_time = f"bucket - {p}", "last_c = bucket"
    else:
        unit = {"1d": "day", "1w": "week", "1mon": "month"}[tf]
        key = f"CAST(date_trunc('{unit}', to_timestamp(close_ts) AT TIME ZONE 'UTC') AS DATE)"
        close, open_ts, on_time = "last_c", "first_o", "FALSE"
    return f"""(
  SELECT symbol, '{tf}' AS timeframe, {open_ts} AS open_ts, {close} AS close_ts, open, high, low, close,
         volume, money,
         CASE WHEN {on_time} THEN {close} ELSE lead(first_c) OVER (PARTITION BY symbol ORDER BY bucket) END AS emit_ts
  FROM (SELECT symbol, {key} AS bucket, min(close_ts) AS first_c, max(close_ts) AS last_c,
               first(open_ts ORDER BY close_ts) AS first_o,
               first(open ORDER BY close_ts) AS open, max(high) AS high, min(low) AS low,
               last(close ORDER BY close_ts) AS close, sum(volume) AS volume, sum(money) AS money
        FROM m1 GROUP BY symbol, {key}))"""


def all_bars_cte(*tfs: str, name: str = "bars_all") -> str:
    """CTEs ``m1`` and ``bars_all`` (unfinished buckets have a NULL emit_ts)."""
    union = "\n UNION ALL ".join(f"SELECT * FROM {_bars_sql(tf)}" for tf in tfs)
    return f"{M1},\n{name} AS MATERIALIZED ({union})"


def series_cte(*tfs: str) -> str:
    """CTEs up to ``s``: closed bars with row number and neighbours."""
    closed = "SELECT * FROM bars_all WHERE emit_ts IS NOT NULL"
    parts = [t for t in tfs if t != "1m"]
    if "1m" in tfs:
        m = "SELECT symbol, timeframe, open_ts, close_ts, open, high, low, close, volume, money, close_ts AS emit_ts FROM m1"
        head = all_bars_cte(*parts) if parts else M1
        closed = f"{closed} UNION ALL {m}" if parts else m
    else:
        head = all_bars_cte(*parts)
    return f"""{head},
s AS MATERIALIZED (
  SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS prev_close,
         lead(open) OVER w AS next_open, lead(close_ts) OVER w AS next_close_ts
  FROM ({closed}) WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY close_ts))"""


SUPPLY = """
m1 AS MATERIALIZED (
  SELECT 'SUP.' || l_suppkey AS symbol, '1m' AS timeframe, epoch(l_shipdate)::BIGINT - 60 AS open_ts,
         epoch(l_shipdate)::BIGINT AS close_ts,
         first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS money
  FROM lineitem GROUP BY l_suppkey, l_shipdate),
s AS MATERIALIZED (
  SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS prev_close,
         lead(open) OVER w AS next_open, lead(close_ts) OVER w AS next_close_ts
  FROM (SELECT symbol, '1d' AS timeframe, open_ts, close_ts, open, high, low, close, volume, money,
               lead(close_ts) OVER (PARTITION BY symbol ORDER BY close_ts) AS emit_ts FROM m1)
  WHERE emit_ts IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY close_ts))"""


def q6(expr: str, digits: int = 6) -> str:
    """Rounded for comparison.  The nudge settles exact halves the same way in both engines, and
    adding zero turns -0.0 into 0.0."""
    return f"(round({expr} + 1e-{digits + 3}, {digits}) + 0.0)"
