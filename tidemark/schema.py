"""Fixed schemas and the timeframe dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["symbol", "timeframe"]

BAR_FIELDS = ["open", "high", "low", "close", "volume", "money", "open_interest"]

BAR_SCHEMA = (
    "symbol string, timeframe string, open_ts bigint, close_ts bigint, open double, high double, "
    "low double, close double, volume double, money double, open_interest double, "
    "trading_day string, closed boolean, emit_ts bigint"
)

SIGNAL_SCHEMA = (
    "rule_id string, symbol string, direction string, timeframe string, fired_at bigint, "
    "trigger_price double, dedup_key string, context map<string,double>, "
    "role_bars map<string,bigint>, tentative boolean, priority string, trading_day string"
)

FILL_SCHEMA = (
    "signal_key string, symbol string, side string, qty double, price double, ts bigint, "
    "kind string, fee double, realized double"
)

# Timeframe -> length in seconds (0 = calendar period), shortest first.
TIMEFRAMES = {
    "1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400,
    "1d": 0, "1w": 0, "1mon": 0,
}
CALENDAR = tuple(tf for tf, s in TIMEFRAMES.items() if s == 0)
RANK = {tf: i for i, tf in enumerate(TIMEFRAMES)}


def timeframe_dim(spark: SparkSession) -> DataFrame:
    rows = [(tf, s, RANK[tf], s == 0) for tf, s in TIMEFRAMES.items()]
    return spark.createDataFrame(rows, "timeframe string, seconds bigint, rank bigint, is_calendar boolean")


def lookup(col: Column, table: dict, default=None) -> Column:
    """A small fixed dict as a CASE expression (stays inside codegen, needs no join)."""
    out = None
    for key, value in table.items():
        out = F.when(col == F.lit(key), F.lit(value)) if out is None else out.when(col == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default))


def seconds_of(tf: Column, calendar_seconds: int = 0) -> Column:
    """Length of a timeframe in seconds; calendar periods give ``calendar_seconds``."""
    return lookup(tf, {k: (v or calendar_seconds) for k, v in TIMEFRAMES.items()}).cast("bigint")


def rank_of(tf: Column) -> Column:
    return lookup(tf, RANK).cast("bigint")
