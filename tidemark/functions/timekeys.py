"""Bucket, period and partition keys on BIGINT epoch seconds (no session time zone involved)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import TIMEFRAMES

CN_OFFSET = 8 * 3600  # fixed value: UTC+8, no daylight saving


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ceil_to(ts, period) -> Column:
    """Right-closed bucket label: the close of the bucket that holds a bar closing at ``ts``."""
    p = F.lit(period) if isinstance(period, int) else period
    return (-F.floor(-_col(ts) / p) * p).cast("bigint")


def bucket_close(ts, timeframe: str) -> Column:
    return ceil_to(ts, TIMEFRAMES[timeframe])


def bucket_open(close_ts, timeframe: str) -> Column:
    return _col(close_ts) - F.lit(TIMEFRAMES[timeframe])


def is_closed(close_ts, now_ts) -> Column:
    return _col(close_ts) <= now_ts


def epoch_micros(ts) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone is."""
    c = _col(ts).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def day_number(ts, offset: int = 0) -> Column:
    return F.floor((_col(ts) + F.lit(offset)) / F.lit(86400)).cast("int")


def as_date(days) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), _col(days).cast("int"))


def utc_date(ts) -> Column:
    return as_date(day_number(ts))


def bar_date(close_ts="close_ts", trading_day="trading_day") -> Column:
    """The day a bar belongs to: its trading day, else the UTC date of its close."""
    return F.coalesce(_col(trading_day).cast("date"), utc_date(close_ts))


def day_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def iso_week_text(date: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def period_key(timeframe: str, date: Column) -> Column:
    if timeframe == "1d":
        return day_text(date)
    if timeframe == "1w":
        return iso_week_text(date)
    if timeframe == "1mon":
        return F.date_format(date, "yyyy-MM")
    raise ValueError(f"{timeframe} is not a calendar period")


def period_start(timeframe: str, date: Column) -> Column:
    """First date of the period as a day number: same grouping as :func:`period_key`, and ordered."""
    unit = {"1d": "day", "1w": "week", "1mon": "month"}[timeframe]
    return F.unix_date(F.trunc(date, unit) if unit != "day" else date).cast("bigint")


def partition_unit(timeframe: str) -> str:
    return "year" if TIMEFRAMES[timeframe] == 0 else "day"


def partition_key(timeframe="timeframe", close_ts="close_ts", trading_day="trading_day") -> Column:
    """Storage partition: one day per intraday part, one year per calendar-bar part."""
    day = day_text(bar_date(close_ts, trading_day))
    calendar = _col(timeframe).isin("1d", "1w", "1mon")
    return F.when(calendar, F.substring(day, 1, 4)).otherwise(day)


def market_of(symbol="symbol") -> Column:
    return F.split(_col(symbol), r"\.")[0]


def local_hour(ts, symbol="symbol") -> Column:
    """Hour on the market's own clock: UTC for crypto, UTC+8 for the futures market."""
    shift = F.when(_col(symbol).startswith("CRYPTO"), 0).otherwise(CN_OFFSET)
    return F.floor(((_col(ts) + shift) % F.lit(86400)) / F.lit(3600)).cast("bigint")
