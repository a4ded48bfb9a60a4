"""Market-data payloads in a landing table to bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timekeys import day_text, utc_date
from tidemark.schema import lookup, TIMEFRAMES

_KLINE = ("array<struct<time_stamp:bigint,open:double,high:double,low:double,close:double,"
          "volume:double,money:double,open_interest:double>>")
_QUOTE = f"code bigint, msg string, data {_KLINE}"
_QUOTE_MULTI = f"code bigint, msg string, data array<struct<code:string,klines:{_KLINE}>>"
_PUSH = "event string, code string, msg string, arg struct<channel:string,instId:string>, data array<array<string>>"


def quote_rows(landing: DataFrame, payload: str = "payload", requested: str | None = None) -> DataFrame:
    """Unwrap futures quote responses: ``data`` is the bars, or one entry per code.  NULL data is a
    valid empty answer.  Keeps the other columns; adds ``error`` (NULL when fine) and ``k``."""
    multi = F.col(payload).contains('"klines"')
    one, many = F.from_json(payload, _QUOTE), F.from_json(payload, _QUOTE_MULTI)
    chosen = many["data"]
    if requested is not None:
        chosen = F.filter(chosen, lambda d: d["code"] == F.col(requested))
    klines = F.when(multi, F.try_element_at(chosen, F.lit(1))["klines"]).otherwise(one["data"])
    code, msg = F.when(multi, many["code"]).otherwise(one["code"]), F.when(multi, many["msg"]).otherwise(one["msg"])
    bad = F.when(code.isNull() | (code != 0), F.concat_ws(" ", F.coalesce(code.cast("string"), F.lit("?")), msg))
    keep = [c for c in landing.columns if c != payload]
    parsed = landing.select(*keep, bad.alias("error"), klines.alias("_k"))
    return parsed.select(*keep, "error", F.explode_outer("_k").alias("k")).filter("k IS NOT NULL OR error IS NOT NULL")


def quote_bars(rows: DataFrame, now_ts: int) -> DataFrame:
    """Quote rows to bars.  Intraday stamps are close times; a daily stamp is the trading date at
    UTC midnight, and its bar spans that nominal day."""
    k, daily = F.col("k"), F.col("timeframe") == "1d"
    t = k["time_stamp"]
    period = lookup(F.col("timeframe"), TIMEFRAMES).cast("bigint")
    close = F.when(daily, t + 86400).otherwise(t)
    zero = F.lit(0.0)
    return rows.filter("error IS NULL").select(
        "symbol", "timeframe", F.when(daily, t).otherwise(t - period).alias("open_ts"), close.alias("close_ts"),
        k["open"].alias("open"), k["high"].alias("high"), k["low"].alias("low"), k["close"].alias("close"),
        F.coalesce(k["volume"], zero).alias("volume"), F.coalesce(k["money"], zero).alias("money"),
        F.coalesce(k["open_interest"], zero).alias("open_interest"),
        F.when(daily, day_text(utc_date(t))).alias("trading_day"), (close <= now_ts).alias("closed"))


def _candle(row: Column, timeframe: Column) -> list[Column]:
    """Exchange candle: ``[open ms, o, h, l, c, contracts, base volume, quote volume, confirm]``."""
    period = lookup(timeframe, {**TIMEFRAMES, "1d": 86400}).cast("bigint")
    open_ts = F.floor(row[0].cast("bigint") / 1000).cast("bigint")
    return [open_ts.alias("open_ts"), (open_ts + period).alias("close_ts"),
            *[row[i].cast("double").alias(n) for i, n in ((1, "open"), (2, "high"), (3, "low"), (4, "close"),
                                                          (6, "volume"), (7, "money"))],
            F.lit(0.0).alias("open_interest"), F.lit(None).cast("string").alias("trading_day"),
            (row[8] == "1").alias("closed")]


def candle_bars(landing: DataFrame, payload: str = "payload", closed_only: bool = True) -> DataFrame:
    """Candle responses (``code`` "0" and an array of string arrays) to bars; a week or month has
    no fixed length and is refused with an error."""
    doc = F.from_json(payload, "code string, msg string, data array<array<string>>")
    rows = landing.withColumn("_d", doc).filter("_d.code = '0'").withColumn("_row", F.explode("_d.data"))
    refused = F.raise_error(F.concat(F.lit("candles of no fixed length: "), F.col("timeframe"))).cast("string")
    fixed = rows.withColumn("timeframe", F.when(F.col("timeframe").isin("1w", "1mon"), refused).otherwise(F.col("timeframe")))
    out = fixed.select("symbol", "timeframe", *_candle(F.col("_row"), F.col("timeframe")))
    return out.filter("closed") if closed_only else out


def candle_errors(landing: DataFrame, payload: str = "payload") -> DataFrame:
    doc = F.from_json(payload, "code string, msg string")
    return landing.withColumn("_d", doc).filter("_d.code IS NULL OR _d.code <> '0'").select(
        "symbol", F.col("_d.code").alias("code"), F.col("_d.msg").alias("msg"))


def push_rows(messages: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Push messages to (instrument, candle) rows, and the error events.  Heartbeats, broken text
    and acknowledgements are ignored.  Works on a batch or a stream."""
    doc = messages.filter(F.col(text) != "pong").withColumn("_m", F.from_json(text, _PUSH))
    keep = [c for c in messages.columns if c != text]
    errors = doc.filter("_m.event = 'error'").select(*keep, F.col("_m.code").alias("code"), F.col("_m.msg").alias("msg"))
    rows = doc.filter("_m.data IS NOT NULL AND coalesce(_m.event, '') <> 'error'").select(
        *keep, F.coalesce("_m.arg.instId", F.lit("")).alias("inst_id"), F.explode("_m.data").alias("row"))
    return rows, errors


def push_bars(rows: DataFrame, timeframe: str = "1m") -> DataFrame:
    tf = F.lit(timeframe)
    return rows.select(F.col("inst_id").alias("symbol"), tf.alias("timeframe"), *_candle(F.col("row"), tf))
