"""Late minutes: one stream, in order to the buckets, late to the stored bars, corrected buckets again.

The stateful operator follows each symbol's newest minute.  A minute in order goes to the open buckets; a late
or repeated one only to the minute table, where the later write wins, and names the buckets that it belongs to: a bucket that has
been closed is to be made again at once, an open one when it closes.  The sink upserts the minutes, then the
closed bars, then makes the named buckets again from the stored minutes and upserts those.  All three steps are
idempotent, so a batch that runs twice changes nothing.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.timekeys import bar_date, ceil_to, period_start
from tidemark.operators.bars import bucketed, closed_only
from tidemark.plans.small import broadcast_if_small
from tidemark.plans.staging import stage
from tidemark.schema import TIMEFRAMES
from tidemark.sources.bar_table import STORED, open_table, write_bars
from tidemark.streaming import live
from tidemark.streaming.live_rules import MINUTE, PROVIDER

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT = ("kind string, symbol string, timeframe string, open_ts bigint, close_ts bigint, open double, high double, low double, close double, "
         "volume double, money double, open_interest double, trading_day string, emit_ts bigint, bucket bigint")
NAMES = [c.split()[0] for c in SPLIT.split(", ")]
LONGEST = 36 * 86400  # a month, and the days by which a minute may stand before its trading day


class Splitter(StatefulProcessor):
    def __init__(self, timeframes: list[str]):
        self.seconds = {tf: TIMEFRAMES[tf] for tf in timeframes}

    def init(self, handle) -> None:
        self.memory = handle.getValueState("memory", "state binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        newest, open_rows, dirty = pickle.loads(self.memory.get()[0]) if self.memory.exists() else (-(2**62), {}, set())
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("close_ts", kind="stable").drop_duplicates("close_ts", keep="last")
        late, pdf = pdf[pdf["close_ts"] <= newest], pdf[pdf["close_ts"] > newest]
        yield self._out(pd.concat([late, pdf]) if len(late) else pdf, "minute", "1m", key[0])
        newest = int(pdf["close_ts"].iloc[-1]) if len(pdf) else newest
        for tf, secs in self.seconds.items():
            again = set(live.period_of(late, tf, secs).tolist()) if len(late) else set()
            still = open_rows.get(tf)
            if still is not None and still["bucket"] in again:
                dirty.add((tf, still["bucket"]))
                again.discard(still["bucket"])
            fixed = dict.fromkeys(again, newest)
            if len(pdf):
                done, open_rows[tf] = live.close_buckets(still, pdf, tf, secs)
                buckets = live.period_of(done, tf, secs) if len(done) else pd.Series(dtype="int64")
                spoilt = [(tf, b) in dirty for b in buckets.tolist()]
                fixed |= {b: int(e) for b, e, s in zip(buckets, done["emit_ts"], spoilt, strict=True) if s}
                dirty -= {(tf, b) for b in fixed}
                yield self._out(done[[not s for s in spoilt]], "bar", tf, key[0])
            if fixed:
                yield self._out(pd.DataFrame({"bucket": list(fixed), "emit_ts": list(fixed.values())}), "fix", tf, key[0])
        self.memory.update((pickle.dumps((newest, open_rows, dirty)),))

    @staticmethod
    def _out(pdf: pd.DataFrame, kind: str, tf: str, symbol: str) -> pd.DataFrame:
        # as objects: a string column of several Arrow chunks can't be sent
        return pdf.assign(kind=kind, timeframe=tf, symbol=symbol).reindex(columns=NAMES).astype(dict.fromkeys(("kind", "symbol", "timeframe", "trading_day"), object))

    def close(self) -> None:
        pass


def split_minutes(minutes: DataFrame, timeframes: list[str]) -> DataFrame:
    """Stream of rows by ``kind``: 'minute' (to be stored), 'bar' (closed) and 'fix' (a bucket to be made again, known by emit_ts)."""
    spark = minutes.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return closed_only(minutes).select(*MINUTE).groupBy("symbol").transformWithStateInPandas(Splitter(timeframes), SPLIT, "Append", "None")


def bucket_column(timeframes: list[str]) -> Column:
    """The bucket of a row's close in the timeframe that the row names."""
    keys = [F.when(F.col("timeframe") == tf, ceil_to("close_ts", TIMEFRAMES[tf]) if TIMEFRAMES[tf] else period_start(tf, bar_date())) for tf in timeframes]
    return F.coalesce(*keys).cast("bigint")


def remade(minutes: DataFrame, fixes: DataFrame, timeframes: list[str]) -> DataFrame:
    """The buckets named by ``fixes`` (symbol, timeframe, bucket, emit_ts), from stored minutes."""
    reach = fixes.agg(F.min(_edge(-1)).alias("lo"), F.max(_edge(1)).alias("hi")).collect()[0]
    near = minutes.filter((F.col("timeframe") == "1m") & (F.col("close_ts") >= reach.lo) & (F.col("close_ts") <= reach.hi))
    if "part" in minutes.columns:  # parts are trading days; one may count for a day some days later
        lo, hi = (F.date_format(F.timestamp_seconds(F.lit(t)), "yyyy-MM-dd") for t in (reach.lo - 4 * 86400, reach.hi + 35 * 86400))
        near = near.filter(F.col("part").between(lo, hi))
    named = broadcast_if_small(fixes.select("symbol", "timeframe", "bucket", F.col("emit_ts").alias("_known")))
    made = bucketed(near.join(broadcast_if_small(fixes.select("symbol").distinct()), "symbol", "left_semi"), timeframes)
    return made.join(named, ["symbol", "timeframe", "bucket"]).select(
        *[c for c in STORED if c not in ("closed", "emit_ts")], "bucket", F.lit(True).alias("closed"), F.col("_known").alias("emit_ts"))


def _edge(side: int) -> Column:
    """An instant before (after) every minute of the named bucket."""
    fixed = [F.when(F.col("timeframe") == tf, F.col("bucket") + side * secs) for tf, secs in TIMEFRAMES.items() if secs]
    return F.coalesce(*fixed, F.col("bucket") * 86400 + side * LONGEST)


def late_sink(minute_root: str, bar_root: str, timeframes: list[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer for :func:`split_minutes`."""
    def write(batch: DataFrame, _batch_id: int) -> None:
        rows = stage(batch.withColumn("closed", F.lit(True)), "split")
        spark = rows.sparkSession
        write_bars(rows.filter("kind = 'minute'").withColumn("emit_ts", F.col("close_ts")), minute_root)
        bars = rows.filter("kind = 'bar'")
        if not bars.isEmpty():
            write_bars(bars, bar_root)
        fixes = rows.filter("kind = 'fix'").groupBy("symbol", "timeframe", "bucket").agg(F.max("emit_ts").alias("emit_ts"))
        if fixes.isEmpty():
            return
        made = stage(remade(open_table(spark, minute_root), fixes, timeframes), "remade")
        # a calendar bar is labelled by its last minute, so a corrected one may replace a bar with another label
        write_bars(made, bar_root, replaces=lambda old: old.withColumn("bucket", bucket_column(timeframes)).join(
            made.select("symbol", "timeframe", "bucket"), ["symbol", "timeframe", "bucket"], "left_anti").drop("bucket"))
    return write


def run_late_loop(minutes: DataFrame, minute_root: str, bar_root: str, timeframes: list[str], checkpoint: str) -> None:
    """Process all available minutes into the two tables; with corrections they equal the batch aggregation of all minutes."""
    split = split_minutes(minutes, timeframes)
    split.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).foreachBatch(
        late_sink(minute_root, bar_root, timeframes)).start().awaitTermination()

