"""Continuous contracts: roll anchors, back-adjustment, stitched series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timekeys import bar_date, day_text
from tidemark.plans.chunks import scan
from tidemark.plans.small import broadcast_if_small
from tidemark.plans.staging import stage


def _by_start():
    return Window.partitionBy("product").orderBy("start_day", "contract")  # few segments per product


def slice_by_segment(segments: DataFrame, bars: DataFrame) -> DataFrame:
    """Contract bars inside the days their contract was the main one (by trading day)."""
    day = F.coalesce("trading_day", day_text(bar_date()))
    seg = broadcast_if_small(segments.withColumnRenamed("contract", "symbol"))
    return (bars.withColumn("day", day).join(seg, "symbol")
            .filter(F.col("day").between(F.col("start_day"), F.col("end_day"))))


def anchors(segments: DataFrame, bars: DataFrame) -> DataFrame:
    """Per roll and timeframe: the last bar both contracts share before the new one takes over, and the spread
    there.  A roll without a common bar has a NULL anchor."""
    w = _by_start()
    pairs = stage(segments.withColumns({
        "to_contract": F.lead("contract").over(w), "at_day": F.lead("start_day").over(w)})
        .filter("to_contract IS NOT NULL")
        .select("product", F.col("contract").alias("from_contract"), "to_contract", "at_day", "start_day"), "rolls")
    day = F.coalesce("trading_day", day_text(bar_date()))
    px = bars.select("symbol", "timeframe", "close_ts", "close", day.alias("day"))
    small = broadcast_if_small(pairs)
    old = px.join(small.withColumnRenamed("from_contract", "symbol"), "symbol").filter(F.col("day") < F.col("at_day")).select(
        "product", F.col("symbol").alias("from_contract"), "to_contract", "timeframe", "close_ts", F.col("close").alias("old_close"))
    new = px.select(F.col("symbol").alias("to_contract"), "timeframe", "close_ts", F.col("close").alias("new_close"))
    found = old.join(new, ["to_contract", "timeframe", "close_ts"]).groupBy("product", "from_contract", "to_contract", "timeframe").agg(
        F.max("close_ts").alias("anchor_ts"),
        F.max_by(F.col("new_close") - F.col("old_close"), "close_ts").alias("diff"))
    # every roll has a row for each timeframe of its contracts, with or without a common bar
    kinds = bars.select(F.col("symbol").alias("_c"), "timeframe").distinct()
    asked = pairs.withColumn("_c", F.explode(F.array("from_contract", "to_contract"))).join(kinds, "_c", "left").drop("_c").distinct()
    has = F.max(F.col("timeframe").isNotNull()).over(Window.partitionBy("product", "from_contract", "to_contract", "at_day"))
    asked = asked.withColumn("_has", has).filter("timeframe IS NOT NULL OR NOT _has").drop("_has")
    return asked.join(found, ["product", "from_contract", "to_contract", "timeframe"], "left")


def rollovers(segments: DataFrame, bars: DataFrame) -> DataFrame:
    """Rolls by timeframe, with the cumulative shift that applies to the old contract and all before it."""
    after = Window.partitionBy("product", "timeframe").orderBy("start_day").rowsBetween(0, Window.unboundedFollowing)
    return anchors(segments, bars).withColumn("cum_offset", F.sum("diff").over(after)).drop("start_day")


def stitch(segments: DataFrame, bars: DataFrame, adjust: bool = True, rolls: DataFrame | None = None) -> DataFrame:
    """One back-adjusted series per product and timeframe: prices shifted, volume not, newest contract as is."""
    pieces = slice_by_segment(segments, bars)
    if adjust:
        rolls = rollovers(segments, bars) if rolls is None else rolls
        shift = rolls.select("product", F.col("from_contract").alias("symbol"), "timeframe", F.col("cum_offset").alias("offset"))
        pieces = pieces.join(broadcast_if_small(shift), ["product", "symbol", "timeframe"], "left")
        offset = F.coalesce("offset", F.lit(0.0))
    else:
        offset = F.lit(0.0)
    moved = [(F.col(c) + offset).alias(c) for c in ("open", "high", "low", "close")]
    return pieces.select(
        F.col("product").alias("symbol"), F.col("symbol").alias("contract"), "timeframe", "open_ts", "close_ts",
        *moved, "volume", "money", "open_interest", F.col("day").alias("trading_day"), offset.alias("offset"))


CHUNK_DAYS = 32  # of the order check: a day of one-minute bars has some hundreds of rows


def stitch_problems(segments: DataFrame, bars: DataFrame, rolls: DataFrame, stitched: DataFrame,
                    chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """Everything that makes a stitched series unusable: (symbol, problem, detail)."""
    no_bars = segments.join(bars.select(F.col("symbol").alias("contract")).distinct(), "contract", "left_anti").select(
        F.col("product").alias("symbol"), F.lit("contract without data").alias("problem"), F.col("contract").alias("detail"))
    covered = slice_by_segment(segments, bars).select("product", F.col("symbol").alias("contract")).distinct()
    empty = segments.join(covered, ["product", "contract"], "left_anti").select(
        F.col("product").alias("symbol"), F.lit("segment without bars").alias("problem"), F.col("contract").alias("detail"))
    unanchored = rolls.filter("diff IS NULL").select(
        F.col("product").alias("symbol"), F.lit("no common bar").alias("problem"), F.col("at_day").alias("detail"))
    negative = stitched.filter((F.col("offset") != 0) & (F.col("low") <= 0)).groupBy("symbol").agg(
        F.min("trading_day").alias("detail")).select("symbol", F.lit("non-positive price").alias("problem"), "detail")
    # chunks follow the order, by trading day, so that a break between two of them shows as well
    chunk = F.floor(F.unix_date(F.col("trading_day").cast("date")) / chunk_days).cast("bigint")
    ordered = scan(stitched.select("symbol", "timeframe", "close_ts", "trading_day"), ["symbol", "timeframe"], ["trading_day", "close_ts"],
                   chunk, {"_before": ("lag", "close_ts")})
    back = ordered.filter(F.col("close_ts") <= F.col("_before")).groupBy("symbol").agg(
        F.min("trading_day").alias("detail")).select("symbol", F.lit("time not increasing").alias("problem"), "detail")
    return no_bars.unionByName(empty).unionByName(unanchored).unionByName(negative).unionByName(back)


def contracts_needed(segments: DataFrame) -> DataFrame:
    """Distinct contracts in the order they were first main."""
    return segments.groupBy("product", "contract").agg(F.min("start_day").alias("first_day"))


def rollover_index(rolls: DataFrame) -> DataFrame:
    return rolls.select("product", "timeframe", "at_day", "from_contract", "to_contract", "anchor_ts", "diff", "cum_offset")


def write_stitched(bars: DataFrame, rolls: DataFrame, root: str) -> None:
    """The stitched series and, next to it, the rolls that explain its prices."""
    # adaptive execution splits a product that is too large for one file
    bars.hint("rebalance", "symbol").sortWithinPartitions("symbol", "close_ts").write.mode("overwrite").partitionBy("symbol").parquet(f"{root}/bars")
    rollover_index(rolls).write.mode("overwrite").parquet(f"{root}/rollovers")
