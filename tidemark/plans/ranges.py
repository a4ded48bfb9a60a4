"""Scans over one global order, however many rows share a moment.

A chunk by clock puts all rows of an hour into one task.  Here boundaries are sampled from the rows (Spark's range
partitioning over the whole order, ties included), every range is scanned by itself, and what a range inherits comes from
a table with one row per range and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.chunks import scan
from tidemark.plans.staging import stage

RANGE_ROWS = 65_536
_RANGE = "_range"


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` written in sampled ranges of ``order``, numbered in the column ``_range``; equal values of the whole order stay together."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(ranges, *order).withColumn(_RANGE, F.spark_partition_id().cast("bigint")), "ranges")


def range_scan(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, tuple[str, Column | str]],
               exclusive: bool = False, ranges: int | None = None) -> DataFrame:
    """``plans.chunks.scan`` over sampled ranges of (keys, order); ``order`` is unique within a key."""
    cut = in_ranges(df, [*keys, *order], ranges)
    return scan(cut, keys, order, F.col(_RANGE), specs, exclusive).drop(_RANGE)


def bracketed_median(df: DataFrame, keys: list[str], value: str, out: str, accuracy: int = 1000) -> DataFrame:
    """Exact median per key: a mergeable sketch brackets the middle, rows below it are only counted, and ranks are
    taken of the values inside, merged where equal and spread over sampled ranges.  Where a bracket should miss the middle it is
    widened to all values."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    near = 2.0 / accuracy
    hist = stage(rows.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n")), "hist")
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_x", [0.5 - near, 0.5 + near], accuracy).alias("_b"))
    placed = hist.join(sketch, keys).select(*keys, "_x", "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    below, inside = F.col("_x") < F.col("_lo"), F.col("_x").between(F.col("_lo"), F.col("_hi"))
    sizes = placed.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.sum(F.when(below, F.col("_n")).otherwise(0)).alias("_below"), F.sum(F.when(inside, F.col("_n")).otherwise(0)).alias("_inside"))
    first, last = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    held = (F.col("_below") < first) & (F.col("_below") + F.col("_inside") >= last)
    sizes = sizes.select(*keys, first.alias("_first"), last.alias("_last"), held.alias("_held"), F.when(held, F.col("_below")).otherwise(0).alias("_before"))
    asked = placed.join(sizes, keys).filter(~F.col("_held") | inside)
    ranked = range_scan(asked, keys, ["_x"], {"_upto": ("sum", "_n")})
    upto = F.col("_before") + F.col("_upto")
    middle = (upto - F.col("_n") < F.col("_last")) & (upto >= F.col("_first"))
    return ranked.filter(middle).groupBy(*keys).agg(((F.min("_x") + F.max("_x")) / 2).alias(out))
