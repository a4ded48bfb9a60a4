"""Symbols, calendars, segments and universes as checked dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.small import broadcast_if_small


def missing_calendars(symbols: DataFrame, calendars: DataFrame) -> DataFrame:
    """Symbols that name a calendar that is not defined."""
    return symbols.join(calendars.select("calendar"), "calendar", "left_anti")


def duplicate_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def tradable(symbols: DataFrame) -> DataFrame:
    """Stitched continuous series can be charted but not traded or alerted on."""
    return symbols.filter(~F.col("is_continuous"))


def missing_mapping(symbols: DataFrame, field: str) -> DataFrame:
    return symbols.filter(F.col(field).isNull() | (F.col(field) == ""))


def with_dimension(df: DataFrame, dim: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Attach dimension columns; broadcast only when the dimension is small."""
    return df.join(broadcast_if_small(dim), on, how)


def parse_segments(rows: DataFrame) -> DataFrame:
    """Main-contract rows to (product, contract, start_day, end_day)."""
    return rows.select(
        F.col("main_variety_code").alias("product"), F.col("variety_code").alias("contract"),
        F.substring("start_date", 1, 10).alias("start_day"), F.substring("end_date", 1, 10).alias("end_day"))


def overlapping_segments(segments: DataFrame) -> DataFrame:
    """Segments that start before the previous one of their product has ended."""
    w = Window.partitionBy("product").orderBy("start_day", "contract")  # a product has few segments
    return (segments.withColumns({"prev_contract": F.lag("contract").over(w), "prev_end": F.lag("end_day").over(w)})
            .filter(F.col("start_day") <= F.col("prev_end")))


def check_segments(segments: DataFrame) -> DataFrame:
    """Raise on an empty or overlapping main-contract calendar."""
    if segments.isEmpty():
        raise ValueError("no main-contract segments; ask with the product's index code")
    bad = overlapping_segments(segments).limit(1).collect()
    if bad:
        raise ValueError(f"main-contract segments overlap: {bad[0].prev_contract} and {bad[0].contract}")
    return segments


def sync_universe(products: DataFrame, calendar_of: DataFrame, mains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tradable universe from product rows, the product-to-calendar map and main-contract rows;
    and the dropped products with the reason.  A missing tick or multiplier is never defaulted."""
    complete = (F.coalesce("price_tick", F.lit(0.0)) != 0) & (F.coalesce("multiplier", F.lit(0.0)) != 0)
    latest = mains.groupBy("product").agg(F.max_by("contract", F.struct("start_date", "contract")).alias("code"))
    full = (products.withColumn("_ok", complete).join(calendar_of, "product", "left").join(latest, "product", "left"))
    reason = (F.when(~F.col("_ok"), "incomplete").when(F.col("calendar").isNull(), "no calendar")
              .when(F.col("code").isNull(), "no main contract"))
    judged = full.withColumn("reason", reason)
    universe = judged.filter("reason IS NULL").select(
        F.concat_ws(".", F.lit("CN"), "exchange", "code").alias("uid"), F.lit("CN").alias("market"),
        "exchange", "code", "calendar", "price_tick", "multiplier", "product")
    return universe, judged.filter("reason IS NOT NULL").select("product", "reason")


def expand_universe(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Universe items (rule_id, pos, item) to distinct tradable symbols in first-seen order.

    ``CN.*`` matches every tradable symbol under that prefix; both sides are joined on their first
    name segment, so the prefix test runs only inside one market."""
    wild = F.col("item").endswith(".*")
    head = F.split("item", r"\.")[0]
    names = tradable(symbols).select(F.col("uid"), F.split("uid", r"\.")[0].alias("_head"))
    prefix = F.expr("substring(item, 1, length(item) - 1)")
    starred = (items.filter(wild).withColumn("_head", head).join(names, "_head")
               .filter(F.col("uid").startswith(prefix)).select("rule_id", "pos", "item", F.col("uid").alias("symbol")))
    plain = items.filter(~wild).select("rule_id", "pos", "item", F.col("item").alias("symbol"))
    return starred.unionByName(plain).groupBy("rule_id", "symbol").agg(F.min("pos").alias("pos"))


def unmatched_items(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Wildcards without any match: a rule must not end up watching nothing unnoticed."""
    wild = items.filter(F.col("item").endswith(".*"))
    names = tradable(symbols).select(F.split("uid", r"\.")[0].alias("_head"), "uid")
    hit = (wild.withColumn("_head", F.split("item", r"\.")[0]).join(names, "_head")
           .filter(F.col("uid").startswith(F.expr("substring(item, 1, length(item) - 1)"))))
    return wild.join(hit.select("rule_id", "item").distinct(), ["rule_id", "item"], "left_anti")
