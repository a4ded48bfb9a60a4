"""Ticks and one-minute bars to multi-timeframe OHLCV bars.

A derived bar carries two clocks: ``close_ts`` (its label) and ``emit_ts`` (when it became
known).  They differ whenever the last one-minute bar of a bucket does not close on the boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from tidemark.functions.timekeys import as_date, bar_date, ceil_to, day_text, epoch_micros, period_start, utc_date
from tidemark.plans.chunks import CHUNK_ROWS, scan
from tidemark.plans.staging import stage
from tidemark.schema import KEYS, TIMEFRAMES, lookup

BAR_COLUMNS = [
    "symbol", "timeframe", "open_ts", "close_ts", "open", "high", "low", "close",
    "volume", "money", "open_interest", "trading_day", "closed", "emit_ts",
]


def _ohlc(order: Column) -> list[Column]:
    return [
        F.min_by("open", order).alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"), F.sum("money").alias("money"),
    ]


def ticks_to_minutes(
    ticks: DataFrame, symbol: Column, ts: Column, price: Column, tie: Column,
    volume: Column | None = None, money: Column | None = None,
) -> DataFrame:
    """One-minute bars of a tick table; ``tie`` (an integer, a whole decimal of
    at most 29 digits, or a struct) orders ticks with equal
    timestamps.

    One partially aggregated shuffle: a hot symbol is spread over its minutes, and each map task
    sends at most one row per minute.
    """
    volume = F.lit(1.0) if volume is None else volume
    micros = epoch_micros(ts)
    flat = ticks.select(
        symbol.alias("symbol"), micros.alias("_us"), tie.alias("_tie"),
        price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"),
        volume.alias("volume"), (price * volume if money is None else money).alias("money"),
    ).withColumn("close_ts", (-F.floor(-F.col("_us") / F.lit(60_000_000)) * 60).cast("bigint"))
    kind = flat.schema["_tie"].dataType
    if isinstance(kind, IntegralType) or (isinstance(kind, DecimalType) and kind.scale == 0 and kind.precision <= 29):
        # microsecond of the minute, then the tie, as one wide number: the aggregate stays hash-based
        inside = (F.col("_us") - (F.col("close_ts") - 60) * 1_000_000).cast("decimal(8,0)")
        place = inside * F.lit("1" + "0" * 29).cast("decimal(30,0)") + F.col("_tie")
    else:
        place = F.struct("_us", "_tie")
    return (
        flat.withColumn("_place", place).groupBy("symbol", "close_ts").agg(*_ohlc(F.col("_place")))
        .select("symbol", F.lit("1m").alias("timeframe"), (F.col("close_ts") - 60).alias("open_ts"),
                "close_ts", "open", "high", "low", "close", "volume", "money",
                F.lit(0.0).alias("open_interest"), F.lit(None).cast("string").alias("trading_day"),
                F.lit(True).alias("closed"), F.col("close_ts").alias("emit_ts"))
    )


def closed_only(bars: DataFrame) -> DataFrame:
    """Without the bars still in progress: they must show in no bucket."""
    return bars.filter("closed") if "closed" in bars.columns else bars


def bucketed(base: DataFrame, timeframes: list[str]) -> DataFrame:
    """Group closed base bars into buckets of every asked timeframe in one shuffle."""
    base, date = closed_only(base), bar_date()
    bucket = None
    for tf in timeframes:
        key = ceil_to("close_ts", TIMEFRAMES[tf]) if TIMEFRAMES[tf] else period_start(tf, date)
        hit = F.col("timeframe") == F.lit(tf)
        bucket = F.when(hit, key) if bucket is None else bucket.when(hit, key)
    spread = base.withColumn("timeframe", F.explode(F.array(*[F.lit(t) for t in timeframes])))
    grouped = spread.withColumn("bucket", bucket).groupBy("symbol", "timeframe", "bucket").agg(
        F.min_by("open_ts", "close_ts").alias("_first_open"), F.min("close_ts").alias("_first"),
        F.max("close_ts").alias("_last"), *_ohlc(F.col("close_ts")),
        F.max_by("open_interest", "close_ts").alias("open_interest"),
        # as a day number, so that the whole aggregate stays hash-based
        F.max_by(F.unix_date(F.col("trading_day").cast("date")), "close_ts").alias("_day"),
    )
    period = lookup(F.col("timeframe"), {t: TIMEFRAMES[t] for t in timeframes}).cast("bigint")
    fixed = period > 0
    return grouped.select(
        "symbol", "timeframe", "bucket", "_first", "_last",
        F.when(fixed, F.col("bucket") - period).otherwise(F.col("_first_open")).alias("open_ts"),
        F.when(fixed, F.col("bucket")).otherwise(F.col("_last")).alias("close_ts"),
        "open", "high", "low", "close", "volume", "money", "open_interest",
        F.when(F.col("_day").isNotNull(), day_text(as_date("_day"))).alias("trading_day"),
        (fixed & (F.col("bucket") == F.col("_last"))).alias("_on_time"),
    )


def _chunk(timeframes: list[str], rows: int) -> Column:
    """At most ``rows`` buckets per chunk: a bucket is one period (a day or more for calendar bars)."""
    span = lookup(F.col("timeframe"), {t: (TIMEFRAMES[t] or 1) * rows for t in timeframes})
    return F.floor(F.col("bucket") / span).cast("bigint")


def aggregate_all(
    base: DataFrame, timeframes: list[str], chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Every bucket including the unfinished last one (``emit_ts`` NULL, ``closed`` FALSE).

    A bucket is known at its label when a base bar closes exactly there, else when the symbol's
    next base bar arrives, which is the first base bar of the next bucket.
    """
    return _known(stage(bucketed(base, timeframes), "buckets"), _chunk(timeframes, chunk_rows))


def _known(grouped: DataFrame, chunk: Column) -> DataFrame:
    """Buckets with the moment at which each becomes known."""
    known = scan(grouped, KEYS, ["bucket"], chunk, {"_next": ("lead", "_first")})
    emit = F.when(F.col("_on_time"), F.col("close_ts")).otherwise(F.col("_next"))
    return known.withColumns({"emit_ts": emit, "closed": emit.isNotNull()}).select(*BAR_COLUMNS)


def aggregate(base: DataFrame, timeframes: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Closed derived bars."""
    return aggregate_all(base, timeframes, chunk_rows).filter("closed")


def pending(base: DataFrame, timeframes: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The bucket still being built, per series."""
    return aggregate_all(base, timeframes, chunk_rows).filter(~F.col("closed"))


def flush(bars: DataFrame) -> DataFrame:
    """Treat a finite input as complete: the last bucket counts as closed."""
    return bars.withColumns({
        "emit_ts": F.coalesce("emit_ts", "close_ts"), "closed": F.lit(True)})


def bar_series(
    base: DataFrame, timeframes: list[str], with_base: bool = False, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Closed derived bars (and the base bars themselves) as an indexed table, in one scan.

    Same result as ``index_bars(aggregate(...))``: the emission clock, the row number and the
    neighbours come out of one pass over the buckets.
    """
    grouped = bucketed(base, timeframes)
    all_tfs = list(timeframes)
    if with_base:
        own = closed_only(base).select(
            "symbol", "timeframe", F.col("close_ts").alias("bucket"), F.col("close_ts").alias("_first"),
            F.col("close_ts").alias("_last"), "open_ts", "close_ts", "open", "high", "low", "close", "volume", "money",
            "open_interest", "trading_day", F.lit(True).alias("_on_time"))
        grouped = grouped.unionByName(own)
        all_tfs.append("1m")
    return _indexed(stage(grouped, "buckets"), _chunk(all_tfs, chunk_rows))


def _indexed(grouped: DataFrame, chunk: Column) -> DataFrame:
    """Closed bars of the buckets with row number and neighbours, as a staged table."""
    out = scan(grouped, KEYS, ["bucket"], chunk, {
        "rn": ("count", "bucket"), "prev_close": ("lag", "close"), "next_open": ("lead", "open"),
        "next_close_ts": ("lead", "close_ts"), "_next_first": ("lead", "_first"),
        "_next_on_time": ("lead", "_on_time"), "_next_bucket": ("lead", "bucket"), "_final": ("overall", "bucket")})
    emit = F.when(F.col("_on_time"), F.col("close_ts")).otherwise(F.col("_next_first"))
    # the last bucket of a series is unfinished unless it was on time, and is nobody's neighbour
    real = F.col("_next_on_time") | (F.col("_next_bucket") < F.col("_final"))
    out = out.withColumns({
        "emit_ts": emit, "closed": F.lit(True),
        "next_open": F.when(real, F.col("next_open")), "next_close_ts": F.when(real, F.col("next_close_ts"))})
    closed = out.filter("emit_ts IS NOT NULL")
    return stage(closed.select(*BAR_COLUMNS, "rn", "prev_close", "next_open", "next_close_ts"), "series")


# ------------------------------------------------------------------ calendar bars straight from ticks

CHUNK_DAYS = 256


def _calendar_buckets(
    ticks: DataFrame, symbol: Column, ts: Column, price: Column, tie: Column, timeframes: list[str],
    volume: Column | None, money: Column | None, chunk_days: int,
) -> DataFrame:
    """Days, weeks and months (UTC) of a tick table, with the chunk (``_days``) that each bucket lies in.

    The narrow ticks are exchanged once, by series and chunk; the grouping, the windows of ``scan`` and its join
    back all keep that partitioning and its order."""
    volume = F.lit(1.0) if volume is None else volume
    raw = ticks.select(
        symbol.alias("symbol"), epoch_micros(ts).alias("_us"), tie.alias("_tie"), price.alias("_price"), volume.alias("_volume"),
        (price * volume if money is None else money).alias("_money"), F.explode(F.array(*[F.lit(t) for t in timeframes])).alias("timeframe"))

    def with_bucket(df: DataFrame) -> DataFrame:
        df = df.withColumn("_minute", (-F.floor(-F.col("_us") / F.lit(60_000_000)) * 60).cast("bigint"))
        bucket = None
        for tf in timeframes:
            key, hit = period_start(tf, utc_date("_minute")), F.col("timeframe") == F.lit(tf)
            bucket = F.when(hit, key) if bucket is None else bucket.when(hit, key)
        return df.withColumn("bucket", bucket)

    days = F.floor(F.col("bucket") / chunk_days).cast("bigint")
    dealt = with_bucket(raw).withColumn("_days", days).drop("bucket", "_minute").filter("symbol IS NOT NULL AND _days IS NOT NULL").repartition(*KEYS, "_days")
    place = F.struct("_us", "_tie")
    grouped = with_bucket(dealt).groupBy(*KEYS, "_days", "bucket").agg(
        F.min("_minute").alias("_first"), F.max("_minute").alias("_last"), F.min_by("_price", place).alias("open"), F.max("_price").alias("high"),
        F.min("_price").alias("low"), F.max_by("_price", place).alias("close"), F.sum("_volume").alias("volume"), F.sum("_money").alias("money"),
        F.count(F.lit(1)).alias("n"))
    # true of every bucket: both readings of ``scan`` then ask for the same columns and share the one exchange
    grouped = grouped.filter((F.col("n") > 0) | F.col("open").isNotNull() | F.col("volume").isNotNull() | F.col("money").isNotNull())
    return grouped.select(
        *KEYS, "_days", "bucket", "_first", "_last", (F.col("_first") - 60).alias("open_ts"), F.col("_last").alias("close_ts"),
        "open", "high", "low", "close", "volume", "money", F.lit(0.0).alias("open_interest"), F.lit(None).cast("string").alias("trading_day"),
        F.lit(False).alias("_on_time"))


def calendar_series(
    ticks: DataFrame, symbol: Column, ts: Column, price: Column, tie: Column, timeframes: list[str],
    volume: Column | None = None, money: Column | None = None, chunk_days: int = CHUNK_DAYS,
) -> DataFrame:
    """Same bars as ``bar_series(ticks_to_minutes(...), timeframes)`` of days, weeks and months: for ticks so sparse that
    minutes hardly shrink them, since every tick of a series' ``chunk_days`` meets in one task."""
    return _indexed(_calendar_buckets(ticks, symbol, ts, price, tie, timeframes, volume, money, chunk_days), F.col("_days"))


def calendar_bars(
    ticks: DataFrame, symbol: Column, ts: Column, price: Column, tie: Column, timeframes: list[str],
    volume: Column | None = None, money: Column | None = None, chunk_days: int = CHUNK_DAYS,
) -> DataFrame:
    """Same bars as ``aggregate_all(ticks_to_minutes(...), timeframes)``, as ``calendar_series`` gets them."""
    return _known(_calendar_buckets(ticks, symbol, ts, price, tie, timeframes, volume, money, chunk_days), F.col("_days"))


def index_bars(bars: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number each series and attach its neighbours, as a staged table.

    Adds ``rn`` (from 1), ``prev_close``, ``next_open`` and ``next_close_ts``.  Everything built
    on a bar series (frames, recurrences, outcome labels) starts from this table.
    """
    bars = stage(bars, "bars")
    span = lookup(F.col("timeframe"), {t: (s or 86400) * chunk_rows for t, s in TIMEFRAMES.items()})
    out = scan(bars, KEYS, ["close_ts"], F.floor(F.col("close_ts") / span).cast("bigint"), {
        "rn": ("count", "close_ts"), "prev_close": ("lag", "close"),
        "next_open": ("lead", "open"), "next_close_ts": ("lead", "close_ts"),
    })
    return stage(out, "series")
