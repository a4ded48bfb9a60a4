"""The stored bar table: scans, coverage, upsert, compaction.

Layout: ``market / timeframe / part`` directories, where part is a day for intraday bars and a year
for calendar bars.  Range scans prune directories; inside a part rows are sorted by symbol and
close, so the footer statistics skip other symbols, and the number of directories does not grow
with the number of symbols.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import LOOK_AHEAD
from tidemark.functions.timekeys import bar_date, day_text, market_of, partition_key
from tidemark.plans.chunks import CHUNK_ROWS, scan
from tidemark.plans.staging import stage
from tidemark.schema import BAR_SCHEMA, KEYS, TIMEFRAMES, lookup, seconds_of

PARTS = ["market", "timeframe", "part"]
MAX_LISTED_PARTS = 2_000
STORED = [c.split()[0] for c in BAR_SCHEMA.split(", ")]


def bar_problem(open_ts: Column, close_ts: Column, high: Column, low: Column) -> Column:
    """NULL for a valid bar, else what is wrong with it."""
    return F.when(close_ts <= open_ts, "close_not_after_open").when(low > high, "low_above_high")


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid bars, and the quarantine with its reason."""
    p = bar_problem(F.col("open_ts"), F.col("close_ts"), F.col("high"), F.col("low"))
    marked = bars.withColumn("problem", p)
    return marked.filter("problem IS NULL").drop("problem"), marked.filter("problem IS NOT NULL")


# ------------------------------------------------------------------ reading

def open_table(spark: SparkSession, root: str) -> DataFrame:
    parts = "market string, part string"
    return spark.read.schema(f"{BAR_SCHEMA}, {parts}").option("basePath", root).parquet(root)


def newest_per_key(df: DataFrame, version: str = "version") -> DataFrame:
    """Later write wins per (symbol, timeframe, close_ts); a partially aggregated max."""
    rest = [c for c in df.columns if c not in (*KEYS, "close_ts")]
    best = df.groupBy(*KEYS, "close_ts").agg(F.max_by(F.struct(*rest), version).alias("_r"))
    return best.select(*KEYS, "close_ts", *[F.col(f"_r.{c}").alias(c) for c in rest])


def read_range(bars: DataFrame, symbol: str, timeframe: str, start: int, end: int) -> DataFrame:
    """Bars with ``start < close_ts <= end``; a stored table also prunes its day or year parts, wider by
    the calendar's look-ahead because a part is the trading day that a bar counts for."""
    df = bars.filter((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))
    df = df.filter((F.col("close_ts") > start) & (F.col("close_ts") <= end))
    if "part" in bars.columns and abs(start) < 2**40 and end < 2**40:
        width = 4 if TIMEFRAMES[timeframe] == 0 else 10
        lo, hi = (F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), d), "yyyy-MM-dd")
                  for d in (max(start, 0) // 86400 - 4, end // 86400 + LOOK_AHEAD + 2))
        df = df.filter(F.col("part").between(F.substring(lo, 1, width), F.substring(hi, 1, width)))
    return df


def read_tail(bars: DataFrame, symbol: str, timeframe: str, n: int) -> DataFrame:
    """Last ``n`` bars of one series (a top-n: each task keeps n rows)."""
    df = bars.filter((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))
    return df.orderBy(F.desc("close_ts")).limit(n)


def tails(bars: DataFrame, n: int) -> DataFrame:
    """Last ``n`` bars of every series, by row number from the end of an indexed table."""
    last = bars.groupBy(*KEYS).agg(F.max("rn").alias("_last"))
    return bars.join(last, KEYS).filter(F.col("rn") > F.col("_last") - n).drop("_last")


def read_close_ts(bars: DataFrame, symbol: str, timeframe: str) -> DataFrame:
    df = bars.filter((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))
    return df.select("close_ts").distinct()


def count_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def partition_span(bars: DataFrame) -> DataFrame:
    day = day_text(bar_date())
    return bars.groupBy(*KEYS).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def replay(bars: DataFrame, symbols: list[str], start: int, end: int) -> DataFrame:
    """One-minute bars of several symbols in replay order."""
    df = bars.filter((F.col("timeframe") == "1m") & F.col("symbol").isin(*symbols))
    return df.filter((F.col("close_ts") > start) & (F.col("close_ts") <= end)).orderBy("close_ts", "symbol")


def replay_stream(spark: SparkSession, root: str, symbols: list[str]) -> DataFrame:
    """The same files as a stream."""
    df = spark.readStream.schema(f"{BAR_SCHEMA}, market string, part string").parquet(root)
    return df.filter((F.col("timeframe") == "1m") & F.col("symbol").isin(*symbols)).select(*STORED)


def covered_span(bars: DataFrame) -> DataFrame:
    return bars.agg(F.min("close_ts").alias("first_ts"), F.max("close_ts").alias("last_ts"))


def backfill_plan(requests: DataFrame, bars: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Requests (symbol, timeframe, start_day, end_day) not yet covered at both ends, by the bars or by their ``covered_spans``."""
    span = partition_span(bars) if spans is None else spans.select(*KEYS, "first_day", "last_day")
    done = requests.join(span, KEYS).filter(
        (F.col("first_day") <= F.col("start_day")) & (F.col("last_day") >= F.col("end_day")))
    return requests.join(done.select(*KEYS, "start_day", "end_day"), [*KEYS, "start_day", "end_day"], "left_anti")


def gaps(bars: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Neighbouring bars more than one period apart."""
    period = seconds_of(F.col("timeframe"))
    span = lookup(F.col("timeframe"), {t: (s or 86400) * chunk_rows for t, s in TIMEFRAMES.items()})
    near = scan(bars.select(*KEYS, "close_ts"), KEYS, ["close_ts"],
                F.floor(F.col("close_ts") / span).cast("bigint"), {"prev_ts": ("lag", "close_ts")})
    return near.withColumn("width", F.col("close_ts") - F.col("prev_ts")).filter(F.col("width") > period)


def missing_spans(cursor: DataFrame, incoming: DataFrame, period: int) -> DataFrame:
    """What lies between the stored cursor (symbol, last_ts) and the first incoming bar."""
    first = incoming.groupBy("symbol").agg(F.min("close_ts").alias("first_new"))
    return (cursor.join(first, "symbol").filter(F.col("first_new") > F.col("last_ts") + period)
            .select("symbol", F.col("last_ts").alias("missing_from"), F.col("first_new").alias("missing_to"),
                    (F.col("first_new") - period).alias("backfill_end")))


# ------------------------------------------------------------------ coverage

COVERAGE = "_coverage"  # Spark's readers skip folders with this start
SPAN_CHARS = 7  # coverage rows of one month (year, for calendar bars) share a folder


def _covered(rows: DataFrame) -> DataFrame:
    """(symbol, first, last, first_day, last_day, rows) of every part in ``rows``."""
    day = day_text(bar_date())
    return rows.groupBy(*PARTS, "symbol").agg(
        F.min("close_ts").alias("first_ts"), F.max("close_ts").alias("last_ts"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.count(F.lit(1)).alias("rows")).withColumn("span", F.substring("part", 1, SPAN_CHARS))


def open_coverage(spark: SparkSession, root: str) -> DataFrame | None:
    schema = "symbol string, first_ts bigint, last_ts bigint, first_day string, last_day string, rows bigint, part string, market string, timeframe string, span string"
    try:
        return spark.read.schema(schema).parquet(f"{root}/{COVERAGE}")
    except Exception as e:  # a table without bars, or from before there was a coverage
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _keep_coverage(written: DataFrame, root: str) -> None:
    """Replace the coverage of the parts in ``written`` (all their rows); other parts of their months are carried over."""
    new = stage(_covered(written), "coverage")
    have = open_coverage(new.sparkSession, root)
    if have is not None:
        touched = new.select(*PARTS, "span").distinct()
        spans = [r.span for r in touched.select("span").distinct().limit(MAX_LISTED_PARTS + 1).collect()]
        near = have.filter(F.col("span").isin(spans)) if len(spans) <= MAX_LISTED_PARTS else have
        same = near.join(touched.select("market", "timeframe", "span").distinct(), ["market", "timeframe", "span"], "left_semi")
        new = stage(same.join(touched.select(*PARTS), PARTS, "left_anti").select(*new.columns).unionByName(new), "coverage")
    folders = ["market", "timeframe", "span"]
    (new.hint("rebalance", *folders).sortWithinPartitions(*folders, "symbol", "part").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(f"{root}/{COVERAGE}"))


def rebuild_coverage(spark: SparkSession, root: str) -> None:
    """From the bars, for a table written before there was a coverage or left between its two writes."""
    _covered(open_table(spark, root)).write.mode("overwrite").partitionBy("market", "timeframe", "span").parquet(f"{root}/{COVERAGE}")


def covered_spans(coverage: DataFrame) -> DataFrame:
    """Per series: first and last day and close, and the number of bars, without opening the bars."""
    return coverage.groupBy(*KEYS).agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"), F.sum("rows").alias("n"))


def tail_of(spark: SparkSession, root: str, symbol: str, timeframe: str, n: int) -> DataFrame:
    """Last ``n`` bars of one stored series: the coverage names the newest parts that hold them, and only those are opened."""
    market = symbol.split(".")[0]
    coverage = open_coverage(spark, root)
    if coverage is None:
        return read_tail(open_table(spark, root), symbol, timeframe, n)
    mine = coverage.filter((F.col("market") == market) & (F.col("timeframe") == timeframe) & (F.col("symbol") == symbol))
    parts, found = [], 0
    for r in mine.select("part", "rows").orderBy(F.desc("part")).limit(n).collect():  # a part holds a bar at least
        if found >= n:
            break
        parts.append(r.part)
        found += r["rows"]
    bars = open_table(spark, root).filter((F.col("market") == market) & F.col("part").isin(parts))
    return read_tail(bars, symbol, timeframe, n)


# ------------------------------------------------------------------ writing

def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new bars with the new ones winning per close."""
    both = old.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)), allowMissingColumns=True)
    return newest_per_key(both).drop("version")


def _laid_out(bars: DataFrame) -> DataFrame:
    keyed = bars.filter("closed").select(*STORED).withColumns({"market": market_of(), "part": partition_key()})
    # adaptive execution merges small parts and splits one that is too large for a single file
    return keyed.hint("rebalance", *PARTS).sortWithinPartitions(*PARTS, "symbol", "close_ts")


def _parts_read(have: DataFrame, new: DataFrame) -> DataFrame:
    """Stored bars of the parts that ``new`` touches; a batch of few parts names them, which prunes the scan."""
    touched = new.select(*PARTS).distinct()
    listed = touched.limit(MAX_LISTED_PARTS + 1).collect()
    if len(listed) <= MAX_LISTED_PARTS:
        for c in PARTS:
            have = have.filter(F.col(c).isin(sorted({r[c] for r in listed})))
    return have.join(touched, PARTS, "left_semi")


def write_bars(bars: DataFrame, root: str, arrival: str | None = None, replaces: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Idempotent upsert of closed bars: only the parts that receive bars are read and rewritten.

    Open bars are left out before anything else, so that none displaces a stored closed bar.  Of several
    bars with one key the last by the column ``arrival`` wins; without it, the greatest by values.
    ``replaces`` gets the stored bars of those parts and returns the ones that stay."""
    spark = bars.sparkSession
    order = F.struct(*([arrival] if arrival else []), "open_ts", "open", "high", "low", "close", "volume", "money")
    new = stage(newest_per_key(bars.filter("closed").withColumn("version", order)).drop("version")
                .withColumns({"market": market_of(), "part": partition_key()}), "upsert")
    try:
        have = open_table(spark, root)
    except Exception as e:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = None
    if have is None:
        merged = new
    else:
        old = _parts_read(have, new)
        old = replaces(old) if replaces else old
        merged = stage(merge(old.select(*STORED), new.select(*STORED)), "merged")
    (_laid_out(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy(*PARTS).parquet(root))
    _keep_coverage(merged.filter("closed").withColumns({"market": market_of(), "part": partition_key()}), root)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Multiset equality: every distinct row as often on either side, in one exchange."""
    both = a.withColumn("_n", F.lit(1)).union(b.select(*a.columns).withColumn("_n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0").isEmpty()


def compact(spark: SparkSession, root: str, target: str) -> DataFrame:
    """Rewrite a bar table into few sorted files at ``target`` and verify it row by row.

    The old files are left for the caller to drop once the new table is in use."""
    src = open_table(spark, root).select(*STORED)
    wanted = stage(newest_per_key(src.withColumn("version", F.lit(1))).drop("version").select(*STORED), "compact")
    _laid_out(wanted).write.mode("errorifexists").option("compression", "zstd").partitionBy(*PARTS).parquet(target)
    rebuild_coverage(spark, target)
    written = open_table(spark, target).select(*STORED)
    if not same_rows(written, wanted):
        raise RuntimeError(f"compaction of {root} does not match its input; {target} must not be used")
    return written


__all__ = [
    "backfill_plan", "bar_problem", "compact", "count_bars", "covered_span", "covered_spans", "gaps", "merge", "open_coverage",
    "missing_spans", "newest_per_key", "open_table", "partition_span", "read_close_ts", "read_range",
    "read_tail", "rebuild_coverage", "replay", "replay_stream", "same_rows", "split_valid", "tail_of", "tails", "write_bars"]
