"""Tables a dashboard reads: markers, watchlist, freshness, intraday line, overlays, crosschecks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timekeys import CN_OFFSET, bar_date, day_text, ceil_to
from tidemark.operators.asof import align_by_close, asof
from tidemark.operators.frame import Frame
from tidemark.operators.rules import PRIORITY_RANK
from tidemark.plans.chunks import scan, time_chunk
from tidemark.plans.ranges import range_scan
from tidemark.plans.staging import stage
from tidemark.schema import KEYS, TIMEFRAMES, lookup, rank_of

STALE_PERIODS = 2.5  # fixed value: missed periods before a live series counts as stale
SLOTS = 9  # fixed value: watchlist size
EMA_WARMUP = 20  # fixed value: warm-up windows after which an EMA seed no longer shows


# ------------------------------------------------------------------ ranking and markers

def coerce_priority(p: Column) -> Column:
    """Anything unknown counts as normal."""
    clean = F.lower(F.trim(p))
    return F.when(clean.isin(*PRIORITY_RANK), clean).otherwise("normal")


def priority_rank(p: Column) -> Column:
    return lookup(coerce_priority(p), PRIORITY_RANK).cast("bigint")


def rank_key(chain_len: Column | None = None) -> list[Column]:
    """Sort key of signals that share a bar: confirmed first, then priority, larger timeframe,
    longer chain, rule id."""
    length = F.lit(1) if chain_len is None else chain_len
    return [F.coalesce("tentative", F.lit(False)).alias("k1"), (-priority_rank(F.col("priority"))).alias("k2"),
            (-rank_of(F.col("timeframe"))).alias("k3"), (-length).alias("k4"), F.col("rule_id").alias("k5"),
            F.col("dedup_key").alias("k6")]


def place_signals(signals: DataFrame, bars: DataFrame, timeframe: str) -> tuple[DataFrame, DataFrame]:
    """Signals with the bar they fall on, and those without such a bar.

    Fixed periods use the bucket label; calendar periods the first bar closing at or after."""
    closes = bars.filter(F.col("timeframe") == timeframe).select("symbol", "close_ts").distinct()
    if TIMEFRAMES[timeframe]:
        marked = signals.withColumn("bucket_ts", ceil_to("fired_at", TIMEFRAMES[timeframe]))
        on = closes.withColumnRenamed("close_ts", "bucket_ts")
        return (marked.join(on, ["symbol", "bucket_ts"], "left_semi").select(*signals.columns, "bucket_ts"),
                marked.join(on, ["symbol", "bucket_ts"], "left_anti").select(*signals.columns))
    closes = stage(closes, "closes")
    found = asof(signals, closes, ["symbol"], "fired_at", "close_ts", ["close_ts"], "_b", direction="forward")
    found = found.withColumn("bucket_ts", F.col("_b.close_ts")).drop("_b")
    return found.filter("bucket_ts IS NOT NULL"), found.filter("bucket_ts IS NULL").drop("bucket_ts")


def _ranked(placed: DataFrame, chain_len: dict[str, int] | None) -> DataFrame:
    length = lookup(F.col("rule_id"), chain_len, 1) if chain_len else None
    member = F.struct("rule_id", "dedup_key", "fired_at", "trigger_price",
                      coerce_priority(F.col("priority")).alias("priority"), "timeframe")
    return placed.select("symbol", "bucket_ts", "direction",
                         F.struct(F.struct(*rank_key(length)).alias("k"), member.alias("m")).alias("item"))


def collapse(placed: DataFrame, chain_len: dict[str, int] | None = None, members: bool = False) -> DataFrame:
    """One marker per (symbol, bar, direction): representative and count, a partially aggregated arg-min;
    the placed rows themselves are the detail table.

    ``members=True`` adds the ordered list of all signals of a marker, for charts of few signals."""
    aggs = [F.min("item").alias("lead"), F.count(F.lit(1)).alias("count")]
    if members:
        aggs.append(F.array_sort(F.collect_list("item")).alias("all"))
    g = _ranked(placed, chain_len).groupBy("symbol", "bucket_ts", "direction").agg(*aggs)
    return g.select("symbol", "bucket_ts", "direction", *[F.col(f"lead.m.{c}").alias(c) for c in (
        "rule_id", "dedup_key", "fired_at", "trigger_price", "priority")], "count",
        *([F.col("all.m").alias("members")] if members else []))


# ------------------------------------------------------------------ watchlist

def latest_by_symbol(signals: DataFrame) -> DataFrame:
    """The newest signal of each symbol (a partially aggregated arg-min); of several at one instant the
    first by rule, then by key."""
    rest = [c for c in signals.columns if c != "symbol"]
    newest = F.struct(-F.col("fired_at"), F.col("rule_id"), F.col("dedup_key"))
    return signals.groupBy("symbol").agg(F.min_by(F.struct(*rest), newest).alias("r")).select("symbol", "r.*")


def watchlist(pinned: DataFrame, recent: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Pinned symbols first (by pin time, never cut), then recent ones up to ``slots``.

    Lazy: the rows are range-partitioned in list order and numbered with counts carried between the ranges; of the others no more than
    ``slots`` are ever kept."""
    pins = pinned.groupBy("symbol").agg(F.min("pinned_at").alias("pinned_at"))
    joined = pins.join(recent, "symbol", "full")
    pin = F.col("pinned_at").isNotNull()
    top = joined.filter(~pin).orderBy(F.desc("fired_at"), "symbol").limit(slots)
    kept = joined.filter(pin).unionByName(top).withColumns({
        "_late": F.when(pin, 0).otherwise(1), "_at": F.coalesce("pinned_at", F.lit(0)), "_back": -F.coalesce("fired_at", F.lit(-(2**62)))})
    placed = range_scan(kept, [], ["_late", "_at", "_back", "symbol"], {"slot": ("count", "symbol")})
    return placed.filter((F.col("_late") == 0) | (F.col("slot") <= slots)).select(
        F.col("slot").cast("bigint").alias("slot"), "symbol", pin.alias("pinned"), "rule_id", "direction", "fired_at", "dedup_key", "trigger_price")


# ------------------------------------------------------------------ freshness

def freshness(bars: DataFrame, sessions: DataFrame, now_ts: int, timeframe: str = "1m",
              gap_rows: DataFrame | None = None) -> DataFrame:
    """Per symbol: last close, lag, bars seen, gaps, in session now, stale.

    ``sessions`` is (symbol, in_session) at ``now_ts``; symbols without a row are always open."""
    period = TIMEFRAMES[timeframe]
    seen = bars.filter(F.col("timeframe") == timeframe).groupBy("symbol").agg(
        F.max("close_ts").alias("last_close_ts"), F.count(F.lit(1)).alias("bars_seen"))
    out = seen.join(sessions, "symbol", "left").withColumn("in_session", F.coalesce("in_session", F.lit(True)))
    if gap_rows is not None:
        g = gap_rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"))
        out = out.join(g, "symbol", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("bigint"))
    lag = F.lit(now_ts) - F.col("last_close_ts")
    return out.withColumns({"lag_s": F.greatest(F.lit(0).cast("bigint"), lag),
                            "stale": F.col("in_session") & (lag > period * STALE_PERIODS)})


def problems(fresh: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Names of stale symbols and of feeds (name, connected) that aren't connected."""
    stale = fresh.filter("stale").select(F.col("symbol").alias("name"))
    return stale if feeds is None else stale.unionByName(feeds.filter("NOT connected").select("name"))


def health_totals(fresh: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """One row: number of problems, healthy without any, gaps of all symbols."""
    gaps = fresh.agg(F.coalesce(F.sum("gaps"), F.lit(0)).alias("total_gaps"))
    return problems(fresh, feeds).agg(F.count("*").alias("n_problems")).crossJoin(gaps).select(  # one row each
        "n_problems", (F.col("n_problems") == 0).alias("healthy"), "total_gaps")


# ------------------------------------------------------------------ charts

def intraday(bars: DataFrame, multipliers: DataFrame | None = None, span: int = 6 * 3600) -> DataFrame:
    """Price and average-price line of each symbol's last session; no average without turnover."""
    m1 = bars.filter("timeframe = '1m' AND closed").withColumn("day", day_text(bar_date()))
    last = m1.groupBy("symbol").agg(F.max_by("day", "close_ts").alias("day"))
    today = m1.join(last, ["symbol", "day"]).select("symbol", "day", "close_ts", "close", "money", "volume")
    cum = scan(today, ["symbol"], ["close_ts"], time_chunk("close_ts", span),
               {"cum_money": ("sum", "money"), "cum_volume": ("sum", "volume")})
    if multipliers is None:
        cum = cum.withColumn("multiplier", F.lit(1.0))
    else:
        cum = cum.join(multipliers, "symbol", "left")
    mult = F.when(F.col("multiplier") > 0, F.col("multiplier")).otherwise(1.0)
    denom = F.col("cum_volume") * mult
    avg = F.when((F.col("cum_money") > 0) & (denom > 0), F.try_divide(F.col("cum_money"), denom))
    return cum.select("symbol", "day", F.col("close_ts").alias("ts"), F.col("close").alias("price"), avg.alias("avg"))


def warmup_bars(lines: list[tuple[str, int]]) -> int:
    return max((n if kind == "sma" else EMA_WARMUP * n for kind, n in lines), default=0)


def moving_averages(bars: DataFrame, lines: list[tuple[str, int]], source: str = "close") -> DataFrame:
    """Chart lines ``sma``/``ema`` of close or volume, one column per line."""
    f = Frame(bars)
    for kind, n in lines:
        f.add(**{f"{kind}{n}_{source}": f.sma(source, n) if kind == "sma" else f.ema(source, n)})
    return f.build()


def chart_tail(bars: DataFrame, limit: int, lines: list[tuple[str, int]], source: str = "close") -> DataFrame:
    """Last ``limit`` bars of each series with lines computed from just enough earlier rows."""
    last = bars.groupBy(*KEYS).agg(F.max("rn").alias("_last"))
    need = limit + warmup_bars(lines)
    tail = bars.join(last, KEYS).filter(F.col("rn") > F.col("_last") - need)
    shift = F.greatest(F.lit(0), F.col("_last") - need)
    local = tail.withColumns({"_keep": F.col("rn") > F.col("_last") - limit, "rn": F.col("rn") - shift}).drop("_last")
    return moving_averages(local, lines, source).filter("_keep").drop("_keep")


def reference_averages(bars: DataFrame, ref_bars: DataFrame, lines: list[tuple[str, int]]) -> DataFrame:
    """Averages of another timeframe aligned to these bars by close time."""
    ref = stage(moving_averages(ref_bars, lines), "ref")
    names = [f"{k}{n}_close" for k, n in lines]
    out = align_by_close(bars, ref, names, "_ref")
    return out.select(*bars.columns, *[F.col(f"_ref.{n}").alias(n) for n in names])


# ------------------------------------------------------------------ crosschecks

CHECKED = ["open", "high", "low", "close", "volume"]


def crosscheck(built: DataFrame, native: DataFrame) -> DataFrame:
    """Field differences on common bars, and native bars missing strictly inside the built span."""
    k = [*KEYS, "close_ts"]
    b = built.select(*k, F.struct(*CHECKED).alias("b"))
    n = native.select(*k, F.struct(*CHECKED).alias("n"))
    span = built.groupBy(*KEYS).agg(F.min("close_ts").alias("lo"), F.max("close_ts").alias("hi"))
    both = b.join(n, k, "full").join(span, KEYS, "left")
    diffs = both.filter("b IS NOT NULL AND n IS NOT NULL").select(*k, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"n.{f}").alias("native"), F.col(f"b.{f}").alias("built"))
        for f in CHECKED])).alias("d")).select(*k, "d.*").filter("native <> built")
    missing = both.filter("b IS NULL AND close_ts > lo AND close_ts < hi").select(
        *k, F.lit("missing").alias("field"), F.lit(None).cast("double").alias("native"), F.lit(None).cast("double").alias("built"))
    return diffs.unionByName(missing)


def missing_bars(built: DataFrame, native: DataFrame) -> DataFrame:
    """Native bars absent from the built ones, strictly inside the built span."""
    k = [*KEYS, "close_ts"]
    gone = native.select(*k).distinct().join(built.select(*k), k, "left_anti")
    span = built.groupBy(*KEYS).agg(F.min("close_ts").alias("lo"), F.max("close_ts").alias("hi"))
    return gone.join(span, KEYS).filter("close_ts > lo AND close_ts < hi").select(*k)


def multiset_diff(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose counts differ between two tables, with the surplus of ``a``: one shuffle."""
    both = a.select(*cols, F.lit(1).alias("_n")).unionByName(b.select(*cols, F.lit(-1).alias("_n")))
    return both.groupBy(*cols).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")


# ------------------------------------------------------------------ message text

# The message's direction marks.
ARROWS = {"long": "▲ 多", "short": "▼ 空", "neutral": "● 提示"}


def format_value(v: Column) -> Column:
    """Four significant digits, or grouped with two decimals from a thousand on; unknown is a dash."""
    small = F.when(v == 0, "0").otherwise(_four_digits(v))
    return F.when(v.isNull(), "—").when(F.abs(v) >= 1000, F.format_number(v, 2)).otherwise(small)


def _four_digits(v: Column) -> Column:
    # the exponent after rounding to four digits: 9.9999e-5 prints as 0.0001
    size = F.regexp_extract(F.format_string("%.3e", v), r"e([+-]\d+)$", 1).cast("int")
    text = F.lit(None).cast("string")
    for e in range(2, -5, -1):
        text = F.when(size == e, F.regexp_replace(F.format_number(v, 3 - e), ",", "")).otherwise(text)
    text = F.when(size < -4, F.regexp_replace(F.format_string("%.3e", v), r"\.?0*e", "e")).otherwise(text)
    return F.when(text.contains(".") & ~text.contains("e"), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def format_time(ts: str = "fired_at", symbol: str = "symbol") -> Column:
    crypto = F.col(symbol).startswith("CRYPTO")
    def text(shift: int) -> Column:
        secs = F.col(ts) + shift
        days = F.floor(secs / 86400).cast("int")
        minute = F.floor((secs % 86400) / 60).cast("int")
        date = F.date_add(F.lit("1970-01-01").cast("date"), days)
        return F.concat(F.date_format(date, "MM-dd"), F.lit(" "), F.lpad((F.floor(minute / 60)).cast("string"), 2, "0"),
                        F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"))
    day = F.when(F.col("trading_day").isNotNull(), F.concat(F.lit("（交易日 "), F.col("trading_day"), F.lit("）"))).otherwise("")
    return F.when(crypto, F.concat(text(0), F.lit(" UTC"))).otherwise(F.concat(text(CN_OFFSET), F.lit(" CST"), day))


def format_signal(context: str = "context", description: Column | None = None) -> Column:
    """Message text of a signal row: head, rule (with its description), time, trigger price and the key
    values."""
    about = F.lit("") if description is None else F.when(F.length(description) > 0, F.concat(F.lit(" — "), description)).otherwise("")
    lines = [
        F.concat(lookup(F.col("direction"), ARROWS), F.lit(" "), F.col("symbol"), F.lit(" ["), F.col("timeframe"), F.lit("]")),
        F.concat(F.lit("规则: "), F.col("rule_id"), about), F.concat(F.lit("时间: "), format_time()),
        F.concat(F.lit("触发价: "), format_value(F.col("trigger_price"))),
    ]
    pairs = F.transform(F.map_entries(context), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = "), format_value(e["value"])))
    extra = F.when(F.size(context) > 0, F.concat(F.lit("关键值:\n"), F.array_join(pairs, "\n")))
    note = F.when(F.col("tentative"), "⚠️ 盘中预报（未收盘确认），不进统计")
    return F.concat_ws("\n", *lines, extra, note)
