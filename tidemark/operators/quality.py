"""Signal quality: summaries, distributions, equity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timekeys import local_hour
from tidemark.plans.chunks import scan
from tidemark.plans.ranges import bracketed_median, in_ranges
from tidemark.plans.staging import stage


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _mean_if(value: str, cond: Column) -> Column:
    return F.coalesce(F.avg(F.when(cond, F.col(value))), F.lit(0.0))


def summarize(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """The 18 metrics per group.  Neutral signals count as evaluated (and in MFE/MAE) but not in
    returns or rates."""
    if not by:
        whole = summarize(outcomes.withColumn("_all", F.lit(1)), ["_all"])
        one = outcomes.sparkSession.range(1).select(F.lit(1).alias("_all"))  # zeros without any outcome
        return one.join(whole, "_all", "left").drop("_all").na.fill(0)
    rows = outcomes.withColumns({
        "_ev": F.col("reason") != "no_data",
        "_dir": (F.col("reason") != "no_data") & (F.col("direction") != "neutral")})
    rows = rows.withColumn("_ret", F.when(F.col("_dir"), F.col("ret")))
    ev, d, ret = F.col("_ev"), F.col("_dir"), F.col("_ret")
    n_dir = F.count_if(d)

    def share(reason: str) -> Column:
        return _ratio(F.count_if(d & (F.col("reason") == reason)), n_dir)

    avg_win, avg_loss = _mean_if("_ret", ret > 0), _mean_if("_ret", ret < 0)
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(ev).alias("evaluated"),
        n_dir.alias("directional"), F.count_if(ret > 0).alias("wins"),
        F.count_if(ret < 0).alias("losses"), _ratio(F.count_if(ret > 0), n_dir).alias("win_rate"),
        _mean_if("_ret", d).alias("avg_return"),
        F.coalesce(F.sum("_ret"), F.lit(0.0)).alias("total_return"),
        avg_win.alias("avg_win"), avg_loss.alias("avg_loss"),
        F.coalesce(F.abs(F.try_divide(avg_win, avg_loss)), F.lit(0.0)).alias("payoff"),
        share("stop").alias("false_rate"), share("target").alias("target_rate"),
        share("horizon").alias("horizon_rate"), _mean_if("mfe", ev).alias("avg_mfe"),
        _mean_if("mae", ev).alias("avg_mae"), _mean_if("bars_held", ev).alias("avg_bars_held"))
    med = bracketed_median(rows.select(*by, "_ret"), by, "_ret", "median_return")
    return agg.join(med, by, "left").withColumn(
        "median_return", F.coalesce("median_return", F.lit(0.0)))


# The report's groupings.
def _dimensions() -> dict[str, Column]:
    return {
        "overall": F.lit("*"), "rule": F.col("rule_id"), "symbol": F.col("symbol"),
        "hour": F.lpad(local_hour("fired_at").cast("string"), 2, "0"),
        "direction": F.col("direction"), "basis": F.col("exit_basis"),
    }


def report(outcomes: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """Long report keyed (dimension, key): every grouping from one pass over the outcomes; the overall row
    is there (with zeros) also without any."""
    dims = {k: v for k, v in _dimensions().items() if dimensions is None or k in dimensions}
    spread = outcomes.withColumn("_g", F.explode(F.array(*[
        F.struct(F.lit(name).alias("dimension"), value.alias("key")) for name, value in dims.items()])))
    long = spread.select("*", "_g.dimension", "_g.key").drop("_g")
    rows = summarize(long, ["dimension", "key"])
    if "overall" not in dims:
        return rows
    overall = outcomes.sparkSession.range(1).select(F.lit("overall").alias("dimension"), F.lit("*").alias("key"))
    return rows.join(overall, ["dimension", "key"], "full").na.fill(0)


def mixed_basis(report_rows: DataFrame) -> DataFrame:
    """TRUE when outcomes with ATR stops and with percentage stops were mixed."""
    return report_rows.filter("dimension = 'basis'").agg(
        (F.count(F.lit(1)) > 1).alias("mixed_basis"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "key", F.col("signals").cast("string")))), ",").alias("parts"))


def top_groups(report_rows: DataFrame, top: int = 10) -> DataFrame:
    """First ``top`` groups by key of each grouping (the grouping has one row per key)."""
    from pyspark.sql import Window

    w = Window.partitionBy("dimension").orderBy("key")
    return report_rows.withColumn("pos", F.row_number().over(w).cast("bigint")).filter(F.col("pos") <= top)


def histogram(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Return histogram in percent: Sturges bins clamped to 5..24, range includes zero, last bin
    closed.  Fewer than two returns give no rows."""
    by = by or []
    pct = outcomes.filter("reason <> 'no_data'").select(*by, (F.col("ret") * 100).alias("v"))
    sizes = pct.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.least(F.min("v"), F.lit(0.0)).alias("lo"),
        F.greatest(F.max("v"), F.lit(0.0)).alias("hi")).filter("n >= 2")
    bins = F.greatest(F.lit(5), F.least(F.lit(24), F.ceil(F.log2("n")) + 1)).cast("bigint")
    sizes = sizes.withColumn("bins", bins)
    placed = (pct.join(sizes, by) if by else pct.crossJoin(F.broadcast(sizes)))  # one row of bounds
    width = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    slot = F.least(F.floor((F.col("v") - F.col("lo")) / width * F.col("bins")), F.col("bins") - 1)
    return (placed.withColumn("bin", slot.cast("bigint")).groupBy(*by, "bins", "lo", "hi", "bin")
            .agg(F.count(F.lit(1)).alias("n")))


def equity_curve(outcomes: DataFrame, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Running sum of returns in percent by entry time, its running peak and the drawdown.

    Ties on entry time are ordered by symbol, rule and fire time.  Tasks take sampled ranges of that order, so outcomes of all
    symbols in one minute are spread as well."""
    by = by or []
    order = ["entry_ts", *[c for c in ("symbol", "rule_id", "fired_at") if c not in by]]
    rows = in_ranges(outcomes.filter("reason <> 'no_data'").select(*by, *order, (F.col("ret") * 100).alias("pct")), [*by, *order], ranges)
    cum = stage(scan(rows, by, order, F.col("_range"), {"equity": ("sum", "pct")}), "equity")
    peak = scan(cum, by, order, F.col("_range"), {"_peak": ("max", "equity")})
    peak = peak.withColumn("peak", F.greatest(F.lit(0.0), "_peak")).drop("_peak", "pct", "_range")
    return peak.withColumn("drawdown", F.col("peak") - F.col("equity"))


def max_drawdown(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    return curve.groupBy(*(by or [])).agg(F.max("drawdown").alias("max_drawdown"))
