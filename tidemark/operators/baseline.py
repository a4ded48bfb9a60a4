"""Random-entry baseline, overlap-corrected errors, horizon curves."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.frame import Frame
from tidemark.operators.outcomes import (
    OutcomeParams, atr_from_context, evaluate, label, ladder_returns, locate)
from tidemark.plans.chunks import scan, time_chunk
from tidemark.plans.staging import stage
from tidemark.schema import KEYS

STRIDE = 10
CURVE_STRIDE = 40
# Holding periods of the curve.
HORIZON_LADDER = [1, 2, 3, 5, 8, 10, 15, 20, 30, 40, 60, 80, 100]
SPAN = 30 * 86400


def overlap_totals(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Number of overlapping (interval, interval) pairs of one symbol, itself included.

    Intervals a, b overlap when a starts by b's end and ends no earlier than b's start, so the
    count is two running sums over distinct instants; no pair is ever formed.
    """
    usable = outcomes.filter("reason <> 'no_data'")
    keys = [*by, *([] if "symbol" in by else ["symbol"])]
    end = F.greatest("exit_ts", "entry_ts")
    marks = F.array(F.struct(F.col("entry_ts").alias("t"), F.lit(1).alias("s"), F.lit(0).alias("e")),
                    F.struct(end.alias("t"), F.lit(0).alias("s"), F.lit(1).alias("e")))
    at = stage(usable.select(*keys, F.explode(marks).alias("m")).groupBy(*keys, F.col("m.t").alias("t"))
               .agg(F.sum("m.s").alias("s"), F.sum("m.e").alias("e")), "marks")
    run = scan(at, keys, ["t"], time_chunk("t", SPAN), {"cs": ("sum", "s"), "ce": ("sum", "e")})
    met = F.col("e") * F.col("cs") - F.col("s") * (F.col("ce") - F.col("e"))
    return run.groupBy(*keys).agg(F.sum(met).cast("bigint").alias("pairs"),
                                  F.sum("s").cast("bigint").alias("n"))


def effective_n(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Sample size divided by the mean holding overlap."""
    t = overlap_totals(outcomes, by).groupBy(*by).agg(F.sum("pairs").alias("o"), F.sum("n").alias("n"))
    mean = F.greatest(F.lit(1.0), F.col("o") / F.col("n"))
    return t.select(*by, "n", F.when(F.col("n") < 2, F.col("n").cast("double"))
                    .otherwise(F.col("n") / mean).alias("n_eff"))


def standard_error(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Sample deviation over the root of the effective size; NULL below two samples."""
    usable = outcomes.filter("reason <> 'no_data'")
    dev = usable.groupBy(*by).agg(F.stddev_samp("ret").alias("_sd"))
    en = effective_n(outcomes, by)
    joined = dev.join(en, by) if by else dev.crossJoin(en)  # one row each
    se = F.when(F.col("n") >= 2, F.col("_sd") / F.sqrt(F.greatest(F.lit(1.0), F.col("n_eff"))))
    return joined.select(*by, "n", "n_eff", se.alias("se"))


def with_baseline_atr(bars: DataFrame) -> DataFrame:
    """The bar table plus ATR(14), which the random entries always carry."""
    f = Frame(bars)
    return stage(f.add(atr=f.atr(14)).build(), "atr")


def random_entries(bars_atr: DataFrame, wanted: DataFrame, params: OutcomeParams, stride: int) -> DataFrame:
    """Every ``stride``-th bar of the asked (symbol, timeframe, direction) as an entry."""
    picked = bars_atr.filter((F.col("rn") - 1) % max(1, stride) == 0)
    if not params.atr_key:
        picked = picked.withColumn("atr", F.lit(None).cast("double"))
    return picked.select(
        *KEYS, F.col("rn").alias("base_rn"), "next_open", "next_close_ts", "atr",
        F.col("close").alias("trigger_price"), F.col("close_ts").alias("fired_at"),
    ).join(wanted, KEYS)


def random_entry_expectation(
    bars_atr: DataFrame, wanted: DataFrame, params: OutcomeParams, stride: int = STRIDE,
) -> DataFrame:
    """Mean return, sample count and its standard error per (symbol, timeframe, direction)."""
    group = [*KEYS, "direction"]
    outs = stage(label(random_entries(bars_atr, wanted, params, stride), bars_atr, params,
                       [*group, "fired_at"]), "random")
    usable = outs.filter("reason <> 'no_data'")
    mean = usable.groupBy(*group).agg(
        F.coalesce(F.avg(F.when(F.col("direction") != "neutral", F.col("ret"))), F.lit(0.0)).alias("expectation"),
        F.count(F.lit(1)).alias("samples"))
    return mean.join(standard_error(outs, group).select(*group, "se"), group)


def excess_se(se_rule: Column, se_base: Column) -> Column:
    return F.sqrt(se_rule * se_rule + F.coalesce(se_base, F.lit(0.0)) * F.coalesce(se_base, F.lit(0.0)))


def weights(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Share of the signals and majority direction per symbol; ties go to the direction seen first."""
    usable = outcomes.filter("reason <> 'no_data'")
    cell = [*by, *[k for k in KEYS if k not in by]]
    per_dir = usable.groupBy(*cell, "direction").agg(
        F.count(F.lit(1)).alias("c"), F.min("fired_at").alias("seen"))
    major = per_dir.groupBy(*cell).agg(
        F.sum("c").alias("n"), F.max_by("direction", F.struct(F.col("c"), -F.col("seen"))).alias("direction"))
    total = usable.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    joined = major.join(total, by) if by else major.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("w", F.col("n") / F.col("total"))


def baseline_parts(
    outcomes: DataFrame, bars: DataFrame, params: OutcomeParams, stride: int = STRIDE,
    by: list[str] | None = None, bars_atr: DataFrame | None = None,
) -> DataFrame:
    """Per symbol of each group: signals ``n`` and their weight, majority direction, and the random
    entries' expectation, samples and error there."""
    by = by if by is not None else ["rule_id"]
    bars_atr = with_baseline_atr(bars) if bars_atr is None else bars_atr
    ws = stage(weights(outcomes, by), "weights")
    exp = random_entry_expectation(bars_atr, ws.select(*KEYS, "direction").distinct(), params, stride)
    return ws.join(exp, [*KEYS, "direction"])


def weighted_baseline(
    outcomes: DataFrame, bars: DataFrame, params: OutcomeParams, stride: int = STRIDE,
    by: list[str] | None = None, bars_atr: DataFrame | None = None,
) -> DataFrame:
    """Baseline weighted by the signals' own distribution, excess over it, and combined error.

    Weights are not rescaled when a symbol has no bars."""
    by = by if by is not None else ["rule_id"]
    base = baseline_parts(outcomes, bars, params, stride, by, bars_atr).groupBy(*by).agg(
        F.sum(F.col("w") * F.col("expectation")).alias("baseline"),
        F.sum("samples").alias("samples"),
        F.sqrt(F.coalesce(F.sum((F.col("w") * F.col("se")) * (F.col("w") * F.col("se"))), F.lit(0.0))).alias("se_base"))
    usable = outcomes.filter("reason <> 'no_data'")
    rule = usable.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(F.col("direction") != "neutral", F.col("ret"))), F.lit(0.0)).alias("avg_return"))
    se = standard_error(outcomes, by).select(*by, "n", "n_eff", F.col("se").alias("se_rule"))
    if by:
        out = rule.join(se, by).join(base, by, "left")
    else:
        out = rule.crossJoin(se).crossJoin(base)  # one row each
    out = out.withColumns({"baseline": F.coalesce("baseline", F.lit(0.0)),
                           "samples": F.coalesce("samples", F.lit(0)),
                           "se_base": F.coalesce("se_base", F.lit(0.0))})
    return out.withColumns({"excess": F.col("avg_return") - F.col("baseline"),
                            "se": excess_se(F.col("se_rule"), F.col("se_base"))})


def verdict(excess: Column, se: Column) -> Column:
    """Does the two-sigma interval of the excess cross zero?"""
    lo, hi = excess - 2 * se, excess + 2 * se
    return (F.when(se.isNull(), "unknown").when((lo <= 0) & (hi >= 0), "noise")
            .when(excess > 0, "better").otherwise("worse"))


def horizon_curve(
    signals: DataFrame, bars: DataFrame, params: OutcomeParams,
    ladder: list[int] | None = None, by: list[str] | None = None, stride: int = CURVE_STRIDE,
    bars_atr: DataFrame | None = None,
) -> DataFrame:
    """Mean return, baseline and excess per holding period, with the evaluated counts."""
    ladder, by = ladder or HORIZON_LADDER, by if by is not None else ["rule_id"]
    bars_atr = with_baseline_atr(bars) if bars_atr is None else bars_atr
    entries = stage(locate(signals, bars).withColumn("atr", atr_from_context(params)), "entries")
    keep = ["rule_id", *KEYS, "direction", "fired_at"]
    mine = stage(ladder_returns(entries, bars, params, ladder, keep), "ladder")
    directional = F.when(F.col("direction") != "neutral", F.col("ret"))
    own = mine.groupBy(*by, "bars").agg(
        F.coalesce(F.avg(directional), F.lit(0.0)).alias("avg_return"), F.count(F.lit(1)).alias("evaluated"))
    # which entries can be evaluated does not depend on the holding period
    once = mine.filter(F.col("bars") == ladder[0]).withColumn("reason", F.lit("ok"))
    ws = stage(weights(once, by), "weights")
    fake = random_entries(bars_atr, ws.select(*KEYS, "direction").distinct(), params, stride)
    rand = (ladder_returns(fake, bars_atr, params, ladder, [*KEYS, "direction"])
            .groupBy(*KEYS, "direction", "bars").agg(F.coalesce(F.avg(directional), F.lit(0.0)).alias("expectation")))
    base = ws.join(rand, [*KEYS, "direction"]).groupBy(*by, "bars").agg(
        F.sum(F.col("w") * F.col("expectation")).alias("baseline"))
    return own.join(base, [*by, "bars"], "left").withColumn(
        "baseline", F.coalesce("baseline", F.lit(0.0))).withColumn(
        "excess", F.col("avg_return") - F.col("baseline"))


def evaluate_rules(
    signals: DataFrame, bars: DataFrame, params: OutcomeParams | None = None, stride: int = STRIDE,
) -> DataFrame:
    """Per rule: signals, win rate, mean return, baseline, excess, errors, effective size, verdict;
    ``baseline_parts`` has the parts per symbol."""
    params = params or OutcomeParams()
    outs = stage(evaluate(signals, bars, params), "outcomes")
    base = weighted_baseline(outs, bars, params, stride)
    decided = (F.col("reason") != "no_data") & (F.col("direction") != "neutral")
    wins = F.try_divide(F.count_if(decided & (F.col("ret") > 0)), F.count_if(decided))
    n = outs.groupBy("rule_id").agg(F.count(F.lit(1)).alias("signals"), F.coalesce(wins, F.lit(0.0)).alias("win_rate"))
    return (n.join(base, "rule_id", "left").withColumn("verdict", verdict(F.col("excess"), F.col("se"))))


__all__ = [
    "CURVE_STRIDE", "HORIZON_LADDER", "STRIDE", "baseline_parts", "effective_n", "evaluate_rules", "excess_se",
    "horizon_curve", "overlap_totals", "random_entry_expectation", "standard_error",
    "verdict", "weighted_baseline", "with_baseline_atr",
]
