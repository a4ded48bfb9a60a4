"""What a rule's conditions did over time: bands, tallies, diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.chunks import rn_chunk, scan
from tidemark.plans.staging import stage

ROLE_KEYS = ["rule_id", "symbol", "role", "timeframe"]


def condition_bands(rows: DataFrame, which: str = "satisfied") -> DataFrame:
    """Runs of equal TRUE or unknown on consecutive bars; FALSE breaks a run."""
    label = F.when(F.col(which), "true").when(F.col(which).isNull(), "unknown").otherwise("")
    marked = rows.select(*ROLE_KEYS, "rn", "close_ts", label.alias("value"))
    before = stage(scan(marked, ROLE_KEYS, ["rn"], rn_chunk(), {"_before": ("lag", "value")}), "bands")
    start = F.when(F.col("value") != F.coalesce("_before", F.lit("")), 1).otherwise(0)
    runs = scan(before, ROLE_KEYS, ["rn"], rn_chunk(), {"_run": ("sum", start)})
    return (
        runs.filter("value <> ''").groupBy(*ROLE_KEYS, "_run", "value")
        .agg(F.min("close_ts").alias("from_ts"), F.max("close_ts").alias("to_ts"),
             F.count(F.lit(1)).alias("bars")).drop("_run"))


def condition_counts(rows: DataFrame) -> DataFrame:
    s = F.col("satisfied")
    return rows.groupBy(*ROLE_KEYS).agg(
        F.count_if(s).alias("n_true"), F.count_if(~s).alias("n_false"),
        F.count_if(s.isNull()).alias("n_unknown"))


def diagnose(counts: DataFrame, role_order: list[str], signals: DataFrame) -> DataFrame:
    """Why a rule did not fire, per symbol and role, with the first role that never held."""
    total = F.col("n_true") + F.col("n_false") + F.col("n_unknown")
    note = (F.when((F.col("n_true") == 0) & (F.col("n_unknown") == total), "warm-up only")
            .when(F.col("n_true") == 0, "never true")
            .when(F.col("n_true") < total * 0.02, "rare").otherwise(""))
    pos = F.array_position(F.array(*[F.lit(r) for r in role_order]), F.col("role"))
    noted = counts.withColumns({"note": note, "pos": pos.cast("bigint")})
    verdicts = noted.groupBy("rule_id", "symbol").agg(
        F.min_by("role", F.when(F.col("n_true") == 0, F.col("pos"))).alias("_blocked"))
    n = signals.groupBy("rule_id", "symbol").agg(F.count(F.lit(1)).alias("n_signals"))
    fired = F.coalesce("n_signals", F.lit(0))
    return (
        noted.join(verdicts, ["rule_id", "symbol"]).join(n, ["rule_id", "symbol"], "left")
        .withColumns({
            "n_signals": fired.cast("bigint"),
            "verdict": F.when(fired > 0, "fired").when(
                F.col("_blocked").isNotNull(), F.concat(F.lit("blocked at "), F.col("_blocked")))
            .otherwise("never in order")})
        .drop("_blocked"))
