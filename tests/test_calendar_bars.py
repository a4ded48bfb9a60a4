"""Calendar bars straight from ticks: the same as by way of minutes, in one exchange of the ticks."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.bars import aggregate_all, bar_series, calendar_bars, calendar_series, ticks_to_minutes
from tidemark.plans.staging import stage

TFS = ["1d", "1w", "1mon"]


@pytest.fixture(scope="module")
def asked(spark):
    """Ticks with equal moments, a series of one day, one without a neighbour for years, midnights, rows without a moment or name."""
    rng, rows = random.Random(3), []
    for k in range(4000):
        sym, far = rng.choice([("A", 900), ("A", 900), ("B", 40), ("C", 1)])
        us = rng.randrange(far * 2) * 43_200_000_000 + rng.choice([0, 0, 1, 59_999_999, 7_000_000])
        rows.append((sym, us, k % 7 * 100_000 + k, float(rng.randrange(1, 500)), float(rng.randrange(9))))
    rows += [("D", 0, 1, 5.0, 1.0), ("D", 9 * 365 * 86_400_000_000, 2, 6.0, 1.0), ("A", None, 3, 9e9, 1.0), (None, 5, 4, 9e9, 1.0), ("E", -86_400_000_000, 5, None, None)]
    ticks = stage(spark.createDataFrame(rows, "s string, us bigint, id bigint, p double, v double"), "ticks")
    return {"ticks": ticks, "symbol": F.col("s"), "ts": F.timestamp_micros("us"), "price": F.col("p"), "tie": F.col("id"), "volume": F.col("v")}


def rows_of(df, names):
    return sorted(map(str, df.filter("symbol IS NOT NULL AND close_ts IS NOT NULL").select(*names).collect()))


@pytest.mark.parametrize("days", [7, 256])
def test_same_as_by_minutes(asked, days):
    base = stage(ticks_to_minutes(**asked), "m")
    want, got = bar_series(base, TFS), calendar_series(**asked, timeframes=TFS, chunk_days=days)
    assert got.dtypes == want.dtypes and got.count() > 1000
    assert rows_of(got, want.columns) == rows_of(want, want.columns)
    want, got = aggregate_all(base, TFS), calendar_bars(**asked, timeframes=TFS, chunk_days=days)
    assert got.dtypes == want.dtypes
    assert rows_of(got, want.columns) == rows_of(want, want.columns)


def test_ticks_are_exchanged_once(asked):
    out = calendar_bars(**asked, timeframes=TFS)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert ["ReusedExchange" in line for line in dealt].count(False) == 1 and len(dealt) == 2
