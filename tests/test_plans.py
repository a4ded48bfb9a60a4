"""Scans, blocks and recurrences against brute force, with chunk sizes far below the data."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.helpers import close_series, close_to, column
from tidemark.operators.asof import asof
from tidemark.operators.frame import Frame
from tidemark.plans.chunks import rn_chunk, scan, time_chunk
from tidemark.plans.ranges import bracketed_median, in_ranges, range_scan
from tidemark.plans.recurrence import ema, linear_scan, smooth, wilder
from tidemark.plans.small import broadcast_if_small
from tidemark.plans.staging import shared_dir, stage

rng = random.Random(7)


@pytest.fixture(scope="module")
def points(spark):
    """One hot key with most rows, and small ones."""
    rows = []
    for key, n in (("hot", 400), ("b", 37), ("c", 1)):
        ts = sorted(rng.sample(range(10_000), n))
        rows += [(key, t, rng.choice([None, 1.0, 2.5, -3.0])) for t in ts]
    return rows, spark.createDataFrame(rows, "k string, t bigint, v double")


@pytest.mark.parametrize("span", [7, 500, 100_000])
def test_scan_ops(points, span):
    rows, df = points
    got = scan(df, ["k"], ["t"], time_chunk("t", span), {
        "s": ("sum", "v"), "c": ("count", "v"), "mx": ("max", "v"), "mn": ("min", "v"),
        "last": ("last", "v"), "lag": ("lag", "v"), "lead": ("lead", "v"), "rn": ("count", "t")}).collect()
    by = {(r.k, r.t): r for r in got}
    assert len(got) == len(rows)
    for key in ("hot", "b", "c"):
        seq = [(t, v) for k, t, v in rows if k == key]
        for i, (t, v) in enumerate(seq):
            r = by[(key, t)]
            known = [x for _, x in seq[:i + 1] if x is not None]
            assert r.rn == i + 1 and r.c == len(known)
            assert abs(r.s - sum(known)) < 1e-9
            assert r.mx == (max(known) if known else None) and r.mn == (min(known) if known else None)
            assert r["last"] == (known[-1] if known else None)
            assert r.lag == (seq[i - 1][1] if i else None)
            assert r.lead == (seq[i + 1][1] if i + 1 < len(seq) else None)


def test_exclusive_scan(points):
    rows, df = points
    got = scan(df.filter("k = 'hot'"), ["k"], ["t"], time_chunk("t", 90), {"s": ("sum", F.lit(1))}, exclusive=True)
    assert [r.s for r in got.orderBy("t").collect()] == list(range(400))


@pytest.mark.parametrize("n", [1, 2, 101, 20_000])
def test_bracketed_median(spark, n):
    """Also where returns pile up: most equal, or all within 0.001 of each other."""
    rows = [(k, rng.choice([0.5, round(rng.uniform(-9, 9), 3)]) if k == "a" else 0.2 + rng.random() / 1000 if k == "b" else rng.choice([-1.0, 1.0])) for k in "aabc" for _ in range(n)]
    df = spark.createDataFrame([*rows, ("d", None)], "k string, x double")
    got = {r.k: r.m for r in bracketed_median(df, ["k"], "x", "m").collect()}
    assert set(got) == {"a", "b", "c"}
    for k in got:
        assert abs(got[k] - statistics.median(x for kk, x in rows if kk == k)) < 1e-12


def test_a_bracket_that_misses_is_widened(spark):
    """A coarse sketch may be wrong about the middle; the result isn't."""
    rows = [("a", float(i * i % 997)) for i in range(4000)]
    got = bracketed_median(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", "m", accuracy=5).collect()
    assert got[0].m == statistics.median(x for _, x in rows)


def test_ranges_spread_one_moment_over_tasks(spark):
    """All rows share one time stamp; sampled ranges of the whole order still cut them, and the scan is exact."""
    rows = [(60, f"s{i:05d}", 1.0) for i in range(8000)]
    df = spark.createDataFrame(rows, "t bigint, s string, x double").repartition(4)
    sizes = [r["count"] for r in in_ranges(df, ["t", "s"], 8).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3000
    got = range_scan(df, [], ["t", "s"], {"n": ("count", "x"), "before": ("lag", "s")}, ranges=8).orderBy("s").collect()
    assert [r.n for r in got] == list(range(1, 8001)) and [r.before for r in got] == [None, *[r[1] for r in rows[:-1]]]


def _loop(xs, n, a, start=1, seed=None):
    out, y = [], seed
    for i, x in enumerate(xs, 1):
        if seed is not None:
            if i >= start:
                y += a * (x - y)
            out.append(y if i >= start else None)
        else:
            first = start + n - 1
            if i == first:
                y = sum(xs[start - 1:first]) / n
            elif i > first:
                y += a * (x - y)
            out.append(y if i >= first else None)
    return out


@pytest.mark.parametrize("run,fan", [(256, 1024), (4, 3), (1, 2)])
def test_recurrences_match_a_loop(spark, run, fan):
    xs = [rng.uniform(1, 100) for _ in range(150)]
    df = close_series(spark, xs)
    got = linear_scan(df, ["symbol", "timeframe"], {
        "e2": ema(F.col("close"), 2), "e20": ema(F.col("close"), 20), "w14": wilder(F.col("close"), 14),
        "one": ema(F.col("close"), 1), "late": ema(F.col("close"), 5, start=30),
        "k": smooth(F.col("close"), 3, 9, 50.0)}, run=run, fan=fan)
    close_to(column(got, "e2"), _loop(xs, 2, 2 / 3))
    close_to(column(got, "e20"), _loop(xs, 20, 2 / 21))
    close_to(column(got, "w14"), _loop(xs, 14, 1 / 14))
    close_to(column(got, "one"), xs)
    close_to(column(got, "late"), _loop(xs, 5, 2 / 6, start=30))
    close_to(column(got, "k"), _loop(xs, 1, 1 / 3, start=9, seed=50.0))


def test_long_flat_tail_keeps_the_rsi_ratio(spark):
    """After moves stop, gains and losses decay together: the ratio must not change."""
    xs = [10.0 + (i % 3) for i in range(20)] + [11.0] * 400
    f = Frame(close_series(spark, xs))
    r = column(f.add(r=f.rsi(14)).build(), "r")
    assert abs(r[-1] - r[25]) < 1e-6 and 20 < r[-1] < 80


@pytest.mark.parametrize("rows", [30, 41, 100_000])
def test_blocked_frames_do_not_depend_on_block_size(spark, rows):
    xs = [((i * 37) % 101) / 7 for i in range(230)]
    f = Frame(close_series(spark, xs, spread=0.5), block_rows=rows, chunk_rows=11)
    box = f.range(10)
    d = f.add(m=f.sma("close", 20), hi=box["high"], p=f.prev(f.sma("close", 20), 3), sh=f.swing_high(3), ps=f.swing_high(3, 1),
              db=f.double_bottom(2, 0.5)).build()
    m = [sum(xs[i - 19:i + 1]) / 20 if i >= 19 else None for i in range(230)]
    close_to(column(d, "m"), m)
    close_to(column(d, "p"), [None] * 3 + m[:-3])
    hi = [max(xs[j], xs[j - 1] if j else xs[0]) + 0.5 for j in range(230)]
    close_to(column(d, "hi"), [max(hi[i - 10:i]) if i >= 10 else None for i in range(230)])
    piv = [i for i in range(3, 227) if hi[i] == max(hi[i - 3:i + 4])]
    want, prev = [], []
    for i in range(230):
        seen = [p for p in piv if p + 3 <= i]
        want.append(hi[seen[-1]] if seen else None)
        prev.append(hi[seen[-2]] if len(seen) > 1 else None)
    close_to(column(d, "sh"), want)
    close_to(column(d, "ps"), prev)


@pytest.mark.parametrize("span", [5, 100, 10**6])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof(spark, span, direction):
    left = [(k, t) for k in "ab" for t in rng.sample(range(300), 60)]
    right = [(k, t, t * 2) for k in "ac" for t in rng.sample(range(300), 25)]
    got = asof(spark.createDataFrame(left, "k string, t bigint"), spark.createDataFrame(right, "k string, u bigint, v bigint"),
               ["k"], "t", "u", ["u", "v"], direction=direction, span=span).collect()
    assert len(got) == len(left)
    for r in got:
        c = [(u, v) for k, u, v in right if k == r.k and (u <= r.t if direction == "backward" else u >= r.t)]
        best = (max(c) if direction == "backward" else min(c)) if c else None
        assert (tuple(r.hit) if r.hit else None) == best


def test_stage_reads_the_session_setting(spark):
    df = stage(spark.range(5), "probe")
    assert df.count() == 5 and shared_dir(spark)
    assert df.inputFiles()[0].split("tidemark/")[0].endswith(shared_dir(spark).split("/")[-1] + "/")


def test_broadcast_hint_only_when_small(spark):
    small, big = broadcast_if_small(spark.range(10), 10), broadcast_if_small(spark.range(11), 10)
    assert "broadcast" in small._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in big._jdf.queryExecution().logical().toString().lower()


def test_rn_chunk_bounds(spark):
    df = spark.range(1, 101).select(F.col("id").alias("rn")).withColumn("c", rn_chunk(10))
    assert df.groupBy("c").count().agg(F.max("count")).first()[0] == 10
    assert isinstance(df.schema["c"].dataType, T.LongType)
