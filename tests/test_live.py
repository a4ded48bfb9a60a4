"""The live side against the batch side: lines, rules from raw minutes, late minutes."""

import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import ohlc_series
from tidemark.operators import rules as R
from tidemark.operators.bars import aggregate, bar_series
from tidemark.operators.frame import Frame
from tidemark.operators.shipped import stock_rules
from tidemark.plans.staging import stage
from tidemark.streaming import live as L
from tidemark.streaming import live_rules as LR
from tidemark.streaming.late import run_late_loop
from tidemark.streaming.live_frame import FIELDS, LiveFrame, affine_run

LINES = {
    "ema": lambda f: f.ema("close", 5), "ema1": lambda f: f.ema("close", 1), "wilder": lambda f: f.wilder("high", 4), "sma": lambda f: f.sma("volume", 3), "std": lambda f: f.std("close", 4),
    "sum": lambda f: f.rolling_sum("volume", 4), "rsi": lambda f: f.rsi(6), "rsi_high": lambda f: f.rsi("high", 6), "dif": lambda f: f.macd_dif(4, 9, 3), "dea": lambda f: f.macd_dea(4, 9, 3),
    "hist": lambda f: f.macd_hist(4, 9, 3), "upper": lambda f: f.boll_upper(6), "width": lambda f: f.boll_width(6), "atr": lambda f: f.atr(5), "k": lambda f: f.kdj_k(5), "d": lambda f: f.kdj_d(5), "j": lambda f: f.kdj_j(5),
    "prev": lambda f: f.prev(f.prev("close", 2), 3), "up": lambda f: f.cross_up(f.ema("close", 3), f.ema("close", 8)), "down": lambda f: f.cross_down(f["close"], 100.0),
    "box": lambda f: f.breakout(f.range(6), "up"), "box2": lambda f: f.breakout(f.range(6), "down") | (f.range_width(f.range(3)) > f.range_mid(f.range(3)) * 0.02),
    "gap": lambda f: f.gap("up"), "gap2": lambda f: f.gap("down"), "eng": lambda f: f.engulfing("up"), "eng2": lambda f: f.engulfing("down"), "pin": lambda f: f.pin_bar("up", 1.5), "pin2": lambda f: f.pin_bar("down", 1.5),
    "cons": lambda f: f.consolidation(4, 0.03), "ratr": lambda f: f.range_atr(6, 5), "inside": lambda f: f.inside_bar(), "sh": lambda f: f.swing_high(2), "sl": lambda f: f.swing_low(2, 1),
    "db": lambda f: f.double_bottom(2, 0.01), "dt": lambda f: f.double_top(2, 0.01), "mw": lambda f: f.mode(f.rsi(6) < 45, "window", 4), "me": lambda f: f.mode(f["close"] > f.ema("close", 5), "event"),
    "mix": lambda f: ~(f["close"] > f.sma("close", 7)) & (f.ratio(f.abs(f["close"] - f.ema("close", 5)), f.atr(5)) < 1.0),
}


def walk(rng, n):
    price, out = 100.0, []
    for _ in range(n):
        o = price
        price = max(round(price + rng.choice([-1.5, -0.5, 0.0, 0.5, 1.0]), 1), 5.0)
        out.append((o, max(o, price) + rng.choice([0.0, 0.5, 2.0]), min(o, price) - rng.choice([0.0, 0.5, 2.0]), price))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_live_lines_equal_the_batch_frame(spark, seed):
    rng = random.Random(seed)
    bars = ohlc_series(spark, walk(rng, 160)).withColumn("volume", (F.col("rn") % 7).cast("double"))
    frame = Frame(bars)
    want = frame.add(**{n: e(frame).cast("double") for n, e in LINES.items()}).build(keep=["rn"]).orderBy("rn").toPandas()
    rows = bars.orderBy("rn").toPandas()
    got, memory, at = {n: [] for n in LINES}, None, 0
    while at < len(rows):
        size = rng.choice([1, 1, 2, 3, 9, 30])
        book = LR.Book(pickle.loads(pickle.dumps(memory)) if memory else None, rows.iloc[at : at + size])
        for n, e in LINES.items():
            got[n] += e(book.frame).v[book.old :].tolist()
        memory, at = book.memory(), at + size
    for n in LINES:
        assert np.allclose(np.array(got[n], float), want[n].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), n
    assert len(memory["rows"]["rn"]) <= 40


def test_affine_runs_compose():
    rng = np.random.default_rng(0)
    x = rng.normal(size=700)
    y, want = 3.0, []
    for v in x:
        y = 0.8 * y + 0.2 * v
        want.append(y)
    whole = affine_run(x, 3.0, 0.8, 0.2)
    cut = affine_run(x[:333], 3.0, 0.8, 0.2)
    assert np.allclose(whole, want) and np.allclose(np.concatenate([cut, affine_run(x[333:], cut[-1], 0.8, 0.2)]), want)
    assert len(affine_run(x[:0], 1.0, 0.5, 0.5)) == 0
    assert set(FIELDS) <= set(LiveFrame.__init__.__globals__["FIELDS"])


MINUTES = ("symbol string, timeframe string, open_ts bigint, close_ts bigint, open double, high double, low double, close double, volume double, money double, "
           "open_interest double, trading_day string, closed boolean, emit_ts bigint")


def minute_rows(seed, symbols=("CN.A", "CRYPTO.B"), n=2600):
    """Minutes with holes; the first symbol has trading days, with evenings that count for the next day."""
    rng, rows = random.Random(seed), []
    for s in symbols:
        t = 1704067200
        for o, h, low, c in walk(rng, n):
            t += 60 * rng.choice([1, 1, 1, 1, 2, 7, 40])
            day = None
            if s == "CN.A":
                k = t // 86400 + (1 if t % 86400 > 68400 else 0)
                day = str(np.datetime64("1970-01-01") + np.timedelta64(k, "D"))
            rows.append((s, "1m", t - 60, t, o, h, low, c, float(rng.randrange(1, 9)), c, float(rng.randrange(50)), day, True, t))
    return rows


def noisy_batches(rows, parts, rng):
    """The rows in order over ``parts`` batches, with open, repeated and late minutes in the later ones."""
    by = sorted(rows, key=lambda r: r[3])
    edges = [i * len(by) // parts for i in range(parts + 1)]
    out = []
    for i in range(parts):
        own = by[edges[i] : edges[i + 1]]
        noise = [(*r[:5], -9.0, -9.0, -9.0, 1e6, *r[9:12], False, r[13]) for r in rng.sample(own, 5)]
        late = [(*r[:5], 900.0, r[6], 900.0, 1e5, *r[9:]) for r in rng.sample(by[: edges[i]], 6)] if i else []
        out.append([*own, *noise, *late])
    return out


def write_feed(spark, root, batches):
    for b in batches:
        spark.createDataFrame(b, MINUTES).coalesce(1).write.mode("append").parquet(root)


def read_feed(spark, root):
    return spark.readStream.schema(MINUTES).option("maxFilesPerTrigger", 1).parquet(root)


def own_rules():
    return [*stock_rules(), R.Rule(
        "level", (R.Condition("far", "1h", lambda f: f["close"] > f["mean4"]), R.Condition("near", "1m", lambda f: f.rsi(5) < 60, "window", 2),
                  R.Condition("go", "5m", lambda f: f["close"] > f.prev("close"), "event")),
        R.Emit("long", ttl_bars=5, cooldown_s=900, dedup_key="{symbol}:{trading_day}:{far_bar_close_ts}:{armed_at}"), universe=("CN.A",),
        at={"mean4": ("15m", lambda f: f.sma("close", 4))}, context={"r": lambda f: f.rsi(5)}, context_by_role={"far": {"e": lambda f: f.ema("close", 3)}})]


def moves_of(df):
    return sorted(tuple(r) for r in df.select("rule_id", "symbol", "rn", "close_ts", "outcome", "stage", "emitted", F.coalesce("dedup_key", F.lit(""))).collect())


def signals_of(df):
    keep = lambda m: sorted((k, None if v is None else round(v, 6)) for k, v in m.items())
    return sorted((r.rule_id, r.symbol, r.direction, r.timeframe, r.fired_at, round(r.trigger_price, 6), r.dedup_key, str(keep(r.context)), str(sorted(r.role_bars.items())), r.priority, str(r.trading_day)) for r in df.collect())


def test_rules_from_raw_minutes_equal_the_batch(spark, tmp_path):
    rows, rng, rules = minute_rows(3), random.Random(4), own_rules()
    minutes = stage(spark.createDataFrame(rows, MINUTES), "m")
    bars = bar_series(minutes, ["5m", "15m", "1h"], with_base=True)
    frames = stage(R.trigger_frames(R.book(bars, rules), rules), "f")
    moves = stage(R.transitions(frames, rules), "mv")
    want, want_signals = moves_of(moves), signals_of(R.signals_of(frames, moves, rules))
    assert len(want) > 100 and {m[0] for m in want} == {r.id for r in rules} and len({s[0] for s in want_signals}) > 2
    batches = noisy_batches(rows, 5, rng)
    root, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    write_feed(spark, root, batches[:3])
    L.run_available(LR.live_rules(read_feed(spark, root), rules), out, ckpt)
    write_feed(spark, root, batches[3:])  # a stop and a start from the checkpoint
    L.run_available(LR.live_rules(read_feed(spark, root), rules), out, ckpt)
    live = spark.read.parquet(out)
    assert moves_of(live) == want
    assert signals_of(LR.signals(live)) == want_signals


def test_primed_rules_continue(spark, tmp_path):
    rows, rules = minute_rows(5, n=1500), own_rules()[-2:]
    by = sorted(rows, key=lambda r: r[3])
    cut = by[len(by) // 2][3]
    root = str(tmp_path / "in")
    write_feed(spark, root, [[r for r in by if r[3] > cut]])
    whole, tail = str(tmp_path / "all"), str(tmp_path / "tail")
    write_feed(spark, str(tmp_path / "whole"), [by])
    L.run_available(LR.live_rules(read_feed(spark, str(tmp_path / "whole")), rules), whole, str(tmp_path / "c1"))
    initial = stage(LR.prime(spark.createDataFrame(rows, MINUTES).filter(F.col("close_ts") <= cut), rules), "primed")
    L.run_available(LR.live_rules(read_feed(spark, root), rules, initial), tail, str(tmp_path / "c2"))
    after = [m for m in moves_of(spark.read.parquet(whole)) if m[3] > cut]
    got = moves_of(spark.read.parquet(tail))
    # a bar that closed before the cut may have become known after it
    assert [m for m in got if m[3] > cut] == after and len(after) > 20
    assert all(m in moves_of(spark.read.parquet(whole)) for m in got)
    bare = LR.prime(spark.createDataFrame(rows, MINUTES), rules, keep_chains=False)
    assert all(pickle.loads(r.state)["chains"] == {} for r in bare.collect())


def test_late_loop_equals_the_batch(spark, tmp_path):
    rng, rows = random.Random(6), minute_rows(7, n=1200)
    batches = noisy_batches(rows, 5, rng)
    held = rng.sample(range(len(batches[1])), 25)  # minutes that come late for the first time
    moved = [batches[1][i] for i in held if batches[1][i][12]]
    batches[1] = [r for r in batches[1] if r not in moved]
    batches[3] += moved
    tfs = ["15m", "4h", "1d", "1w", "1mon"]
    feed, m, b = (str(tmp_path / x) for x in ("in", "minutes", "bars"))
    write_feed(spark, feed, batches[:2])
    run_late_loop(read_feed(spark, feed), m, b, tfs, str(tmp_path / "c"))
    write_feed(spark, feed, batches[2:])
    run_late_loop(read_feed(spark, feed), m, b, tfs, str(tmp_path / "c"))
    last = {}
    for part in batches:
        for r in part:
            if r[12]:
                last[r[0], r[3]] = r
    names = ["symbol", "timeframe", "open_ts", "close_ts", "open", "high", "low", "close", "volume", "open_interest", "trading_day"]
    want = aggregate(spark.createDataFrame(list(last.values()), MINUTES), tfs).select(*names)
    stored = spark.read.parquet(b).select(*names)
    assert spark.read.parquet(m).count() == len(last)
    assert sorted(map(str, stored.collect())) == sorted(map(str, want.collect()))
