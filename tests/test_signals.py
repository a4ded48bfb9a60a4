"""Indicators' edge cases, condition modes, the chain, outcomes, reports, trades."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import close_series, column, ohlc_series
from tidemark.functions import registry as G
from tidemark.functions import scalars as X
from tidemark.operators import baseline as B
from tidemark.operators import chain as H
from tidemark.operators import continuous as CC
from tidemark.operators import quality as Q
from tidemark.operators import trades, views
from tidemark.operators.frame import Frame
from tidemark.operators.outcomes import OutcomeParams, evaluate


def test_one_sided_and_flat_rsi(spark):
    up, flat = Frame(close_series(spark, list(range(1, 30)))), Frame(close_series(spark, [5.0] * 30))
    assert column(up.add(r=up.rsi(14)).build(), "r")[14:] == [100.0] * 15
    got = column(flat.add(r=flat.rsi(14)).build(), "r")
    assert got[:14] == [None] * 14 and got[14:] == [50.0] * 16


def test_flat_window_kdj_and_warm_up(spark):
    f = Frame(close_series(spark, [5.0] * 40))
    d = f.add(k=f.kdj_k(), j=f.kdj_j(), dea=f.macd_dea(), atr=f.atr(14), r=f.range_atr(5)).build()
    assert column(d, "k")[:8] == [None] * 8 and abs(column(d, "k")[20] - 50) < 1e-9 and abs(column(d, "j")[20] - 50) < 1e-9
    assert column(d, "dea")[:33] == [None] * 33 and column(d, "dea")[33] is not None
    assert column(d, "atr")[:13] == [None] * 13 and column(d, "r") == [None] * 40


def test_swing_is_known_only_after_confirmation(spark):
    bars = [(1, 2, 0, 1)] * 5 + [(1, 9, 0, 1)] + [(1, 2, 0, 1)] * 8
    f = Frame(ohlc_series(spark, bars))
    got = column(f.add(s=f.swing_high(3)).build(), "s")
    assert got[7] != 9 and got[8] == 9.0


def test_event_mode_ignores_an_unknown_previous_bar(spark):
    f = Frame(close_series(spark, [1, 2, 3, 1, 5]))
    raw = F.when(F.col("rn") > 1, F.col("close") > 1.5)
    assert column(f.add(e=f.mode(raw, "event")).build(), "e") == [False, False, False, False, True]


def test_scalars(spark):
    df = spark.createDataFrame([(5.0, -3.0, None), (1.0, 0.0, 2.0)], "a double, b double, c double")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    r = df.select(X.mod(a, b), X.div(a, b), X.smallest(a, b, c), X.chain(c, "<", a, "<", b), X.chain(a, "<", b, "<", c)).collect()
    assert tuple(r[0]) == (-1.0, -5 / 3, None, None, False)
    assert tuple(r[1]) == (None, None, 0.0, False, False)


def test_registry_checks_names_and_arguments(spark):
    f = Frame(close_series(spark, [1.0, 2.0]))
    with pytest.raises(KeyError):
        G.call(f, "no_such")
    with pytest.raises(TypeError):
        G.call(f, "sma", "close")
    with pytest.raises(ValueError):
        f.prev("close", 251)
    with pytest.raises(ValueError):
        f.macd_dif(26, 12)


# ------------------------------------------------------------------ the chain

def spec(persistent, ttl=0, cool=0, key="{symbol}:{bar_close_ts}"):
    return H.ChainSpec(tuple(persistent), tuple(f"r{i}" for i in range(len(persistent))), ttl, cool, key, "1h", "long")


def run(sp, oks, step=60, key_ts=None):
    rows = [("r", "s", i, (i + 1) * step, np.array(ok, dtype=object), [key_ts(i) if key_ts else 0] * sp.length, None) for i, ok in enumerate(oks)]
    return [(r[2], r[4], r[5], r[6]) for r in H.run_block(H.ChainState(), sp, pd.DataFrame(rows, columns=H.COLUMNS))]


def test_several_stages_in_one_bar_and_rest_stage():
    assert run(spec([1, 0]), [(True, True), (True, False), (True, True)]) == [(0, "fired", 1, True), (2, "fired", 1, True)]


def test_retreat_beats_the_trigger():
    assert run(spec([1, 0, 0]), [(True, True, False), (False, True, True)])[-1] == (1, "retreated", 0, False)
    assert run(spec([1, 0, 0]), [(True, True, False), (None, True, True)])[-1][1] == "retreated"


def test_only_state_conditions_hold_the_chain():
    assert run(spec([0, 0]), [(True, False), (False, True)])[-1][1] == "fired"


def test_ttl_expires_to_the_stage_before():
    got = run(spec([1, 0, 0], ttl=2), [(True, True, False)] + [(True, False, False)] * 3)
    assert got == [(0, "advanced", 2, False), (3, "expired", 1, False)]


def test_cooldown_is_exact_and_release_bar_counts():
    got = run(spec([1, 0], cool=120), [(True, True)] * 4)
    assert [(i, o, e) for i, o, _, e in got] == [(0, "fired", True), (2, "fired", True)]
    idle = run(spec([1, 0], cool=60), [(True, True), (True, False)])
    assert idle[-1][:2] == (1, "cooled")


def test_duplicate_key_aborts_without_cooldown():
    got = run(spec([1, 0], cool=60, key="{symbol}:{r0_bar_close_ts}"), [(True, True), (True, False), (True, True), (True, True)], key_ts=lambda i: i // 3)
    assert [(o, e) for _, o, _, e in got] == [("fired", True), ("cooled", False), ("fired", False), ("fired", True)]


def test_numpy_booleans_count():
    rows = [("r", "s", 0, 60, np.array([True, True]), [0, 0], None)]
    assert H.run_block(H.ChainState(), spec([1, 0]), pd.DataFrame(rows, columns=H.COLUMNS))[0][4] == "fired"


def test_memory_forgets_the_oldest_key():
    st = H.ChainState()
    for i in range(H.MEMORY + 1):
        assert H.remember(st, f"k{i}")
    assert H.remember(st, "k0") and not H.remember(st, f"k{H.MEMORY}")


FOLDED = [spec([1, 0, 0], 3, 120, "{symbol}:{r0_bar_close_ts}"), spec([1, 0], 2, 300, "{symbol}:{armed_at}"), spec([0, 1, 1, 0], 0, 0, "{r1_bar_close_ts}"), spec([1], 0, 180, "{symbol}:{r0_bar_close_ts}")]


@pytest.mark.parametrize("piece_rows", [1, 7, 64, 1000])
def test_fold_in_pieces_equals_one_pass(spark, piece_rows):
    """Whatever the pieces, also where keys repeat across them and where a state lasts over several."""
    rng, specs = random.Random(3), {f"rule{i}": sp for i, sp in enumerate(FOLDED)}
    rows = [(r, s, i, i * 60, i * 60, [rng.choice([True, rng.random() < 0.5, None]) if s != "c" else False for _ in range(sp.length)], [i // 40] * sp.length, None)
            for r, sp in specs.items() for s in "abc" for i in range(1, 12 if piece_rows == 1 else 260)]
    df = spark.createDataFrame(rows, "rule_id string, symbol string, rn bigint, close_ts bigint, emit_ts bigint, satisfied array<boolean>, role_ts array<bigint>, trading_day string")
    got = sorted(tuple(r) for r in H.fold(df.repartition(3), specs, piece_rows).select(*H.OUT[:-1], F.coalesce("dedup_key", F.lit(""))).collect())
    want = []
    for r, sp in specs.items():
        for s in "abc":
            pdf = pd.DataFrame([(x[0], x[1], x[2], x[3], x[5], x[6], x[7]) for x in rows if x[:2] == (r, s)], columns=H.COLUMNS)
            want += [(*o[:7], o[7] or "") for o in H.run_block(H.ChainState(), sp, pdf)]
    assert got == sorted(want)


def test_a_hot_series_runs_on_several_tasks(spark):
    """One (rule, symbol) holds all rows: its pieces are dealt to tasks, and memory beyond 512 keys matters across them."""
    sp = spec([1], 0, 0, "{r0_bar_close_ts}")
    rows = [("r", "hot", i, i * 60, i * 60, [True], [i % 700], None) for i in range(1, 2101)]
    df = spark.createDataFrame(rows, "rule_id string, symbol string, rn bigint, close_ts bigint, emit_ts bigint, satisfied array<boolean>, role_ts array<bigint>, trading_day string")
    got = H.fold(df, {"r": sp}, 100)
    pdf = pd.DataFrame([(x[0], x[1], x[2], x[3], x[5], x[6], x[7]) for x in rows], columns=H.COLUMNS)
    want = H.run_block(H.ChainState(), sp, pdf)
    assert sorted((r.rn, r.emitted) for r in got.collect()) == sorted((o[2], o[6]) for o in want)
    assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().toString()  # the rounds are written, not recomputed
    few = H.fold(spark.createDataFrame([(*x[:6], [x[2] % 300], None) for x in rows], df.schema), {"r": sp}, 100)
    assert few.filter("emitted").count() == 300


# ------------------------------------------------------------------ outcomes

def label(spark, bars, at=1, direction="long", params=None, atr=None, price=10.0):
    sig = spark.createDataFrame([("r", "T.X", direction, "1h", at * 3600, price, "k", {"atr14": atr} if atr else {})],
                                "rule_id string, symbol string, direction string, timeframe string, fired_at bigint, trigger_price double, dedup_key string, context map<string,double>")
    return evaluate(sig, ohlc_series(spark, bars), params or OutcomeParams(horizon_bars=3, stop_pct=0.1, target_pct=0.2)).first()


def test_entry_is_the_next_open_and_stop_wins(spark):
    r = label(spark, [(9, 9, 9, 9), (10, 13, 8, 11), (11, 11, 11, 11)])
    assert (r.entry_price, r.reason, r.exit_price, r.bars_held) == (10.0, "stop", 9.0, 1)
    assert abs(r.ret + 0.1) < 1e-12 and abs(r.mfe - 0.3) < 1e-12 and abs(r.mae + 0.2) < 1e-12


def test_target_horizon_short_and_cost(spark):
    bars = [(9, 9, 9, 9), (10, 10.5, 9.5, 10), (10, 12.5, 10, 12), (1, 1, 1, 1)]
    assert label(spark, bars).reason == "target"
    short = label(spark, bars, direction="short", params=OutcomeParams(horizon_bars=1, stop_pct=0.5, target_pct=0.5, cost_bps=10))
    assert short.reason == "horizon" and abs(short.ret + 0.002) < 1e-12 and short.gross_ret == 0
    assert label(spark, bars, direction="short").reason == "stop"


def test_atr_distances_and_basis(spark):
    r = label(spark, [(9, 9, 9, 9), (10, 13.1, 9, 11)], atr=1.0)
    assert (r.reason, r.exit_price, r.exit_basis) == ("target", 13.0, "atr")


def test_no_data_cases(spark):
    bars = [(9, 9, 9, 9), (0, 1, 0, 1)]
    assert label(spark, bars, at=1).reason == "no_data"     # entry price not positive
    assert label(spark, bars, at=2).reason == "no_data"     # nothing after
    assert label(spark, bars, at=0).reason == "no_data"     # series starts later
    assert label(spark, bars, at=0).exit_basis == "pct"


def outcomes(spark, rows):
    """rows: (symbol, direction, reason, ret, entry_ts, exit_ts)."""
    return spark.createDataFrame([("r", s, d, "1h", e, e, x, why, r, 0.1, -0.1, 2, "pct") for s, d, why, r, e, x in rows],
                                 "rule_id string, symbol string, direction string, timeframe string, fired_at bigint, entry_ts bigint, exit_ts bigint, reason string, ret double, mfe double, mae double, bars_held bigint, exit_basis string")


def test_neutral_is_left_out_of_rates(spark):
    o = outcomes(spark, [("a", "long", "target", 0.2, 1, 2), ("a", "long", "stop", -0.1, 3, 4), ("a", "neutral", "horizon", 9.0, 5, 6), ("a", "long", "no_data", 0.0, 0, 0)])
    r = Q.summarize(o, []).first()
    assert (r.signals, r.evaluated, r.directional, r.wins, r.losses) == (4, 3, 2, 1, 1)
    assert abs(r.avg_return - 0.05) < 1e-12 and abs(r.median_return - 0.05) < 1e-12 and abs(r.payoff - 2) < 1e-12


def test_overlap_lowers_the_effective_size(spark):
    rng = random.Random(5)
    rows = [(s, "long", "target", rng.uniform(-1, 1), e, e + rng.randrange(0, 40)) for s in "ab" for e in [rng.randrange(200) for _ in range(60)]]
    got = B.effective_n(outcomes(spark, rows), []).first()
    total = sum(1 for a in rows for b in rows if a[0] == b[0] and b[4] <= a[5] and b[5] >= a[4])
    assert got.n == 120 and abs(got.n_eff - 120 / (total / 120)) < 1e-9 and got.n_eff < 120


# ------------------------------------------------------------------ tables

def test_both_directions_stay_two_markers(spark):
    sig = spark.createDataFrame([("a", "s", "long", "1h", 10, 1.0, "k1", "high", False, 20), ("b", "s", "short", "1h", 10, 1.0, "k2", "odd", False, 20), ("c", "s", "long", "4h", 10, 1.0, "k3", "high", False, 20)],
                                "rule_id string, symbol string, direction string, timeframe string, fired_at bigint, trigger_price double, dedup_key string, priority string, tentative boolean, bucket_ts bigint")
    got = {r.direction: r for r in views.collapse(sig, members=True).collect()}
    assert got["long"]["count"] == 2 and got["long"].rule_id == "c" and [m.rule_id for m in got["long"].members] == ["c", "a"]
    assert got["short"]["count"] == 1 and got["short"].priority == "normal"


def test_open_and_orphan_trades(spark):
    f = spark.createDataFrame([("k1", "s", "buy", 1.0, 10.0, 5, "entry", 0.0, 0.0), ("k1", "s", "sell", 1.0, 11.0, 9, "target", 0.0, 1.0), ("k1", "s", "sell", 1.0, 12.0, 12, "stop", 0.0, 2.0),
                               ("k2", "s", "buy", 1.0, 10.0, 5, "entry", 0.0, 0.0), ("k3", "s", "sell", 1.0, 10.0, 5, "stop", 0.0, 0.0)],
                              "signal_key string, symbol string, side string, qty double, price double, ts bigint, kind string, fee double, realized double")
    dim = spark.createDataFrame([("s", 10.0)], "uid string, multiplier double")
    got = {r.signal_key: r for r in trades.pair_trades(trades.with_notional(f, dim)).collect()}
    assert set(got) == {"k1", "k2"} and got["k2"].open and got["k2"].realized is None
    assert got["k1"].exit_ts == 9 and abs(got["k1"].pnl_pct - 1.0) < 1e-12


def test_three_contracts_accumulate_backwards(spark):
    days = [f"2024-01-0{i}" for i in range(1, 10)]
    rows = []
    for c, base in (("a", 100.0), ("b", 110.0), ("c", 130.0)):
        for i, d in enumerate(days):
            rows.append((c, "1d", i * 86400, (i + 1) * 86400, base + i, base + i + 1, base + i - 1, base + i, 5.0, 0.0, 0.0, d))
    bars = spark.createDataFrame(rows, "symbol string, timeframe string, open_ts bigint, close_ts bigint, open double, high double, low double, close double, volume double, money double, open_interest double, trading_day string")
    seg = spark.createDataFrame([("P", "a", days[0], days[2]), ("P", "b", days[3], days[5]), ("P", "c", days[6], days[8])], "product string, contract string, start_day string, end_day string")
    rolls = CC.rollovers(seg, bars)
    assert [(r.from_contract, r.diff, r.cum_offset) for r in rolls.orderBy("at_day").collect()] == [("a", 10.0, 30.0), ("b", 20.0, 20.0)]
    out = CC.stitch(seg, bars).orderBy("close_ts").collect()
    assert [r.close for r in out] == [130.0 + i for i in range(9)] and {r.volume for r in out} == {5.0}
    assert CC.stitch_problems(seg, bars, rolls, CC.stitch(seg, bars)).isEmpty()
    gone = bars.filter("symbol <> 'c' OR trading_day >= '2024-01-07'")
    assert [r.problem for r in CC.stitch_problems(seg, gone, CC.rollovers(seg, gone), CC.stitch(seg, gone)).collect()] == ["no common bar"]


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_labels_equal_a_walk_over_the_bars(spark, block_rows):
    """The descent over extremes against bar-by-bar loops: gaps over both barriers, ties, ends of series, both directions, a ladder."""
    rng = random.Random(block_rows)
    price, bars = 100.0, []
    for _ in range(300):
        o = price + rng.choice([0, 0, 0, 6.0, -6.0])
        c = o + rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0])
        bars.append((o, max(o, c) + rng.choice([0, 1.0]), min(o, c) - rng.choice([0, 1.0]), c))
        price = max(c, 20.0)
    table = ohlc_series(spark, bars)
    rows = [("r", "T.X", "1h", d, i * 3600, 100.0, rng.choice([None, 0.0, 1.5])) for i in range(1, 301) for d in ("long", "short", "neutral")]
    sig = spark.createDataFrame(rows, "rule_id string, symbol string, timeframe string, direction string, fired_at bigint, trigger_price double, atr double")
    at = table.select("symbol", "timeframe", F.col("close_ts").alias("fired_at"), F.col("rn").alias("base_rn"), "next_open", "next_close_ts")
    entries = sig.join(at, ["symbol", "timeframe", "fired_at"])
    p = OutcomeParams(horizon_bars=9, stop_pct=0.03, target_pct=0.05, cost_bps=1.0)

    def walk(i, d, atr, h):
        if i >= 300:
            return None
        entry, s = bars[i][0], -1.0 if d == "short" else 1.0
        sd, td = (atr * 1.5, atr * 3.0) if atr else (entry * 0.03, entry * 0.05)
        stop, target = entry - s * sd, entry + s * td
        mx, mn = -1e9, 1e9
        for k in range(i, min(i + h, 300)):
            _, hi, lo, c = bars[k]
            mx, mn = max(mx, hi), min(mn, lo)
            why, px = ("stop", stop) if (lo <= stop if s > 0 else hi >= stop) else ("target", target) if (hi >= target if s > 0 else lo <= target) else (None, c)
            if why:
                break
        ends = sorted(((m - entry) / entry * s) for m in (mx, mn))
        return why or "horizon", (px - entry) / entry * s - 2e-4, k - i + 1, (k + 1) * 3600, max(0.0, ends[1]), min(0.0, ends[0])
    got = {(r.fired_at, r.direction, r.bars_held if r.reason == "no_data" else -1): r for r in label_all(entries, table, p, block_rows)}
    assert len(got) == 900
    atr_of = {(r[4], r[3]): r[6] for r in rows}
    for (t, d, _), r in got.items():
        want = walk(t // 3600, d, atr_of[t, d], 9)
        if want is None:
            assert (r.reason, r.ret, r.exit_ts, r.mfe) == ("no_data", 0.0, 0, 0.0)
        else:
            assert r.reason == want[0] and r.bars_held == want[2] and r.exit_ts == want[3]
            assert max(abs(r.ret - want[1]), abs(r.mfe - want[4]), abs(r.mae - want[5])) < 1e-12
    from tidemark.operators.outcomes import ladder_returns
    steps = {(r.fired_at, r.direction, r.bars): r.ret for r in ladder_returns(entries, table, p, [1, 3, 9], ["rule_id", "symbol", "direction", "fired_at"], block_rows).collect()}
    assert len(steps) == 299 * 9
    assert all(abs(ret - walk(t // 3600, d, atr_of[t, d], h)[1]) < 1e-12 for (t, d, h), ret in steps.items())


def label_all(entries, table, params, block_rows):
    from tidemark.operators.outcomes import label

    out = label(entries, table, params, ["rule_id", "symbol", "direction", "fired_at"], block_rows)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]
    return out.collect()
