"""The stock rules: thresholds and periods are fixed values of the rule set."""

from __future__ import annotations

from tidemark.operators.frame import Frame
from tidemark.operators.rules import Condition, Emit, Rule


def _above_rising(f: Frame):
    e = f.ema("close", 20)
    return (f["close"] > e) & (e > f.prev(e))


def _below_falling(lag: int):
    def when(f: Frame):
        e = f.ema("close", 20)
        return (f["close"] < e) & (e < f.prev(e, lag))
    return when


def _near_average(multiple: float):
    return lambda f: f.abs(f["close"] - f.ema("close", 20)) < f.atr(14) * multiple


def _volume_break(direction: str):
    def when(f: Frame):
        return f.breakout(f.range(20), direction) & (f["volume"] > f.sma("volume", 20) * 1.5)
    return when


def _distance(f: Frame):
    return f.ratio(f.abs(f["close"] - f.ema("close", 20)), f.atr(14))


def _breakout(side: str, universe: tuple[str, ...]) -> Rule:
    up = side == "long"
    return Rule(
        id=f"breakout_{side}", universe=universe,
        conditions=(
            Condition("trend", "1h", _above_rising if up else _below_falling(1)),
            Condition("mid", "1h", _near_average(2.5)),
            Condition("box", "15m", lambda f: f.range_atr(20) < 3.83),
            Condition("brk", "5m", _volume_break("up" if up else "down"), mode="event"),
        ),
        context={"atr14": lambda f: f.atr(14),
                 "vol_ratio": lambda f: f.ratio(f["volume"], f.sma("volume", 20))},
        context_by_role={
            "mid": {"ema20": lambda f: f.ema("close", 20), "dist_atr": _distance},
            "box": {"box_high": lambda f: f.highest("high", 20), "box_low": lambda f: f.lowest("low", 20)},
        },
        emit=Emit(side, ttl_bars=24, cooldown_s=1800, priority="high",
                  dedup_key="{symbol}:{rule}:{box_bar_close_ts}"))


def _zone_context(roles: tuple[str, ...]) -> dict:
    out = {"trend": {"ema20": lambda f: f.ema("close", 20)},
           "zone": {"atr14": lambda f: f.atr(14), "dist_atr": _distance}}
    return {r: out[r] for r in roles}


def zone_long(universe: tuple[str, ...] = ()) -> Rule:
    return Rule(
        id="zone_long", universe=universe,
        conditions=(
            Condition("trend", "1h", _above_rising),
            Condition("zone", "1h", _near_average(0.8)),
            Condition("setup", "5m", lambda f: f.double_bottom(5, 0.003)
                      | f.cross_up(f.macd_dif(), f.macd_dea()), mode="event"),
            Condition("box", "5m", lambda f: f.consolidation(12, 0.005)),
        ),
        context={"atr14": lambda f: f.atr(14), "ema20": lambda f: f.ema("close", 20)},
        context_by_role=_zone_context(("trend", "zone")),
        emit=Emit("long", ttl_bars=48, cooldown_s=1800, priority="high",
                  dedup_key="{symbol}:{rule}:{trend_bar_close_ts}"))


def zone_short(universe: tuple[str, ...] = ()) -> Rule:
    return Rule(
        id="zone_short", universe=universe,
        conditions=(
            Condition("trend", "1h", _below_falling(6)),
            Condition("zone", "1h", _near_average(0.8)),
            Condition("trigger", "5m", _volume_break("down"), mode="event"),
        ),
        context={"atr14": lambda f: f.atr(14), "ema20": lambda f: f.ema("close", 20)},
        context_by_role=_zone_context(("trend", "zone")),
        emit=Emit("short", ttl_bars=48, cooldown_s=1800, priority="high",
                  dedup_key="{symbol}:{rule}:{trend_bar_close_ts}"))


def trend_pullback(universe: tuple[str, ...] = ()) -> Rule:
    def trend(f: Frame):
        fast, slow = f.ema("close", 20), f.ema("close", 60)
        return (fast > slow) & (f["close"] > slow)

    return Rule(
        id="trend_pullback", universe=universe,
        conditions=(
            Condition("trend", "1h", trend),
            Condition("setup", "15m", lambda f: (f.rsi(14) < 45) & ~f.breakout(f.range(20), "down"),
                      mode="window", within=6),
            Condition("trigger", "5m", lambda f: f.cross_up(f["close"], f.ema("close", 20))
                      & (f["volume"] > f.sma("volume", 20) * 1.5), mode="event"),
        ),
        emit=Emit("long", ttl_bars=8, cooldown_s=1800, priority="high",
                  dedup_key="{symbol}:{rule}:{trend_bar_close_ts}"))


def stock_rules(universe: tuple[str, ...] = ()) -> list[Rule]:
    return [_breakout("long", universe), _breakout("short", universe), zone_long(universe),
            zone_short(universe), trend_pullback(universe)]
