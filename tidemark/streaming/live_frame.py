"""The builders of a ``Frame`` over a live series: the same conditions, evaluated batch by batch.

A :class:`LiveFrame` holds the new bars of one series behind as many old ones as its windows reach back, and
offers the methods of ``operators.frame.Frame``, so a rule's functions run on either.  Windows work on whole
arrays.  Recurrences are affine maps, ``y -> q**k y + c`` after k bars; only y (and the sum of the samples until the
seed is complete) is carried from batch to batch, and a batch is worked off in blocks, each one product with the
triangle of powers of q.

NULL is NaN; flags are 1, 0 and NaN with Kleene's ``& | ~``.  Functions of ``pyspark.sql.functions`` don't apply
here; ``Frame.abs`` and ``Frame.ratio`` stand in for the two that rules need.
"""

from __future__ import annotations

import sys

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 128
FIELDS = ("open", "high", "low", "close", "volume", "money", "open_interest")
LEAST_ROWS = 8  # rows kept of any series, for readers on another clock


class Values:
    """One value per row, with the number of earlier rows that it reads."""

    __hash__ = None

    def __init__(self, v: np.ndarray, depth: int = 0):
        self.v, self.depth = v, depth

    def _with(self, other, op, flag: bool = False) -> Values:
        o, depth = (other.v, other.depth) if isinstance(other, Values) else (float(other), 0)
        with np.errstate(all="ignore"):
            out = op(self.v, o)
        if flag:
            out = np.where(np.isnan(self.v) | np.isnan(o), np.nan, out)
        return Values(out.astype(float), max(self.depth, depth))

    def __add__(self, o): return self._with(o, lambda a, b: a + b)
    def __radd__(self, o): return self._with(o, lambda a, b: b + a)
    def __sub__(self, o): return self._with(o, lambda a, b: a - b)
    def __rsub__(self, o): return self._with(o, lambda a, b: b - a)
    def __mul__(self, o): return self._with(o, lambda a, b: a * b)
    def __rmul__(self, o): return self._with(o, lambda a, b: b * a)
    def __truediv__(self, o): return self._with(o, lambda a, b: np.where(b == 0, np.nan, a / np.where(b == 0, 1, b)))
    def __rtruediv__(self, o): return self._with(o, lambda a, b: np.where(a == 0, np.nan, b / np.where(a == 0, 1, a)))
    def __neg__(self): return Values(-self.v, self.depth)
    def __lt__(self, o): return self._with(o, np.less, True)
    def __le__(self, o): return self._with(o, np.less_equal, True)
    def __gt__(self, o): return self._with(o, np.greater, True)
    def __ge__(self, o): return self._with(o, np.greater_equal, True)
    def __eq__(self, o): return self._with(o, np.equal, True)
    def __ne__(self, o): return self._with(o, np.not_equal, True)
    def __and__(self, o): return self._with(o, lambda a, b: np.where((a == 0) | (b == 0), 0.0, a * b))
    def __or__(self, o): return self._with(o, lambda a, b: np.where((a == 1) | (b == 1), 1.0, a + b))
    def __invert__(self): return Values(1 - self.v, self.depth)
    __rand__, __ror__ = __and__, __or__

    def cast(self, _kind: str) -> Values:
        return self

    def isNull(self) -> Values:  # noqa: N802 - the Column's name
        return Values(np.isnan(self.v).astype(float), self.depth)

    def isNotNull(self) -> Values:  # noqa: N802
        return ~self.isNull()


def _shifted(v: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.full(min(n, len(v)), np.nan), v[: max(len(v) - n, 0)]])


def _windows(v: np.ndarray, n: int) -> np.ndarray:
    return sliding_window_view(np.concatenate([np.full(n - 1, np.nan), v]), n)


def affine_run(x: np.ndarray, y: float, q: float, a: float) -> np.ndarray:
    """``y = q y + a x`` along x, a block at a time: y's share is q**k, x's a product with the powers' triangle."""
    out = np.empty(len(x))
    k = np.arange(BLOCK)
    triangle = np.where(k[:, None] >= k, q ** np.maximum(k[:, None] - k, 0), 0.0) * a if len(x) else None
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK]
        m = len(part)
        out[i : i + m] = triangle[:m, :m] @ part + q ** (k[:m] + 1) * y
        y = out[i + m - 1]
    return out


class LiveFrame:
    """``rows``: arrays by field, with rn and prev_close; the first ``old`` rows are known from before.  ``memory`` is
    what :meth:`finish` returned then."""

    def __init__(self, rows: dict[str, np.ndarray], old: int, memory: dict | None = None):
        self.rows, self.old, self.memory = rows, old, memory or {}
        self.n, self.depth = len(rows["rn"]), 0
        self.done: dict[str, tuple[list[np.ndarray], object]] = {}

    def finish(self, kept: int) -> dict:
        """What the next frame needs, when ``kept`` rows of this one stay."""
        return {name: ([v[self.n - kept :] for v in tails], state) for name, (tails, state) in self.done.items()}

    def __getitem__(self, field: str) -> Values:
        return Values(self.rows[field])

    def _note(self, v: Values) -> Values:
        self.depth = max(self.depth, v.depth)
        return v

    def _source(self, src) -> Values:
        return self[src] if isinstance(src, str) else src if isinstance(src, Values) else Values(np.full(self.n, float(src)))

    def _carried(self, name: str, state, compute) -> list[np.ndarray]:
        """Columns that depend on all earlier rows: ``compute(state)`` gives them for the new rows, with the state after."""
        if name not in self.done:
            tails, before = self.memory.get(name, (None, state))
            fresh, after = compute(before)
            self.done[name] = [np.concatenate([t, f]) for t, f in zip(tails or [np.full(self.old, np.nan)] * len(fresh), fresh, strict=True)], after
        return self.done[name][0]

    # ---- the two functions, neighbours and windows

    def abs(self, x) -> Values:
        x = self._source(x)
        return Values(np.abs(x.v), x.depth)

    def ratio(self, a, b) -> Values:
        return self._source(a) / self._source(b)

    def prev(self, x, n: int = 1) -> Values:
        x = self._source(x)
        return self._note(Values(_shifted(x.v, n), x.depth + n))

    def _rolling(self, src, n: int, agg) -> Values:
        x = self._source(src)
        return self._note(Values(agg(_windows(x.v, n), axis=1) if self.n else x.v, x.depth + n))

    def sma(self, src, n): return self._rolling(src, n, np.mean)
    def rolling_sum(self, src, n): return self._rolling(src, n, np.sum)
    def std(self, src, n): return self._rolling(src, n, np.std)
    def highest(self, src, n): return self._rolling(src, n, np.max)
    def lowest(self, src, n): return self._rolling(src, n, np.min)
    def boll_mid(self, n=20, k=2.0): return self.sma("close", n)
    def boll_upper(self, n=20, k=2.0): return self.sma("close", n) + k * self.std("close", n)
    def boll_lower(self, n=20, k=2.0): return self.sma("close", n) - k * self.std("close", n)

    def boll_width(self, n=20, k=2.0) -> Values:
        mid = self.boll_mid(n, k)
        return self._choose(mid == 0, 0.0, (self.boll_upper(n, k) - self.boll_lower(n, k)) / mid)

    def _choose(self, flag: Values, yes, no) -> Values:
        yes, no = self._source(yes), self._source(no)
        return Values(np.where(flag.v == 1, yes.v, no.v), max(flag.depth, yes.depth, no.depth))

    def cross_up(self, a, b): return self._cross(a, b, lambda x, y: x > y)
    def cross_down(self, a, b): return self._cross(a, b, lambda x, y: x < y)

    def _cross(self, a, b, beyond) -> Values:
        a, b = self._source(a), self._source(b)
        before, now = beyond(self.prev(a), self.prev(b)), beyond(a, b)
        return Values(np.where(np.isnan(before.v) | np.isnan(now.v), np.nan, (before.v == 0) & (now.v == 1)), before.depth)

    # ---- recurrences

    def _recur(self, name: str, x: Values, n: int, q: float, a: float, start: int = 1, seed: float | None = None) -> Values:
        def compute(state):
            y, total = state
            rn, own = self.rows["rn"][self.old :], x.v[self.old :]
            first = start if seed is not None else start + n - 1
            out = np.full(len(own), np.nan)
            if seed is None:
                warm = (rn >= start) & (rn <= first)
                total += float(own[warm].sum())
                if (rn == first).any():
                    out[rn == first] = y = total / n
            live = rn >= start if seed is not None else rn > first
            out[live] = affine_run(own[live], y, q, a)
            return [out], (float(out[live][-1]) if live.any() else y, total)
        return self._note(Values(self._carried(name, (seed, 0.0), compute)[0], x.depth))

    def _mean(self, name, x, n, wild=False, start=1) -> Values:
        return self._recur(name, x, n, (n - 1) / n if wild else (n - 1) / (n + 1), 1 / n if wild else 2 / (n + 1), start)

    def ema(self, src, n): return self._mean(f"ema_{src}_{n}", self[src], n)
    def wilder(self, src, n): return self._mean(f"wilder_{src}_{n}", self[src], n, True)

    def atr(self, n: int = 14) -> Values:
        h, low, p = (self.rows[c] for c in ("high", "low", "prev_close"))
        return self._mean(f"atr_{n}", Values(np.fmax(h - low, np.fmax(np.abs(h - p), np.abs(low - p)))), n, True)

    def rsi(self, src="close", n: int = 14) -> Values:
        if not isinstance(src, str):
            src, n = "close", src
        move = self[src] - (self["prev_close"] if src == "close" else self.prev(src))
        gain, loss = (self._mean(f"_{k}_{src}_{n}", Values(np.maximum(s * move.v, 0), move.depth), n, True, 2) for k, s in (("gain", 1), ("loss", -1)))
        flat = self._choose(gain > 0, 100.0, self._choose(gain == 0, 50.0, np.nan))
        return self._choose(loss == 0, flat, 100.0 - 100.0 / (1.0 + gain / loss))

    def _macd(self, fast, slow, signal) -> tuple[Values, Values]:
        dif = self.ema("close", fast) - self.ema("close", slow)
        dea = self._mean(f"_dea_{fast}_{slow}_{signal}", dif, signal, start=slow)
        return self._choose(dea.isNotNull(), dif, np.nan), dea

    def macd_dif(self, fast=12, slow=26, signal=9): return self._macd(fast, slow, signal)[0]
    def macd_dea(self, fast=12, slow=26, signal=9): return self._macd(fast, slow, signal)[1]

    def macd_hist(self, fast=12, slow=26, signal=9) -> Values:
        dif, dea = self._macd(fast, slow, signal)
        return 2.0 * (dif - dea)

    def _kdj(self, n, m1, m2) -> tuple[Values, Values]:
        hi, lo = self.highest("high", n), self.lowest("low", n)
        rsv = self._choose(hi == lo, 50.0, (self["close"] - lo) / (hi - lo) * 100.0)
        k = self._recur(f"_k_{n}_{m1}", rsv, 1, (m1 - 1) / m1, 1 / m1, n, 50.0)
        return k, self._recur(f"_d_{n}_{m1}_{m2}", k, 1, (m2 - 1) / m2, 1 / m2, n, 50.0)

    def kdj_k(self, n=9, m1=3, m2=3): return self._kdj(n, m1, m2)[0]
    def kdj_d(self, n=9, m1=3, m2=3): return self._kdj(n, m1, m2)[1]

    def kdj_j(self, n=9, m1=3, m2=3) -> Values:
        k, d = self._kdj(n, m1, m2)
        return 3.0 * k - 2.0 * d

    # ---- candles and structure

    def range(self, n: int) -> dict[str, Values]:
        before = {c: self.prev(f(c, n)) for c, f in (("high", self.highest), ("low", self.lowest))}
        return before

    @staticmethod
    def range_width(box): return box["high"] - box["low"]
    @staticmethod
    def range_mid(box): return (box["high"] + box["low"]) / 2

    def breakout(self, box, direction="up") -> Values:
        return self["close"] > box["high"] if direction == "up" else self["close"] < box["low"]

    def gap(self, direction="up") -> Values:
        return self["low"] > self.prev("high") if direction == "up" else self["high"] < self.prev("low")

    def engulfing(self, direction="up") -> Values:
        po, pc, o, c = self.prev("open"), self.prev("close"), self["open"], self["close"]
        s = 1.0 if direction == "up" else -1.0
        return self._choose(po.isNotNull(), (s * pc < s * po) & (s * c > s * o) & (s * c >= s * po) & (s * o <= s * pc), np.nan)

    def pin_bar(self, direction="up", ratio=2.0) -> Values:
        o, h, low, c = (self.rows[x] for x in ("open", "high", "low", "close"))
        top, tail = h - np.maximum(o, c), np.minimum(o, c) - low
        shadow, other = (tail, top) if direction == "up" else (top, tail)
        return Values(((h != low) & (shadow >= ratio * np.abs(c - o)) & (other <= shadow / ratio)).astype(float))

    def consolidation(self, n, max_width=0.02) -> Values:
        hi, lo = self.highest("high", n), self.lowest("low", n)
        return (hi - lo) / ((hi + lo) / 2) <= max_width

    def range_atr(self, n, atr_n=14) -> Values:
        atr = self.atr(atr_n)
        return self._choose(atr > 0, (self.highest("high", n) - self.lowest("low", n)) / atr, np.nan)

    def inside_bar(self) -> Values:
        return (self["high"] <= self.prev("high")) & (self["low"] >= self.prev("low"))

    def _pivots(self, side: str, n: int) -> list[int]:
        """New rows that confirm a swing ``n`` rows back (extreme of the 2n + 1 rows around it, ties qualify)."""
        self.depth = max(self.depth, 2 * n)
        new, x = np.arange(self.old, self.n), self.rows[side]
        new = new[new >= 2 * n]
        if not len(new):
            return []
        around = sliding_window_view(x, 2 * n + 1)[new - 2 * n]
        return new[x[new - n] == (around.max(axis=1) if side == "high" else around.min(axis=1))].tolist()

    def swing(self, side: str, n: int = 5) -> dict[str, Values]:
        names = ("price", "rn", "prev_price", "prev_rn")

        def compute(last):
            out = np.full((4, self.n - self.old), np.nan)
            at = 0
            for r in self._pivots(side, n):
                out[:, at : r - self.old] = np.array(last)[:, None]
                last, at = (float(self.rows[side][r - n]), float(self.rows["rn"][r - n]), *last[:2]), r - self.old
            out[:, at:] = np.array(last)[:, None]
            return list(out), last
        columns = self._carried(f"swing_{side}_{n}", (np.nan,) * 4, compute)
        return {k: self._note(Values(v, 2 * n)) for k, v in zip(names, columns, strict=True)}

    def swing_high(self, n=5, back=0): return self.swing("high", n)["price" if back == 0 else "prev_price"]
    def swing_low(self, n=5, back=0): return self.swing("low", n)["price" if back == 0 else "prev_price"]
    def double_bottom(self, n=5, tol=0.003): return self._double("low", n, tol)
    def double_top(self, n=5, tol=0.003): return self._double("high", n, tol)

    def _double(self, side: str, n: int, tol: float) -> Values:
        other, extreme = ("low", np.fmin) if side == "high" else ("high", np.fmax)

        def compute(state):
            price, neck, verdict = state  # of the last swing; what lies between it and the newest row that may be one
            out, at, begin = np.full(self.n - self.old, np.nan), 0, max(self.old - n, 0)
            for r in self._pivots(side, n):
                neck = float(extreme.reduce(self.rows[other][begin : r - n], initial=neck))
                new, old, begin = float(self.rows[side][r - n]), price, r - n + 1
                out[at : r - self.old], at = verdict, r - self.old
                if not np.isnan(old):
                    base = min(abs(new), abs(old))
                    depth = min(new, old) - neck if side == "high" else neck - max(new, old)
                    verdict = np.nan if base <= 0 else float(abs(new - old) / base <= tol and depth / base >= tol)
                price, neck = new, np.nan
            out[at:] = verdict
            end = max(self.n - n, begin)
            return [out], (price, float(extreme.reduce(self.rows[other][begin:end], initial=neck)), verdict)
        return self._note(Values(self._carried(f"double_{side}_{n}_{tol}", (np.nan,) * 3, compute)[0], 2 * n))

    # ---- conditions over time

    def step(self, _name: str, x: Values, back: int = 0) -> Values:
        return x

    def mode(self, x: Values, mode: str = "state", within: int = 1) -> Values:
        if mode == "state":
            return x
        if mode == "event":
            return self._note(Values(((x.v == 1) & (_shifted(x.v, 1) == 0)).astype(float), x.depth + 1))
        if mode == "window":
            # rows before the series are no rows: they are neither seen nor unknown
            w = _windows(x.v, within) if self.n else x.v[:, None]
            missing = np.maximum(within - self.rows["rn"], 0)
            blank = np.isnan(w).sum(axis=1) > missing
            return self._note(Values(np.where((w == 1).any(axis=1), 1.0, np.where(blank, np.nan, 0.0)), x.depth + within))
        raise ValueError(f"unknown mode {mode!r}")
