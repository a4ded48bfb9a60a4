"""Indicators and patterns of an indexed bar series, as Column builders.

A :class:`Frame` collects what is asked of it and computes it in as few passes as possible:
series-wide structure (swings, KDJ inputs) first, then all recurrences together, then every
bounded window in one blocked pass.

    f = Frame(bars)
    f.add(trend=f["close"] > f.ema("close", 20), box=f.range_atr(20) < 3.8)
    table = f.build()

Missing history is NULL and NULL propagates, so an unfinished warm-up never counts as true.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import BLOCK_ROWS, block_window, core_rows, to_blocks
from tidemark.plans.chunks import CHUNK_ROWS, rn_chunk, scan
from tidemark.plans.recurrence import Recurrence, ema, linear_scan, smooth, wilder
from tidemark.plans.staging import stage
from tidemark.schema import BAR_FIELDS, KEYS

HISTORY = 250  # fixed value: the furthest ``prev`` may reach


def _count(n) -> int:
    if isinstance(n, bool) or int(n) != n or n < 1:
        raise ValueError(f"a row count must be an integer >= 1, not {n!r}")
    return int(n)


def _side(direction: str) -> bool:
    if direction not in ("up", "down"):
        raise ValueError(f"dir must be 'up' or 'down', not {direction!r}")
    return direction == "up"


def true_range() -> Column:
    """High-low for the first bar, else the widest reach including the previous close."""
    h, low, p = F.col("high"), F.col("low"), F.col("prev_close")
    return F.greatest(h - low, F.abs(h - p), F.abs(low - p))  # greatest skips the missing p


class Frame:
    def __init__(self, bars: DataFrame, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS):
        self.bars, self.block_rows, self.chunk_rows = bars, block_rows, chunk_rows
        self.w = block_window(KEYS)
        self.back = self.ahead = 0
        self._pre: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self._points: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self._scans: list[dict[str, Recurrence]] = [{}, {}]
        self._ready: dict[str, Column] = {}
        self._steps: dict[str, Column] = {}
        self._out: dict[str, Column] = {}

    # ---- building blocks

    def __getitem__(self, field: str) -> Column:
        return F.col(field)

    def add(self, **columns: Column) -> "Frame":
        self._out.update(columns)
        return self

    def step(self, name: str, expr: Column, back: int = 0) -> Column:
        """Register one column of the blocked pass; ``back`` is how many earlier rows it reads."""
        if name not in self._steps:
            self._steps[name] = expr
            self.back += back
        return F.col(name)

    def _source(self, src: str | Column) -> tuple[Column, str]:
        if isinstance(src, str):
            return F.col(src), src
        name = f"x{len(self._steps)}"
        return self.step(name, src), name

    def _last(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def _full(self, value: Column, agg: Column, n: int) -> Column:
        return F.when(F.count(value).over(self._last(n)) == n, agg.over(self._last(n)))

    def _series_field(self, src: str) -> Column:
        if src not in BAR_FIELDS:
            raise ValueError(f"a recurrence runs over a bar field, not {src!r}")
        return F.col(src)

    @staticmethod
    def abs(x: Column) -> Column:
        return F.abs(x)

    @staticmethod
    def ratio(a: Column, b: Column) -> Column:
        """a / b, NULL where b is zero."""
        return F.try_divide(a, b)

    # ---- rolling windows

    def sma(self, src, n: int) -> Column:
        n = _count(n)
        x, name = self._source(src)
        return self.step(f"sma_{name}_{n}", self._full(x, F.avg(x), n), n)

    def rolling_sum(self, src, n: int) -> Column:
        n = _count(n)
        x, name = self._source(src)
        return self.step(f"sum_{name}_{n}", self._full(x, F.sum(x), n), n)

    def std(self, src, n: int) -> Column:
        n = _count(n)
        x, name = self._source(src)
        return self.step(f"std_{name}_{n}", self._full(x, F.stddev_pop(x), n), n)

    def highest(self, src, n: int) -> Column:
        n = _count(n)
        x, name = self._source(src)
        return self.step(f"highest_{name}_{n}", self._full(x, F.max(x), n), n)

    def lowest(self, src, n: int) -> Column:
        n = _count(n)
        x, name = self._source(src)
        return self.step(f"lowest_{name}_{n}", self._full(x, F.min(x), n), n)

    def boll_mid(self, n: int = 20, k: float = 2.0) -> Column:
        return self.sma("close", n)

    def boll_upper(self, n: int = 20, k: float = 2.0) -> Column:
        return self.sma("close", n) + k * self.std("close", n)

    def boll_lower(self, n: int = 20, k: float = 2.0) -> Column:
        return self.sma("close", n) - k * self.std("close", n)

    def boll_width(self, n: int = 20, k: float = 2.0) -> Column:
        mid = self.boll_mid(n, k)
        spread = self.boll_upper(n, k) - self.boll_lower(n, k)
        return F.when(mid == 0, 0.0).otherwise(F.try_divide(spread, mid))

    # ---- neighbours

    def prev(self, x: str | Column, n: int = 1) -> Column:
        """Value ``n`` bars ago; for a confirmed swing it is the swing before, see :meth:`swing`."""
        n = _count(n)
        if n > HISTORY:
            raise ValueError(f"prev reaches back at most {HISTORY} rows")
        x, name = self._source(x)
        return self.step(f"prev_{name}_{n}", F.lag(x, n).over(self.w), n)

    def cross_up(self, a, b) -> Column:
        return self._cross(a, b, lambda x, y: x > y)

    def cross_down(self, a, b) -> Column:
        return self._cross(a, b, lambda x, y: x < y)

    def _cross(self, a, b, beyond) -> Column:
        a = F.lit(float(a)) if isinstance(a, int | float) else a
        b = F.lit(float(b)) if isinstance(b, int | float) else b
        (x, _), (y, _) = self._source(a), self._source(b)
        px, py = self.prev(x), self.prev(y)
        known = x.isNotNull() & y.isNotNull() & px.isNotNull() & py.isNotNull()
        return F.when(known, ~beyond(px, py) & beyond(x, y))

    # ---- recurrences

    def _recur(self, name: str, spec: Recurrence, level: int = 0) -> Column:
        self._scans[level].setdefault(name, spec)
        return F.col(name)

    def ema(self, src: str, n: int) -> Column:
        n = _count(n)
        return self._recur(f"ema_{src}_{n}", ema(self._series_field(src), n))

    def wilder(self, src: str, n: int) -> Column:
        n = _count(n)
        return self._recur(f"wilder_{src}_{n}", wilder(self._series_field(src), n))

    def atr(self, n: int = 14) -> Column:
        n = _count(n)
        return self._recur(f"atr_{n}", wilder(true_range(), n))

    def rsi(self, src: str | int = "close", n: int = 14) -> Column:
        if not isinstance(src, str):
            src, n = "close", src
        n = _count(n)
        x = self._series_field(src)
        if src == "close":
            before = F.col("prev_close")
        else:
            self._pre.setdefault(f"_prev_{src}", lambda df: scan(
                df, KEYS, ["rn"], rn_chunk(self.chunk_rows), {f"_prev_{src}": ("lag", src)}))
            before = F.col(f"_prev_{src}")
        move = x - before
        gain = self._recur(f"_gain_{src}_{n}", wilder(F.greatest(move, F.lit(0.0)), n, 2))
        loss = self._recur(f"_loss_{src}_{n}", wilder(F.greatest(-move, F.lit(0.0)), n, 2))
        return (F.when(loss == 0, F.when(gain > 0, 100.0).when(gain == 0, 50.0))
                .otherwise(100.0 - 100.0 / (1.0 + F.try_divide(gain, loss))))

    def _macd(self, fast: int, slow: int, signal: int) -> tuple[Column, Column]:
        if not fast < slow:
            raise ValueError("macd needs fast < slow")
        dif = self.ema("close", fast) - self.ema("close", slow)
        dea = self._recur(f"_dea_{fast}_{slow}_{signal}", ema(dif, signal, start=slow), level=1)
        return F.when(dea.isNotNull(), dif), dea

    def macd_dif(self, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
        return self._macd(fast, slow, signal)[0]

    def macd_dea(self, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
        return self._macd(fast, slow, signal)[1]

    def macd_hist(self, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
        dif, dea = self._macd(fast, slow, signal)
        return 2.0 * (dif - dea)

    def _kdj(self, n: int, m1: int, m2: int) -> tuple[Column, Column]:
        n, rsv = _count(n), f"_rsv_{n}"

        def with_rsv(df: DataFrame) -> DataFrame:
            frame = Frame(df, self.block_rows)
            hi, lo = frame.highest("high", n), frame.lowest("low", n)
            pos = F.when(hi == lo, 50.0).otherwise(F.try_divide(F.col("close") - lo, hi - lo) * 100.0)
            return frame.add(**{rsv: F.when(hi.isNotNull(), pos)}).build()

        self._pre.setdefault(rsv, with_rsv)
        k = self._recur(f"_k_{n}_{m1}", smooth(F.col(rsv), m1, n, 50.0))
        d = self._recur(f"_d_{n}_{m1}_{m2}", smooth(k, m2, n, 50.0), level=1)
        return k, d

    def kdj_k(self, n: int = 9, m1: int = 3, m2: int = 3) -> Column:
        return self._kdj(n, m1, m2)[0]

    def kdj_d(self, n: int = 9, m1: int = 3, m2: int = 3) -> Column:
        return self._kdj(n, m1, m2)[1]

    def kdj_j(self, n: int = 9, m1: int = 3, m2: int = 3) -> Column:
        k, d = self._kdj(n, m1, m2)
        return 3.0 * k - 2.0 * d

    # ---- candle and structure patterns

    def range(self, n: int) -> Column:
        """High/low of the ``n`` bars before the current one, as a struct."""
        n = _count(n)
        before = self.w.rowsBetween(-n, -1)
        box = F.struct(F.max("high").over(before).alias("high"), F.min("low").over(before).alias("low"))
        return self.step(f"range_{n}", F.when(F.col("rn") > n, box), n)

    @staticmethod
    def range_width(box: Column) -> Column:
        return box["high"] - box["low"]

    @staticmethod
    def range_mid(box: Column) -> Column:
        return (box["high"] + box["low"]) / 2

    @staticmethod
    def breakout(box: Column, direction: str = "up") -> Column:
        return F.col("close") > box["high"] if _side(direction) else F.col("close") < box["low"]

    def gap(self, direction: str = "up") -> Column:
        if _side(direction):
            return F.col("low") > self.prev("high")
        return F.col("high") < self.prev("low")

    def engulfing(self, direction: str = "up") -> Column:
        po, pc = self.prev("open"), self.prev("close")
        o, c = F.col("open"), F.col("close")
        if _side(direction):
            return F.when(po.isNotNull(), (pc < po) & (c > o) & (c >= po) & (o <= pc))
        return F.when(po.isNotNull(), (pc > po) & (c < o) & (c <= po) & (o >= pc))

    @staticmethod
    def pin_bar(direction: str = "up", ratio: float = 2.0) -> Column:
        if ratio <= 0:
            raise ValueError("pin_bar needs a positive ratio")
        o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
        body, top, tail = F.abs(c - o), h - F.greatest(o, c), F.least(o, c) - low
        shadow, other = (tail, top) if _side(direction) else (top, tail)
        return F.when(h == low, False).otherwise((shadow >= ratio * body) & (other <= shadow / ratio))

    def consolidation(self, n: int, max_width: float = 0.02) -> Column:
        hi, lo = self.highest("high", n), self.lowest("low", n)
        return F.try_divide(hi - lo, (hi + lo) / 2) <= max_width

    def range_atr(self, n: int, atr_n: int = 14) -> Column:
        atr = self.atr(atr_n)
        return F.when(atr > 0, F.try_divide(self.highest("high", n) - self.lowest("low", n), atr))

    def inside_bar(self) -> Column:
        ph, pl = self.prev("high"), self.prev("low")
        return F.when(ph.isNotNull(), (F.col("high") <= ph) & (F.col("low") >= pl))

    def swing(self, side: str, n: int = 5) -> Column:
        """Struct ``(price, rn, prev_price, prev_rn)`` of the last two swings confirmed by now."""
        n = _count(n)
        name = f"swing_{side}_{n}"
        self._points.setdefault(name, lambda df: swing_points(df, side, n, self.block_rows, self.chunk_rows))
        return F.col(name)

    def swing_high(self, n: int = 5, back: int = 0) -> Column:
        return self.swing("high", n)["price" if back == 0 else "prev_price"]

    def swing_low(self, n: int = 5, back: int = 0) -> Column:
        return self.swing("low", n)["price" if back == 0 else "prev_price"]

    def double_bottom(self, n: int = 5, tol: float = 0.003) -> Column:
        return self._double("low", n, tol)

    def double_top(self, n: int = 5, tol: float = 0.003) -> Column:
        return self._double("high", n, tol)

    def _double(self, side: str, n: int, tol: float) -> Column:
        n = _count(n)
        name = f"double_{side}_{n}_{str(tol).replace('.', 'p')}"
        self._points.setdefault(name, lambda df: double_points(df, side, n, tol, self.block_rows, self.chunk_rows))
        return F.col(name)["ok"]

    # ---- conditions over time

    def mode(self, raw: Column, mode: str = "state", within: int = 1) -> Column:
        """What a rule sees of a condition: as is, on its edge, or once in the last ``within`` bars."""
        x, name = self._source(raw)
        if mode == "state":
            return x
        if mode == "event":
            # only FALSE -> TRUE is an edge; an unknown previous bar is not
            return F.coalesce(x & (self.prev(x) == F.lit(False)), F.lit(False))
        if mode == "window":
            w = self._last(_count(within))
            seen = F.coalesce(F.max(x).over(w), F.lit(False))
            blank = F.count(F.when(x.isNull(), 1)).over(w) > 0
            return self.step(f"win_{name}_{within}", F.when(seen, True).when(~blank, False), within)
        raise ValueError(f"unknown mode {mode!r}")

    # ---- execution

    def build(self, keep: list[str] | None = None) -> DataFrame:
        df = self.bars
        if self._points:
            points = {name: stage(fn(df), "points") for name, fn in self._points.items()}
            df = stage(with_latest(df, points, self.chunk_rows), "structure")
        for fn in self._pre.values():
            df = stage(fn(df), "structure")
        if self._scans[0]:
            df = linear_scan(df, KEYS, self._scans[0])
            if self._scans[1]:
                df = linear_scan(stage(df, "scan"), KEYS, self._scans[1])
        if self._steps:
            df = to_blocks(df, self.back, self.ahead, self.block_rows)
            for name, expr in self._steps.items():
                df = df.withColumn(name, expr)
            df = core_rows(df)
        base = self.bars.columns if keep is None else keep
        return df.select(*[c for c in base if c not in self._out],
                         *[c.alias(n) for n, c in self._out.items()])


def _pivots(df: DataFrame, side: str, n: int, block_rows: int) -> DataFrame:
    """Flag rows whose price is the extreme of the 2n+1 bars around it (ties qualify)."""
    w = block_window(KEYS).rowsBetween(-n, n)
    extreme = F.max(side).over(w) if side == "high" else F.min(side).over(w)
    flag = (F.col(side) == extreme) & (F.count(side).over(w) == 2 * n + 1)
    return core_rows(to_blocks(df, n, n, block_rows).withColumn("_pivot", flag))


def with_latest(bars: DataFrame, points: dict[str, DataFrame], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Carry the newest value of every point table (keyed by the row it is known at) down each
    series: one scan for all of them."""
    both = bars.select(*KEYS, "rn", F.lit(1).alias("_side"), F.struct(*bars.columns).alias("_bar"))
    for name, table in points.items():
        fields = [c for c in table.columns if c not in (*KEYS, "rn")]
        both = both.unionByName(
            table.select(*KEYS, "rn", F.lit(0).alias("_side"), F.struct(*fields).alias(f"_p_{name}")),
            allowMissingColumns=True)
    found = scan(both, KEYS, ["rn", "_side"], rn_chunk(chunk_rows), {n: ("last", f"_p_{n}") for n in points})
    return found.filter("_side = 1").select("_bar.*", *points)


def swing_points(bars: DataFrame, side: str, n: int, block_rows: int = BLOCK_ROWS,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Swings and the swing before each, keyed by the row that confirms them."""
    pivots = stage(_pivots(bars.select(*KEYS, "rn", side), side, n, block_rows)
                   .filter("_pivot").select(*KEYS, "rn", F.col(side).alias("price")), "pivots")
    paired = scan(pivots, KEYS, ["rn"], rn_chunk(chunk_rows),
                  {"prev_price": ("lag", "price"), "prev_rn": ("lag", "rn")})
    # a pivot is known n bars after it happened
    return paired.select(*KEYS, (F.col("rn") + n).alias("rn"), "price", F.col("rn").alias("at_rn"),
                         "prev_price", "prev_rn")


def double_points(bars: DataFrame, side: str, n: int, tol: float, block_rows: int = BLOCK_ROWS,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Verdict on each pair of neighbouring swings, keyed by the row that confirms the later one.

    Every bar is given the number of the swing before it, so the neckline of a pair is a partially
    aggregated groupBy and not a range join.
    """
    other, extreme = ("low", F.min) if side == "high" else ("high", F.max)
    pivots = stage(_pivots(bars.select(*KEYS, "rn", side), side, n, block_rows)
                   .filter("_pivot").select(*KEYS, "rn", F.col(side).alias("price")), "pivots")
    numbered = stage(scan(pivots, KEYS, ["rn"], rn_chunk(chunk_rows), {"seg": ("count", "rn")}), "pivots")
    # a pivot row itself carries its own number but no price, so it never counts as "between"
    both = bars.select(*KEYS, "rn", F.lit(1).alias("_side"), F.col(other).alias("x")).unionByName(
        numbered.select(*KEYS, "rn", F.lit(0).alias("_side"), "seg"), allowMissingColumns=True)
    tagged = scan(both, KEYS, ["rn", "_side"], rn_chunk(chunk_rows), {
        "_seg": ("last", "seg"), "_at": ("last", F.when(F.col("_side") == 0, F.col("rn")))})
    between = tagged.filter("_side = 1 AND rn > _at").groupBy(*KEYS, (F.col("_seg") + 1).alias("seg")).agg(
        extreme("x").alias("neck"))
    earlier = numbered.select(*KEYS, (F.col("seg") + 1).alias("seg"), F.col("price").alias("old"))
    pair = numbered.join(earlier, [*KEYS, "seg"]).join(between, [*KEYS, "seg"], "left")
    new, old, neck = F.col("price"), F.col("old"), F.col("neck")
    base = F.least(F.abs(new), F.abs(old))
    depth = F.least(new, old) - neck if side == "high" else neck - F.greatest(new, old)
    verdict = (F.when(base <= 0, None)
               .when(F.try_divide(F.abs(new - old), base) > tol, False)
               .when(neck.isNull(), False)
               .otherwise(F.try_divide(depth, base) >= tol))
    return pair.select(*KEYS, (F.col("rn") + n).alias("rn"), verdict.alias("ok"))
