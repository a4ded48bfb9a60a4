"""Rules from raw minutes: one stateful operator per symbol, from closed one-minute bars to signals.

State of a symbol: the open bucket of each timeframe with the newest minute seen, per timeframe the last rows
(as many as its windows reach back) with the recurrences' values and booked results, and each rule's chain.  A batch
of minutes closes buckets, evaluates every condition once per closed bar of its own timeframe, reads other
timeframes as known at emission, and runs the chains: the steps of ``operators.rules``, and the same rows.

Minutes at or before the newest one seen (late, repeated) and open ones change nothing here; ``late_loop`` brings
them into the stored bars.  A micro-batch of one symbol is held in memory, so bound the source's trigger
(``maxFilesPerTrigger``, ``maxBytesPerTrigger``); a history of any length goes through :func:`prime` in Arrow batches.
"""

from __future__ import annotations

import json
import pickle
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators import chain
from tidemark.operators.bars import closed_only
from tidemark.operators.rules import Rule
from tidemark.schema import RANK, TIMEFRAMES
from tidemark.streaming import live
from tidemark.streaming.live_frame import FIELDS, LEAST_ROWS, LiveFrame, Values

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = ["symbol", "open_ts", "close_ts", *FIELDS, "trading_day"]
OUT = (f"{chain.TRANSITION_SCHEMA}, timeframe string, direction string, priority string, trigger_price double, trading_day string, "
       "context string, role_bars string")
NAMES = [c.strip().split()[0] for c in OUT.split(",")]
STATE = "symbol string, state binary"


class Book:
    """The rows of one timeframe of one symbol, old ones first, and what rules booked on them."""

    def __init__(self, memory: dict | None, bars: pd.DataFrame):
        old = memory["rows"] if memory else {}
        self.old = len(old["rn"]) if old else 0
        count = memory["count"] if memory else 0
        own = {c: bars[c].to_numpy(float) for c in FIELDS}
        own |= {c: bars[c].to_numpy(np.int64) for c in ("close_ts", "emit_ts")} | {"trading_day": bars["trading_day"].to_numpy(object)}
        own["rn"] = count + 1 + np.arange(len(bars))
        before = old["close"][-1:] if old else np.array([np.nan])
        own["prev_close"] = np.concatenate([before, own["close"]])[: len(bars)]
        self.count = count + len(bars)
        self.rows = {c: np.concatenate([old[c], v]) if old else v for c, v in own.items()}
        self.booked: dict[str, np.ndarray] = dict(memory["booked"]) if memory else {}
        self.frame = LiveFrame(self.rows, self.old, memory["frame"] if memory else None)

    def note(self, name: str, value: Values | np.ndarray) -> None:
        """The column ``name``: booked values of old rows stay as they were."""
        v = value.v if isinstance(value, Values) else value
        self.booked[name] = np.concatenate([self.booked.get(name, np.full(self.old, np.nan))[: self.old], v[self.old :]])

    def at(self, emit: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (-1: none) that were emitted by ``emit``, and those that had closed by ``close`` too."""
        known = np.searchsorted(self.rows["emit_ts"], emit, "right")
        return known - 1, np.minimum(known, np.searchsorted(self.rows["close_ts"], close, "right")) - 1

    def memory(self) -> dict:
        kept = min(max(self.frame.depth, LEAST_ROWS), len(self.rows["rn"]))
        cut = {c: v[len(v) - kept :].copy() for c, v in self.rows.items()}
        return {"count": self.count, "rows": cut, "booked": {c: v[len(v) - kept :].copy() for c, v in self.booked.items()}, "frame": self.frame.finish(kept)}


def _take(column: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, column[np.maximum(at, 0)], np.nan) if len(column) else np.full(len(at), np.nan)


class Engine:
    """What a set of rules does with the minutes of a symbol.  ``state`` is a dict that pickles."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.timeframes = sorted({tf for r in rules for tf in r.required_timeframes}, key=RANK.get)
        self.specs = {r.id: r.chain() for r in rules}

    def closed(self, state: dict, pdf: pd.DataFrame) -> dict[str, pd.DataFrame]:
        """Bars of each timeframe that become known with these minutes, which are in order and newer than all before."""
        out = {}
        for tf in self.timeframes:
            seconds = TIMEFRAMES[tf]
            if tf == "1m":
                out[tf] = pdf.assign(emit_ts=pdf["close_ts"])
                continue
            done, state["open"][tf] = live.close_buckets(state["open"].get(tf), pdf, tf, seconds)
            out[tf] = done
        return out

    def books(self, state: dict, bars: dict[str, pd.DataFrame], symbol: str) -> dict[str, Book]:
        mine = [r for r in self.rules if not r.universe or symbol in r.universe]
        books = {tf: Book(state["frames"].get(tf), bars[tf]) for tf in self.timeframes}
        for r in mine:
            for name, (other, expr) in r.at.items():
                books[other].note(f"at__{name}", expr(books[other].frame))
        for tf, b in books.items():
            for r in mine:
                if any(c.timeframe == tf for c in r.conditions):
                    for name, (other, _) in r.at.items():
                        visible = books[other].at(b.rows["emit_ts"], b.rows["close_ts"])[1]
                        b.note(f"ref__{name}", _take(books[other].booked[f"at__{name}"], visible))
                        b.rows[name] = b.booked[f"ref__{name}"]
        for tf, b in books.items():
            for r in mine:
                for c in r.conditions:
                    if c.timeframe == tf:
                        b.note(f"sat__{r.id}__{c.role}", b.frame.mode(c.when(b.frame), c.mode, c.within))
                        for name, expr in r.context_by_role.get(c.role, {}).items():
                            b.note(f"ctx__{r.id}__{c.role}__{name}", expr(b.frame))
                if r.timeframe == tf:
                    for name, expr in r.context.items():
                        b.note(f"ctx__{r.id}____{name}", expr(b.frame))
        return books

    def moves(self, state: dict, books: dict[str, Book], symbol: str, rule: Rule) -> list[tuple]:
        b = books[rule.timeframe]
        new = np.arange(b.old, len(b.rows["rn"]))
        if not len(new):
            return []
        emit, close = b.rows["emit_ts"][new], b.rows["close_ts"][new]
        same = np.append(emit[1:] == emit[:-1], False)  # two bars known at one instant: both are evaluated before either is decided
        known, stamps, visible = [], [], {}
        for c in rule.conditions:
            sat = books[c.timeframe].booked[f"sat__{rule.id}__{c.role}"]
            if c.timeframe == rule.timeframe:
                known.append(sat[np.where(same, new + 1, new)])
                visible[c.role], stamp = new, close.astype(float)
            else:
                latest, visible[c.role] = books[c.timeframe].at(emit, close)
                known.append(_take(sat, latest))
                stamp = _take(books[c.timeframe].rows["close_ts"].astype(float), visible[c.role])
            stamps.append(stamp)
        flags = [[None if x != x else bool(x) for x in row] for row in zip(*known, strict=True)]
        times = [[None if x != x else int(x) for x in row] for row in zip(*stamps, strict=True)]
        pdf = pd.DataFrame({"rule_id": rule.id, "symbol": symbol, "rn": b.rows["rn"][new], "close_ts": close, "satisfied": flags, "role_ts": times, "trading_day": b.rows["trading_day"][new]})
        before = state["chains"].get(rule.id)
        current = live.unpack_chain(before) if before else chain.ChainState()
        moved = chain.run_block(current, self.specs[rule.id], pdf)
        state["chains"][rule.id] = live.pack_chain(current)
        place = {int(rn): k for k, rn in enumerate(pdf["rn"])}
        return [self._row(m, rule, b, books, visible, place[m[2]], new) for m in moved]

    def _row(self, move: tuple, rule: Rule, b: Book, books: dict[str, Book], visible: dict, k: int, new: np.ndarray) -> tuple:
        if not move[6]:
            return (*move, rule.timeframe, *[None] * 6)
        plain = lambda x: None if x != x else float(x)
        i = int(new[k])
        context = {"close": plain(b.rows["close"][i]), "volume": plain(b.rows["volume"][i])}
        context |= {n: plain(b.booked[f"ctx__{rule.id}____{n}"][i]) for n in rule.context}
        bars = {}
        for c in rule.conditions:
            j = int(visible[c.role][k])
            other = books[c.timeframe]
            if j >= 0:
                bars[c.role] = int(other.rows["close_ts"][j])
            context |= {f"{c.role}.{n}": plain(other.booked[f"ctx__{rule.id}__{c.role}__{n}"][j]) if j >= 0 else None for n in rule.context_by_role.get(c.role, {})}
        return (*move, rule.timeframe, rule.emit.direction, rule.emit.priority, float(b.rows["close"][i]), b.rows["trading_day"][i], json.dumps(context), json.dumps(bars))

    def advance(self, state: dict, symbol: str, minutes: pd.DataFrame) -> pd.DataFrame:
        pdf = minutes[minutes["close_ts"] > state["newest"]].sort_values("close_ts", kind="stable").drop_duplicates("close_ts")
        out: list[tuple] = []
        if not pdf.empty:
            state["newest"] = int(pdf["close_ts"].iloc[-1])
            bars = self.closed(state, pdf)
            if any(len(x) for x in bars.values()):
                books = self.books(state, bars, symbol)
                for r in self.rules:
                    if not r.universe or symbol in r.universe:
                        out += self.moves(state, books, symbol, r)
                state["frames"] = {tf: b.memory() for tf, b in books.items()}
        return pd.DataFrame(out, columns=NAMES)


def fresh() -> dict:
    return {"newest": -(2**62), "open": {}, "frames": {}, "chains": {}}


class LiveRules(StatefulProcessor):
    """``Engine`` on Spark's state store: one value for the clock and open buckets, maps by timeframe and by rule."""

    def __init__(self, rules: list[Rule]):
        self.engine = Engine(rules)

    def init(self, handle) -> None:
        self.clock = handle.getValueState("clock", "state binary")
        self.frames = handle.getMapState("frames", "timeframe string", "state binary")
        self.chains = handle.getMapState("chains", "rule string", "state string")

    def _load(self) -> dict:
        if not self.clock.exists():
            return fresh()
        newest, open_ = pickle.loads(self.clock.get()[0])
        frames = {k[0]: pickle.loads(v[0]) for k, v in self.frames.iterator()}
        return {"newest": newest, "open": open_, "frames": frames, "chains": {k[0]: v[0] for k, v in self.chains.iterator()}}

    def _save(self, state: dict) -> None:
        self.clock.update((pickle.dumps((state["newest"], state["open"])),))
        for tf, memory in state["frames"].items():
            self.frames.updateValue((tf,), (pickle.dumps(memory),))
        for rule, packed in state["chains"].items():
            self.chains.updateValue((rule,), (packed,))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803 - Spark's names
        self._save(pickle.loads(initialState["state"].iloc[0]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._load()
        out = self.engine.advance(state, key[0], pd.concat(list(rows), ignore_index=True))
        self._save(state)
        yield out

    def close(self) -> None:
        pass


def _slim(minutes: DataFrame) -> DataFrame:
    return closed_only(minutes).select(*MINUTE)


def prime(history: DataFrame, rules: list[Rule], keep_chains: bool = True) -> DataFrame:
    """(symbol, state) after a finished history of minutes, for ``live_rules(initial=...)``: no signal is emitted.  Without
    ``keep_chains`` conditions are warm, but every chain starts anew.  Arrow batches of sorted rows go through; memory follows the state."""
    engine = Engine(rules)

    def finish(symbol, state):
        state["chains"] = state["chains"] if keep_chains else {}
        return pd.DataFrame({"symbol": [symbol], "state": [pickle.dumps(state)]})

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state = None, fresh()
        for pdf in batches:
            edges = [0, *(np.flatnonzero((pdf["symbol"] != pdf["symbol"].shift()).to_numpy()[1:]) + 1), len(pdf)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = pdf.iloc[lo:hi]
                if hi > lo and part["symbol"].iloc[0] != symbol:
                    if symbol is not None:
                        yield finish(symbol, state)
                    symbol, state = part["symbol"].iloc[0], fresh()
                if hi > lo:
                    engine.advance(state, symbol, part)
        if symbol is not None:
            yield finish(symbol, state)
    return _slim(history).repartition("symbol").sortWithinPartitions("symbol", "close_ts").mapInPandas(work, STATE)


def live_rules(minutes: DataFrame, rules: list[Rule], initial: DataFrame | None = None) -> DataFrame:
    """Stream of all chains' transitions; rows with ``emitted`` carry the signal (see :func:`signals`).  ``initial`` (symbol, state)
    from :func:`prime` becomes the operator's initial state; it is read once, when the query first starts."""
    spark = minutes.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return _slim(minutes).groupBy("symbol").transformWithStateInPandas(
        LiveRules(rules), OUT, "Append", "None", initialState=initial.groupBy("symbol") if initial is not None else None)


def signals(moves: DataFrame) -> DataFrame:
    """The emitted signals of ``live_rules``, as the batch side has them."""
    return moves.filter("emitted").select(
        "rule_id", "symbol", "direction", "timeframe", F.col("close_ts").alias("fired_at"), "trigger_price", "dedup_key",
        F.from_json("context", "map<string,double>").alias("context"), F.from_json("role_bars", "map<string,bigint>").alias("role_bars"),
        F.lit(False).alias("tentative"), "priority", "trading_day")


class Lines(StatefulProcessor):
    """Named indicator lines of closed bars, continued batch by batch."""

    def __init__(self, lines: dict):
        self.lines = lines

    def init(self, handle) -> None:
        self.memory = handle.getValueState("memory", "state binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = pickle.loads(self.memory.get()[0]) if self.memory.exists() else None
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("close_ts", kind="stable").drop_duplicates("close_ts")
        pdf = pdf[pdf["close_ts"] > before["rows"]["close_ts"][-1]] if before else pdf
        if pdf.empty:
            return
        b = Book(before, pdf.assign(emit_ts=pdf["close_ts"]))
        out = {n: expr(b.frame).v[b.old :] for n, expr in self.lines.items()}
        self.memory.update((pickle.dumps(b.memory()),))
        yield pd.DataFrame({"symbol": key[0], "timeframe": key[1], "close_ts": pdf["close_ts"].to_numpy(), **out})

    def close(self) -> None:
        pass


def live_lines(bars: DataFrame, lines: dict) -> DataFrame:
    """Stream of (symbol, timeframe, close_ts, one column per line) for closed bars in order; ``lines`` are a rule's functions,
    ``{"rsi14": lambda f: f.rsi(14)}``.  A bar at or before the newest one seen is left out."""
    spark = bars.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = "symbol string, timeframe string, close_ts bigint, " + ", ".join(f"`{n}` double" for n in lines)
    slim = closed_only(bars).select("symbol", "timeframe", "close_ts", *FIELDS, "trading_day")
    return slim.groupBy("symbol", "timeframe").transformWithStateInPandas(Lines(lines), schema, "Append", "None")


def averages(bars: DataFrame, lines: list[tuple[str, int]]) -> DataFrame:
    """SMA / EMA / Wilder lines of closes, continued batch by batch; columns like ``ema20``."""
    return live_lines(bars, {f"{kind}{n}": lambda f, kind=kind, n=n: getattr(f, kind)("close", n) for kind, n in lines})
