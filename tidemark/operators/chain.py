"""The ordered condition chain of a rule, as a fold over its trigger bars that runs on many tasks.

Its input is a slim frame (satisfied flags and a few timestamps), cut into pieces of ``PIECE_ROWS`` bars of a
(rule, symbol).  All pieces run at once, each from an assumed state at its start (a fresh chain at first).  A small
table of the pieces' ends then tells the state that each piece really starts from; pieces for which that makes a
difference run again, until none is left.  A chain forgets its past at every retreat to the start, every signal and
every expiry, so that is one more round as a rule, and the result is exact in any case: the first piece's start is
known, and each further one's start is the end of the one before.

What a piece depends on is its entry stage with deadline, end of cooldown and arming time, and the remembered
dedup keys only as far as it tries one of them.

Inside a piece, what each stage could do on each bar is computed for all bars at once; the sequential part
jumps from transition to transition (next bar that moves this stage, end of the cooldown, deadline), so its cost follows
the transitions, not the bars.
"""

from __future__ import annotations

import json
import sys
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.small import broadcast_if_small
from tidemark.plans.staging import stage

# executors need not have this package installed: its task code travels with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE_ROWS = 65_536
MEMORY = 512  # fixed value: dedup keys remembered per (rule, symbol)

TRANSITION_SCHEMA = (
    "rule_id string, symbol string, rn bigint, close_ts bigint, outcome string, stage bigint, "
    "emitted boolean, dedup_key string"
)


@dataclass
class ChainState:
    stage: int = 0
    deadline: int = 0  # the last trigger bar, by number, on which an armed chain may still fire
    cooldown_until: int = 0
    armed_at: int = 0
    last_fired: int = 0
    seen: OrderedDict = field(default_factory=OrderedDict)


@dataclass(frozen=True)
class ChainSpec:
    """What the fold needs to know of a rule."""

    persistent: tuple[bool, ...]
    roles: tuple[str, ...]
    ttl_bars: int
    cooldown_s: int
    key_template: str
    timeframe: str
    direction: str

    @property
    def length(self) -> int:
        return len(self.persistent)

    @property
    def rest(self) -> int:
        """Stage taken up after a signal or a cooldown: the first condition is assumed to hold."""
        return 1 if self.length > 1 else 0


class Block:
    """A stretch of one key's trigger bars, with what any stage could do on each of them.

    ``fails[j]`` is the first persistent condition that does not hold (the chain's length if all do);
    ``goes[j, s]`` the first condition from ``s`` on that doesn't hold, which is where stage ``s`` would
    get to.  An unknown result counts as not holding.
    """

    def __init__(self, spec: ChainSpec, rn, ts, holds: np.ndarray):
        n, size = len(rn), spec.length
        self.rn, self.ts = np.asarray(rn, np.int64), np.asarray(ts, np.int64)
        broken = ~holds & np.array(spec.persistent, bool)
        self.fails = np.where(broken.any(axis=1), broken.argmax(axis=1), size)
        self.goes = np.full((n, size + 1), size)
        for s in range(size - 1, -1, -1):
            self.goes[:, s] = np.where(holds[:, s], self.goes[:, s + 1], s)
        # bars on which a chain at stage s moves by itself, forwards or back
        self.moves = [np.flatnonzero((self.fails < s) | (self.goes[:, s] > s)) for s in range(size)]

    def next_move(self, stage: int, at: int) -> int:
        own = self.moves[stage]
        k = np.searchsorted(own, at)
        return int(own[k]) if k < len(own) else len(self.rn)


def remember(state: ChainState, key: str) -> bool:
    """TRUE when the key is new; the oldest is forgotten beyond ``MEMORY``."""
    if key in state.seen:
        return False
    state.seen[key] = None
    if len(state.seen) > MEMORY:
        state.seen.popitem(last=False)
    return True


def walk(state: ChainState, spec: ChainSpec, block: Block) -> Iterator[tuple[int, str, bool]]:
    """Jump from transition to transition: (bar, outcome, chain complete).  The caller settles a
    complete chain before it asks for the next one."""
    last, at, n = spec.length - 1, 0, len(block.rn)
    while True:
        released = bool(state.cooldown_until)
        if released:
            j = max(at, int(np.searchsorted(block.ts, state.cooldown_until)))
        else:
            j = block.next_move(state.stage, at)
            if last and spec.ttl_bars and state.stage == last:
                j = min(j, max(at, int(np.searchsorted(block.rn, state.deadline, "right"))))
        if j >= n:
            return
        at, outcome = j + 1, ""
        if released:
            state.cooldown_until, state.stage, outcome = 0, spec.rest, "cooled"
        late = last and spec.ttl_bars and state.stage == last and block.rn[j] > state.deadline
        if block.fails[j] < state.stage:  # a lost condition comes before everything else
            state.stage, state.armed_at, outcome = int(block.fails[j]), 0, "retreated"
        elif late:
            state.stage, state.armed_at, outcome = last - 1, 0, "expired"
        else:
            reached = int(block.goes[j, state.stage])
            if reached > state.stage:
                outcome = "advanced"
                if state.stage < last <= reached:
                    state.deadline, state.armed_at = int(block.rn[j]) + spec.ttl_bars, int(block.ts[j])
                state.stage = reached
        if state.stage > last:
            yield j, "fired", True
        elif outcome:
            yield j, outcome, False


def settle(state: ChainState, spec: ChainSpec, key: str, rn: int, ts: int) -> bool:
    """After a completed chain: TRUE and back to rest (or into the cooldown) when its key is new; else
    the chain waits one stage below."""
    state.stage = spec.length - 1
    if not remember(state, key):
        return False
    state.last_fired, state.deadline, state.armed_at = ts, rn, 0
    if spec.cooldown_s:
        state.cooldown_until = ts + spec.cooldown_s
    else:
        state.stage = spec.rest
    return True


def dedup_key(spec: ChainSpec, rule_id: str, symbol: str, ts: int, day, role_ts, armed_at: int) -> str:
    fields = {
        "symbol": symbol, "rule": rule_id, "timeframe": spec.timeframe, "bar_close_ts": ts,
        "trading_day": day or "", "direction": spec.direction, "armed_at": armed_at,
    }
    fields.update({f"{r}_bar_close_ts": int(t) for r, t in zip(spec.roles, role_ts, strict=True)
                   if t is not None and t == t})
    return spec.key_template.format(**fields)


COLUMNS = ["rule_id", "symbol", "rn", "close_ts", "satisfied", "role_ts", "trading_day"]
OUT = ["rule_id", "symbol", "rn", "close_ts", "outcome", "stage", "emitted", "dedup_key"]


def run_bars(state: ChainState, spec: ChainSpec, block: Block, rule_id: str, symbol: str, stamps, days) -> list[tuple]:
    """The transitions of a block; ``stamps(j)`` and ``days(j)`` are a bar's role times and trading day."""
    out = []
    for j, outcome, complete in walk(state, spec, block):
        rn, ts, key, emitted = int(block.rn[j]), int(block.ts[j]), None, False
        if complete:
            key = dedup_key(spec, rule_id, symbol, ts, days(j), stamps(j), state.armed_at)
            emitted = settle(state, spec, key, rn, ts)
        out.append((rule_id, symbol, rn, ts, outcome, state.stage, emitted, key))
    return out


def run_block(state: ChainState, spec: ChainSpec, pdf: pd.DataFrame) -> list[tuple]:
    """The transitions of one key's rows (``COLUMNS``), in order."""
    holds = (np.array([list(v) for v in pdf["satisfied"]], dtype=object).reshape(len(pdf), spec.length) == True).astype(bool)  # noqa: E712
    block = Block(spec, pdf["rn"].to_numpy(), pdf["close_ts"].to_numpy(), holds)
    role_ts, day = pdf["role_ts"], pdf["trading_day"]
    return run_bars(state, spec, block, pdf["rule_id"].iloc[0], pdf["symbol"].iloc[0], lambda j: role_ts.iloc[j], lambda j: day.iloc[j])


def by_key(pdf: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Stretches of rows with one (rule, symbol)."""
    new = (pdf["rule_id"] != pdf["rule_id"].shift()) | (pdf["symbol"] != pdf["symbol"].shift())
    edges = [*np.flatnonzero(new.to_numpy()), len(pdf)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = pdf.iloc[lo:hi]
        yield (part["rule_id"].iloc[0], part["symbol"].iloc[0]), part


# ------------------------------------------------------------------ pieces

PIECE = ["rule_id", "symbol", "piece"]
PIECE_SCHEMA = f"piece bigint, {TRANSITION_SCHEMA}, result string"
PIECE_OUT = ["piece", *OUT, "result"]


def _core(state: ChainState, last: int) -> list:
    """What later bars may depend on, the keys aside: deadline and arming time count at the last stage or in a cooldown only."""
    if state.cooldown_until:
        return [0, state.deadline, state.armed_at, state.cooldown_until]
    return [state.stage, state.deadline, state.armed_at, 0] if state.stage == last else [state.stage, 0, 0, 0]


def _entry(core: list, keys: list[str]) -> ChainState:
    return ChainState(core[0], core[1], core[3], core[2], 0, OrderedDict((k, None) for k in keys))


def _run_piece(specs: dict[str, ChainSpec]):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("emit_ts", "ascending"), ("close_ts", "ascending")])
        rule_id, symbol, piece = (group[c][0].as_py() for c in PIECE)
        spec, entry = specs[rule_id], group["entry"][0].as_py()
        core, keys = json.loads(entry) if entry else ([0, 0, 0, 0], [])
        state = _entry(core, keys)
        mask = group["holds"].to_numpy()
        block = Block(spec, group["rn"].to_numpy(), group["close_ts"].to_numpy(), (mask[:, None] >> np.arange(spec.length)) & 1 == 1)
        rows = run_bars(state, spec, block, rule_id, symbol, lambda j: group["role_ts"][j].as_py(), lambda j: group["trading_day"][j].as_py())
        tried = sorted({r[7] for r in rows if r[7] is not None})
        emitted = [r[7] for r in rows if r[6]][-MEMORY:]
        end = json.dumps([core, keys, _core(state, spec.length - 1), tried, emitted])
        rows.append((rule_id, symbol, None, None, "", None, False, None))
        columns = list(zip(*[(piece, *r, None if r[4] else end) for r in rows], strict=True))
        return pa.table([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES, strict=True)], names=PIECE_OUT)
    return run


_PIECE_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()]


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a key, in order, that have to run again, with the state that they start from."""
    pdf, core, keys, again = pdf.sort_values("piece"), [0, 0, 0, 0], [], []
    for piece, result in zip(pdf["piece"], pdf["result"], strict=True):
        had_core, had_keys, end, tried, emitted = json.loads(result)
        if had_core != core or not set(tried).isdisjoint(set(keys) ^ set(had_keys)):
            again.append((piece, json.dumps([core, keys])))
        # beyond a piece that runs again the ends are the best guess there is
        core, keys = end, [*keys, *emitted][-MEMORY:]
    return pd.DataFrame({"rule_id": pdf["rule_id"].iloc[0], "symbol": pdf["symbol"].iloc[0], "piece": [p for p, _ in again], "entry": [e for _, e in again]},
                        columns=[*PIECE, "entry"]).astype({"rule_id": object, "symbol": object, "piece": "int64", "entry": object})


def fold(frame: DataFrame, specs: dict[str, ChainSpec], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """All transitions of all rules; rows with ``emitted`` are the signals.  The frame is read once per round."""
    widest = max(s.length for s in specs.values())
    bits = [F.when(F.get("satisfied", F.lit(i)), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(widest)]
    slim = frame.select(*COLUMNS, "emit_ts").withColumns({"holds": sum(bits[1:], bits[0]).cast("bigint"), "piece": F.floor((F.col("rn") - 1) / piece_rows).cast("bigint")}).drop("satisfied")
    run = _run_piece(specs)
    done = stage(slim.withColumn("entry", F.lit(None).cast("string")).groupBy(*PIECE).applyInArrow(run, PIECE_SCHEMA), "pieces")
    while True:
        ends = done.filter("outcome = ''").select(*PIECE, "result")
        if ends.filter("piece > 0").isEmpty():
            break
        again = stage(ends.groupBy("rule_id", "symbol").applyInPandas(_entries, "rule_id string, symbol string, piece bigint, entry string"), "entries")
        if again.isEmpty():
            break
        fresh = slim.join(broadcast_if_small(again), PIECE).groupBy(*PIECE).applyInArrow(run, PIECE_SCHEMA)
        done = stage(done.join(broadcast_if_small(again.select(*PIECE)), PIECE, "left_anti").select(*PIECE_OUT).unionByName(fresh), "pieces")
    return done.filter("outcome <> ''").select(*OUT)
