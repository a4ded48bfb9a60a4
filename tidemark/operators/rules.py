"""Multi-timeframe rules: definition, booking, trigger frame, signals, trial."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_known
from tidemark.operators.chain import ChainSpec, fold
from tidemark.operators.frame import Frame
from tidemark.plans.chunks import rn_chunk, scan
from tidemark.plans.staging import stage
from tidemark.schema import KEYS, RANK, TIMEFRAMES, lookup

Expr = Callable[[Frame], Column]

# Priority names and their order.
PRIORITY_RANK = {"low": 0, "normal": 1, "high": 2}


@dataclass(frozen=True)
class Condition:
    role: str
    timeframe: str
    when: Expr
    mode: str = "state"
    within: int = 1

    def __post_init__(self):
        if self.timeframe not in TIMEFRAMES:
            raise ValueError(f"unknown timeframe {self.timeframe!r}")
        if self.mode not in ("state", "window", "event"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.within < 1:
            raise ValueError("within must be at least 1")


@dataclass(frozen=True)
class Emit:
    direction: str
    ttl_bars: int = 0
    cooldown_s: int = 0
    priority: str = "normal"
    dedup_key: str = "{symbol}:{rule}:{bar_close_ts}"


@dataclass(frozen=True)
class Rule:
    """Conditions in chain order; the last one is the trigger."""

    id: str
    conditions: tuple[Condition, ...]
    emit: Emit
    universe: tuple[str, ...] = ()  # empty = every symbol of the bars
    context: dict[str, Expr] = field(default_factory=dict)
    context_by_role: dict[str, dict[str, Expr]] = field(default_factory=dict)
    at: dict[str, tuple[str, Expr]] = field(default_factory=dict)  # name -> (timeframe, value)
    description: str = ""

    def __post_init__(self):
        roles = [c.role for c in self.conditions]
        if not roles or len(set(roles)) != len(roles):
            raise ValueError("a rule needs conditions with distinct roles")
        unknown = set(self.context_by_role) - set(roles)
        if unknown:
            raise ValueError(f"context_by_role names unknown roles {sorted(unknown)}")

    @property
    def timeframe(self) -> str:
        return self.conditions[-1].timeframe

    @property
    def slug(self) -> str:
        return self.id.replace("-", "_")

    @property
    def required_timeframes(self) -> list[str]:
        asked = {c.timeframe for c in self.conditions} | {tf for tf, _ in self.at.values()}
        return sorted(asked, key=RANK.get)

    def chain(self) -> ChainSpec:
        return ChainSpec(
            persistent=tuple(c.mode == "state" for c in self.conditions),
            roles=tuple(c.role for c in self.conditions), ttl_bars=self.emit.ttl_bars,
            cooldown_s=self.emit.cooldown_s, key_template=self.emit.dedup_key,
            timeframe=self.timeframe, direction=self.emit.direction)


def timeframes_needed(conditions: DataFrame) -> DataFrame:
    """The timeframes that a table of conditions (rule_id, timeframe) needs, lowest rank first."""
    rank = lookup(F.col("timeframe"), RANK).cast("bigint")
    return conditions.groupBy("timeframe").agg(F.countDistinct("rule_id").alias("rules"), F.count("*").alias("conditions")).select(
        "timeframe", rank.alias("rank"), "rules", "conditions").orderBy("rank")


def required_timeframes(rules: list[Rule]) -> list[str]:
    return sorted({tf for r in rules for tf in r.required_timeframes}, key=RANK.get)


def _with_references(bars: DataFrame, tf: str, rules: list[Rule]) -> DataFrame:
    """``at()`` values: another timeframe's expressions, as known to each bar of ``tf``."""
    mine = bars.filter(F.col("timeframe") == tf)
    wanted: dict[str, dict[str, Expr]] = {}
    for r in rules:
        if any(c.timeframe == tf for c in r.conditions):
            for name, (other, expr) in r.at.items():
                wanted.setdefault(other, {})[name] = expr
    for other, exprs in wanted.items():
        frame = Frame(bars.filter(F.col("timeframe") == other))
        values = stage(frame.add(**{n: e(frame) for n, e in exprs.items()})
                       .build(keep=["symbol", "rn", "close_ts", "emit_ts"]), "at")
        joined = asof_known(mine, values, list(exprs), "_at")
        mine = stage(joined.select(*mine.columns, *[F.col(f"_at.{n}").alias(n) for n in exprs]), "at")
    return mine


BOOK_KEEP = ["symbol", "timeframe", "rn", "close_ts", "emit_ts", "close", "volume", "trading_day"]


def book(bars: DataFrame, rules: list[Rule]) -> dict[str, DataFrame]:
    """Evaluate every condition once per bar of its own timeframe: one frame per timeframe, shared
    by all rules.  Columns: ``raw__<rule>__<role>``, ``sat__<rule>__<role>``, ``ctx__...``."""
    out = {}
    for tf in sorted({c.timeframe for r in rules for c in r.conditions}, key=RANK.get):
        frame = Frame(_with_references(bars, tf, rules))
        for r in rules:
            for c in r.conditions:
                if c.timeframe == tf:
                    raw = frame.step(f"raw__{r.slug}__{c.role}", c.when(frame))
                    frame.add(**{f"raw__{r.slug}__{c.role}": raw,
                                 f"sat__{r.slug}__{c.role}": frame.mode(raw, c.mode, c.within)})
                    for name, expr in r.context_by_role.get(c.role, {}).items():
                        frame.add(**{f"ctx__{r.slug}__{c.role}__{name}": expr(frame).cast("double")})
            if r.timeframe == tf:
                for name, expr in r.context.items():
                    frame.add(**{f"ctx__{r.slug}__{name}": expr(frame).cast("double")})
        out[tf] = stage(frame.build(keep=BOOK_KEEP), f"book-{tf}")
    return out


def booked_rows(booked: dict[str, DataFrame], rule: Rule) -> DataFrame:
    """Long record of the conditions: one row per (symbol, role, bar) with raw and satisfied."""
    parts = []
    for c in rule.conditions:
        df = booked[c.timeframe]
        if rule.universe:
            df = df.filter(F.col("symbol").isin(*rule.universe))
        parts.append(df.select(
            F.lit(rule.id).alias("rule_id"), "symbol", F.lit(c.role).alias("role"), "timeframe",
            "rn", "close_ts", "emit_ts", F.col(f"raw__{rule.slug}__{c.role}").alias("raw"),
            F.col(f"sat__{rule.slug}__{c.role}").alias("satisfied")))
    return reduce(DataFrame.unionByName, parts)


def _sat(rule: Rule, role: str) -> str:
    return f"sat__{rule.slug}__{role}"


def _context_columns(rule: Rule) -> dict[str, tuple[str | None, str]]:
    """Snapshot name -> (timeframe or None for the trigger's own, booked column)."""
    out: dict[str, tuple[str | None, str]] = {"close": (None, "close"), "volume": (None, "volume")}
    out.update({n: (None, f"ctx__{rule.slug}__{n}") for n in rule.context})
    for c in rule.conditions:
        for n in rule.context_by_role.get(c.role, {}):
            own = c.timeframe == rule.timeframe
            out[f"{c.role}.{n}"] = (None if own else c.timeframe, f"ctx__{rule.slug}__{c.role}__{n}")
    return out


def _wide_frame(booked: dict[str, DataFrame], tf: str, rules: list[Rule]) -> DataFrame:
    """Trigger bars of one timeframe with everything its rules read: one lead scan for the own
    timeframe and one as-of join per other timeframe, whatever the number of rules."""
    own = [_sat(r, c.role) for r in rules for c in r.conditions if c.timeframe == tf]
    # two bars emitted at the same instant are both evaluated before either is decided
    df = scan(booked[tf], KEYS, ["rn"], rn_chunk(), {"_after": ("lead", F.struct("emit_ts", *own))})
    twin = F.col("_after.emit_ts") == F.col("emit_ts")
    df = df.withColumns({s: F.when(twin, F.col("_after")[s]).otherwise(F.col(s)) for s in own})
    df = stage(df.drop("_after", *[c for c in df.columns if c.startswith("raw__")]), "trigger")
    others = sorted({c.timeframe for r in rules for c in r.conditions} - {tf}, key=RANK.get)
    for other in others:
        latest = [_sat(r, c.role) for r in rules for c in r.conditions if c.timeframe == other]
        snap = [col for r in rules for t, col in _context_columns(r).values() if t == other]
        joined = asof_known(df, booked[other], ["close_ts", *snap], "_ref", latest=latest, latest_out="_latest")
        df = stage(joined.select(
            *df.columns, F.col("_ref.close_ts").alias(f"_t_{other}"), *[F.col("_latest")[s].alias(s) for s in latest],
            *[F.col("_ref")[c].alias(c) for c in snap]), "trigger")
    return df


def _rule_rows(wide: DataFrame, rule: Rule) -> DataFrame:
    df = wide.filter(F.col("symbol").isin(*rule.universe)) if rule.universe else wide
    roles = [c.role for c in rule.conditions]
    stamp = [F.col("close_ts") if c.timeframe == rule.timeframe else F.col(f"_t_{c.timeframe}") for c in rule.conditions]
    ctx = _context_columns(rule)
    names = F.array(*[F.lit(r) for r in roles])
    return df.select(
        F.lit(rule.id).alias("rule_id"), *BOOK_KEEP,
        F.array(*[F.col(_sat(rule, r)) for r in roles]).alias("satisfied"), F.array(*stamp).alias("role_ts"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in ctx]), F.array(*[F.col(c) for _, c in ctx.values()])).alias("context"),
        F.map_filter(F.map_from_arrays(names, F.array(*stamp)), lambda _, v: v.isNotNull()).alias("role_bars"))


def trigger_frames(booked: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """One row per rule and trigger bar: latest evaluated result of every role at emission, the
    role bars visible at the bar's close, and the context snapshot."""
    parts = []
    for tf in sorted({r.timeframe for r in rules}, key=RANK.get):
        mine = [r for r in rules if r.timeframe == tf]
        wide = _wide_frame(booked, tf, mine)
        parts += [_rule_rows(wide, r) for r in mine]
    return reduce(DataFrame.unionByName, parts)


def trigger_frame(booked: dict[str, DataFrame], rule: Rule) -> DataFrame:
    return trigger_frames(booked, [rule])


def transitions(frames: DataFrame, rules: list[Rule]) -> DataFrame:
    return fold(frames, {r.id: r.chain() for r in rules})


def signals_of(frames: DataFrame, moves: DataFrame, rules: list[Rule]) -> DataFrame:
    """Signal rows: the emitting transitions joined back to their trigger bars."""
    direction = _per_rule(rules, lambda r: r.emit.direction)
    priority = _per_rule(rules, lambda r: r.emit.priority)
    fired = moves.filter("emitted").select("rule_id", "symbol", "rn", "dedup_key")
    return frames.join(fired, ["rule_id", "symbol", "rn"]).select(
        "rule_id", "symbol", direction.alias("direction"), "timeframe",
        F.col("close_ts").alias("fired_at"), F.col("close").alias("trigger_price"), "dedup_key",
        "context", "role_bars", F.lit(False).alias("tentative"), priority.alias("priority"),
        "trading_day")


def _per_rule(rules: list[Rule], pick) -> Column:
    col = None
    for r in rules:
        hit = F.col("rule_id") == r.id
        col = F.when(hit, pick(r)) if col is None else col.when(hit, pick(r))
    return col


def single_condition_signals(booked: dict[str, DataFrame], rule: Rule, key: Column) -> DataFrame:
    """A one-condition rule without cooldown needs no fold: every satisfied bar fires, and the
    first bar of each dedup key wins.

    Equivalent to the fold as long as no more than the remembered number of other keys lie
    between two uses of one key, which holds for keys made of bar times."""
    if len(rule.conditions) != 1 or rule.emit.cooldown_s:
        raise ValueError("only for one condition and no cooldown")
    c = rule.conditions[0]
    df = booked[c.timeframe].filter(F.col(f"sat__{rule.slug}__{c.role}"))
    if rule.universe:
        df = df.filter(F.col("symbol").isin(*rule.universe))
    values = {"close": "close", "volume": "volume",
              **{n: f"ctx__{rule.slug}__{n}" for n in rule.context}}
    first = df.withColumn("dedup_key", key).groupBy("symbol", "dedup_key").agg(F.min_by(
        F.struct("timeframe", "close_ts", "trading_day", *dict.fromkeys(values.values())),
        F.struct("emit_ts", "close_ts")).alias("b"))
    at = F.col("b.close_ts")
    return first.select(
        F.lit(rule.id).alias("rule_id"), "symbol", F.lit(rule.emit.direction).alias("direction"),
        "b.timeframe", at.alias("fired_at"), F.col("b.close").alias("trigger_price"), "dedup_key",
        F.map_from_arrays(F.array(*[F.lit(n) for n in values]),
                          F.array(*[F.col("b")[v] for v in values.values()])).alias("context"),
        F.create_map(F.lit(c.role), at).alias("role_bars"), F.lit(False).alias("tentative"),
        F.lit(rule.emit.priority).alias("priority"), F.col("b.trading_day").alias("trading_day"))


@dataclass
class Trial:
    """Everything a historical run of one rule yields; each field is a DataFrame."""

    signals: DataFrame
    outcomes: DataFrame
    report: DataFrame
    bands: DataFrame
    counts: DataFrame
    moves: DataFrame
    symbols_without_data: list[str]


def run_trial(rule: Rule, bars: DataFrame, params=None) -> Trial:
    """Run a rule over an indexed bar table as if it were enabled."""
    from tidemark.operators.conditions import condition_bands, condition_counts
    from tidemark.operators.outcomes import OutcomeParams, evaluate
    from tidemark.operators.quality import report

    params = params or OutcomeParams()
    booked = book(bars, [rule])
    frame = stage(trigger_frame(booked, rule), "frame")
    moves = stage(transitions(frame, [rule]), "moves")
    signals = stage(signals_of(frame, moves, [rule]), "signals")
    outcomes = stage(evaluate(signals, bars, params), "outcomes")
    rows = stage(booked_rows(booked, rule), "booked")
    missing = []
    if rule.universe:
        spark = bars.sparkSession
        asked = spark.createDataFrame([(u,) for u in rule.universe], "symbol string")
        missing = [r[0] for r in asked.join(bars.select("symbol").distinct(), "symbol", "left_anti")
                   .orderBy("symbol").collect()]  # at most the rule's own symbol list
    return Trial(signals, outcomes, report(outcomes), condition_bands(rows), condition_counts(rows),
                 moves, missing)
