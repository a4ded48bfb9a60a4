"""Named functions and user patterns.

Every function takes a :class:`Frame` first and returns a Column, so a user pattern sees exactly
the as-of window that the built-in ones see and runs in the same pass.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators.frame import Frame

_FUNCTIONS: dict[str, tuple[Callable[..., Column], str]] = {}


def register(name: str, doc: str = ""):
    """Register ``fn(frame, ...) -> Column`` under ``name``."""
    def add(fn):
        if name in _FUNCTIONS:
            raise ValueError(f"function {name!r} exists already")
        if not inspect.signature(fn).parameters:
            raise ValueError(f"function {name!r} must take the frame as its first argument")
        _FUNCTIONS[name] = (fn, doc or inspect.getdoc(fn) or "")
        return fn
    return add


def pattern(name: str, params: dict[str, object] | None = None):
    """A user pattern with default parameters; its result must be boolean."""
    defaults = dict(params or {})

    def add(fn):
        def call(frame: Frame, **kw):
            unknown = set(kw) - set(defaults)
            if unknown:
                raise TypeError(f"pattern {name!r} has no parameter {sorted(unknown)}")
            return fn(frame, **{**defaults, **kw}).cast("boolean")
        register(name, inspect.getdoc(fn) or "")(call)
        return fn
    return add


def call(frame: Frame, name: str, *args, **kw) -> Column:
    """Look up ``name`` and check the arguments against its signature before calling it."""
    if name not in _FUNCTIONS:
        raise KeyError(f"unknown function {name!r}; known: {', '.join(names())}")
    fn, _doc = _FUNCTIONS[name]
    try:
        inspect.signature(fn).bind(frame, *args, **kw)
    except TypeError as e:
        raise TypeError(f"{name}: {e}") from None
    return fn(frame, *args, **kw)


def names() -> list[str]:
    return sorted(_FUNCTIONS)


def unregister(name: str) -> None:
    _FUNCTIONS.pop(name, None)


# Names usable in conditions.
for _name in ("sma ema std rsi macd_dif macd_dea macd_hist boll_mid boll_upper boll_lower atr kdj_k kdj_d kdj_j "
              "prev cross_up cross_down range gap engulfing consolidation range_atr inside_bar highest lowest "
              "swing_high swing_low double_bottom double_top").split():
    register(_name)(getattr(Frame, _name))
register("breakout")(lambda frame, box, direction="up": Frame.breakout(box, direction))
register("pin_bar")(lambda frame, direction="up", ratio=2.0: Frame.pin_bar(direction, ratio))
register("abs")(lambda frame, x: F.abs(x))
register("min")(lambda frame, *xs: scalars.smallest(*xs))
register("max")(lambda frame, *xs: scalars.largest(*xs))
