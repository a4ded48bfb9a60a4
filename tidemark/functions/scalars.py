"""Expression scalars with NULL as "unknown"."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
        "==": operator.eq, "!=": operator.ne}


def div(a: Column, b: Column) -> Column:
    """Division by zero is unknown."""
    return F.try_divide(a, b)


def mod(a: Column, b: Column) -> Column:
    """Floor modulo: the result has the sign of the divisor; by zero it is unknown."""
    return a - b * F.floor(F.try_divide(a, b))


def chain(first: Column, *rest) -> Column:
    """``chain(a, "<", b, "<=", c)``: stops at the first unknown or false link, left to right."""
    links = []
    left = first
    for op, right in zip(rest[::2], rest[1::2], strict=True):
        right = right if isinstance(right, Column) else F.lit(right)
        links.append(_OPS[op](left, right))
        left = right
    out = links[-1]
    for link in reversed(links[:-1]):
        out = F.when(link, out).when(~link, False)
    return out


def _all_known(xs: tuple[Column, ...]) -> Column:
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return known


def smallest(*xs: Column) -> Column:
    return F.when(_all_known(xs), F.least(*xs))


def largest(*xs: Column) -> Column:
    return F.when(_all_known(xs), F.greatest(*xs))


def truth(x: Column) -> Column:
    return x != 0
