"""Small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.data import q6, series_cte

OHLC = ["open", "high", "low", "close", "volume", "money"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double and widen every int, so that both engines print the same."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind == "double":
            c = F.round(c + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sel(frm: str, keys: list[str], floats: dict[str, str] | list[str], with_: str = "", where: str = "",
        digits: int = 6) -> str:
    """``WITH .. SELECT keys, rounded floats FROM frm``."""
    if isinstance(floats, list):
        floats = {f: f for f in floats}
    cols = ", ".join([*keys, *[f"{q6(e, digits)} AS {n}" for n, e in floats.items()]])
    head = f"WITH RECURSIVE {with_}\n" if with_ else ""
    return f"{head}SELECT {cols} FROM {frm}" + (f" WHERE {where}" if where else "")


def recur(name: str, frm: str, x: str, n: int, a: float, start: int = 1, seed: float | None = None) -> str:
    """Recursive CTE of a seeded recurrence over ``frm(symbol, rn, ...)``."""
    first = start if seed is not None else start + n - 1
    if seed is not None:
        base = f"SELECT symbol, rn, {a!r}::DOUBLE * ({x}) + {1 - a!r}::DOUBLE * {seed!r}::DOUBLE AS y FROM {frm} WHERE rn = {start}"
    else:
        base = (f"SELECT symbol, CAST({first} AS BIGINT) AS rn, avg({x}) AS y FROM {frm} "
                f"WHERE rn BETWEEN {start} AND {first} GROUP BY symbol HAVING count({x}) = {n}")
    return (f"{name} AS ({base} UNION ALL SELECT t.symbol, t.rn, {name}.y + {a!r}::DOUBLE * (t.x - {name}.y) "
            f"FROM {name} JOIN (SELECT symbol, rn, ({x}) AS x FROM {frm}) t "
            f"ON t.symbol = {name}.symbol AND t.rn = {name}.rn + 1)")


H1 = series_cte("1h")
