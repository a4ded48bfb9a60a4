"""The function registry and user patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import sigdata as S
from tidemark.catalog.data import q6, series
from tidemark.catalog.q_indicators import H1
from tidemark.catalog.q_signals import COUNTS, DEMO, _booked
from tidemark.catalog.registry import query
from tidemark.catalog.util import rounded
from tidemark.functions import registry as G
from tidemark.operators import rules as R
from tidemark.operators.frame import Frame


@query("udf01_registered_functions", f"""WITH {H1} SELECT symbol, close_ts, {q6('CASE WHEN count(close) OVER w = 8 THEN avg(close) OVER w END')} AS m8, {q6('CASE WHEN count(high) OVER w = 8 THEN max(high) OVER w END')} AS h8, {q6('greatest(open, close)')} AS top
 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    f = Frame(series(spark, sf, "1h"))
    f.add(m8=G.call(f, "sma", "close", 8), h8=G.call(f, "highest", "high", 8), top=G.call(f, "max", f["open"], f["close"]))
    return rounded(f.build(keep=["symbol", "close_ts"]))


if "rising_closes" not in G.names():
    @G.pattern("rising_closes", {"n": 2})
    def rising_closes(frame, n):
        """Each of the last ``n`` closes above the one before it."""
        ok = frame["close"] > frame.prev("close", 1)
        for k in range(1, n):
            ok = ok & (frame.prev("close", k) > frame.prev("close", k + 1))
        return ok


@query("udf02_user_pattern", f"WITH {H1} SELECT symbol, close_ts, close > lag(close) OVER w AND lag(close) OVER w > lag(close, 2) OVER w AND lag(close, 2) OVER w > lag(close, 3) OVER w AS rising FROM s WINDOW w AS (PARTITION BY symbol ORDER BY rn)")
def _(spark, sf):
    f = Frame(series(spark, sf, "1h"))
    return f.add(rising=G.call(f, "rising_closes", n=3)).build(keep=["symbol", "close_ts"])


@query("udf03_condition_record", f"WITH RECURSIVE {DEMO}, {COUNTS} SELECT role, CAST(sum(n_true) AS BIGINT) AS n_true, CAST(sum(n_false) AS BIGINT) AS n_false, CAST(sum(n_unknown) AS BIGINT) AS n_unknown FROM cnt GROUP BY role")
def _(spark, sf):
    """The booked frame is the record of every condition."""
    rows = R.booked_rows(_booked(spark, sf), S.demo_rule())
    s = F.col("satisfied")
    return rows.groupBy("role").agg(F.count_if(s).alias("n_true"), F.count_if(~s).alias("n_false"), F.count_if(s.isNull()).alias("n_unknown"))
