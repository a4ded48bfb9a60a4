"""Bars: aggregation, the two clocks, keys, storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.data import (
    DERIVED, FIXED, M1, SUPPLY, all_bars_cte, minutes, once, series, series_cte, supply_calendar)
from tidemark.catalog.registry import query
from tidemark.catalog.util import OHLC, rounded, sel
from tidemark.functions import timekeys as K
from tidemark.operators import bars as B
from tidemark.plans.staging import stage
from tidemark.schema import rank_of, seconds_of, timeframe_dim

BAR_KEYS = ["symbol", "timeframe", "open_ts", "close_ts"]


@query("agg01_minutes_from_ticks", sel("m1", BAR_KEYS, OHLC, M1))
def _(spark, sf):
    return rounded(minutes(spark, sf).select(*BAR_KEYS, *OHLC))


@query("agg01_fixed_bars", sel("bars_all", [*BAR_KEYS, "emit_ts"], OHLC, all_bars_cte(*FIXED), "emit_ts IS NOT NULL"))
def _(spark, sf):
    return rounded(B.aggregate(minutes(spark, sf), FIXED).select(*BAR_KEYS, "emit_ts", *OHLC))


@query("agg01_bars_beside_open_minutes", sel("bars_all", [*BAR_KEYS, "emit_ts"], OHLC, all_bars_cte("5m", "1h", "1d"), "emit_ts IS NOT NULL"))
def _(spark, sf):
    """Minutes still in progress, inside and behind the closed ones, show in no bar."""
    m = minutes(spark, sf)
    open_ = m.filter("close_ts % 7 < 3").withColumns({"closed": F.lit(False), "high": F.lit(1e9), "close": F.lit(1e9), "close_ts": F.col("close_ts") + F.col("close_ts") % 2 * 60})
    return rounded(B.bar_series(m.unionByName(open_), ["5m", "1h", "1d"]).select(*BAR_KEYS, "emit_ts", *OHLC))


@query("agg01_complete_bars", sel("bars_all", [*BAR_KEYS, "coalesce(emit_ts, close_ts) AS emit_ts"], OHLC, all_bars_cte("1h", "4h")))
def _(spark, sf):
    return rounded(B.flush(B.aggregate_all(minutes(spark, sf), ["1h", "4h"])).select(*BAR_KEYS, "emit_ts", *OHLC))


@query("agg01_pending_bars", sel("bars_all", BAR_KEYS, OHLC, all_bars_cte("5m", "1h", "1d", "1mon"), "emit_ts IS NULL"))
def _(spark, sf):
    return rounded(B.pending(minutes(spark, sf), ["5m", "1h", "1d", "1mon"]).select(*BAR_KEYS, *OHLC))


@query("agg02_calendar_bars", sel("bars_all", [*BAR_KEYS, "emit_ts"], OHLC, all_bars_cte("1d", "1w", "1mon")))
def _(spark, sf):
    return rounded(B.aggregate_all(minutes(spark, sf), ["1d", "1w", "1mon"]).select(*BAR_KEYS, "emit_ts", *OHLC))


def _supply_cal():
    body = SUPPLY.split(",\ns AS MATERIALIZED")[0]
    parts = []
    for tf, unit in (("1w", "week"), ("1mon", "month")):
        key = f"date_trunc('{unit}', to_timestamp(close_ts) AT TIME ZONE 'UTC')"
        parts.append(f"""SELECT symbol, '{tf}' AS timeframe, first(open_ts ORDER BY close_ts) AS open_ts, max(close_ts) AS close_ts,
          first(open ORDER BY close_ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY close_ts) AS close,
          sum(volume) AS volume, sum(money) AS money,
          lead(min(close_ts)) OVER (PARTITION BY symbol ORDER BY {key}) AS emit_ts
          FROM m1 GROUP BY symbol, {key}""")
    return f"{body}, cal AS ({' UNION ALL '.join(parts)})"


@query("agg02_supplier_weeks_months", sel("cal", [*BAR_KEYS, "emit_ts"], OHLC, _supply_cal(), digits=8))
def _(spark, sf):
    return rounded(supply_calendar(spark, sf, ["1w", "1mon"]).select(*BAR_KEYS, "emit_ts", *OHLC), 8)


@query("agg03_all_timeframes", sel("bars_all", [*BAR_KEYS, "emit_ts"], OHLC, all_bars_cte(*DERIVED), "emit_ts IS NOT NULL"))
def _(spark, sf):
    return rounded(B.aggregate(minutes(spark, sf), DERIVED).select(*BAR_KEYS, "emit_ts", *OHLC))


# ------------------------------------------------------------------ scalar keys

@query("prj01_bucket_close", f"WITH {M1} SELECT symbol, close_ts, -(CAST(floor(-close_ts / 300.0) AS BIGINT)) * 300 AS b5m, -(CAST(floor(-close_ts / 14400.0) AS BIGINT)) * 14400 AS b4h FROM m1")
def _(spark, sf):
    return minutes(spark, sf).select("symbol", "close_ts", K.bucket_close("close_ts", "5m").alias("b5m"),
                                     K.bucket_close("close_ts", "4h").alias("b4h"))


@query("prj02_bucket_open", f"WITH {M1} SELECT symbol, close_ts, ((close_ts + 3599) // 3600) * 3600 - 3600 AS bucket_open FROM m1")
def _(spark, sf):
    return minutes(spark, sf).select("symbol", "close_ts", K.bucket_open(K.bucket_close("close_ts", "1h"), "1h").alias("bucket_open"))


NOW = 1705276800  # a fixed clock inside the data


@query("prj03_closed_filter", f"WITH {M1} SELECT symbol, close_ts FROM m1 WHERE close_ts <= {NOW}")
def _(spark, sf):
    return minutes(spark, sf).filter(K.is_closed("close_ts", NOW)).select("symbol", "close_ts")


@query("prj04_timeframe_dimension", f"""WITH {all_bars_cte('5m', '1h', '1d')},
 d(timeframe, seconds, rank, is_calendar) AS (VALUES ('1m',60,0,false),('5m',300,1,false),('15m',900,2,false),('30m',1800,3,false),('1h',3600,4,false),('4h',14400,5,false),('1d',0,6,true),('1w',0,7,true),('1mon',0,8,true))
 SELECT timeframe, CAST(any_value(seconds) AS BIGINT) AS seconds, CAST(any_value(rank) AS BIGINT) AS rank, bool_or(is_calendar) AS is_calendar, count(*) AS n
 FROM bars_all JOIN d USING (timeframe) WHERE emit_ts IS NOT NULL GROUP BY timeframe""")
def _(spark, sf):
    return (series(spark, sf, "5m", "1h", "1d").join(F.broadcast(timeframe_dim(spark)), "timeframe")  # 9 rows
            .groupBy("timeframe").agg(F.max("seconds").alias("seconds"), F.max("rank").alias("rank"),
                                      F.max("is_calendar").alias("is_calendar"), F.count(F.lit(1)).alias("n")))


@query("prj04_timeframe_scalars", f"""WITH {all_bars_cte('15m', '1w')} SELECT symbol, close_ts, CASE timeframe WHEN '15m' THEN 900 ELSE 0 END::BIGINT AS seconds, CASE timeframe WHEN '15m' THEN 2 ELSE 7 END::BIGINT AS rank FROM bars_all WHERE emit_ts IS NOT NULL""")
def _(spark, sf):
    return series(spark, sf, "15m", "1w").select("symbol", "close_ts", seconds_of(F.col("timeframe")).alias("seconds"), rank_of(F.col("timeframe")).alias("rank"))


@query("prj11_period_keys", """WITH t AS (SELECT event_id, (epoch_us(ts) + 59999999) // 60000000 * 60 AS c FROM events), d AS (SELECT *, CAST(to_timestamp(c) AT TIME ZONE 'UTC' AS DATE) AS dt FROM t)
 SELECT event_id, strftime(dt, '%Y-%m-%d') AS day_key, isoyear(dt) || '-W' || lpad(CAST(week(dt) AS VARCHAR), 2, '0') AS week_key, strftime(dt, '%Y-%m') AS month_key FROM d""")
def _(spark, sf):
    from tidemark.catalog.data import table
    c = K.ceil_to(F.floor((K.epoch_micros("ts") + 999999) / 1000000).cast("bigint"), 60)
    d = K.utc_date(c)
    return table(spark, sf, "events").select("event_id", K.period_key("1d", d).alias("day_key"),
                                             K.period_key("1w", d).alias("week_key"), K.period_key("1mon", d).alias("month_key"))


@query("prj11_supplier_period_keys", """SELECT l_shipdate, strftime(l_shipdate, '%Y-%m-%d') AS day_key, isoyear(l_shipdate) || '-W' || lpad(CAST(week(l_shipdate) AS VARCHAR), 2, '0') AS week_key,
 strftime(l_shipdate, '%Y-%m') AS month_key, count(*) AS n FROM (SELECT strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate_s, l_shipdate FROM lineitem) GROUP BY l_shipdate""".replace("SELECT l_shipdate,", "SELECT strftime(l_shipdate, '%Y-%m-%d') AS ship_day,"))
def _(spark, sf):
    from tidemark.catalog.data import table
    days = table(spark, sf, "lineitem").groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n"))
    d = F.col("l_shipdate").cast("date")
    return days.select(K.day_text(d).alias("ship_day"), K.period_key("1d", d).alias("day_key"), K.period_key("1w", d).alias("week_key"),
                       K.period_key("1mon", d).alias("month_key"), "n")


@query("prj12_partition_key", f"""WITH {all_bars_cte('1h', '1w')} SELECT timeframe, CASE WHEN timeframe = '1w' THEN strftime(dt, '%Y') ELSE strftime(dt, '%Y-%m-%d') END AS part, count(*) AS n
 FROM (SELECT timeframe, CAST(to_timestamp(close_ts) AT TIME ZONE 'UTC' AS DATE) AS dt FROM bars_all WHERE emit_ts IS NOT NULL) GROUP BY ALL""")
def _(spark, sf):
    return series(spark, sf, "1h", "1w").groupBy("timeframe", K.partition_key().alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("prj13_invalid_bars", """SELECT l_orderkey, l_linenumber, l_partkey, 'close_not_after_open' AS problem FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate <= o_orderdate
 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'low_above_high' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate AND l_extendedprice > o_totalprice""")
def _(spark, sf):
    from tidemark.catalog.data import table
    from tidemark.sources.bar_table import bar_problem
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    problem = bar_problem(F.col("o_orderdate").cast("timestamp_ntz"), F.col("l_shipdate").cast("timestamp_ntz"), F.col("o_totalprice"), F.col("l_extendedprice"))
    return rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", problem.alias("problem")).filter("problem IS NOT NULL")


@query("prj14_market_of_symbol", f"WITH {M1} SELECT split_part(symbol, '.', 1) AS market, count(*) AS n FROM m1 GROUP BY 1")
def _(spark, sf):
    return minutes(spark, sf).groupBy(K.market_of().alias("market")).agg(F.count(F.lit(1)).alias("n"))


@query("prj15_local_hour", f"WITH {M1} SELECT symbol, CAST(((close_ts + CASE WHEN symbol LIKE 'CRYPTO%' THEN 0 ELSE 28800 END) % 86400) // 3600 AS BIGINT) AS hour, count(*) AS n FROM m1 GROUP BY ALL")
def _(spark, sf):
    return minutes(spark, sf).groupBy("symbol", K.local_hour("close_ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("prj16_session_day", f"WITH {M1} SELECT symbol, strftime(to_timestamp(close_ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS session_day, count(*) AS n FROM m1 GROUP BY ALL")
def _(spark, sf):
    return minutes(spark, sf).groupBy("symbol", K.day_text(K.bar_date()).alias("session_day")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ gaps

@query("win04_gaps", f"WITH {series_cte('1h')} SELECT symbol, prev_ts, close_ts, close_ts - prev_ts AS width FROM (SELECT symbol, close_ts, lag(close_ts) OVER (PARTITION BY symbol ORDER BY close_ts) AS prev_ts FROM s) WHERE close_ts - prev_ts > 3600")
def _(spark, sf):
    from tidemark.sources.bar_table import gaps
    return gaps(series(spark, sf, "1h")).select("symbol", "prev_ts", "close_ts", "width")


@query("win05_missing_span", f"""WITH {M1}, cur AS (SELECT symbol, max(close_ts) AS last_ts FROM m1 WHERE close_ts <= {NOW} GROUP BY symbol),
 nxt AS (SELECT symbol, min(close_ts) AS first_new FROM m1 WHERE close_ts > {NOW} GROUP BY symbol)
 SELECT symbol, last_ts AS missing_from, first_new AS missing_to, first_new - 60 AS backfill_end FROM cur JOIN nxt USING (symbol) WHERE first_new > last_ts + 60""")
def _(spark, sf):
    from tidemark.sources.bar_table import missing_spans
    m = minutes(spark, sf)
    cursor = m.filter(F.col("close_ts") <= NOW).groupBy("symbol").agg(F.max("close_ts").alias("last_ts"))
    return missing_spans(cursor, m.filter(F.col("close_ts") > NOW), 60)

