"""Stored bars, payloads, dimensions, calendars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog import sigdata as S
from tidemark.catalog.data import M1, SUPPLY, minutes, once, q6, series, series_cte, supply_series, table
from tidemark.catalog.q_indicators import H1
from tidemark.catalog.registry import query
from tidemark.catalog.util import OHLC, rounded, sel
from tidemark.functions import calendar as C
from tidemark.functions import timekeys as K
from tidemark.plans.ranges import range_scan
from tidemark.plans.staging import shared_dir, stage
from tidemark.sources import bar_table as T
from tidemark.sources import dimensions as D
from tidemark.sources import logs, payloads

BAR_KEYS = ["symbol", "timeframe", "open_ts", "close_ts"]
STORE_TFS = ("1h", "4h", "1d")
NOW = 1705276800


def store(spark, sf):
    """A bar table written through the upsert, in two overlapping batches."""
    def make():
        root = f"{shared_dir(spark)}/tidemark/store-{uuid.uuid4().hex}"
        bars = series(spark, sf, *STORE_TFS).select(*T.STORED)
        T.write_bars(bars.filter(F.col("close_ts") <= NOW + 86400), root)
        T.write_bars(bars.filter(F.col("close_ts") > NOW - 86400), root)
        return root
    return once(spark, ("store", sf), make)


STORED = series_cte(*STORE_TFS)


@query("src01_range_scan", sel("s", BAR_KEYS, OHLC, STORED, "symbol = 'CN.SIM.click' AND timeframe = '1h' AND close_ts > 1704600000 AND close_ts <= 1706000400"))
def _(spark, sf):
    bars = T.open_table(spark, store(spark, sf))
    return rounded(T.read_range(bars, "CN.SIM.click", "1h", 1704600000, 1706000400).select(*BAR_KEYS, *OHLC))


@query("src02_tail_scan", sel("(SELECT * FROM s WHERE symbol = 'CRYPTO.SIM.error' AND timeframe = '1h' ORDER BY close_ts DESC LIMIT 100)", BAR_KEYS, OHLC, STORED))
def _(spark, sf):
    return rounded(T.tail_of(spark, store(spark, sf), "CRYPTO.SIM.error", "1h", 100).select(*BAR_KEYS, *OHLC))


@query("src02_tail_of_every_series", sel("(SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY close_ts DESC) AS back FROM s)", BAR_KEYS, OHLC, STORED, "back <= 50"))
def _(spark, sf):
    return rounded(T.tails(series(spark, sf, *STORE_TFS), 50).select(*BAR_KEYS, *OHLC))


@query("src03_close_ts_scan", f"WITH {STORED} SELECT DISTINCT close_ts FROM s WHERE symbol = 'CRYPTO.SIM.signup' AND timeframe = '4h'")
def _(spark, sf):
    return T.read_close_ts(T.open_table(spark, store(spark, sf)), "CRYPTO.SIM.signup", "4h")


@query("src04_bar_counts", f"WITH {STORED} SELECT symbol, timeframe, count(*) AS n FROM s GROUP BY ALL")
def _(spark, sf):
    return T.count_bars(T.open_table(spark, store(spark, sf)))


_DAY = "strftime(to_timestamp(close_ts) AT TIME ZONE 'UTC', '%Y-%m-%d')"


@query("src05_partition_span", f"WITH {STORED} SELECT symbol, timeframe, min({_DAY}) AS first_day, max({_DAY}) AS last_day FROM s GROUP BY ALL")
def _(spark, sf):
    return T.covered_spans(T.open_coverage(spark, store(spark, sf))).select("symbol", "timeframe", "first_day", "last_day")


@query("src06_replay_feed", f"WITH {M1} SELECT symbol, close_ts, {q6('close')} AS close FROM m1 WHERE symbol IN ('CN.SIM.click', 'CRYPTO.SIM.error') AND close_ts > 1704600000 AND close_ts <= 1706000000")
def _(spark, sf):
    return rounded(T.replay(minutes(spark, sf), ["CN.SIM.click", "CRYPTO.SIM.error"], 1704600000, 1706000000).select("symbol", "close_ts", "close"))


@query("src06_covered_span", f"WITH {M1} SELECT min(close_ts) AS first_ts, max(close_ts) AS last_ts FROM m1")
def _(spark, sf):
    return T.covered_span(minutes(spark, sf))


@query("srt03_replay_order", f"WITH {M1} SELECT symbol, close_ts, row_number() OVER (ORDER BY close_ts, symbol) AS pos FROM m1")
def _(spark, sf):
    """Global replay positions: sampled ranges of the order, each numbered by itself, with counts carried between them."""
    return range_scan(minutes(spark, sf).select("symbol", "close_ts"), [], ["close_ts", "symbol"], {"pos": ("count", "close_ts")})


# ------------------------------------------------------------------ payloads

def quote_landing(spark, sf):
    """Quote responses per (symbol, timeframe, day), one per code or several codes in one answer."""
    bars = series(spark, sf, "1h", "1d")
    daily = F.col("timeframe") == "1d"
    day_start = F.floor((F.col("close_ts") - F.when(daily, 1).otherwise(0)) / 86400).cast("bigint") * 86400
    k = F.struct(F.when(daily, day_start).otherwise(F.col("close_ts")).alias("time_stamp"), "open", "high", "low", "close", "volume", "money", "open_interest")
    g = bars.groupBy("symbol", "timeframe", day_start.alias("d")).agg(F.array_sort(F.collect_list(k)).alias("k"))  # one day of one series
    single = F.to_json(F.struct(F.lit(0).alias("code"), F.lit("ok").alias("msg"), F.col("k").alias("data")))
    multi = F.to_json(F.struct(F.lit(0).alias("code"), F.lit("ok").alias("msg"), F.array(
        F.struct(F.lit("other").alias("code"), F.slice("k", 1, 1).alias("klines")), F.struct(F.col("symbol").alias("code"), F.col("k").alias("klines"))).alias("data")))
    text = (F.when(F.col("symbol") == "CN.SIM.view", multi)
            .when((F.col("symbol") == "CRYPTO.SIM.error") & (F.col("d") % 172800 == 0), F.lit('{"code":7,"msg":"quota","data":null}'))
            .when((F.col("symbol") == "CRYPTO.SIM.error"), F.lit('{"code":0,"msg":"ok","data":null}')).otherwise(single))
    return g.select("symbol", "timeframe", F.col("symbol").alias("requested"), text.alias("payload"))


@query("src07_quote_payload_bars", f"""WITH {series_cte('1h', '1d')}, q AS (SELECT *, CAST(floor((close_ts - CASE timeframe WHEN '1d' THEN 1 ELSE 0 END) / 86400.0) AS BIGINT) * 86400 AS d FROM s WHERE symbol <> 'CRYPTO.SIM.error')
 SELECT symbol, timeframe, CASE timeframe WHEN '1d' THEN d ELSE close_ts - 3600 END AS open_ts, CASE timeframe WHEN '1d' THEN d + 86400 ELSE close_ts END AS close_ts, {', '.join(f'{q6(c)} AS {c}' for c in OHLC)},
 CASE timeframe WHEN '1d' THEN strftime(to_timestamp(d) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS trading_day, CASE timeframe WHEN '1d' THEN d + 86400 ELSE close_ts END <= {NOW} AS closed FROM q""")
def _(spark, sf):
    rows = payloads.quote_rows(quote_landing(spark, sf), requested="requested")
    return rounded(payloads.quote_bars(rows, NOW).select(*BAR_KEYS, *OHLC, "trading_day", "closed"))


@query("src07_quote_payload_errors", f"""WITH {series_cte('1h', '1d')}, q AS (SELECT DISTINCT symbol, timeframe, CAST(floor((close_ts - CASE timeframe WHEN '1d' THEN 1 ELSE 0 END) / 86400.0) AS BIGINT) * 86400 AS d FROM s WHERE symbol = 'CRYPTO.SIM.error')
 SELECT symbol, timeframe, '7 quota' AS error, count(*) AS n FROM q WHERE d % 172800 = 0 GROUP BY ALL""")
def _(spark, sf):
    rows = payloads.quote_rows(quote_landing(spark, sf), requested="requested")
    return rows.filter("error IS NOT NULL").groupBy("symbol", "timeframe", "error").agg(F.count(F.lit(1)).alias("n"))


def _candle_row():
    return F.array((F.col("open_ts") * 1000).cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close")],
                   (F.col("volume") * 100).cast("string"), F.col("volume").cast("string"), F.col("money").cast("string"),
                   F.when(F.col("close_ts") <= NOW, "1").otherwise("0"))


def candle_landing(spark, sf):
    """Exchange candle responses, newest first, with open candles and failed answers."""
    bars = series(spark, sf, "1h")
    g = bars.groupBy("symbol", "timeframe", F.floor(F.col("close_ts") / 86400).alias("d")).agg(
        F.sort_array(F.collect_list(F.struct("close_ts", _candle_row().alias("r"))), asc=False).alias("k"))  # one day of one series
    good = F.to_json(F.struct(F.lit("0").alias("code"), F.lit("").alias("msg"), F.col("k.r").alias("data")))
    return g.select("symbol", "timeframe", F.when(F.col("symbol") == "CN.SIM.view", '{"code":"50011","msg":"busy","data":[]}').otherwise(good).alias("payload"))


@query("src08_candle_payload_bars", sel("s", BAR_KEYS, OHLC, H1, f"close_ts <= {NOW} AND symbol <> 'CN.SIM.view'"))
def _(spark, sf):
    return rounded(payloads.candle_bars(candle_landing(spark, sf)).select(*BAR_KEYS, *OHLC))


@query("src08_candle_payload_errors", f"WITH {H1} SELECT symbol, '50011' AS code, 'busy' AS msg, count(DISTINCT close_ts // 86400) AS n FROM s WHERE symbol = 'CN.SIM.view' GROUP BY ALL")
def _(spark, sf):
    return payloads.candle_errors(candle_landing(spark, sf)).groupBy("symbol", "code", "msg").agg(F.count(F.lit(1)).alias("n"))


def push_messages(spark, sf):
    """One push message per one-minute bar, with heartbeats, acknowledgements and error events."""
    m = minutes(spark, sf)
    data = F.to_json(F.struct(F.struct(F.lit("candle1m").alias("channel"), F.col("symbol").alias("instId")).alias("arg"),
                              F.array(F.array((F.col("open_ts") * 1000).cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close")],
                                              F.col("volume").cast("string"), F.col("volume").cast("string"), F.col("money").cast("string"), F.lit("1"))).alias("data")))
    text = (F.when(F.col("symbol") == "CRYPTO.SIM.signup", F.lit('{"event":"error","code":"60018","msg":"wrong channel"}'))
            .when((F.col("symbol") == "CN.SIM.view") & (F.col("close_ts") % 120 == 0), "pong")
            .when((F.col("symbol") == "CN.SIM.view"), F.lit('{"event":"subscribe","arg":{"channel":"candle1m"}}'))
            .when((F.col("symbol") == "CRYPTO.SIM.purchase") & (F.col("close_ts") % 300 == 0), F.lit("{broken")).otherwise(data))
    return m.select(text.alias("text"))


@query("src09_push_message_bars", sel("m1", BAR_KEYS, OHLC, M1, "symbol IN ('CN.SIM.click', 'CRYPTO.SIM.error') OR (symbol = 'CRYPTO.SIM.purchase' AND close_ts % 300 <> 0)"))
def _(spark, sf):
    rows, _errors = payloads.push_rows(push_messages(spark, sf))
    return rounded(payloads.push_bars(rows).select(*BAR_KEYS, *OHLC))


@query("src09_push_message_errors", f"WITH {M1} SELECT '60018' AS code, 'wrong channel' AS msg, count(*) AS n FROM m1 WHERE symbol = 'CRYPTO.SIM.signup'")
def _(spark, sf):
    _rows, errors = payloads.push_rows(push_messages(spark, sf))
    return errors.groupBy("code", "msg").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ dimensions

def segment_rows(spark, sf):
    """Main-contract rows: ten suppliers form a product, each its main contract for 240 days."""
    s = table(spark, sf, "supplier")
    j = (F.col("s_suppkey") % 10).cast("int")
    start = F.date_add(F.lit("1995-01-02").cast("date"), j * 240)
    end = F.date_add(start, 239)
    return s.select(F.concat(F.lit("PROD."), F.floor(F.col("s_suppkey") / 10).cast("string")).alias("main_variety_code"),
                    F.concat(F.lit("SUP."), F.col("s_suppkey").cast("string")).alias("variety_code"),
                    F.concat(K.day_text(start), F.lit(" 00:00:00")).alias("start_date"), F.concat(K.day_text(end), F.lit(" 00:00:00")).alias("end_date"))


SEG = """seg AS MATERIALIZED (SELECT 'PROD.' || (s_suppkey // 10) AS product, 'SUP.' || s_suppkey AS contract, strftime(DATE '1995-01-02' + CAST(s_suppkey % 10 * 240 AS INTEGER), '%Y-%m-%d') AS start_day,
 strftime(DATE '1995-01-02' + CAST(s_suppkey % 10 * 240 + 239 AS INTEGER), '%Y-%m-%d') AS end_day FROM supplier)"""


@query("src10_main_segments", f"WITH {SEG} SELECT * FROM seg")
def _(spark, sf):
    return D.check_segments(D.parse_segments(segment_rows(spark, sf)))


@query("src10_overlapping_segments", """WITH o AS (SELECT o_orderpriority AS product, 'C' || o_custkey AS contract, strftime(min(o_orderdate), '%Y-%m-%d') AS start_day, strftime(max(o_orderdate), '%Y-%m-%d') AS end_day FROM orders GROUP BY ALL),
 l AS (SELECT *, lag(end_day) OVER (PARTITION BY product ORDER BY start_day, contract) AS prev_end FROM o) SELECT product, contract, start_day, prev_end FROM l WHERE start_day <= prev_end""")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("product"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("contract")).agg(
        K.day_text(F.min("o_orderdate").cast("date")).alias("start_day"), K.day_text(F.max("o_orderdate").cast("date")).alias("end_day"))
    return D.overlapping_segments(o).select("product", "contract", "start_day", "prev_end")


def symbols(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(F.concat(F.lit("SUP."), F.col("s_suppkey").cast("string")).alias("uid"),
                         F.concat(F.lit("cal_"), F.col("n_regionkey").cast("string")).alias("calendar"), (F.col("s_suppkey") % 10 == 3).alias("is_continuous"),
                         F.when(F.col("s_acctbal") > 0, F.floor(F.col("s_acctbal") / 1000) + 1.0).alias("multiplier"),
                         F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("quote_code"))


SYM = """sym AS (SELECT 'SUP.' || s_suppkey AS uid, 'cal_' || n_regionkey AS calendar, s_suppkey % 10 = 3 AS is_continuous, CASE WHEN s_acctbal > 0 THEN floor(s_acctbal / 1000) + 1.0 END AS multiplier,
 CASE WHEN s_acctbal > 5000 THEN s_name END AS quote_code FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("src11_missing_calendars", f"WITH {SYM} SELECT uid, calendar FROM sym WHERE calendar NOT IN (SELECT 'cal_' || r_regionkey FROM region WHERE r_name <> 'ASIA')")
def _(spark, sf):
    cals = table(spark, sf, "region").filter("r_name <> 'ASIA'").select(F.concat(F.lit("cal_"), F.col("r_regionkey").cast("string")).alias("calendar"))
    return D.missing_calendars(symbols(spark, sf), cals).select("uid", "calendar")


@query("src11_tradable_symbols", f"WITH {SYM} SELECT uid, quote_code IS NULL AS unmapped FROM sym WHERE NOT is_continuous")
def _(spark, sf):
    t = D.tradable(symbols(spark, sf))
    gone = D.missing_mapping(t, "quote_code").select("uid", F.lit(True).alias("u"))
    return t.join(gone, "uid", "left").select("uid", F.coalesce("u", F.lit(False)).alias("unmapped"))


@query("jon13_dimension_lookup", f"WITH {SUPPLY}, {SYM} SELECT s.symbol, s.close_ts, calendar, multiplier FROM s LEFT JOIN sym ON sym.uid = s.symbol")
def _(spark, sf):
    dim = symbols(spark, sf).select(F.col("uid").alias("symbol"), "calendar", "multiplier")
    return D.with_dimension(supply_series(spark, sf), dim, ["symbol"]).select("symbol", "close_ts", "calendar", "multiplier")


_BF = "SELECT 'SUP.' || s_suppkey AS symbol, '1d' AS timeframe, CASE WHEN s_suppkey % 2 = 0 THEN '1996-01-01' ELSE '1995-01-01' END AS start_day, '2000-12-31' AS end_day FROM supplier"


@query("src14_backfill_plan", f"WITH {SUPPLY}, rq AS ({_BF}), sp AS (SELECT symbol, min({_DAY}) AS f, max({_DAY}) AS l FROM s GROUP BY symbol) SELECT rq.* FROM rq LEFT JOIN sp USING (symbol) WHERE NOT coalesce(f <= start_day AND l >= end_day, FALSE)")
def _(spark, sf):
    rq = table(spark, sf, "supplier").select(
        F.concat(F.lit("SUP."), F.col("s_suppkey").cast("string")).alias("symbol"), F.lit("1d").alias("timeframe"),
        F.when(F.col("s_suppkey") % 2 == 0, "1996-01-01").otherwise("1995-01-01").alias("start_day"), F.lit("2000-12-31").alias("end_day"))
    return T.backfill_plan(rq, supply_series(spark, sf))


_BF2 = "SELECT symbol, timeframe, CASE WHEN hash_ % 2 = 0 THEN first_day ELSE '2023-12-01' END AS start_day, last_day AS end_day FROM (SELECT *, length(symbol) AS hash_ FROM sp)"


@query("src14_backfill_from_coverage", f"WITH {STORED}, sp AS (SELECT symbol, timeframe, min({_DAY}) AS first_day, max({_DAY}) AS last_day FROM s GROUP BY ALL), rq AS ({_BF2}) SELECT rq.symbol, rq.timeframe, start_day, end_day FROM rq JOIN sp USING (symbol, timeframe) WHERE NOT (first_day <= start_day AND last_day >= end_day)")
def _(spark, sf):
    """Which requests aren't covered, from the coverage rows of the stored table alone."""
    spans = T.covered_spans(T.open_coverage(spark, store(spark, sf)))
    rq = spans.select("symbol", "timeframe", F.when(F.length("symbol") % 2 == 0, F.col("first_day")).otherwise("2023-12-01").alias("start_day"), F.col("last_day").alias("end_day"))
    return T.backfill_plan(rq, spans=spans)


_MAINS = "SELECT n_name AS product, 'c' || c_custkey AS contract, min(o_orderdate) AS start_date FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL"
_SYNC = f"""WITH p AS (SELECT n_name AS product, r_name AS exchange, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE 0.5 END::DOUBLE AS price_tick, 10.0::DOUBLE AS multiplier FROM nation JOIN region ON r_regionkey = n_regionkey),
 c AS (SELECT n_name AS product, 'cal_' || n_regionkey AS calendar FROM nation WHERE n_regionkey < 4), m AS ({_MAINS}), l AS (SELECT product, arg_max(contract, (start_date, contract)) AS code FROM m GROUP BY product)"""


def _sync(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    products = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_name").alias("product"), F.col("r_name").alias("exchange"),
        F.when(F.col("n_nationkey") % 7 == 0, None).otherwise(0.5).cast("double").alias("price_tick"), F.lit(10.0).alias("multiplier"))
    cals = n.filter("n_regionkey < 4").select(F.col("n_name").alias("product"), F.concat(F.lit("cal_"), F.col("n_regionkey").cast("string")).alias("calendar"))
    mains = (table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
             .join(n, F.col("n_nationkey") == F.col("c_nationkey"))
             .groupBy(F.col("n_name").alias("product"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("contract"))
             .agg(F.min("o_orderdate").alias("start_date")))
    return D.sync_universe(products, cals, mains)


@query("src15_universe_sync", f"{_SYNC} SELECT 'CN.' || exchange || '.' || code AS uid, 'CN' AS market, exchange, code, calendar, price_tick, multiplier, product FROM p JOIN c USING (product) JOIN l USING (product) WHERE coalesce(price_tick, 0) <> 0")
def _(spark, sf):
    return _sync(spark, sf)[0]


@query("src15_universe_dropped", f"{_SYNC} SELECT product, CASE WHEN price_tick IS NULL THEN 'incomplete' WHEN calendar IS NULL THEN 'no calendar' ELSE 'no main contract' END AS reason FROM p LEFT JOIN c USING (product) LEFT JOIN l USING (product) WHERE price_tick IS NULL OR calendar IS NULL OR code IS NULL")
def _(spark, sf):
    return _sync(spark, sf)[1]


@query("prj23_universe_expansion", f"WITH {SYM}, i(rule_id, pos, item) AS (VALUES ('a', 1, 'SUP.*'), ('a', 2, 'SUP.3'), ('a', 3, 'CRYPTO.X'), ('b', 1, 'SUP.7'), ('b', 2, 'SUP.1.*')), x AS (SELECT rule_id, pos, uid AS symbol FROM i JOIN sym ON NOT is_continuous AND item LIKE '%.*' AND starts_with(uid, substr(item, 1, length(item) - 1)) UNION ALL SELECT rule_id, pos, item FROM i WHERE item NOT LIKE '%.*') SELECT rule_id, symbol, CAST(min(pos) AS BIGINT) AS pos FROM x GROUP BY ALL")
def _(spark, sf):
    items = spark.createDataFrame([("a", 1, "SUP.*"), ("a", 2, "SUP.3"), ("a", 3, "CRYPTO.X"), ("b", 1, "SUP.7"), ("b", 2, "SUP.1.*")], "rule_id string, pos bigint, item string")
    return D.expand_universe(items, symbols(spark, sf))


# ------------------------------------------------------------------ calendars

HOLIDAYS = frozenset({"1996-12-25", "1997-01-01", "1997-05-01", "1998-10-01", "1998-10-02", "1999-02-15", "1999-02-16", "1999-02-17",
                      "2024-01-01", "2024-01-10", "2024-01-26"})
CALS = C.stock_calendars(HOLIDAYS)
_HOL = ", ".join(f"(DATE '{h}')" for h in sorted(HOLIDAYS))
_CAL_ROWS = ", ".join(f"('{c.id}', {str(c.weekends).upper()}, {str(c.has_night).upper()}, {c.early_end}, {str(bool(c.holidays)).upper()})" for c in CALS.values())
_SES_ROWS = ", ".join(f"('{c.id}', {a}, {b}, {str(a >= 1200).upper()})" for c in CALS.values() for a, b in c.spans)


def _dates_sql(first: str, last: str) -> str:
    return f"""hol(h) AS (VALUES {_HOL}), cal(calendar, weekends, has_night, early_end, uses) AS (VALUES {_CAL_ROWS}), ses(calendar, s0, s1, night) AS (VALUES {_SES_ROWS}),
 d0 AS MATERIALIZED (SELECT calendar, has_night, CAST(unnest(generate_series({first}, {last} + 40, INTERVAL 1 DAY)) AS DATE) AS date, weekends, uses FROM cal),
 d1 AS MATERIALIZED (SELECT calendar, has_night, date, uses AND date IN (SELECT h FROM hol) AS holiday, weekends OR isodow(date) < 6 AS open_day FROM d0),
 d2 AS MATERIALIZED (SELECT *, open_day AND NOT holiday AS is_trading, min(CASE WHEN open_day AND NOT holiday THEN date END) OVER w AS next_trading,
  min(CASE WHEN holiday OR open_day THEN (CASE WHEN holiday THEN 0 ELSE 1 END + 10 * datediff('day', DATE '1970-01-01', date)) END) OVER w % 10 = 1 AS tonight FROM d1 WINDOW w AS (PARTITION BY calendar ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)),
 dates AS MATERIALIZED (SELECT calendar, date, is_trading, next_trading, has_night AND is_trading AND tonight AS opens_night FROM d2)"""


ORD = _dates_sql("(SELECT min(CAST(o_orderdate AS DATE)) FROM orders)", "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)")


def _order_dates(spark, sf):
    days = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    span = days.agg(F.min(F.unix_date("date")).alias("lo"), F.max(F.unix_date("date")).alias("hi")).first()
    return days.join(C.date_dim(spark, CALS, span.lo, span.hi), "date")


_OD = f"WITH {ORD}, od AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1)"


@query("prj06_next_trading_date", f"{_OD} SELECT calendar, strftime(date, '%Y-%m-%d') AS day, strftime(next_trading, '%Y-%m-%d') AS next_day, n FROM od JOIN dates USING (date)")
def _(spark, sf):
    return _order_dates(spark, sf).select("calendar", K.day_text(F.col("date")).alias("day"), K.day_text(C.checked_next("next_trading")).alias("next_day"), "n")


@query("prj07_is_trading_date", f"{_OD} SELECT calendar, strftime(date, '%Y-%m-%d') AS day, is_trading FROM od JOIN dates USING (date)")
def _(spark, sf):
    return _order_dates(spark, sf).select("calendar", K.day_text(F.col("date")).alias("day"), "is_trading")


@query("prj08_opens_night", f"{_OD} SELECT calendar, strftime(date, '%Y-%m-%d') AS day, opens_night FROM od JOIN dates USING (date)")
def _(spark, sf):
    return _order_dates(spark, sf).select("calendar", K.day_text(F.col("date")).alias("day"), "opens_night")


_CAL_OF = {"CN.SIM.click": "cn_night_0230", "CN.SIM.view": "cn_night_23", "CRYPTO.SIM.purchase": "cffex_bond", "CRYPTO.SIM.error": "crypto_24x7"}
_CASE = "CASE symbol " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CAL_OF.items()) + " END"
TD = f"""WITH {M1}, {_dates_sql("DATE '2023-12-20'", "DATE '2024-02-10'")},
 x AS (SELECT symbol, close_ts, {_CASE} AS calendar, ((close_ts + 28800) % 86400) // 60 AS mi, CAST(to_timestamp(close_ts + 28800) AT TIME ZONE 'UTC' AS DATE) AS today FROM m1),
 y AS (SELECT x.*, mi <= early_end AS early, cal.calendar IS NOT NULL AS known FROM x LEFT JOIN cal USING (calendar)),
 z AS (SELECT y.*, d.next_trading, d.is_trading, d.opens_night FROM y LEFT JOIN dates d ON d.calendar = y.calendar AND d.date = CASE WHEN early THEN today - 1 ELSE today END),
 f AS (SELECT symbol, close_ts, CASE WHEN NOT known THEN NULL WHEN early OR mi >= 1200 THEN strftime(next_trading, '%Y-%m-%d') ELSE strftime(today, '%Y-%m-%d') END AS trading_day,
  CASE WHEN NOT known THEN TRUE WHEN early THEN opens_night ELSE coalesce((SELECT bool_or(CASE WHEN night THEN opens_night ELSE is_trading END) FROM ses WHERE ses.calendar = z.calendar AND mi BETWEEN s0 AND least(s1, 1440)), FALSE) END AS in_session FROM z)"""


def calendared(spark, sf):
    from tidemark.schema import lookup
    m = minutes(spark, sf).withColumn("calendar", lookup(F.col("symbol"), _CAL_OF))
    return C.with_calendar_day(m, "close_ts", CALS)


@query("prj05_trading_day", f"{TD} SELECT symbol, close_ts, trading_day FROM f")
def _(spark, sf):
    return calendared(spark, sf).select("symbol", "close_ts", "trading_day")


@query("prj09_in_session", f"{TD} SELECT symbol, close_ts, in_session FROM f")
def _(spark, sf):
    return calendared(spark, sf).select("symbol", "close_ts", "in_session")


@query("agg02_trading_day_bars", f"""{TD}, t AS (SELECT m1.*, coalesce(trading_day, {_DAY.replace('close_ts', 'm1.close_ts')}) AS day, trading_day FROM m1 JOIN f USING (symbol, close_ts)),
 g AS (SELECT symbol, day, min(close_ts) AS fc, max(close_ts) AS close_ts, first(open_ts ORDER BY close_ts) AS open_ts, first(open ORDER BY close_ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY close_ts) AS close, sum(volume) AS volume FROM t GROUP BY ALL)
 SELECT symbol, open_ts, close_ts, day, lead(fc) OVER (PARTITION BY symbol ORDER BY day) AS emit_ts, {q6('open')} AS open, {q6('high')} AS high, {q6('low')} AS low, {q6('close')} AS close, {q6('volume')} AS volume FROM g""")
def _(spark, sf):
    """Daily bars by trading day: a night session counts to the next trading date."""
    from tidemark.operators.bars import aggregate_all
    base = stage(calendared(spark, sf).drop("calendar", "in_session"), "calendared")
    out = aggregate_all(base, ["1d"])
    return rounded(out.select("symbol", "open_ts", "close_ts", K.day_text(K.bar_date()).alias("day"), "emit_ts", "open", "high", "low", "close", "volume"))


@query("prj10_session_text", """WITH t AS (SELECT event_type, CAST(ts AS DATE) AS d, strftime(min(ts), '%H:%M') AS a, strftime(max(ts), '%H:%M') AS b FROM events GROUP BY ALL),
 x AS (SELECT event_type, d, a || '-' || b AS session FROM t UNION ALL SELECT event_type, d, b || '-' || a FROM t),
 m AS (SELECT *, CAST(substr(session, 1, 2) AS BIGINT) * 60 + CAST(substr(session, 4, 2) AS BIGINT) AS start_min, CAST(substr(session, 7, 2) AS BIGINT) * 60 + CAST(substr(session, 10, 2) AS BIGINT) AS e FROM x)
 SELECT event_type, session, start_min, CASE WHEN e <= start_min THEN e + 1440 ELSE e END AS end_min FROM m""")
def _(spark, sf):
    hm = lambda c: F.date_format(c, "HH:mm")
    t = table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(hm(F.min("ts")).alias("a"), hm(F.max("ts")).alias("b"))
    x = t.select("event_type", F.explode(F.array(F.concat_ws("-", "a", "b"), F.concat_ws("-", "b", "a"))).alias("session"))
    start, end = C.session_minutes_col(F.col("session"))
    return x.select("event_type", "session", start.alias("start_min"), end.cast("bigint").alias("end_min"))


@query("prj17_calendar_mismatch", f"""WITH {M1}, h AS (SELECT symbol, list(DISTINCT ((close_ts + 28800) % 86400) // 3600) AS hs FROM m1 GROUP BY symbol), c AS (SELECT symbol, hs, {_CASE} AS calendar FROM h),
 i AS (SELECT *, CASE WHEN list_contains(hs, 2) THEN 'cn_night_0230' WHEN list_contains(hs, 0) OR list_contains(hs, 1) THEN 'cn_night_01' WHEN list_has_any(hs, [21, 22, 23]) THEN 'cn_night_23' ELSE 'cn_no_night' END AS inferred FROM c WHERE calendar NOT LIKE 'cffex%')
 SELECT symbol, calendar, inferred, array_to_string(list_sort(list_filter(hs, lambda x: x >= 21 OR x <= 3)), ',') AS night_hours FROM i WHERE inferred <> calendar""")
def _(spark, sf):
    declared = spark.createDataFrame(list(_CAL_OF.items()), "symbol string, calendar string")
    return C.calendar_mismatches(minutes(spark, sf), declared)


# ------------------------------------------------------------------ sinks

_CHANGED = "CASE WHEN close_ts > 1706000000 THEN close + 1 ELSE close END"


@query("snk01_upsert_bars", f"WITH {H1} SELECT symbol, close_ts, {q6(_CHANGED)} AS close FROM s")
def _(spark, sf):
    """Write all bars, then rewrite the late ones with corrected closes; open bars on the same keys change nothing."""
    root = f"{shared_dir(spark)}/tidemark/upsert-{uuid.uuid4().hex}"
    bars = series(spark, sf, "1h").select(*T.STORED)
    T.write_bars(bars, root)
    late = bars.filter("close_ts > 1706000000").withColumn("close", F.col("close") + 1)
    T.write_bars(late.unionByName(late.withColumns({"closed": F.lit(False), "close": F.lit(-1.0)})), root)
    return rounded(T.open_table(spark, root).select("symbol", "close_ts", "close"))


@query("set04_merge_new_wins", f"WITH {H1} SELECT symbol, close_ts, {q6(_CHANGED)} AS close FROM s")
def _(spark, sf):
    bars = series(spark, sf, "1h").select("symbol", "timeframe", "close_ts", "close")
    return rounded(T.merge(bars, bars.filter("close_ts > 1706000000").withColumn("close", F.col("close") + 1)).select("symbol", "close_ts", "close"))


@query("snk02_compaction", f"WITH {STORED} SELECT symbol, timeframe, count(*) AS n, {q6('sum(volume)')} AS volume FROM s GROUP BY ALL")
def _(spark, sf):
    target = f"{shared_dir(spark)}/tidemark/compact-{uuid.uuid4().hex}"
    done = T.compact(spark, store(spark, sf), target)
    return rounded(done.groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")))


@query("set03_multiset_equality", f"WITH {STORED}, t AS (SELECT symbol, timeframe, close_ts FROM s) SELECT count(*) AS rows, TRUE AS same, FALSE AS same_without_last FROM t")
def _(spark, sf):
    a = T.open_table(spark, store(spark, sf)).select(*T.STORED)
    b = series(spark, sf, *STORE_TFS).select(*T.STORED)
    last = b.agg(F.max("close_ts").alias("m"))
    shorter = b.join(F.broadcast(last), F.col("close_ts") < F.col("m"))  # one row
    flags = (T.same_rows(a, b), T.same_rows(a, shorter.select(*T.STORED)))
    return b.agg(F.count(F.lit(1)).alias("rows")).withColumns({"same": F.lit(flags[0]), "same_without_last": F.lit(flags[1])})


@query("snk04_append_fills", f"WITH RECURSIVE {S.FILLS} SELECT signal_key, kind, ts, {q6('price')} AS price FROM fills WHERE ts >= 1705000000")
def _(spark, sf):
    f = S.fills(spark, sf)
    again = f.withColumn("price", F.col("price") + 1)  # the same key once more, with another price
    return rounded(logs.append_fills(again.unionByName(f), f.filter("ts < 1705000000")).select("signal_key", "kind", "ts", "price"))


@query("src13_fill_scan", f"WITH RECURSIVE {S.FILLS} SELECT signal_key, kind, ts, {q6('price')} AS price FROM fills WHERE symbol = 'CN.SIM.click' ORDER BY ts DESC, signal_key DESC, kind DESC LIMIT 30")
def _(spark, sf):
    return rounded(logs.scan_fills(S.fills(spark, sf), "CN.SIM.click", 30).select("signal_key", "kind", "ts", "price"))


@query("src13_log_counts", f"WITH RECURSIVE {S.FILLS} SELECT (SELECT count(*) FROM fills) AS n_fills, (SELECT count(*) FROM sig) AS n_signals")
def _(spark, sf):
    return S.fills(spark, sf).agg(F.count(F.lit(1)).alias("n_fills")).crossJoin(  # one row each
        S.signals(spark, sf).agg(F.count(F.lit(1)).alias("n_signals")))


