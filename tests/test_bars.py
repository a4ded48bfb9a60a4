"""Derived bars, both clocks, calendars."""

import datetime as dt

from pyspark.sql import functions as F

from tests.helpers import minute_bars
from tidemark.functions import calendar as C
from tidemark.functions import timekeys as K
from tidemark.operators.bars import aggregate, aggregate_all, flush, index_bars, pending
from tidemark.sources import bar_table as T


def ts(text: str, offset: int = 0) -> int:
    return int(dt.datetime.fromisoformat(text + "+00:00").timestamp()) - offset


CST = 8 * 3600


def test_bucket_is_right_closed_and_known_late(spark):
    # 11:29, 11:30 in the 12:00 hour bar; the next minute comes after lunch
    rows = [(ts(f"2024-01-03 {h}"), 1, 2, 0.5, 1.5, 10) for h in ("10:59", "11:00", "11:29", "11:30", "13:31")]
    out = {r.close_ts: r for r in aggregate(minute_bars(spark, rows), ["1h"]).collect()}
    assert set(out) == {ts("2024-01-03 11:00"), ts("2024-01-03 12:00")}
    assert out[ts("2024-01-03 11:00")].emit_ts == ts("2024-01-03 11:00")
    assert out[ts("2024-01-03 12:00")].emit_ts == ts("2024-01-03 13:31")
    assert out[ts("2024-01-03 12:00")].volume == 20
    last = pending(minute_bars(spark, rows), ["1h"]).collect()
    assert [r.close_ts for r in last] == [ts("2024-01-03 14:00")] and last[0].emit_ts is None
    assert flush(aggregate_all(minute_bars(spark, rows), ["1h"])).filter("closed").count() == 3


def test_night_and_day_session_make_one_daily_bar(spark):
    rows = [(ts("2024-01-02 21:01", CST), 100, 102, 99, 101, 8, "2024-01-03"), (ts("2024-01-02 22:59", CST), 101, 103, 100, 102, 8, "2024-01-03"),
            (ts("2024-01-03 09:01", CST), 102, 109, 101, 104, 8, "2024-01-03"), (ts("2024-01-03 10:00", CST), 104, 106, 103, 105, 8, "2024-01-03"),
            (ts("2024-01-03 15:00", CST), 105, 107, 104, 106, 8, "2024-01-03"), (ts("2024-01-03 21:01", CST), 1, 1, 1, 1, 1, "2024-01-04")]
    day = aggregate(minute_bars(spark, rows), ["1d"]).collect()
    assert len(day) == 1
    r = day[0]
    assert (r.open, r.high, r.low, r.close, r.volume) == (100, 109, 99, 106, 40)
    assert r.open_ts == ts("2024-01-02 21:00", CST) and r.trading_day == "2024-01-03"
    assert r.emit_ts == ts("2024-01-03 21:01", CST)


def test_midnight_minute_belongs_to_the_next_utc_day(spark):
    rows = [(ts("2024-01-01 23:59"), 1, 1, 1, 1, 1), (ts("2024-01-02 00:00"), 2, 2, 2, 2, 1), (ts("2024-01-03 00:01"), 3, 3, 3, 3, 1)]
    out = sorted((r.close_ts, r.close) for r in aggregate(minute_bars(spark, rows), ["1d"]).collect())
    assert out == [(ts("2024-01-01 23:59"), 1.0), (ts("2024-01-02 00:00"), 2.0)]


def test_iso_week_across_new_year(spark):
    d = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2025, 1, 1),), (dt.date(2023, 1, 1),)], "d date")
    keys = [r[0] for r in d.select(K.period_key("1w", F.col("d"))).collect()]
    assert keys == ["2025-W01", "2025-W01", "2022-W52"]


def test_small_chunks_give_the_same_index(spark):
    rows = [(ts("2024-01-03 00:00") + 60 * i * (1 + i % 3), i, i + 1, i - 1, i + 0.5, 1) for i in range(1, 90)]
    rows = sorted({r[0]: r for r in rows}.values())
    base = minute_bars(spark, rows)
    a, b = (index_bars(aggregate(base, ["5m", "1h", "1d"], chunk_rows=n), chunk_rows=n) for n in (2, 10_000))
    assert T.same_rows(a, b)
    assert a.filter("timeframe = '5m'").agg(F.max("rn"), F.count("rn")).first()[0] == a.filter("timeframe = '5m'").count()


HOL = frozenset({"2026-10-01", "2026-10-02"})
CALS = {"n": C.Calendar("n", ("09:00-10:15", "10:30-11:30", "13:30-15:00", "21:00-02:30"), HOL), "x": C.Calendar("x", ("00:00-24:00",), frozenset(), True)}


def _day(spark, *stamps):
    df = spark.createDataFrame([("n", ts(s, CST)) for s in stamps], "calendar string, t bigint")
    out = C.with_calendar_day(df, "t", CALS, first_day=20_000, last_day=21_000)
    got = {r.t: r for r in out.collect()}
    return [got[ts(s, CST)] for s in stamps]


def test_friday_night_is_one_trading_day(spark):
    a, b = _day(spark, "2026-09-04 23:59", "2026-09-05 02:30")
    assert a.trading_day == b.trading_day == "2026-09-07"
    assert a.in_session and b.in_session


def test_no_night_session_before_a_holiday(spark):
    eve, small_hours, weekend, holiday, lunch = _day(spark, "2026-09-30 22:00", "2026-10-01 01:00", "2026-09-05 10:00", "2026-10-01 10:00", "2026-09-04 12:00")
    assert not eve.in_session and not small_hours.in_session
    assert eve.trading_day == small_hours.trading_day == "2026-10-05"
    assert not weekend.in_session and not holiday.in_session and not lunch.in_session


def test_session_text():
    assert C.session_minutes("21:00-02:30") == (1260, 1590)
    assert C.session_minutes("09:00-10:15") == (540, 615)


def test_upsert_is_idempotent_and_later_wins(spark, tmp_path):
    root = str(tmp_path / "bars")
    rows = [(ts("2024-01-03 00:00") + 60 * i, i, i + 1, i - 1, i, 1) for i in range(1, 50)]
    base = minute_bars(spark, rows, symbol="CN.A.x")
    T.write_bars(base, root)
    T.write_bars(base, root)
    T.write_bars(base.filter(F.col("close_ts") % 120 == 0).withColumn("close", F.lit(-1.0)), root)
    got = T.open_table(spark, root)
    assert got.count() == 49
    assert got.filter("close = -1").count() == sum(1 for r in rows if r[0] % 120 == 0)
    plan = T.read_range(got, "CN.A.x", "1m", rows[3][0], rows[9][0])
    assert [r.close_ts for r in plan.orderBy("close_ts").collect()] == [r[0] for r in rows[4:10]]
    assert "PartitionFilters: [isnotnull" in plan._jdf.queryExecution().toString()


def test_quarantine(spark):
    bars = minute_bars(spark, [(600, 1, 2, 0, 1, 1), (660, 1, 0, 2, 1, 1)])
    ok, bad = T.split_valid(bars)
    assert ok.count() == 1 and [r.problem for r in bad.collect()] == ["low_above_high"]


def test_open_bars_never_displace_closed_ones(spark, tmp_path):
    row = ("A.B.c", "1m", 0, 60, 1.0, 2.0, 0.5, 1.5, 10.0, 15.0, 0.0, None, True, 60)
    base = spark.createDataFrame([row], T.BAR_SCHEMA)
    root = str(tmp_path / "bars")
    T.write_bars(base, root)
    T.write_bars(base.withColumn("closed", F.lit(False)).withColumn("close", F.lit(-1.0)), root)
    two = base.withColumns({"close": F.lit(1.6), "n": F.lit(1)}).unionByName(base.withColumns({"close": F.lit(1.4), "n": F.lit(2)}))
    assert [r.close for r in T.open_table(spark, root).collect()] == [1.5]
    T.write_bars(two, root, arrival="n")
    assert [r.close for r in T.open_table(spark, root).collect()] == [1.4]


def test_calendar_fails_beyond_what_it_knows(spark):
    import pytest

    month = frozenset(f"2024-01-{d:02d}" for d in range(2, 32)) | frozenset(f"2024-02-{d:02d}" for d in range(1, 10))
    shut = {"x": C.Calendar("x", ("09:00-15:00", "21:00-23:00"), month)}
    df = spark.createDataFrame([("x", 1704114000)], "calendar string, t long")  # 2024-01-01 21:00 local, then 30 days shut
    with pytest.raises(Exception, match="no trading date within"):
        C.with_calendar_day(df, "t", shut).collect()
    with pytest.raises(Exception, match="outside the calendar"):
        C.with_calendar_day(df, "t", shut, first_day=0, last_day=10).select("in_session").collect()
    far = spark.createDataFrame([("x", 4102444800 + 7200), (None, 0)], "calendar string, t long")  # 2100-01-01, a Friday
    assert [r.trading_day for r in C.with_calendar_day(far, "t", shut).orderBy("t").collect()] == [None, "2100-01-01"]


def test_candles_of_no_fixed_length_are_refused(spark):
    import pytest

    from tidemark.sources import payloads

    df = spark.createDataFrame([("s", "1w", '{"code":"0","msg":"","data":[["0","1","1","1","1","1","1","1","1"]]}')], "symbol string, timeframe string, payload string")
    with pytest.raises(Exception, match="no fixed length"):
        payloads.candle_bars(df).collect()


def test_coverage_names_the_parts_of_a_tail(spark, tmp_path):
    """Last bars of a series that stands in few parts; a later upsert changes only its own months; the plan opens one part."""
    root = str(tmp_path / "t")
    day = 86400

    def at(days, symbol):
        return minute_bars(spark, [(1704067200 + d * day + k * 60, 1.0, 2.0, 0.5, 1.0 + d, 1.0) for d in days for k in range(1, 6)], symbol)
    T.write_bars(at(range(0, 60), "T.A").unionByName(at([3, 4], "T.B")), root)
    T.write_bars(at([45, 61], "T.A"), root)
    few = T.tail_of(spark, root, "T.A", "1m", 3)
    assert [r.close_ts for r in few.orderBy("close_ts").collect()] == [1704067200 + 61 * day + k * 60 for k in (3, 4, 5)]
    few.collect()
    scan = few._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numFiles").get().value() == 1 and len(few.inputFiles()) > 60
    assert T.tail_of(spark, root, "T.B", "1m", 7).agg(F.min("close_ts")).first()[0] == 1704067200 + 3 * day + 4 * 60
    assert T.tail_of(spark, root, "T.C", "1m", 3).collect() == []
    spans = {r.symbol: tuple(r)[2:] for r in T.covered_spans(T.open_coverage(spark, root)).collect()}
    assert spans["T.A"] == ("2024-01-01", "2024-03-02", 1704067260, 1704067200 + 61 * day + 300, 305) and spans["T.B"][-1] == 10
    kept = sorted(map(str, T.open_coverage(spark, root).select("symbol", "part", "rows").collect()))
    T.rebuild_coverage(spark, root)
    assert kept == sorted(map(str, T.open_coverage(spark, root).select("symbol", "part", "rows").collect()))


def test_sink_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    """A key that returns days later is refused; the scan of stored keys names the buckets of the batch."""
    from tidemark.sources import logs

    root, keys = str(tmp_path / "log"), ["rule_id", "symbol", "dedup_key"]
    write = logs.table_sink(root, keys)

    def batch(rows):
        return spark.createDataFrame(rows, "rule_id string, symbol string, dedup_key string, fired_at bigint")
    write(batch([("r", "s", f"k{i}", 1704067200 + i) for i in range(200)]), 0)
    write(batch([("r", "s", "k7", 1704067200 + 40 * 86400), ("r", "s", "new", 1704067200 + 40 * 86400), ("r", "s", "new", 1704067201)]), 1)
    stored = spark.read.parquet(root)
    assert stored.count() == 201 and stored.filter("dedup_key = 'k7'").first().fired_at == 1704067207
    assert stored.filter("dedup_key = 'new'").first().fired_at == 1704067201
    write(batch([("r", "s", f"k{i}", 1704067200 + i) for i in range(200)]), 0)
    assert spark.read.parquet(root).count() == 201
    plan = logs.seen_keys(stored, keys, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "fired_at" not in plan.split("ReadSchema")[1]
