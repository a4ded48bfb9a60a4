"""Queries against their SQL twins on ticks without a gap, a signal or an even end."""

import datetime as dt
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.oracle_tools import TABLES, compare, connect

SMALL = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 14)


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """Two days with a tick of the same price in every minute; one symbol has the minute that closes at midnight, the others end sooner."""
    root = str(tmp_path_factory.mktemp("dense"))
    for t in TABLES:
        if t != "events":
            os.symlink(f"{SMALL}/{t}.parquet", f"{root}/{t}.parquet")
    ticks = [(START + dt.timedelta(minutes=m, seconds=30), kind) for m in range(2 * 1440)
             for kind in ("click", "view", "purchase", "signup", "error") if kind == "error" or m < 2 * 1440 - 30]
    pdf = pd.DataFrame(ticks, columns=["ts", "event_type"]).assign(user_id=1, value=100.0, props="{}")
    pdf.insert(0, "event_id", range(len(pdf)))
    pdf.astype({"ts": "datetime64[us]"}).to_parquet(f"{root}/events.parquet")
    return root


def same(spark, sf, name):
    return compare(spark, connect(sf), sf, name, entry.queries()[name], entry.oracle_sql()[name])


def test_without_outcomes_the_overall_row_has_zeros(spark, dense):
    assert same(spark, dense, "rul11_trial_report") == ("", 1)


def test_freshness_without_gaps(spark, dense):
    assert same(spark, dense, "agg17_freshness") == ("", 5)
    assert same(spark, dense, "agg17_health_totals") == ("", 1)


def test_a_stream_without_signals(spark, dense):
    assert same(spark, dense, "str07_stop_and_resume") == ("", 0)


def test_a_day_is_closed_by_its_own_symbol(spark, dense):
    """A day of 5 symbols, and the next one of the symbol that has a minute closing at midnight."""
    assert same(spark, dense, "str01_windowed_daily_bars") == ("", 6)
