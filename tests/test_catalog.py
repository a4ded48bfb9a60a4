"""Registered queries against their SQL twins at the smallest scale.

TIDEMARK_ALL=1 runs every query; by default one of each family runs."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_tools import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ("agg01_fixed_bars agg02_supplier_weeks_months ind02_ema ind06_macd pat05_swings pat12_double_bottom_top jon01_at_timeframe "
          "rul10_transition_log jon05_outcomes agg05_quality_report agg11_weighted_baseline agg12_horizon_curve agg18_continuous_series "
          "exp05_kleene_logic win08_condition_bands srt05_required_timeframes set03_multiset_equality udf01_registered_functions agg01_bars_beside_open_minutes "
          "win06_latest_by_symbol snk03_append_signals str01_keyed_bars_late_minutes prj22_small_values agg17_health_totals "
          "str04_late_bars str05_gap_requests str08_primed_rules str09_live_signals str10_incremental_lines str01_trading_day_bars str02_pending_periods agg18_anchors_of_two_timeframes src02_tail_scan src05_partition_span src14_backfill_from_coverage "
          "agg04_outcome_summary agg14_rule_evaluation win07_equity_curve srt03_replay_order jon16_watchlist rul13_stock_rule_zone_short "
          "prj09_in_session src07_quote_payload_bars snk01_upsert_bars str01_keyed_bars str07_stop_and_resume jon12_paired_trades").split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = list(QUERIES) if os.environ.get("TIDEMARK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, SF, name, QUERIES[name], ORACLES[name])[0] == ""
    else:
        assert QUERIES[name](spark, SF).columns


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["symbol", "signals", "evaluated", "wins", "avg_return"]
    assert set(ORACLES) <= set(QUERIES)


def test_a_key_of_another_builder_is_refused(spark):
    """Two queries that share a cached table share its builder; a clash is an error, not another query's rows."""
    from tidemark.catalog.data import once

    def one():
        return 1

    def two():
        return 2
    assert once(spark, ("test", "key"), one) == once(spark, ("test", "key"), one) == 1
    with pytest.raises(ValueError):
        once(spark, ("test", "key"), two)
