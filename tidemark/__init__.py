"""tidemark: multi-timeframe market-signal analytics as Spark DataFrame jobs."""

from tidemark.operators.bars import aggregate, aggregate_all, bar_series, pending
from tidemark.operators.frame import Frame
from tidemark.operators.rules import Condition, Emit, Rule, run_trial

__all__ = [
    "Condition", "Emit", "Frame", "Rule", "aggregate", "aggregate_all", "bar_series", "pending", "run_trial",
]
