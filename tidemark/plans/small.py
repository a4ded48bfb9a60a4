"""Broadcast only behind a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when ``df`` has at most ``max_rows`` rows; otherwise left as it is and the
    join shuffles.  The check reads at most ``max_rows + 1`` rows."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df
