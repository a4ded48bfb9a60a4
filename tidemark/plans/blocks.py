"""Bounded row frames over series of any length.

A row-numbered series is cut into blocks of ``block_rows``; the last ``back`` rows of a block
are also sent to the next one and the first ``ahead`` rows to the previous one.  Every frame that
looks at most that far is then exact inside its block, so one hot series spreads over many tasks
and the copied rows are back / block_rows of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 65536


def block_window(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "_blk").orderBy("rn")


def to_blocks(df: DataFrame, back: int, ahead: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_blk`` and ``_core`` (FALSE on a copied row)."""
    rows = max(block_rows, back, ahead)
    pos = (F.col("rn") - 1) % F.lit(rows)
    own = F.floor((F.col("rn") - 1) / F.lit(rows)).cast("bigint")

    if not back and not ahead:
        return df.withColumns({"_blk": own, "_core": F.lit(True)})
    late, early = pos >= rows - back, (pos < ahead) & (own > 0)
    # plain CASE over short arrays: most rows go to one block, edge rows to two or three
    blocks = (F.when(late & early, F.array(own, own + 1, own - 1)).when(late, F.array(own, own + 1))
              .when(early, F.array(own, own - 1)).otherwise(F.array(own)))
    spread = df.withColumn("_own", own).withColumn("_blk", F.explode(blocks))
    return spread.withColumn("_core", F.col("_blk") == F.col("_own")).drop("_own")


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_blk", "_core")
