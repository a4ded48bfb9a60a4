"""Signal and fill logs: scans, pages, idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tidemark.plans.staging import stage

SIGNAL_KEY = ["rule_id", "symbol", "dedup_key"]
FILL_KEY = ["signal_key", "kind", "ts"]


def scan_signals(
    signals: DataFrame, rule_id: str | None = None, symbol: str | None = None,
    since: int | None = None, until: int | None = None,
) -> DataFrame:
    """Signals of a rule and symbol in the closed interval on ``fired_at``."""
    df = signals
    if rule_id:
        df = df.filter(F.col("rule_id") == rule_id)
    if symbol:
        df = df.filter(F.col("symbol") == symbol)
    if since is not None:
        df = df.filter(F.col("fired_at") >= since)
    if until is not None:
        df = df.filter(F.col("fired_at") <= until)
    return df


def in_order(signals: DataFrame) -> DataFrame:
    return signals.orderBy("fired_at", "rule_id", "symbol")


def page(signals: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """One page counted from the newest, returned ascending (a top-n, not a full sort)."""
    order = ["fired_at", "rule_id", "symbol", "dedup_key"]
    newest = signals.orderBy(*[F.desc(c) for c in order]).offset(offset).limit(limit)
    return newest.orderBy(*order)


def page_info(signals: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    total = F.count(F.lit(1))
    return signals.agg(total.alias("total"), F.min("fired_at").alias("first_at"), F.max("fired_at").alias("last_at"),
                       (total > limit + offset).alias("has_older"))


def scan_fills(fills: DataFrame, symbol: str | None = None, limit: int = 500) -> DataFrame:
    """The last ``limit`` fills, ascending."""
    df = fills.filter(F.col("symbol") == symbol) if symbol else fills
    order = ["ts", "signal_key", "kind"]
    return df.orderBy(*[F.desc(c) for c in order]).limit(limit).orderBy(*order)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, then by its other values: a partially aggregated arg-min."""
    rest = [c for c in rows.columns if c not in keys]
    sortable = [c for c in rest if c not in order and not isinstance(rows.schema[c].dataType, MapType)]
    if not rest:
        return rows.distinct()
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *sortable)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-ignore: of the incoming rows whose key is not stored yet, the first per key."""
    return first_per_key(incoming, keys, order).join(existing.select(*keys), keys, "left_anti")


def append_signals(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return new_rows(incoming, existing, SIGNAL_KEY, ["fired_at"])


def append_fills(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return new_rows(incoming, existing, FILL_KEY, ["ts"])


BUCKETS = 64


def table_sink(root: str, keys: list[str], order: tuple[str, ...] = (), ts: str | None = None):
    """``foreachBatch`` writer: appends only unseen keys, so a replayed batch changes nothing.

    The log lies in folders of key bucket and day (of ``ts``).  A batch reads the key columns of the buckets
    that its own keys fall into and no others; a key that returns on another day is in the same bucket, so it is refused."""
    def write(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        at = ts or next((c for c in ("fired_at", "ts", "close_ts") if c in batch.columns), None)
        fresh = first_per_key(batch, keys, [c for c in order or ("fired_at", "ts") if c in batch.columns])
        fresh = stage(fresh.withColumns({
            "bucket": F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"),
            "day": F.date_format(F.timestamp_seconds(F.col(at)), "yyyy-MM-dd") if at else F.lit("all")}), "log")
        try:
            stored = spark.read.schema(fresh.schema).parquet(root)
        except Exception as e:  # first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = None
        if stored is not None:
            met = [r.bucket for r in fresh.select("bucket").distinct().collect()]
            fresh = fresh.join(seen_keys(stored, keys, met), ["bucket", *keys], "left_anti").select(*fresh.columns)
        fresh.write.mode("append").partitionBy("bucket", "day").parquet(root)
    return write


def seen_keys(stored: DataFrame, keys: list[str], buckets: list[int]) -> DataFrame:
    return stored.filter(F.col("bucket").isin(buckets)).select("bucket", *keys)
