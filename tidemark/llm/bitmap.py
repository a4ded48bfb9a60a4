"""A broadcast of fixed size that tells which rows surely aren't among a set of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITMAP_WORDS = 1 << 17


def likely(docs: DataFrame, keys: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose doc_id may be (``keep``) or surely isn't among ``keys``, told by a bitmap of at most
    ``BITMAP_WORDS`` rows that is broadcast, so that most texts needn't be shuffled.  A full bitmap
    only costs time: an exact join follows.  A null doc_id is among no keys."""
    bit = F.xxhash64(F.col("doc_id").cast("long"))
    word, mask = F.pmod(bit, F.lit(BITMAP_WORDS)), F.expr("shiftleft(1L, CAST(pmod(shiftright(xxhash64(CAST(doc_id AS BIGINT)), 32), 64) AS INT))")
    bitmap = keys.filter("doc_id IS NOT NULL").select(word.alias("__w"), mask.alias("__m")).groupBy("__w").agg(F.bit_or("__m").alias("__m"))
    found = F.col("doc_id").isNotNull() & (word == F.col("__w")) & (mask.bitwiseAND(F.col("__m")) != 0)
    return docs.join(F.broadcast(bitmap), found, "left_semi" if keep else "left_anti")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` (doc_id, copy) names; copy is the hash of the text."""
    own = F.hash(F.coalesce("text", F.lit("")))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).distinct()
    named = gone.select(F.col("__id").alias("doc_id"))
    touched = likely(docs, named).join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("__id")) & (own == F.col("__copy")), "left_anti")
    return touched.unionByName(likely(docs, named, keep=False))
