"""The registered queries of this subpackage: whole tables in, digests of the operators' results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import oracles
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.html_extract import extract_pages
from tidemark.llm.license_scan import scan_licences
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.pii_surrogates import replace_entities
from tidemark.llm.quality_classifier import score_quality
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.sentencepiece import encode_texts
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.llm.token_alignment import align_tokens
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.url_filter import Rule, judge_urls
from tidemark.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_substring_dedup", oracles.SUBSTRING_DEDUP)
def substring_dedup(spark, sf):
    return remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_minhash_dedup", oracles.MINHASH_DEDUP)
def minhash_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), shingle=4).drop("copy")


@query("op2_quality_classifier")
def quality_classifier(spark, sf):
    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_quality_rules")
def quality_rules_(spark, sf):
    return quality_rules(table(spark, sf, "documents"))


@query("op7_decontamination")
def decontamination(spark, sf):
    return decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


URL_RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


@query("op4_url_filter")
def url_filter(spark, sf):
    return judge_urls(table(spark, sf, "pages"), URL_RULES).drop("features")


@query("op5_html_extraction")
def html_extraction(spark, sf):
    return extract_pages(table(spark, sf, "pages"))


@query("op3_pii_surrogates")
def pii_surrogates(spark, sf):
    return replace_entities(table(spark, sf, "documents").select("doc_id", "text"))


@query("op8_sentencepiece")
def sentencepiece_encoding(spark, sf):
    return encode_texts(table(spark, sf, "documents"), with_ids=False)


@query("op10_license_scan")
def license_scan(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return scan_licences(docs.select("doc_id", path.alias("path"), "text"))


@query("op11_token_alignment")
def token_alignment(spark, sf):
    return align_tokens(table(spark, sf, "documents"))


@query("op12_whitening")
def whitening(spark, sf):
    return whiten(table(spark, sf, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query("op13_token_counts")
def token_counts(spark, sf):
    return count_tokens(table(spark, sf, "documents"))
