"""URL filter: block and allow rules, and for the rest naive Bayes over segmented names.

Hosts such as ``cheapshoesonline.example.org`` run words together.  A unigram model of words, counted
by Spark over the visible words of all pages, segments each host label by Viterbi: labels of equal
length advance together, a word costs its negative log share, an unknown stretch more with every
letter.  Segments and path tokens are the features of a multinomial naive Bayes model.

The model is trained here, on every url: one whose segmented host holds a word of ``SEEDS`` counts as
blocked, the others as allowed.  It then judges by all words that go with such hosts, not by the seeds
alone.  Word table and model hold every word and feature, however rare, and stay distributed: the substrings
of the distinct host labels are joined with the word counts, so a task gets just the entries that its labels
need, and the urls' features are joined with the model.  Urls with a rule get the rule's verdict, the others
the model's.

Defined results: null urls and urls without ``://`` have empty host and path and match no rule, so the
model's prior decides; rows that repeat are judged each; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

LONGEST = 24
#: Words of hosts that trade in adverts, wagers, drugs, loans and spam.
SEEDS = ("ads adserver banner bet bets betting casino cheap clickbait doubleclick escort free gambling jackpot "
         "loan loans lottery payday pharma pills poker porn promo replica sex slots spam track tracker tracking "
         "viagra warez winner xxx").split()
UNKNOWN = 4.0
SMOOTH = 1.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    there = F.instr(url, "://") > 0
    after = F.when(there, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits: its host is the url's or a parent of it, its path begins the url's."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def segments(labels: list[str], words: dict[str, float], floor: float | None = None) -> list[list[str]]:
    """Most probable words of each label; ``words`` maps a word to its log share, ``floor`` is the least share of all."""
    out: list[list[str]] = [[] for _ in labels]
    floor = min(words.values(), default=0.0) if floor is None else floor
    by_length: dict[int, list[int]] = {}
    for i, x in enumerate(labels):
        by_length.setdefault(len(x), []).append(i)
    for size, own in by_length.items():
        best = np.full((size + 1, len(own)), -np.inf)
        best[0] = 0
        back = np.zeros((size + 1, len(own)), np.int64)
        for end in range(1, size + 1):
            for start in range(max(0, end - LONGEST), end):
                step = np.array([words.get(labels[i][start:end], floor - UNKNOWN * (end - start)) for i in own])
                now = best[start] + step
                better = now > best[end]
                best[end][better], back[end][better] = now[better], start
        for j, i in enumerate(own):
            end, cuts = size, []
            while end:
                cuts.append(labels[i][back[end][j] : end])
                end = back[end][j]
            out[i] = cuts[::-1]
    return out


def path_tokens(path: str) -> list[str]:
    return ["/" + t for t in re.split(r"[^a-z0-9]+", re.sub(r"[0-9]+", "0", path.lower())) if t]


def host_labels(host: str) -> list[str]:
    return [x for x in re.split(r"[^\w]+|_", host) if x]


def word_counts(html: DataFrame) -> tuple[DataFrame, int, int]:
    """Counts of the visible words of all pages (w, n), their sum and their least; the seeds count as often as the
    commonest word in a thousand, so that they are words wherever they stand."""
    visible = F.regexp_replace(F.lower(F.coalesce("html", F.lit(""))), r"(?s)<(script|style)\b.*?</\1|<[^>]*>|&#?\w+;?", " ")
    words = html.select(F.explode(F.split(visible, r"[^\p{L}]+")).alias("w")).filter(f"length(w) BETWEEN 2 AND {LONGEST}")
    seen = stage(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    usual = max(1, (seen.agg(F.sum("n").alias("n")).first().n or 0) // 1000)
    seeds = html.sparkSession.createDataFrame([(w, usual) for w in SEEDS], "w string, n long")
    count = seen.union(seeds.join(seen.select("w"), "w", "left_anti")).withColumn("n", F.when(F.col("w").isin(*SEEDS), F.greatest("n", F.lit(usual))).otherwise(F.col("n")))
    whole = count.agg(F.sum("n").alias("n"), F.min("n").alias("least")).first()
    return count, whole.n, whole.least


def _labelled(batches):
    for batch in batches:
        rows = [(h, i, x) for h in batch.column("host").to_pylist() for i, x in enumerate(host_labels(h))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["host", "at", "label"])


def _substrings(batches):
    for batch in batches:
        for x in batch.column("label").to_pylist():
            own = sorted({x[i:j] for i in range(len(x)) for j in range(i + 2, min(len(x), i + LONGEST) + 1)})
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(own), pa.string()), pa.array(own, pa.string())], names=["label", "w"])


def _segmented(total, least):
    floor = float(np.log(least / total))

    def run(batches):
        for batch in batches:
            labels = batch.column("label").to_pylist()
            # a label's entries are all its substrings that are words, so the entries of a batch serve each of its labels
            words = {e["w"]: float(np.log(e["n"] / total)) for own in batch.column("known").to_pylist() for e in own or ()}
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(segments(labels, words, floor), pa.list_(pa.string()))], names=["label", "words"])
    return run


def host_words(hosts: DataFrame, html: DataFrame) -> DataFrame:
    """(host, words) of the distinct ``hosts`` (host) that have a label: the words of their labels in order."""
    count, total, least = word_counts(html)
    labelled = stage(hosts.distinct().mapInArrow(_labelled, "host string, at int, label string"), "labels")
    labels = labelled.select("label").distinct()
    known = (labels.mapInArrow(_substrings, "label string, w string").join(count, "w").groupBy("label")
             .agg(F.collect_list(F.struct("w", "n")).alias("known")))
    split = labels.join(known, "label", "left").mapInArrow(_segmented(total, least), "label string, words array<string>")
    return (labelled.join(split, "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("own"))
            .select("host", F.flatten("own.words").alias("words")))


def _pathed(batches):
    """Features of urls: the words of their host, and path tokens marked by a slash."""
    for batch in batches:
        found = [(w or []) + path_tokens(p) for w, p in zip(batch.column("words").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "page_id", "host", "path")), pa.array(found, pa.list_(pa.string()))],
                                         names=["id", "page_id", "host", "path", "features"])


def naive_bayes(rows: DataFrame) -> tuple[DataFrame, float]:
    """Log odds for blocking of each feature (f, odds), and the prior's, from rows (features, seeded)."""
    by = rows.groupBy().agg(F.sum(F.col("seeded").cast("long")).alias("bad"), F.count("*").alias("n")).first()
    bad, good = by.bad or 0, by.n - (by.bad or 0)
    one = F.col("seeded").cast("long")
    counts = stage(rows.select(F.explode("features").alias("f"), "seeded").groupBy("f").agg(F.sum(one).alias("b"), F.sum(1 - one).alias("g")), "counts")
    whole = counts.agg(F.sum("b").alias("b"), F.sum("g").alias("g"), F.count("*").alias("n")).first()
    sums = [float((x or 0) + SMOOTH * max(whole.n, 1)) for x in (whole.b, whole.g)]
    odds = F.log((F.col("b") + SMOOTH) / sums[0]) - F.log((F.col("g") + SMOOTH) / sums[1])
    return counts.select("f", odds.alias("odds")), float(np.log(bad + SMOOTH) - np.log(good + SMOOTH))


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, block_score and host words."""
    host, path = split_url(F.col("url"))
    split = stage(pages.select(F.monotonically_increasing_id().alias("id"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")), "split")
    named = split.join(host_words(split.select("host"), pages.select("html")), "host", "left").select("id", "page_id", "host", "path", "words")
    rows = stage(named.mapInArrow(_pathed, "id long, page_id long, host string, path string, features array<string>")
                 .withColumn("seeded", F.arrays_overlap("features", F.array(*map(F.lit, SEEDS)))), "urls")
    odds, prior = naive_bayes(rows)
    # sorted, so that equal urls get equal scores to the last bit
    own = F.aggregate(F.array_sort(F.collect_list("odds")), F.lit(0.0), lambda a, x: a + x)
    sums = rows.select("id", F.explode("features").alias("f")).join(odds, "f").groupBy("id").agg(own.alias("sum"))
    scored = rows.join(sums, "id", "left").withColumn("block_score", F.lit(prior) + F.coalesce("sum", F.lit(0.0)))
    fit = best_rule(F.col("host"), F.col("path"), rules)
    return scored.withColumn("fit", fit).select(
        "page_id", "host", "path", F.col("fit.text").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("block_score") > 0, "block").otherwise("allow")).alias("verdict"), "block_score", "features")
