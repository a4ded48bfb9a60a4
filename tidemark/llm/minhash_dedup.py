"""Near-duplicate groups by SuperMinHash, banding, exact verification and components.

A document's set holds its distinct shingles of ``shingle`` words, A-Z lower-cased; a shorter text is
one shingle.  SuperMinHash gives each element a random permutation of the signature's places and
writes ``j + uniform`` to its j-th place, so that one element's ranks differ between places, which
lowers the variance against independent hashes.  Round j can only matter while a place holds more than
j, so long texts stop after one round.  Signatures of 128 places form 32 bands of 4; at similarity
0.8 a pair misses all of them with probability below 1e-7.

Equal sets are one class, represented by the least doc_id, before banding.  In a band's bucket the
members are compared with a leader, not with each other; the first leader is the most central member.
A second leader serves buckets that still hold several components.  Across the components that are
left, pairs meet by their rarest shingles (prefix and position filter, exact) instead of by bucket.
So no link between classes is lost, and none is needed inside a component.  Links are
confirmed on the full sets (64-bit shingle fingerprints).

Defined results: null or empty text has an empty set and is linked with nothing; a null doc_id is
linked with nothing and kept, with a null component; rows that repeat a doc_id are judged each by its
own text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.bitmap import likely, without
from tidemark.llm.components import components
from tidemark.llm.textops import U64, Words, between, map_slices, mix, prefix, signed, text_buffers
from tidemark.plans.staging import stage

SHINGLE = 5
PERCENT = 80
PLACES = 128
BAND = 4
LEADER_ROUNDS = 2


def shingle_sets(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of a slice, and the row of each, ordered by row."""
    w = Words(*text_buffers(text))
    sums = prefix(w.hashes(0, lower=True), 1)
    at = np.arange(len(w.row))
    end = w.first[1:][w.row]
    short = (w.count < shingle)[w.row]
    start = at[np.where(short, at == w.first[w.row], at + shingle <= end)]
    stop = np.where(short[start], end[start], start + shingle)
    item, row = between(sums, start, stop, 1), w.row[start]
    _, at = np.unique(mix(item + mix(row.astype(U64))), return_index=True)
    at = at[np.lexsort((item[at], row[at]))]
    return item[at], row[at]


def super_minhash(item: np.ndarray, row: np.ndarray, rows: int, places: int = PLACES) -> np.ndarray:
    """Signatures (rows x places) of the sets; inf where a row has no items."""
    sig = np.full((rows, places), np.inf)
    flat, perm = sig.reshape(-1), None
    for j in range(places):
        draw = mix(item + U64((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        value = (draw >> U64(11)).astype(float) * 2.0**-53 + j
        k = j + (mix(draw) % U64(places - j)).astype(np.int64)
        if j == 0:
            place, earlier = k, k
        else:
            if perm is None:  # Fisher-Yates, resumed after the first round's swap
                perm = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(item), 1))
                every = np.arange(len(item))
                perm[every, earlier] = 0
                perm[:, 0] = earlier
            every = np.arange(len(item))
            place = perm[every, k].astype(np.int64)
            perm[every, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(flat, row * places + place, value)
        open_rows = sig.max(axis=1) > j + 1
        on = open_rows[row]
        if not on.any():
            break
        item, row = item[on], row[on]
        if perm is not None:
            perm = perm[on]
        else:
            earlier = earlier[on]
    return sig


def band_keys(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    parts = mix(sig.view(U64)).reshape(len(sig), -1, band)
    key = np.arange(parts.shape[1], dtype=U64)[None, :] * U64(0xD1342543DE82EF95)
    for j in range(band):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def profile(batch: pa.RecordBatch, shingle: int) -> pa.RecordBatch:
    item, row = shingle_sets(batch.column("text"), shingle)
    n = batch.num_rows
    size = np.bincount(row, minlength=n).astype(np.int64)
    one, two = np.zeros(n, U64), np.zeros(n, U64)
    np.add.at(one, row, mix(item))
    np.add.at(two, row, mix(item ^ U64(0x2545F4914F6CDD1D)))
    keys = band_keys(super_minhash(item, row, n))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(signed(keys.reshape(-1))))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(size), pa.array(signed(one)), pa.array(signed(two)), lists],
                                      names=["doc_id", "copy", "n_shingles", "one", "two", "bands"])


def packed_sets(batch: pa.RecordBatch, shingle: int) -> pa.RecordBatch:
    item, row = shingle_sets(batch.column("text"), shingle)
    edge = np.searchsorted(row, np.arange(batch.num_rows + 1)) * 8
    raw = item.tobytes()
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())],
                                      names=["doc_id", "items"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(a.as_py(), U64), np.frombuffer(b.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))
    return run


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) of doc_ids whose full sets are similar enough."""
    needed = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    texts = docs.join(needed.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = stage(map_slices(texts, "text", lambda b: packed_sets(b, shingle), "doc_id long, items binary"), "sets")
    one = pairs.join(sets.select(F.col("doc_id").alias("v"), F.col("items").alias("right")), "v")
    two = one.join(sets.select(F.col("doc_id").alias("u"), F.col("items").alias("left")), "u")
    return stage(two.mapInArrow(_confirm(percent), "u long, v long").distinct(), "links")


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set, with the least doc_id and the bands; copies merge before the shuffle."""
    return rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("one", "two", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))


def _sizes_allow(percent: int):
    return F.expr(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")


def _tokens(batch: pa.RecordBatch, shingle: int) -> pa.RecordBatch:
    item, row = shingle_sets(batch.column("text"), shingle)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(signed(item))], names=["doc_id", "token"])


def remaining_pairs(members: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (doc_id, n, c) of different components that may be similar enough.

    Ordered by rarity, two such sets share a shingle among their first n - ceil(t n) + 1; and the first
    one they share leaves room for enough others behind it on both sides.  Both are exact conditions.
    """
    tokens = stage(map_slices(docs.join(members.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi"), "text",
                              lambda b: _tokens(b, shingle), "doc_id long, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("df", "token"))
    lead = (tokens.join(often, "token").withColumn("i", place).join(members, "doc_id")
            .filter(f"df > 1 AND i <= n - ceil({percent} * n / 100) + 1"))
    lead = stage(lead.select("token", "doc_id", "c", "n", (F.col("n") - F.col("i") + 1).alias("left")), "prefixes")
    x = lead.select("token", F.col("doc_id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("nu"), F.col("left").alias("la"))
    y = lead.select("token", F.col("doc_id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nv"), F.col("left").alias("lb"))
    room = f"a < b AND ca <> cb AND 100 * least(la, lb) >= {percent} * (nu + nv - least(la, lb))"
    return x.join(y, "token").filter(room).select("a", "b")


def _labelled(members: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return members.withColumn("c", F.col("doc_id"))
    return (members.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .withColumn("c", F.coalesce("component", "doc_id")).drop("component"))


def _mixed(members: DataFrame, leader) -> DataFrame:
    """Buckets that hold several components, each with a leader."""
    return members.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"),
                                       F.max_by(F.struct("doc_id", "n", "c"), leader).alias("lead")).filter("c0 < c1").select("band", "lead")


def class_links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the class representatives that have a link."""
    members = stage(classes.select(F.explode("bands").alias("band"), F.col("rep").alias("doc_id"), F.col("n_shingles").alias("n")), "members")
    several = members.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1")
    open_ = stage(members.join(several, "band"), "open")
    # a document that shares large buckets in many bands is near the middle of its group: it leads first
    weight = open_.groupBy("doc_id").agg(F.sum("k").alias("w"))
    open_ = stage(open_.drop("k").join(weight, "doc_id"), "open")
    links = tested = label = None

    def confirmed(met: DataFrame):
        nonlocal links, tested, label
        pairs = met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = stage(pairs, "pairs")
        fresh = verified(pairs, docs, shingle, percent)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = fresh if links is None else links.unionByName(fresh)
        label = components(links)

    for turn in range(LEADER_ROUNDS):
        now = _labelled(open_, label)
        lead = _mixed(now, F.struct("w", -F.col("doc_id")) if turn == 0 else F.xxhash64("doc_id", F.lit(turn)))
        confirmed(now.join(lead, "band").filter("c <> lead.c").select(
            F.col("lead.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("lead.n").alias("nu"), F.col("n").alias("nv")).filter(_sizes_allow(percent)))
    # the rest, exactly: what could still link across components
    now = _labelled(open_, label)
    now = now.join(_mixed(now, F.col("doc_id")).select("band"), "band", "left_semi").select("doc_id", "n", "c").distinct()
    confirmed(remaining_pairs(stage(now, "rest"), docs, shingle, percent))
    return label


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, copy (hash of the text), n_shingles, component_id (least doc_id
    reachable) and kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", F.hash("text"))
    rows = stage(map_slices(texts, "text", lambda b: profile(b, shingle),
                            "doc_id long, copy int, n_shingles long, one long, two long, bands array<long>"), "profiles")
    classes = stage(_classes(rows), "classes")
    label = class_links(texts, classes, shingle, percent)
    group = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
        "one", "two", F.coalesce("component", "rep").alias("group"))
    whole = rows.select("doc_id", "copy", "n_shingles", "one", "two").join(group, ["one", "two"], "left")
    found = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("group"))
    return whole.select("doc_id", "copy", "n_shingles", found.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with one document of each group; of rows that repeat doc_id and text one stays."""
    gone = stage(near_duplicates(docs, shingle, percent).filter("NOT kept").select("doc_id", "copy"), "gone")
    rest = without(docs, gone)
    again = stage(docs.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1 AND doc_id IS NOT NULL").select("doc_id"), "again")
    single = likely(rest, again).withColumn("__copy", F.hash(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "__copy"]).drop("__copy")
    return single.unionByName(likely(rest, again, keep=False))
