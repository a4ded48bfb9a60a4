"""Benchmark decontamination: a BM25 index of the test items with block-max WAND.

Spark builds the index: postings (term, item, weight) of the test items, with document frequencies and
mean length over all items.  Items are dealt by hash into shards of about ``SHARD_ITEMS`` entries and
``SHARD_TERMS`` terms at most; a shard goes to the tasks as one broadcast, so its size is bounded by these
parameters and a larger benchmark only adds shards, each a pass of its own.

Every document is cut into overlapping passages, each a query.  A term of an item can give at most its
postings' largest weight; postings are stored in blocks of items with the block's maximum.  Per passage
the block maxima of its terms are summed first, and only blocks whose bound reaches the threshold are
scored: no entry above the threshold is missed.  Entries of the index are the question and the answer of an item, each cut
into overlapping pieces of ``PIECE`` terms, which a passage holds whole; answers of fewer than ``ANSWER`` terms can't decide a
verdict without their question and have no entry.  The threshold is relative: an item is retrieved when a passage scores ``RETRIEVE`` of what one
of its entries scores against itself.

Retrieved (document, item) pairs are verified on words: the share of the question's and of the answer's
word ``GRAM``-grams that the document holds.  The last sentence of an item is its answer, what stands
before it the question; an item of one sentence is all question.  A pair is contaminated when the
question share reaches ``QUESTION`` or, for items with both, question and answer together reach
``BOTH``.  Punctuation and the case of Latin letters are ignored.

Defined results: null or empty texts and items match nothing; rows that repeat a doc_id or item_id are
judged each by its own text; extra columns are ignored; empty tables give empty (or all-clean) results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bitmap import without
from tidemark.llm.textops import _TABLES, LOWER, U64, Words, between, map_slices, mix, prefix, signed, text_buffers
from tidemark.plans.staging import stage

K1, B = 1.2, 0.75
RETRIEVE = 0.4
QUESTION = 0.6
BOTH = 0.6
GRAM = 3
PASSAGE = 128
PIECE = PASSAGE // 2
ANSWER = 8
BLOCK_ITEMS = 16
SHARD_ITEMS = 20_000
SHARD_TERMS = 2_000_000
DENSE_CELLS = 1 << 23

#: Bytes that count as part of a term: letters, digits and everything beyond ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
PLAIN = np.where(TERM, LOWER, 32).astype(np.uint8)


def terms(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Terms of each text (runs of letters and digits, A-Z lower-cased) and their fingerprints."""
    data, bounds = text_buffers(column)
    plain = PLAIN[data]
    accented = np.zeros(len(data), bool)  # capitals of the Latin-1 block: lead byte C3, trail bytes 80 to 9E
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    plain[accented] += 32
    w = Words(plain, bounds)
    return w, between(prefix(_TABLES[3][w.data], 3), w.start, w.end, 3)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last sentence, if there are two."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text.strip(), "")


def gram_keys(h: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Fingerprints of the gram-word runs; of the whole where it is shorter."""
    if not len(h):
        return h
    n = min(gram, len(h))
    sums = prefix(h, 1)
    start = np.arange(len(h) - n + 1)
    return np.unique(between(sums, start, start + n, 1))


def entries(text: str) -> list[str]:
    """What is indexed of an item: pieces of its question and of its answer."""
    out = []
    for k, part in enumerate(split_item(text)):
        w, _ = terms(pa.array([part]))
        n = len(w.start)
        if not n or (k and n < ANSWER):
            continue
        raw = part.encode()
        for i in range(0, max(n - PIECE // 2, 1), PIECE // 2):
            j = min(i + PIECE, n) - 1
            out.append(raw[w.start[i] : w.end[j]].decode("utf-8", "ignore"))
    return out


def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted ``keys``."""
    at = np.searchsorted(keys, x)
    return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == x) if len(keys) else np.zeros(len(x), bool)


def summed(cell: np.ndarray, weight: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells that occur and the sums of their weights (all above 0), by a table of all cells where that is small."""
    if cells <= DENSE_CELLS:
        total = np.bincount(cell, weight, minlength=cells)
        spot = np.flatnonzero(total)
        return spot, total[spot]
    spot, where = np.unique(cell, return_inverse=True)
    return spot, np.bincount(where, weight, minlength=len(spot))


def _pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
    cut = [entries(t) for t in batch.column("text").to_pylist()]
    rows = [i for i, c in enumerate(cut) for _ in c]
    item, text = batch.column("item").take(pa.array(rows, pa.int64())), [t for c in cut for t in c]
    return pa.RecordBatch.from_arrays([item, pa.array([k for c in cut for k in range(len(c))], pa.int32()), pa.array(text, pa.string())], names=["item", "piece", "text"])


def _item_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    w, h = terms(batch.column("text"))
    row = w.row
    _, at, count = np.unique(mix(h + mix(row.astype(U64))), return_index=True, return_counts=True)
    take = pa.array(row[at])
    return pa.RecordBatch.from_arrays([batch.column("item").take(take), batch.column("piece").take(take), pa.array(signed(h[at])), pa.array(count.astype(np.int64)),
                                       pa.array(w.count[row[at]].astype(np.int64))], names=["item", "piece", "term", "tf", "length"])


class Index:
    """One shard: postings by term in entry order, block maxima, each entry's own score and item, and each item's grams."""

    def __init__(self, postings: pa.Table, items: pa.Table):
        self.item_id = items["item_id"].to_pylist()
        place = {k: i for i, k in enumerate(items["item"].to_pylist())}
        term = postings["term"].to_numpy().view(U64)
        owner = np.array([place[k] for k in postings["item"].to_pylist()], np.int64)
        # entries in the order of their items
        key, item = np.unique(owner << 32 | postings["piece"].to_numpy().astype(np.int64), return_inverse=True)
        self.owner = key >> 32
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], postings["weight"].to_numpy()[order]
        self.term, self.first = np.unique(term[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.own = np.bincount(self.item, self.weight, minlength=len(key))
        blocks = -(-max(len(key), 1) // BLOCK_ITEMS)
        owner = np.repeat(np.arange(len(self.term)), np.diff(self.first))
        cell, where = np.unique(owner * blocks + self.item // BLOCK_ITEMS, return_inverse=True)
        peak = np.zeros(len(cell))
        np.maximum.at(peak, where, self.weight)
        self.cell_block, self.cell_peak = cell % blocks, peak
        self.cell_first = np.searchsorted(cell, np.arange(len(self.term) + 1) * blocks)
        need = np.full(blocks * BLOCK_ITEMS, np.inf)
        need[: len(self.own)] = np.where(self.own > 0, RETRIEVE * self.own, np.inf)
        self.need, self.blocks = need, blocks
        self.block_need = need.reshape(blocks, BLOCK_ITEMS).min(axis=1)
        self.grams = []
        for text in items["text"].to_pylist():
            self.grams.append([gram_keys(terms(pa.array([part]))[1]) for part in split_item(text or "")])

    def search(self, key: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) pairs that reach the entry's threshold.  ``key``: term slots, ``query``: the query
        of each, both without repeats and in query order."""
        n = np.diff(self.cell_first)[key]
        at = np.repeat(self.cell_first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        queries = int(query.max(initial=-1)) + 1
        spot, bound = summed(np.repeat(query, n) * self.blocks + self.cell_block[at], self.cell_peak[at], queries * self.blocks)
        live = spot[bound >= self.block_need[spot % self.blocks]]
        if not len(live):
            return live, live
        some = among(query, np.unique(live // self.blocks))
        key, query = key[some], query[some]
        n = np.diff(self.first)[key]
        at = np.repeat(self.first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        q = np.repeat(query, n)
        inside = among(q * self.blocks + self.item[at] // BLOCK_ITEMS, live)
        pair, score = summed(q[inside] * len(self.own) + self.item[at][inside], self.weight[at][inside], queries * len(self.own))
        good = pair[score >= self.need[pair % len(self.own)]]
        return good // len(self.own), good % len(self.own)


def _find(index):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        x: Index = index.value
        w, h = terms(batch.column("text"))
        slot = np.minimum(np.searchsorted(x.term, h), max(len(x.term) - 1, 0))
        known = x.term[slot] == h if len(x.term) else np.zeros(len(h), bool)
        if not known.any():
            return None
        # a word stands in the passage of its half and in the one before
        half = PASSAGE // 2
        offset = (np.arange(len(h)) - w.first[w.row])[known]
        row, slot = w.row[known], slot[known]
        n = np.maximum(-(-(w.count - half) // half), 1)
        first = np.cumsum(n) - n
        one = np.minimum(offset // half, n[row] - 1)
        query = np.concatenate([first[row] + one, first[row] + np.maximum(one - 1, 0)])
        pair = np.unique(query * len(x.term) + np.concatenate([slot, slot]))
        found, item = x.search(pair % len(x.term), pair // len(x.term))
        if not len(found):
            return None
        row = np.searchsorted(first, found, "right") - 1
        both = np.unique(row * len(x.item_id) + x.owner[item])
        row, item = both // len(x.item_id), both % len(x.item_id)
        out = []
        for r in np.unique(row):
            held = gram_keys(h[w.first[r] : w.first[r + 1]])
            for i in item[row == r]:
                asked, told = x.grams[i]
                q = among(asked, held).mean() if len(asked) else 0.0
                a = among(told, held).mean() if len(told) else None
                mean = q if a is None else (q * len(asked) + a * len(told)) / (len(asked) + len(told))
                if q >= QUESTION or (a is not None and mean >= BOTH):
                    out.append((r, x.item_id[i], float(q), None if a is None else float(a)))
        if not out:
            return None
        rows, ids, q, a = zip(*out, strict=True)
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("copy").take(take), pa.array(ids, pa.int64()),
                                           pa.array(q, pa.float64()), pa.array(a, pa.float64())],
                                          names=["doc_id", "copy", "item_id", "question_share", "answer_share"])
    return work


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified pairs (doc_id, copy, item_id, question_share, answer_share); ``docs``: doc_id, copy, text."""
    spark = docs.sparkSession
    items = stage(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
                  .withColumn("item", F.xxhash64("item_id", "text")), "items")
    pieces = map_slices(items.select("item", "text"), "text", _pieces, "item long, piece int, text string")
    raw = stage(map_slices(pieces, "text", _item_terms, "item long, piece int, term long, tf long, length long"), "terms")
    whole = raw.select("item", "piece", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.sum("length").alias("terms")).first()
    schema = "doc_id long, copy int, item_id long, question_share double, answer_share double"
    if not whole.n:
        return spark.createDataFrame([], schema)
    df = raw.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (whole.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / float(whole.mean)))
    postings = stage(raw.join(df, "term").select("item", "piece", "term", (idf * gain).alias("weight")), "postings")
    shards = max(-(-whole.n // SHARD_ITEMS), -(-whole.terms // SHARD_TERMS))
    out = []
    for k in range(shards):
        mine = F.pmod(F.col("item"), F.lit(shards)) == k
        index = spark.sparkContext.broadcast(Index(postings.filter(mine).toArrow(), items.filter(mine).toArrow()))
        out.append(stage(map_slices(docs, "text", _find(index), schema), "leaks"))
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def with_copy(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", F.hash("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, item_ids (sorted; empty when clean) and contaminated."""
    rows = with_copy(docs)
    hit = contaminated_pairs(rows, benchmark).groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return rows.select("doc_id", "copy").join(hit, ["doc_id", "copy"], "left").select(
        "doc_id", F.coalesce("item_ids", F.array().cast(T.ArrayType(T.LongType()))).alias("item_ids"), F.col("item_ids").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that hold a benchmark item."""
    return without(docs, contaminated_pairs(with_copy(docs), benchmark).select("doc_id", "copy"))
