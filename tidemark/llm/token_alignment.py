"""Alignment of two tokenizers' tokens over a corpus, with corpus-wide counts of linked token pairs.

Tokenizer A is a byte-level BPE, B a sentencepiece model; both are given ``blank + text`` and so cut the same bytes.
Offsets where tokens of both end bound *groups*; an A and a B token whose bytes overlap are *linked*.
Between two neighbouring token ends of either kind lies exactly one link, so links need no pairing.

Every task cuts its texts into units, mostly words, at which tokens of both kinds surely end (``Units``), and aligns a unit
once.  First pass: every task aligns its texts and sends its distinct pairs with their counts.  The distinct pairs of
all tasks get numbers by a minimal perfect hash (``perfect_hash``); tasks over the first pass's rows add up dense
count vectors indexed by it, which are summed block by block in a tree of fan-in ``FAN``.  Stored keys verify each
look-up.  Second pass: every task aligns its texts anew and looks the counts up in the broadcast table.

The table takes about 17 bytes a pair and is broadcast for up to ``MAX_PAIRS`` distinct pairs, which are counted
first.  Beyond that nothing is collected: the second pass writes each text's distinct pairs, and counts are joined by pair.

Defined results: a text that is null or empty, or whose joined tokens of A or B aren't ``blank + text`` (B reads
U+2581 as a blank, for one), has no tokens: zeros and ''.  It adds to no count.  Repeated rows count each.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytebpe import Encoder, read_bytes, vocabulary_path
from tidemark.llm.perfect_hash import PerfectHash, build
from tidemark.llm.textops import U64, slices
from tidemark.plans.staging import stage

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MAX_PAIRS = 4_000_000
BLOCK = 1 << 15
FAN = 16
UNITS = 300_000
UNIT = re.compile(" +[^ ]*").findall
MIXED = re.compile(r"[^\S ] ").search
COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
ORDER = [c.split()[0] for c in COUNTS.split(", ")]
SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Pieces:
    """Tokenizer B in a worker: ids of units, bytes of pieces, and whether texts may be cut in front of blanks."""

    def __init__(self, raw: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        blobs = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.blob, self.blob_at = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)])
        spec = sentencepiece_model_pb2.ModelProto.FromString(raw)
        how, plain = spec.normalizer_spec, spec.trainer_spec.model_type == 2 and not any(p.type == p.USER_DEFINED for p in spec.pieces)
        self.blank = sp.piece_to_id("▁")
        self.cuts = (plain and how.name == "identity" and how.add_dummy_prefix and not how.remove_extra_whitespaces and self.blank != sp.unk_id()
                     and not any(re.search("[^▁]▁", p) for p in names))

    def encode(self, units: list[str]) -> list[list[int]]:
        """``units`` start with the blank that the library adds; a blank alone it would drop."""
        lists = self.library.encode([u[1:] for u in units], num_threads=1) if units else []
        return [[self.blank] if u == " " and self.cuts else x for u, x in zip(units, lists, strict=True)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, n.sum()), n


def _bytes_of(t, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' joined bytes, and each one's length."""
    size = np.diff(t.blob_at)[ids]
    upto = np.cumsum(size)
    return t.blob[np.repeat(t.blob_at[ids] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)], size


def _intact(t, ids: np.ndarray, n: np.ndarray, whole: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row, whether its tokens' bytes are its bytes in ``whole``; and all tokens' lengths."""
    data, size = _bytes_of(t, ids)
    edge = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
    good = np.diff(edge) == np.diff(bounds)
    if good.all():
        wrong = np.flatnonzero(data != whole)
        good[np.searchsorted(bounds, wrong, "right") - 1] = False
    else:
        a, b = data.tobytes(), whole.tobytes()
        good = np.array([a[edge[i] : edge[i + 1]] == b[bounds[i] : bounds[i + 1]] for i in range(len(n))], bool)
    return good, size


@dataclass
class Aligned:
    """A slice of texts: tokens per row, ids, and for every link its row, its two tokens, and whether either (both: a group) ends there."""

    n_a: np.ndarray
    n_b: np.ndarray
    a: np.ndarray
    b: np.ndarray
    row: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    pair: np.ndarray
    size: int  # ids are below this


def align(a: Encoder, b: Pieces, full: list[str]) -> Aligned:
    """Of texts or units that start with the blank in front."""
    rows = len(full)
    (ids_a, n_a), (ids_b, n_b) = _flat(a.encode(full)), _flat(b.encode(full))
    raw = [t.encode() for t in full]
    whole, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    good_a, size_a = _intact(a, ids_a, n_a, whole, bounds)
    good_b, size_b = _intact(b, ids_b, n_b, whole, bounds)
    good = good_a & good_b
    if not good.all():
        keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
        ids_a, size_a, ids_b, size_b = ids_a[keep_a], size_a[keep_a], ids_b[keep_b], size_b[keep_b]
        n_a, n_b = n_a * good, n_b * good
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    mark_a = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool)
    mark_b = np.zeros_like(mark_a)
    mark_a[end_a], mark_b[end_b] = True, True
    cut = np.flatnonzero(mark_a | mark_b)
    ends_a, ends_b = mark_a[cut], mark_b[cut]
    link_a, link_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    row = np.repeat(np.arange(rows), n_a)[link_a] if len(cut) else np.zeros(0, np.int64)
    return Aligned(n_a, n_b, ids_a, ids_b, row, link_a, link_b, ends_a, ends_b, ids_a[link_a] * b.size + ids_b[link_b], max(a.size, b.size))


def group_texts(x: Aligned, size: int) -> list[bytes]:
    """Per row its groups as text, without a semicolon behind the last."""
    both = x.ends_a & x.ends_b
    group = np.cumsum(both) - both
    group_a, group_b = group[x.ends_a], group[x.ends_b]
    groups = int(both.sum())
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    upto_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
    ids, after = np.zeros(len(x.a) + len(x.b), np.int64), np.full(len(x.a) + len(x.b), ord(","), np.uint8)
    at_a, at_b = np.arange(len(x.a)) + before_b[group_a], np.arange(len(x.b)) + upto_a[group_b]
    ids[at_a], ids[at_b] = x.a, x.b
    after[at_a[both[x.ends_a]]], after[at_b[both[x.ends_b]]] = ord("|"), ord(";")
    count, packed = (t[ids] for t in _decimal(size))
    packed |= after.astype(U64) << (count.astype(U64) << U64(3))
    text = packed.view(np.uint8).reshape(-1, 8)[np.arange(8) <= count[:, None]].tobytes()
    edge = np.concatenate([[0], np.cumsum(count + 1, dtype=np.int64)])[np.concatenate([[0], np.cumsum(x.n_a + x.n_b)])]
    return [text[i : max(j - 1, i)] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


class Units:
    """Texts in a worker, cut into units that are aligned once.

    A cut stands in front of a run of blanks behind a character that is no white space.  There a pre-token of A ends, and
    so does a piece of B where no piece of a plain merge model holds a blank behind another character: both kinds of tokens end at
    the cut, so groups, links and their sums are those of the units.  Texts for which that isn't sure are one unit: those with a character that A's two
    encoders treat differently, with U+2581, or with a blank behind other white space; and all texts of other kinds of tokenizers."""

    def __init__(self, raw: tuple[bytes, bytes], table: tuple[PerfectHash, np.ndarray, np.ndarray] | None = None, texts: bool = False):
        self.a, self.b = Encoder(raw[0]), Pieces(raw[1])
        self.table, self.texts, self.cuts = table, texts, self.b.cuts and self.a.fast is not None
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.good = np.zeros((len(SUMS), 0), np.int64), np.zeros(0, bool)
        self.groups: list[bytes] = []
        self.pair: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.held = 0

    @property
    def full(self) -> bool:
        return len(self.known) > UNITS or self.held > 16 * UNITS

    def _learn(self, new: list[str]) -> None:
        x = align(self.a, self.b, new)
        n, both = len(new), x.ends_a & x.ends_b
        links = np.bincount(x.row, minlength=n)
        own = [x.n_a, x.n_b, np.bincount(x.row[both], minlength=n), links, np.zeros(n, np.int64), np.zeros(n, np.int64)]
        if self.table:
            hashed, total, best = self.table
            at = hashed.find(x.pair)
            if len(at) and at.min() < 0:
                raise ValueError("the second pass met a pair that the first one didn't")
            edge = np.concatenate([[0], np.cumsum(links)])
            for k, v in ((4, total[at] == best[x.pair % len(best)]), (5, total[at])):
                own[k] = np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[edge])
        self.known.update(zip(new, range(len(self.good), len(self.good) + n), strict=True))
        self.sums, self.good = np.concatenate([self.sums, np.stack(own)], axis=1), np.concatenate([self.good, x.n_a > 0])
        if self.texts:
            self.groups += group_texts(x, x.size)
        self.pair.append(x.pair)
        self.links.append(links)
        self.held += len(x.pair)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' units by number, how many each text has, and which texts have tokens."""
        odd = self.a.probed.odd(texts)[0].tolist() if self.cuts else [True] * len(texts)
        units = [([" " + t] if t else []) if o or "▁" in t or MIXED(t) else UNIT(" " + t) if t else [] for t, o in zip(texts, odd, strict=True)]
        new = set().union(*units).difference(self.known)
        if new:
            self._learn(sorted(new))
        n = np.array([len(u) for u in units], np.int64)
        slot = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, n.sum())
        bad = np.concatenate([[0], np.cumsum(~self.good[slot])])[np.concatenate([[0], np.cumsum(n)])]
        return slot, n, (n > 0) & (np.diff(bad) == 0)

    def pairs(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs with the links of units that occurred ``times``."""
        links = np.concatenate(self.links)
        return _merged([np.concatenate(self.pair)], [np.repeat(times, links)])


@cache
def _decimal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and digits of the numbers below n (at most 10**7), the digits as bytes of a word, lowest first; one byte more is free."""
    if n > 10**7:
        raise ValueError("ids of more than seven digits")
    words = [str(i).encode().ljust(8, b"\0") for i in range(n)]
    return np.array([len(w.rstrip(b"\0")) for w in words], np.int8), np.frombuffer(b"".join(words), "<u8")


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts).astype(float), len(key)).astype(np.int64)


def pair_counts(texts: DataFrame, shipped) -> DataFrame:
    """(pair, n): the distinct pairs of each task's texts, with that task's links; a task sends its pairs whenever its units are full."""
    def work(batches) -> Iterator[pa.RecordBatch]:
        units = Units(shipped.value)
        times = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                slot, n, good = units.read([t or "" for t in part.column("text").to_pylist()])
                times = np.bincount(slot[np.repeat(good, n)], minlength=len(units.good)) + np.pad(times, (0, len(units.good) - len(times)))
                if units.full:
                    yield from send(*units.pairs(times))
                    units._clear()
                    times = np.zeros(0, np.int64)
        if len(times):
            yield from send(*units.pairs(times))

    def send(k, c):
        k, c = k[c > 0], c[c > 0]
        for i in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)]), pa.array(c[i : i + (1 << 16)])], names=["pair", "n"])
    return texts.select("text").mapInArrow(work, "pair long, n long")


def summed_counts(counts: DataFrame, hashed: PerfectHash) -> np.ndarray:
    """Counts by hash number: a dense vector per task, summed in a tree block by block."""
    shipped, n = counts.sparkSession.sparkContext.broadcast(hashed), len(hashed.keys)
    blocks = -(-n // BLOCK)

    def dense(batches):
        total = np.zeros(blocks * BLOCK, np.int64)
        for batch in batches:
            at = shipped.value.find(batch.column("pair").to_numpy())
            if len(at) and at.min() < 0:
                raise ValueError("a pair is missing from its own hash table")
            total += np.bincount(at, batch.column("n").to_numpy().astype(float), len(total)).astype(np.int64)
        node = TaskContext.get().partitionId()
        for i in range(blocks):
            part = total[i * BLOCK : (i + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([node]), pa.array([part.tobytes()], pa.binary())], names=["block", "node", "v"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for v in group["v"]:
            total += np.frombuffer(v.as_buffer(), np.int64)
        return pa.table({"block": group["block"].slice(0, 1), "node": group["node"].slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})
    schema = "block long, node long, v binary"
    out, nodes = counts.mapInArrow(dense, schema), counts.rdd.getNumPartitions()
    while True:
        out = out.withColumn("node", F.floor(F.col("node") / FAN).cast("long")).groupBy("block", "node").applyInArrow(add, schema)
        nodes = -(-nodes // FAN)
        if nodes <= 1:
            break
    total = np.zeros(blocks * BLOCK, np.int64)
    for r in out.collect():
        total[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.v, np.int64)
    return total[:n]


def _row_columns(units: Units, slot: np.ndarray, n: np.ndarray, good: np.ndarray) -> dict[str, pa.Array]:
    edge = np.concatenate([[0], np.cumsum(n)])
    columns = {name: pa.array(np.diff(np.concatenate([[0], np.cumsum(v[slot])])[edge]) * good) for name, v in zip(SUMS, units.sums, strict=True)}
    get, flat = units.groups.__getitem__, slot.tolist()
    sha = [hashlib.sha256(b";".join(map(get, flat[i:j]))).hexdigest() if g else "" for i, j, g in zip(edge[:-1].tolist(), edge[1:].tolist(), good.tolist(), strict=True)]
    return columns | {"groups_sha256": pa.array(sha, pa.string())}


def align_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a and n_b tokens, n_groups, n_links, n_best (links whose count is the highest of
    their B id), count_sum (of all links' counts) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``)."""
    spark = docs.sparkSession
    raw = read_bytes(path_a or vocabulary_path(TOKENIZER_A)), read_bytes(path_b or vocabulary_path(TOKENIZER_B))
    shipped, size_b = spark.sparkContext.broadcast(raw), Pieces(raw[1]).size
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = stage(pair_counts(texts, shipped), "pairs")
    keys = stage(counts.select("pair").distinct(), "keys")
    n = keys.count()
    if n > max_pairs:
        return _joined(texts, counts, shipped, size_b)
    hashed = build(keys, "pair", n)
    total = summed_counts(counts, hashed)
    best = np.zeros(size_b, np.int64)
    np.maximum.at(best, hashed.keys % size_b, total)
    table = spark.sparkContext.broadcast((hashed, total, best))

    def work(batches) -> Iterator[pa.RecordBatch]:
        units = Units(shipped.value, table.value, texts=True)
        for batch in batches:
            for part in slices(batch, "text"):
                if units.full:
                    units._clear()
                out = {"doc_id": part.column("doc_id")} | _row_columns(units, *units.read([t or "" for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([out[c] for c in ORDER], names=ORDER)
    return texts.mapInArrow(work, COUNTS)


def _joined(texts: DataFrame, counts: DataFrame, shipped, size_b: int) -> DataFrame:
    """The same for more pairs than a broadcast may hold: texts' distinct pairs meet their counts in a join."""
    schema = "row string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches):
        units, done = Units(shipped.value, texts=True), 0
        for batch in batches:
            for part in slices(batch, "text"):
                if units.full:
                    units._clear()
                slot, n, good = units.read([t or "" for t in part.column("text").to_pylist()])
                out = {"doc_id": part.column("doc_id")} | _row_columns(units, slot, n, good)
                out["row"] = pa.array([f"{TaskContext.get().partitionId()}/{done + i}" for i in range(part.num_rows)], pa.string())
                done += part.num_rows
                links, pool = np.concatenate([*units.links, np.zeros(0, np.int64)]), np.concatenate([*units.pair, np.zeros(0, np.int64)])
                used = slot[np.repeat(good, n)]
                size, first = links[used], (np.cumsum(links) - links)[used]
                upto = np.cumsum(size)
                pair = pool[np.repeat(first - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
                row = np.repeat(np.repeat(np.arange(part.num_rows), n * good), size)
                order = np.lexsort((pair, row))
                row, pair = row[order], pair[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])[: len(row)])
                edge = pa.array(np.searchsorted(row[new], np.arange(part.num_rows + 1)).astype(np.int32))
                out |= {"pairs": pa.ListArray.from_arrays(edge, pa.array(pair[new])), "times": pa.ListArray.from_arrays(edge, pa.array(np.diff(np.append(new, len(row)))))}
                yield pa.RecordBatch.from_arrays([out[c] for c in names], names=names)
    rows = stage(texts.mapInArrow(work, schema), "rows")
    total = stage(counts.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    best = total.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("best"))
    table = total.join(best, F.col("pair") % size_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("best")).alias("top"))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", "l.pairs", "l.times")
    sums = links.join(table, F.col("pairs") == F.col("pair")).groupBy("row").agg(
        F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
