"""Quality rules: counting rules, then language-specific perplexity bands of a word model.

The model is modified Kneser-Ney over pairs of neighbouring words (lower-cased; a text's first word follows a
start mark), with a continuation model of single words below it and, for ``UNSEEN`` of the mass, as many equal
slots as there are distinct pairs.  Words are hashed together with their language, so every language found in
the column has its own counts and discounts, however many there are.  Every pair of every text is counted, in
tables that grow with the corpus and are never in one place.

Work goes by *bundles* of whole texts (about ``BUNDLE_BYTES``, chosen by row hash, packed) and *parts* of the
hash space, each a sorted hash array:

1. Each bundle sends its distinct pairs to the parts, once however often they occur, as differences of sorted
   hashes with counts.  A part sums them and answers in the same order, so no hash travels back; the first
   bundle that sent a pair is told that it owns it.  The sums are made a second time for step 3, from the same
   exchange: that takes less disk than handing them on through step 2.
2. Each bundle adds up, for its words, how often they are followed, by how many owned pairs of total count 1, 2
   and 3 or more, and how many owned pairs end in them; for its languages, the counts of counts.  These sums
   take the same way, so each bundle ends with corpus-wide numbers for exactly its own words.
3. Each bundle scores its texts.  A text's own pairs are taken out of all counts first (leave-one-out: a pair
   that occurs nowhere else is new), so a text can't vouch for itself.

Hashes have ``SPARE`` bits more than the number of the corpus' bytes (``LEAST_BITS`` at least), so that the chance that a new pair
meets another's hash (below 1 / 2^(SPARE + 1)) is the same at every size.

A text has two scores over all its words: ``perplexity`` of the whole model and ``word_perplexity`` of the
continuation model, which counts kinds of contexts and so isn't moved by copies.  Each language's band is its
median plus and minus ``SPREAD`` times the median absolute deviation (at least ``FLOOR``) of the texts that pass
the counting rules; it is wider for languages of few texts (``FEW``) and short texts (``SHORT``).  Texts above
either band are rejected, and those below the band of word_perplexity (below that of perplexity stand copies,
which isn't a fault of their language).

Defined results: null text has no words, perplexity 1 and fails the base rule; a null language counts as the
language ''; a null doc_id is judged like any other, repeated rows each get a row (each is the other's evidence);
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bz2
import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textops import U64, Words, mix, slices, text_buffers
from tidemark.llm.textstats import TextStats
from tidemark.plans.staging import stage

BUNDLE_BYTES = 12 << 20
PART_BYTES = 32 << 20
PARTS = 32
SPARE = 6
LEAST_BITS = 34
UNSEEN = 0.05
SPREAD = 6.0
FLOOR = 0.1
FEW = 4.0
SHORT = 6.0
STEP = 0.005
SCORE_WORDS = 1 << 18
HELD_BYTES = 32 << 20
SPLIT = 4096
PACKED = 15
BLOCK = "p long, target long, keys binary, numbers binary"
SCORED = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, surprise double, word_surprise double")


def shrink(x: np.ndarray) -> bytes:
    """Numbers (rows of them) as compressed byte planes; from ``SPLIT`` numbers on each plane has a code of its own."""
    rows = np.ascontiguousarray(np.atleast_2d(x), "<u8")
    head, coded = [struct.pack("<IB", rows.shape[1], len(rows))], []
    for row in rows:
        planes = np.ascontiguousarray(row.view(np.uint8).reshape(-1, 8).T)
        kept = int(np.flatnonzero(planes.any(axis=1)).max(initial=-1)) + 1
        pieces = [p.tobytes() for p in planes[:kept]] if len(row) >= SPLIT else [planes[:kept].tobytes()] if kept else []
        coded += (own := [pa.Codec("zstd", PACKED).compress(p, asbytes=True) for p in pieces])
        head.append(struct.pack(f"<BB{len(own)}I", kept, len(own), *map(len, own)))
    return b"".join(head + coded)


def grow(b: bytes) -> np.ndarray:
    """The numbers that ``shrink`` packed, its rows one after the other."""
    (n, count), at, shape = struct.unpack_from("<IB", b), 5, []
    for _ in range(count):
        kept, pieces = struct.unpack_from("<BB", b, at)
        shape.append((kept, struct.unpack_from(f"<{pieces}I", b, at + 2)))
        at += 2 + 4 * pieces
    out = np.zeros((count, n), "<u8")
    for row, (kept, sizes) in zip(out, shape, strict=True):
        for i, size in enumerate(sizes):
            width = kept // len(sizes)
            raw = pa.Codec("zstd").decompress(b[at : at + size], width * n, asbytes=True)
            row.view(np.uint8).reshape(-1, 8)[:, i * width : (i + 1) * width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
            at += size
    return out.reshape(-1).astype(U64)


def shrink_gaps(x: np.ndarray) -> bytes:
    """Differences of sorted hashes: as many low bits as their mean has, which are noise, as they are; the rest packed.
    The first is a hash itself and tells nothing of the mean."""
    low = max(int(x[1:].mean()).bit_length() - 1, 0) if len(x) > 1 else 0
    bits = ((x.astype(U64)[:, None] >> np.arange(low, dtype=U64)) & U64(1)).astype(bool)
    rest = shrink(x.astype(U64) >> U64(low))
    return struct.pack("<BI", low, len(rest)) + rest + np.packbits(bits).tobytes()


def grow_gaps(b: bytes) -> np.ndarray:
    low, size = struct.unpack_from("<BI", b)
    out = grow(b[5 : 5 + size]) << U64(low)
    bits = np.unpackbits(np.frombuffer(b, np.uint8, offset=5 + size), count=low * len(out)).reshape(len(out), low)
    for i in range(low):
        out |= bits[:, i].astype(U64) << U64(i)
    return out


def fold(sums: np.ndarray) -> np.ndarray:
    """``Bundle.sums`` in smaller numbers: of the first and last column only what the kinds of pairs don't tell, signs in the lowest bit."""
    rest = np.stack([sums[0] - sums[1] - 2 * sums[2] - 3 * sums[3], sums[4] - sums[1] - sums[2] - sums[3]])
    first, last = (rest << 1) ^ (rest >> 63)
    return np.stack([first, *sums[1:4], last])


def unfold(folded: np.ndarray) -> np.ndarray:
    first, last = (folded[[0, 4]] >> 1) ^ -(folded[[0, 4]] & 1)
    one, two, three = folded[1:4]
    return np.stack([first + one + 2 * two + 3 * three, one, two, three, last + one + two + three])


def _blocks(rows) -> pa.Table:
    p, target, keys, numbers = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.table([pa.array(p, pa.int64()), pa.array(target, pa.int64()), pa.array(keys, pa.binary()), pa.array(numbers, pa.binary())],
                    names=["p", "target", "keys", "numbers"])


def _pack(batches):
    """Texts of a task by bundle, compressed."""
    def flush(held):
        t = pa.Table.from_batches(held).combine_chunks()
        which = t["bundle"].to_numpy()
        order = np.argsort(which, kind="stable")
        cut = np.append(np.flatnonzero(np.diff(which[order], prepend=-1)), len(order))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = t.take(pa.array(order[a:b])).select(["doc_id", "lang", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as out:
                out.write_table(own)
            # sorted blocks take a sixth less than zstd does at a level that is as quick
            yield pa.RecordBatch.from_arrays([pa.array([which[order[a]]], pa.int64()), pa.array([bz2.compress(sink.getvalue())], pa.binary())], names=["bundle", "docs"])
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES:
            yield from flush(held)
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield from flush(held)


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the first place of each, the rank of every item and the counts."""
    bits = max(len(x) - 1, 1).bit_length()
    if len(x) and int(x.max()).bit_length() + bits <= 64:  # value and place in one number: a plain sort is several times as quick
        y = np.sort((x.astype(U64) << U64(bits)) | np.arange(len(x), dtype=U64))
        order = (y & U64((1 << bits) - 1)).astype(np.int64)
        y >>= U64(bits)
    else:
        order = np.argsort(x, kind="stable")
        y = x[order]
    new = np.concatenate([[True], y[1:] != y[:-1]])[: len(y)]
    start = np.flatnonzero(new)
    rank = np.empty(len(x), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return y[start], order[start], rank, np.diff(np.append(start, len(x)))


class Bundle:
    """The words and pairs of a bundle's texts as sorted hash arrays."""

    def __init__(self, pieces: pa.ChunkedArray, shift: int, names: bool = True):
        self.parts = [s for piece in pieces for b in pa.ipc.open_stream(bz2.decompress(piece.as_py())).read_all().to_batches() for s in slices(b, "text")]
        word, row, langs, done = [], [], [], 0
        for part in self.parts:
            w = Words(*text_buffers(part.column("text")))
            lang = self._languages(part.column("lang"))
            word.append(mix(w.hashes(3, lower=True) + lang[w.row]))
            row.append((w.row + done).astype(np.int32))
            langs.append(lang)
            done += part.num_rows
        word, self.row, lang = np.concatenate(word), np.concatenate(row), np.concatenate(langs)
        self.rows = done
        new = np.concatenate([[True], self.row[1:] != self.row[:-1]])[: len(word)]
        context = np.concatenate([word[:1], word[:-1]])
        context[new] = mix(lang + U64(1))[self.row[new]]
        pair = mix(mix(context) * U64(3) + word) >> U64(shift)
        if not names:
            self.pair, self.times = np.unique(pair, return_counts=True)
        else:
            n = len(word)
            self.pair, self.sample, self.which, self.times = ranked(pair)
            del context, pair
            self.name, _, at, _ = ranked(np.concatenate([word, mix(lang + U64(1)), mix(lang + U64(2))]) >> U64(shift))
            self.word, start, self.whole = at[:n], at[n : n + done], at[n + done :]
            self.context = np.concatenate([at[:1], self.word[:-1]])[:n]
            self.context[new] = start[self.row[new]]

    @staticmethod
    def _languages(column: pa.Array) -> np.ndarray:
        coded = column.fill_null("").dictionary_encode()
        known = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
        return np.array(known, U64)[coded.indices.to_numpy(zero_copy_only=False)]

    def sums(self, total: np.ndarray, owned: np.ndarray) -> np.ndarray:
        """Per name: times followed, owned pairs from it of count 1, 2, 3 or more, owned pairs into it;
        for a language: owned pairs of count exactly 4, 1, 2, 3 and all."""
        size = len(self.name)
        at, n = self.sample[owned], total[owned]
        left, right, own = self.context[at], self.word[at], self.whole[self.row[at]]
        out = np.zeros((5, size), np.int64)
        out[0] = np.bincount(self.context, minlength=size) + np.bincount(own[n == 4], minlength=size)
        for k in (1, 2, 3):
            out[k] = np.bincount(left[np.minimum(n, 3) == k], minlength=size) + np.bincount(own[n == k], minlength=size)
        out[4] = np.bincount(right, minlength=size) + np.bincount(own, minlength=size)
        return out

    def surprise(self, total: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: mean negative log probability of a word by both models, the text's own pairs left out."""
        edge = np.searchsorted(self.row, np.arange(self.rows + 1))
        out, a = [], 0
        while a < self.rows:  # texts don't depend on each other: some at a time
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + SCORE_WORDS, "right")) - 1)
            out.append(self._surprise(a, b, slice(edge[a], edge[b]), total, sums))
            a = b
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _surprise(self, a: int, b: int, span: slice, total: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, which, whole, rows = self.row[span] - a, self.which[span], self.whole[a:b], b - a
        context, word = self.context[span], self.word[span]
        # the text's distinct pairs: one place of each, how often it stands there
        _, first, rank, times = ranked(row.astype(np.int64) * len(self.pair) + which)
        seen = total[which[first]]
        other = seen - times
        before, after = np.minimum(seen, 3), np.minimum(other, 3)
        gone = (other == 0).astype(float)
        _, left, left_rank, _ = ranked(row.astype(np.int64) * len(self.name) + context)
        _, right, right_rank, _ = ranked(row.astype(np.int64) * len(self.name) + word)

        def less(names, places, ranks, column, weight):
            """Numbers of the texts' names without what the texts' own pairs (``weight``) add to them."""
            return sums[column][names[places]] - np.bincount(ranks[first], weight, minlength=len(places))
        n4, n1, n2, n3, every = sums[:, whole].astype(float)
        every = np.maximum(every - np.bincount(row[first], gone, minlength=rows), 1)
        y = n1 / np.maximum(n1 + 2 * n2, 1)
        cut = [np.clip(j - (j + 1) * y * d / np.maximum(c, 1), 0.05, j - 0.05) for j, c, d in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        # a word that is followed elsewhere has held mass there; hashes that meet can't take it away
        kinds = [np.maximum(less(context, left, left_rank, k, (before == k).astype(float) - (after == k)), 0) for k in (1, 2, 3)]
        held = np.maximum(sum(c[row[left]] * k for c, k in zip(cut, kinds, strict=True)), 0.05)[left_rank[first]]
        followed = less(context, left, left_rank, 0, times)[left_rank[first]]
        into = np.maximum(less(word, right, right_rank, 4, gone), 0)[right_rank[first]]
        low = ((1 - UNSEEN) * into + UNSEEN) / every[row[first]]
        high = np.maximum(other - np.choose(after, [np.zeros(len(first)), *(c[row[first]] for c in cut)]), 0)
        full = np.where(followed > 0, (high + held * low) / np.maximum(followed, 1), low)
        n = np.maximum(np.bincount(row, minlength=rows), 1)
        return tuple(np.bincount(row[first], -times * np.log(p), minlength=rows) / n for p in (full, low))


def _sent(keys: np.ndarray, numbers: np.ndarray, bundle: int, parts: int, shift: int) -> list:
    """Blocks of sorted ``keys`` (with columns of ``numbers``) for the parts of the hash space."""
    p = ((keys << U64(shift)) >> U64(32)) * U64(parts) >> U64(32)
    cut = np.append(np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])[: len(p)]), len(p))
    return [(int(p[a]), bundle, shrink_gaps(np.diff(keys[a:b], prepend=U64(0))), shrink(numbers[:, a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _received(group: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of a part by bundle: bundles, where each begins, all keys, all numbers."""
    group = group.sort_by("target")
    keys = [np.cumsum(grow_gaps(k), dtype=U64) for k in group["keys"].to_pylist()]
    numbers = [grow(x).reshape(-1, len(k)) for x, k in zip(group["numbers"].to_pylist(), keys, strict=True)]
    return group["target"].to_pylist(), np.cumsum([0, *map(len, keys)]), np.concatenate(keys), np.concatenate(numbers, axis=1).astype(np.int64)


def _answered(group: pa.Table, columns: int) -> np.ndarray:
    """What the parts sent back to a bundle, in the order of its keys."""
    if not group.num_rows:
        return np.zeros((columns, 0), np.int64)
    return np.concatenate([grow(x).reshape(columns, -1) for x in group.sort_by("p")["numbers"].to_pylist()], axis=1).astype(np.int64)


def _send_pairs(parts, shift):
    def work(docs: pa.Table) -> pa.Table:
        b = Bundle(docs["docs"], shift, names=False)
        return _blocks(_sent(b.pair, b.times[None], docs["bundle"][0].as_py(), parts, shift))
    return work


def _count_pairs(parts=None):
    """A part of the pair table: counts in all other bundles, twice, plus one for the bundle that owns the pair; with ``parts``
    the counts alone, under numbers below zero."""
    def work(group: pa.Table) -> pa.Table:
        bundles, edge, keys, numbers = _received(group)
        _, first, inverse, _ = ranked(keys)
        answer, p = np.bincount(inverse, numbers[0])[inverse].astype(np.int64) - numbers[0], group["p"][0].as_py()
        if parts is None:
            answer *= 2
            answer[first] += 1
        else:
            p -= parts
        return _blocks([(p, b, None, shrink(answer[i:j])) for b, i, j in zip(bundles, edge[:-1], edge[1:], strict=True)])
    return work


def _send_words(parts, shift):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        b, bundle = Bundle(docs["docs"], shift), docs["bundle"][0].as_py()
        answer = _answered(answers, 1)[0]
        return _blocks(_sent(b.name, fold(b.sums((answer >> 1) + b.times, (answer & 1) > 0)), bundle, parts, shift))
    return work


def _count_words(group: pa.Table) -> pa.Table:
    """A part of the word table: sums of the bundles' numbers."""
    bundles, edge, keys, numbers = _received(group)
    _, _, inverse, _ = ranked(keys)
    answer = fold(np.stack([np.bincount(inverse, x) for x in unfold(numbers)]).astype(np.int64))[:, inverse]
    p = group["p"][0].as_py()
    return _blocks([(p, b, None, shrink(answer[:, i:j])) for b, i, j in zip(bundles, edge[:-1], edge[1:], strict=True)])


def _score(shift):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = Bundle(docs["docs"], shift)
        of_pairs = pa.compute.less(answers["p"], 0)
        total = _answered(answers.filter(of_pairs), 1)[0] + b.times
        full, low = b.surprise(total, unfold(_answered(answers.filter(pa.compute.invert(of_pairs)), 5)))
        out, done = [], 0
        for part in b.parts:
            s = TextStats(part.column("text"))
            counts = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words]
            failed = (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)
            own = slice(done, done + part.num_rows)
            done += part.num_rows
            out.append(pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang").fill_null(""), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(full[own]), pa.array(low[own])],
                names=[c.split()[0] for c in SCORED.split(", ")]))
        return pa.Table.from_batches(out)
    return work


def scores(docs: DataFrame) -> DataFrame:
    """The counts and both scores (mean negative log probability of a word) of every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bundles, parts = size // BUNDLE_BYTES + 1, max(PARTS, size // PART_BYTES)
    shift = 64 - min(64, max(LEAST_BITS, size.bit_length() + SPARE))
    packed = texts.withColumn("bundle", F.pmod(F.xxhash64("doc_id", "text"), F.lit(bundles))).mapInArrow(_pack, "bundle long, docs binary")
    by_bundle = packed.groupBy("bundle")
    sent = by_bundle.applyInArrow(_send_pairs(parts, shift), BLOCK).groupBy("p")
    pairs, totals = sent.applyInArrow(_count_pairs(), BLOCK), sent.applyInArrow(_count_pairs(parts), BLOCK)
    words = by_bundle.cogroup(pairs.groupBy("target")).applyInArrow(_send_words(parts, shift), BLOCK).groupBy("p").applyInArrow(_count_words, BLOCK)
    return by_bundle.cogroup(words.union(totals).groupBy("target")).applyInArrow(_score(shift), SCORED)


def bands(scored: DataFrame) -> DataFrame:
    """Per language: texts that pass the base rules, medians and median absolute deviations of both scores, in
    steps of ``STEP`` (so an aggregate holds a bounded number of different values)."""
    def step(x):
        return F.round(x / STEP) * STEP
    good = scored.filter("NOT base_failed").select(F.col("lang").alias("of"), step(F.col("surprise")).alias("a"), step(F.col("word_surprise")).alias("b"))
    mid = good.groupBy("of").agg(F.count("*").alias("texts"), F.percentile("a", 0.5).alias("mid"), F.percentile("b", 0.5).alias("word_mid"))
    off = good.join(mid.withColumnRenamed("of", "to"), F.col("of") == F.col("to")).groupBy("of", "texts", "mid", "word_mid").agg(
        F.percentile(step(F.abs(F.col("a") - F.col("mid"))), 0.5).alias("dev"), F.percentile(step(F.abs(F.col("b") - F.col("word_mid"))), 0.5).alias("word_dev"))
    return off


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, perplexity and word_perplexity (per word) and kept."""
    scored = stage(scores(docs), "scored")
    per = stage(bands(scored), "bands")

    def width(dev):
        return SPREAD * F.greatest(F.col(dev), F.lit(FLOOR)) * (1 + FEW / F.col("texts")) + SHORT / F.sqrt(F.greatest("n_words", F.lit(1)))
    off = (F.col("surprise") - F.col("mid") > width("dev")) | (F.abs(F.col("word_surprise") - F.col("word_mid")) > width("word_dev"))
    return scored.join(per, F.col("lang") == F.col("of"), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.exp("surprise").alias("perplexity"), F.exp("word_surprise").alias("word_perplexity"),
        (~F.col("base_failed") & ~F.coalesce(off, F.lit(False))).alias("kept"))
