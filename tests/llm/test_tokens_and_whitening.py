"""Token alignment, token counts and whitening against brute force on small tables."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import awkward, awkward_rows, clashing, empty
from tidemark.llm import perfect_hash, token_alignment, whitening
from tidemark.llm.bytebpe import byte_alphabet
from tidemark.llm.queries import QUERIES
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.whitening import whiten

SF = "/root/testdata/sf0.001"
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

STRANGE = ["<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "it's 'sure' ''s 're\n's  's", "▁▁x", " lead", "  two", "tail  ", "\n\n\t x   y z\r\n", "\0nul\0", "½ ² ५६ Ⅷ",
           "é ñ́ 漢字 かな 한국어 עברית 🏳️‍🌈", "​‍﻿", "x" * 5000, " " * 5000, "ab" * 3000 + " " + "!?" * 2000, "\U000e0001\U0010ffff", "Ᲊ\U00010d40͸", "<s></s><unk><0x41>"]


def strange(spark):
    rows = [*awkward_rows(), *((100 + i, t, "en", "s", len(t)) for i, t in enumerate(STRANGE))]
    return spark.createDataFrame(rows, awkward(spark).schema)


def brute_alignment(rows):
    """Per (doc_id, text) the row that align_tokens promises, by plain loops."""
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    letters, vocab = byte_alphabet(), {i: t for t, i in a.get_vocab().items()}
    per = []
    for _, text in rows:
        if not text:
            per.append(([], [], [], []))
            continue
        whole = (" " + text).encode()
        one = [(i, bytes(letters[c] for c in vocab[i]) if i != 50256 else vocab[i].encode()) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if b"".join(x for _, x in one) != whole or b"".join(x for _, x in two) != whole:
            per.append(([], [], [], []))
            continue

        def spans(tokens):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out
        sa, sb, links, j0 = spans(one), spans(two), [], 0
        for i, s, e in sa:
            while sb[j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(sb) and sb[j][1] < e:
                links.append((i, sb[j][0]))
                j += 1
        ends = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        groups, ia, ib = [], 0, 0
        for e in ends:
            left, right = [], []
            while ia < len(sa) and sa[ia][2] <= e:
                left.append(str(sa[ia][0]))
                ia += 1
            while ib < len(sb) and sb[ib][2] <= e:
                right.append(str(sb[ib][0]))
                ib += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        per.append((sa, sb, links, groups))
    count = Counter(x for _, _, links, _ in per for x in links)
    best = {}
    for (_, b_id), n in count.items():
        best[b_id] = max(best.get(b_id, 0), n)
    return sorted((str(doc), len(sa), len(sb), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                   hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for (doc, _), (sa, sb, links, groups) in zip(rows, per))


def rows_of(df):
    return sorted((str(r[0]), *r[1:]) for r in df.select(*token_alignment.ORDER).collect())


def test_alignment_against_loops(spark):
    want = brute_alignment([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])
    assert rows_of(QUERIES["op11_token_alignment"](spark, SF)) == want


def test_alignment_of_awkward_texts_in_both_forms(spark, monkeypatch):
    docs = clashing(strange(spark)).repartition(5)
    want = brute_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(token_alignment.align_tokens(docs)) == want
    assert rows_of(token_alignment.align_tokens(docs, max_pairs=0)) == want
    monkeypatch.setattr(token_alignment, "FAN", 2)
    assert rows_of(token_alignment.align_tokens(docs)) == want
    assert rows_of(token_alignment.align_tokens(empty(spark))) == []
    assert [r[1:] for r in rows_of(token_alignment.align_tokens(docs.filter("doc_id < 3")))] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_perfect_hash_is_minimal_and_verified(spark):
    rng = random.Random(5)
    keys = np.array(sorted({rng.randrange(-(2**60), 2**60) for _ in range(70_000)} | {0, -1}))
    h = perfect_hash.build(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", len(keys))
    at = h.find(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))
    assert (h.find(keys[:1000] + 2**61) == -1).all()
    none = perfect_hash.build(spark.createDataFrame([], "k long"), "k", 0)
    assert (none.find(keys[:3]) == -1).all()
    one = perfect_hash.build(spark.createDataFrame([(7,)], "k long"), "k", 1)
    assert one.find(np.array([7, 8])).tolist() == [0, -1]


def test_token_counts_are_the_library_s(spark):
    library = Tokenizer.from_file(JSON)

    def check(docs, got):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            want[(r.doc_id, len((r.text or "").encode()), n, n > 512)] += 1
        assert Counter(tuple(r) for r in got.collect()) == want
    check(spark.read.parquet(f"{SF}/documents.parquet"), QUERIES["op13_token_counts"](spark, SF))
    docs = clashing(strange(spark)).repartition(5)
    check(docs, count_tokens(docs))
    assert count_tokens(empty(spark)).collect() == []


@pytest.mark.parametrize("path", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_of_other_kinds(spark, path):
    docs = strange(spark)
    full = public_tokenizers.path(path)
    if path.endswith(".model"):
        size = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=full).encode(t))
    else:
        size = lambda t: len(Tokenizer.from_file(full).encode(t, add_special_tokens=False).ids)
    want = Counter((r.doc_id, size(r.text or "")) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in count_tokens(docs, full).collect()) == want


def brute_whitening(vectors, k):
    x = [[int(Fraction(c) * 64 // 1) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    z = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(row, s)] for row in x])
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > e[0] * 1e-11).sum()))
    return deviation, z @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check_whitening(rows, vectors, k=32, within=1e-6):
    deviation, white, share = brute_whitening(vectors, k)
    n = len(vectors)
    by = {}
    for r in rows:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id]) and r.identity_error < 1e-6
        by[r.vec_id, r.component] = r.whitened, r.explained
    assert len(by) == len(rows) == n * white.shape[1]
    for c in range(white.shape[1]):
        got = np.array([by[i, c + 1][0] for i in range(n)])
        sign = np.sign(got @ white[:, c])
        assert np.abs(got * sign - white[:, c]).max() < within
        assert abs(by[0, c + 1][1] / share[c] - 1) < within


def test_whitening_against_eigenvectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    index = {r.vec_id: i for i, r in enumerate(table)}
    rows = [r.asDict() | {"vec_id": index[r.vec_id]} for r in QUERIES["op12_whitening"](spark, SF).collect()]
    check_whitening([type("R", (), r) for r in rows], [r.embedding for r in table])


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(40, 3)) @ rng.normal(size=(3, 7)) * 50).round(3)  # rank about 3 before rounding down
    good = [[float(v) for v in row] for row in base] + [[float(v) for v in base[0]]] * 2
    bad = [None, [], [1.0] * 6 + [None], [float("nan")] * 7, [float("inf")] + [0.0] * 6, [1.0, 2.0], [2.0**50] * 7]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in enumerate([*good, *bad])], "vec_id long, embedding array<double>, component string, n double")
    check_whitening(whiten(df.repartition(4), 5).collect(), good, 5, 1e-4)  # eigenvalues 1e9 apart: the brute force itself is good to about 1e-5
    assert whiten(df.filter("vec_id < 0")).collect() == []
    assert whiten(df.filter(F.col("vec_id").isin(40, 41))).collect() == []
    flat = spark.createDataFrame([(None, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    out = whiten(flat).collect()
    assert len(out) == 4 and {r.component for r in out} == {1} and all(abs(r.explained - 1) < 1e-12 for r in out)


def test_exact_deviations_beyond_64_bits():
    x = np.array([[2**45, 0], [0, 2**45]])
    d = whitening.exact_deviations(x, 2**20, np.array([2**63, 5], object))
    assert whitening.squared_length(d) == [(2**65 - 2**63) ** 2 + 25, 2**126 + (2**65 - 5) ** 2]
