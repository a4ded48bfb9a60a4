import hashlib

import numpy as np
import pyarrow as pa

from tests.llm.cases import awkward, awkward_rows, clashing, empty
from tidemark.llm import minhash_dedup as M
from tidemark.llm import substring_dedup as S
from tidemark.llm.components import components


def expected_removal(rows, window):
    first, out = {}, []
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, t, *_ in order:
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_removal_against_brute_force(spark):
    rows = awkward_rows()
    got = S.remove_repeats(clashing(awkward(spark))).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == expected_removal(rows, 50)
    assert S.remove_repeats(empty(spark)).count() == 0


def test_equal_windows_are_filed_alike():
    """Windows get their symbol from their own words, whatever surrounds them (periodic text included)."""
    rng = np.random.default_rng(1)
    shared = [f"s{x}" for x in rng.integers(0, 40, 120)] + ["p", "q", "r"] * 40 + ["z"] * 90
    texts = [" ".join([f"a{x}" for x in rng.integers(0, 30, n)] + shared + ["end"] * n) for n in (1, 7, 60, 200)]
    seen = {}
    for t in texts:
        w = S.Words(*S.text_buffers(pa.array([t])))
        starts = S.window_starts(w, 50)
        name, at = S.file_windows(w.hashes(0), w.row, starts)
        tokens = t.split()
        for s, n, a in zip(starts, name, at, strict=True):
            assert seen.setdefault(tuple(tokens[s : s + 50]), (n, a - s)) == (n, a - s)


def expected_components(rows, shingle, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
        own = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
        sets.setdefault(i, own)
    ids = [i for i in sets if i is not None]
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_groups_against_brute_force(spark):
    rows = awkward_rows()
    got = M.near_duplicates(clashing(awkward(spark)), shingle=4).collect()
    want = expected_components(rows, 4, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    assert M.near_duplicates(empty(spark)).count() == 0


def test_chain_of_near_copies(spark):
    """Each copy is close to the next only, so the leader of a bucket can't confirm them all."""
    base = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(base[:k] + [f"n{j}" for j in range(k)] + base[k:][k and 0 :])) for i, k in enumerate(range(0, 60, 4))]
    rows += [(100 + i, " ".join([f"e{i}_{j}" for j in range(i * 3)] + base)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in M.near_duplicates(df, shingle=4).collect()}
    assert got == {i: c for i, (_, c) in expected_components(rows, 4, 80).items()}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = items[:600], items[150:750]
    sig = M.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 600), 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 450 / 750) < 0.06
    few = M.super_minhash(items[:3], np.zeros(3, np.int64), 1, 128)
    assert np.isfinite(few).all() and len(np.unique(few)) == 128
    assert np.isinf(M.super_minhash(items[:0], np.zeros(0, np.int64), 1, 16)).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[k] == 100 for k in range(101, 130))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stage_keeps_one_of_repeated_rows(spark):
    df = awkward(spark)
    out = M.drop_near_duplicates(clashing(df))
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 9, 11, 13, 14, 16]
    assert ids.count(None) == 2 and "extra" == out.first().bands
