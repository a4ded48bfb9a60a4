import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from tests.llm.cases import awkward, awkward_rows, clashing, empty
from tidemark.llm import decontamination as D
from tidemark.llm import html_extract as X
from tidemark.llm import license_scan as L
from tidemark.llm import pii_surrogates as P
from tidemark.llm import quality_classifier as C
from tidemark.llm import quality_rules as Q
from tidemark.llm import sentencepiece as SP
from tidemark.llm import url_filter as U


def test_quality_counts_against_brute_force(spark):
    rows = awkward_rows()
    got = Q.quality_rules(clashing(awkward(spark))).collect()
    want = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        twice = [False] * len(w)
        for k, g in enumerate(grams):
            if count[g] > 1:
                twice[k : k + 3] = [True] * 3
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n_rep = sum(twice)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n_rep, len(w) < 50 or 100 * n_rep > 50 * len(w)))
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    assert all(not r.kept for r in got if r.base_failed)
    assert Q.quality_rules(empty(spark)).count() == 0


def test_word_salad_is_rejected(spark):
    import random

    rng = random.Random(11)
    parts = "ba der lin mo ta sel vor ki nen gra pu sto".split()
    words = ["".join(rng.choices(parts, k=rng.choice((2, 2, 3)))) for _ in range(300)]
    follow = {w: rng.sample(words, 4) for w in words}

    def sentence(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return out
    rows = [(i, "en", " ".join(sentence(300))) for i in range(400)]
    for i in range(400, 410):  # the words of such a text in random order
        salad = sentence(300)
        rng.shuffle(salad)
        rows.append((i, "en", " ".join(salad)))
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not any(got[i].kept for i in range(400, 410))
    assert all(got[i].kept for i in range(400))


def kneser_ney(texts, own):
    """The model of ``texts`` (lang, words) without text ``own``, spelled out: p(word | context) and p(word) as functions."""
    import collections

    lang = texts[own][0]

    def pairs(w):
        return list(zip(["^", *w], w, strict=False))
    every = collections.Counter(p for la, w in texts if la == lang for p in pairs(w))
    left = every - collections.Counter(pairs(texts[own][1]))
    n = [sum(c == k for c in every.values()) for k in range(5)]
    y = n[1] / max(n[1] + 2 * n[2], 1)
    cut = [0.0] + [min(max(k - (k + 1) * y * n[k + 1] / max(n[k], 1), 0.05), k - 0.05) for k in (1, 2, 3)]

    def single(v):
        return (0.95 * sum(x == v for _, x in left) + 0.05) / max(len(left), 1)

    def after(u, v):
        whole = sum(c for (a, _), c in left.items() if a == u)
        if not whole:
            return single(v)
        c = left[u, v]
        held = sum(cut[min(k, 3)] for (a, _), k in left.items() if a == u)
        return (max(c - cut[min(c, 3)], 0) + max(held, 0.05) * single(v)) / whole
    return after, single, left


def test_word_model_against_brute_force(spark):
    import math
    import random

    rng = random.Random(5)
    vocabulary = [f"W{i}" for i in range(12)]
    rows = [(i, rng.choice(["en", "xx"]), " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(40)]
    rows += [(40, "en", None), (41, None, "alone in no language"), (42, "zz", "alone"), (43, "en", " ")]
    got = {r.doc_id: r for r in Q.scores(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)).collect()}
    texts = [(la or "", (t or "").lower().split()) for _, la, t in rows]
    for i, (_, words) in enumerate(texts):
        after, single, left = kneser_ney(texts, i)
        n = max(len(words), 1)
        assert abs(got[i].surprise + sum(math.log(after(u, v)) for u, v in zip(["^", *words], words, strict=False)) / n) < 1e-9
        assert abs(got[i].word_surprise + sum(math.log(single(v)) for v in words) / n) < 1e-9
    after, single, left = kneser_ney(texts, 0)
    seen = {v for _, v in left}
    unseen = len(left) - len(seen)  # the slots that no known word takes
    for u in ("^", "w3", "never"):
        assert abs(sum(after(u, v) for v in seen) + unseen * after(u, "another") - 1) < 1e-9


def test_bundles_and_parts_change_nothing(spark, monkeypatch):
    df = clashing(awkward(spark))
    one = sorted(map(tuple, Q.scores(df).collect()), key=repr)
    monkeypatch.setattr(Q, "BUNDLE_BYTES", 5000)
    monkeypatch.setattr(Q, "PART_BYTES", 1000)
    many = sorted(map(tuple, Q.scores(df.repartition(5)).collect()), key=repr)
    assert [r[:8] for r in one] == [r[:8] for r in many]
    assert all(abs(a - b) < 1e-9 for x, y in zip(one, many, strict=True) for a, b in zip(x[8:], y[8:], strict=True))


def test_bands_of_each_language(spark):
    import random

    rng = random.Random(7)

    def language(letters, n):
        words = ["".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(400)]
        weights = [1 / (k + 1) for k in range(400)]
        return [rng.choices(words, weights, k=200) for _ in range(n)], words
    large, words = language("abcdefgh", 200)
    small, _ = language("qrstuvwx", 5)
    half = large[0][:100] + ["".join(rng.choices("mnopzyjk", k=8)) for _ in range(100)]  # the second half is noise
    few = [a for _ in range(70) for a in rng.sample(words[:3], 3)]  # nothing but the commonest words
    rows = [(i, "one", " ".join(w)) for i, w in enumerate(large)] + [(500 + i, "two", " ".join(w)) for i, w in enumerate(small)]
    rows += [(900, "one", " ".join(half)), (901, "two", " ".join(large[1])), (902, "one", " ".join(few))]
    rows += [(1000 + i, "one", " ".join(large[2])) for i in range(60)]  # copies are no fault of their language
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert not got[900].kept and not got[902].kept
    assert all(got[i].kept for i in [*range(200), *range(500, 505), *range(1000, 1060)])


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = C.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in got) / len(got)
    assert right > 0.95


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (11, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = C.score_quality(clashing(awkward(spark)), labels).collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in C.score_quality(awkward(spark), labels.filter("doc_id < 0")).collect()} == {0.5}
    assert C.score_quality(empty(spark), labels).count() == 0


def test_pooling_is_monotone():
    knots, levels = C.pooled([0.0, 1, 2, 3], [1, 1, 1, 1], [0, 1, 0, 1])
    assert list(levels) == [0, 0.5, 1] and list(knots) == [0, 1.5, 3]


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate([int(c) for c in d][::-1])) % 10 == 0


def test_surrogates(spark):
    rows = [(1, "Mr John Smith wrote a.b@Mail.Example.com, +1 (017) 555-7713, 97.51.17.173 and 4111 1111 1111 1111."),
            (2, "Mrs Jane Roe; A.B@MAIL.EXAMPLE.COM; 4111-1111-1111-1111; 1234567890123456; Г-жа Иванова Анна"), (3, None), (4, ""),
            (2, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 999.1.1.1 version 1.2.3'), (None, "SSN 123-45-6789 Mr John Smith")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("hits", "kinds", "found", "again", "tid", "surrogates", "entities"):
        df = df.withColumn(name, P.F.lit("extra"))
    out = [r.text for r in P.replace_entities(df).collect()]
    assert out[2] == out[3] == ""
    whole = " ".join(out)
    for secret in ("John Smith", "a.b@Mail", "A.B@MAIL", "017) 555", "97.51.17.173", "4111", "04dbebab", "123-45-6789", "Jane Roe", "Иванова"):
        assert secret not in whole
    for clean in ("1234567890123456", "999.1.1.1", "version 1.2.3", "Mr ", "Mrs ", "Г-жа "):
        assert clean in whole
    mail = re.search(r"\S+@\S+\.com", out[0])[0]
    assert mail.upper() in out[1].upper()  # one surrogate for one address, in each text's case
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", out[0])[0]
    assert luhn(card.replace(" ", "")) and card.replace(" ", "-") in out[1]
    he = re.search(r"Mr (\w+ \w+)", out[0])[1]
    assert he in out[5] and he.split()[0] in P.FIRST["m"].split()
    assert re.search(r"Г-жа [А-Яа-яёЁ]+ [А-Яа-я]+", out[1]) and re.search(r"Mrs (\w+)", out[1])[1] in P.FIRST["f"].split()


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"SSN {i:03d}-{i % 97:02d}-{i * 7 % 9973:04d} and Mr A{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} B{chr(97 + i // 7 % 26)}") for i in range(900)]
    out = P.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for pattern in (r"\d{3}-\d{2}-\d{4}", r"Mr (\w+ \w+)"):
        old = [re.search(pattern, t)[0] for _, t in rows]
        new = {r.doc_id: re.search(pattern, r.text)[0] for r in out}
        pairs = {(o, new[i]) for (i, _), o in zip(rows, old, strict=True)}
        assert len(pairs) == len({o for o, _ in pairs}) == len({n for _, n in pairs})
        assert not {n for _, n in pairs} & set(old)


def test_written_names_stay_distinct_and_agree(spark):
    rows = [(i, f"Mr Q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x") for i in range(1500)]
    rows += [(2000, "Mr John Smith came. Mr Smith left. Mrs Smith stayed. Mr Paul Smith, too.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    new = {r.doc_id: r.text for r in P.replace_entities(df).collect()}
    assert len({new[i] for i in range(1500)}) == 1500
    full, short, her, other = re.fullmatch(r"Mr (\w+ \w+) came. Mr (\w+) left. Mrs (\w+) stayed. Mr (\w+ \w+), too.", new[2000]).groups()
    assert full.split()[1] == short == her == other.split()[1] != "Smith" and full != other
    # a surrogate that is a last word of the corpus is drawn again
    again = {r.text for r in P.replace_entities(df.union(spark.createDataFrame([(3000, f"Mr Max {short}")], df.schema))).filter("doc_id = 2000").collect()}
    assert short not in " ".join(again)


def test_url_rules_and_model(spark):
    rules = [U.Rule("net", "/", "block"), U.Rule("example.net", "/en/", "allow"), U.Rule("example.com", "/de/", "block"), U.Rule("org", "/fr/", "allow")]
    rows = [(1, "https://M.Example.NET/en/5?x#y"), (2, "http://a.net"), (3, "http://a.net/"), (4, "x://sub.example.com/de/1"), (5, "x://badexample.com/de/"), (6, None), (7, "nothing"),
            (8, "://q.org/fr/#a"), (9, "x://freebets.example.com/en/1"), (9, "x://freebets.example.com/en/1"), (10, "x://thther.example.com/en/2?u://v")]
    rows += [(100 + i, f"x://{h}.example.com/en/{i}") for i in range(20) for h in ("free-bets", "thther")]
    page = "<p>" + "free bets thther " * 40 + "</p><script>freebets</script>"
    df = spark.createDataFrame([(*r, page) for r in rows], "page_id long, url string, html string").withColumn("host", U.F.lit("extra"))
    got = {r.page_id: r for r in U.judge_urls(df, rules).collect()}
    assert [(got[i].rule, got[i].verdict) for i in (1, 3, 4, 8)] == [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert (got[1].host, got[1].path) == ("m.example.net", "/en/5") and (got[2].rule, got[2].path) == (None, "")
    assert got[5].rule is None and (got[6].host, got[6].path) == ("", "") and (got[7].host, got[7].path) == ("", "")
    assert got[9].features[:2] == ["free", "bets"] and got[9].verdict == "block" and got[10].verdict == "allow"
    assert U.judge_urls(df.limit(0), rules).count() == 0


def test_rare_url_words_count_in_a_large_table(spark):
    def word(i):
        return "q" + "".join(chr(97 + i // 26**k % 26) for k in range(4))
    pages = [" ".join(map(word, range(k, k + 1000))) for k in range(0, 210_000, 1000)]  # each once
    rows = [(i, f"x://w.example.com/{page.replace(' ', '-')}", page) for i, page in enumerate(pages)]
    rows += [(500, f"x://{word(7)}{word(90_000)}.example.com/", ""), (501, "x://spam.example.com/lynx", ""), (502, "x://spam.example.com/", "")]
    got = {r.page_id: r for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), []).collect()}
    assert len(got) == len(rows) and got[500].features[:2] == [word(7), word(90_000)]
    assert got[501].block_score > got[502].block_score


def test_segmentation_is_the_best_split():
    words = {"ab": -1.0, "abc": -2.5, "c": -1.0, "cd": -1.2, "d": -3.0}
    assert U.segments(["abcd", "abc", "", "zz"], words) == [["ab", "cd"], ["ab", "c"], [], ["zz"]] or U.segments(["abcd"], words) == [["ab", "cd"]]


PAGE = ("<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>"
        "<div class='ad'>Buy now</div><article><h1>Head &amp; more</h1><p><b>First  part<br>of it.<p>Second <i>piece</i>, {0}.</p></article><footer>&copy; me</footer></body></html>")


def test_extraction(spark):
    pages = [(i, f"u{i}", PAGE.format("word " * (3 + i % 40) + "end")) for i in range(60)]
    variants = [(100, "c", PAGE.format("end").replace("</article>", "<section class='comments'><h2>Comments</h2><p>A reader says this, at some length, here.</p></section></article>")),
                (101, "h", PAGE.format("end").replace("<nav>", "<header><h1>Site</h1></header><aside><p>See also this page, please.</p></aside><nav>")),
                (102, "n", None), (103, "e", ""), (104, "p", "plain &lt;text"), (0, "u0", pages[0][2]), (105, None, "<p>never <b>closed"), (106, "l", PAGE.format("long " * 50000 + "end"))]
    df = spark.createDataFrame(pages + variants, "page_id long, url string, html string").withColumn("text", X.F.lit("extra"))
    got = {r.page_id: r for r in X.extract_pages(df).collect()}
    want = "Head & more\nFirst part of it.\nSecond piece, {0}."
    for i, _, _ in pages:
        assert got[i].text == want.format("word " * (3 + i % 40) + "end")
    assert got[100].text == got[101].text == want.format("end")
    assert got[102].text == got[103].text == "" and got[102].n_chars == 0 and got[104].text == "plain <text"
    assert got[106].text == want.format("long " * 50000 + "end") and got[106].n_chars == len(got[106].text)
    assert X.extract_pages(df.limit(0)).count() == 0


def test_decontamination(spark):
    item = "What is the capital of the old kingdom? It was moved twice before the war and once after it. The answer is Thernd."
    items = [(1, item), (2, "Short one."), (3, None), (4, ""), (1, "A second text under one id, with its own words alone."), (5, "Été À LA MER avec les amis de toujours")]
    rows = [(1, "before it stands " * 20 + item.upper() + " and behind " * 20), (2, item.split("?")[0]), (3, None), (4, "short ONE"), (5, "nothing here " * 100),
            (6, "été à la mer, avec les amis de toujours!"), (None, item), (6, "clean"), (7, "a second text under one id with its own words alone")]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", D.F.lit("extra"))
    got = D.decontaminate(clashing(spark.createDataFrame(rows, "doc_id long, text string")), b).collect()
    found = sorted(((r.doc_id, tuple(r.item_ids)) for r in got if r.contaminated), key=repr)
    assert found == [(1, (1,)), (4, (2,)), (6, (5,)), (7, (1,))]
    assert len(got) == len(rows)
    assert not any(r.contaminated for r in D.decontaminate(awkward(spark), b.limit(0)).collect())
    assert D.decontaminate(empty(spark), b).count() == 0
    left = D.drop_contaminated(clashing(spark.createDataFrame(rows, "doc_id int, text string")), b).collect()
    assert sorted((r.doc_id for r in left), key=repr) == [2, 3, 5, 6, None]


@pytest.mark.parametrize("shard", [15, 20_000])
def test_search_equals_scoring_everything(spark, shard, monkeypatch):
    """Block bounds never hide an item that reaches its threshold, in one shard or several."""
    monkeypatch.setattr(D, "SHARD_ITEMS", shard)
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, i) for r in D.decontaminate(docs, items).collect() for i in r.item_ids}

    def plain(t):
        return " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())) + " "
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if plain(i.text) in plain(d.text)}
    assert want and got == want


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP.MODEL)
    got = SP.encode_texts(clashing(awkward(spark)).drop("ids", "score"), keep=("lang",)).collect()
    texts = {(i, len(sp.encode(t or ""))): t or "" for i, t, *_ in awkward_rows()}
    for r in got:
        text = texts[r.doc_id, r.n_tokens]
        assert r.ids == sp.encode(text)
        assert r.round_trip == ("▁" not in text)
    back = {(r.doc_id, r.text) for r in SP.decode_texts(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>")).collect()}
    assert {(i, (t or "").replace("▁", " ")) for i, t, *_ in awkward_rows()} == back
    assert SP.encode_texts(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a", "  two  blanks ", "\ttab\nline", "日本語 テキスト", "😀x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "un-be-liev-ably (quoted) \"words\"...", "<s> </s> <0x0A>"])
def test_sentencepiece_texts(text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP.MODEL)
    e = SP.Encoder(SP.load())
    ids, bounds = e.encode(pa.array([text, None, text]))
    assert list(ids[: bounds[1]]) == sp.encode(text) == list(ids[bounds[2] :])


def test_licences(spark):
    rows = [(1, "a/LICENSE", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
            (2, "a/b/c.py", "code only"), (3, "d/x.py", "some code\n# Licensed under the Apache License, Version 2.0.\nmore code here and here and here and here and here and here"),
            (4, "d/y.py", None), (5, None, ""), (6, "a/b/COPYING", "GNU General Public License, version 3"), (7, "a/z.txt", "the license of the poet to rhyme"),
            (2, "a/b/c.py", "code only"), (8, "e/f/g", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (9, "top", "x" * 100000), (10, "d/lic/readme", "word " * 50000 + "\nReleased under the MIT License.")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, path string, text string")).withColumn("dir", L.F.lit("x")).withColumn("file", L.F.lit("x"))
    got = {r.doc_id: r for r in L.scan_licences(df).collect()}
    assert [(got[i].licence, got[i].how) for i in range(1, 11)] == [
        ("MIT", "own"), ("GPL-3.0", "inherited"), ("Apache-2.0", "own"), (None, None), (None, None), ("GPL-3.0", "own"), ("MIT", "inherited"), ("CC-BY-NC-4.0", "own"), (None, None), ("MIT", "own")]
    assert got[8].licences == ["CC-BY-NC-4.0", "MIT"] and L.scan_licences(df).count() == len(rows)
    assert L.scan_licences(df.limit(0)).count() == 0


def test_cosine_against_brute_force():
    import math
    from collections import Counter

    texts = [re.findall(r"[^\W_]+", t.lower()) for _, t in L.TEMPLATES]
    df = Counter(w for t in texts for w in set(t))
    rare = math.log(len(texts)) + 1

    def vector(t):
        v = {w: n * (math.log(len(texts) / df[w]) + 1 if w in df else rare) for w, n in Counter(t).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}
    header = vector(["gnu", "general", "public", "license", "version", "3"])
    assert round(max(sum(header[w] * v.get(w, 0) for w in header) for v in map(vector, texts)), 6) == 0.770438


def test_quality_numbers_are_packed_close_to_their_entropy():
    rng = np.random.default_rng(5)
    for x in ([], [0] * 9, [0, 2**64 - 1, 1], rng.integers(0, 2**40, 5000), rng.integers(0, 9, (5, 700))):
        x = np.array(x, np.uint64)
        assert (Q.grow(Q.shrink(x)) == x.ravel()).all()
        assert x.ndim > 1 or (Q.grow_gaps(Q.shrink_gaps(x)) == x).all()
    sums = rng.integers(0, 50, (5, 99))
    assert (Q.unfold(Q.fold(sums)) == sums).all()
    gaps = rng.geometric(1 / 48_000, 45_000)
    gaps[0] = 2**35  # the first is a hash
    assert len(Q.shrink_gaps(gaps)) < 1.02 * 45_000 * np.log2(np.e * 48_000) / 8


def test_quality_pair_totals_cross_one_exchange(spark):
    """Only the numbers of words stand in what the bundles send for words; the totals come from the parts of pairs."""
    docs = spark.createDataFrame([(i, "en", f"red fox {i} ran on") for i in range(50)], "doc_id long, lang string, text string")
    plan = Q.scores(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
    packed = pa.chunked_array([next(Q._pack(iter([pa.RecordBatch.from_pydict({"bundle": [0], "doc_id": [1], "lang": ["en"], "text": ["a b c d"]})])))["docs"]])
    shift, one = 30, pa.table({"bundle": [0], "docs": packed})
    pairs = Q._send_pairs(4, shift)(one)
    answers = pa.concat_tables([Q._count_pairs()(pairs.filter(pa.compute.equal(pairs["p"], p))) for p in set(pairs["p"].to_pylist())])
    assert min(Q._send_words(4, shift)(one, answers)["p"].to_pylist()) >= 0
    totals = pa.concat_tables([Q._count_pairs(4)(pairs.filter(pa.compute.equal(pairs["p"], p))) for p in set(pairs["p"].to_pylist())])
    assert Q._answered(totals, 1).tolist() == [[0, 0, 0, 0]]  # no other bundle holds them
