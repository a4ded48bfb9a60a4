"""Cases that once lost text or items, or never came to an end."""

import random
import re

import pytest

from tidemark.llm import decontamination as D
from tidemark.llm.html_extract import Page
from tidemark.llm.pii_surrogates import replace_entities

# ------------------------------------------------------------------ pages


@pytest.mark.parametrize("html,want", [
    ("<article><p>One</p><svg/><p>Two</p></article>", ["One", "Two"]),
    ("<article><p>One</p><svg><path d='M0'/><title>icon</title><p>Two</p></article>", ["One", "Two"]),
    ("<article><p>One</p><button>Click<p>Two</p></article>", ["One", "Two"]),
    ("<p>One <button>Click</button> two</p>", ["One two"]),
    ("<datalist><option>A<option>B</datalist><p>One</p>", ["One"]),
    ("<p>One<select><option>x<option>y</select> two</p><p>Three</p>", ["One two", "Three"]),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p>", ["Let x=2 hold"]),
    ("<p>See <object data=a.pdf>the file</object> and <canvas>the drawing</canvas></p>", ["See the file and the drawing"]),
    ("<p>One<noscript>Enable scripts</noscript> two</p><noscript><p>Three</p>", ["One two", "Three"]),
    ("<template><p>hidden</p></template><p>One</p>", ["One"]),
    ("<p>One</p><iframe src=a>frame</iframe><p>Two</p><iframe src=b><p>Three</p>", ["One", "Two", "Three"]),
    ("<p>One</p><script>var a = '<p>no</p>'", ["One"]),
    ("<textarea>typed</textarea><p>One &amp; two</p>", ["One & two"]),
    ("<head><title>T</title><p>One</p>", ["One"]),
])
def test_no_text_is_lost_behind_an_open_element(html, want):
    assert Page(html).segment == want


# ------------------------------------------------------------------ surrogates

def test_long_and_hostile_texts_end(spark):
    """A megabyte of labels behind an @, of digits, of quotes and of one word; nulls; nothing overflows the stack."""
    rows = [(1, "x@" + "a." * 400_000), (2, "x@" + "z" * 1_000_000 + ".com"), (3, "+12 " + "34 " * 300_000), (4, '"' * 500_000), (5, "1" * 1_000_000), (6, None), (7, "me@" + "ab." * 30 + "org"), (8, "0f" * 200_000)]
    got = {r.doc_id: r for r in replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == rows[1][1]  # no addresses: labels without end, a label of a megabyte
    assert got[8].entities == "secret=1" and len(got[8].text) == 400_000 and re.fullmatch("[0-9a-f]+", got[8].text) and got[8].text != rows[7][1]
    assert got[7].entities == "email=1" and got[7].text.endswith(".org") and got[6].text == "" and got[4].text == rows[3][1]


def test_dense_entities_stay_distinct(spark):
    """More phone numbers of one form than the form has other values for: the draw ends, and all are told apart."""
    rng = random.Random(2)
    numbers = [f"+12 {n // 100:02d} {n % 100:02d}" for n in rng.sample(range(10_000), 6000)]
    out = replace_entities(spark.createDataFrame([(i, f"call {n} now") for i, n in enumerate(numbers)], "doc_id long, text string")).collect()
    new = [re.fullmatch(r"call (\+12 \d\d \d\d\d*) now", r.text)[1] for r in out]
    assert len(set(new)) == 6000 and not set(new) & set(numbers)


def test_the_key_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "mail anna.lee@mail.example.org or 10.1.2.3"), (2, "ANNA.lee@mail.example.org")], "doc_id long, text string")
    one, two, again = ([r.text for r in replace_entities(docs, k).orderBy("doc_id").collect()] for k in ("a", "b", "a"))
    assert one == again and one[0] != two[0]
    assert one[0].split()[1].lower() == one[1].lower()


# ------------------------------------------------------------------ benchmark items

def sentence(rng, n):
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randrange(10**6)}" for _ in range(n))


def test_long_items_and_short_questions_are_found(spark):
    """Against a brute-force scoring of every pair on words: an item of 600 words, a short question with a long answer, and parts of them."""
    rng = random.Random(8)
    texts = [f"{sentence(rng, 300)}? {sentence(rng, 300)}.", f"{sentence(rng, 9)}? {sentence(rng, 60)}.", f"{sentence(rng, 40)}? {sentence(rng, 2)}.", sentence(rng, 30), f"{sentence(rng, 12)}? {sentence(rng, 20)}."]
    items = list(enumerate(texts, 10))
    filler = [sentence(rng, 200) for _ in range(40)]
    docs, parts = [], [D.split_item(t) for t in texts]
    for t, (q, a) in zip(texts, parts):
        for part in (t, q, a, q[: len(q) // 2], t[len(t) // 3 :], q + " " + a[: len(a) // 2], ""):
            docs.append(f"{rng.choice(filler)} {part.upper()} {rng.choice(filler)}")
    docs += [*filler, texts[0] + " " + texts[1], None, ""]
    got = {(r.doc_id, i) for r in D.decontaminate(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() for i in r.item_ids}

    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def grams(t):
        w = words(t)
        n = min(D.GRAM, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    want = set()
    for d, text in enumerate(docs):
        held = grams(text)
        for (i, _), (q, a) in zip(items, parts):
            gq, ga = grams(q), grams(a)
            q_in, a_in = len(gq & held), len(ga & held)
            if q_in >= D.QUESTION * len(gq) or (ga and q_in + a_in >= D.BOTH * (len(gq) + len(ga))):
                want.add((d, i))
    assert got == want and {i for _, i in want} == {i for i, _ in items} and len(want) > 15
