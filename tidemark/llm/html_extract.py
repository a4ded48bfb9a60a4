"""Main text of web pages: boosted trees over DOM nodes, then a decoding that keeps the tree consistent.

A page becomes a tree of block elements; the text between their tags forms its leaves (*segments*, with
inline elements dissolved).  Every node and segment has statistics of its subtree (text length, text and
tags, link share), its place (depth, order), its siblings (number, mean length), the tokens of its tag,
class, id and role, and the nearest landmark: the closest ancestor, itself included, whose tokens speak
for an article or against it.

The trees are fitted here on ``TRAIN_PAGES`` pages, chosen by hash, with labels that the pages' own
landmarks give: a node counts as main text when most of its text stands nearest to a content landmark.
Each training page appears three times: as it is; with landmarks and tokens hidden, so that pages
without landmarks are judged by density, place and siblings; and with its paragraphs repeated under
boilerplate landmarks.

Decoding picks, for every node, keep all, drop all, or leave it to the children, so that the summed log
odds are best; a dropped node has no kept descendant and a kept one no dropped descendant.

Scripts, styles, text areas and titles are skipped to their end tag (or the end of the page, as browsers do); form controls,
pictures and frames only lose their own inline text, so that nothing behind one that isn't closed is lost; formulas and
fallback content are text.

Defined results: null or empty html gives empty text; markup that is never closed ends with the page;
rows that repeat are extracted each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import trees
from tidemark.llm.textops import map_slices

TRAIN_PAGES = 400
BUCKETS = 16
MIXED = 1.0

#: Elements by their role in HTML.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
                  "tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to the end tag, or else the end of the page, is no text of the page; for the second group only where an end tag follows.
RAW, RAW_IF_CLOSED = frozenset("script style textarea title".split()), frozenset("head noscript template".split())
#: Controls and pictures: their own inline text is left out, up to their end tag or the next block tag.
MUTE = frozenset("svg iframe select button option".split())
UNMUTE = {t: {t, "select", "datalist", "optgroup"} if t == "option" else {t} for t in MUTE}
CLOSES_P = BLOCK - {"html", "body"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Tokens of tags, classes, ids and roles that speak for or against main text.
CONTENT = frozenset("article main content post entry story articlebody maincontent body_text posttext".split())
BOILER = frozenset("nav menu navbar navigation header footer aside sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo "
                   "banner notice cookie cookies consent gdpr popup modal overlay form login signup subscribe newsletter search comment "
                   "comments commentlist disqus reply replies respond share sharing social related recommended recommendations breadcrumb "
                   "breadcrumbs pagination pager toolbar widget masthead copyright legal tags byline metadata alert contentinfo "
                   "complementary dialog toc skip hidden".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>", re.S)
ATTR = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")


class Page:
    """Block tree of a page: per node its tag, tokens, parent and own segments in order."""

    def __init__(self, html: str):
        self.parent, self.tag, self.tokens, self.tags = [-1], ["html"], [[]], [0]
        self.children: list[list[tuple[bool, int]]] = [[]]  # (is a segment, index)
        self.segment: list[str] = []
        self.linked: list[int] = []
        self._read(html)

    def _open(self, tag: str, attributes: str, at: int) -> int:
        tokens = [t for m in ATTR.finditer(attributes) for t in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()) if t] if attributes else []
        self.parent.append(at), self.tag.append(tag), self.tokens.append(tokens), self.tags.append(0), self.children.append([])
        self.children[at].append((False, len(self.tag) - 1))
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        at, pos, links = 0, 0, 0
        buffer: list[str] = []
        linked = 0
        mute = ""

        def flush():
            nonlocal linked
            text = SPACE.sub(" ", entities.unescape("".join(buffer))).strip() if buffer else ""
            if text:
                self.children[at].append((True, len(self.segment)))
                self.segment.append(text)
                self.linked.append(linked)
            buffer.clear()
            linked = 0

        def close(tags, scope) -> int:
            node = at
            while node > 0:
                if self.tag[node] in tags:
                    return self.parent[node]
                if self.tag[node] in scope:
                    return -1
                node = self.parent[node]
            return -1

        while True:
            m = TAG.search(html, pos)
            stop = m.start() if m else len(html)
            if stop > pos and not mute:
                buffer.append(html[pos:stop])
                if links:
                    linked += stop - pos
            if not m:
                break
            pos = m.end()
            start, end = m[1], m[3]
            if start:
                tag = start.lower()
                if tag in RAW or tag in RAW_IF_CLOSED:
                    over = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, pos)
                    if over or tag in RAW:
                        pos = over.end() if over else len(html)
                elif tag in MUTE:
                    self.tags[at] += 1
                    if not mute and not m[2].rstrip().endswith("/"):
                        mute = tag
                        buffer.append(" ")
                elif tag in BLOCK:
                    flush()
                    mute = ""
                    links = 0
                    if tag in CLOSES_P and (up := close({"p"}, BLOCK - {"p"})) >= 0:
                        at = up
                    if tag in CLOSED_BY and (up := close(CLOSED_BY[tag], SCOPE[tag])) >= 0:
                        at = up
                    self.tags[at] += 1
                    if tag not in VOID and tag not in ("html", "body"):
                        at = self._open(tag, m[2], at)
                else:
                    self.tags[at] += 1
                    if tag == "br":
                        buffer.append(" ")
                    elif tag == "a":
                        links += 1
            elif end:
                tag = end.lower()
                if mute and (tag in UNMUTE[mute] or tag in BLOCK):
                    mute = ""
                if tag == "a":
                    links = max(0, links - 1)
                elif tag in BLOCK and tag not in ("html", "body") and (up := close({tag}, ())) >= 0:
                    flush()
                    at, links = up, 0
        flush()


FIXED = 16
WIDTH = FIXED + BUCKETS


def _landmark(tokens) -> int:
    if any(t in BOILER for t in tokens):
        return -1
    return 1 if any(t in CONTENT for t in tokens) else 0


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Rows for nodes, then segments: statistics, and each one's nearest landmark."""
    n, k = len(page.tag), len(page.segment)
    size, link, tags, mark, depth = np.zeros(n), np.zeros(n), np.array(page.tags, float), np.zeros(n, int), np.zeros(n)
    length = np.array([len(s) for s in page.segment], float)
    linked = np.minimum(np.array(page.linked, float), length)
    for i in range(1, n):
        own = _landmark([page.tag[i], *page.tokens[i]])
        mark[i], depth[i] = own or mark[page.parent[i]], depth[page.parent[i]] + 1
    owner = np.zeros(k, int)
    for i in range(n - 1, -1, -1):
        for seg, j in page.children[i]:
            if seg:
                owner[j] = i
                size[i] += length[j]
                link[i] += linked[j]
        if i:
            up = page.parent[i]
            size[up] += size[i]
            link[up] += link[i]
            tags[up] += tags[i]
    x = np.zeros((n + k, WIDTH))
    parent = np.concatenate([np.maximum(np.array(page.parent), 0), owner])
    full, ref = np.concatenate([size, length]), np.concatenate([link, linked])
    count = np.array([len(c) for c in page.children], float)
    x[:, 0] = np.log1p(full)
    x[:, 1] = ref / np.maximum(full, 1)
    x[:, 2] = np.concatenate([size / (tags + 1), length])
    x[:, 3] = np.concatenate([depth, depth[owner] + 1])
    x[:, 4] = count[parent]
    x[:, 5] = full[parent] / np.maximum(count[parent], 1)  # siblings' mean length
    x[:, 6] = full / np.maximum(full[0], 1)
    x[:, 7] = ref[parent] / np.maximum(full[parent], 1)
    x[:, 8] = np.concatenate([np.zeros(n), np.ones(k)])
    x[:, 9] = np.concatenate([np.arange(n) / max(n, 1), owner / max(n, 1)])
    x[:, 10] = np.concatenate([np.zeros(n), [sum(map(s.count, ".,;:?!")) / len(s) for s in page.segment]])
    x[:, 11] = np.concatenate([tags, np.zeros(k)])
    names = [*page.tag, *(page.tag[o] for o in owner)]
    x[:, 12] = [t == "p" for t in names]
    x[:, 13] = [t in ("h1", "h2", "h3", "h4") for t in names]
    x[:, 14] = [t in ("li", "ul", "ol", "td", "table") for t in names]
    landmark = np.concatenate([mark, mark[owner]])
    x[:, 15] = landmark
    for i in range(n):
        for t in page.tokens[i]:
            x[i, FIXED + zlib.crc32(t.encode()) % BUCKETS] = 1
    return x, landmark


def disturbed(html: str, page: Page, rng: np.random.Generator) -> str:
    """A variant of a training page: its own paragraphs stand once more under boilerplate landmarks, inside
    and outside the article, and the article may be a ``main``.  Only the landmark tells them apart."""
    words = sorted(BOILER)
    texts = sorted(page.segment, key=len)[len(page.segment) // 2 :] or [""]

    def extra(_):
        token, body = words[rng.integers(len(words))], entities.escape(texts[rng.integers(len(texts))])
        tag = token if token in BLOCK else "div"
        return f'<{tag} class="{token}"><h2>{body[:30]}</h2><p>{body}</p></{tag}>'
    spots = [m.start() for m in re.finditer(r"<(?:p|article|footer|/body)\b", html)] or [len(html)]
    cuts = sorted(rng.choice(spots, min(4, len(spots)), replace=False))
    out = "".join(html[a:b] + extra(b) for a, b in zip([0, *cuts], cuts, strict=False)) + html[cuts[-1] :]
    return re.sub(r"<(/?)article\b", r"<\1main", out) if rng.random() < 0.3 else out


def labelled(page: Page) -> tuple[np.ndarray, np.ndarray] | None:
    x, landmark = features(page)
    n = len(page.tag)
    good, all_ = np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        for seg, j in page.children[i]:
            if seg:
                all_[i] += len(page.segment[j])
                good[i] += len(page.segment[j]) * (landmark[n + j] > 0)
        if i:
            all_[page.parent[i]] += all_[i]
            good[page.parent[i]] += good[i]
    if not good[0]:
        return None  # a page without a content landmark teaches nothing
    y = np.concatenate([good > 0.5 * all_, landmark[n:] > 0]).astype(float)
    return x[1:], y[1:]


def training_rows(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rng, xs, ys = np.random.default_rng(5), [], []
    for html in pages:
        page = Page(html)
        if (rows := labelled(page)) is None:
            continue
        hidden = rows[0].copy()
        hidden[:, 15:] = 0
        varied = labelled(Page(disturbed(html, page, rng))) or rows
        xs += [rows[0], hidden, varied[0]]
        ys += [rows[1], rows[1], varied[1]]
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros((0, WIDTH)), np.zeros(0))


def decode(page: Page, odds: np.ndarray) -> list[int]:
    """Segments to keep, in page order, by the best consistent labelling of the tree."""
    n = len(page.tag)
    if n == 1:  # no block element at all: plain text
        return [j for _, j in page.children[0]]
    keep, best = np.zeros(n), np.zeros(n)
    choice = [""] * n
    for i in range(n - 1, -1, -1):
        total = odds[i] if i else 0.0  # log odds of keeping everything, against dropping everything
        free = 0.0
        for seg, j in page.children[i]:
            o = odds[n + j] if seg else keep[j]
            total += o
            free += max(o, 0.0) if seg else best[j]
        keep[i] = total
        mixed = free - (MIXED if i else 0.0)
        best[i] = max(0.0, total, mixed)
        choice[i] = "mixed" if i == 0 or mixed > max(0.0, total) else "keep" if total > 0 else "drop"
    out: list[int] = []
    stack = [(0, "mixed")]
    while stack:
        i, how = stack.pop()
        if how == "segment":
            out.append(i)
            continue
        for seg, j in reversed(page.children[i]):
            if seg:
                if how == "keep" or odds[n + j] > 0:
                    stack.append((j, "segment"))
            else:
                turn = "keep" if how == "keep" else choice[j]
                if turn != "drop":
                    stack.append((j, turn))
    return out


def extract(html: str, model: trees.Boosted) -> str:
    page = Page(html)
    if not page.segment:
        return ""
    return "\n".join(page.segment[j] for j in decode(page, model.score(features(page)[0])))


def fit_model(pages: DataFrame) -> trees.Boosted:
    """Fit on the ``TRAIN_PAGES`` different pages of least hash, whatever the number of pages.  Tasks send
    hashes, not pages, until the sample is known."""
    hashed = pages.filter("html IS NOT NULL").select("html", F.xxhash64("html").alias("h"))
    cut = hashed.select("h").distinct().orderBy("h").limit(TRAIN_PAGES).agg(F.max("h").alias("h")).first().h
    some = hashed.filter(F.col("h") <= F.lit(cut)).dropDuplicates(["h"]).collect() if cut is not None else []
    return trees.fit(*training_rows([r.html for r in sorted(some, key=lambda r: r.h)]))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text and n_chars (its code points)."""
    model = pages.sparkSession.sparkContext.broadcast(fit_model(pages))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = [Page(h or "") for h in batch.column("html").to_pylist()]
        rows = [features(p)[0] for p in read]
        edge = np.cumsum([0, *map(len, rows)])
        odds = model.value.score(np.concatenate(rows))
        text = ["\n".join(p.segment[j] for j in decode(p, odds[a:b])) for p, a, b in zip(read, edge[:-1], edge[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                          names=["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_slices(rows, "html", work, "page_id long, url string, text string, n_chars long")
