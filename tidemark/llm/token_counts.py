"""Token counts of whole texts: a two-tier look-up of pre-token lengths inside the map tasks.

A byte-level tokenizer splits a text into pre-tokens and merges inside each, so a text's count is the sum of
its pre-tokens' lengths.  First tier: a table of the most frequent pre-tokens with their lengths, made from
``SAMPLE_DOCS`` documents chosen by hash, at most ``TABLE`` entries, broadcast in compact form (one string, one
array).  Second tier: each worker keeps the pre-tokens that the table misses, up to ``CACHE``, and has the
library encode those that it hasn't met, a slice of texts at a time.  No pre-token is shuffled.  The sample decides
what is quick, never what comes out.

Texts that hold a string of an added token, or a character that the splitter and the library treat
differently, are encoded whole by the library; so are all texts of tokenizers of another kind (other JSON files,
sentencepiece models).

Defined results: null and empty texts have 0 bytes and 0 tokens; rows that repeat, or have no doc_id, are counted
each on its own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytebpe import PATTERN, Probed, is_plain, load_library, read_bytes, vocabulary_path
from tidemark.llm.textops import map_slices, slices, text_buffers

TOKENIZER = "byte_bpe_50k.json"
SAMPLE_DOCS = 4096
SAMPLE_TASKS = 8
TABLE = 1 << 16
CACHE = 1 << 19


class Lengths:
    """Token counts inside a worker."""

    def __init__(self, raw: bytes, kind: str, table: tuple[str, bytes] | None = None):
        self.first = dict(zip(*table_of(table), strict=True)) if table else {}
        self.known = dict(self.first)
        if kind == "model":
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_proto=raw)
            self.whole, self.split = (lambda t: len(library.encode(t))), None
            return
        import regex

        spec = json.loads(raw)
        self.library = load_library(raw)
        self.whole = lambda t: len(self.library.encode(t, add_special_tokens=False).ids)
        self.split = regex.compile(PATTERN).findall if is_plain(spec) else None
        self.added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        pre = self.library.pre_tokenizer
        self.probed = Probed(lambda s: [len(x) for x in self.split(s)] == [b - a for _, (a, b) in pre.pre_tokenize_str(s)])

    def pre_tokens(self, texts: list[str]) -> list[list[str] | None]:
        """Each text's pre-tokens; None where the library has to encode it whole."""
        if self.split is None:
            return [None] * len(texts)
        odd = self.probed.odd(texts)[0].tolist()
        return [None if o or any(a in t for a in self.added) else self.split(t) for t, o in zip(texts, odd, strict=True)]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > len(self.first) + CACHE:
            self.known = dict(self.first)
            new = [w for w in words if w not in self.known]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.known.update(zip(part, map(len, self.library.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        split = self.pre_tokens(texts)
        self.learn(set().union(*(s for s in split if s is not None)))
        return [self.whole(t) if s is None else sum(map(self.known.__getitem__, s)) for t, s in zip(texts, split, strict=True)]


def table_of(packed: tuple[str, bytes]) -> tuple[list[str], list[int]]:
    """Pre-tokens and lengths of a packed table; a NUL never stands inside a listed pre-token."""
    words, sizes = packed
    return (words.split("\0") if words else []), np.frombuffer(sizes, np.uint16).tolist()


def frequent(docs: DataFrame, raw: bytes) -> tuple[str, bytes]:
    """The packed first tier: of the sampled documents' shares, each one's most frequent pre-tokens."""
    step = max(docs.count() // SAMPLE_DOCS, 1)
    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).repartition(SAMPLE_TASKS)

    def work(batches):
        lengths, seen = Lengths(raw, "json"), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for words in lengths.pre_tokens([t or "" for t in part.column("text").to_pylist()]):
                    seen.update(words or ())
        best = [w for w, _ in seen.most_common(TABLE // SAMPLE_TASKS) if "\0" not in w]
        lengths.learn(set(best))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array([lengths.known[w] for w in best], pa.int32())], names=["word", "size"])
    table = {r.word: r.size for r in sample.mapInArrow(work, "word string, size int").collect() if r.size < 1 << 16}
    return "\0".join(table), np.array(list(table.values()), np.uint16).tobytes()


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``)."""
    path = path or vocabulary_path(TOKENIZER)
    raw, kind = read_bytes(path), path.rsplit(".", 1)[-1]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = frequent(texts, raw) if kind == "json" and is_plain(json.loads(raw)) else None
    shipped = docs.sparkSession.sparkContext.broadcast((raw, kind, table))
    state: dict[str, Lengths] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = state["l"] if "l" in state else state.setdefault("l", Lengths(*shipped.value))
        n = np.array(lengths.count([t or "" for t in batch.column("text").to_pylist()]), np.int64)
        size = np.diff(text_buffers(batch.column("text"))[1])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return map_slices(texts, "text", work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
