"""A byte-level BPE tokenizer from its JSON file, for use inside tasks.

The driver reads the file and ships its bytes, so executors need the library but not the path.  The library
itself is exact but slow; a quicker splitter or encoder may stand in for it wherever both treat every
character alike.  Which characters those are is not assumed: each code point is probed once per worker, in
front of and behind a letter, a digit, a symbol and a blank, and texts with a code point that differs go to
the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import Path

import numpy as np

# The split in front of the merges of byte-level tokenizers of this family, and the length of
# a run without a change between blank and other characters from which on the library encodes a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_RUN = 1000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_bytes(path: str) -> bytes:
    return Path(path).read_bytes()


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it prints, else the next free code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_library(raw: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_str(raw.decode())


def is_plain(spec: dict) -> bool:
    """Whether the file describes the plain kind: no normalizer, the usual split, BPE over bytes."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (spec.get("normalizer") is None and spec.get("truncation") is None and spec.get("padding") is None and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
            and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))


class Probed:
    """Tells which texts hold a code point that ``same`` finds to be treated differently."""

    def __init__(self, same: Callable[[str], bool]):
        self.same, self.seen, self.differs = same, np.zeros(0x110000, bool), np.zeros(0x110000, bool)

    def odd(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text whether the library has to take it; also all code points and the texts' edges in them."""
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        edge = np.cumsum([0, *map(len, texts)])
        if not self.seen[code].all():
            for c in np.unique(code[~self.seen[code]]).tolist():
                x = chr(c)
                self.seen[c], self.differs[c] = True, not self.same(f"a{x}b1{x}2!{x}? {x}  {x}\n{x}{x}a")
        out = np.zeros(len(texts), bool)
        if len(code):
            out[np.searchsorted(edge, np.flatnonzero(self.differs[code]), "right") - 1] = True
        return out, code, edge


class Encoder:
    """Ids of whole texts; special tokens' strings are ordinary text."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        self.library = load_library(raw)
        self.library.encode_special_tokens = True
        letters = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        tokens = {t: t.encode() if t in special or not all(c in letters for c in t) else bytes(letters[c] for c in t) for t in vocabulary}
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        blobs = [b""] * self.size
        for t, i in vocabulary.items():
            blobs[i] = tokens[t]
        self.blob, self.blob_at = np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)])
        self.fast = self._fast(spec, vocabulary, tokens, special)
        self.probed = Probed(lambda s: self.fast is not None and self.fast.encode_ordinary(s) == self._exact(s))

    def _fast(self, spec, vocabulary, tokens, special):
        """A merge-by-rank encoder, where ids follow the order of the merges."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", [])]
        ids = [vocabulary.get(a + b, -1) for a, b in merges]
        if not is_plain(spec) or ids != sorted(set(ids)) or len(ids) + 256 + len(special & set(vocabulary)) != len(vocabulary):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={tokens[t]: i for t, i in vocabulary.items() if t not in special}, special_tokens={})

    def _exact(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        slow, code, edge = self.probed.odd(texts)
        turn = np.flatnonzero(np.diff(np.isin(code, (9, 10, 13, 32)).astype(np.int8))) + 1
        stop = np.union1d(turn, edge)
        slow[np.searchsorted(edge, stop[:-1][np.diff(stop) > LONG_RUN], "right") - 1] = True
        return [self._exact(t) if s else self.fast.encode_ordinary(t) for t, s in zip(texts, slow.tolist(), strict=True)]
