"""SentencePiece encoding and decoding in batches of numpy arrays.

The model's file gives pieces and scores (its path is a parameter; only arrays of the vocabulary's size go
to the tasks).  Text is cut into units wherever two neighbours stand side by side in no piece, so that no
piece crosses a cut; equal units are encoded once and kept in a bounded table per task.

Units of equal length advance together through a Viterbi pass: at each end position the hashes of all
substrings that end there probe the sorted piece keys, and the best admissible piece leaves a back-pointer.
For a merge model (BPE) a piece is admissible behind the last one of its prefix if the two would stay
apart when merged in order of score; exactly one path is admissible throughout, and it is the one that
merging gives, so the ids equal those of the sentencepiece library.  Adding up scores, as for a unigram
model, would not give the merge result.  Characters that are no piece become byte pieces.

Decoding joins the pieces' bytes, turns the blank mark into a blank and drops the one put in front.

Defined results: null text counts as empty and has no ids; rows that repeat are encoded alike; the blank
mark itself (U+2581) decodes as a blank; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textops import U64, map_slices, mix, text_buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
BASE = U64(0x9E3779B97F4A7C15)
LOOSE = -1
TABLE_UNITS = 400_000
SLICE_BYTES = 4 << 20  # of text at once: more units of one length advance together


@dataclass
class Vocabulary:
    """Arrays by piece: raw hash, length, rank (0 for single characters) and the two halves of its last merge."""

    raw: np.ndarray
    length: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    key: np.ndarray  # sorted
    key_id: np.ndarray
    longest: int
    byte_id: np.ndarray
    blob: np.ndarray
    blob_at: np.ndarray
    inside: np.ndarray  # by bigram hash: whether two characters stand side by side in some piece

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.key >> U64(44)).astype(np.int64)] = True

    def find(self, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; LOOSE where there is none."""
        k = mix(raw + length.astype(U64))
        out = np.full(len(k), LOOSE)
        some = np.flatnonzero(self.maybe[(k >> U64(44)).astype(np.int64)])  # most substrings end here
        at = np.minimum(np.searchsorted(self.key, k[some]), len(self.key) - 1)
        out[some] = np.where(self.key[at] == k[some], self.key_id[at], LOOSE)
        return out


def _powers(n: int) -> np.ndarray:
    p = np.full(n + 1, BASE, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _bigram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(U64) * U64(0x9E3779B1) + b.astype(U64)) * BASE >> U64(44)).astype(np.int64)


def _raw(code: np.ndarray) -> np.uint64:
    return np.sum((code.astype(U64) + U64(1)) * _powers(len(code))[:-1], dtype=U64)


def _merge(text: str, rank: dict[str, int]) -> list[tuple[str, tuple[int, int] | None]]:
    """Merging by rank, for the vocabulary's own pieces: what is left, with each one's last split."""
    parts: list[str | None] = list(text)
    cut: list = [None] * len(parts)
    nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = nxt[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[j] is None or parts[i] + parts[j] != both:
            continue
        cut[i], parts[i], parts[j] = (parts[i], parts[j]), both, None
        nxt[i] = nxt[j]
        if nxt[j] < len(parts):
            prv[nxt[j]] = i
        for a, b in ((prv[i], i), (i, nxt[i])):
            if a >= 0 and b < len(parts) and parts[a] + parts[b] in rank:
                heapq.heappush(heap, (rank[parts[a] + parts[b]], a, parts[a] + parts[b]))
    return [(p, c) for p, c in zip(parts, cut, strict=True) if p is not None]


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    piece = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    byte_id = np.full(256, sp.unk_id(), np.int32)
    for i in range(n):
        if sp.is_byte(i):
            byte_id[int(piece[i][3:5], 16)] = i
    order = sorted((i for i in plain if len(piece[i]) > 1), key=lambda i: -sp.get_score(i))
    rank_of = {piece[i]: k for k, i in enumerate(order, 1)}
    number = {piece[i]: i for i in plain}
    raw, length, rank = np.zeros(n, U64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, right, usable = np.full(n, LOOSE), np.full(n, LOOSE), []
    for i in plain:
        text = piece[i]
        raw[i], length[i], rank[i] = _raw(np.array([ord(c) for c in text])), len(text), rank_of.get(text, 0)
        if len(text) > 1:
            end = _merge(text, rank_of)
            if len(end) != 1 or any(h not in number for h in end[0][1]):
                continue  # merging never arrives at this piece
            left[i], right[i] = (number[h] for h in end[0][1])
        usable.append(i)
    ids = np.array(usable, np.int64)
    key = mix(raw[ids] + length[ids].astype(U64))
    by = np.argsort(key)
    blobs = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(chr(MARK), " ").encode() for i, p in enumerate(piece)]
    inside = np.zeros(1 << 20, bool)
    pairs = np.array([(ord(a), ord(b)) for i in plain for a, b in zip(piece[i], piece[i][1:], strict=False)])
    inside[_bigram(pairs[:, 0], pairs[:, 1])] = True
    return Vocabulary(raw, length, rank, left, right, key[by], ids[by], int(length.max()), byte_id,
                      np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)]), inside)


def apart(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pieces a and b, side by side, stay apart under merging: undo the later of the two merges
    that made them, again and again, and see whether the touching halves would have merged before it."""
    ok, todo = np.ones(len(a), bool), np.flatnonzero((a >= 0) & (b >= 0))
    a, b, limit = a.copy(), b.copy(), np.full(len(a), np.iinfo(np.int64).max)
    power = _powers(v.longest + 1)
    while len(todo):
        x, y = a[todo], b[todo]
        both = v.find(v.raw[x] + power[v.length[x]] * v.raw[y], v.length[x] + v.length[y])
        clash = (both >= 0) & (v.rank[both] < limit[todo])
        ok[todo[clash]] = False
        rx, ry = v.rank[x], v.rank[y]
        end = (rx == 0) & (ry == 0)
        undo_x = rx > ry
        go = ~clash & ~end
        # a merge on the left wins a tie of ranks against one further right
        limit[todo] = np.where(undo_x, rx, ry + 1)
        a[todo] = np.where(undo_x, v.right[x], x)
        b[todo] = np.where(undo_x, y, v.left[y])
        todo = todo[go]
    return ok


def viterbi(v: Vocabulary, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For units of one length (rows of ``code``): last piece and start of the best path at every end."""
    rows, n = code.shape
    power = _powers(n)
    sums = np.zeros((rows, n + 1), U64)
    np.cumsum((code.astype(U64) + U64(1)) * power[:n], axis=1, out=sums[:, 1:])
    inverse = np.full(n + 1, U64(pow(int(BASE), -1, 2**64)), U64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    last, back = np.full((rows, n + 1), -2), np.zeros((rows, n + 1), np.int64)  # -2: no path ends here
    for end in range(1, n + 1):
        for start in range(end - 1, max(-1, end - v.longest - 1), -1):
            own = np.flatnonzero(last[:, start] != -2) if start else np.arange(rows)
            size = end - start
            piece = v.find((sums[own, end] - sums[own, start]) * inverse[start], np.full(len(own), size))
            good = piece >= 0
            if size == 1:
                good[:] = True  # a character that is no piece stands for itself
            own, piece = own[good], piece[good]
            if start and len(own):
                stay = apart(v, last[own, start], piece)
                own, piece = own[stay], piece[stay]
            last[own, end], back[own, end] = piece, start  # at most one start is admissible
    return last, back


def encode_units(v: Vocabulary, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ids of the units code[start:end]."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(start)
    size = end - start
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        for part in np.array_split(own, -(-len(own) * int(n) // 200_000)):
            mat = code[start[part][:, None] + np.arange(n)]
            last, back = viterbi(v, mat)
            width = np.zeros(len(part), np.int64)
            steps = np.full((len(part), n), -2)
            at, rows = np.full(len(part), n), np.arange(len(part))
            while len(rows):  # walk back; positions count from the end
                piece, begin = last[rows, at[rows]], back[rows, at[rows]]
                steps[rows, width[rows]] = np.where(piece >= 0, piece, -3 - mat[rows, at[rows] - 1].astype(np.int64))
                width[rows] += 1
                at[rows] = begin
                rows = rows[at[rows] > 0]
            for k, i in enumerate(part):
                ids = steps[k, : width[k]][::-1]
                if (ids < 0).any():
                    ids = np.concatenate([[x] if x >= 0 else v.byte_id[list(chr(-3 - x).encode())] for x in ids])
                out[i] = ids.astype(np.int32)
    return out


class Encoder:
    """Encodes slices of texts, keeping the ids of units that it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._clear()

    def _clear(self):
        self.known: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.size = [], []

    def _learn(self, keys: list[int], code, start, end) -> None:
        for key, ids in zip(keys, encode_units(self.v, code, start, end), strict=True):
            self.known[key] = len(self.at)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.at.append(self.used), self.size.append(len(ids))
            self.used += len(ids)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's range in them."""
        texts = [t or "" for t in column.to_pylist()]
        code = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le"), np.uint32)
        code = np.where(code == 32, MARK, code)
        edge = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        first = np.zeros(len(code) + 1, bool)
        first[1:-1] = ~self.v.inside[_bigram(code[:-1], code[1:])]
        first[edge] = True
        start = np.flatnonzero(first[:-1])
        end = np.append(start[1:], len(code))
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        power = _powers(len(code))
        inverse = np.full(len(code) + 1, U64(pow(int(BASE), -1, 2**64)), U64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum((code.astype(U64) + U64(1)) * power[:-1])])
        key, at, back = np.unique(mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64)), return_index=True, return_inverse=True)
        if len(self.known) > TABLE_UNITS:
            self._clear()
        names = key.tolist()
        new = np.array([i for i, k in enumerate(names) if k not in self.known], np.int64)
        if len(new):
            self._learn([names[i] for i in new], code, start[at[new]], end[at[new]])
        slot = np.array([self.known[k] for k in names], np.int64)[back]
        begin, size = np.array(self.at)[slot], np.array(self.size)[slot]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(start, edge)]


def decode_ids(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of id sequences, without the blank in front, and each one's range in them."""
    size = np.diff(v.blob_at)[ids]
    upto = np.concatenate([[0], np.cumsum(size)])
    data = v.blob[np.repeat(v.blob_at[ids] - upto[:-1], size) + np.arange(upto[-1])]
    edge = upto[bounds]
    drop = np.zeros(len(data) + 1, bool)
    filled = edge[:-1][edge[1:] > edge[:-1]]
    drop[filled] = data[filled] == 32
    return data[~drop[:-1]], edge - np.concatenate([[0], np.cumsum(drop[:-1])])[edge]


def encode_texts(docs: DataFrame, path: str = MODEL, with_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (if asked for), n_tokens, ids_sha256 (of the ids as 32-bit
    little-endian numbers) and round_trip, whether decoding gives the text back; and the columns ``keep``."""
    model = docs.sparkSession.sparkContext.broadcast(load(path))
    state: dict[str, Encoder] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = state.setdefault("e", Encoder(model.value))
        ids, bounds = e.encode(batch.column("text"))
        back, edge = decode_ids(e.v, ids, bounds)
        data, was = text_buffers(batch.column("text"))
        whole, mine, raw = data.tobytes(), back.tobytes(), ids.astype("<i4").tobytes()
        n = range(batch.num_rows)
        same = [whole[was[i] : was[i + 1]] == mine[edge[i] : edge[i + 1]] for i in n]
        sha = [hashlib.sha256(raw[4 * bounds[i] : 4 * bounds[i + 1]]).hexdigest() for i in n]
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(bounds).astype(np.int64)), "ids_sha256": pa.array(sha), "round_trip": pa.array(same)}
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
        columns |= {c: batch.column(c) for c in keep}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    schema = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return map_slices(rows, "text", work, ", ".join([schema, *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)]), SLICE_BYTES)


def decode_texts(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` (doc_id, ids) as (doc_id, text); null ids give an empty text, ids outside the vocabulary fail."""
    model = encoded.sparkSession.sparkContext.broadcast(load(path))

    def work(batches):
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            flat, bounds = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
            data, edge = decode_ids(model.value, flat, bounds - bounds[0])
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")
