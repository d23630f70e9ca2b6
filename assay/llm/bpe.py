"""Byte-level BPE encoding and decoding.

Pre-tokens come from the array scan in ``pretokens``; each distinct one is merged
once per worker (a bounded cache) and its ids are reused. Byte offsets of the
tokens are kept, so any id range decodes to its place in the text.

Defined cases: a null text counts as empty and gives no ids; a text that is one
huge pre-token is merged with a heap in O(n log n); repeated rows give repeated
results; a text with invalid UTF-8 is read with U+FFFD in the bad places.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assay.llm.batches import map_chunks, texts_of
from assay.llm.pretokens import cut, ragged

#: Entries of a worker's cache; it is emptied when full (results don't depend on it).
CACHE_ENTRIES = 400_000
#: Longer pre-tokens (in bytes) are merged with a heap, and not kept.
SHORT = 32
#: Pre-tokens of like length (in bytes) are merged together.
LENGTHS = (0, 4, 8, 16, SHORT)
#: Ids that a worker's store holds before it is emptied.
STORED_IDS = 4_000_000


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Join the adjacent pair of the lowest rank, leftmost on ties, until none is left: a
    heap of pairs over a linked list."""
    n = len(piece)
    part: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = right[i]
        if part[i] is None or j >= n or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, None
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(both + part[k])) is not None:
                heapq.heappush(heap, (r, i, both + part[k]))
        h = left[i]
        if h >= 0 and (r := ranks.get(part[h] + both)) is not None:
            heapq.heappush(heap, (r, h, part[h] + both))
    return [p for p in part if p is not None]


class MergeTable:
    """All pairs of tokens that join to a token, for merging many pre-tokens at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.none = np.int32(max(ranks.values(), default=0) + 1)
        keys = {}
        for tok, rank in ranks.items():
            for i in range(1, len(tok)):
                a, b = ranks.get(tok[:i]), ranks.get(tok[i:])
                if a is not None and b is not None:
                    keys[a << 32 | b] = rank
        self.keys = np.array(sorted(keys), np.int64)
        self.values = np.array([keys[k] for k in self.keys.tolist()], np.int32)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], self.none)

    def merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pre-tokens (of at least two and at most a few dozen bytes) one after
        another, and how many each has."""
        size = np.array([len(r) for r in raw])
        width = int(size.max())
        flat = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in raw]), np.uint8).reshape(len(raw), width)
        ids = np.where(np.arange(width) < size[:, None], self.byte[flat], -1)
        pair = self.rank(ids[:, :-1], ids[:, 1:])
        out = np.full((len(raw), width), -1, np.int64)
        rows, col = np.arange(len(raw)), np.arange(width)
        while len(rows):
            at = pair.argmin(1)
            here = np.arange(len(rows))
            best = pair[here, at]
            done = best == self.none
            out[rows[done]] = ids[done]
            go = ~done
            rows, ids, pair, at, best = rows[go], ids[go], pair[go], at[go], best[go]
            if not len(rows):
                break
            here = np.arange(len(rows))
            late = col[1:-1] > at[:, None]
            ids[here, at] = best
            ids[:, 1:-1] = np.where(late, ids[:, 2:], ids[:, 1:-1])
            ids[here[at == width - 2], -1] = -1
            ids[at < width - 2, -1] = -1
            late = col[:-2] >= at[:, None]
            pair[:, :-1] = np.where(late, pair[:, 1:], pair[:, :-1])
            pair[:, -1] = self.none
            pair[here, at] = np.where(at < width - 1, self.rank(ids[here, at], ids[here, np.minimum(at + 1, width - 1)]), self.none)
            back = np.flatnonzero(at > 0)
            pair[back, at[back] - 1] = self.rank(ids[back, at[back] - 1], ids[back, at[back]])
        held = out >= 0
        return out[held], held.sum(1)


class ByteBPE:
    """Encoder and decoder over ranks: token bytes -> id, merged in the order of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.table = MergeTable(ranks)
        self._forget()
        self.shown: dict[str, tuple[int, bytes, bytes]] = {}

    @classmethod
    def from_file(cls, path: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _forget(self) -> None:
        self.known: dict[str, int] = {}             # place of a pre-token in the store
        self.flat = np.zeros(0, np.int32)           # the store: ids one after another
        self.size = np.zeros(0, np.int64)           # and how many each pre-token has

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the pre-tokens one after another, and how many each has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = np.array(list(map(self.ranks.get, raw, itertools.repeat(-1))), np.int64)
        length = np.array([len(r) for r in raw])
        size = np.ones(len(raw), np.int64)
        found = []
        for low, high in itertools.pairwise(LENGTHS):
            some = np.flatnonzero((whole < 0) & (length > low) & (length <= high))
            if len(some):
                ids, size[some] = self.table.merge([raw[k] for k in some.tolist()])
                found.append((some, ids))
        for k in np.flatnonzero((whole < 0) & (length > SHORT)).tolist():
            ids = np.array([self.ranks[p] for p in merge_long(raw[k], self.ranks)], np.int64)
            size[k] = len(ids)
            found.append((np.array([k]), ids))
        begin = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int32)
        single = np.flatnonzero(whole >= 0)
        flat[begin[single]] = whole[single]
        for some, ids in found:
            flat[ragged(begin[some], size[some])] = ids
        return flat, size

    def places_of(self, words: list[str]) -> np.ndarray:
        """Places of the pre-tokens in the store; those not met before are merged together."""
        if len(self.known) + len(words) > CACHE_ENTRIES or len(self.flat) > STORED_IDS:
            self._forget()
        at = np.array(list(map(self.known.get, words, itertools.repeat(-1))), np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            named = [words[k] for k in new.tolist()]
            flat, size = self.merged(named)
            first = len(self.size)
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
            at[new] = np.arange(first, first + len(new))
            self.known.update((w, k) for k, w in enumerate(named, first) if len(w) <= SHORT)
        return at

    def shown_of(self, words: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Of each pre-token: count of ids, the ids as decimals, and their bytes again."""
        got = list(map(self.shown.get, words))
        new = [k for k, x in enumerate(got) if x is None]
        flat, size = self.merged([words[k] for k in new])
        flat, ends = flat.tolist(), np.cumsum(size).tolist()
        for k, a, b in zip(new, [0, *ends], ends):
            ids = flat[a:b]
            got[k] = len(ids), " ".join(map(str, ids)).encode(), self.decode(ids)
        if len(self.shown) + len(new) > CACHE_ENTRIES:
            self.shown = {}
        self.shown.update((words[k], got[k]) for k in new if len(words[k]) <= SHORT)
        return got

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds of each text in them)."""
        own = cut(texts)
        if not own.words:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        at = self.places_of(own.words)[own.which]
        n = self.size[at]
        bounds = np.concatenate([[0], np.cumsum(n)])[own.bounds]
        return self.flat[ragged((np.cumsum(self.size) - self.size)[at], n)], bounds

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        ids, bounds = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Byte offset of each token in the encoded text, and its end."""
        return np.concatenate([[0], np.cumsum([len(self.token[i]) for i in ids], dtype=np.int64)])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@functools.cache
def bpe(path: str) -> ByteBPE:
    """One encoder per worker and rank file."""
    return ByteBPE.from_file(path)


def read_text(raw: bytes | None) -> str:
    return "" if raw is None else raw.decode("utf-8", "replace")


def bpe_encode(df: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids and byte offsets of every text: (id, ids array<int>, offsets array<long>)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = bpe(ranks_path)
        ids = own.encode_batch([read_text(t) for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.list_(pa.int32())),
             pa.array([own.offsets(x).tolist() for x in ids], pa.list_(pa.int64()))], [id_col, "ids", "offsets"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_chunks(texts_of(df, id_col, text=text_col), run,
                      f"`{id_col}` {kind}, ids array<int>, offsets array<bigint>", "text")


def bpe_decode(df: DataFrame, ranks_path: str, *, id_col: str = "doc_id") -> DataFrame:
    """Texts of ``bpe_encode``'s ids: (id, text binary); null ids give null."""
    kind = df.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, text binary"

    def run(it):
        own = bpe(ranks_path)
        for batch in it:
            raw = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [id_col, "text"])

    return df.select(id_col, "ids").mapInArrow(run, out)


def bpe_digest(df: DataFrame, ranks_path: str) -> DataFrame:
    """Encode every text and decode its ids again; per row the count of ids, the SHA-256
    of the ids written as decimals with one space between, and of the decoded bytes."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = bpe(ranks_path)
        cuts = cut([read_text(t) for t in batch.column("text").to_pylist()])
        each = own.shown_of(cuts.words)
        size = np.array([x[0] for x in each], np.int64)
        shown, bytes_of = [x[1] for x in each], [x[2] for x in each]
        n, ids, back = [], [], []
        for a, b in zip(cuts.bounds, cuts.bounds[1:]):
            which = cuts.which[a:b]
            n.append(int(size[which].sum()))
            which = which.tolist()
            ids.append(hashlib.sha256(b" ".join([shown[k] for k in which])).hexdigest())
            back.append(hashlib.sha256(b"".join([bytes_of[k] for k in which])).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_chunks(texts_of(df, "doc_id"), run,
                      "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "text")
