"""Best-fit-decreasing packing of tokenised documents into fixed windows.

A document's ids (with an end id) longer than a window are cut into full windows first;
what remains is packed in decreasing length into the open window with the least room
that still holds it. A segment tree over the remaining capacities finds that window.

Documents are packed where they are read, in groups of about ``GROUP_TOKENS`` ids, so
nothing is shuffled and a task's memory is bounded; a task that runs again packs the
same windows under the same numbers.

Added tokens of the tokenizer's file that a text holds literally become their ids, as the
library does by default.

Defined cases: a null or empty text is a document of the end id alone; a document of any
length is cut without loss; repeated rows are packed as documents of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from assay.llm.batches import chunks, release, texts_of
from assay.llm.bpe import ByteBPE, read_text
from assay.session import ship_package

WINDOW = 2048
END_ID = 1
GROUP_TOKENS = 6_000_000
#: Text bytes encoded at a time: the arrays of a text's code points take about 60 times that.
PART_BYTES = 1 << 20


class CapacityTree:
    """Which remaining capacities have an open window; finds the least one that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += change
            i >>= 1

    def least(self, need: int) -> int:
        """The least room >= need that an open window has, or -1."""
        i, count = self.leaves + need, self.count
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def pack(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window number, offset) of documents by length."""
    out, used = [], 0
    rest = []
    for d, n in enumerate(lengths.tolist()):
        full = n // window
        for k in range(full):
            out.append((d, k * window, window, used, 0))
            used += 1
        if n % window:
            rest.append((n % window, d, full * window))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, rooms = CapacityTree(window), [[] for _ in range(window + 1)]
    for n, d, start in rest:
        room = tree.least(n)
        if room < 0:
            w, room = used, window
            used += 1
        else:
            w = rooms[room].pop()
            tree.add(room, -1)
        out.append((d, start, n, w, window - room))
        if room > n:
            rooms[room - n].append(w)
            tree.add(room - n, 1)
    return out


def _bytes_of(token: str) -> bytes:
    """Bytes of a token as the vocabulary file writes them: printable stand-ins."""
    return bytes(_stand_ins()[c] for c in token)


@functools.cache
def _stand_ins() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WithAdded:
    """An encoder that turns the file's added tokens in a text into their ids first, the
    longest at the leftmost place; the texts between them are encoded each on its own."""

    def __init__(self, own: ByteBPE, added: list[dict]):
        self.own = own
        self.ids = {t["content"]: t["id"] for t in added if t["content"]}
        by_size = sorted((t for t in added if t["content"]), key=lambda t: -len(t["content"]))
        self.pattern = re.compile("|".join(map(_pattern_of, by_size)) or r"(?!)")

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds of each text in them)."""
        held = [k for k, t in enumerate(texts) if any(c in t for c in self.ids)]
        if not held:
            return self.own.encode_flat(texts)
        parts, first, tokens = [], [0], []
        held = set(held)
        for k, t in enumerate(texts):
            at = 0
            for m in self.pattern.finditer(t) if k in held else ():
                parts.append(t[at:m.start()])
                tokens.append((len(parts), self.ids[m[m.lastindex]]))
                at = m.end()
            parts.append(t[at:])
            first.append(len(parts))
        flat, ends = self.own.encode_flat(parts)
        after = np.array([k for k, _ in tokens], np.int64)
        flat = np.insert(flat, ends[after], [i for _, i in tokens])
        first = np.array(first)
        return flat, ends[first] + np.searchsorted(after, first)


def _pattern_of(token: dict) -> str:
    """The regular expression of an added token; the content is a group."""
    found = f"({re.escape(token['content'])})"
    if token.get("single_word"):
        found = rf"(?<!\w){found}(?!\w)"
    return (r"\s*" if token.get("lstrip") else "") + found + (r"\s*" if token.get("rstrip") else "")


@functools.cache
def tokenizer(path: str) -> WithAdded:
    """Encoder over a byte-level BPE file of the tokenizers library, its added tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens") or []
    special = {t["content"] for t in added}
    return WithAdded(ByteBPE({_bytes_of(t): i for t, i in spec["model"]["vocab"].items() if t not in special}), added)


def groups(it, path: str, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS):
    """(names of the documents, their token ids in one array, their sizes) of about
    ``group_tokens`` ids; a name is the row's first column, or a tuple of all but the text."""
    names, flats, sizes, total = [], [], [], 0
    own = tokenizer(path)
    for batch in it:
        for part in chunks(batch, "text", PART_BYTES):
            texts = [read_text(t) for t in part.column("text").to_pylist()]
            ids, bounds = own.encode_flat(texts)
            n = np.diff(bounds)
            flat = np.insert(ids, bounds[1:], end_id).astype(np.uint32)
            own_names = [c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True) if n != "text"]
            names += own_names[0] if len(own_names) == 1 else zip(*own_names, strict=True)
            flats.append(flat)
            sizes.append(n + 1)
            total += len(flat)
            if total >= group_tokens:
                yield names, np.concatenate(flats), np.concatenate(sizes)
                names, flats, sizes, total = [], [], [], 0
                release()
    if names:
        yield names, np.concatenate(flats), np.concatenate(sizes)
    del names, flats, sizes
    release()


def _first_number() -> int:
    return TaskContext.get().partitionId() << 32


def _pack_apart(sizes: np.ndarray, kinds: list, window: int) -> list[tuple[int, int, int, int, int]]:
    """``pack`` over the documents of each kind alone, windows numbered on."""
    members: dict = {}
    for d, kind in enumerate(kinds):
        members.setdefault(kind, []).append(d)
    out, used = [], 0
    for some in members.values():
        pieces = pack(sizes[some], window)
        out += [(some[d], start, n, used + w, offset) for d, start, n, w, offset in pieces]
        used += 1 + max(w for _, _, _, w, _ in pieces)
    return out


def pack_documents(df: DataFrame, tokenizer_path: str, *, window: int = WINDOW, end_id: int = END_ID,
                   by: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    With ``by`` a window holds documents of one value of that column (a string, or null)."""
    ship_package(df.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(it):
        number = _first_number()
        for docs, flat, sizes in groups(it, tokenizer_path, end_id):
            begin = np.cumsum(sizes) - sizes
            if by is None:
                pieces = pack(sizes, window)
            else:
                docs, kinds = zip(*docs, strict=True)
                pieces = _pack_apart(sizes, kinds, window)
            d, start, n, w, offset = np.array(pieces, np.int64).T
            del pieces
            raw = memoryview(flat.astype("<u4", copy=False)).cast("B")
            at = 4 * (begin[d] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * n).tolist(), strict=True)]
            ids = pa.array(docs, pa.int64()).take(pa.array(d))
            yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(n), pa.array(crc, pa.int64()),
                                              pa.array(sizes[d].astype(np.int64)), pa.array(w + number), pa.array(offset)], names)
            number += int(w.max()) + 1

    return texts_of(df, "doc_id", *([by] if by else [])).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
