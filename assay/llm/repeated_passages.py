"""Substring dedup: passages of ``WINDOW`` words that an earlier document holds already.

1. Documents are dealt to blocks of bounded size. In each block the minimizers of the
   windows (short phrases; equal windows choose the same one) are listed once with the
   least document that holds them and whether the block has another; a phrase that two documents of the corpus
   hold recurs.
2. Each block compiles the phrases that recur and that it holds into an Aho-Corasick
   automaton of its own, and all its documents stream through it; windows whose minimizer
   is hit are candidates. Candidates are listed once per block and confirmed over the
   corpus, which gives the least document of each window.
3. Each block marks the words of its windows that start in a smaller document.

Rows that share a doc_id need not share a block: lists name the least document of all blocks. The text moves once (the three steps share its exchange). Lists hold one row per block and
phrase or window, so a passage that a third of the documents share costs one row a block.

Defined cases: a null or empty text has no words; texts shorter than a window lose nothing;
a passage repeated inside one document only stays; rows that repeat a doc_id don't take from
each other; a row without doc_id loses nothing and takes nothing; a text of any length is
judged whole; an empty table gives an empty result. Phrases are compared by their words in
the automaton, windows by 64-bit hashes of thirteen words.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.batches import chunks, release, shuffle_width
from assay.llm.words import run_hashes, word_hashes, word_spans
from assay.session import ship_package

WINDOW = 13
#: Words of the phrases that stand for windows.
PHRASE = 6
#: Digits of a word's number, and phrases of an automaton (their words have numbers enough).
BASE, DIGITS = 64, 3
SHARD = BASE ** DIGITS // PHRASE - 1
#: Text of a block.
BLOCK_BYTES = 8 << 20


class Block:
    """Words of a block's documents."""

    def __init__(self, table: pa.Table, keep_words: bool = False):
        self.docs = table.column("doc_id").to_pylist()
        parts, counts, self.raw, self.spans = [], [], [], []
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for piece in chunks(batch, "text"):
                raw = [b"" if t is None else t for t in piece.column("text").to_pylist()]
                words, bounds = word_hashes(raw)
                parts.append(words)
                counts.append(np.diff(bounds))
                if keep_words:
                    base = np.repeat(np.cumsum([0] + [len(r) + 1 for r in raw])[:-1], np.diff(bounds))
                    begin, end = word_spans(raw)
                    self.raw += raw
                    self.spans.append((begin - base, end - base))
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.ends = np.cumsum(self.count)
        known = np.array([d is not None for d in self.docs], bool)
        self.owner = np.repeat(np.array([0 if d is None else d for d in self.docs], np.int64), self.count)
        usable = np.repeat(known, self.count)
        place = np.repeat(self.ends, self.count) - np.arange(len(self.words))  # words to the document's end
        n = max(0, len(self.words) - WINDOW + 1)
        self.whole = (place[:n] >= WINDOW) & usable[:n]  # a window starts here

    def windows(self) -> np.ndarray:
        return run_hashes(self.words, WINDOW)

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the phrase at each word, place of each window's least phrase)."""
        phrases = run_hashes(self.words, PHRASE)
        span = WINDOW - PHRASE + 1
        if len(phrases) < span:
            return phrases, np.zeros(0, np.int64)
        least = phrases[:len(phrases) - span + 1].copy()
        at = np.zeros(len(least), np.int64)
        for k in range(1, span):
            other = phrases[k:k + len(least)]
            less = other < least
            least[less] = other[less]
            at[less] = k
        return phrases, at + np.arange(len(least))


_LISTED = pa.schema([("block", pa.int32()), ("key", pa.int64()), ("lo", pa.int64()), ("several", pa.bool_())])
LISTED = "block int, key bigint, lo bigint, several boolean"


def _listed(block: int, keys: np.ndarray, owner: np.ndarray) -> pa.Table:
    """Distinct keys with the least document that holds each, and whether another one does."""
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    lo, hi = (f.reduceat(owner, first) if len(keys) else owner for f in (np.minimum, np.maximum))
    return pa.Table.from_arrays([pa.array(np.full(len(first), block, np.int32)), pa.array(keys[first].view(np.int64)),
                                 pa.array(lo), pa.array(lo < hi)], schema=_LISTED)


def _phrases(table: pa.Table) -> pa.Table:
    b = Block(table)
    hashes, at = b.minimizers()
    at = np.unique(at[b.whole[:len(at)]])
    release()
    return _listed(table.column("block")[0].as_py(), hashes[at], b.owner[at])


def _sorted_keys(table: pa.Table) -> np.ndarray:
    return np.sort(table.column("key").to_numpy().view(np.uint64))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each of ``keys`` is one of the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def occurrences(words: np.ndarray, hits_of: int, places: np.ndarray) -> np.ndarray:
    """Where the phrases at ``places`` (of PHRASE words) occur in the block's text: automata
    of at most SHARD phrases each, through each of which the whole text streams. Words are
    written as DIGITS characters, so that the automaton's nodes have few children."""
    hit = np.zeros(hits_of, bool)
    for a in range(0, len(places), SHARD):
        rows = places[a:a + SHARD, None] + np.arange(PHRASE)
        vocabulary, number = np.unique(words[rows], return_inverse=True)
        phrases, size = _written(number.reshape(-1) + 1), PHRASE * DIGITS
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k in range(0, len(phrases), size):
            automaton.add_word(phrases[k:k + size], 1)
        automaton.make_automaton()
        at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        text = _written(np.where(vocabulary[at] == words, at + 1, 0))
        found = np.array([e for e, _ in automaton.iter(text)], np.int64)
        hit[(found + 1) // DIGITS - PHRASE] = True
    return hit


def _written(numbers: np.ndarray) -> str:
    """DIGITS characters for each number; a first one is never a later one."""
    out = np.empty((len(numbers), DIGITS), np.uint8)
    for k in range(DIGITS):
        out[:, DIGITS - 1 - k] = numbers % BASE
        numbers = numbers // BASE
    out[:, 0] += BASE
    return out.tobytes().decode("latin-1")


def _candidates(key, docs: pa.Table, recurring: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return _LISTED.empty_table()
    b = Block(docs)
    hashes, at = b.minimizers()
    whole = b.whole[:len(at)]
    used = np.unique(at[whole])
    used = used[_find(hashes[used], _sorted_keys(recurring))]
    places = used[np.unique(hashes[used], return_index=True)[1]]
    hit = occurrences(b.words, len(hashes), places)
    start = np.flatnonzero(whole)
    start = start[hit[at[start]]]
    release()
    return _listed(key[0].as_py(), b.windows()[start], b.owner[start])


def _marked(b: Block, confirmed: pa.Table) -> np.ndarray:
    """Words covered by a window that starts in a smaller document."""
    first = np.zeros(len(b.words) + 1, np.int64)
    if confirmed.num_rows:
        keys = confirmed.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, least = keys[order], confirmed.column("least").to_numpy()[order]
        own = b.windows()
        start = np.flatnonzero(b.whole)
        k = np.minimum(np.searchsorted(keys, own[start]), len(keys) - 1)
        start = start[(keys[k] == own[start]) & (least[k] < b.owner[start])]
        np.add.at(first, start, 1)
        np.add.at(first, start + WINDOW, -1)
    return np.cumsum(first[:-1]) > 0


def _dealt(docs: DataFrame, carry: tuple[str, ...], n_blocks: int) -> DataFrame:
    """Rows with their block, by id, text and input partition: rows that share a doc_id or have
    none spread, and so do copies of one row. A task that runs again deals the same blocks."""
    place = F.xxhash64("doc_id", "text", F.spark_partition_id())
    return docs.select("doc_id", *carry, F.col("text").cast("binary").alias("text"),
                       F.pmod(place, F.lit(n_blocks)).cast("int").alias("block")).repartition(n_blocks, "block")


def remove_repeats(docs: DataFrame, *, carry: tuple[str, ...] = (), leave_clean: bool = False,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, the columns ``carry``, text, n_words and n_removed of every row.

    ``text`` is the kept words joined by one space; with ``leave_clean`` a document that
    loses nothing keeps its text as it is (null too).
    """
    spark = docs.sparkSession
    ship_package(spark)
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_blocks = max(shuffle_width(spark), -(-size // block_bytes))
    dealt = _dealt(docs, carry, n_blocks)

    over_key = Window.partitionBy("key")
    least, most = F.min("lo").over(over_key).alias("least"), F.max("lo").over(over_key).alias("most")
    recurring = (dealt.groupBy("block").applyInArrow(_phrases, LISTED)
                 .select("block", "key", least, most, F.max("several").over(over_key).alias("several"))
                 .filter("least < most or several").select("block", "key"))
    confirmed = (dealt.groupBy("block").cogroup(recurring.groupBy("block")).applyInArrow(_candidates, LISTED)
                 .select("block", "key", "lo", "several", least).filter("least < lo or several").select("block", "key", "least"))

    out = T.StructType([docs.schema["doc_id"], *[docs.schema[c] for c in carry], T.StructField("text", T.BinaryType()),
                        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    names = [f.name for f in out]

    def kept(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({n: pa.array([], docs.schema.field(n).type if n in docs.schema.names else pa.int64()) for n in names})
        b = Block(docs, keep_words=True)
        gone = _marked(b, confirmed)
        begin, end = (np.concatenate(x) for x in zip(*b.spans, strict=True))
        texts, removed, count = [], [], b.count
        a = 0
        source = docs.column("text")
        for d, z in enumerate(b.ends.tolist()):
            lost = int(gone[a:z].sum())
            removed.append(lost)
            if leave_clean and not lost:
                texts.append(source[d].as_py())
            else:
                raw, stay = b.raw[d], ~gone[a:z]
                if lost:
                    texts.append(b" ".join([raw[x:y] for x, y in zip(begin[a:z][stay].tolist(), end[a:z][stay].tolist(), strict=True)]))
                else:
                    texts.append(b" ".join(raw.split()))
            a = z
        del b, gone, begin, end
        release()
        cols = {"text": pa.array(texts, pa.binary()), "n_words": pa.array(count, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        return pa.table({n: cols.get(n, docs.column(n) if n in docs.schema.names else None) for n in names})

    result = dealt.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(kept, out)
    return result.withColumn("text", F.col("text").cast("string"))


def repeat_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
