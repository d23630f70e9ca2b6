"""Phrase collocations: phrases of two to four words, counted without loss and scored by their
weakest cut.

1. One pass turns texts into blocks of one language: the block's words, each with its count,
   and the text as numbers of these words. Nothing but blocks is read afterwards.
2. Words are counted in shards by hash. A word of ``LEAST`` occurrences and more gets an id;
   others end a phrase, as a phrase is never more frequent than a word of it.
3. For n = 2, 3, 4: each block counts its n-grams of ids in a counting quotient filter
   (``quotient_filter``), which is cut by the first bits of the quotient into shards. A shard's
   sorted filters are merged; the task returns to each block one bit for each entry of its
   filter, whether the n-gram has ``LEAST`` occurrences. Blocks keep only the runs of words
   whose n-grams all have, as a longer phrase is never more frequent than a part of it.
4. Counts of phrases and of their parts are joined, the lowest-scoring cut counts; a candidate
   goes if a longer candidate with ``COVERED`` percent of its count holds it.

A block holds about ``BLOCK_BYTES`` of text, a shard about ``SHARD`` entries whatever the words'
frequencies: a word or phrase that makes up a third of the corpus is one entry a block, and a
language or document of any size is many blocks (a document may be cut between blocks only
where a phrase ends).

Defined cases: a null text is empty, a null language ``und``; texts without words give nothing;
repeated rows count as often as they stand there; equal scores are ordered by count, then by the
phrase's bytes; other columns are not read; an empty table gives an empty result. Texts are
taken whole. Counts are exact; scores are computed in decimals of 38 digits.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm import quotient_filter as qf
from assay.llm.batches import chunks, written
from assay.llm.pretokens import ragged
from assay.session import ship_package

LEAST, COVERED, LONGEST, TOP = 30, 80, 4, 2000
#: Text of a block, and entries of a shard.
BLOCK_BYTES, SHARD = 8 << 20, 1 << 20
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 18

#: Byte that ends a phrase; UTF-8 texts have no such byte.
END = b"\xff"
_TABLE = bytearray(range(256))
for _c in range(ord("A"), ord("Z") + 1):
    _TABLE[_c] += 32
_TABLE[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = END[0]
_TABLE = bytes(_TABLE)


class _Words(dict):
    """Local number of each word, by first occurrence; END is 0."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _tokens(text: bytes):
    """Words and phrase ends of a text, in pieces cut at spaces or phrase ends."""
    text = text.translate(_TABLE)
    a = 0
    while a < len(text):
        z = len(text)
        if z - a > PIECE:
            cuts = [c for c in (text.find(b" ", a + PIECE), text.find(END, a + PIECE)) if c >= 0]
            z = min(cuts, default=z)
        yield text[a:z].replace(END, b" \xff ").split()
        a = z


def _compressed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte of all numbers, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _plain(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).reshape(-1).view("<u4").astype(np.int64)


BLOCKS = "block bigint, lang string, tokens bigint, hashes binary, words array<binary>, counts array<bigint>, seq binary"


class _Open:
    def __init__(self):
        self.words, self.parts, self.size = _Words({END: 0}), [], 0

    def add(self, text: bytes) -> None:
        for tokens in _tokens(text):
            self.parts.append(np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(text) + 1

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        """The block with its words in the order of their hashes."""
        words = [*self.words][1:]
        named = sorted((blake2b(w, digest_size=4).digest(), w, k) for k, w in enumerate(words, 1))
        place = np.zeros(len(words) + 1, np.int64)
        place[[k for _, _, k in named]] = np.arange(1, len(words) + 1)
        seq = place[np.concatenate(self.parts)]
        counts = np.bincount(seq, minlength=len(words) + 1)[1:]
        hashes = np.frombuffer(b"".join(h for h, _, _ in named), ">u4").astype("<u4").tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([lang]), pa.array([int(counts.sum())]), pa.array([hashes], pa.binary()),
             pa.array([[w for _, w, _ in named]], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())),
             pa.array([_compressed(seq)], pa.binary())], ["block", "lang", "tokens", "hashes", "words", "counts", "seq"])


def _blocks(block_bytes: int):
    def run(batches):
        number, open_ = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            for piece in chunks(batch, "text"):
                for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    held = open_.setdefault(lang, _Open())
                    held.add(text or b"")
                    if held.size >= block_bytes or sum(o.size for o in open_.values()) >= 4 * block_bytes:
                        full = [lang] if held.size >= block_bytes else [*open_]
                        for one in full:
                            yield open_.pop(one).row(number, one)
                            number += 1
        for one, held in open_.items():
            yield held.row(number, one)
            number += 1
    return run


def _bits(entries: int, shard: int = SHARD) -> int:
    """Bits of the shards that hold about ``shard`` of the entries each."""
    return max(0, (max(0, entries - 1) // shard).bit_length())


def _shard_cuts(first: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted numbers by their bits above ``shift``."""
    if not len(first):
        return []
    shard = first >> np.uint64(shift)
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    return [(int(shard[a]), a, z) for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True)]


# ---- words

def _word_lists(bits: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                hashes = np.frombuffer(one.column("hashes")[0].as_py(), "<u4").astype(np.uint64)
                words, counts = (one.column(c).flatten() for c in ("words", "counts"))
                cuts = _shard_cuts(hashes, 32 - bits)
                ends = np.array([0] + [z for _, _, z in cuts], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.column("lang").to_pylist() * len(cuts), pa.string()), pa.array([s for s, _, _ in cuts], pa.int64()),
                     pa.array(one.column("block").to_pylist() * len(cuts), pa.int64()),
                     pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, counts)], ["lang", "shard", "block", "words", "counts"])
    return run


#: Rows of a merge: for each block (its number) one bit an entry, and ids of those set; for the
#: shard (block -1) the frequent words or n-grams and their counts.
MERGED = "lang string, shard bigint, block bigint, size bigint, mask binary, ids binary, words array<binary>, counts array<bigint>"


def _merged(lang, shard, blocks, ends, masks, ids, words, counts) -> pa.Table:
    n = len(blocks)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "shard": pa.array([shard] * n, pa.int64()), "block": pa.array(blocks, pa.int64()),
                     "size": pa.array([0, *np.diff(ends)], pa.int64()), "mask": pa.array(masks, pa.binary()), "ids": pa.array(ids, pa.binary()),
                     "words": pa.array(words, pa.list_(pa.binary())), "counts": pa.array(counts, pa.list_(pa.int64()))})


def _merge_words(shards: int, least: int):
    def run(key, table):
        lang, shard = (k.as_py() for k in key)
        table = table.combine_chunks()
        words = table.column("words").combine_chunks().flatten().dictionary_encode()
        which = words.indices.to_numpy()
        total = np.zeros(len(words.dictionary), np.int64)
        np.add.at(total, which, table.column("counts").combine_chunks().flatten().to_numpy())
        often = total >= least
        number = np.zeros(len(total), np.int64)
        number[often] = np.arange(int(often.sum())) * shards + shard + 1  # ids without a count of other shards
        ends = np.concatenate([[0], np.cumsum([len(x) for x in table.column("words")])]).tolist()
        masks, ids = [None], [number[often].astype("<u8").tobytes()]
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            mask = often[which[a:z]]
            masks.append(np.packbits(mask).tobytes())
            ids.append(number[which[a:z]][mask].astype("<u8").tobytes())
        n = table.num_rows
        return _merged(lang, shard, [-1, *table.column("block").to_pylist()], ends, masks, ids,
                       [words.dictionary.take(pa.array(np.flatnonzero(often))).to_pylist()] + [None] * n, [total[often]] + [None] * n)
    return run


# ---- n-grams

SEQ = "block bigint, lang string, tokens bigint, seq binary"


def _seq(block, lang, seq: np.ndarray) -> pa.Table:
    return pa.table({"block": pa.array([block], pa.int64()), "lang": pa.array([lang], pa.string()),
                     "tokens": pa.array([int(np.count_nonzero(seq))], pa.int64()), "seq": pa.array([_compressed(seq)], pa.binary())})


def _none(schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.table({c.split()[0]: pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")})


def _encode(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """A block with ids for its frequent words, 0 for all others."""
    if not blocks.num_rows:
        return _none(SEQ)
    ids = [np.zeros(1, np.int64)]
    for row in found.sort_by("shard").select(["size", "mask", "ids"]).to_pylist():
        own = np.zeros(row["size"], np.int64)
        own[np.unpackbits(np.frombuffer(row["mask"], np.uint8), count=row["size"]).astype(bool)] = np.frombuffer(row["ids"], "<u8")
        ids.append(own)
    seq = np.concatenate(ids)[_plain(blocks.column("seq")[0].as_py())]
    return _seq(blocks.column("block")[0].as_py(), blocks.column("lang")[0].as_py(), _runs(seq, seq > 0, 1))


def _runs(seq: np.ndarray, kept: np.ndarray, n: int) -> np.ndarray:
    """The runs of words whose n-grams are all kept (by their first word), each with a 0 behind
    it; runs of n words are left out, as they hold no longer phrase."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
    first, size = edge[::2], edge[1::2] - edge[::2] + n - 1
    first, size = first[size > n], size[size > n]
    out = np.append(seq, 0)[ragged(first, size + 1)]
    out[np.cumsum(size + 1) - 1] = 0
    return out


def _grams(seq: np.ndarray, packing: qf.Packing):
    """(first word of each n-gram, sorted distinct permuted n-grams, counts, places)."""
    n = packing.n
    rows = max(0, len(seq) - n + 1)
    at = np.flatnonzero(np.logical_and.reduce([seq[k:k + rows] > 0 for k in range(n)])) if rows else np.zeros(0, np.int64)
    return at, packing.counted(*packing.permute(*packing.pack([seq[at + k] for k in range(n)])))


def _filters(n: int, bits: int, shard_bits: int):
    packing = qf.Packing(n, bits)

    def run(batches):
        for batch in batches:
            for block, lang, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "seq")), strict=True):
                _, (left, right, counts, _) = _grams(_plain(raw), packing)
                rows = [(lang, s, block, qf.write(packing, left[a:z], right[a:z], counts[a:z], shard_bits))
                        for s, a, z in _shard_cuts(left, packing.half - shard_bits)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["lang", "shard", "block", "filter"])
    return run


def _merge_filters(n: int, bits: int, least: int):
    packing = qf.Packing(n, bits)

    def run(key, table):
        lang, shard = (k.as_py() for k in key)
        filters = [qf.read(raw, shard) for raw in table.column("filter").to_pylist()]
        left, right, counts, which = packing.counted(*(np.concatenate([f[k] for f in filters]) for k in range(3)))
        often = counts >= least
        ends = np.concatenate([[0], np.cumsum([len(f[0]) for f in filters])]).tolist()
        masks = [np.packbits(often[which[a:z]]).tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]
        ids = np.stack(packing.unpack(*packing.invert(left[often], right[often])), axis=1).astype("<u8").tobytes()
        m = table.num_rows
        return _merged(lang, shard, [-1, *table.column("block").to_pylist()], ends, [None, *masks], [ids] + [None] * m, [None] * (m + 1),
                       [counts[often]] + [None] * m)
    return run


def _prune(n: int, bits: int):
    packing = qf.Packing(n, bits)

    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _none(SEQ)
        seq = _plain(blocks.column("seq")[0].as_py())
        at, (left, _, _, which) = _grams(seq, packing)
        often = [np.unpackbits(np.frombuffer(row["mask"], np.uint8), count=row["size"]) for row in found.sort_by("shard").select(["size", "mask"]).to_pylist()]
        kept = np.zeros(len(seq), bool)
        if len(at):
            kept[at] = np.concatenate(often).astype(bool)[which]
        return _seq(blocks.column("block")[0].as_py(), blocks.column("lang")[0].as_py(), _runs(seq, kept[:max(0, len(seq) - n + 1)], n))
    return run


def _listed(merged: DataFrame, n: int) -> DataFrame:
    """(lang, gram: ids, f) of the frequent n-grams."""
    def run(batches):
        for batch in batches:
            for lang, ids, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "ids", "counts")), strict=True):
                flat = np.frombuffer(ids, "<u8").astype(np.int64)
                grams = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), grams, pa.array(counts, pa.int64())], ["lang", "gram", "f"])
    return merged.filter("block = -1").select("lang", "ids", "counts").mapInArrow(run, "lang string, gram array<bigint>, f bigint")


def frequent_phrases(docs: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(n of each lang; lang, id, word of frequent words; lang, gram, f of frequent phrases of
    one to four words)."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    blocks = written(texts.mapInArrow(_blocks(block_bytes), BLOCKS), "blocks")
    totals = blocks.groupBy("lang").agg(F.sum("tokens").alias("n")).filter("n > 0")

    entries = blocks.agg(F.sum(F.size("words").cast("bigint"))).first()[0] or 0
    bits = _bits(entries, shard)
    lists = blocks.select("block", "lang", "hashes", "words", "counts").mapInArrow(
        _word_lists(bits), "lang string, shard bigint, block bigint, words array<binary>, counts array<bigint>")
    merged = written(lists.groupBy("lang", "shard").applyInArrow(_merge_words(1 << bits, least), MERGED), "words")
    ids = merged.filter("block = -1").select("lang", F.col("words").alias("word"), "counts", "ids")

    def numbered(batches):
        for batch in batches:
            for lang, words, counts, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "counts", "ids")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(np.frombuffer(raw, "<u8").astype(np.int64)),
                                                  pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["lang", "id", "word", "f"])
    words = written(ids.mapInArrow(numbered, "lang string, id bigint, word binary, f bigint"), "vocabulary")
    width = max(1, int(words.agg(F.max("id")).first()[0] or 1).bit_length())
    if width > 32:
        raise ValueError("more than 2^32 frequent words: ids are packed in 32 bits at most")

    found = merged.filter("block >= 0").select("block", "shard", "size", "mask", "ids")
    now = written(blocks.select("block", "lang", "seq").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_encode, SEQ), "encoded")
    phrases = words.select("lang", F.array("id").alias("gram"), "f")
    for n in range(2, LONGEST + 1):
        tokens = now.agg(F.sum("tokens")).first()[0] or 0
        shard_bits = min(_bits(tokens, shard), qf.Packing(n, width).half)
        filters = now.filter("tokens > 0").mapInArrow(_filters(n, width, shard_bits), "lang string, shard bigint, block bigint, filter binary")
        merged = written(filters.groupBy("lang", "shard").applyInArrow(_merge_filters(n, width, least), MERGED), "merged")
        phrases = phrases.unionByName(_listed(merged, n))
        if n < LONGEST:
            found = merged.filter("block >= 0").select("block", "shard", "size", "mask")
            now = written(now.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_prune(n, width), SEQ), "pruned")
    return totals, words, written(phrases, "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases."""
    totals, words, phrases = frequent_phrases(docs, least, **sizes)
    long = phrases.filter(F.size("gram") > 1)
    part = phrases.select("lang", F.col("gram").alias("part"), F.col("f").alias("part_f"))
    cuts = (long.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)))
            .withColumns({"first": F.expr("slice(gram, 1, k)"), "rest": F.expr("slice(gram, k + 1, size(gram) - k)")}))
    halves = (cuts.join(part.withColumnsRenamed({"part": "first", "part_f": "l"}), ["lang", "first"])
              .join(part.withColumnsRenamed({"part": "rest", "part_f": "r"}), ["lang", "rest"])
              .withColumn("score", F.expr("(cast(2000000 as decimal(7)) * cast(f as decimal(19))) div (cast(l as decimal(19)) + cast(r as decimal(19)))")))
    weakest = halves.groupBy("lang", "gram", F.col("f").alias("a")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = (phrases.filter(F.size("gram") > 2).select("lang", "f", F.col("gram").alias("whole"), F.explode(F.expr("sequence(2, size(gram) - 1)")).alias("m"))
             .select("lang", "f", F.explode(F.expr("transform(sequence(1, size(whole) - m + 1), i -> slice(whole, i, m))")).alias("gram"))
             .groupBy("lang", "gram").agg(F.max("f").alias("longer")))
    left = (weakest.join(inner, ["lang", "gram"], "left")
            .filter(F.expr(f"longer is null or 100 * cast(longer as decimal(19)) < {COVERED} * cast(a as decimal(19))"))
            .select("lang", "gram", "a", "cut.score", "cut.l", "cut.r"))
    ahead = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = left.withColumn("place", F.rank().over(ahead)).filter(F.col("place") <= top).drop("place")  # with all that are level
    spelt = (best.select("lang", "gram", F.posexplode("gram").alias("at", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
             .groupBy("lang", "gram").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
             .select("lang", "gram", F.expr("concat_ws(' ', transform(words, w -> cast(w.word as string)))").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(spelt, ["lang", "gram"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n",
                                              F.col("score").cast("bigint").alias("score"))
