"""Exact deduplication by block naming, with DataFrame functions only.

The normalised text is cut into blocks of ``BLOCK_BYTES``. Distinct blocks are sorted
and numbered; a document is then a row of numbers. Adjacent pairs of numbers are sorted
and numbered again, level by level, until each document has one number. Two documents
have the same number of blocks and the same last number if and only if their texts are
equal: nothing rests on a hash.

Block texts move once, to be sorted; documents meet their blocks' numbers through a
128-bit key, after the key has been found to tell all distinct blocks of the table apart
(else another seed is taken). Distinct blocks and pairs are pre-aggregated before each
exchange, so a text that a third of the rows share costs one row a task; the joins that
bring numbers back hold numbers only and are split by Spark where a key is frequent.

Defined cases: a null text counts as empty, and empty texts equal each other; of rows
that repeat doc_id and text one stays; a null doc_id is the smallest; texts of any
length take part whole; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.batches import written

#: Bytes of a block. Longer documents take log2(length / BLOCK_BYTES) more levels.
BLOCK_BYTES = 16384


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Distinct rows sorted in their partitions; ``name`` is partition and place."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _block_key(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), block), F.xxhash64(block, F.lit(seed))]


def _named_blocks(texts: DataFrame, blocks: Column) -> tuple[DataFrame, int]:
    """(k1, k2, name) of all distinct blocks, and the seed whose keys tell them apart."""
    for seed in range(100):
        distinct = texts.select(F.explode(blocks).alias("block")).distinct()
        names = written(_numbered(distinct, "block").select(
            *[k.alias(n) for k, n in zip(_block_key(F.col("block"), seed), ("k1", "k2"), strict=True)], "name"), "blocks")
        if names.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
            return names, seed
    raise RuntimeError("no seed tells the blocks apart")


def document_names(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: row (its number), doc_id, text_sha256, n_blocks, name;
    texts are equal where n_blocks and name are."""
    texts = df.select("doc_id", ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t")).select(
        "doc_id", F.col("t").cast("binary").alias("t"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("t") / block_bytes)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("t"), i * block_bytes + 1, F.lit(block_bytes)))
    names, seed = _named_blocks(texts, blocks)
    rows = written(texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("t", 256).alias("text_sha256"), n.alias("n_blocks"),
        F.transform(blocks, lambda b: F.struct(*[k.alias(c) for k, c in zip(_block_key(b, seed), ("k1", "k2"), strict=True)])).alias("keys")), "rows")

    own = ["row", "doc_id", "text_sha256", "n_blocks"]
    single = rows.filter("n_blocks = 1").select(*own, F.col("keys")[0]["k1"].alias("k1"), F.col("keys")[0]["k2"].alias("k2"))
    done = single.join(names, ["k1", "k2"]).select(*own, "name")
    # documents of several blocks: pairs of adjacent numbers, until one is left
    level = written(rows.filter("n_blocks > 1").select("row", F.posexplode("keys").alias("pos", "key"))
                    .select("row", "pos", "key.k1", "key.k2").join(names, ["k1", "k2"]).select("row", "pos", "name"), "level")
    ended: list[DataFrame] = []
    while not level.isEmpty():
        half = written(level.groupBy("row", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")), "pairs")
        pairs = written(_numbered(half.select("a", "b").distinct(), "a", "b"), "names")
        level = written(half.join(pairs, ["a", "b"]).select("row", "pos", "name"), "level")
        last = level.groupBy("row").agg(F.max("pos").alias("last"))
        open_rows = written(last.filter("last > 0").select("row"), "open")
        ended.append(level.join(open_rows, "row", "left_anti").select("row", "name"))
        level = level.join(open_rows, "row", "left_semi")
    for part in ended:
        done = done.unionByName(rows.filter("n_blocks > 1").select(*own).join(part, "row"))
    return done


def exact_duplicates(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row: of equal texts the
    row with the largest doc_id stays."""
    named = written(document_names(df, block_bytes), "identities")
    groups = named.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.select("n_blocks", "name", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"),
                                   "group_size"), "groups")
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
