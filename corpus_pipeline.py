"""A corpus pipeline over the table ``documents``: language ID, exact dedup, near-duplicate
groups, repeated passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame. ``run`` writes each stage's result as Parquet and reads it for the next. All
stages but the last return the columns that ``documents`` has.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import exact_dedup, jaccard_join, language_id, packing, repeated_passages
from assay.llm.batches import unused, written
from assay.llm.catalog import TOKENIZER
from assay.sources.tables import read_table

#: A key for rows without doc_id.
NO_ID = -(1 << 63)
#: A document's language is told if its score is over so many times an even share of the labels.
OVER_CHANCE = 1.05


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Documents without a letter go, and those in which the network tells no language: of
    two or more labels none scores over OVER_CHANCE even shares. ``languages`` keeps these
    labels only. The told language takes the place of ``lang`` (``pack`` goes by it). With
    nothing to learn from, all documents with a letter stay and keep their ``lang``."""
    net = language_id.fit(docs)
    lang, score, letters = (unused(docs, c) for c in ("told_lang", "told_score", "told_letters"))
    told = language_id.with_language(docs, net, names=(lang, score), letters=letters).filter(letters)
    if len(net.labels) > 1:
        told = told.filter(F.col(score) > OVER_CHANCE / len(net.labels))
    if net.labels and languages is not None:
        told = told.filter(F.col(lang).isin(*languages))
    if not net.labels:
        return told.select(*columns(docs))
    return told.select(*[F.col(lang).alias(c) if c.lower() == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat a doc_id and
    its text, one."""
    found = written(exact_dedup.exact_duplicates(docs), "copies").filter("not kept")
    key, own_id, own_hash = F.coalesce(F.col("doc_id"), F.lit(NO_ID)), unused(docs, "own_id"), unused(docs, "own_hash")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(key.alias(own_id), F.col("text_sha256").alias(own_hash)).distinct()
    repeated = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    text = exact_dedup.ascii_lower(F.coalesce("text", F.lit("")))
    rest = docs.withColumns({own_id: key, own_hash: F.sha2(text.cast("binary"), 256)}).join(gone, [own_id, own_hash], "left_anti")
    if not repeated.isEmpty():
        rest = rest.dropDuplicates([own_id, own_hash])
    return rest.select(*columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: of those with the smallest doc_id the one whose
    text has the least SHA-256. Rows without doc_id stay."""
    own = unused(docs, "own_key")
    rows = written(jaccard_join.similar_rows(docs, keyed=True).filter("doc_id is not null"), "groups")
    groups = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "key")).alias("kept"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    linked = rows.join(groups, "comp")
    gone = linked.filter(F.struct("doc_id", "key") != F.col("kept")).select("doc_id", F.col("key").alias(own)).distinct()
    rest = docs.withColumn(own, jaccard_join.text_key(docs)).join(gone, ["doc_id", own], "left_anti")
    # rows that repeat an id and its text can't be told apart by them: one of each stays
    again = (linked.filter(F.struct("doc_id", "key") == F.col("kept")).groupBy("doc_id", F.col("key").alias(own))
             .count().filter("count > 1").select("doc_id", own))
    if not again.isEmpty():
        copies = rest.join(again, ["doc_id", own], "left_semi").dropDuplicates(["doc_id", own])
        rest = rest.join(again, ["doc_id", own], "left_anti").unionByName(copies)
    return rest.select(*columns(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller doc_id holds go; a document that loses all its words
    goes, one that loses none keeps its text as it is."""
    own = ("doc_id", "text", "n_chars")
    others = {c: f"x{i}" for i, c in enumerate(docs.columns) if c not in own}
    rest = repeated_passages.remove_repeats(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(x) for c, x in others.items()]),
                                            carry=tuple(others.values()), leave_clean=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("bigint"),
               **{c: F.col(x) for c, x in others.items()}}
    return rest.filter("n_removed = 0 or n_removed < n_words").select(*[columns[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of tokens; a window holds one language."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), by="lang")


STAGES = [("language_id", keep_languages), ("exact_dedup", drop_exact_copies), ("near_copies", drop_near_copies),
          ("repeated_passages", drop_repeated_passages), ("packing", pack)]

#: SQL can't express the network, the automata or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
