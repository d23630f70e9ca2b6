"""A7, A8, B12, B13, F2, F3 — dataset records: typed decode, nested structs, counts, limits
and ordered output.

A dataset table may come with loosely typed nested columns: chunks and classes as JSON text or
as arrays whose fields are missing or null, instructions null, flags as text. The decode is
bound to a schema and gives every record the same types and defaults.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: types of a decoded record's nested columns
CHUNKS = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("score", T.DoubleType())]))
CLASSES = T.ArrayType(T.StructType([T.StructField("class", T.StringType()), T.StructField("context", T.StringType()),
                                    T.StructField("id", T.StringType())]))
TEXTS = T.ArrayType(T.StringType())


def _typed(df: DataFrame, name: str, schema: T.ArrayType) -> Column:
    """A column as an array of ``schema``: JSON text is parsed (text that is no such array gives
    null), an array is cast field by field, missing fields are null."""
    if name not in df.columns:
        return F.lit(None).cast(schema)
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        return F.from_json(col, schema)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and isinstance(schema.elementType, T.StructType):
        have = set(kind.elementType.names)
        return F.transform(col, lambda e: F.when(e.isNotNull(), F.struct(*[
            (e[f.name].try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.elementType.fields])))
    return col.cast(schema)


def _each(items: Column, fields: dict[str, object]) -> Column:
    """Elements that are not null, their null fields filled; no array is an empty one."""
    present = F.filter(items, lambda e: e.isNotNull())
    filled = F.transform(present, lambda e: F.struct(*[F.coalesce(e[n], F.lit(d)).alias(n) for n, d in fields.items()]))
    return F.coalesce(filled, F.array().cast(T.ArrayType(T.StructType([
        T.StructField(n, T.DoubleType() if isinstance(d, float) else T.StringType()) for n, d in fields.items()]))))


def decode_records(df: DataFrame) -> DataFrame:
    """A7 — ``df`` with its nested columns decoded: chunks (content '', score 0.0), classes
    (class, context, id: '') and instructions (no null element); no value is an empty array.
    Names, goal and the other texts stay; language is a long, 0 without one."""
    texts = F.coalesce(F.filter(_typed(df, "instructions", TEXTS), lambda s: s.isNotNull()), F.array().cast(TEXTS))
    out = {"chunks_big": _each(_typed(df, "chunks_big", CHUNKS), {"content": "", "score": 0.0}),
           "classes": _each(_typed(df, "classes", CLASSES), {"class": "", "context": "", "id": ""}), "instructions": texts}
    if "language" in df.columns:
        out["language"] = F.coalesce(F.col("language").try_cast("bigint"), F.lit(0).cast("bigint"))
    return df.withColumns(out)


def load_filtered(df: DataFrame, categories: Iterable[str] | None = None, col: str = "data_category_QA") -> DataFrame:
    """A7 — decoded records of the given categories (all of them without a list). The filter
    stands before the decode, so it is pushed to the scan."""
    kept = df if categories is None else df.filter(F.col(col).isin(list(categories)))
    return decode_records(kept)


def count_by_category(df: DataFrame, categories: Iterable[str], col: str = "data_category_QA") -> DataFrame:
    """A8 — (category, n) of the given categories, 0 where a category has no record."""
    wanted = list(dict.fromkeys(categories))
    spark = df.sparkSession
    asked = spark.createDataFrame([(c,) for c in wanted], f"{col} string")
    counts = df.filter(F.col(col).isin(wanted)).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counts, col, "left").select(col, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def scorer_inputs(records: DataFrame, response: str = "response") -> DataFrame:
    """B13 — ``inputs``, ``outputs`` and ``expectations`` structs of decoded records."""
    classes = F.transform("classes", lambda c: F.struct(c["id"].alias("id"), c["class"].alias("class")))
    return records.withColumns({
        "inputs": F.struct(F.col("question").alias("question")),
        "outputs": F.struct(F.col(response).alias("response")),
        "expectations": F.struct(F.col("content").alias("expected_response"), F.array_join("instructions", "; ").alias("guidelines"),
                                 F.col("chosen_class_id").alias("chosen_class_id"), classes.alias("classes"), F.col("chunks_big").alias("chunks"))})


def nested_records(records: DataFrame, limit: int | None = None, id_col: str = "id") -> DataFrame:
    """B12 + F3 — each record as ``{inputs, expectations, tags}``; with ``limit`` the first
    records by id (the exact top-n, without a sort in one task)."""
    from assay.sources.medallion import top_n_exact
    if limit is not None:
        keyed = records.withColumn("_order", F.lit(0))
        records = top_n_exact(keyed, "_order", id_col, F.lit(limit)).drop("_order")
    return records.select(
        F.struct("question", "language").alias("inputs"),
        F.struct(F.col("content").alias("expected_response"), F.array_join("instructions", "; ").alias("guidelines"), "chosen_class_id").alias("expectations"),
        F.struct("data_category_QA", F.col(id_col).alias("session_id")).alias("tags"))


def write_ordered(df: DataFrame, path: str, order: list[str], partitions: int | None = None) -> None:
    """F2 — ``df`` in the order of ``order`` over its files: rows are range-partitioned, each
    file is sorted and starts where the one before ends, and the files' names sort in that
    order. No task sorts the whole table. Rows that are equal in ``order`` share a file."""
    width = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(width, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_ordered(spark, path: str, order: list[str]) -> DataFrame:
    """The rows with ``file`` (the files' number in order) and ``place`` in it, which together
    give the order back whatever the scan's partitions."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("place"))
    return rows.withColumn("file", F.regexp_extract("_file", r"part-(\d+)", 1).cast("int")).drop("_file")
