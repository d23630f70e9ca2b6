"""Medallion preparation and the gold fact tables.

bronze  raw parquet as a temp view (A1)
silver  15-column projection + validity filter (A2, B1), category whitelist (B2)
sample  weighted sample without replacement, exact size, partition-independent (F1)
gold    predictions JSONL (A5/A12) -> fct_inference_results (B4 + C1) and
        fct_evaluation_scores (B3)
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.session import ensure_checkpoint_dir

# fixed values: prediction file schema (declared: all-null columns would infer badly)
PREDICTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("attempt", T.IntegerType()), T.StructField("timestamp", T.StringType()),
    T.StructField("question", T.StringType()), T.StructField("prediction", T.StringType()),
    T.StructField("data_category_QA", T.StringType()), T.StructField("language", T.LongType()),
    T.StructField("model", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in (
        "token_overlap_f1", "question_response_overlap", "response_length_ratio", "rouge_l",
        "chunk_attribution", "groundedness_score", "correctness_score", "guidelines_score",
        "pass_at_k_best_score", "self_consistency", "self_consistency_variance")],
    *[T.StructField(c, T.BooleanType()) for c in (
        "class_exact_match", "refusal_detection", "hedging_detection", "pass_at_k")],
    T.StructField("failure_mode", T.StringType()),
])

SILVER_COLUMNS = ["id", "content", "context_metadata", "question", "name", "occupation", "instructions",
                  "chatbot_goal", "adjective", "chunks_big", "classes", "chosen_class_id", "language",
                  "data_category_QA", "content_base_uuids"]


def bronze(spark: SparkSession, path: str, view: str = "stg_raw_dataset") -> DataFrame:
    """A1 — the raw parquet as a view (all columns, schema from the file)."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(view)
    return df


def silver(raw: DataFrame, columns=SILVER_COLUMNS) -> DataFrame:
    """A2 + B1 — projection to the dataset-record columns present, and the validity
    filter: non-null, non-empty question and non-null content."""
    cols = [c for c in columns if c in raw.columns]
    return raw.select(*cols).filter(
        F.col("question").isNotNull() & (F.col("question") != "") & F.col("content").isNotNull())


def category_filter(df: DataFrame, categories, col: str = "data_category_QA") -> DataFrame:
    """B2/A7 — category IN-list (pushed into the parquet scan when it is a plain column)."""
    return df.filter(F.col(col).isin(list(categories)))


def uniform_from_key(key) -> F.Column:
    """Seeded uniform in (0, 1) from md5 of a key string (same value in any engine,
    any partitioning): first 13 hex digits of md5 / 16^13, nudged off 0."""
    h = F.conv(F.substr(F.md5(key), F.lit(1), F.lit(13)), 16, 10).cast("double")
    return (h + 0.5) / float(16 ** 13)


def top_n_exact(df: DataFrame, key: str, tie: str, n, num_partitions: int | None = None) -> DataFrame:
    """Exact top-``n`` rows by ``key`` desc (``tie`` asc), without a single-task sort.

    Range-partition on the order (checkpointed, so partition ids are stable),
    count rows per partition (one row per partition), turn counts into
    offsets, and keep rows whose global rank (offset + rank inside the
    partition) is at most ``n``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    num_partitions = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(num_partitions, F.col(key).desc(), F.col(tie).asc()).checkpoint()
    with_pid = ranged.withColumn("_pid", F.spark_partition_id())
    counts = with_pid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.select("_pid", F.coalesce(
        F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_off"))
    w = Window.partitionBy("_pid").orderBy(F.col(key).desc(), F.col(tie).asc())
    ranked = with_pid.withColumn("_lr", F.row_number().over(w)).join(F.broadcast(offs), "_pid")
    return ranked.filter(F.col("_off") + F.col("_lr") <= n).drop("_pid", "_lr", "_off")


def weighted_sample(df: DataFrame, fraction: float, seed: int, id_col: str = "id",
                    category_col: str = "data_category_QA", proportional: bool = False,
                    num_partitions: int | None = None) -> DataFrame:
    """F1 — weighted sample without replacement of exactly int(N * fraction) rows.

    Weight = 1 / count(category) (E2), so every category gets equal mass (the
    reference's code; ``proportional=True`` uses weight 1). Efraimidis-Spirakis
    keys ln(u) / w with u = uniform(md5(id:seed)) make the draw independent of
    partitioning; the top keys are taken with ``top_n_exact``.
    """
    counts = df.groupBy(category_col).agg(F.count(F.lit(1)).alias("_cat_n"))
    n = F.floor(df.select(F.count(F.lit(1)).cast("double")).scalar() * F.lit(fraction))
    w = F.lit(1.0) if proportional else 1.0 / F.col("_cat_n")
    u = uniform_from_key(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    counts = counts.withColumnRenamed(category_col, "_cat")  # rows without a category are one of their own
    keyed = (df.join(counts, F.col(category_col).eqNullSafe(F.col("_cat")))
             .withColumn("_key", F.log(u) / w).drop("_cat_n", "_cat"))
    return top_n_exact(keyed, "_key", id_col, n, num_partitions).drop("_key")


def sample_report(before: DataFrame, after: DataFrame, category_col: str = "data_category_QA") -> DataFrame:
    """D17 — count per category before and after sampling."""
    b = before.groupBy(category_col).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(category_col).agg(F.count(F.lit(1)).alias("n_after"))
    return b.join(a, category_col, "left").fillna(0, ["n_after"])


# ---------------------------------------------------------------------- gold
def write_predictions(pred: DataFrame, path: str, mode: str = "append") -> None:
    """A5/A12 — append predictions as JSON lines, partitioned by run so earlier runs stay."""
    pred.write.mode(mode).partitionBy("run_id").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A3 — JSON-lines scan with the declared schema."""
    return spark.read.schema(PREDICTION_SCHEMA).json(path)


def fct_inference_results(silver_df: DataFrame, predictions: DataFrame) -> DataFrame:
    """B4 + C1 — renaming projection of predictions joined to silver on the session id."""
    p = predictions.select(F.col("id").alias("session_id"), "run_id", "attempt",
                           F.to_timestamp("timestamp").alias("timestamp"),
                           F.col("question").alias("input"), F.col("prediction").alias("output"), "model")
    lang = F.col("language") if "language" in silver_df.columns else F.lit(None).cast("long")
    s = silver_df.select(F.col("id").alias("session_id"), "data_category_QA", lang.alias("language"))
    return p.join(s, "session_id")


def fct_evaluation_scores(predictions: DataFrame) -> DataFrame:
    """B3 — lenient typed projection: doubles via try_cast, booleans as
    coalesce(try_cast(x as boolean), false) (N/A becomes false in gold, Q5)."""
    dbl = ["token_overlap_f1", "question_response_overlap", "response_length_ratio", "rouge_l",
           "chunk_attribution", "pass_at_k_best_score", "self_consistency", "self_consistency_variance"]
    boo = ["class_exact_match", "refusal_detection", "hedging_detection", "pass_at_k"]
    return predictions.select(
        F.col("id").alias("session_id"), "run_id", "attempt", F.to_timestamp("timestamp").alias("timestamp"),
        "data_category_QA", "language",
        F.coalesce(F.expr("try_cast(correctness_score AS boolean)"), F.lit(False)).alias("correctness"),
        F.coalesce(F.expr("try_cast(guidelines_score AS boolean)"), F.lit(False)).alias("guidelines"),
        *[F.expr(f"try_cast({c} AS double)").alias(c) for c in dbl],
        *[F.coalesce(F.expr(f"try_cast({c} AS boolean)"), F.lit(False)).alias(c) for c in boo],
        F.expr("try_cast(groundedness_score AS double)").alias("groundedness"),
        "failure_mode")


def build_medallion(spark: SparkSession, raw_path: str, out_dir: str, *, categories=None,
                    predictions_path: str | None = None, gold: bool = False) -> dict[str, str]:
    """A9 — materialisation policy: bronze as a view, silver as a table (A4: parquet
    overwrite), gold fact tables only when ``gold`` is set and predictions exist.
    Path variables of the original project become arguments. Returns the table paths."""
    raw = bronze(spark, raw_path)
    sil = silver(raw)
    if categories:
        sil = category_filter(sil, categories)
    paths = {"int_filtered_dataset": os.path.join(out_dir, "int_filtered_dataset")}
    sil.write.mode("overwrite").parquet(paths["int_filtered_dataset"])
    if gold and predictions_path:
        preds = read_predictions(spark, predictions_path)
        silver_t = spark.read.parquet(paths["int_filtered_dataset"])
        paths["fct_inference_results"] = os.path.join(out_dir, "fct_inference_results")
        paths["fct_evaluation_scores"] = os.path.join(out_dir, "fct_evaluation_scores")
        fct_inference_results(silver_t, preds).write.mode("overwrite").partitionBy("run_id") \
            .parquet(paths["fct_inference_results"])
        fct_evaluation_scores(preds).write.mode("overwrite").partitionBy("run_id") \
            .parquet(paths["fct_evaluation_scores"])
    return paths


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the session's checkpoint dir (shared storage on a cluster)."""
    return os.path.join(ensure_checkpoint_dir(spark), "tables", name)
