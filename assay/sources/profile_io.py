"""A6 — threshold profile as one JSON document (save / load; a missing path loads None).

The profile is a flat table ``(category, metric, value, ci_lower, ci_upper,
metric_type, test_paired, test_unpaired, reference_mean, reference_std,
sample_count)`` — one row per (category, metric), plus ``category='global'``
rows — so its JSON document is O(categories x metrics), independent of data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

THRESHOLD = T.StructType([
    T.StructField("metric_name", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("ci_lower", T.DoubleType()), T.StructField("ci_upper", T.DoubleType()),
    T.StructField("metric_type", T.StringType()), T.StructField("test_paired", T.StringType()),
    T.StructField("test_unpaired", T.StringType()), T.StructField("reference_mean", T.DoubleType()),
    T.StructField("reference_std", T.DoubleType()), T.StructField("sample_count", T.LongType()),
])
PROFILE = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("benchmark", T.StringType()),
    T.StructField("reference_models", T.ArrayType(T.StringType())),
    T.StructField("reference_run_ids", T.ArrayType(T.StringType())),
    T.StructField("total_sessions", T.LongType()), T.StructField("bootstrap_b", T.LongType()),
    T.StructField("bootstrap_seed", T.LongType()), T.StructField("threshold_percentile", T.LongType()),
    T.StructField("alpha", T.DoubleType()), T.StructField("correction_method", T.StringType()),
    T.StructField("category_thresholds", T.MapType(T.StringType(), T.ArrayType(THRESHOLD))),
    T.StructField("global_thresholds", T.ArrayType(THRESHOLD)),
])


def _threshold_struct() -> F.Column:
    return F.struct(F.col("metric").alias("metric_name"), "value", "ci_lower", "ci_upper", "metric_type",
                    "test_paired", "test_unpaired", "reference_mean", "reference_std",
                    F.col("sample_count").cast("long").alias("sample_count"))


def profile_document(flat: DataFrame, *, created_at: str, benchmark: str, reference_models, reference_run_ids,
                     total_sessions: int, bootstrap_b: int, seed: int, percentile: int, alpha: float,
                     version: str = "1.0.0") -> DataFrame:
    """Flat profile table -> one-row DataFrame with the JSON document in ``json``."""
    per = (flat.filter(F.col("category") != "global").groupBy("category")
           .agg(F.array_sort(F.collect_list(_threshold_struct())).alias("t")))
    cats = per.agg(F.map_from_entries(F.collect_list(F.struct("category", "t"))).alias("category_thresholds"))
    glob = flat.filter(F.col("category") == "global").agg(
        F.array_sort(F.collect_list(_threshold_struct())).alias("global_thresholds"))
    doc = cats.withColumn("_k", F.lit(1)).join(glob.withColumn("_k", F.lit(1)), "_k")
    meta = F.struct(
        F.lit(version).alias("version"), F.lit(created_at).alias("created_at"), F.lit(benchmark).alias("benchmark"),
        F.array(*[F.lit(m) for m in reference_models]).cast("array<string>").alias("reference_models"),
        F.array(*[F.lit(r) for r in reference_run_ids]).cast("array<string>").alias("reference_run_ids"),
        F.lit(total_sessions).cast("long").alias("total_sessions"),
        F.lit(bootstrap_b).cast("long").alias("bootstrap_b"), F.lit(seed).cast("long").alias("bootstrap_seed"),
        F.lit(percentile).cast("long").alias("threshold_percentile"), F.lit(alpha).alias("alpha"),
        F.lit("benjamini-hochberg").alias("correction_method"),
        F.coalesce("category_thresholds", F.create_map().cast("map<string,array<" + THRESHOLD.simpleString() + ">>"))
        .alias("category_thresholds"),
        F.coalesce("global_thresholds", F.array().cast("array<" + THRESHOLD.simpleString() + ">"))
        .alias("global_thresholds"))
    return doc.select(F.to_json(meta).alias("json"))


def save_profile(doc: DataFrame, path: str) -> None:
    """Write the one-row document (a single small text file)."""
    doc.coalesce(1).write.mode("overwrite").text(path)


def _document(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        raw = spark.read.text(path)
        raw.schema  # noqa: B018 - resolve now so a missing path raises here
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return raw.select(F.from_json("value", PROFILE).alias("p")).select("p.*")


def load_profile_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved profile's metadata as one row; ``None`` if the path does not exist."""
    doc = _document(spark, path)
    return None if doc is None else doc.drop("category_thresholds", "global_thresholds")


def load_profile(spark: SparkSession, path: str) -> DataFrame | None:
    """Read a saved profile back as the flat table; ``None`` if the path does not exist."""
    doc = _document(spark, path)
    if doc is None:
        return None
    per = doc.select(F.explode("category_thresholds").alias("category", "ts")).select(
        "category", F.explode("ts").alias("t"))
    glob = doc.select(F.lit("global").alias("category"), F.explode("global_thresholds").alias("t"))
    flat = per.unionByName(glob)
    return flat.select("category", F.col("t.metric_name").alias("metric"), "t.value", "t.ci_lower", "t.ci_upper",
                       "t.metric_type", "t.test_paired", "t.test_unpaired", "t.reference_mean",
                       "t.reference_std", "t.sample_count")
