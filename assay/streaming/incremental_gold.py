"""L1 — incremental gold build from appended prediction files (Structured Streaming).

``readStream`` on the JSON-lines folder with the declared schema, ``trigger(availableNow=True)``
and a ``foreachBatch`` that appends only keys (run_id, id, attempt) that no earlier batch holds.
No streaming state is kept: the target is the record of what has been written.

Each batch has a folder of its own, named by the stream's id and the batch's number, so a batch
that runs again after a failure overwrites itself and no other. A batch counts once its row
stands in the manifest (``<target>.batches``), which is written last; ``gold`` reads the batches
listed there. Rows lie in ``BUCKETS`` buckets by the hash of their run, and a batch looks for
known keys only in the buckets of its own runs.

Beside the rows each batch leaves partial sums by run (``<target>.sums``): running means and
failure-mode rates add up the sums of the listed batches and never read the rows again.

Defined cases: null keys are equal to each other; of rows of one key in a batch the greatest
by all other columns stays; NaN and null scores count nowhere; a batch without new rows is
listed too; a target that can't be read ends the batch in an error. One stream at a time may
write a target; a new checkpoint folder is a new stream, whose repeated keys add nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.numeric import rnd
from assay.sources.medallion import PREDICTION_SCHEMA

KEYS = ["run_id", "id", "attempt"]
BUCKETS = 64
#: The stream's id as Spark tells it to the jobs of a batch.
STREAM_ID = "sql.streaming.queryId"

GOLD_SCHEMA = T.StructType([*PREDICTION_SCHEMA.fields, T.StructField("batch", T.StringType()),
                            T.StructField("run_bucket", T.IntegerType())])
BATCH_SCHEMA = "n_rows long, batch string"
SUM_SCHEMA = "run_id string, metric string, failure_mode string, n long, total decimal(38,12), batch string"
METRICS = [f.name for f in PREDICTION_SCHEMA.fields if f.dataType in (T.DoubleType(), T.BooleanType())]


def _read(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at ``path``, None if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # a target that can't be read is no empty target: appending would repeat its rows
        return None


def _listed(spark: SparkSession, path: str, target: str, schema) -> DataFrame | None:
    """Rows at ``path`` of the batches that the manifest lists."""
    rows, done = _read(spark, path, schema), _read(spark, f"{target}.batches", BATCH_SCHEMA)
    return None if rows is None or done is None else rows.join(done.select("batch"), "batch", "left_semi")


def gold(spark: SparkSession, target: str) -> DataFrame:
    """Rows of the finished batches, in the columns of the predictions."""
    rows = _listed(spark, target, target, GOLD_SCHEMA)
    rows = spark.createDataFrame([], GOLD_SCHEMA) if rows is None else rows
    return rows.select(*PREDICTION_SCHEMA.fieldNames())


def unseen(batch: DataFrame, name: str, target: str) -> DataFrame:
    """Rows of ``batch``, one a key, whose key is in no finished batch of another name."""
    spark = batch.sparkSession
    others = [c for c in batch.columns if c not in KEYS]
    new = (batch.groupBy(*KEYS).agg(F.max(F.struct(*others)).alias("_row")).select(*KEYS, "_row.*")
           .withColumn("run_bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int")))
    known = _listed(spark, target, target, GOLD_SCHEMA)
    if known is None:
        return new
    # at most BUCKETS numbers: a filter on the partitions that the scan reads
    buckets = [r["run_bucket"] for r in new.select("run_bucket").distinct().collect()]
    known = known.filter((F.col("batch") != name) & F.col("run_bucket").isin(buckets)).select("run_bucket", *KEYS)
    new, known = new.alias("n"), known.alias("k")
    same = F.col("n.run_bucket") == F.col("k.run_bucket")
    for c in KEYS:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}"))
    return new.join(known, same, "left_anti")


def partial_sums(rows: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Counts and exact decimal sums of each run's scores, and its count of each failure mode."""
    scores = rows.select("run_id", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["run_id"], metrics, "metric", "value").withColumn("value", F.col("value").cast("decimal(38,12)"))
    sums = scores.filter("value is not null").groupBy("run_id", "metric").agg(
        F.lit(None).cast("string").alias("failure_mode"), F.count("value").alias("n"),
        F.sum("value").cast("decimal(38,12)").alias("total"))
    modes = rows.groupBy("run_id", F.lit("failure_mode").alias("metric"), F.coalesce("failure_mode", F.lit("none")).alias("failure_mode")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("decimal(38,12)").alias("total"))
    return sums.unionByName(modes)


def append_batch(batch: DataFrame, name: str, target: str) -> None:
    """Write the new rows of one batch, their sums, and last the manifest's row. The same
    batch under the same name again leaves the same target."""
    spark = batch.sparkSession
    path = f"{target}/batch={name}"
    unseen(batch, name, target).write.mode("overwrite").partitionBy("run_bucket").parquet(path)
    written = spark.read.schema(T.StructType(GOLD_SCHEMA.fields[:-2])).parquet(path)
    partial_sums(written).write.mode("overwrite").parquet(f"{target}.sums/batch={name}")
    written.agg(F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").parquet(f"{target}.batches/batch={name}")


def incremental_gold(spark: SparkSession, source_dir: str, target: str, checkpoint: str,
                     max_files_per_trigger: int | None = None) -> None:
    """Process every prediction file not yet seen, then stop (availableNow)."""
    reader = spark.readStream.schema(PREDICTION_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def each(df: DataFrame, number: int) -> None:
        stream = df.sparkSession.sparkContext.getLocalProperty(STREAM_ID)
        if not stream:
            raise RuntimeError("the batch doesn't tell its stream: two streams could overwrite each other's batches")
        append_batch(df, f"{stream}-{number}", target)

    q = (reader.json(source_dir).writeStream.foreachBatch(each)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def running_run_metrics(spark: SparkSession, target: str, digits: int = 6) -> DataFrame:
    """D1/D4 per run over all finished batches: (run_id, metric, n, mean). Failure modes are
    the metrics ``failure_mode_<mode>`` with their count and their share of the run's rows."""
    sums = _listed(spark, f"{target}.sums", target, SUM_SCHEMA)
    sums = spark.createDataFrame([], SUM_SCHEMA) if sums is None else sums
    per = sums.groupBy("run_id", "metric", "failure_mode").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("run_id"))
    modes = per.filter("metric = 'failure_mode'").select(
        "run_id", F.concat(F.lit("failure_mode_"), "failure_mode").alias("metric"), "n", rnd(share, digits).alias("mean"))
    means = per.filter("metric <> 'failure_mode'").select("run_id", "metric", "n", rnd(F.col("total") / F.col("n"), digits).alias("mean"))
    return means.unionByName(modes)
