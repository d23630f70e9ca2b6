"""A10, A13 — a table of traces, laid out by run, and the ways to look into it.

Traces are appended as Parquet under one folder a run (``run_id=...``), so a search within
some runs opens the files of those runs only: with the ids given, partition pruning; with the
ids in another table, dynamic pruning from the join. Existence is a semi join, never a count.

Defined cases: a trace without a run has the run NULL and is found by a search for NULL
runs; repeated traces stay as often as they were written; a search for nothing finds
nothing; a table that was never written is empty.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: columns of a trace
TRACE_SCHEMA = T.StructType([
    T.StructField("trace_id", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("attempt", T.IntegerType()), T.StructField("created_at", T.LongType()),
    T.StructField("input_text", T.StringType()), T.StructField("output_text", T.StringType()),
    T.StructField("run_id", T.StringType()),
])
#: Files of a run are cut beyond so many rows.
ROWS_PER_FILE = 1_000_000


def append_traces(traces: DataFrame, path: str, mode: str = "append") -> None:
    """Writes traces below their runs. A run may hold any share of the rows: its rows are dealt
    to the tasks by trace, not by run, and its files are cut by rows."""
    width = int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (traces.select(*[F.col(f.name).cast(f.dataType) for f in TRACE_SCHEMA.fields])
             .repartition(width, F.pmod(F.xxhash64("trace_id"), F.lit(width))).sortWithinPartitions("run_id", "session_id", "created_at"))
    dealt.write.mode(mode).partitionBy("run_id").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


def _missing(e: AnalysisException) -> bool:
    return (e.getCondition() or "").startswith(("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """The whole table; only a path that does not exist counts as empty, other errors are raised."""
    try:
        return spark.read.schema(TRACE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], TRACE_SCHEMA)


def search_traces(traces: DataFrame, run_ids: Iterable[str | None] | DataFrame) -> DataFrame:
    """A10 — traces of the given runs: ids, or a table with a column run_id."""
    if isinstance(run_ids, DataFrame):
        wanted = run_ids.select(F.col("run_id").alias("_wanted")).distinct()
        return traces.join(wanted, traces["run_id"].eqNullSafe(F.col("_wanted")), "left_semi")
    named = [r for r in dict.fromkeys(run_ids)]
    found = F.col("run_id").isin([r for r in named if r is not None]) if any(r is not None for r in named) else F.lit(False)
    return traces.filter(found | F.col("run_id").isNull() if None in named else found)


def find_by_session(traces: DataFrame, session_id: str) -> DataFrame:
    """A13 — traces of one session, oldest first (one session's rows are sorted)."""
    return traces.filter(F.col("session_id") == session_id).orderBy("created_at", "trace_id")


def with_existence(sessions: DataFrame, traces: DataFrame, column: str = "has_trace") -> DataFrame:
    """A13 — each session with a flag, whether it has a trace. Traces are reduced to one row a
    session before the join, so a session of very many traces costs one row."""
    seen = traces.select(F.col("session_id").alias("_seen")).filter("_seen is not null").distinct()
    return sessions.join(seen, F.col("session_id") == F.col("_seen"), "left").withColumn(column, F.col("_seen").isNotNull()).drop("_seen")
