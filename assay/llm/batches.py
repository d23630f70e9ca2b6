"""Small helpers shared by the operators: Arrow batches cut by bytes, and tables
written to the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import ensure_checkpoint_dir, ship_package

#: Text bytes that a Python worker holds at a time (a longer text stands alone).
CHUNK_BYTES = 4 << 20


def byte_lengths(col: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(batch: pa.RecordBatch, by: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose column ``by`` holds about ``limit`` bytes each."""
    if batch.num_rows == 0:
        return
    part = np.cumsum(byte_lengths(batch.column(by))) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def release() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task would
    keep it from the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_chunks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema,
               by: str) -> DataFrame:
    """``mapInArrow`` over slices bounded in bytes; ``fn`` sees one slice at a time."""
    ship_package(df.sparkSession)

    def run(it):
        for batch in it:
            for piece in chunks(batch, by):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out
        release()

    return df.mapInArrow(run, schema)


def texts_of(df: DataFrame, *cols: str, text: str = "text") -> DataFrame:
    """The named columns and ``text`` as bytes; nothing else is read."""
    return df.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").cast("binary").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the lineage ends
    here, and a lost executor costs no more than the reading of its files."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
