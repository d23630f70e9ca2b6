"""Running numbering and carried values within a key, safe for hot keys.

A window ``PARTITION BY key ORDER BY ...`` sends every row of a key to one
task. These helpers split the keys:

* normal keys (at most ``hot_rows`` rows) use the plain window;
* hot keys (found by a partial-aggregated count; at most N / hot_rows of them)
  are range-partitioned on (key, order) so one key spans many tasks, numbered
  locally per (partition, key), and corrected with per-partition carries — the
  row count and the last non-null value of the earlier partitions of the same
  key (a small table: one row per (partition, hot key)).

Results are identical on both paths (tested with a tiny threshold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.session import ensure_checkpoint_dir

DEFAULT_HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows (there are at most N / hot_rows of them)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(*keys)


def _plain(df: DataFrame, keys, order, value_col, rn_col, prev_col) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rn_col, F.row_number().over(w))
    if value_col:
        out = out.withColumn(prev_col, F.last(value_col, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)))
    return out


def _scan(df: DataFrame, keys, order, value_col, rn_col, prev_col, num_partitions: int) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    # stable partition ids: the range-partitioned rows are written to the checkpoint folder
    ranged = df.repartitionByRange(num_partitions, *keys, *order).checkpoint()
    x = ranged.withColumn("_pid", F.spark_partition_id())
    wl = Window.partitionBy("_pid", *keys).orderBy(*order)
    x = x.withColumn("_lrn", F.row_number().over(wl))
    aggs = [F.count(F.lit(1)).alias("_c")]
    if value_col:
        x = x.withColumn("_lprev", F.last(value_col, ignorenulls=True).over(
            wl.rowsBetween(Window.unboundedPreceding, -1)))
        aggs.append(F.max_by(F.col(value_col), F.when(F.col(value_col).isNotNull(), F.struct(*order)))
                    .alias("_last"))
    summ = x.groupBy("_pid", *keys).agg(*aggs)
    wk = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [F.coalesce(F.sum("_c").over(wk), F.lit(0)).alias("_off")]
    if value_col:
        carry_cols.append(F.last("_last", ignorenulls=True).over(wk).alias("_carry"))
    carry = summ.select("_pid", *keys, *carry_cols)
    out = x.join(carry, ["_pid", *keys]).withColumn(rn_col, (F.col("_off") + F.col("_lrn")).cast("int"))
    if value_col:
        out = out.withColumn(prev_col, F.coalesce("_lprev", "_carry"))
    return out.drop("_pid", "_lrn", "_lprev", "_off", "_carry")


def number_within(df: DataFrame, keys: list[str], order: list[str], *, value_col: str | None = None,
                  rn_col: str = "rn", prev_col: str = "prev_value", hot_rows: int = DEFAULT_HOT_ROWS,
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``rn_col`` = row_number within ``keys`` by ``order`` and, when ``value_col``
    is given, ``prev_col`` = its last non-null value strictly before the row."""
    hot = hot_keys(df, keys, hot_rows)
    # the hot-key table is bounded by N / hot_rows rows; it is checked before broadcasting
    n_hot = hot.limit(10_001).count()
    if n_hot == 0:
        return _plain(df, keys, order, value_col, rn_col, prev_col)
    hot_b = F.broadcast(hot) if n_hot <= 10_000 else hot
    normal = df.join(hot_b, keys, "left_anti")
    heavy = df.join(hot_b, keys, "left_semi")
    parts = num_partitions or max(2, df.sparkSession.sparkContext.defaultParallelism)
    a = _plain(normal, keys, order, value_col, rn_col, prev_col)
    b = _scan(heavy, keys, order, value_col, rn_col, prev_col, parts)
    return a.unionByName(b.select(*a.columns))
