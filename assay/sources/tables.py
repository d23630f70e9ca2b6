"""A1/A2 — parquet scans of the driver tables.

Scans are lazy: Catalyst prunes the columns a query uses and pushes filters
into the parquet reader, so callers select what they need and never read a
whole table eagerly.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A1 — scan one table (all columns are available; pruning is Catalyst's)."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """A1 — bronze: every table as a temp view (the SQL entry point)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
