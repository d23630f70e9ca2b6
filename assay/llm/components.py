"""Connected components of an undirected graph whose edges are rows of a DataFrame.

Large-star and small-star steps (Kiveris et al., 2014): each hangs neighbours on the
least node seen. Minima are pre-aggregated, so a node with very many edges costs one row
a task, and edges stay as many as they were. Every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.batches import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of an edge (a, b), and the least node it reaches."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = written(_small(_large(now)).filter("a <> b").distinct(), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    return written(now.select(F.col("a").alias("node"), F.col("b").alias("component"))
                   .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct(), "components")
