"""D-family aggregations over long score tables.

Every aggregate is a ``groupBy`` with map-side partial aggregation, so a hot
group (one category holding a third of all rows) costs one partial row per
task before the shuffle, never a single task holding the group's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.numeric import fixed_mean, fixed_var_pop, round_even

# fixed values: metric registry (name -> type); booleans become 1.0/0.0
METRIC_TYPES = {
    "token_overlap_f1": "continuous",
    "groundedness": "continuous",
    "refusal_detection": "binary",
    "class_exact_match": "binary",
    "pass_at_k": "binary",
    "hedging_detection": "binary",
    "question_response_overlap": "continuous",
    "response_length_ratio": "continuous",
    "rouge_l": "continuous",
    "chunk_attribution": "continuous",
    "self_consistency": "continuous",
}
# fixed values: test names per metric type (paired, unpaired)
TEST_MAP = {
    "continuous": ("wilcoxon", "mannwhitneyu"),
    "binary": ("mcnemar", "chi2"),
    "composite": ("bootstrap", "bootstrap"),
}


def to_double(c: Column) -> Column:
    """B5 — booleans to 1.0/0.0, numbers to double, NULL kept."""
    return c.cast("double")


def unpivot_metrics(df: DataFrame, id_cols: list[str], metrics: list[str],
                    name_col: str = "scorer_name", value_col: str = "value",
                    drop_nulls: bool = True) -> DataFrame:
    """Wide metric columns -> long ``(ids..., scorer_name, value double)``.

    Metrics absent from ``df`` are skipped; NULL (not applicable) values are
    dropped unless ``drop_nulls=False``.
    """
    present = [m for m in metrics if m in df.columns]
    if not present:
        raise ValueError("none of the metric columns is present")
    wide = df.select(*id_cols, *[to_double(F.col(m)).alias(m) for m in present])
    long = wide.unpivot(id_cols, present, name_col, value_col)
    return long.filter(F.col(value_col).isNotNull()) if drop_nulls else long


def _metric_aggs(value_col: str = "value") -> list[Column]:
    """mean / population std / count of 4-decimal scores (exact fixed-point sums)."""
    n = F.count(value_col)
    return [
        round_even(fixed_mean(value_col), 4).alias("mean"),
        round_even(F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(fixed_var_pop(value_col))), 4).alias("std"),
        n.alias("count"),
    ]


def aggregate_scores(long: DataFrame, group_cols: list[str] | None = None,
                     name_col: str = "scorer_name") -> DataFrame:
    """D1/D2 — mean, population std (0 if n<2), non-null count per scorer."""
    group_cols = list(group_cols or [])
    return long.groupBy(*group_cols, name_col).agg(*_metric_aggs())


def aggregate_overall_and_by(long: DataFrame, by: str = "category", outer: list[str] | None = None,
                             name_col: str = "scorer_name") -> DataFrame:
    """D1 + D2 in one pass: grouping sets ((outer, scorer), (outer, by, scorer)).

    Rows of the overall set carry ``<by> = NULL`` and ``level = 'overall'``.
    """
    outer = list(outer or [])
    g = long.groupingSets([[*outer, name_col], [*outer, by, name_col]], *outer, by, name_col)
    return g.agg(*_metric_aggs(), F.grouping(by).alias("_g")).select(
        *outer, by, name_col, "mean", "std", "count",
        F.when(F.col("_g") == 1, "overall").otherwise(F.col(by)).alias("level"))


def flat_run_metrics(agg: DataFrame, outer: list[str], name_col: str = "scorer_name",
                     modes: DataFrame | None = None, mode_col: str = "failure_mode") -> DataFrame:
    """D3 — ``{scorer}_mean`` and ``{scorer}_std`` as long key/value rows; with the rows of
    ``failure_mode_rates`` also ``total_scored`` and of each mode (null: unknown)
    ``failure_mode_{mode}_count`` and ``failure_mode_{mode}_rate``."""
    means = agg.select(*outer, F.concat(F.col(name_col), F.lit("_mean")).alias("metric_key"),
                       F.col("mean").alias("metric_value"))
    stds = agg.select(*outer, F.concat(F.col(name_col), F.lit("_std")).alias("metric_key"),
                      F.col("std").alias("metric_value"))
    flat = means.unionByName(stds)
    if modes is None:
        return flat
    total = modes.groupBy(*outer).agg(F.max("total_scored").cast("double").alias("metric_value")).select(
        *outer, F.lit("total_scored").alias("metric_key"), "metric_value")
    name = F.concat(F.lit("failure_mode_"), F.coalesce(mode_col, F.lit("unknown")))
    parts = [modes.select(*outer, F.concat(name, F.lit(f"_{x}")).alias("metric_key"), F.col(x).cast("double").alias("metric_value"))
             for x in ("count", "rate")]
    return flat.unionByName(total).unionByName(parts[0]).unionByName(parts[1])


def failure_mode_rates(df: DataFrame, outer: list[str], mode_col: str = "failure_mode") -> DataFrame:
    """D4 — count and rate (count / scored rows, round 4) per failure mode.

    The per-group total is a window sum over the already aggregated counts
    (at most 7 rows per group), so no second pass over ``df``.
    """
    counts = df.groupBy(*outer, mode_col).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*outer))
    return counts.select(*outer, mode_col, "count", total.alias("total_scored"),
                         round_even(F.col("count") / total, 4).alias("rate"))


def completeness_gate(long: DataFrame, group_cols: list[str], name_col: str = "metric",
                      value_col: str = "value") -> DataFrame:
    """D5/D6 — keep a metric in a group only if every session of the group has it.

    ``long`` carries one row per (group, session, metric) with NULL values
    kept (``unpivot_metrics(..., drop_nulls=False)``), so the gate is
    ``count(value) = count(*)`` per (group, metric). Complete pairs are
    semi-joined back; NULLs are removed.
    """
    complete = (long.groupBy(*group_cols, name_col)
                .agg((F.count(value_col) == F.count(F.lit(1))).alias("ok"))
                .filter("ok").drop("ok"))
    return long.filter(F.col(value_col).isNotNull()).join(complete, [*group_cols, name_col], "left_semi")


def dropped_metrics(long: DataFrame, group_cols: list[str], name_col: str = "metric",
                    value_col: str = "value") -> DataFrame:
    """Report of (group, metric) pairs removed by the completeness gate (Q6)."""
    return (long.groupBy(*group_cols, name_col)
            .agg(F.count(F.lit(1)).alias("n_sessions"), F.count(value_col).alias("n_values"))
            .filter(F.col("n_values") < F.col("n_sessions")))
