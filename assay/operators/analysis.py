"""Dashboard analysis operators (D8-D20, B5-B11, E1, I17) over a merged score frame.

Score means (KPI, radar, complexity bins) use exact fixed-point sums: the
dashboard metrics are 4-decimal scores or 0/1 flags.

Every operator takes a metric list and skips metrics that are absent from the
frame. Group-level statistics are ``groupBy`` aggregates (partial aggregation
before the shuffle); exact quartiles come from running counts (``prefix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.prefix import exact_quantiles, prefix_scan, value_counts
from assay.operators.stats import CAND, REF, joined, welch

# fixed values: language code -> label, and the dashboard's metric columns
LANGUAGE_MAP = {1: "English", 2: "Spanish", 3: "Portuguese"}
BOOL_COLS = ["correctness", "guidelines", "class_exact_match", "refusal_detection", "pass_at_k",
             "hedging_detection"]
FLOAT_COLS = ["token_overlap_f1", "groundedness", "pass_at_k_best_score", "question_response_overlap",
              "response_length_ratio", "rouge_l", "chunk_attribution", "self_consistency",
              "self_consistency_variance"]


def present(df: DataFrame, metrics: list[str]) -> list[str]:
    return [m for m in metrics if m in df.columns]


def language_label(code) -> Column:
    """B6 — language code to label, else 'Unknown'."""
    m = F.create_map(*[x for k, v in LANGUAGE_MAP.items() for x in (F.lit(k), F.lit(v))])
    c = F.col(code) if isinstance(code, str) else code
    return F.coalesce(F.try_element_at(m, c.cast("int")), F.lit("Unknown"))


def melt(df: DataFrame, id_cols: list[str], metrics: list[str]) -> DataFrame:
    """Long ``(ids..., metric, value)`` over the present metrics (booleans -> 1.0/0.0), nulls kept."""
    ms = present(df, metrics)
    wide = df.select(*id_cols, *[F.col(m).cast("double").alias(m) for m in ms])
    return wide.unpivot(id_cols, ms, "metric", "value")


def descriptive_stats(long: DataFrame, group: list[str]) -> DataFrame:
    """D8/D9/D15 — mean, sample std/variance (NULL if n <= 1), cv (NULL if mean 0),
    linear-interpolation quartiles, iqr, min, max, count; NULLs ignored.

    Quartiles are read off running counts of the distinct values, scanned over range
    partitions; no buffer holds a group's values.
    """
    v = F.col("value")
    g = long.filter(v.isNotNull()).groupBy(*group).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("variance"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"))
    q = exact_quantiles(value_counts(long, group), group, (0.25, 0.5, 0.75))
    cv = F.when(F.col("std").isNull() | (F.col("mean") == 0), F.lit(None).cast("double")).otherwise(
        F.col("std") / F.col("mean"))
    return joined(g, q, group).select(*group, "mean", "std", "variance", cv.alias("cv"), F.col("q0").alias("q1"), F.col("q1").alias("q2"),
                                      F.col("q2").alias("q3"), (F.col("q2") - F.col("q0")).alias("iqr"), "min", "max", "count")


def z_scores(long: DataFrame, group: list[str]) -> DataFrame:
    """E1 — (x - mean) / sample std per group; NULL when n < 2 or std = 0; NULL x stays NULL.

    Group moments are an aggregate joined back on the group key (AQE
    broadcasts it when small), not a window holding a whole group in one task.
    """
    m = long.groupBy(*group).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"),
                                 F.count("value").alias("_n"))
    j = long.join(m, group)
    z = F.when((F.col("_n") < 2) | (F.col("_s") == 0) | F.col("_s").isNull(), F.lit(None).cast("double")) \
        .otherwise((F.col("value") - F.col("_m")) / F.col("_s"))
    return j.withColumn("z_score", z).drop("_m", "_s", "_n")


def kpi_cards(df: DataFrame, metrics: list[str]) -> DataFrame:
    """D10 — overall mean and sample std per metric (one aggregate, stacked to long)."""
    return melt(df, [], metrics).filter(F.col("value").isNotNull()).groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def radar_profile(df: DataFrame, metrics: list[str], group_col: str) -> DataFrame:
    """D11 — mean per metric per group."""
    return (melt(df, [group_col], metrics).filter(F.col("value").isNotNull())
            .groupBy(group_col, "metric").agg(F.avg("value").alias("mean")))


def failure_mode_counts(df: DataFrame, group_col: str) -> DataFrame:
    """D12 — counts by (group, failure mode); NULL mode -> 'none'."""
    return (df.select(group_col, F.coalesce("failure_mode", F.lit("none")).alias("failure_mode"))
            .groupBy(group_col, "failure_mode").agg(F.count(F.lit(1)).alias("count")))


def sankey_edges(df: DataFrame) -> DataFrame:
    """D13 — edges category -> refusal label -> failure mode with counts (two levels)."""
    refused = F.when(F.coalesce(F.col("refusal_detection").cast("double"), F.lit(0.0)) == 1.0, "refused") \
        .otherwise("not_refused")
    t = df.select(F.col("data_category_QA").alias("category"), refused.alias("refusal_label"),
                  F.coalesce("failure_mode", F.lit("none")).alias("failure_mode"))
    e1 = t.groupBy(F.col("category").alias("source"), F.col("refusal_label").alias("target")).agg(
        F.count(F.lit(1)).alias("value")).withColumn("level", F.lit(1))
    e2 = t.groupBy(F.col("refusal_label").alias("source"), F.col("failure_mode").alias("target")).agg(
        F.count(F.lit(1)).alias("value")).withColumn("level", F.lit(2))
    return e1.unionByName(e2)


def sankey_nodes(df: DataFrame) -> DataFrame:
    """D13 — the flow's nodes (layer, label, node): categories, refusal labels and failure
    modes, each layer sorted by label (null first), numbered from 0 through the layers."""
    e = sankey_edges(df)
    first = e.filter("level = 1")
    labels = (first.select(F.lit(1).alias("layer"), F.col("source").alias("label"))
              .union(first.select(F.lit(2), "target")).union(e.filter("level = 2").select(F.lit(3), "target")))
    numbered = prefix_scan(labels.distinct().withColumn("one", F.lit(1)), [], [F.col("layer"), F.col("label")], sums=["one"])
    return numbered.select("layer", "label", F.coalesce("one_before", F.lit(0)).cast("long").alias("node"))


def complexity_bins(df: DataFrame, metrics: list[str], group_col: str, x_col: str = "input_len",
                    n_bins: int = 5) -> DataFrame:
    """D14 — mean score by equal-width, right-closed bin of ``x_col`` (as pandas.cut with
    an integer bin count): bin = max(1, ceil((x - min) / (max - min) * n)); a constant
    ``x`` puts every row in the middle bin. Global min and max are one scalar subquery."""
    ends = df.select(F.struct(F.min(x_col).cast("double").alias("lo"), F.max(x_col).cast("double").alias("hi"))).scalar()
    lo, hi = ends["lo"], ends["hi"]
    x = F.col(x_col).cast("double")
    b = F.when(hi == lo, F.lit((n_bins + 1) // 2)).otherwise(
        F.greatest(F.lit(1), F.ceil((x - lo) / (hi - lo) * n_bins).cast("int")))
    binned = df.withColumn("complexity_bin", b.cast("int"))
    long = melt(binned, [group_col, "complexity_bin"], metrics)
    return long.groupBy(group_col, "complexity_bin", "metric").agg(F.avg("value").alias("mean")) \
        .filter(F.col("mean").isNotNull())


def apply_filters(df: DataFrame, models=None, categories=None, languages=None, failure_modes=None,
                  score_ranges: dict | None = None, model_col: str = "model_label") -> DataFrame:
    """B8 — conjunctive filter; an empty list means no filter; a metric range keeps NULLs."""
    cond = F.lit(True)
    if models:
        cond = cond & F.col(model_col).isin(list(models))
    if categories and "data_category_QA" in df.columns:
        cond = cond & F.col("data_category_QA").isin(list(categories))
    if languages and "language_label" in df.columns:
        cond = cond & F.col("language_label").isin(list(languages))
    if failure_modes and "failure_mode" in df.columns:
        cond = cond & F.col("failure_mode").isin(list(failure_modes))
    for m, (lo, hi) in (score_ranges or {}).items():
        if m in df.columns:
            cond = cond & (F.col(m).isNull() | F.col(m).between(lo, hi))
    return df.filter(cond)


def filter_options(df: DataFrame, dims: dict[str, str]) -> DataFrame:
    """B9 — sorted distinct non-null values per dimension: long (dimension, value)."""
    parts = None
    for name, col in dims.items():
        if col not in df.columns:
            continue
        p = df.select(F.lit(name).alias("dimension"), F.col(col).cast("string").alias("value")) \
            .filter(F.col("value").isNotNull()).distinct()
        parts = p if parts is None else parts.unionByName(p)
    return parts


def metric_ranges(df: DataFrame, metrics: list[str]) -> DataFrame:
    """B10 — slider range per metric: (min, max); all-NULL -> (0, 1); dropped when min == max."""
    r = melt(df, [], metrics).groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    r = r.select("metric", F.coalesce("lo", F.lit(0.0)).alias("min_value"),
                 F.coalesce("hi", F.lit(1.0)).alias("max_value"))
    return r.filter(F.col("min_value") != F.col("max_value"))


def available_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """B11 — metrics with at least one non-null value."""
    return melt(df, [], metrics).groupBy("metric").agg(F.count("value").alias("n_values")) \
        .filter(F.col("n_values") > 0)


def filter_summary(original: DataFrame, filtered: DataFrame, model_col: str = "model_label") -> DataFrame:
    """D19 — filtered / total rows and distinct models after filtering (one row)."""
    t = original.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("_k", F.lit(1))
    f = filtered.agg(F.count(F.lit(1)).alias("filtered_rows"),
                     F.countDistinct(model_col).alias("n_models")).withColumn("_k", F.lit(1))
    return f.join(t, "_k").drop("_k")


def low_sample_groups(df: DataFrame, group_col: str, min_rows: int = 2) -> DataFrame:
    """D20 — groups with fewer than ``min_rows`` rows."""
    return df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") < min_rows)


def comparison_table(df: DataFrame, metrics: list[str], model_a: str, model_b: str,
                     group_col: str = "model_label") -> DataFrame:
    """I16/I17 — per metric: means and sample stds of two groups, delta, relative delta %
    (NULL if mean_b is 0), Welch p-value (NULL if n < 2), significant = p < 0.05."""
    long = melt(df.filter(F.col(group_col).isin(model_a, model_b)), [group_col], metrics) \
        .filter(F.col("value").isNotNull()) \
        .withColumn("side", F.when(F.col(group_col) == model_a, CAND).otherwise(REF))
    w = welch(long, ["metric"])
    delta = F.col("m1") - F.col("m2")
    rel = F.when((F.col("m2") == 0) | F.col("m2").isNull(), F.lit(None).cast("double")) \
        .otherwise(delta / F.col("m2") * 100)
    return w.select("metric", F.col("m1").alias("mean_a"), F.sqrt("v1").alias("std_a"),
                    F.col("m2").alias("mean_b"), F.sqrt("v2").alias("std_b"), delta.alias("delta"),
                    rel.alias("relative_delta_pct"), "p_value",
                    F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"))


def comparison_stats(df: DataFrame, metrics: list[str], model_a: str, model_b: str,
                     group_col: str = "model_label") -> DataFrame:
    """I17 — per metric the descriptive statistics (D8) of two groups side by side (``a_*``,
    ``b_*``), the delta of the means and the relative delta in percent (NULL if b's mean is 0).
    A metric that only one group has stays, with NULLs on the other side."""
    side = F.when(F.col(group_col) == model_a, "a").otherwise("b")
    long = melt(df.filter(F.col(group_col).isin(model_a, model_b)), [group_col], metrics).withColumn("side", side)
    stats = descriptive_stats(long, ["metric", "side"])
    names = [c for c in stats.columns if c not in ("metric", "side")]
    wide = stats.groupBy("metric").agg(*[
        F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("a", "b") for c in names])
    delta = F.col("a_mean") - F.col("b_mean")
    return wide.withColumns({"delta": delta, "relative_delta_pct": F.when(F.col("b_mean") != 0, delta / F.col("b_mean") * 100)})


def first_of_session(df: DataFrame, session_col: str = "session_id", order_col: str = "attempt") -> DataFrame:
    """B14 — the first row (lowest ``order_col``) of every session.

    A ``min_by`` aggregate (partial aggregation before the shuffle), so a
    session with very many rows is reduced map-side instead of being sorted
    in one task as a window would.
    """
    others = [c for c in df.columns if c != session_col]
    row = F.min_by(F.struct(*others), F.struct(order_col, *[c for c in others if c != order_col]))
    return df.groupBy(session_col).agg(row.alias("_r")).select(session_col, "_r.*")
