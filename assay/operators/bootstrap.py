"""I8, I12-I14 — bootstrap on value histograms, distributed over replicates and slices.

A resample of size n from n values is Multinomial(n, counts / n) over the value
histogram, and a multinomial splits: first how many draws fall into each slice of the
histogram, then the draws inside each slice. So only ``(group, value, count)`` is needed,
and no row holds a group's histogram:

1. ``groupBy(group, value).count()`` — distributed, partial-aggregated, skew-free;
2. running counts cut a group's sorted values into slices of ``SLICE`` values;
3. for each block of replicates the slices' totals are drawn, one number a slice;
4. each (block, slice) is drawn in a task of its own, with
   ``numpy.random.default_rng([seed, group_hash, block, slice])`` — independent of
   partitioning and of the number of executors — and leaves partial sums, added by replicate;
5. quantiles of the replicate means per group (linear interpolation, as numpy's default).

The replicate streams differ from a single sequential generator, so the
numbers are statistically, not bit-for-bit, equal to a sequential bootstrap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators.prefix import prefix_scan, value_counts
from assay.operators.stats import joined

BLOCK = 500  # replicates drawn at a time
SLICE = 4096  # distinct values of a histogram slice


def histogram(long: DataFrame, group: list[str], value_col: str = "value", slice_values: int = SLICE) -> DataFrame:
    """Histogram slices (group..., slice, n, total, hist: array<struct<v, c>> sorted by value)."""
    counts = value_counts(long.select(*group, F.col(value_col).cast("double").alias("v")), group, "v", "c").withColumn("one", F.lit(1).cast("long"))
    placed = prefix_scan(counts, group, [F.col("v")], sums=["one"])
    slices = placed.groupBy(*group, F.floor(F.col("one_before") / slice_values).alias("slice")).agg(
        F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("v", "c"))).alias("hist"))
    return slices.withColumn("total", F.aggregate("hist", F.lit(0.0), lambda acc, x: acc + x["v"] * x["c"]))


def _in_order(value: str) -> F.Column:
    """Sum over a group's slices in their order, whatever the partitioning."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct("slice", F.col(value).alias("x")))), F.lit(0.0), lambda acc, e: acc + e["x"])


def means(slices: DataFrame, group: list[str]) -> DataFrame:
    """n and mean of each group."""
    return slices.groupBy(*group).agg(F.sum("n").alias("n"), _in_order("total").alias("_total")).select(
        *group, "n", (F.col("_total") / F.col("n")).alias("mean"))


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)


def _slice_totals(group: list[str], seed: int):
    """How many of a replicate's draws fall into each slice, for a block of replicates."""
    def draw(batches):
        for pdf in batches:
            out = []
            for d in pdf.to_dict("records"):
                numbers = [s["slice"] for s in d["slices"]]
                n = np.array([s["n"] for s in d["slices"]], dtype=np.int64)
                rng = np.random.default_rng([seed, int(d["_gh"]) & 0x7FFFFFFF, int(d["_block"])])
                drawn = rng.multinomial(n.sum(), n / n.sum(), size=int(d["_size"]))
                frame = {g: [d[g]] * len(numbers) for g in group}
                out.append(pd.DataFrame(frame | {"_gh": d["_gh"], "_block": d["_block"], "slice": numbers, "drawn": list(drawn.T)}))
            if out:
                yield pd.concat(out, ignore_index=True)
    return draw


def _slice_sums(group: list[str], seed: int):
    """Sums of the values that a block's replicates draw from a slice."""
    def draw(batches):
        for pdf in batches:
            out = []
            for d in pdf.to_dict("records"):
                vals = np.array([h["v"] for h in d["hist"]], dtype=np.float64)
                cnts = np.array([h["c"] for h in d["hist"]], dtype=np.float64)
                rng = np.random.default_rng([seed, int(d["_gh"]) & 0x7FFFFFFF, int(d["_block"]), 1 + int(d["slice"])])
                sums = rng.multinomial(np.asarray(d["drawn"], dtype=np.int64), cnts / cnts.sum()) @ vals
                frame = {g: [d[g]] * len(sums) for g in group}
                first = int(d["_block"]) * BLOCK
                out.append(pd.DataFrame(frame | {"slice": d["slice"], "replicate": np.arange(first, first + len(sums), dtype=np.int64), "part": sums}))
            if out:
                yield pd.concat(out, ignore_index=True)
    return draw


def bootstrap_means(slices: DataFrame, group: list[str], bootstrap_b: int, seed: int,
                    key_cols: list[str] | None = None) -> DataFrame:
    """One row per (group, replicate) with the replicate mean.

    ``key_cols`` (default ``group``) name the columns hashed into the random
    stream; passing a sub-key lets two groups share replicate streams.
    """
    key_cols = key_cols or group
    n_blocks = (bootstrap_b + BLOCK - 1) // BLOCK
    sizes = slices.groupBy(*group).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("slice", "n"))).alias("slices"))
    blocks = sizes.select(
        *group, "slices", F.xxhash64(*[F.col(c).cast("string") for c in key_cols]).alias("_gh"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block")).withColumn(
        "_size", F.least(F.lit(BLOCK), F.lit(bootstrap_b) - F.col("_block") * BLOCK))
    # blocks are spread over the cluster by (group, block), a unique, balanced key
    parts = max(1, min(n_blocks * 8, 2 * slices.sparkSession.sparkContext.defaultParallelism))
    keys = _fields(slices, group)
    totals = blocks.repartition(parts, *group, "_block").mapInPandas(
        _slice_totals(group, seed), f"{keys}, _gh bigint, _block int, slice bigint, drawn array<bigint>")
    drawn = joined(totals, slices.select(*group, F.col("slice"), "hist"), [*group, "slice"])
    sums = drawn.repartition(parts, *group, "_block", "slice").mapInPandas(
        _slice_sums(group, seed), f"{keys}, slice bigint, replicate bigint, part double")
    boots = sums.groupBy(*group, "replicate").agg(_in_order("part").alias("_sum"))
    return joined(boots, sizes.select(*group, "n"), group).select(*group, "replicate", (F.col("_sum") / F.col("n")).alias("boot_mean"))


def bootstrap_ci(long: DataFrame, group: list[str], *, bootstrap_b: int = 10_000, seed: int = 42,
                 percentiles=(0.025, 0.975), value_col: str = "value") -> DataFrame:
    """Bootstrap percentiles of the mean per group: n, mean, and one column per percentile."""
    hist = histogram(long, group, value_col).checkpoint()  # read for the totals, the draws and the means
    boots = bootstrap_means(hist, group, bootstrap_b, seed)
    q = boots.groupBy(*group).agg(F.percentile("boot_mean", F.array(*[F.lit(p) for p in percentiles])).alias("_q"))
    out = joined(means(hist, group), q, group)
    return out.select(*group, "n", "mean", *[F.col("_q")[i].alias(f"p{i}") for i in range(len(percentiles))])


def bootstrap_ci_test(long: DataFrame, group: list[str], thresholds: DataFrame, *,
                      bootstrap_b: int = 10_000, seed: int = 42, value_col: str = "value") -> DataFrame:
    """I8 — 95 % bootstrap CI of the candidate mean; reject iff upper < threshold;
    effect = relative difference to the threshold (0 when threshold is 0).
    ``thresholds``: (group..., threshold_value)."""
    from assay.operators.stats import magnitude
    ci = bootstrap_ci(long, group, bootstrap_b=bootstrap_b, seed=seed, value_col=value_col)
    j = ci.join(thresholds, group)
    thr = F.col("threshold_value")
    rel = F.when(thr != 0, (F.col("mean") - thr) / thr).otherwise(F.lit(0.0))
    return j.select(*group, F.lit("bootstrap").alias("test_name"), F.col("mean").alias("statistic"),
                    F.lit(0.0).alias("p_value"), F.lit(0.0).alias("p_value_adjusted"),
                    (F.col("p1") < thr).alias("reject_null"), rel.alias("effect_size"),
                    magnitude(rel, F.lit("continuous")).alias("effect_magnitude"),
                    F.col("p0").alias("ci_lower"), F.col("p1").alias("ci_upper"),
                    F.col("mean").alias("candidate_value"), thr.alias("threshold_value"),
                    F.col("n").alias("sample_size_candidate"), F.lit(0).cast("long").alias("sample_size_reference"),
                    F.lit(False).alias("is_paired"))


def derive_thresholds(long: DataFrame, group: list[str], metric_col: str = "metric", *,
                      bootstrap_b: int = 10_000, seed: int = 42, percentile: float = 5,
                      alpha: float = 0.05, value_col: str = "value") -> DataFrame:
    """I12/I13 — per (category, metric): threshold = percentile of bootstrap means,
    CI at (alpha/2, 1-alpha/2), reference mean, sample std (0 if n = 1), count,
    metric type and test names from the registry (I15)."""
    from assay.operators.aggregate import METRIC_TYPES, TEST_MAP
    pcts = (percentile / 100.0, alpha / 2, 1 - alpha / 2)
    ci = bootstrap_ci(long, group, bootstrap_b=bootstrap_b, seed=seed, percentiles=pcts, value_col=value_col)
    sd = long.groupBy(*group).agg(F.coalesce(F.stddev_samp(value_col), F.lit(0.0)).alias("reference_std"))
    types = F.create_map(*[x for k, v in METRIC_TYPES.items() for x in (F.lit(k), F.lit(v))])
    mtype = F.coalesce(F.try_element_at(types, F.col(metric_col)), F.lit("continuous"))
    paired_t = F.create_map(*[x for k, v in TEST_MAP.items() for x in (F.lit(k), F.lit(v[0]))])
    unpaired_t = F.create_map(*[x for k, v in TEST_MAP.items() for x in (F.lit(k), F.lit(v[1]))])
    return ci.join(sd, group).select(
        *group, F.col("p0").alias("value"), F.col("p1").alias("ci_lower"), F.col("p2").alias("ci_upper"),
        mtype.alias("metric_type"), F.element_at(paired_t, mtype).alias("test_paired"),
        F.element_at(unpaired_t, mtype).alias("test_unpaired"),
        F.col("mean").alias("reference_mean"), "reference_std", F.col("n").alias("sample_count"))


def discrimination_delta(f1_long: DataFrame, *, bootstrap_b: int = 10_000, seed: int = 42,
                         percentile: float = 5, alpha: float = 0.05, category_col: str = "category",
                         value_col: str = "value") -> DataFrame:
    """I14 — bootstrap of |mean(F1 positivo) - mean(F1 negativo)| with independent
    resamples per category, joined on the replicate id. One row (composite metric)."""
    pos_neg = f1_long.filter(F.col(category_col).isin("positivo", "negativo"))
    hist = histogram(pos_neg, [category_col], value_col).checkpoint()
    boots = bootstrap_means(hist, [category_col], bootstrap_b, seed)
    pos = boots.filter(F.col(category_col) == "positivo").select("replicate", F.col("boot_mean").alias("bp"))
    neg = boots.filter(F.col(category_col) == "negativo").select("replicate", F.col("boot_mean").alias("bn"))
    deltas = pos.join(neg, "replicate").select(F.abs(F.col("bp") - F.col("bn")).alias("delta"))
    pcts = F.array(*[F.lit(p) for p in (percentile / 100.0, alpha / 2, 1 - alpha / 2)])
    q = deltas.agg(F.percentile("delta", pcts).alias("_q"), F.stddev_samp("delta").alias("reference_std"))
    actual = means(hist, [category_col]).agg(
        F.abs(F.max(F.when(F.col(category_col) == "positivo", F.col("mean")))
              - F.max(F.when(F.col(category_col) == "negativo", F.col("mean")))).alias("reference_mean"),
        F.sum("n").alias("sample_count"),
        F.count_if(F.col(category_col) == "positivo").alias("_has_pos"),
        F.count_if(F.col(category_col) == "negativo").alias("_has_neg"))
    # both sides are single-row aggregates: join on a constant key
    ok = actual.filter((F.col("_has_pos") > 0) & (F.col("_has_neg") > 0)).withColumn("_k", F.lit(1))
    return q.withColumn("_k", F.lit(1)).join(ok, "_k").select(
        F.lit("global").alias("category"), F.lit("discrimination_delta").alias("metric"),
        F.col("_q")[0].alias("value"), F.col("_q")[1].alias("ci_lower"), F.col("_q")[2].alias("ci_upper"),
        F.lit("composite").alias("metric_type"), F.lit("bootstrap").alias("test_paired"),
        F.lit("bootstrap").alias("test_unpaired"), "reference_mean", "reference_std", "sample_count")
