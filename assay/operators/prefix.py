"""Running sums and minima within groups, for groups of any size.

A window over a group would sort the whole group in one task. Here rows are
range-partitioned by (group, order), so a group spans as many partitions as its size
needs; each partition is scanned by itself, and what lies before a partition comes from
one summary row per (partition, group), of which a group has at most as many as there
are partitions. The ranged rows are written to the checkpoint folder: their partitions
are the same for the scan and for the summary, and an executor lost later costs a read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.session import ensure_checkpoint_dir


def prefix_scan(df: DataFrame, group: Sequence[str], order: Sequence[Column], *, sums: Sequence[str] = (),
                mins: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with ``<c>_before`` for each of ``sums`` (the sum over the group's rows strictly
    before the row) and ``<c>_so_far`` for each of ``mins`` (the least value up to the row).

    ``order`` are sort expressions that tell the rows of a group apart. Null keys are a
    group of their own.
    """
    ensure_checkpoint_dir(df.sparkSession)
    width = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a constant key stands for "no group": repartitionByRange and joins need one
    keyed = df.withColumn("_group", F.struct(*group) if group else F.struct(F.lit(0).alias("all")))
    ranged = keyed.repartitionByRange(width, F.col("_group"), *order).checkpoint()
    placed = ranged.withColumn("_part", F.spark_partition_id())
    scan = Window.partitionBy("_part", "_group").orderBy(*order)
    before, through = scan.rowsBetween(Window.unboundedPreceding, -1), scan.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"_s_{c}": F.sum(c).over(before) for c in sums} | {f"_m_{c}": F.min(c).over(through) for c in mins})
    parts = placed.groupBy("_part", "_group").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_t_{c}") for c in sums],
                                                  *[F.min(c).alias(f"_l_{c}") for c in mins])
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_part", F.col("_group").alias("_of_group"), *[F.sum(f"_t_{c}").over(earlier).alias(f"_t_{c}") for c in sums],
                           *[F.min(f"_l_{c}").over(earlier).alias(f"_l_{c}") for c in mins]).withColumnRenamed("_part", "_of_part")
    joined = local.join(carried, (F.col("_part") == F.col("_of_part")) & F.col("_group").eqNullSafe(F.col("_of_group")))
    zero = F.lit(0)
    out = {f"{c}_before": F.coalesce(f"_s_{c}", zero) + F.coalesce(f"_t_{c}", zero) for c in sums}
    out |= {f"{c}_so_far": F.least(f"_m_{c}", f"_l_{c}") for c in mins}
    return joined.select(*df.columns, *[v.alias(k) for k, v in out.items()])


def value_counts(long: DataFrame, group: Sequence[str], value: str = "value", count: str = "t") -> DataFrame:
    """Distinct non-null values of each group with their counts (partial aggregation: a group
    costs a task one row for each of its values)."""
    return long.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias(count))


def exact_quantiles(counts: DataFrame, group: Sequence[str], quantiles: Sequence[float], value: str = "value",
                    count: str = "t") -> DataFrame:
    """(group..., q0, q1, ...): linearly interpolated quantiles of ``value_counts`` rows.

    The value at a place is found by the running count before it, so no task holds
    a group's values.
    """
    g = [F.col(c) for c in group]
    ranked = prefix_scan(counts, group, [F.col(value)], sums=[count])
    sizes = counts.groupBy(*group).agg(F.sum(count).alias("_n")).select(*[c.alias(f"_k{i}") for i, c in enumerate(g)], "_n")
    same = [c.eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(g)]
    placed = ranked.join(sizes, same) if same else ranked.join(F.broadcast(sizes))  # one row without a group
    first, last = F.col(f"{count}_before"), F.col(f"{count}_before") + F.col(count) - 1
    aggs = []
    for i, q in enumerate(quantiles):
        place = (F.col("_n") - 1).cast("double") * F.lit(float(q))
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            aggs.append(F.max(F.when((first <= at) & (at <= last), F.col(value))).alias(f"_{end}{i}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"_f{i}"))
    found = placed.groupBy(*group).agg(*aggs)
    return found.select(*group, *[(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}")
                                  for i in range(len(quantiles))])
