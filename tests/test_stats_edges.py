"""Degenerate inputs of the statistics."""

from pyspark.sql import functions as F

from assay.functions.numeric import fixed_mean, fixed_var_pop
from assay.operators import stats
from assay.plans import stats_plans


def _long(spark, rows):
    return spark.createDataFrame(rows, "g string, side string, value double")


def test_identical_samples_and_single_rows(spark):
    rows = [("same", s, float(v)) for v in range(9) for s in (stats.CAND, stats.REF)] + [("one", stats.CAND, 1.0)]
    got = {r.g: r for r in stats.mann_whitney(_long(spark, rows), ["g"]).collect()}
    assert got["same"].p_value == 1.0


def test_moments_do_not_overflow(spark):
    r = spark.range(300).select(F.lit(20_000.0).alias("v")).agg(fixed_mean("v").alias("m"), fixed_var_pop("v").alias("s")).first()
    assert (r.m, r.s) == (20_000.0, 0.0)


def test_tie_terms_beyond_64_bits(spark):
    n = 3_000_000  # n^3 passes 2^63
    side = F.when(F.col("id") % 2 == 0, stats.CAND).otherwise(stats.REF)
    long = spark.range(n).select(F.lit("g").alias("g"), side.alias("side"), F.when(F.col("id") < n - 10, 1.0).otherwise(2.0).alias("value"))
    s = stats.mann_whitney_stats(long, ["g"]).first()
    assert s.tie_term == (n - 10) ** 3 - (n - 10) + 990 and s.z is not None
    assert stats.mann_whitney(long, ["g"]).first().p_value == 1.0
    pairs = spark.range(n).select(F.lit("g").alias("g"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("cand"), F.lit(0.0).alias("ref"))
    assert stats.wilcoxon_stats(pairs, ["g"]).first().tie_term == n ** 3 - n
    assert stats.wilcoxon(pairs, ["g"]).first().p_value == 1.0


def test_type_of_tie_terms(spark):
    one = spark.range(1).select(F.lit(24).cast("decimal(38,0)").alias("tie_term"))
    for rows, kind in ((stats_plans.BIGINT_ROWS, "bigint"), (stats_plans.BIGINT_ROWS + 1, "decimal(38,0)")):
        out = one.select(stats_plans._tie_term(spark.range(rows)).alias("t"))
        assert out.dtypes == [("t", kind)] and out.first().t == 24
