"""Running sums, exact quantiles, step-up and the sliced bootstrap against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import bootstrap as bs
from assay.operators import stats as st
from assay.operators.prefix import exact_quantiles, prefix_scan, value_counts

ROWS = [(g, i, random.Random(i).randint(-5, 9)) for i, g in enumerate(random.Random(1).choices(["hot", "hot", "hot", "cold", None], k=600))]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_prefix_scan(spark, partitions):
    """A group that spans many partitions, and one of null keys."""
    df = spark.createDataFrame(ROWS, "g string, i long, x long")
    got = {(r["g"], r["i"]): r for r in prefix_scan(df, ["g"], [F.col("i").desc()], sums=["x"], mins=["x"], partitions=partitions).collect()}
    assert len(got) == len(ROWS)
    for g in ("hot", "cold", None):
        total, least = 0, 99
        for _, i, x in sorted((r for r in ROWS if r[0] == g), key=lambda r: -r[1]):
            least = min(least, x)
            assert (got[g, i]["x_before"], got[g, i]["x_so_far"]) == (total, least)
            total += x


def test_without_a_group_and_without_rows(spark):
    df = spark.createDataFrame(ROWS, "g string, i long, x long")
    out = {r["i"]: r["x_before"] for r in prefix_scan(df, [], [F.col("i")], sums=["x"], partitions=7).collect()}
    assert out == {i: sum(x for _, j, x in ROWS if j < i) for _, i, _ in ROWS}
    assert prefix_scan(df.limit(0), ["g"], [F.col("i")], sums=["x"]).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 97])
def test_exact_quantiles(spark, n):
    rng = random.Random(n)
    vals = {g: [rng.choice([0.0, 0.25, rng.random()]) for _ in range(n + k)] for k, g in enumerate(["a", "b", None])}
    df = spark.createDataFrame([(g, v) for g, vs in vals.items() for v in vs + [None]], "g string, value double")
    got = {r["g"]: [r["q0"], r["q1"], r["q2"], r["q3"]] for r in exact_quantiles(value_counts(df, ["g"]), ["g"], (0.0, 0.25, 0.9, 1.0)).collect()}
    for g, vs in vals.items():
        assert np.allclose(got[g], np.quantile(vs, [0.0, 0.25, 0.9, 1.0]), rtol=0, atol=1e-12)


def test_step_up_of_a_large_family(spark):
    rng = random.Random(3)
    p = [rng.choice([rng.random() ** 4, 0.03, 0.5]) for _ in range(400)]
    out = [r["p_value_adjusted"] for r in st.bh_adjust(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i long, p_value double")).orderBy("i").collect()]
    order = np.argsort(p, kind="stable")
    raw = np.array(p)[order] * len(p) / np.arange(1, len(p) + 1)
    expected = np.empty(len(p))
    expected[order] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    assert np.allclose(out, expected, rtol=1e-12)


def test_slices_draw_the_same_distribution(spark):
    """A histogram cut into slices resamples like one that is not: same mean and spread of the
    replicate means, every replicate of all rows, whatever the partitioning."""
    vals = [round(random.Random(i).gauss(0.5, 0.2), 3) for i in range(500)]
    long = spark.createDataFrame([("a", v) for v in vals], "g string, value double")
    boots = {}
    for size in (10_000, 7):
        slices = bs.histogram(long, ["g"], slice_values=size)
        got = bs.bootstrap_means(slices, ["g"], 2000, 5).orderBy("replicate").toPandas()
        assert got["replicate"].tolist() == list(range(2000))
        boots[size] = got["boot_mean"].to_numpy()
        assert slices.agg(F.sum("n")).first()[0] == 500 and bs.means(slices, ["g"]).first()["mean"] == pytest.approx(np.mean(vals))
    for b in boots.values():
        assert b.mean() == pytest.approx(np.mean(vals), abs=0.002)
        assert b.std() == pytest.approx(np.std(vals) / np.sqrt(500), rel=0.08)
    again = bs.bootstrap_means(bs.histogram(long.repartition(9), ["g"], slice_values=7), ["g"], 2000, 5).orderBy("replicate").toPandas()
    assert again["boot_mean"].tolist() == boots[7].tolist()
