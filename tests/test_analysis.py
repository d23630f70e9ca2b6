"""Dashboard analysis operators, sampling and verdicts."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.operators import analysis as an
from assay.operators.verdict import critical_metrics, rule_verdict, statistical_verdict
from assay.sources import medallion as md
from conftest import rows


def test_descriptive_stats_matches_numpy(spark):
    series = {"a": [1.0, 2.0, 3.0, 4.0, 5.0], "b": [10.0, 20.0, 30.0], "c": [42.0], "d": [1.0, None, 3.0]}
    data = [(k, v) for k, vs in series.items() for v in vs]
    df = spark.createDataFrame(data, "g string, value double")
    out = {r["g"]: r for r in rows(an.descriptive_stats(df, ["g"]))}
    for k, vs in series.items():
        clean = np.array([v for v in vs if v is not None])
        r = out[k]
        assert r["count"] == len(clean)
        assert r["mean"] == pytest.approx(clean.mean())
        for q, name in ((25, "q1"), (50, "q2"), (75, "q3")):
            assert r[name] == pytest.approx(np.percentile(clean, q))
        if len(clean) > 1:
            assert r["std"] == pytest.approx(clean.std(ddof=1))
        else:
            assert r["std"] is None and r["cv"] is None


def test_z_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 2.0)],
                               "g string, value double")
    out = rows(an.z_scores(df, ["g"]))
    za = sorted(r["z_score"] for r in out if r["g"] == "a")
    assert za == pytest.approx([-1.0, 0.0, 1.0])
    assert all(r["z_score"] is None for r in out if r["g"] in ("b", "c"))


def test_complexity_bins_match_pandas_cut(spark):
    rnd = random.Random(2)
    x = [rnd.randint(0, 500) for _ in range(60)]
    pdf = pd.DataFrame({"run_id": ["r"] * 60, "input_len": x, "score": [rnd.random() for _ in range(60)]})
    cut = pd.cut(pdf["input_len"], bins=5)
    codes = cut.cat.codes + 1
    df = spark.createDataFrame(pdf)
    binned = df.withColumn("bin", F.lit(0))
    lo, hi = min(x), max(x)
    got = [r["b"] for r in df.select(
        F.greatest(F.lit(1), F.ceil((F.col("input_len") - lo) / (hi - lo) * 5).cast("int")).alias("b")).collect()]
    assert got == list(codes)
    out = rows(an.complexity_bins(df, ["score"], "run_id"))
    assert {r["complexity_bin"] for r in out} == set(codes)
    const = spark.createDataFrame([("r", 7, 0.5)] * 4, "run_id string, input_len long, score double")
    assert {r["complexity_bin"] for r in rows(an.complexity_bins(const, ["score"], "run_id"))} == {3}
    del binned


def test_sankey_sums_to_twice_rows(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["positivo", "negativo"]), rnd.choice([True, False, None]),
             rnd.choice(["off_topic", None, "hallucination"])) for _ in range(20)]
    df = spark.createDataFrame(data, "data_category_QA string, refusal_detection boolean, failure_mode string")
    edges = rows(an.sankey_edges(df))
    assert sum(e["value"] for e in edges) == 40
    nodes = sorted(rows(an.sankey_nodes(df)), key=lambda n: n["node"])
    assert [(n["layer"], n["label"]) for n in nodes] == [(1, "negativo"), (1, "positivo"), (2, "not_refused"), (2, "refused"),
                                                         (3, "hallucination"), (3, "none"), (3, "off_topic")]
    assert [n["node"] for n in nodes] == list(range(7))
    assert rows(an.sankey_nodes(df.limit(0))) == []


def test_flat_run_metrics_and_verdict_metrics(spark):
    from assay.operators.aggregate import failure_mode_rates, flat_run_metrics
    from assay.operators.verdict import rule_verdict_metrics
    agg = spark.createDataFrame([("r", "rouge_l", 0.5, 0.1, 3)], "run string, scorer_name string, mean double, std double, count long")
    modes = failure_mode_rates(spark.createDataFrame([("r", "off_topic"), ("r", "off_topic"), ("r", None)], "run string, failure_mode string"), ["run"])
    got = {r["metric_key"]: r["metric_value"] for r in rows(flat_run_metrics(agg, ["run"], modes=modes))}
    assert got == {"rouge_l_mean": 0.5, "rouge_l_std": 0.1, "total_scored": 3.0, "failure_mode_off_topic_count": 2.0,
                   "failure_mode_off_topic_rate": 0.6667, "failure_mode_unknown_count": 1.0, "failure_mode_unknown_rate": 0.3333}
    b = spark.createDataFrame([("r", "positivo", "token_overlap_f1", 0.75)], "run string, category string, scorer_name string, mean double")
    got = {r["metric_key"]: r["metric_value"] for r in rows(rule_verdict_metrics(rule_verdict(b, ["run"]), ["run"]))}
    assert got == {"verdict_positivo_overlap_mean": 0.75, "verdict_negativo_overlap_mean": 0.0, "verdict_positivo_refusal_rate": 0.0,
                   "verdict_negativo_refusal_rate": 0.0, "verdict_discrimination_delta": 0.0}


def test_tool_arguments(spark):
    from assay.functions.text import tool_arguments
    cases = {'{"a": 1}': '{"a": 1}', "[1, 2]": "[1, 2]", "5": "5", "": "{}", None: "{}", "no json": '{"raw":"no json"}', " ": '{"raw":" "}'}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    assert [r for r in rows(df.select("raw", "want", tool_arguments("raw").alias("got"))) if r["got"] != r["want"]] == []


def test_filters_keep_nulls_in_ranges(spark):
    df = spark.createDataFrame([("m1", 0.5), ("m1", None), ("m2", 0.95)], "model_label string, token_overlap_f1 double")
    f = an.apply_filters(df, models=[], score_ranges={"token_overlap_f1": (0.1, 0.9)})
    assert f.count() == 2
    assert an.apply_filters(df, models=["m2"]).count() == 1


def test_metric_ranges_defaults(spark):
    df = spark.createDataFrame([(None, 0.2), (None, 0.2), (None, 0.2)], "groundedness double, rouge_l double")
    out = {r["metric"]: r for r in rows(an.metric_ranges(df, ["groundedness", "rouge_l"]))}
    assert out["groundedness"]["min_value"] == 0.0 and out["groundedness"]["max_value"] == 1.0
    assert "rouge_l" not in out  # min == max


def test_weighted_sample_exact_size_and_balance(spark):
    data = [(f"id{i}", "big" if i < 3000 else "small") for i in range(3887)]
    df = spark.createDataFrame(data, "id string, data_category_QA string")
    s = md.weighted_sample(df, 0.1, 42)
    counts = {r["data_category_QA"]: r["count"] for r in s.groupBy("data_category_QA").count().collect()}
    assert sum(counts.values()) == 388
    assert abs(counts["big"] - counts["small"]) < 60  # equal mass per category
    again = sorted(r["id"] for r in md.weighted_sample(df.repartition(7), 0.1, 42).collect())
    assert again == sorted(r["id"] for r in s.collect())


def _breakdown(spark, rows_):
    return spark.createDataFrame(rows_, "run string, category string, scorer_name string, mean double")


@pytest.mark.parametrize("pf1,nf1,nref,verdict", [
    (0.6, 0.2, 0.0, "capable"),
    (0.2, 0.5, 0.1, "not_capable"),
    (0.6, 0.55, 0.1, "inconclusive"),
    (0.35, 0.3, 0.5, "inconclusive"),
])
def test_rule_verdict_table(spark, pf1, nf1, nref, verdict):
    b = _breakdown(spark, [("r", "positivo", "token_overlap_f1", pf1), ("r", "negativo", "token_overlap_f1", nf1),
                           ("r", "negativo", "refusal_detection", nref)])
    r = rows(rule_verdict(b, ["run"]))[0]
    assert r["verdict"] == verdict
    assert len(r["reasons"]) == 3
    assert r["discrimination_delta"] == pytest.approx(abs(pf1 - nf1))


def test_rule_verdict_missing_category(spark):
    b = _breakdown(spark, [("r", "positivo", "token_overlap_f1", 0.9)])
    r = rows(rule_verdict(b, ["run"]))[0]
    assert r["verdict"] == "inconclusive" and r["discrimination_delta"] == 0.0
    assert r["reasons"] == ["Missing category data — cannot determine capability"]


def test_statistical_verdict(spark):
    schema = "metric_name string, category string, reject_null boolean, effect_magnitude string, " \
             "p_value_adjusted double, effect_size double"
    crit = critical_metrics(spark)
    fail = spark.createDataFrame([("token_overlap_f1", "positivo", True, "large", 0.001, 1.2),
                                  ("rouge_l", "positivo", True, "large", 0.001, 1.0)], schema)
    assert rows(statistical_verdict(fail, crit))[0]["verdict"] == "not_capable"
    weak = spark.createDataFrame([("refusal_detection", "negativo", True, "small", 0.01, 1.6)], schema)
    assert rows(statistical_verdict(weak, crit))[0]["verdict"] == "inconclusive"
    ok = spark.createDataFrame([("token_overlap_f1", "positivo", False, "large", 0.2, 1.2),
                                ("rouge_l", "positivo", True, "large", 0.001, 1.0)], schema)
    r = rows(statistical_verdict(ok, crit))[0]
    assert r["verdict"] == "capable" and r["reasons"] == ["All critical metrics within reference thresholds"]


def test_reasons_stand_in_test_order(spark):
    from assay.operators.verdict import critical_metrics, statistical_verdict
    schema = ("category string, metric_name string, test_name string, p_value_adjusted double, reject_null boolean, effect_size double, "
              "effect_magnitude string")
    data = [("global", "discrimination_delta", "bootstrap", 0.0, True, -0.9, "large"),
            ("positivo", "token_overlap_f1", "wilcoxon", 0.001, True, -0.3, "small"),
            ("negativo", "token_overlap_f1", "bootstrap", 0.01, True, -0.9, "large"),
            ("negativo", "refusal_detection", "chi2", 0.002, True, 0.9, "large"),
            ("positivo", "rouge_l", "wilcoxon", 0.0, True, 0.9, "large")]
    r = statistical_verdict(spark.createDataFrame(data, schema), critical_metrics(spark)).first()
    assert r["verdict"] == "not_capable" and r["n_critical_failures"] == 3
    assert [x.split(":")[0] for x in r["reasons"]] == [
        "refusal_detection (negativo)", "token_overlap_f1 (positivo)", "token_overlap_f1 (negativo)", "discrimination_delta (global)"]


def test_comparison_stats_against_pandas(spark):
    from assay.operators.analysis import comparison_stats
    data = [("a", 0.1, 1.0), ("a", 0.4, None), ("a", 0.7, 3.0), ("b", 0.2, None), ("b", 0.2, None), ("c", 9.0, 9.0), (None, 5.0, 5.0)]
    df = spark.createDataFrame(data, "model_label string, x double, y double")
    out = {r["metric"]: r for r in comparison_stats(df, ["x", "y"], "a", "b").collect()}
    x, y = out["x"], out["y"]
    assert x["a_count"] == 3 and x["b_count"] == 2 and x["a_mean"] == pytest.approx(0.4) and x["a_std"] == pytest.approx(0.3)
    assert x["a_q1"] == pytest.approx(0.25) and x["a_q3"] == pytest.approx(0.55) and x["b_std"] == pytest.approx(0.0)
    assert x["delta"] == pytest.approx(0.2) and x["relative_delta_pct"] == pytest.approx(100.0)
    assert y["a_count"] == 2 and y["b_count"] is None and y["delta"] is None
    assert comparison_stats(df.limit(0), ["x"], "a", "b").count() == 0
