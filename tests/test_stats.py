"""Statistical operators against brute-force Python and published values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assay.functions import special
from assay.operators import stats as st
from assay.operators.bootstrap import bootstrap_ci, derive_thresholds
from assay.operators.tests_routing import detect_pairing
from conftest import rows


# ---------------------------------------------------------------- special functions
def test_published_values():
    assert special.two_sided_normal_p(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert special.chi2_1_sf(3.841458821) == pytest.approx(0.05, abs=1e-8)
    # Student t, two-sided: t=2.228 with 10 df is the 5 % critical value
    assert special.t_two_sided_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.t_two_sided_p(0.0, 5) == pytest.approx(1.0)
    # exact signed-rank null: n=10, T=8 -> two-sided 0.04883 (table value)
    assert special.wilcoxon_exact_p(10, 8) == pytest.approx(0.048828125)
    # exact rank-sum null: n1=n2=5, U=2 -> two-sided 0.03175
    assert special.mannwhitney_exact_p(5, 5, 2) == pytest.approx(0.0317460317)
    assert special.binom_cdf(2, 10) == pytest.approx(56 / 1024)


def _midranks(vals):
    s = sorted(vals)
    first = {}
    for i, v in enumerate(s):
        first.setdefault(v, i)
    return [first[v] + (s.count(v) + 1) / 2 for v in vals]


def test_mann_whitney_stats_brute_force(spark):
    rnd = random.Random(11)
    a = [round(rnd.gauss(0.7, 0.1), 2) for _ in range(40)]
    b = [round(rnd.gauss(0.6, 0.1), 2) for _ in range(35)]
    data = [("g", "m", st.CAND, i, v) for i, v in enumerate(a)] + [("g", "m", st.REF, 100 + i, v) for i, v in enumerate(b)]
    df = spark.createDataFrame(data, "category string, metric string, side string, session_id long, value double")
    r = rows(st.mann_whitney_stats(df, ["category", "metric"]))[0]
    ranks = _midranks(a + b)
    u1 = sum(ranks[: len(a)]) - len(a) * (len(a) + 1) / 2
    ties = [(a + b).count(v) for v in set(a + b)]
    tie = sum(t ** 3 - t for t in ties)
    n1, n2, n = len(a), len(b), len(a) + len(b)
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1))))
    assert r["u_statistic"] == pytest.approx(u1)
    assert r["tie_term"] == tie
    assert r["z"] == pytest.approx((abs(u1 - n1 * n2 / 2) - 0.5) / sigma)
    full = rows(st.mann_whitney(df, ["category", "metric"]))[0]
    assert full["p_value"] == pytest.approx(special.two_sided_normal_p(r["z"]))


def test_mann_whitney_exact_small(spark):
    data = [("g", "m", st.CAND, i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5])] + \
           [("g", "m", st.REF, 10 + i, float(v)) for i, v in enumerate([6, 7, 8, 9, 10])]
    df = spark.createDataFrame(data, "category string, metric string, side string, session_id long, value double")
    r = rows(st.mann_whitney(df, ["category", "metric"]))[0]
    assert r["statistic"] == 0.0
    assert r["p_value"] == pytest.approx(special.mannwhitney_exact_p(5, 5, 0.0))


def test_wilcoxon_brute_force_and_degenerate(spark):
    rnd = random.Random(5)
    cand = [round(rnd.gauss(0.6, 0.1), 2) for _ in range(50)]
    ref = [round(rnd.gauss(0.4, 0.1), 2) for _ in range(50)]
    data = [("g", "m", st.CAND, i, v) for i, v in enumerate(cand)] + [("g", "m", st.REF, i, v) for i, v in enumerate(ref)]
    df = spark.createDataFrame(data, "category string, metric string, side string, session_id long, value double")
    pairs = st.paired(df, ["category", "metric"])
    s = rows(st.wilcoxon_stats(pairs, ["category", "metric"]))[0]
    d = [c - r for c, r in zip(cand, ref) if c - r != 0]
    rk = _midranks([abs(x) for x in d])
    wp = sum(r for r, x in zip(rk, d) if x > 0)
    wm = sum(r for r, x in zip(rk, d) if x < 0)
    assert s["w_plus"] == pytest.approx(wp) and s["w_minus"] == pytest.approx(wm)
    assert s["t_statistic"] == pytest.approx(min(wp, wm))
    same = spark.createDataFrame([("g", "m", side, i, 0.5) for i in range(10) for side in (st.CAND, st.REF)],
                                 "category string, metric string, side string, session_id long, value double")
    r = rows(st.wilcoxon(st.paired(same, ["category", "metric"]), ["category", "metric"]))[0]
    assert r["statistic"] == 0.0 and r["p_value"] == 1.0


def test_paired_keeps_one_value_per_id(spark):
    """Reference rows that repeat an id give one pair, with the latest value."""
    data = [("g", "m", st.CAND, "c", i, 0.1 * i) for i in range(20)]
    data += [("g", "m", st.REF, run, i, v) for i in range(20) for run, v in (("r1", 9.0), ("r2", float(i)))]
    data += [("g", "m", st.REF, "r1", 99, 1.0)]
    df = spark.createDataFrame(data, "category string, metric string, side string, run_id string, session_id long, value double")
    out = rows(st.paired(df, ["category", "metric"], order=["run_id"]))
    assert len(out) == 20 and all(r["ref"] == float(r["session_id"]) for r in out)
    assert len(rows(st.paired(df, ["category", "metric"]))) == 20


def test_reference_models_by_name(spark):
    from assay.plans.verdict_plans import is_reference
    df = spark.createDataFrame([("base",), ("large-v2",), (None,), ("src1",)], "model string")
    got = [r["x"] for r in df.select(is_reference(("base", "src1")).alias("x")).collect()]
    assert got == [True, False, False, True]


def test_mcnemar_exact_and_identical(spark):
    pairs = [(1.0, 0.0)] * 7 + [(0.0, 1.0)] * 1 + [(1.0, 1.0)] * 2
    df = spark.createDataFrame([("g", "m", i, c, r) for i, (c, r) in enumerate(pairs)],
                               "category string, metric string, session_id long, cand double, ref double")
    r = rows(st.mcnemar(df, ["category", "metric"]))[0]
    assert (r["b"], r["c"]) == (7, 1)
    assert r["statistic"] == 1.0
    assert r["p_value"] == pytest.approx(2 * special.binom_cdf(1, 8))
    assert r["effect_size"] == 7.0
    ident = spark.createDataFrame([("g", "m", i, float(i % 2), float(i % 2)) for i in range(30)],
                                  "category string, metric string, session_id long, cand double, ref double")
    r2 = rows(st.mcnemar(ident, ["category", "metric"]))[0]
    assert r2["p_value"] == 1.0 and r2["effect_size"] == 1.0


def test_chi2_yates_and_all_zero(spark):
    data = [("g", "m", st.CAND, i, 1.0 if i < 30 else 0.0) for i in range(50)] + \
           [("g", "m", st.REF, 100 + i, 1.0 if i < 15 else 0.0) for i in range(50)]
    df = spark.createDataFrame(data, "category string, metric string, side string, session_id long, value double")
    r = rows(st.chi2(df, ["category", "metric"]))[0]
    obs = [[30, 20], [15, 35]]
    n = 100
    rs, cs = [50, 50], [45, 55]
    stat = sum((abs(obs[i][j] - rs[i] * cs[j] / n) - 0.5) ** 2 / (rs[i] * cs[j] / n) for i in range(2) for j in range(2))
    assert r["statistic"] == pytest.approx(stat)
    assert r["p_value"] == pytest.approx(special.chi2_1_sf(stat))
    assert r["effect_size"] == pytest.approx(20 / 15)


def test_bh_against_step_up(spark):
    ps = [0.01, 0.04, 0.03, 0.20, 0.50]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "id long, p_value double")
    out = {r["id"]: r for r in rows(st.bh_adjust(df, [], 0.05))}
    m = len(ps)
    order = sorted(range(m), key=lambda i: ps[i])
    adj = [0.0] * m
    running = 1.0
    for rank in range(m, 0, -1):
        i = order[rank - 1]
        running = min(running, ps[i] * m / rank)
        adj[i] = running
    for i in range(m):
        assert out[i]["p_value_adjusted"] == pytest.approx(adj[i])
        assert out[i]["p_value_adjusted"] >= ps[i]
        assert out[i]["reject_null"] == (adj[i] <= 0.05)
    single = rows(st.bh_adjust(spark.createDataFrame([(0, 0.03)], "id long, p_value double"), [], 0.05))[0]
    assert single["p_value_adjusted"] == pytest.approx(0.03)


def test_effect_sizes(spark):
    df = spark.createDataFrame([(1,)], "x int")
    r = df.select(
        st.cohens_d(F.lit(1), F.lit(0.5), F.lit(0.01), F.lit(5), F.lit(0.4), F.lit(0.01)).alias("d_small_n"),
        st.cohens_d(F.lit(5), F.lit(0.5), F.lit(0.0), F.lit(5), F.lit(0.5), F.lit(0.0)).alias("d_zero"),
        st.odds_ratio(F.lit(0), F.lit(4)).alias("or_haldane"),
        st.magnitude(F.lit(2.5), F.lit("binary")).alias("m_bin"),
        st.magnitude(F.lit(-0.6), F.lit("continuous")).alias("m_cont")).first()
    assert r["d_small_n"] == 0.0 and r["d_zero"] == 0.0
    assert r["or_haldane"] == pytest.approx(0.5 / 4.5)
    assert r["m_bin"] == "medium" and r["m_cont"] == "medium"


def test_welch(spark):
    a = [0.5, 0.6, 0.7, 0.8]
    b = [0.1, 0.2, 0.25, 0.3, 0.35]
    data = [("m", st.CAND, v) for v in a] + [("m", st.REF, v) for v in b]
    df = spark.createDataFrame(data, "metric string, side string, value double")
    r = rows(st.welch(df, ["metric"]))[0]
    m1, m2 = sum(a) / 4, sum(b) / 5
    v1 = sum((x - m1) ** 2 for x in a) / 3
    v2 = sum((x - m2) ** 2 for x in b) / 4
    t = (m1 - m2) / math.sqrt(v1 / 4 + v2 / 5)
    dfree = (v1 / 4 + v2 / 5) ** 2 / ((v1 / 4) ** 2 / 3 + (v2 / 5) ** 2 / 4)
    assert r["t_statistic"] == pytest.approx(t) and r["df"] == pytest.approx(dfree)
    assert r["p_value"] == pytest.approx(special.t_two_sided_p(t, dfree))


def test_pairing(spark):
    c = spark.createDataFrame([("g", i) for i in range(10)], "category string, session_id long")
    r = spark.createDataFrame([("g", i) for i in range(2, 20)], "category string, session_id long")
    out = rows(detect_pairing(c, r, ["category"]))[0]
    assert out["n_common"] == 8 and out["is_paired"] is True


def test_bootstrap_deterministic_and_ci(spark):
    rnd = random.Random(42)
    vals = [round(min(1, max(0, rnd.gauss(0.5, 0.1))), 4) for _ in range(200)]
    df = spark.createDataFrame([("positivo", "f1", v) for v in vals], "category string, metric string, value double")
    a = rows(bootstrap_ci(df, ["category", "metric"], bootstrap_b=2000, seed=42))[0]
    b = rows(bootstrap_ci(df.repartition(5), ["category", "metric"], bootstrap_b=2000, seed=42))[0]
    assert a == b  # independent of partitioning
    mean = sum(vals) / len(vals)
    assert a["p0"] < mean < a["p1"]
    se = math.sqrt(sum((v - mean) ** 2 for v in vals) / (len(vals) - 1) / len(vals))
    assert a["p1"] - a["p0"] == pytest.approx(2 * 1.96 * se, rel=0.15)
    t = rows(derive_thresholds(df, ["category", "metric"], bootstrap_b=2000, seed=42, percentile=5, alpha=0.05))[0]
    assert t["ci_lower"] <= t["value"] <= t["ci_upper"]
    assert t["sample_count"] == 200 and t["metric_type"] == "continuous"


def _scores(categories, metrics, ids, value):
    return [(c, i, m, value(c, m, i)) for c in categories for m in metrics for i in ids]


def test_all_routes_of_the_tests(spark):
    """Paired and unpaired, binary and continuous, with and without a reference; the
    correction covers all but the bootstrap tests."""
    from assay.operators.tests_routing import RESULT_COLS, run_all_tests
    schema = "category string, session_id long, metric string, value double"
    cand = spark.createDataFrame(
        _scores(["same", "other"], ["f1", "hit"], range(40), lambda c, m, i: float(i % 2) if m == "hit" else i / 100)
        + _scores(["alone"], ["f1"], range(40), lambda c, m, i: 0.5 + i / 1000)
        + _scores(["positivo", "negativo"], ["token_overlap_f1"], range(4), lambda c, m, i: 0.9 if c == "positivo" else 0.2), schema)
    ref = spark.createDataFrame(
        _scores(["same"], ["f1", "hit"], range(40), lambda c, m, i: float(i % 4 < 3) if m == "hit" else 0.3 + i / 150)
        + _scores(["other"], ["f1", "hit"], range(100, 150), lambda c, m, i: float(i % 5 > 0) if m == "hit" else i / 200), schema)
    profile = spark.createDataFrame(
        [(c, m, "binary" if m == "hit" else "continuous", 0.4) for c in ("same", "other") for m in ("f1", "hit")]
        + [("alone", "f1", "continuous", 0.9), ("same", "absent", "continuous", 0.1)],
        "category string, metric string, metric_type string, threshold_value double")
    whole = spark.createDataFrame([("discrimination_delta", 0.5)], "metric string, threshold_value double")
    out = {(r["category"], r["metric_name"]): r for r in rows(run_all_tests(cand, ref, profile, bootstrap_b=200, global_profile=whole))}
    names = {k: r["test_name"] for k, r in out.items()}
    assert set(next(iter(out.values()))) == set(RESULT_COLS)
    assert {k: v.split("_")[0] for k, v in names.items()} == {
        ("same", "f1"): "wilcoxon", ("same", "hit"): "mcnemar", ("other", "f1"): "mannwhitneyu", ("other", "hit"): "chi2",
        ("alone", "f1"): "bootstrap", ("global", "discrimination_delta"): "bootstrap"}
    tested = sorted((r for r in out.values() if r["test_name"] != "bootstrap"), key=lambda r: r["p_value"])
    for rank, r in enumerate(tested):
        expected = min(min(1.0, x["p_value"] * len(tested) / (j + 1)) for j, x in enumerate(tested) if j >= rank)
        assert r["p_value_adjusted"] == pytest.approx(expected) and r["reject_null"] == (expected <= 0.05)
    assert out["alone", "f1"]["reject_null"] and out["global", "discrimination_delta"]["reject_null"] is False
    assert out["same", "f1"]["is_paired"] and not out["other", "f1"]["is_paired"]


def test_tests_without_a_reference_are_bootstrap_tests(spark):
    from assay.operators.tests_routing import run_all_tests
    cand = spark.createDataFrame([("c", i, "f1", 0.5) for i in range(5)], "category string, session_id long, metric string, value double")
    profile = spark.createDataFrame([("c", "f1", "continuous", 0.4)], "category string, metric string, metric_type string, threshold_value double")
    out = rows(run_all_tests(cand, None, profile, bootstrap_b=50))
    assert [(r["test_name"], r["reject_null"]) for r in out] == [("bootstrap", False)]
    assert run_all_tests(cand.limit(0), None, profile, bootstrap_b=50).count() == 0


def test_pairing_of_null_and_repeated_ids(spark):
    schema = "category string, session_id long"
    c = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", None), (None, 5), ("b", 7)], schema)
    r = spark.createDataFrame([("a", 1), ("a", None), (None, 5), ("c", 9), ("b", 7), ("b", 8)], schema)
    got = {x["category"]: (x["n_candidate"], x["n_common"], x["is_paired"]) for x in rows(detect_pairing(c, r, ["category"]))}
    assert got == {"a": (3, 1, False), None: (1, 0, False), "b": (1, 1, True)}


def test_reference_rows_are_not_gathered_by_category(spark):
    from assay.plans.stats_plans import against
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = against(spark.range(100).selectExpr("if(id % 2 = 0, 'N', 'R') as model", "'F' as category", "id as session_id"), "N")
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in text and plan.filter("side = 'reference'").count() == 50
