"""C7 pairing detection, I10 test routing, I11 orchestration of all tests.

Everything is joins of long tables with a small per-(category, metric) plan
table — no driver loop over metrics: each test runs once over all groups that
were routed to it, and the results are unioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators import stats as st
from assay.operators.bootstrap import bootstrap_ci_test
from assay.session import ensure_checkpoint_dir

RESULT_COLS = ["category", "metric_name", "test_name", "statistic", "p_value", "p_value_adjusted",
               "reject_null", "effect_size", "effect_magnitude", "ci_lower", "ci_upper", "candidate_value",
               "threshold_value", "sample_size_candidate", "sample_size_reference", "is_paired"]
_TEXTS, _FLAGS, _SIZES = ("category", "metric_name", "test_name", "effect_magnitude"), ("reject_null", "is_paired"), RESULT_COLS[-3:-1]
RESULT_SCHEMA = ", ".join(
    f"{c} " + ("string" if c in _TEXTS else "boolean" if c in _FLAGS else "bigint" if c in _SIZES else "double") for c in RESULT_COLS)


def detect_pairing(cand_ids: DataFrame, ref_ids: DataFrame, group: list[str], id_col: str = "session_id",
                   threshold: float = 0.80) -> DataFrame:
    """C7 — |cand ∩ ref| / |cand| on distinct ids per group; paired iff >= threshold."""
    # one grouping of both sides by id tells which sides hold it; null keys never match
    keys = [*group, id_col]
    both = cand_ids.select(*keys, F.lit(1).alias("_side")).unionByName(ref_ids.select(*keys, F.lit(0).alias("_side")))
    told = F.lit(True)
    for c in keys:
        told = told & F.col(c).isNotNull()
    ids = both.groupBy(*keys).agg(F.max("_side").alias("_cand"), F.min("_side").alias("_ref")).filter("_cand = 1")
    j = ids.groupBy(*group).agg(F.count(F.lit(1)).alias("n_candidate"), F.count_if((F.col("_ref") == 0) & told).alias("n_common"))
    ratio = F.col("n_common") / F.col("n_candidate")
    return j.select(*group, "n_candidate", "n_common", ratio.alias("overlap_ratio"),
                    (ratio >= threshold).alias("is_paired"))


def route_tests(cand: DataFrame, ref: DataFrame | None, profile: DataFrame) -> DataFrame:
    """I10 — one row per (category, metric) of the profile that the candidate has:
    composite -> bootstrap; paired -> mcnemar (binary) / wilcoxon; unpaired with a
    reference -> chi2 (binary) / mannwhitneyu; no reference -> bootstrap."""
    cm = cand.select("category", "metric").distinct()
    plan = profile.join(cm, ["category", "metric"], "left_semi")
    if ref is not None:
        rm = ref.select("category", "metric").distinct().withColumn("ref_has", F.lit(True))
        pairing = detect_pairing(cand, ref, ["category"]).select("category", "is_paired")
        plan = plan.join(rm, ["category", "metric"], "left").join(pairing, "category", "left")
    else:
        plan = plan.withColumn("ref_has", F.lit(None).cast("boolean")).withColumn("is_paired", F.lit(False))
    has_ref = F.coalesce("ref_has", F.lit(False))
    is_pair = F.coalesce("is_paired", F.lit(False)) & has_ref
    binary = F.col("metric_type") == "binary"
    route = (F.when(F.col("metric_type") == "composite", "bootstrap")
             .when(is_pair & binary, "mcnemar").when(is_pair, "wilcoxon")
             .when(has_ref & binary, "chi2").when(has_ref, "mannwhitneyu")
             .otherwise("bootstrap"))
    return plan.withColumn("route", route)


def _finish(df: DataFrame, plan: DataFrame) -> DataFrame:
    j = df.join(plan.select("category", "metric", "metric_type"), ["category", "metric"])
    out = j.withColumns({
        "metric_name": F.col("metric"),
        "effect_magnitude": st.magnitude(F.col("effect_size"), F.col("metric_type")),
        "p_value_adjusted": F.col("p_value"), "reject_null": F.lit(False),
        "ci_lower": F.lit(0.0), "ci_upper": F.lit(0.0)})
    return out.select(*RESULT_COLS)


def run_all_tests(cand: DataFrame, ref: DataFrame | None, profile: DataFrame, *,
                  alpha: float = 0.05, bootstrap_b: int = 10_000, seed: int = 42,
                  global_profile: DataFrame | None = None) -> DataFrame:
    """I11 — all tests of a candidate against a threshold profile.

    cand / ref: long ``(category, session_id, metric, value)`` (gated, one value
    per session and metric). profile: ``(category, metric, metric_type,
    threshold_value)``. global_profile: optional ``(metric, threshold_value)``
    for ``discrimination_delta``. BH runs over the non-bootstrap tests only.
    """
    g = ["category", "metric"]
    plan = route_tests(cand, ref, profile)
    long = cand.withColumn("side", F.lit(st.CAND))
    if ref is not None:
        long = long.unionByName(ref.withColumn("side", F.lit(st.REF)))

    def routed(name):
        return plan.filter(F.col("route") == name).select(*g)

    # the plan has one row per (category, metric); only the names of the routes in
    # use (at most five strings) reach the driver, to skip test kinds with no groups
    ensure_checkpoint_dir(plan.sparkSession)
    plan = plan.checkpoint()
    used = {r["route"] for r in plan.select("route").distinct().collect()}
    parts = []
    order = [c for c in ("model", "run_id", "attempt") if c in long.columns]  # latest value of a repeated id
    if ref is not None:
        if "wilcoxon" in used:
            pl = long.join(F.broadcast(routed("wilcoxon")), g, "left_semi")
            parts.append(st.wilcoxon(st.paired(pl, g, order=order), g))
        if "mcnemar" in used:
            pb = long.join(F.broadcast(routed("mcnemar")), g, "left_semi")
            parts.append(st.mcnemar(st.paired(pb, g, order=order), g).drop("a", "b", "c", "d"))
        if "mannwhitneyu" in used:
            ul = long.join(F.broadcast(routed("mannwhitneyu")), g, "left_semi")
            parts.append(st.mann_whitney(ul, g))
        if "chi2" in used:
            ub = long.join(F.broadcast(routed("chi2")), g, "left_semi")
            parts.append(st.chi2(ub, g).drop("degenerate", "odds_ratio_adbc"))
    tested = None
    for p in parts:
        p = _finish(p, plan)
        tested = p if tested is None else tested.unionByName(p)
    # one row a test; the correction reads them several times
    corrected = st.bh_adjust(tested.checkpoint(), [], alpha) if tested is not None else None

    out = None if corrected is None else corrected.select(*RESULT_COLS)
    if "bootstrap" in used:
        thr = plan.filter(F.col("route") == "bootstrap").select(*g, "threshold_value")
        boot_in = cand.join(F.broadcast(thr.select(*g)), g, "left_semi")
        boot = bootstrap_ci_test(boot_in, g, thr, bootstrap_b=bootstrap_b, seed=seed)
        boot = boot.withColumn("metric_name", F.col("metric")).select(*RESULT_COLS)
        out = boot if out is None else out.unionByName(boot)

    if global_profile is not None:
        f1 = cand.filter(F.col("metric") == "token_overlap_f1")
        means = f1.groupBy().agg(
            F.avg(F.when(F.col("category") == "positivo", F.col("value"))).alias("mp"),
            F.avg(F.when(F.col("category") == "negativo", F.col("value"))).alias("mn"))
        delta = means.filter(F.col("mp").isNotNull() & F.col("mn").isNotNull()).select(
            F.lit("discrimination_delta").alias("metric"), F.abs(F.col("mp") - F.col("mn")).alias("delta"))
        gp = delta.join(global_profile, "metric")
        thr_v = F.col("threshold_value")
        rel = F.when(thr_v != 0, (F.col("delta") - thr_v) / thr_v).otherwise(F.lit(0.0))
        # a single composite value: the bootstrap CI collapses to the point (Q10)
        glob = gp.select(
            F.lit("global").alias("category"), F.col("metric").alias("metric_name"),
            F.lit("bootstrap").alias("test_name"), F.col("delta").alias("statistic"),
            F.lit(0.0).alias("p_value"), F.lit(0.0).alias("p_value_adjusted"),
            (F.col("delta") < thr_v).alias("reject_null"), rel.alias("effect_size"),
            st.magnitude(rel, F.lit("continuous")).alias("effect_magnitude"),
            F.col("delta").alias("ci_lower"), F.col("delta").alias("ci_upper"),
            F.col("delta").alias("candidate_value"), thr_v.alias("threshold_value"),
            F.lit(1).cast("long").alias("sample_size_candidate"), F.lit(0).cast("long").alias("sample_size_reference"),
            F.lit(False).alias("is_paired"))
        out = glob if out is None else out.unionByName(glob)
    if out is None:  # nothing of the profile was measured
        return plan.sparkSession.createDataFrame([], RESULT_SCHEMA)
    return out
