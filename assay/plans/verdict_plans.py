"""derive-thresholds -> hypothesis tests -> statistical verdict, on the ``qa`` view.

Reference runs are the responses of the reference models, candidate runs those of all
other models (both cover every document of their sources).
The scores are gated (D5/D6) before anything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.aggregate import completeness_gate, unpivot_metrics
from assay.operators.bootstrap import derive_thresholds, discrimination_delta
from assay.operators.tests_routing import run_all_tests
from assay.operators.verdict import critical_metrics, flatten_verdict_metrics, statistical_verdict
from assay.plans.qa_plans import QA_METRICS, scored_qa
from assay.session import ensure_checkpoint_dir

# fixed parameters of the registered pipeline
BOOTSTRAP_B = 10_000
SEED = 42
PERCENTILE = 5
ALPHA = 0.05
REFERENCE_MODELS = tuple(f"src{i}" for i in range(0, 20, 2))


def is_reference(models=REFERENCE_MODELS, model_col="model"):
    """Whether a row's model is one of the reference models (false without a model)."""
    return F.coalesce(F.col(model_col).isin(*models), F.lit(False))


def scored_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored responses as a long table, written once to the checkpoint folder.

    Everything downstream (profile, tests, verdicts) reads this table, so the
    scoring plan runs once and the lineage (and plan size) is cut here; an
    executor lost later recomputes from the checkpoint, not from the text.
    """
    ensure_checkpoint_dir(spark)
    long = unpivot_metrics(scored_qa(spark, sf_dir), ["model", "category", "session_id"], QA_METRICS, name_col="metric",
                           drop_nulls=False)
    return long.checkpoint()


def scores_long(spark: SparkSession, sf_dir: str, reference_models=REFERENCE_MODELS, scored: DataFrame | None = None) -> DataFrame:
    """The rows of ``scored_long``, with a flag for those of the reference models. A query that
    needs them more than once passes its ``scored`` table, so the texts are scored once."""
    long = scored_long(spark, sf_dir) if scored is None else scored
    return long.withColumn("is_reference", is_reference(reference_models))


def gated_long(long: DataFrame, reference: bool) -> DataFrame:
    side = long.filter(F.col("is_reference") == reference).drop("is_reference")
    return completeness_gate(side, ["category"], name_col="metric")


def profile_from(long: DataFrame, bootstrap_b: int = BOOTSTRAP_B) -> DataFrame:
    """I13 + I14: one row per (category, metric) plus the global discrimination delta."""
    ref = gated_long(long, True)
    per = derive_thresholds(ref, ["category", "metric"], bootstrap_b=bootstrap_b, seed=SEED,
                            percentile=PERCENTILE, alpha=ALPHA)
    glob = discrimination_delta(ref.filter(F.col("metric") == "token_overlap_f1"), bootstrap_b=bootstrap_b,
                                seed=SEED, percentile=PERCENTILE, alpha=ALPHA)
    return per.unionByName(glob)


def profile(spark: SparkSession, sf_dir: str, bootstrap_b: int = BOOTSTRAP_B) -> DataFrame:
    return profile_from(scores_long(spark, sf_dir), bootstrap_b)


def thresholds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold profile as a flat table (I18 summary)."""
    return profile(spark, sf_dir)


def tests_against(long: DataFrame, prof: DataFrame, *, alpha: float = ALPHA, bootstrap_b: int = BOOTSTRAP_B, seed: int = SEED) -> DataFrame:
    """Every routed test of the candidate rows of ``long`` against a profile and its reference rows."""
    per = prof.filter(F.col("category") != "global").select(
        "category", "metric", "metric_type", F.col("value").alias("threshold_value"))
    glob = prof.filter(F.col("category") == "global").select("metric", F.col("value").alias("threshold_value"))
    cand = gated_long(long, False)
    ref = gated_long(long, True)
    return run_all_tests(cand, ref, per, alpha=alpha, bootstrap_b=bootstrap_b, seed=seed, global_profile=glob)


def hypothesis_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = scores_long(spark, sf_dir)
    return tests_against(long, profile_from(long).checkpoint())  # one row per (category, metric)


def hypothesis_tests_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every routed test with BH-adjusted p-values."""
    return hypothesis_tests(spark, sf_dir)


def statistical_verdict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + J3: verdict from the tests and the critical set."""
    v = statistical_verdict(hypothesis_tests(spark, sf_dir), critical_metrics(spark), alpha=ALPHA)
    return v.withColumns({"reasons": F.array_join("reasons", " | "),
                          "critical_failures": F.array_join("critical_failures", ",")})


def verdict_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened verdict metrics (metric_key, metric_value)."""
    return flatten_verdict_metrics(hypothesis_tests(spark, sf_dir))
