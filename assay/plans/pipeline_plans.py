"""Pipeline plans: incremental gold (L1), profile save/load (A6), trace lookup
(C4/C5/A10/A13), the lexicon scorers (H7/H8) and the
end-to-end run (J5/J6)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.functions.lexicon import default_lexicon, default_rows
from assay.operators.aggregate import aggregate_scores
from assay.operators.lexicon_scores import lexicon_scores
from assay.operators.verdict import critical_metrics, rule_verdict, statistical_verdict
from assay.plans.dashboard_plans import PREDS_SQL, md_typed, predictions
from assay.plans.qa_plans import QA_METRICS
from assay.plans.sqlkit import lexicon_flags_sql
from assay.plans.verdict_plans import (ALPHA, BOOTSTRAP_B, PERCENTILE, REFERENCE_MODELS, SEED,
                                       profile_from, scored_long, scores_long, tests_against)
from assay.sources import medallion as md
from assay.sources.profile_io import load_profile, load_profile_metadata, profile_document, save_profile
from assay.sources.tables import read_table
from assay.sources.views import QA_SQL, qa
from assay.streaming.incremental_gold import gold, incremental_gold, running_run_metrics


CREATED_AT = "2024-01-01T00:00:00+00:00"
BENCHMARK = "driver-qa"
STATISTICAL_COLUMNS = ("statistical_verdict", "statistical_reasons", "profile_version", "correction")


def _scratch(spark: SparkSession, name: str) -> str:
    return md.scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """Predictions land as JSON-lines files in three appends (the last one repeats a run) and
    are streamed into a new target, from two checkpoints: what the second one reads again adds nothing."""
    src, target, once = _scratch(spark, "pred-src"), _scratch(spark, "gold"), _scratch(spark, "scored")
    md_typed(predictions(spark, sf_dir)).write.parquet(once)
    p = spark.read.parquet(once)
    first = p.filter(~F.coalesce(F.col("run_id") >= "run-src5", F.lit(False)))
    rest = p.filter(F.col("run_id") >= "run-src5")
    again = p.filter(F.col("run_id") == "run-src1")
    for part in (first, rest, again):
        part.write.mode("append").json(src)
    for _ in range(2):
        incremental_gold(spark, src, target, _scratch(spark, "stream-ckpt"), max_files_per_trigger=8)
    return target


def incremental_gold_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: the availableNow stream appends only unseen (run_id, id, attempt) keys."""
    return gold(spark, _streamed(spark, sf_dir)).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_sessions"))


def running_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 + D1/D4: running means and failure-mode rates of each run from the batches' sums."""
    return running_run_metrics(spark, _streamed(spark, sf_dir))


MEDALLION_BUILD_SQL_TAIL = """
SELECT 'int_filtered_dataset' AS "table", data_category_QA, count(*) AS n_rows FROM raw
WHERE question IS NOT NULL AND question <> '' AND content IS NOT NULL GROUP BY data_category_QA
UNION ALL
SELECT 'fct_inference_results', p.data_category_QA_s, count(*) FROM (
  SELECT r.data_category_QA AS data_category_QA_s FROM preds JOIN raw r ON r.id = preds.id
  WHERE r.question IS NOT NULL AND r.question <> '' AND r.content IS NOT NULL) p GROUP BY 2
UNION ALL
SELECT 'fct_evaluation_scores', data_category_QA, count(*) FROM preds GROUP BY 2"""

INCREMENTAL_GOLD_SQL = "WITH " + PREDS_SQL + """
SELECT run_id, count(*) AS n_rows, count(DISTINCT id) AS n_sessions FROM preds GROUP BY run_id"""

RUNNING_METRICS_SQL = "WITH " + PREDS_SQL + """,
long AS (
  UNPIVOT (SELECT run_id, CAST(token_overlap_f1 AS DOUBLE) AS token_overlap_f1,
                  CAST(question_response_overlap AS DOUBLE) AS question_response_overlap,
                  CAST(response_length_ratio AS DOUBLE) AS response_length_ratio,
                  CAST(refusal_detection AS DOUBLE) AS refusal_detection,
                  CAST(hedging_detection AS DOUBLE) AS hedging_detection FROM preds)
  ON token_overlap_f1, question_response_overlap, response_length_ratio, refusal_detection, hedging_detection
  INTO NAME metric VALUE value
),
modes AS (SELECT run_id, coalesce(failure_mode, 'none') AS mode, count(*) AS n FROM preds GROUP BY 1, 2)
SELECT run_id, metric, count(value) AS n,
       round(CAST(sum(CAST(value AS DECIMAL(38, 12))) AS DOUBLE) / count(value), 6) AS mean
FROM long WHERE value IS NOT NULL GROUP BY run_id, metric
UNION ALL
SELECT run_id, 'failure_mode_' || mode, n, round(n / sum(n) OVER (PARTITION BY run_id), 6) FROM modes"""


def saved_profile(spark: SparkSession, sf_dir: str, scored: DataFrame | None = None) -> str:
    """Derive the threshold profile of the reference runs and save it; its path."""
    long = scores_long(spark, sf_dir, scored=scored)
    flat = profile_from(long).checkpoint()
    # one row of each response of the reference runs (sessions are summed over runs), and the run names
    ref = long.filter(F.col("is_reference") & (F.col("metric") == QA_METRICS[0]))
    n_sessions = ref.count()
    run_ids = sorted(r["run_id"] for r in ref.select(F.concat(F.lit("run-"), "model").alias("run_id")).distinct().collect())
    doc = profile_document(flat, created_at=CREATED_AT, benchmark=BENCHMARK,
                           reference_models=list(REFERENCE_MODELS), reference_run_ids=run_ids, total_sessions=n_sessions,
                           bootstrap_b=BOOTSTRAP_B, seed=SEED, percentile=PERCENTILE, alpha=ALPHA)
    path = _scratch(spark, "profile")
    save_profile(doc, path)
    return path


def profile_roundtrip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 + I13/I14/I18: derive the threshold profile, save it as JSON, load it back."""
    path = saved_profile(spark, sf_dir)
    assert load_profile(spark, os.path.join(path, "missing")) is None
    return load_profile(spark, path)


def profile_metadata_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 + D7 + D23: the saved profile's metadata, read back."""
    m = load_profile_metadata(spark, saved_profile(spark, sf_dir))
    return m.withColumns({c: F.array_join(c, ",") for c in ("reference_models", "reference_run_ids")})


PROFILE_METADATA_SQL = "WITH " + QA_SQL + f"""
SELECT '1.0.0' AS version, '{CREATED_AT}' AS created_at, '{BENCHMARK}' AS benchmark, '{','.join(REFERENCE_MODELS)}' AS reference_models,
       string_agg(DISTINCT 'run-' || model, ',' ORDER BY 'run-' || model) AS reference_run_ids, count(*) AS total_sessions,
       CAST({BOOTSTRAP_B} AS BIGINT) AS bootstrap_b, CAST({SEED} AS BIGINT) AS bootstrap_seed,
       CAST({PERCENTILE} AS BIGINT) AS threshold_percentile, CAST({ALPHA} AS DOUBLE) AS alpha, 'benjamini-hochberg' AS correction_method
FROM qa WHERE model IN ({', '.join(f"'{m}'" for m in REFERENCE_MODELS)})"""


def trace_lookup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4/C5 + A10/A13: traces find their record by group id (fallback: trace id);
    unmatched traces are reported; matched traces are renumbered per session."""
    c = read_table(spark, sf_dir, "conversations")
    records = c.filter(F.col("role") == "user").select(F.col("conv_id").cast("string").alias("id")).distinct()
    tr = c.filter(F.col("role") == "assistant").select(
        F.when(F.col("turn") == 1, F.col("conv_id").cast("string"))
        .otherwise(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("trace_id"),
        F.when((F.col("turn") != 1) & (F.pmod(F.col("conv_id"), F.lit(10)) != 0), F.col("conv_id").cast("string"))
        .alias("group_id"),
        F.col("turn").alias("created_at"), F.col("text").alias("output_text"))
    keyed = tr.withColumn("id", F.coalesce("group_id", "trace_id"))
    matched = keyed.join(records, "id", "left_semi")
    unmatched = keyed.join(records, "id", "left_anti")
    w = Window.partitionBy("id").orderBy("created_at", "trace_id")
    sessions = matched.withColumn("attempt", F.row_number().over(w) - 1).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_traces"), F.max("attempt").alias("last_attempt"))
    lost = unmatched.groupBy(F.split("trace_id", "-")[0].alias("id")).agg(F.count(F.lit(1)).alias("n_unmatched"))
    return sessions.join(lost, "id", "full").select(
        "id", F.coalesce("n_traces", F.lit(0)).alias("n_traces"), "last_attempt",
        F.coalesce("n_unmatched", F.lit(0)).alias("n_unmatched"))


TRACE_LOOKUP_SQL = """WITH records AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id FROM conversations WHERE role = 'user'),
tr AS (
  SELECT CASE WHEN turn = 1 THEN CAST(conv_id AS VARCHAR) ELSE CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END
           AS trace_id,
         CASE WHEN turn <> 1 AND conv_id % 10 <> 0 THEN CAST(conv_id AS VARCHAR) END AS group_id, turn AS created_at
  FROM conversations WHERE role = 'assistant'
),
k AS (SELECT *, coalesce(group_id, trace_id) AS id FROM tr),
m AS (SELECT * FROM k WHERE id IN (SELECT id FROM records)),
u AS (SELECT * FROM k WHERE id NOT IN (SELECT id FROM records)),
s AS (SELECT id, count(*) AS n_traces, CAST(count(*) - 1 AS INTEGER) AS last_attempt FROM m GROUP BY id),
l AS (SELECT split_part(trace_id, '-', 1) AS id, count(*) AS n_unmatched FROM u GROUP BY 1)
SELECT coalesce(s.id, l.id) AS id, coalesce(s.n_traces, 0) AS n_traces, s.last_attempt,
       coalesce(l.n_unmatched, 0) AS n_unmatched
FROM s FULL OUTER JOIN l ON s.id = l.id"""


def lexicon_forms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7/H8 by the lexicon's surface forms on every document and every turn of a conversation."""
    d = read_table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    t = read_table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("id"), "text")
    s = lexicon_scores(d.unionByName(t), ["id"], "text", default_lexicon(spark))
    return s.select("id", "refusal_detection", "refusal_language", "hedging_detection", "hedging_count")


LEXICON_FORMS_SQL = """WITH texts AS (
  SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'c' || conv_id || ':' || turn AS id, text FROM conversations
),
""" + lexicon_flags_sql("texts", "id", "text", default_rows()) + """
SELECT t.id, coalesce(f.refusal_detection, false) AS refusal_detection, f.refusal_language,
       coalesce(f.hedging_detection, false) AS hedging_detection,
       CAST(coalesce(f.hedging_count, 0) AS BIGINT) AS hedging_count
FROM texts t LEFT JOIN lx_flags f ON f.id = t.id"""


def run_pipeline(spark: SparkSession, sf_dir: str, profile_path: str | None = None, scored: DataFrame | None = None) -> DataFrame:
    """J6 — scored responses -> per-category breakdown -> rule verdict per model, plus the
    statistical verdict of the candidate responses against a saved profile.

    J5: without a path, a profile there or a candidate's test, the statistical columns are
    NULL. Reference models, alpha, bootstrap parameters, correction and version are the
    saved profile's. The candidates' responses are one run: all share its verdict.
    Both verdicts read ``scored`` (default: scored here), so the texts are scored once.
    """
    scored = scored_long(spark, sf_dir) if scored is None else scored
    measured = scored.filter(F.col("value").isNotNull())
    rule = rule_verdict(aggregate_scores(measured, ["model", "category"], name_col="metric"), ["model"], name_col="metric")
    skipped = rule.withColumns({c: F.lit(None).cast("string") for c in STATISTICAL_COLUMNS})
    flat = load_profile(spark, profile_path) if profile_path else None
    if flat is None:
        return skipped
    meta = load_profile_metadata(spark, profile_path).first()  # one row
    tests = tests_against(scores_long(spark, sf_dir, meta["reference_models"], scored), flat, alpha=meta["alpha"],
                          bootstrap_b=meta["bootstrap_b"], seed=meta["bootstrap_seed"])
    tests = tests.checkpoint()  # one row a test
    if tests.isEmpty():
        return skipped
    sv = statistical_verdict(tests, critical_metrics(spark), alpha=meta["alpha"], correction_method=meta["correction_method"],
                             profile_version=meta["version"])
    top5 = F.array_join(F.slice("reasons", 1, 5), "; ")  # F5
    sv = sv.select(*[c.alias(n) for c, n in zip((F.col("verdict"), top5, F.col("threshold_profile_version"), F.col("correction_method")),
                                                STATISTICAL_COLUMNS, strict=True)])
    return rule.withColumn("_k", F.lit(1)).join(sv.withColumn("_k", F.lit(1)), "_k").drop("_k")


def pipeline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5/J6 + F5: both verdicts side by side for every model, against a saved profile."""
    scored = scored_long(spark, sf_dir)
    return run_pipeline(spark, sf_dir, saved_profile(spark, sf_dir, scored), scored).withColumn("reasons", F.array_join("reasons", " | "))


def qa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:  # pragma: no cover - helper for notebooks
    return qa(spark, sf_dir)


def medallion_build_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze -> silver table -> gold fact tables (flag on),
    read back; rows per (table, category)."""
    from assay.plans.dashboard_plans import raw_dataset
    base = _scratch(spark, "medallion")
    raw_path, pred_path = os.path.join(base, "raw"), os.path.join(base, "predictions")
    raw_dataset(spark, sf_dir).write.mode("overwrite").parquet(raw_path)
    md.write_predictions(md_typed(predictions(spark, sf_dir)), pred_path, "append")
    paths = md.build_medallion(spark, raw_path, os.path.join(base, "out"), predictions_path=pred_path, gold=True)
    sil = spark.read.parquet(paths["int_filtered_dataset"]).groupBy("data_category_QA").agg(
        F.count(F.lit(1)).alias("n_rows")).withColumn("table", F.lit("int_filtered_dataset"))
    inf = spark.read.parquet(paths["fct_inference_results"]).groupBy("data_category_QA").agg(
        F.count(F.lit(1)).alias("n_rows")).withColumn("table", F.lit("fct_inference_results"))
    sc = spark.read.parquet(paths["fct_evaluation_scores"]).groupBy("data_category_QA").agg(
        F.count(F.lit(1)).alias("n_rows")).withColumn("table", F.lit("fct_evaluation_scores"))
    return sil.unionByName(inf).unionByName(sc)
