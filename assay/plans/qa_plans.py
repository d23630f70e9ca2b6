"""Plans over the ``qa`` view: score responses, aggregate, verdict.

Each ``*_query(spark, sf_dir)`` returns a lazy DataFrame; each ``*_SQL`` is
the DuckDB oracle of the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.classify import FAILURE_MODE_SQL
from assay.functions.numeric import fixed_mean_sql, fixed_var_pop_sql, round_even_sql
from assay.functions.lexicon import default_rows
from assay.operators.aggregate import (aggregate_overall_and_by, aggregate_scores, failure_mode_rates,
                                       unpivot_metrics)
from assay.operators.scoring import score_responses
from assay.operators.verdict import rule_verdict, rule_verdict_metrics
from assay.plans.sqlkit import length_ratio_sql, lexicon_flags_sql, set_f1_sql, tokens_sql
from assay.sources.views import QA_SQL, qa

QA_METRICS = ["token_overlap_f1", "question_response_overlap", "response_length_ratio",
              "refusal_detection", "hedging_detection"]


def scored_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored."""
    return score_responses(qa(spark, sf_dir), ["session_id"], default_rows())


SCORED_QA_SQL = QA_SQL + """,
qa_tok AS (
  SELECT *, """ + tokens_sql("response") + """ AS r_tok, """ + tokens_sql("reference") + """ AS f_tok,
         """ + tokens_sql("question") + """ AS q_tok
  FROM qa
),
""" + lexicon_flags_sql("qa", "session_id", "response", default_rows()) + """,
scored AS (
  SELECT t.session_id, t.model, t.language, t.category, t.question, t.response, t.reference,
         """ + set_f1_sql("t.r_tok", "t.f_tok") + """ AS token_overlap_f1,
         """ + length_ratio_sql("t.r_tok", "t.f_tok") + """ AS response_length_ratio,
         """ + set_f1_sql("t.r_tok", "t.q_tok") + """ AS question_response_overlap,
         coalesce(f.refusal_detection, false) AS refusal_detection, f.refusal_language,
         coalesce(f.hedging_detection, false) AS hedging_detection,
         coalesce(f.hedging_count, 0) AS hedging_count
  FROM qa_tok t LEFT JOIN lx_flags f ON f.session_id = t.session_id
),
scored_fm AS (
  SELECT *, """ + FAILURE_MODE_SQL.format(ref="refusal_detection", f1="token_overlap_f1",
                                           hedge="hedging_detection", cat="category") + """ AS failure_mode
  FROM scored
)"""


def qa_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_qa(spark, sf_dir)
    return s.select("session_id", "model", "category", "token_overlap_f1", "question_response_overlap",
                    "response_length_ratio", "refusal_detection", "refusal_language",
                    "hedging_detection", "hedging_count", "failure_mode")


QA_SCORES_SQL = "WITH " + SCORED_QA_SQL + """
SELECT session_id, model, category, token_overlap_f1, question_response_overlap, response_length_ratio,
       refusal_detection, refusal_language, hedging_detection, CAST(hedging_count AS BIGINT) AS hedging_count,
       failure_mode
FROM scored_fm"""


def _long(spark, sf_dir):
    s = scored_qa(spark, sf_dir)
    return unpivot_metrics(s, ["model", "category", "session_id"], QA_METRICS)


def qa_breakdown_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 + D2: per model, overall and per category, for every scorer."""
    return aggregate_overall_and_by(_long(spark, sf_dir), by="category", outer=["model"])


_LONG_SQL = SCORED_QA_SQL + """,
long AS (
  SELECT model, category, session_id, scorer_name, value FROM (
    UNPIVOT (SELECT model, category, session_id,
                    CAST(token_overlap_f1 AS DOUBLE) AS token_overlap_f1,
                    CAST(question_response_overlap AS DOUBLE) AS question_response_overlap,
                    CAST(response_length_ratio AS DOUBLE) AS response_length_ratio,
                    CAST(refusal_detection AS DOUBLE) AS refusal_detection,
                    CAST(hedging_detection AS DOUBLE) AS hedging_detection
             FROM scored)
    ON token_overlap_f1, question_response_overlap, response_length_ratio, refusal_detection, hedging_detection
    INTO NAME scorer_name VALUE value)
  WHERE value IS NOT NULL
)"""

_STD_SQL = f"CASE WHEN count(value) < 2 THEN 0.0 ELSE sqrt({fixed_var_pop_sql('value')}) END"
_AGG_SQL = f"""{round_even_sql(fixed_mean_sql('value'))} AS mean,
       {round_even_sql(_STD_SQL)} AS std,
       count(value) AS count"""

QA_BREAKDOWN_SQL = "WITH " + _LONG_SQL + f"""
SELECT model, category, scorer_name, {_AGG_SQL},
       CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS level
FROM long GROUP BY GROUPING SETS ((model, scorer_name), (model, category, scorer_name))"""


def qa_verdict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: J1 verdict per model from D2 per-category means."""
    by_cat = aggregate_scores(_long(spark, sf_dir), ["model", "category"])
    v = rule_verdict(by_cat, ["model"])
    return v.withColumn("reasons", F.array_join("reasons", " | "))


def rule_verdict_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule verdict's metrics of each model as key/value rows."""
    by_cat = aggregate_scores(_long(spark, sf_dir), ["model", "category"])
    return rule_verdict_metrics(rule_verdict(by_cat, ["model"]), ["model"])


def _fmt3(x):
    return f"printf('%.3f', {round_even_sql(x, 3)})"


QA_VERDICT_SQL = "WITH " + _LONG_SQL + f""",
by_cat AS (
  SELECT model, category, scorer_name, {_AGG_SQL} FROM long GROUP BY model, category, scorer_name
),
g AS (
  SELECT model,
    coalesce(max(CASE WHEN category = 'positivo' AND scorer_name = 'token_overlap_f1' THEN mean END), 0.0) AS po,
    coalesce(max(CASE WHEN category = 'negativo' AND scorer_name = 'token_overlap_f1' THEN mean END), 0.0) AS no_,
    coalesce(max(CASE WHEN category = 'positivo' AND scorer_name = 'refusal_detection' THEN mean END), 0.0) AS pr,
    coalesce(max(CASE WHEN category = 'negativo' AND scorer_name = 'refusal_detection' THEN mean END), 0.0) AS nr,
    max(CASE WHEN category = 'positivo' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN category = 'negativo' THEN 1 ELSE 0 END) = 1 AS complete
  FROM by_cat GROUP BY model
),
d AS (SELECT *, CASE WHEN complete THEN abs(po - no_) ELSE 0.0 END AS delta FROM g)
SELECT model,
  CASE WHEN NOT complete THEN 'inconclusive'
       WHEN po >= 0.3 AND (nr >= 0.3 OR no_ < 0.3) AND delta >= 0.1 THEN 'capable'
       WHEN po < 0.3 AND NOT (nr >= 0.3 OR no_ < 0.3) THEN 'not_capable'
       ELSE 'inconclusive' END AS verdict,
  po AS positivo_overlap_mean, no_ AS negativo_overlap_mean, pr AS positivo_refusal_rate,
  nr AS negativo_refusal_rate, delta AS discrimination_delta,
  CASE WHEN NOT complete THEN 'Missing category data — cannot determine capability' ELSE
    (CASE WHEN po >= 0.3 THEN 'Positivo overlap (' || {_fmt3('po')} || ') >= threshold (0.3)'
          ELSE 'Positivo overlap (' || {_fmt3('po')} || ') < threshold (0.3)' END)
    || ' | ' ||
    (CASE WHEN nr >= 0.3 THEN 'Negativo refusal rate (' || {_fmt3('nr')} || ') >= threshold (0.3)'
          WHEN no_ < 0.3 THEN 'Negativo overlap (' || {_fmt3('no_')} || ') < threshold — avoids hallucination'
          ELSE 'Negativo: low refusal (' || {_fmt3('nr')} || ') and high overlap (' || {_fmt3('no_')} || ') — hallucination risk' END)
    || ' | ' ||
    (CASE WHEN delta >= 0.1 THEN 'Discrimination delta (' || {_fmt3('delta')} || ') >= threshold (0.1)'
          ELSE 'Discrimination delta (' || {_fmt3('delta')} || ') < threshold (0.1) — model does not differentiate categories' END)
  END AS reasons
FROM d"""


def qa_failure_rates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 — failure-mode counts and rates per model."""
    return failure_mode_rates(scored_qa(spark, sf_dir), ["model"])


RULE_VERDICT_METRICS_SQL = """SELECT model, 'verdict_' || name AS metric_key, value AS metric_value FROM (
  UNPIVOT (SELECT model, CAST(positivo_overlap_mean AS DOUBLE) AS positivo_overlap_mean,
                  CAST(negativo_overlap_mean AS DOUBLE) AS negativo_overlap_mean,
                  CAST(positivo_refusal_rate AS DOUBLE) AS positivo_refusal_rate,
                  CAST(negativo_refusal_rate AS DOUBLE) AS negativo_refusal_rate,
                  CAST(discrimination_delta AS DOUBLE) AS discrimination_delta FROM (""" + QA_VERDICT_SQL + """))
  ON positivo_overlap_mean, negativo_overlap_mean, positivo_refusal_rate, negativo_refusal_rate, discrimination_delta
  INTO NAME name VALUE value)"""

QA_FAILURE_RATES_SQL = "WITH " + SCORED_QA_SQL + """,
c AS (SELECT model, failure_mode, count(*) AS count FROM scored_fm GROUP BY model, failure_mode)
SELECT model, failure_mode, count, CAST(sum(count) OVER (PARTITION BY model) AS BIGINT) AS total_scored,
       """ + round_even_sql("count / sum(count) OVER (PARTITION BY model)") + """ AS rate
FROM c"""


def rouge_l_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5 — ROUGE-L of every response against its reference (no SQL oracle: the LCS
    recurrence is checked against the dynamic program in unit tests)."""
    from assay.functions.lcs import rouge_l
    from assay.functions.tokens import tokens
    q = qa(spark, sf_dir)
    return q.select("session_id", "model", "category",
                    rouge_l(tokens("response"), tokens("reference")).alias("rouge_l"))
