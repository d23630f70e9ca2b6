"""Plans over the ``attempts`` and ``chunks`` views: per-attempt scores and
session scorers (H3, H9, H10, H11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.numeric import fixed_mean_sql, fixed_var_pop_sql, round_even_sql
from assay.operators.scoring import score_text_metrics
from assay.operators.session_scores import chunk_attribution, pass_at_k, self_consistency
from assay.plans.sqlkit import length_ratio_sql, set_f1_sql, tokens_sql
from assay.sources.views import ATTEMPTS_SQL, CHUNKS_SQL, attempts, chunks


def attempt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_text_metrics(attempts(spark, sf_dir))


def attempt_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2/H3/H4 for every attempt."""
    return attempt_scores(spark, sf_dir).select(
        "session_id", "attempt", "token_overlap_f1", "question_response_overlap", "response_length_ratio")


ATTEMPT_SCORES_CTE = ATTEMPTS_SQL + """,
att_tok AS (
  SELECT *, """ + tokens_sql("response") + """ AS r_tok, """ + tokens_sql("reference") + """ AS f_tok,
         """ + tokens_sql("question") + """ AS q_tok
  FROM attempts
),
att_scores AS (
  SELECT session_id, attempt,
         """ + set_f1_sql("r_tok", "f_tok") + """ AS token_overlap_f1,
         """ + set_f1_sql("r_tok", "q_tok") + """ AS question_response_overlap,
         """ + length_ratio_sql("r_tok", "f_tok") + """ AS response_length_ratio
  FROM att_tok
)"""

ATTEMPT_SCORES_SQL = "WITH " + ATTEMPT_SCORES_CTE + """
SELECT * FROM att_scores"""


def pass_at_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9 — pass@k on token F1 against the reference, threshold 0.3."""
    return pass_at_k(attempt_scores(spark, sf_dir), ["session_id"], "token_overlap_f1")


PASS_AT_K_SQL = "WITH " + ATTEMPT_SCORES_CTE + """
SELECT session_id, count(*) AS k, """ + round_even_sql("coalesce(max(token_overlap_f1), 0.0)") + """ AS pass_at_k_best_score,
       coalesce(max(token_overlap_f1), 0.0) >= 0.3 AS pass_at_k
FROM att_scores GROUP BY session_id HAVING count(*) >= 2"""


def self_consistency_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H10 — pairwise F1 agreement between the attempts of a session."""
    return self_consistency(attempts(spark, sf_dir), ["session_id"])


SELF_CONSISTENCY_SQL = "WITH " + ATTEMPT_SCORES_CTE + """,
pairs AS (
  SELECT a.session_id, """ + set_f1_sql("a.r_tok", "b.r_tok") + """ AS f1
  FROM att_tok a JOIN att_tok b ON a.session_id = b.session_id AND a.attempt < b.attempt
),
agg AS (
  SELECT session_id, count(*) AS n_pairs, """ + round_even_sql(fixed_mean_sql("f1")) + """ AS self_consistency,
         """ + round_even_sql(fixed_var_pop_sql("f1")) + """ AS self_consistency_variance
  FROM pairs GROUP BY session_id
)
SELECT s.session_id, coalesce(agg.n_pairs, 0) AS n_pairs, agg.self_consistency, agg.self_consistency_variance
FROM (SELECT DISTINCT session_id FROM attempts) s LEFT JOIN agg ON agg.session_id = s.session_id"""


def chunk_attribution_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H11 — chunk attribution of every attempt against its conversation's chunks."""
    r = chunk_attribution(attempts(spark, sf_dir), chunks(spark, sf_dir), ["session_id"])
    return r.withColumn("per_chunk", F.array_join(F.transform("per_chunk", lambda v: F.format_string("%.4f", v)), ","))


CHUNK_ATTRIBUTION_SQL = "WITH " + ATTEMPT_SCORES_CTE + ",\n" + CHUNKS_SQL + """,
pc AS (
  SELECT a.session_id, a.attempt, c.chunk_id, CAST(c.chunk_score AS DOUBLE) AS x,
         """ + set_f1_sql("a.r_tok", tokens_sql("c.content")) + """ AS y
  FROM att_tok a JOIN chunks c ON c.session_id = a.session_id
),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY session_id, attempt ORDER BY x)
              + (count(*) OVER (PARTITION BY session_id, attempt, x) - 1) / 2.0 AS rx,
            rank() OVER (PARTITION BY session_id, attempt ORDER BY y)
              + (count(*) OVER (PARTITION BY session_id, attempt, y) - 1) / 2.0 AS ry,
            sum(y) OVER (PARTITION BY session_id, attempt) AS total
  FROM pc
),
g AS (
  SELECT session_id, attempt, count(*) AS n_chunks, max(y) AS max_attr,
         -sum((y / CASE WHEN total = 0 THEN 1.0 ELSE total END)
              * log2((y / CASE WHEN total = 0 THEN 1.0 ELSE total END) + 1e-10)) AS entropy,
         sum(rx) AS sx, sum(ry) AS sy, sum(rx * ry) AS sxy, sum(rx * rx) AS sxx, sum(ry * ry) AS syy,
         string_agg(printf('%.4f', round(y, 4)), ',' ORDER BY chunk_id) AS per_chunk
  FROM ranked GROUP BY session_id, attempt
),
c AS (
  SELECT *, n_chunks * sxy - sx * sy AS num,
         sqrt((n_chunks * sxx - sx * sx) * (n_chunks * syy - sy * sy)) AS den
  FROM g
)
SELECT session_id, attempt, n_chunks, """ + round_even_sql("max_attr") + """ AS chunk_attribution,
       """ + round_even_sql("entropy") + """ AS chunk_entropy,
       """ + round_even_sql("CASE WHEN n_chunks > 2 THEN coalesce(CASE WHEN den > 1e-12 THEN num / den END, 0.0) ELSE 0.0 END") + """
         AS chunk_score_correlation,
       per_chunk
FROM c"""
