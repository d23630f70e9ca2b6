"""Plans of the scored export (A5, M2, H14) and of raw scores read off it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.classify import FAILURE_MODE_SQL
from assay.functions.lexicon import default_rows
from assay.functions.numeric import fixed_mean_sql, fixed_var_pop_sql, round_even_sql
from assay.operators import export as ex
from assay.plans.sqlkit import length_ratio_sql, lexicon_flags_sql, rouge_l_sql, set_f1_sql, tokens_sql
from assay.session import ensure_checkpoint_dir
from assay.sources import medallion as md
from assay.sources.views import ATTEMPTS_SQL, CHUNKS_SQL, attempts, chunks

TIMESTAMP = "2026-01-01T00:00:00"


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts view as answers of eight runs, with classes and judges' raw answers."""
    a = attempts(spark, sf_dir)
    sid, word = F.col("session_id"), F.split("question", " ")
    classes = F.array(*[F.struct(F.get(word, F.lit(i)).alias("class"), F.lit("").alias("context"), F.lit(f"c{i}").alias("id")) for i in range(2)])
    turn = F.col("turn")
    return a.withColumns({
        "run_id": F.concat(F.lit("run-"), F.pmod(sid, F.lit(8))), "model": F.concat(F.lit("m"), F.pmod(sid, F.lit(4))),
        "category": F.when(F.pmod(sid, F.lit(2)) == 0, "positivo").otherwise("negativo"),
        "language": F.pmod(sid, F.lit(4)).cast("long"),
        "classes": classes, "chosen_class_id": F.concat(F.lit("c"), F.pmod(sid, F.lit(3))),
        "correctness_raw": F.when(F.pmod(turn, F.lit(4)) == 1, " YES").when(F.pmod(turn, F.lit(4)) == 3, "no"),
        "guidelines_raw": F.when(F.pmod(sid, F.lit(5)) != 0, F.when(F.length("response") > 400, "yes").otherwise("unsure")),
        "groundedness_raw": F.length("response") / 512.0 - 0.25})


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of all attempts, written as JSON lines and read again."""
    ensure_checkpoint_dir(spark)
    base = answered(spark, sf_dir).checkpoint()  # read by each scorer that moves rows
    path = md.scratch_path(spark, f"export-{uuid.uuid4().hex}")
    n = ex.export_predictions(ex.scored_export(base, default_rows(), TIMESTAMP, chunks(spark, sf_dir)), path)
    return md.read_predictions(spark, path).withColumn("n_exported", F.lit(n).cast("long"))


def scored_export_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + M2 + H14 + H5: every metric on every attempt, read from the exported JSON lines."""
    return exported(spark, sf_dir).select(
        "id", "run_id", "attempt", "model", "data_category_QA", "language", "token_overlap_f1", "question_response_overlap",
        "response_length_ratio", "rouge_l", "chunk_attribution", "class_exact_match", "refusal_detection", "hedging_detection",
        "correctness_score", "guidelines_score", "groundedness_score", "pass_at_k", "pass_at_k_best_score", "self_consistency",
        "self_consistency_variance", "failure_mode", "n_exported")


EXPORT_SQL = "WITH RECURSIVE " + ATTEMPTS_SQL + ",\n" + CHUNKS_SQL + """,
e AS (
  SELECT *, session_id || '-' || attempt AS trace, 'run-' || (session_id % 8) AS run_id, 'm' || (session_id % 4) AS model,
         CASE WHEN session_id % 2 = 0 THEN 'positivo' ELSE 'negativo' END AS category, CAST(session_id % 4 AS BIGINT) AS language,
         'c' || (session_id % 3) AS chosen, """ + tokens_sql("response") + " AS r_tok, " + tokens_sql("reference") + " AS f_tok, " + tokens_sql("question") + """ AS q_tok
  FROM attempts
),
""" + lexicon_flags_sql("e", "trace", "response", default_rows()) + ",\n" + rouge_l_sql("e", "trace", "r_tok", "f_tok") + """,
attr AS (
  SELECT trace, max(""" + set_f1_sql("e.r_tok", tokens_sql("c.content")) + """) AS chunk_attribution
  FROM e JOIN chunks c ON c.session_id = e.session_id GROUP BY trace
),
s AS (
  SELECT e.*, """ + set_f1_sql("r_tok", "f_tok") + " AS token_overlap_f1, " + set_f1_sql("r_tok", "q_tok") + " AS question_response_overlap, " + length_ratio_sql("r_tok", "f_tok") + """ AS response_length_ratio,
         CASE chosen WHEN 'c0' THEN string_split(question, ' ')[1] WHEN 'c1' THEN string_split(question, ' ')[2] END AS class_name,
         coalesce(f.refusal_detection, false) AS refusal_detection, coalesce(f.hedging_detection, false) AS hedging_detection
  FROM e LEFT JOIN lx_flags f ON f.trace = e.trace
),
p AS (
  SELECT session_id, """ + round_even_sql("max(token_overlap_f1)") + """ AS best, max(token_overlap_f1) >= 0.3 AS pass
  FROM s GROUP BY session_id HAVING count(*) >= 2
),
pairs AS (
  SELECT a.session_id, """ + set_f1_sql("a.r_tok", "b.r_tok") + """ AS f1
  FROM e a JOIN e b ON a.session_id = b.session_id AND a.attempt < b.attempt
),
agree AS (
  SELECT session_id, """ + round_even_sql(fixed_mean_sql("f1")) + " AS mean, " + round_even_sql(fixed_var_pop_sql("f1")) + """ AS variance
  FROM pairs GROUP BY session_id
),
export AS (
SELECT CAST(s.session_id AS VARCHAR) AS id, run_id, s.attempt, model, category AS data_category_QA, language, token_overlap_f1,
       question_response_overlap, response_length_ratio, rl.rouge_l, attr.chunk_attribution,
       CASE WHEN class_name IS NULL THEN NULL
            ELSE contains(lower(coalesce(response, '')), chosen)
                 OR (class_name <> '' AND contains(lower(coalesce(response, '')), lower(replace(class_name, '_', ' ')))) END AS class_exact_match,
       refusal_detection, hedging_detection,
       CASE turn % 4 WHEN 1 THEN 1.0 WHEN 3 THEN 0.0 END::DOUBLE AS correctness_score,
       CASE WHEN s.session_id % 5 <> 0 THEN CASE WHEN length(response) > 400 THEN 1.0 ELSE 0.0 END END::DOUBLE AS guidelines_score,
       CASE WHEN response IS NOT NULL THEN """ + round_even_sql("least(greatest(length(response) / 512.0 - 0.25, 0.0), 1.0)") + """ END AS groundedness_score,
       p.pass AS pass_at_k, p.best AS pass_at_k_best_score, agree.mean AS self_consistency, agree.variance AS self_consistency_variance,
       """ + FAILURE_MODE_SQL.format(ref="refusal_detection", f1="token_overlap_f1", hedge="hedging_detection", cat="category") + """ AS failure_mode,
       count(*) OVER () AS n_exported
FROM s LEFT JOIN rl ON rl.trace = s.trace LEFT JOIN attr ON attr.trace = s.trace
       LEFT JOIN p ON p.session_id = s.session_id LEFT JOIN agree ON agree.session_id = s.session_id
)"""

SCORED_EXPORT_SQL = EXPORT_SQL + "\nSELECT * FROM export"


def raw_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First attempts' scores by run, category and metric, where each session has one."""
    raw = ex.collect_raw_scores(exported(spark, sf_dir).drop("n_exported"))
    return raw.groupBy("run_id", "category", "metric").agg(
        F.count("value").alias("n_values"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"))


RAW_SCORES_SQL = EXPORT_SQL + """,
f AS (SELECT * FROM export QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY attempt) = 1),
long AS (""" + "\n  UNION ALL ".join(
    f"SELECT run_id, data_category_QA AS category, '{m}' AS metric, CAST({'groundedness_score' if m == 'groundedness' else m} AS DOUBLE) AS value FROM f"
    for m in ex.STATISTICAL_METRICS) + """)
SELECT run_id, category, metric, count(value) AS n_values, round(sum(value), 4) AS total, min(value) AS least, max(value) AS greatest
FROM long GROUP BY run_id, category, metric HAVING count(value) = count(*)"""

QUERIES = {"scored_export": scored_export_query, "raw_scores": raw_scores_query}
ORACLE_SQL = {"scored_export": SCORED_EXPORT_SQL, "raw_scores": RAW_SCORES_SQL}
