"""Record-level plans: class match, prompts, knowledge, cache, token usage, provider,
judge normalisation, gold round trip, bookkeeping (H6, H16-H21, K1-K5, C2, C8-C10,
D18, D21-D24, E3, B12-B19, A3, A5, A12)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import text as tx
from assay.functions.numeric import fixed_mean, fixed_mean_sql, round_even_sql
from assay.functions.numeric import fixed_var_pop_sql as _var_sql
from assay.plans.sqlkit import length_ratio_sql as _ratio_sql
from assay.plans.sqlkit import set_f1_sql as _f1_sql
from assay.plans.sqlkit import tokens_sql as _tok_sql
from assay.operators import requests as rq
from assay.operators.aggregate import completeness_gate, unpivot_metrics
from assay.operators.analysis import first_of_session
from assay.plans.dashboard_plans import PREDS_SQL, predictions
from assay.plans.qa_plans import QA_METRICS, SCORED_QA_SQL, scored_qa
from assay.sources import medallion as md
from assay.sources.tables import read_table
from assay.sources.views import ATTEMPTS_SQL, QA_SQL, attempts, qa

LANG_CODE_SQL = "CASE language WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'pt' THEN 3 ELSE 0 END"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset records (FIXTURES §1 layout) derived from the qa view."""
    q = qa(spark, sf_dir)
    code = F.create_map(F.lit("en"), F.lit(1), F.lit("es"), F.lit(2), F.lit("pt"), F.lit(3))
    words = F.split(F.col("question"), " ")
    classes = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(
        F.try_element_at(words, i + 1).alias("class"), F.concat(F.lit("ctx"), i).alias("context"),
        F.concat(F.lit("c"), i).alias("id")))
    return q.select(
        F.col("session_id").cast("string").alias("id"), "session_id", "question", "response", "reference",
        F.col("category").alias("data_category_QA"),
        F.coalesce(F.try_element_at(code, F.col("language")), F.lit(0)).alias("language"),
        F.col("model").alias("name"), F.concat(F.col("language"), F.lit(" writer")).alias("occupation"),
        F.lit("Helpful").alias("adjective"), F.col("question").alias("chatbot_goal"),
        F.array(F.concat(F.lit("Answer in "), F.col("language")), F.concat(F.lit("Cite "), F.col("model")))
        .alias("instructions"),
        classes.alias("classes"),
        F.concat(F.lit("c"), F.pmod(F.col("session_id"), F.lit(7))).alias("chosen_class_id"),
        F.array(F.struct(F.col("question").alias("content"), F.lit(1.0).alias("score")),
                F.struct(F.col("reference").alias("content"), F.lit(0.5).alias("score"))).alias("chunks_big"),
    )


RECORDS_SQL = QA_SQL + f""",
records AS (
  SELECT CAST(session_id AS VARCHAR) AS id, session_id, question, response, reference, category AS data_category_QA,
         {LANG_CODE_SQL} AS language, model AS name, language || ' writer' AS occupation, 'Helpful' AS adjective,
         question AS chatbot_goal, ['Answer in ' || language, 'Cite ' || model] AS instructions,
         list_transform(range(5), lambda i: {{'class': string_split(question, ' ')[i + 1], 'context': 'ctx' || i,
                                          'id': 'c' || i}}) AS classes,
         'c' || (session_id % 7) AS chosen_class_id,
         [{{'content': question, 'score': 1.0}}, {{'content': reference, 'score': 0.5}}] AS chunks_big
  FROM qa
)"""


def class_match_query(spark, sf_dir):
    """H6 + C10: class exact match (N/A when the expected id is not in the class list)."""
    r = records(spark, sf_dir)
    return r.select("session_id", "chosen_class_id", tx.class_name_for("classes", "chosen_class_id").alias("class_name"),
                    tx.class_exact_match("response", "classes", "chosen_class_id").alias("class_exact_match"))


CLASS_MATCH_SQL = "WITH " + RECORDS_SQL + """,
c AS (SELECT session_id, chosen_class_id, response,
             list_filter(classes, lambda x: x.id = chosen_class_id)[1].class AS class_name FROM records)
SELECT session_id, chosen_class_id, class_name,
       CASE WHEN chosen_class_id IS NULL OR chosen_class_id = '' OR class_name IS NULL THEN NULL
            ELSE contains(lower(response), lower(chosen_class_id))
                 OR (coalesce(class_name, '') <> '' AND contains(lower(response), lower(replace(class_name, '_', ' '))))
       END AS class_exact_match
FROM c"""


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def prompts_query(spark, sf_dir):
    """Rendered system prompt, its hash and cache key, joined guidelines."""
    r = records(spark, sf_dir)
    p = r.withColumn("prompt", tx.render_prompt("name", "adjective", "occupation", "chatbot_goal", "instructions",
                                                "language", "classes"))
    h = tx.prompt_hash("prompt")
    return p.select("session_id", h.alias("prompt_hash"),
                    tx.cache_key(F.col("id"), F.lit("gpt-4o-mini"), h).alias("cache_key"),
                    F.length("prompt").alias("prompt_len"),
                    tx.join_instructions("instructions").alias("expected_guidelines"))


_PROMPT_SQL = ("'You are ' || name || ', a ' || lower(adjective) || ' ' || occupation || '.' || "
               + _sql_lit(tx.PROMPT_GOAL) + " || chatbot_goal || " + _sql_lit(tx.PROMPT_INSTRUCTIONS)
               + " || array_to_string(list_transform(instructions, lambda s: '- ' || s || chr(10)), '') || "
               + _sql_lit(tx.PROMPT_LANGUAGE)
               + " || CASE language WHEN 1 THEN 'English' WHEN 2 THEN 'Spanish' WHEN 3 THEN 'Portuguese' ELSE "
               + _sql_lit(tx.PROMPT_DEFAULT_LANGUAGE) + " END || " + _sql_lit(tx.PROMPT_KNOWLEDGE)
               + " || CASE WHEN len(classes) > 0 THEN " + _sql_lit(tx.PROMPT_CLASSES)
               + " || array_to_string(list_transform(classes, lambda c: '- [' || c.id || '] ' || c.class || ': ' || c.context"
               + " || chr(10)), '') || chr(10) ELSE chr(10) END")

PROMPTS_SQL = "WITH " + RECORDS_SQL + f""",
p AS (SELECT session_id, id, instructions, {_PROMPT_SQL} AS prompt FROM records)
SELECT session_id, substr(sha256(prompt), 1, 12) AS prompt_hash,
       substr(sha256(id || ':gpt-4o-mini:' || substr(sha256(prompt), 1, 12)), 1, 16) AS cache_key,
       CAST(length(prompt) AS INTEGER) AS prompt_len, array_to_string(instructions, '; ') AS expected_guidelines
FROM p"""


def knowledge_query(spark, sf_dir):
    """Knowledge text of every record (length and sha256)."""
    r = records(spark, sf_dir)
    k = tx.knowledge_content(F.transform("chunks_big", lambda c: c["content"]))
    return r.select("session_id", F.length(k).alias("knowledge_len"), F.sha2(k, 256).alias("knowledge_sha256"))


KNOWLEDGE_SQL = "WITH " + RECORDS_SQL + f""",
k AS (SELECT session_id, array_to_string(list_transform(chunks_big, lambda c: c.content), {_sql_lit(tx.KNOWLEDGE_SEPARATOR)}) AS j
      FROM records)
SELECT session_id, CAST(length(CASE WHEN j = '' THEN {_sql_lit(tx.KNOWLEDGE_EMPTY)} ELSE j END) AS INTEGER) AS knowledge_len,
       sha256(CASE WHEN j = '' THEN {_sql_lit(tx.KNOWLEDGE_EMPTY)} ELSE j END) AS knowledge_sha256
FROM k"""


def tool_args_query(spark, sf_dir):
    """Event properties parsed as tool-call arguments."""
    e = read_table(spark, sf_dir, "events")
    a = tx.tool_arguments("props")
    return e.select("event_id", ((a == F.col("props")) & F.trim("props").startswith("{")).alias("is_object"),
                    F.get_json_object(a, "$.k").alias("k"))


TOOL_ARGS_SQL = """SELECT event_id, coalesce(json_valid(props) AND starts_with(trim(props), '{'), false) AS is_object,
       json_extract_string(props, '$.k') AS k FROM events"""


def judge_norm_query(spark, sf_dir):
    """B16 + B17: judge feedback and groundedness normalisation on event values."""
    e = read_table(spark, sf_dir, "events")
    raw = F.when(F.col("value") > 50, " Yes").when(F.col("value") < 10, "no ").otherwise("maybe")
    return e.select("event_id", tx.judge_feedback(raw).alias("judge_score"),
                    tx.groundedness(F.col("value") / 50.0 - 0.5).alias("groundedness"))


JUDGE_NORM_SQL = f"""SELECT event_id,
       CAST(CASE WHEN value > 50 THEN 1.0 WHEN value < 10 THEN 0.0 ELSE 0.0 END AS DOUBLE) AS judge_score,
       {round_even_sql('least(greatest(coalesce(value / 50.0 - 0.5, 0.0), 0.0), 1.0)::DOUBLE')} AS groundedness
FROM events"""


def provider_query(spark, sf_dir):
    """Provider and judge URI of model strings."""
    d = read_table(spark, sf_dir, "documents")
    m = F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0, F.concat(F.col("lang"), F.lit("/"), F.col("source"))) \
        .otherwise(F.col("source"))
    return d.select("doc_id", tx.provider(m).alias("provider"), tx.judge_model_uri(m).alias("judge_uri"))


PROVIDER_SQL = """SELECT doc_id,
       CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'openai' END AS provider,
       CASE WHEN doc_id % 2 = 0 THEN lang || ':/' || source ELSE 'openai:/' || source END AS judge_uri
FROM documents"""


# ----------------------------------------------------------------- requests
K_ATTEMPTS = 3


def _requests_and_cache(spark, sf_dir):
    reqs = rq.build_requests(records(spark, sf_dir), "gpt-4o-mini", K_ATTEMPTS)
    # an earlier run answered English records, attempts 0..(session_id mod 3)
    prev = reqs.filter((F.col("language") == 1) & (F.col("attempt") <= F.pmod(F.col("session_id"), F.lit(3))))
    cache = prev.select("cache_key", F.col("attempt").cast("long").alias("created_at"),
                        F.concat_ws("-", "id", "attempt").alias("trace_id"),
                        F.concat(F.lit("cached answer "), F.col("attempt")).alias("output_text"))
    return reqs, rq.number_attempts(cache)


def cache_counts_query(spark, sf_dir):
    """K requests per record resolved against a cache."""
    reqs, cache = _requests_and_cache(spark, sf_dir)
    return rq.cache_counts(reqs, cache)


CACHE_COUNTS_SQL = "WITH " + RECORDS_SQL + f"""
SELECT CAST(sum(CASE WHEN language = 1 THEN session_id % 3 + 1 ELSE 0 END) AS BIGINT) AS hits,
       CAST(count(*) * {K_ATTEMPTS} - sum(CASE WHEN language = 1 THEN session_id % 3 + 1 ELSE 0 END) AS BIGINT) AS misses
FROM records"""


def sessions_query(spark, sf_dir):
    """K3 + K4: misses answered by a deterministic stub responder, assembled per record."""
    reqs, cache = _requests_and_cache(spark, sf_dir)
    hits, misses = rq.resolve_cache(reqs, cache)

    def stub(pdf):
        import pandas as pd
        out = pd.DataFrame({"id": pdf["id"], "attempt": pdf["attempt"],
                            "output_text": "stub answer " + pdf["attempt"].astype(str),
                            "error": None})
        return out

    answered = rq.respond(misses.select("id", "attempt"), stub, "id string, attempt int, output_text string, error string")
    allr = hits.select("id", "attempt", "output_text").unionByName(answered.drop("error"))
    s = rq.assemble_sessions(allr, ["id"])
    return s.select("id", "n_traces", F.transform("traces", lambda t: t["output_text"]).alias("outputs")) \
        .withColumn("outputs", F.array_join("outputs", "|"))


SESSIONS_SQL = "WITH " + RECORDS_SQL + f"""
SELECT id, count(*) AS n_traces,
       string_agg(CASE WHEN language = 1 AND i <= session_id % 3 THEN 'cached answer ' ELSE 'stub answer ' END || i, '|' ORDER BY i) AS outputs
FROM records CROSS JOIN (SELECT unnest(range({K_ATTEMPTS})) AS i) GROUP BY id"""


def upsert_query(spark, sf_dir):
    """K5: register records twice; the second version replaces positivo records."""
    r = records(spark, sf_dir).select("id", "data_category_QA", "name")
    cur = r.withColumn("version", F.lit(1))
    upd = r.filter(F.col("data_category_QA") == "positivo").withColumn("name", F.concat("name", F.lit("-v2"))) \
        .withColumn("version", F.lit(2))
    return rq.upsert_latest(cur, upd).groupBy("version").agg(F.count(F.lit(1)).alias("n_records"))


UPSERT_SQL = "WITH " + RECORDS_SQL + """
SELECT CASE WHEN data_category_QA = 'positivo' THEN 2 ELSE 1 END AS version, count(*) AS n_records
FROM records GROUP BY 1"""


def token_usage_query(spark, sf_dir):
    """Per response, token usage summed over its calls (events as calls)."""
    e = read_table(spark, sf_dir, "events")
    calls = e.select(F.col("user_id").alias("trace_id"), F.floor(F.col("value") * 10).alias("input_tokens"),
                     F.floor(F.col("value")).alias("output_tokens"),
                     (F.floor(F.col("value") * 10) + F.floor(F.col("value"))).alias("total_tokens"))
    return rq.token_usage(calls)


TOKEN_USAGE_SQL = """SELECT user_id AS trace_id, CAST(sum(floor(value * 10)) AS BIGINT) AS input_tokens,
       CAST(sum(floor(value)) AS BIGINT) AS output_tokens,
       CAST(sum(floor(value * 10) + floor(value)) AS BIGINT) AS total_tokens
FROM events GROUP BY user_id"""


# ------------------------------------------------------------- bookkeeping
def bookkeeping_query(spark, sf_dir):
    """D23 + D24: sessions, scored rows and scorer names per run."""
    long = unpivot_metrics(scored_qa(spark, sf_dir), ["model", "session_id"], QA_METRICS)
    return long.groupBy("model").agg(
        F.countDistinct("session_id").alias("total_sessions"), F.count(F.lit(1)).alias("total_scored"),
        F.array_join(F.array_sort(F.collect_set("scorer_name")), ",").alias("scorers"))


BOOKKEEPING_SQL = "WITH " + SCORED_QA_SQL + """
SELECT model, count(DISTINCT session_id) AS total_sessions,
       count(token_overlap_f1) + count(question_response_overlap) + count(response_length_ratio)
         + count(refusal_detection) + count(hedging_detection) AS total_scored,
       array_to_string(list_sort(list_distinct(flatten(list(
         list_filter(['hedging_detection', 'question_response_overlap', 'refusal_detection', 'response_length_ratio',
                      'token_overlap_f1'],
                     lambda x: (x = 'token_overlap_f1' AND token_overlap_f1 IS NOT NULL)
                       OR (x = 'question_response_overlap' AND question_response_overlap IS NOT NULL)
                       OR (x = 'response_length_ratio' AND response_length_ratio IS NOT NULL)
                       OR (x = 'refusal_detection' AND refusal_detection IS NOT NULL)
                       OR (x = 'hedging_detection' AND hedging_detection IS NOT NULL)))))), ',') AS scorers
FROM scored GROUP BY model"""


def global_delta_query(spark, sf_dir):
    """|mean F1 (positivo) - mean F1 (negativo)| per model (NULL if a category is missing)."""
    s = scored_qa(spark, sf_dir)
    f1 = F.col("token_overlap_f1")
    g = s.groupBy("model").agg(
        fixed_mean(F.when(F.col("category") == "positivo", f1)).alias("mp"),
        fixed_mean(F.when(F.col("category") == "negativo", f1)).alias("mn"))
    from assay.functions.numeric import rnd
    return g.select("model", rnd(F.abs(F.col("mp") - F.col("mn")), 6).alias("discrimination_delta"))


GLOBAL_DELTA_SQL = "WITH " + SCORED_QA_SQL + f"""
SELECT model, round(abs({fixed_mean_sql("CASE WHEN category = 'positivo' THEN token_overlap_f1 END")}
                       - {fixed_mean_sql("CASE WHEN category = 'negativo' THEN token_overlap_f1 END")}), 6)
         AS discrimination_delta
FROM scored GROUP BY model"""


def session_shape_query(spark, sf_dir):
    """B14 + B15 + B18: first attempt of each session, its single-turn flag and empty-output flag."""
    a = attempts(spark, sf_dir)
    n = a.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_attempts"))
    f = first_of_session(a).join(n, "session_id")
    return f.select("session_id", "turn", (F.col("n_attempts") == 1).alias("is_single_turn"),
                    (F.trim(F.col("response")) == "").alias("empty_output"))


SESSION_SHAPE_SQL = "WITH " + ATTEMPTS_SQL + """,
n AS (SELECT session_id, count(*) AS n_attempts FROM attempts GROUP BY session_id)
SELECT a.session_id, a.turn, n.n_attempts = 1 AS is_single_turn, trim(a.response) = '' AS empty_output
FROM attempts a JOIN n USING (session_id) WHERE a.attempt = 0"""


# ---------------------------------------------------------------- gold I/O
def predictions_roundtrip_query(spark, sf_dir):
    """Predictions appended as JSON lines (two runs' files in the
    same folder), read back with the declared schema, joined to silver records."""
    path = md.scratch_path(spark, f"predictions-{uuid.uuid4().hex}")
    preds = predictions(spark, sf_dir)
    runs = preds.select("run_id").distinct()
    first = preds.join(runs.filter(F.col("run_id") < "run-src5"), "run_id", "left_semi")
    rest = preds.join(runs.filter(F.col("run_id") >= "run-src5"), "run_id", "left_semi")
    md.write_predictions(md_full(first), path, "append")
    md.write_predictions(md_full(rest), path, "append")
    back = md.read_predictions(spark, path)
    silver_like = records(spark, sf_dir).select("id", "data_category_QA", "language")
    inf = md.fct_inference_results(silver_like, back)
    return inf.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.sum(F.length("output")).alias("output_chars"))


def md_full(p: DataFrame) -> DataFrame:
    from assay.plans.dashboard_plans import md_typed
    return md_typed(p)


PREDICTIONS_ROUNDTRIP_SQL = "WITH " + PREDS_SQL + """
SELECT run_id, count(*) AS n_rows, CAST(sum(length(prediction)) AS BIGINT) AS output_chars
FROM preds GROUP BY run_id"""


def reference_scores_query(spark, sf_dir):
    """C2 + D6: reference-model scores joined scores x inference on (session, run, attempt),
    model IN-list, completeness gate; (category, metric) value counts."""
    p = md_full(predictions(spark, sf_dir))
    scores = md.fct_evaluation_scores(p)
    inf = md.fct_inference_results(p.select("id", "data_category_QA", "language"), p).select(
        "session_id", "run_id", "attempt", "model")
    j = scores.join(inf, ["session_id", "run_id", "attempt"]).filter(F.col("model").isin("src0", "src2"))
    long = unpivot_metrics(j, ["data_category_QA", "session_id"],
                           ["token_overlap_f1", "question_response_overlap", "response_length_ratio",
                            "refusal_detection", "hedging_detection", "rouge_l"],
                           name_col="metric", drop_nulls=False)
    gated = completeness_gate(long, ["data_category_QA"], name_col="metric")
    return gated.groupBy("data_category_QA", "metric").agg(F.count(F.lit(1)).alias("n_values"))


REFERENCE_SCORES_SQL = "WITH " + PREDS_SQL + """,
j AS (SELECT * FROM preds WHERE model IN ('src0', 'src2')),
long AS (
  SELECT data_category_QA, 'token_overlap_f1' AS metric, CAST(token_overlap_f1 AS DOUBLE) AS value FROM j
  UNION ALL SELECT data_category_QA, 'question_response_overlap', question_response_overlap FROM j
  UNION ALL SELECT data_category_QA, 'response_length_ratio', response_length_ratio FROM j
  UNION ALL SELECT data_category_QA, 'refusal_detection', CAST(coalesce(refusal_detection, false) AS DOUBLE) FROM j
  UNION ALL SELECT data_category_QA, 'hedging_detection', CAST(coalesce(hedging_detection, false) AS DOUBLE) FROM j
  UNION ALL SELECT data_category_QA, 'rouge_l', CAST(NULL AS DOUBLE) FROM j
),
ok AS (SELECT data_category_QA, metric FROM long GROUP BY 1, 2 HAVING count(value) = count(*))
SELECT l.data_category_QA, l.metric, count(*) AS n_values
FROM long l JOIN ok USING (data_category_QA, metric) WHERE l.value IS NOT NULL GROUP BY 1, 2"""


def registry_scores_query(spark, sf_dir):
    """M1-M4: the default deterministic scorer set applied to the dataset records."""
    from assay.functions.registry import DEFAULT_SCORERS, apply_scorers, select_scorers
    r = records(spark, sf_dir)
    s = apply_scorers(r, select_scorers(DEFAULT_SCORERS, deterministic_only=True))
    return s.select("session_id", "token_overlap_f1", "question_response_overlap", "response_length_ratio",
                    "class_exact_match")


def run_metrics_query(spark, sf_dir):
    """D3: flat run metrics per model: ``{scorer}_mean``, ``{scorer}_std``, ``total_scored``
    and the counts and rates of its failure modes."""
    from assay.operators.aggregate import aggregate_scores, failure_mode_rates, flat_run_metrics
    scored = scored_qa(spark, sf_dir)
    long = unpivot_metrics(scored, ["model", "session_id"], QA_METRICS)
    return flat_run_metrics(aggregate_scores(long, ["model"]), ["model"], modes=failure_mode_rates(scored, ["model"]))


REGISTRY_SCORES_SQL = "WITH " + RECORDS_SQL + """,
t AS (SELECT *, """ + _tok_sql("response") + """ AS r_tok, """ + _tok_sql("reference") + """ AS f_tok,
             """ + _tok_sql("question") + """ AS q_tok,
             list_filter(classes, lambda x: x.id = chosen_class_id)[1].class AS class_name FROM records)
SELECT session_id, """ + _f1_sql("r_tok", "f_tok") + """ AS token_overlap_f1,
       """ + _f1_sql("r_tok", "q_tok") + """ AS question_response_overlap,
       """ + _ratio_sql("r_tok", "f_tok") + """ AS response_length_ratio,
       CASE WHEN chosen_class_id IS NULL OR chosen_class_id = '' OR class_name IS NULL THEN NULL
            ELSE contains(lower(response), lower(chosen_class_id))
                 OR (coalesce(class_name, '') <> '' AND contains(lower(response), lower(replace(class_name, '_', ' '))))
       END AS class_exact_match
FROM t"""

RUN_METRICS_SQL = "WITH " + SCORED_QA_SQL + """,
long AS (
  SELECT model, scorer_name, value FROM (
    UNPIVOT (SELECT model, CAST(token_overlap_f1 AS DOUBLE) AS token_overlap_f1,
                    CAST(question_response_overlap AS DOUBLE) AS question_response_overlap,
                    CAST(response_length_ratio AS DOUBLE) AS response_length_ratio,
                    CAST(refusal_detection AS DOUBLE) AS refusal_detection,
                    CAST(hedging_detection AS DOUBLE) AS hedging_detection FROM scored)
    ON token_overlap_f1, question_response_overlap, response_length_ratio, refusal_detection, hedging_detection
    INTO NAME scorer_name VALUE value)
),
agg AS (
  SELECT model, scorer_name, """ + round_even_sql(fixed_mean_sql("value")) + """ AS mean,
         """ + round_even_sql("CASE WHEN count(value) < 2 THEN 0.0 ELSE sqrt(" + _var_sql("value") + ") END") + """ AS std
  FROM long GROUP BY model, scorer_name
)
SELECT model, scorer_name || '_mean' AS metric_key, mean AS metric_value FROM agg
UNION ALL
SELECT model, scorer_name || '_std', std FROM agg
UNION ALL
SELECT model, 'total_scored', CAST(count(*) AS DOUBLE) FROM scored_fm GROUP BY model
UNION ALL
SELECT model, 'failure_mode_' || coalesce(failure_mode, 'unknown') || '_count', CAST(count(*) AS DOUBLE)
FROM scored_fm GROUP BY model, failure_mode
UNION ALL
SELECT model, 'failure_mode_' || coalesce(failure_mode, 'unknown') || '_rate',
       """ + round_even_sql("count(*) / sum(count(*)) OVER (PARTITION BY model)") + """ FROM scored_fm GROUP BY model, failure_mode"""
