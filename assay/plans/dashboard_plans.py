"""Medallion, gold and dashboard plans over the driver tables.

raw      documents as the bronze dataset: id=doc_id, question = whole text in one
         line, content = whole text, data_category_QA = lang
preds    scored ``qa`` responses as prediction rows (one attempt per session)
dash     gold scores LEFT JOIN gold inference on (session_id, run_id, attempt),
         with language labels, text lengths and model_label (C3, A11, B5-B7)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import analysis as an
from assay.plans.qa_plans import SCORED_QA_SQL, scored_qa
from assay.sources import medallion as md
from assay.sources.tables import read_table

# fixed parameters of the registered dashboard queries
RUN_TS = "2024-01-01T00:00:00+00:00"
LANG_CODES = {"en": 1, "es": 2, "pt": 3}
DASH_METRICS = an.BOOL_COLS + an.FLOAT_COLS
MODEL_A, MODEL_B = "src0", "src1"
SAMPLE_FRACTION, SAMPLE_SEED = 0.1, 42
VALID_LANGS = ("en", "es", "fr", "de")


def raw_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"),
                    F.replace("text", F.lit("\n"), F.lit(" ")).alias("question"),
                    F.col("lang").alias("data_category_QA"), F.col("source").alias("name"))


RAW_SQL = """raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, text AS content,
         replace(text, chr(10), ' ') AS question,
         lang AS data_category_QA, source AS name
  FROM documents
)"""


def silver_query(spark, sf_dir):
    """A2 + B1 + B2: projected, valid, whitelisted records."""
    s = md.category_filter(md.silver(raw_dataset(spark, sf_dir)), VALID_LANGS)
    return s.select("id", "data_category_QA", F.length("question").alias("question_len"),
                    F.length("content").alias("content_len"))


SILVER_SQL = "WITH " + RAW_SQL + f"""
SELECT id, data_category_QA, length(question) AS question_len, length(content) AS content_len
FROM raw WHERE question IS NOT NULL AND question <> '' AND content IS NOT NULL
  AND data_category_QA IN {tuple(VALID_LANGS)}"""


def weighted_sample_query(spark, sf_dir):
    """F1 + E2: weighted sample of the silver records (ids only)."""
    s = md.silver(raw_dataset(spark, sf_dir)).select("id", "data_category_QA")  # no texts in the ranking
    return md.weighted_sample(s, SAMPLE_FRACTION, SAMPLE_SEED)


WEIGHTED_SAMPLE_SQL = "WITH " + RAW_SQL + f""",
s AS (SELECT * FROM raw WHERE question IS NOT NULL AND question <> '' AND content IS NOT NULL),
c AS (SELECT data_category_QA, count(*) AS n FROM s GROUP BY data_category_QA),
k AS (
  SELECT s.id, s.data_category_QA,
         ln((CAST(('0x' || substr(md5(s.id || ':{SAMPLE_SEED}'), 1, 13)) AS BIGINT) + 0.5) / {float(16 ** 13)})
           / (1.0 / c.n) AS key
  FROM s JOIN c USING (data_category_QA)
)
SELECT id, data_category_QA FROM k
ORDER BY key DESC, id ASC
LIMIT (SELECT CAST(floor(count(*) * {SAMPLE_FRACTION}) AS BIGINT) FROM s)"""


def sample_report_query(spark, sf_dir):
    """Per category counts before and after sampling."""
    s = md.silver(raw_dataset(spark, sf_dir)).select("id", "data_category_QA")
    return md.sample_report(s, md.weighted_sample(s, SAMPLE_FRACTION, SAMPLE_SEED))


SAMPLE_REPORT_SQL = "WITH " + RAW_SQL + f""",
s AS (SELECT * FROM raw WHERE question IS NOT NULL AND question <> '' AND content IS NOT NULL),
c AS (SELECT data_category_QA, count(*) AS n FROM s GROUP BY data_category_QA),
k AS (
  SELECT s.id, s.data_category_QA,
         ln((CAST(('0x' || substr(md5(s.id || ':{SAMPLE_SEED}'), 1, 13)) AS BIGINT) + 0.5) / {float(16 ** 13)})
           / (1.0 / c.n) AS key
  FROM s JOIN c USING (data_category_QA)
),
smp AS (
  SELECT id, data_category_QA FROM k ORDER BY key DESC, id ASC
  LIMIT (SELECT CAST(floor(count(*) * {SAMPLE_FRACTION}) AS BIGINT) FROM s)
)
SELECT c.data_category_QA, c.n AS n_before, coalesce(a.n_after, 0) AS n_after
FROM c LEFT JOIN (SELECT data_category_QA, count(*) AS n_after FROM smp GROUP BY 1) a USING (data_category_QA)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored qa responses as prediction rows (A5 layout)."""
    s = scored_qa(spark, sf_dir)
    code = F.create_map(*[x for k, v in LANG_CODES.items() for x in (F.lit(k), F.lit(v))])
    return s.select(
        F.col("session_id").cast("string").alias("id"), F.concat(F.lit("run-"), "model").alias("run_id"),
        F.lit(0).alias("attempt"), F.lit(RUN_TS).alias("timestamp"), "question",
        F.col("response").alias("prediction"), F.col("category").alias("data_category_QA"),
        F.coalesce(F.try_element_at(code, F.col("language")), F.lit(0)).cast("long").alias("language"),
        "model", "token_overlap_f1", "question_response_overlap", "response_length_ratio",
        "refusal_detection", "hedging_detection", "failure_mode")


PREDS_SQL = SCORED_QA_SQL + f""",
preds AS (
  SELECT CAST(session_id AS VARCHAR) AS id, 'run-' || model AS run_id, 0 AS attempt, '{RUN_TS}' AS timestamp,
         question, response AS prediction, category AS data_category_QA,
         CAST(CASE language WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'pt' THEN 3 ELSE 0 END AS BIGINT) AS language,
         model, token_overlap_f1, question_response_overlap, response_length_ratio, refusal_detection,
         hedging_detection, failure_mode
  FROM scored_fm
)"""


def dash_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 — gold scores LEFT JOIN gold inference, plus A11/B5-B7 derived columns."""
    p = predictions(spark, sf_dir)
    silver_like = p.select("id", "data_category_QA", "language")
    inf = md.fct_inference_results(silver_like, p)
    scores = md.fct_evaluation_scores(md_typed(p))
    scores = scores.withColumns({c: F.col(c).cast("double") for c in an.BOOL_COLS})
    scores = scores.withColumn("language_label", an.language_label("language"))
    inf = inf.select("session_id", "run_id", "attempt", "input", "output", "model",
                     F.length(F.coalesce("input", F.lit(""))).alias("input_len"),
                     F.length(F.coalesce("output", F.lit(""))).alias("output_len"))
    m = scores.join(inf, ["session_id", "run_id", "attempt"], "left")
    return m.withColumn("model_label", F.coalesce("model", "run_id"))


def md_typed(p: DataFrame) -> DataFrame:
    """Predictions with the full declared column set (missing metrics as NULL)."""
    return p.select(*[F.col(f.name).cast(f.dataType) if f.name in p.columns
                      else F.lit(None).cast(f.dataType).alias(f.name) for f in md.PREDICTION_SCHEMA.fields])


DASH_SQL = PREDS_SQL + """,
dash AS (
  SELECT p.id AS session_id, p.run_id, p.attempt, p.data_category_QA, p.language,
         0.0 AS correctness, 0.0 AS guidelines, CAST(NULL AS DOUBLE) AS class_exact_match,
         CAST(coalesce(p.refusal_detection, false) AS DOUBLE) AS refusal_detection,
         0.0 AS pass_at_k, CAST(coalesce(p.hedging_detection, false) AS DOUBLE) AS hedging_detection,
         p.token_overlap_f1, p.question_response_overlap, p.response_length_ratio,
         p.failure_mode,
         CASE p.language WHEN 1 THEN 'English' WHEN 2 THEN 'Spanish' WHEN 3 THEN 'Portuguese' ELSE 'Unknown' END
           AS language_label,
         p.question AS input, p.prediction AS output, p.model,
         length(coalesce(p.question, '')) AS input_len, length(coalesce(p.prediction, '')) AS output_len,
         coalesce(p.model, p.run_id) AS model_label
  FROM preds p
)"""
# In gold, class_exact_match N/A becomes false (Q5): coalesce(try_cast(NULL), false) -> 0.0
DASH_SQL = DASH_SQL.replace("CAST(NULL AS DOUBLE) AS class_exact_match", "0.0 AS class_exact_match")

STAT_METRICS = ["token_overlap_f1", "question_response_overlap", "response_length_ratio", "refusal_detection",
                "hedging_detection"]


def _r6(c):
    from assay.functions.numeric import rnd
    return rnd(c, 6)


def descriptive_stats_query(spark, sf_dir):
    """11 statistics per (model, metric)."""
    long = an.melt(dash_frame(spark, sf_dir), ["model_label"], STAT_METRICS)
    d = an.descriptive_stats(long, ["model_label", "metric"])
    return d.select("model_label", "metric", *[_r6(c).alias(c) for c in
                                               ("mean", "std", "variance", "cv", "q1", "q2", "q3", "iqr", "min", "max")],
                    "count")


def _melt_sql(src: str, ids: str, metrics: list[str], include_nulls: bool = False) -> str:
    casts = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in metrics)
    inc = " INCLUDE NULLS" if include_nulls else ""
    return (f"(SELECT {ids + ', ' if ids else ''}metric, value FROM (UNPIVOT{inc} (SELECT {ids + ', ' if ids else ''}{casts} "
            f"FROM {src}) ON {', '.join(metrics)} INTO NAME metric VALUE value))")


DESCRIPTIVE_STATS_SQL = "WITH " + DASH_SQL + f""",
long AS {_melt_sql('dash', 'model_label', STAT_METRICS)}
SELECT model_label, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(var_samp(value), 6) AS variance,
       round(CASE WHEN stddev_samp(value) IS NULL OR avg(value) = 0 THEN NULL ELSE stddev_samp(value) / avg(value) END, 6) AS cv,
       round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2,
       round(quantile_cont(value, 0.75), 6) AS q3,
       round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr,
       round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS count
FROM long WHERE value IS NOT NULL GROUP BY model_label, metric"""


def zscore_query(spark, sf_dir):
    """Z-score of every response's metric value within its model."""
    long = an.melt(dash_frame(spark, sf_dir), ["model_label", "session_id"], STAT_METRICS)
    z = an.z_scores(long, ["model_label", "metric"])
    return z.select("model_label", "session_id", "metric", _r6("z_score").alias("z_score"))


ZSCORE_SQL = "WITH " + DASH_SQL + f""",
long AS ({' UNION ALL '.join(f"SELECT model_label, session_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM dash" for m in STAT_METRICS)}),
m AS (SELECT model_label, metric, avg(value) AS mu, stddev_samp(value) AS s, count(value) AS n
      FROM long GROUP BY model_label, metric)
SELECT l.model_label, l.session_id, l.metric,
       round(CASE WHEN m.n < 2 OR m.s = 0 OR m.s IS NULL THEN NULL ELSE (l.value - m.mu) / m.s END, 6) AS z_score
FROM long l JOIN m ON m.model_label = l.model_label AND m.metric = l.metric"""


def kpi_query(spark, sf_dir):
    """Overall mean and sample std per metric."""
    k = an.kpi_cards(dash_frame(spark, sf_dir), DASH_METRICS)
    return k.select("metric", _r6("mean").alias("mean"), _r6("std").alias("std"))


_DASH_PRESENT = ["correctness", "guidelines", "class_exact_match", "refusal_detection", "pass_at_k",
                 "hedging_detection", "token_overlap_f1", "question_response_overlap", "response_length_ratio"]

KPI_SQL = "WITH " + DASH_SQL + f""",
long AS {_melt_sql('dash', '', _DASH_PRESENT)}
SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
FROM long GROUP BY metric"""


def radar_query(spark, sf_dir):
    """Mean per metric per model."""
    r = an.radar_profile(dash_frame(spark, sf_dir), DASH_METRICS, "model_label")
    return r.select("model_label", "metric", _r6("mean").alias("mean"))


RADAR_SQL = "WITH " + DASH_SQL + f""",
long AS {_melt_sql('dash', 'model_label', _DASH_PRESENT)}
SELECT model_label, metric, round(avg(value), 6) AS mean FROM long GROUP BY model_label, metric"""


def failure_bars_query(spark, sf_dir):
    """Failure-mode counts per model."""
    return an.failure_mode_counts(dash_frame(spark, sf_dir), "model_label")


FAILURE_BARS_SQL = "WITH " + DASH_SQL + """
SELECT model_label, coalesce(failure_mode, 'none') AS failure_mode, count(*) AS count
FROM dash GROUP BY model_label, coalesce(failure_mode, 'none')"""


def sankey_query(spark, sf_dir):
    """Flow edges category -> refusal -> failure mode."""
    return an.sankey_edges(dash_frame(spark, sf_dir))


SANKEY_SQL = "WITH " + DASH_SQL + """,
t AS (SELECT data_category_QA AS category,
             CASE WHEN coalesce(refusal_detection, 0.0) = 1.0 THEN 'refused' ELSE 'not_refused' END AS refusal_label,
             coalesce(failure_mode, 'none') AS failure_mode FROM dash)
SELECT category AS source, refusal_label AS target, count(*) AS value, 1 AS level FROM t GROUP BY 1, 2
UNION ALL
SELECT refusal_label AS source, failure_mode AS target, count(*) AS value, 2 AS level FROM t GROUP BY 1, 2"""


def sankey_nodes_query(spark, sf_dir):
    """The flow's numbered nodes."""
    return an.sankey_nodes(dash_frame(spark, sf_dir))


SANKEY_NODES_SQL = "WITH " + DASH_SQL + """,
labels AS (
  SELECT DISTINCT 1 AS layer, data_category_QA AS label FROM dash
  UNION SELECT 2, CASE WHEN coalesce(refusal_detection, 0.0) = 1.0 THEN 'refused' ELSE 'not_refused' END FROM dash
  UNION SELECT 3, coalesce(failure_mode, 'none') FROM dash
)
SELECT layer, label, row_number() OVER (ORDER BY layer, label NULLS FIRST) - 1 AS node FROM labels"""


def complexity_query(spark, sf_dir):
    """Mean score per model and equal-width input-length bin."""
    c = an.complexity_bins(dash_frame(spark, sf_dir), STAT_METRICS, "model_label")
    return c.select("model_label", "complexity_bin", "metric", _r6("mean").alias("mean"))


COMPLEXITY_SQL = "WITH " + DASH_SQL + f""",
mm AS (SELECT CAST(min(input_len) AS DOUBLE) AS lo, CAST(max(input_len) AS DOUBLE) AS hi FROM dash),
b AS (
  SELECT d.*, CAST(CASE WHEN mm.hi = mm.lo THEN 3
                   ELSE greatest(1, CAST(ceil((input_len - mm.lo) / (mm.hi - mm.lo) * 5) AS INTEGER)) END AS INTEGER)
                AS complexity_bin
  FROM dash d, mm
),
long AS {_melt_sql('b', 'model_label, complexity_bin', STAT_METRICS)}
SELECT model_label, complexity_bin, metric, round(avg(value), 6) AS mean
FROM long GROUP BY model_label, complexity_bin, metric HAVING avg(value) IS NOT NULL"""


FILTERS = dict(models=[], categories=["positivo"], languages=["English", "Unknown"], failure_modes=[],
               score_ranges={"token_overlap_f1": (0.1, 0.9)})


def filtered_query(spark, sf_dir):
    """B8 + D19: filter summary after a category/language/range filter."""
    d = dash_frame(spark, sf_dir)
    f = an.apply_filters(d, **FILTERS)
    return an.filter_summary(d, f)


FILTERED_SQL = "WITH " + DASH_SQL + """,
f AS (SELECT * FROM dash WHERE data_category_QA IN ('positivo') AND language_label IN ('English', 'Unknown')
      AND (token_overlap_f1 IS NULL OR token_overlap_f1 BETWEEN 0.1 AND 0.9))
SELECT (SELECT count(*) FROM f) AS filtered_rows, (SELECT count(DISTINCT model_label) FROM f) AS n_models,
       (SELECT count(*) FROM dash) AS total_rows"""


def filter_options_query(spark, sf_dir):
    """Sorted distinct values per filter dimension."""
    return an.filter_options(dash_frame(spark, sf_dir), {
        "models": "model_label", "categories": "data_category_QA", "languages": "language_label",
        "failure_modes": "failure_mode"})


FILTER_OPTIONS_SQL = "WITH " + DASH_SQL + """
SELECT DISTINCT 'models' AS dimension, model_label AS value FROM dash WHERE model_label IS NOT NULL
UNION SELECT DISTINCT 'categories', data_category_QA FROM dash WHERE data_category_QA IS NOT NULL
UNION SELECT DISTINCT 'languages', language_label FROM dash WHERE language_label IS NOT NULL
UNION SELECT DISTINCT 'failure_modes', failure_mode FROM dash WHERE failure_mode IS NOT NULL"""


def metric_ranges_query(spark, sf_dir):
    """B10 + B11: slider ranges of the metrics that vary and have values."""
    r = an.metric_ranges(dash_frame(spark, sf_dir), an.FLOAT_COLS)
    return r.select("metric", _r6("min_value").alias("min_value"), _r6("max_value").alias("max_value"))


_FLOATS_PRESENT = ["token_overlap_f1", "question_response_overlap", "response_length_ratio"]

METRIC_RANGES_SQL = "WITH " + DASH_SQL + f""",
long AS {_melt_sql('dash', '', _FLOATS_PRESENT)},
r AS (SELECT metric, coalesce(min(value), 0.0) AS lo, coalesce(max(value), 1.0) AS hi FROM long GROUP BY metric)
SELECT metric, round(lo, 6) AS min_value, round(hi, 6) AS max_value FROM r WHERE lo <> hi
UNION ALL
SELECT metric, 0.0, 1.0 FROM (VALUES ('groundedness'), ('pass_at_k_best_score'), ('rouge_l'), ('chunk_attribution'),
  ('self_consistency'), ('self_consistency_variance')) t(metric)"""


def low_sample_query(spark, sf_dir):
    """Models with fewer than 2 rows after the category filter."""
    d = an.apply_filters(dash_frame(spark, sf_dir), categories=["negativo"])
    return an.low_sample_groups(d, "model_label", 2)


LOW_SAMPLE_SQL = "WITH " + DASH_SQL + """
SELECT model_label, count(*) AS n_rows FROM dash WHERE data_category_QA IN ('negativo')
GROUP BY model_label HAVING count(*) < 2"""


def comparison_query(spark, sf_dir):
    """Comparison table of two models over every metric (Welch p-value)."""
    return an.comparison_table(dash_frame(spark, sf_dir), STAT_METRICS, MODEL_A, MODEL_B)


_STATS = ("mean", "std", "variance", "cv", "q1", "q2", "q3", "iqr", "min", "max")


def comparison_stats_query(spark, sf_dir):
    """The descriptive statistics of two models side by side, with deltas."""
    c = an.comparison_stats(dash_frame(spark, sf_dir), STAT_METRICS, MODEL_A, MODEL_B)
    return c.select("metric", "a_count", "b_count", *[_r6(f"{s}_{x}").alias(f"{s}_{x}") for s in "ab" for x in _STATS],
                    _r6("delta").alias("delta"), _r6("relative_delta_pct").alias("relative_delta_pct"))


def _side_sql(side: str) -> str:
    v = f"CASE WHEN model_label = '{MODEL_A if side == 'a' else MODEL_B}' THEN value END"
    exprs = {"mean": f"avg({v})", "std": f"stddev_samp({v})", "variance": f"var_samp({v})",
             "cv": f"CASE WHEN avg({v}) <> 0 THEN stddev_samp({v}) / avg({v}) END",
             "q1": f"quantile_cont({v}, 0.25)", "q2": f"quantile_cont({v}, 0.5)", "q3": f"quantile_cont({v}, 0.75)",
             "iqr": f"quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)", "min": f"min({v})", "max": f"max({v})"}
    return f"count({v}) AS {side}_count, " + ", ".join(f"round({e}, 6) AS {side}_{n}" for n, e in exprs.items())


_MEAN_A, _MEAN_B = (f"avg(CASE WHEN model_label = '{m}' THEN value END)" for m in (MODEL_A, MODEL_B))
COMPARISON_STATS_SQL = "WITH " + DASH_SQL + f""",
long AS {_melt_sql('dash', 'model_label', STAT_METRICS)}
SELECT metric, {_side_sql('a')}, {_side_sql('b')}, round({_MEAN_A} - {_MEAN_B}, 6) AS delta,
       round(CASE WHEN {_MEAN_B} <> 0 THEN ({_MEAN_A} - {_MEAN_B}) / {_MEAN_B} * 100 END, 6) AS relative_delta_pct
FROM long WHERE value IS NOT NULL AND model_label IN ('{MODEL_A}', '{MODEL_B}') GROUP BY metric"""


def scatter_query(spark, sf_dir):
    """Cost-vs-metric scatter projection with hover columns."""
    d = dash_frame(spark, sf_dir)
    return d.select("session_id", "model_label", "output_len", "token_overlap_f1", "failure_mode", "language_label")


SCATTER_SQL = "WITH " + DASH_SQL + """
SELECT session_id, model_label, output_len, token_overlap_f1, failure_mode, language_label FROM dash"""
