"""Plans for the statistical operators (I-family, C6/C7, E5/E6) on the driver tables.

Oracle SQL covers the sufficient statistics (counts, rank sums, tie terms,
z scores, effect sizes); p-values need erfc / incomplete beta, which DuckDB
lacks, so the full test rows are registered without an oracle and the
p-value functions are unit-tested against published values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.numeric import rnd
from assay.operators import stats as st
from assay.sources.tables import read_table
from assay.sources.views import BINARY_SQL, LINES_SQL, SCORES_SQL, binary, lines, scores

# fixed parameters of the registered stats queries
EVENT_REF = "view"
LINE_REF = "N"
ORDER_REF = "2-HIGH"
LINE_METRICS = ["quantity", "discount", "tax"]
G = ["model", "category", "metric"]


def _r6(c):
    return rnd(c, 6)


#: Of so many rows in all, no sum of t^3 - t passes 64 bits.
BIGINT_ROWS = 2_097_151


def _tie_term(rows: DataFrame) -> Column:
    """``tie_term`` as bigint if no group of ``rows`` can pass it, else exact as decimal(38,0).
    The count reads the Parquet footers only."""
    return F.col("tie_term").cast("bigint" if rows.count() <= BIGINT_ROWS else "decimal(38,0)")


# ------------------------------------------------------------------ long inputs
def against(rows: DataFrame, reference: str) -> DataFrame:
    """Every model but the reference as a candidate: its rows, and beside them the
    reference's rows of each category that the model has. Categories are few: a shuffle by
    them would gather the reference's rows in a few tasks, so the names go to the rows."""
    cand = rows.filter(F.col("model") != reference)
    models = cand.select("category", "model").distinct()
    ref = rows.filter(F.col("model") == reference).drop("model").join(F.broadcast(models), "category")
    return cand.withColumn("side", F.lit(st.CAND)).unionByName(ref.withColumn("side", F.lit(st.REF)))


def _against_sql(src: str, reference: str, cols: str) -> str:
    return f"""SELECT model, category, 'candidate' AS side, {cols} FROM {src} WHERE model <> '{reference}'
  UNION ALL
  SELECT m.model, m.category, 'reference' AS side, {cols}
  FROM (SELECT category AS of, {cols} FROM {src} WHERE model = '{reference}') r
  JOIN (SELECT DISTINCT model, category FROM {src} WHERE model <> '{reference}') m ON m.category = r.of"""


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).select("model", "category", "session_id", "value")
    return against(s, EVENT_REF).withColumn("metric", F.lit("event_value"))


EVENTS_LONG_SQL = SCORES_SQL + f""",
ev_long AS (
  SELECT *, 'event_value' AS metric FROM ({_against_sql("scores", EVENT_REF, "session_id, value")})
)"""


def lines_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = against(lines(spark, sf_dir).select("model", "category", "session_id", *LINE_METRICS), LINE_REF)
    return w.unpivot(["model", "category", "side", "session_id"], LINE_METRICS, "metric", "value")


LINES_LONG_SQL = LINES_SQL + f""",
li_long AS (
  SELECT model, category, side, session_id, metric, value FROM (
    UNPIVOT ({_against_sql("lines", LINE_REF, "session_id, " + ", ".join(LINE_METRICS))})
    ON {', '.join(LINE_METRICS)} INTO NAME metric VALUE value)
)"""


def orders_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer and priority: did any order finish (max flag); each priority but the
    reference's is paired with it."""
    b = binary(spark, sf_dir).select("model", F.lit("orders").alias("category"), F.lit("finished").alias("metric"),
                                     F.col("custkey").alias("session_id"), F.col("flag").alias("value"))
    return st.paired(against(b, ORDER_REF), G)


ORDERS_PAIRED_SQL = BINARY_SQL + f""",
per_cust AS (SELECT custkey, model, max(flag) AS flag FROM binary_v GROUP BY custkey, model),
o_pairs AS (
  SELECT c.model, 'orders' AS category, 'finished' AS metric, c.custkey AS session_id, c.flag AS cand, r.flag AS ref
  FROM per_cust c JOIN per_cust r ON r.custkey = c.custkey AND r.model = '{ORDER_REF}' AND c.model <> '{ORDER_REF}'
  WHERE c.flag IS NOT NULL AND r.flag IS NOT NULL
)"""


def orders_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binary(spark, sf_dir).select("model", F.lit("orders").alias("category"), F.lit("finished").alias("metric"),
                                     "session_id", F.col("flag").alias("value"))
    return against(b, ORDER_REF)


# ------------------------------------------------------------------- queries
def wilcoxon_stats_query(spark, sf_dir):
    """I5 + C6: signed-rank sufficient statistics and Cohen's d (paired events)."""
    pairs = st.paired(events_long(spark, sf_dir), G)
    t = st.wilcoxon(pairs, G)
    s = st.wilcoxon_stats(pairs, G)
    return t.join(s, G, "left").select(
        *G, "sample_size_candidate", "n_nonzero", _r6("w_plus").alias("w_plus"), _r6("w_minus").alias("w_minus"),
        _r6("statistic").alias("statistic"), _tie_term(read_table(spark, sf_dir, "events")).alias("tie_term"), _r6("z").alias("z"),
        _r6("effect_size").alias("effect_size"), _r6("candidate_value").alias("candidate_value"),
        _r6("threshold_value").alias("threshold_value"))


def _midrank_sql(src: str, part: str, key: str) -> str:
    return (f"coalesce(sum(t) OVER (PARTITION BY {part} ORDER BY {key} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0")


_COHEN_SQL = """CASE WHEN {n1} < 2 OR {n2} < 2 THEN 0.0 ELSE ({m1} - {m2}) / (CASE WHEN
   (({n1} - 1) * {v1} + ({n2} - 1) * {v2}) / ({n1} + {n2} - 2) > 0 THEN
   sqrt((({n1} - 1) * {v1} + ({n2} - 1) * {v2}) / ({n1} + {n2} - 2)) ELSE 1e-12 END) END"""

WILCOXON_STATS_SQL = "WITH " + EVENTS_LONG_SQL + """,
pairs AS (
  SELECT c.model, c.category, c.metric, c.session_id, c.value AS cand, r.value AS ref
  FROM ev_long c JOIN ev_long r ON c.model = r.model AND c.category = r.category AND c.metric = r.metric
   AND c.session_id = r.session_id AND c.side = 'candidate' AND r.side = 'reference'
),
base AS (
  SELECT model, category, metric, count(*) AS n, avg(cand) AS m1, var_samp(cand) AS v1,
         avg(ref) AS m2, var_samp(ref) AS v2 FROM pairs GROUP BY model, category, metric
),
d AS (SELECT model, category, metric, cand - ref AS d FROM pairs WHERE cand - ref <> 0),
hist AS (
  SELECT model, category, metric, abs(d) AS absd, count(*) FILTER (WHERE d > 0) AS pos,
         count(*) FILTER (WHERE d < 0) AS neg, count(*) AS t
  FROM d GROUP BY model, category, metric, abs(d)
),
ranked AS (SELECT *, """ + _midrank_sql("hist", "model, category, metric", "absd") + """ AS midrank FROM hist),
g AS (
  SELECT model, category, metric, sum(t) AS n_nonzero, sum(pos * midrank) AS w_plus, sum(neg * midrank) AS w_minus,
         sum(t * t * t - t) AS tie_term FROM ranked GROUP BY model, category, metric
)
SELECT b.model, b.category, b.metric, b.n AS sample_size_candidate, CAST(g.n_nonzero AS BIGINT) AS n_nonzero,
       round(g.w_plus, 6) AS w_plus, round(g.w_minus, 6) AS w_minus,
       round(coalesce(least(g.w_plus, g.w_minus), 0.0), 6) AS statistic, CAST(g.tie_term AS BIGINT) AS tie_term,
       round((least(g.w_plus, g.w_minus) - g.n_nonzero * (g.n_nonzero + 1) / 4.0)
             / sqrt(g.n_nonzero * (g.n_nonzero + 1) * (2 * g.n_nonzero + 1) / 24.0 - g.tie_term / 48.0), 6) AS z,
       round(""" + _COHEN_SQL.format(n1="b.n", n2="b.n", m1="b.m1", m2="b.m2", v1="b.v1", v2="b.v2") + """, 6)
         AS effect_size,
       round(b.m1, 6) AS candidate_value, round(b.m2, 6) AS threshold_value
FROM base b LEFT JOIN g ON g.model = b.model AND g.category = b.category AND g.metric = b.metric"""


def wilcoxon_test_query(spark, sf_dir):
    """I5 full test rows (p-value from the exact/normal null)."""
    return st.wilcoxon(st.paired(events_long(spark, sf_dir), G), G)


def mannwhitney_stats_query(spark, sf_dir):
    """Rank-sum statistics and Cohen's d per (category, metric) of lineitem."""
    long = lines_long(spark, sf_dir)
    s = st.mann_whitney_stats(long, G)
    t = st.mann_whitney(long, G)
    return s.join(t.select(*G, "effect_size", "candidate_value", "threshold_value"), G).select(
        *G, "n1", "n2", _r6("u_statistic").alias("u_statistic"), _tie_term(read_table(spark, sf_dir, "lineitem")).alias("tie_term"),
        "has_ties", _r6("z").alias("z"), _r6("effect_size").alias("effect_size"),
        _r6("candidate_value").alias("candidate_value"), _r6("threshold_value").alias("threshold_value"))


MANNWHITNEY_STATS_SQL = "WITH " + LINES_LONG_SQL + """,
hist AS (
  SELECT model, category, metric, value, count(*) FILTER (WHERE side = 'candidate') AS c1,
         count(*) FILTER (WHERE side = 'reference') AS c2, count(*) AS t
  FROM li_long GROUP BY model, category, metric, value
),
ranked AS (SELECT *, """ + _midrank_sql("hist", "model, category, metric", "value") + """ AS midrank FROM hist),
g AS (
  SELECT model, category, metric, CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(c2) AS BIGINT) AS n2,
         sum(c1 * midrank) AS r1, sum(t * t * t - t) AS tie_term, max(t) > 1 AS has_ties
  FROM ranked GROUP BY model, category, metric
),
mo AS (
  SELECT model, category, metric,
         avg(value) FILTER (WHERE side = 'candidate') AS m1, var_samp(value) FILTER (WHERE side = 'candidate') AS v1,
         avg(value) FILTER (WHERE side = 'reference') AS m2, var_samp(value) FILTER (WHERE side = 'reference') AS v2
  FROM li_long GROUP BY model, category, metric
),
u AS (
  SELECT g.*, mo.m1, mo.v1, mo.m2, mo.v2, g.r1 - g.n1 * (g.n1 + 1) / 2.0 AS u1,
         sqrt(g.n1 * g.n2 / 12.0 * ((g.n1 + g.n2 + 1) - g.tie_term / ((g.n1 + g.n2) * (g.n1 + g.n2 - 1.0)))) AS sigma
  FROM g JOIN mo USING (model, category, metric)
)
SELECT model, category, metric, n1, n2, round(u1, 6) AS u_statistic, CAST(tie_term AS BIGINT) AS tie_term, has_ties,
       round((abs(u1 - n1 * n2 / 2.0) - 0.5) / sigma, 6) AS z,
       round(""" + _COHEN_SQL.format(n1="n1", n2="n2", m1="m1", m2="m2", v1="v1", v2="v2") + """, 6) AS effect_size,
       round(m1, 6) AS candidate_value, round(m2, 6) AS threshold_value
FROM u"""


def mannwhitney_test_query(spark, sf_dir):
    """I6 full test rows."""
    return st.mann_whitney(lines_long(spark, sf_dir), G)


def mcnemar_query(spark, sf_dir):
    """I4: paired binary counts, statistic and odds ratio (p-value in ``mcnemar_test``)."""
    t = st.mcnemar(orders_paired(spark, sf_dir), G)
    return t.select(*G, "a", "b", "c", "d", _r6("statistic").alias("statistic"),
                    _r6("effect_size").alias("effect_size"), _r6("candidate_value").alias("candidate_value"),
                    _r6("threshold_value").alias("threshold_value"), "sample_size_candidate")


MCNEMAR_SQL = "WITH " + ORDERS_PAIRED_SQL + """,
k AS (
  SELECT model, category, metric,
         count(*) FILTER (WHERE cand = 1 AND ref = 1) AS a, count(*) FILTER (WHERE cand = 1 AND ref <> 1) AS b,
         count(*) FILTER (WHERE cand <> 1 AND ref = 1) AS c, count(*) FILTER (WHERE cand <> 1 AND ref <> 1) AS d,
         avg(cand) AS cv, avg(ref) AS tv, count(*) AS n
  FROM o_pairs GROUP BY model, category, metric
)
SELECT model, category, metric, a, b, c, d,
       round(CASE WHEN b + c < 25 THEN least(b, c) ELSE (abs(b - c) - 1.0) ^ 2 / (b + c) END, 6) AS statistic,
       round(CASE WHEN b = 0 OR c = 0 THEN (b + 0.5) / (c + 0.5) ELSE b / c END, 6) AS effect_size,
       round(cv, 6) AS candidate_value, round(tv, 6) AS threshold_value, n AS sample_size_candidate
FROM k"""


def mcnemar_test_query(spark, sf_dir):
    return st.mcnemar(orders_paired(spark, sf_dir), G)


def chi2_query(spark, sf_dir):
    """Unpaired 2x2 counts, Yates statistic and the two odds ratios."""
    t = st.chi2(orders_long(spark, sf_dir), G)
    return t.select(*G, _r6("statistic").alias("statistic"), _r6("effect_size").alias("effect_size"),
                    _r6("odds_ratio_adbc").alias("odds_ratio_adbc"), _r6("candidate_value").alias("candidate_value"),
                    _r6("threshold_value").alias("threshold_value"), "sample_size_candidate",
                    "sample_size_reference", "degenerate")


CHI2_SQL = "WITH " + BINARY_SQL + f""",
k AS (
  SELECT c.model, 'orders' AS category, 'finished' AS metric, c.cp, c.cn, r.rp, r.rn
  FROM (SELECT model, CAST(count(*) FILTER (WHERE flag = 1) AS DOUBLE) AS cp,
               CAST(count(*) FILTER (WHERE flag <> 1) AS DOUBLE) AS cn
        FROM binary_v WHERE model <> '{ORDER_REF}' GROUP BY model) c,
       (SELECT CAST(count(*) FILTER (WHERE flag = 1) AS DOUBLE) AS rp,
               CAST(count(*) FILTER (WHERE flag <> 1) AS DOUBLE) AS rn
        FROM binary_v WHERE model = '{ORDER_REF}') r
),
e AS (
  SELECT *, cp + cn + rp + rn AS n,
         (cp + cn) * (cp + rp) / (cp + cn + rp + rn) AS e_cp, (cp + cn) * (cn + rn) / (cp + cn + rp + rn) AS e_cn,
         (rp + rn) * (cp + rp) / (cp + cn + rp + rn) AS e_rp, (rp + rn) * (cn + rn) / (cp + cn + rp + rn) AS e_rn
  FROM k
)
SELECT model, category, metric,
  round((abs(cp - e_cp) - least(0.5, abs(cp - e_cp))) ^ 2 / e_cp + (abs(cn - e_cn) - least(0.5, abs(cn - e_cn))) ^ 2 / e_cn
      + (abs(rp - e_rp) - least(0.5, abs(rp - e_rp))) ^ 2 / e_rp + (abs(rn - e_rn) - least(0.5, abs(rn - e_rn))) ^ 2 / e_rn, 6)
    AS statistic,
  round(CASE WHEN cn = 0 OR rp = 0 THEN (cn + 0.5) / (rp + 0.5) ELSE cn / rp END, 6) AS effect_size,
  round(CASE WHEN cp * rn = 0 OR cn * rp = 0 THEN (cp * rn + 0.5) / (cn * rp + 0.5) ELSE (cp * rn) / (cn * rp) END, 6)
    AS odds_ratio_adbc,
  round(cp / (cp + cn), 6) AS candidate_value, round(rp / (rp + rn), 6) AS threshold_value,
  CAST(cp + cn AS BIGINT) AS sample_size_candidate, CAST(rp + rn AS BIGINT) AS sample_size_reference,
  false AS degenerate
FROM e"""


def chi2_test_query(spark, sf_dir):
    return st.chi2(orders_long(spark, sf_dir), G)


def pairing_query(spark, sf_dir):
    """Share of candidate ids also present in the reference, per model and category."""
    from assay.operators.tests_routing import detect_pairing
    long = lines_long(spark, sf_dir).filter(F.col("metric") == "quantity")
    cand = long.filter(F.col("side") == st.CAND).select("model", "category", "session_id")
    ref = long.filter(F.col("side") == st.REF).select("model", "category", "session_id")
    p = detect_pairing(cand, ref, ["model", "category"])
    return p.select("model", "category", "n_candidate", "n_common", _r6("overlap_ratio").alias("overlap_ratio"), "is_paired")


PAIRING_SQL = "WITH " + LINES_LONG_SQL + """,
c AS (SELECT DISTINCT model, category, session_id FROM li_long WHERE metric = 'quantity' AND side = 'candidate'),
r AS (SELECT DISTINCT model, category, session_id FROM li_long WHERE metric = 'quantity' AND side = 'reference'),
j AS (
  SELECT c.model, c.category, count(*) AS n_candidate, count(r.session_id) AS n_common
  FROM c LEFT JOIN r ON r.model = c.model AND r.category = c.category AND r.session_id = c.session_id
  GROUP BY c.model, c.category
)
SELECT model, category, n_candidate, n_common, round(n_common / n_candidate, 6) AS overlap_ratio,
       n_common / n_candidate >= 0.8 AS is_paired
FROM j"""


def bh_query(spark, sf_dir):
    """BH adjustment per model family over data-derived p-like values."""
    s = scores(spark, sf_dir).select("model", "session_id",
                                     F.least(F.lit(1.0), F.col("value") / 100.0).alias("p_value"))
    r = st.bh_adjust(s, ["model"], alpha=0.05)
    return r.select("model", "session_id", _r6("p_value").alias("p_value"),
                    _r6("p_value_adjusted").alias("p_value_adjusted"), "reject_null")


BH_SQL = "WITH " + SCORES_SQL + """,
p AS (SELECT model, session_id, least(1.0, value / 100.0) AS p_value FROM scores),
r AS (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY p_value) AS rk, count(*) OVER (PARTITION BY model) AS m
  FROM p
),
a AS (
  SELECT *, least(1.0, min(p_value * m / rk) OVER (PARTITION BY model ORDER BY rk DESC
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adj
  FROM r
)
SELECT model, session_id, round(p_value, 6) AS p_value, round(adj, 6) AS p_value_adjusted, adj <= 0.05 AS reject_null
FROM a"""


def welch_query(spark, sf_dir):
    """I16 statistics (t, df) for every lineitem metric and category, each return flag against N."""
    w = st.welch(lines_long(spark, sf_dir), G)
    return w.select(*G, "n1", "n2", _r6("m1").alias("mean_a"), _r6("m2").alias("mean_b"),
                    _r6("t_statistic").alias("t_statistic"), _r6("df").alias("df"))


WELCH_SQL = "WITH " + LINES_LONG_SQL + """,
m AS (
  SELECT model, category, metric,
         count(value) FILTER (WHERE side = 'candidate') AS n1, avg(value) FILTER (WHERE side = 'candidate') AS m1,
         var_samp(value) FILTER (WHERE side = 'candidate') AS v1,
         count(value) FILTER (WHERE side = 'reference') AS n2, avg(value) FILTER (WHERE side = 'reference') AS m2,
         var_samp(value) FILTER (WHERE side = 'reference') AS v2
  FROM li_long GROUP BY model, category, metric
)
SELECT model, category, metric, n1, n2, round(m1, 6) AS mean_a, round(m2, 6) AS mean_b,
       round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t_statistic,
       round((v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)), 6) AS df
FROM m"""


def welch_test_query(spark, sf_dir):
    return st.welch(lines_long(spark, sf_dir), G)
