"""Evaluation views derived from the driver tables.

Each view is a lazy DataFrame built with joins/windows on the given tables, so
its work grows with them. Next to each builder is the equivalent DuckDB SQL
(``*_SQL``) that the oracle queries use as a CTE.

qa        documents with their labels and benchmark passages: one response per document.
attempts  conversations: assistant turns are attempts of a session, the
          question is the latest user turn before the attempt, the reference
          the first user turn of the conversation (when it precedes the attempt).
chunks    documents assigned to a conversation as retrieval chunks.
scores    events averaged per (user, event type): long score table.
lines     lineitem as a multi-metric score table (model=returnflag).
binary    orders with a binary outcome (status 'F').
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.functions.numeric import rnd

from assay.sources.tables import read_table


def _bench_count(spark: SparkSession, sf_dir: str):
    # scalar subquery: computed by one tiny aggregate job, inlined as a literal
    return read_table(spark, sf_dir, "benchmark").select(F.count(F.lit(1))).scalar()


#: Category of the documents that have no label.
UNLABELLED = "unlabelled"


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per document.

    response  = document text (whole)
    question  = the benchmark passage the document is paired with (empty if there is none)
    reference = the question for every fourth document, else the whole document without
                every j-th sentence, j = 2 to 10
    category  = positivo when the quality label is 1, unlabelled without a label, else negativo
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    b = read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id"), F.col("text").alias("bench_text"))
    nth = F.pmod(F.col("doc_id"), F.lit(9)) + 2
    kept = F.filter(F.split("text", r"\. "), lambda x, i: (i + 1) % nth != 0)
    question = F.coalesce("bench_text", F.lit(""))
    return (
        d.join(lab, "doc_id", "left")
        .withColumn("item_id", F.pmod(F.col("doc_id"), _bench_count(spark, sf_dir)))
        .join(b, "item_id", "left")
        .select(
            F.col("doc_id").alias("session_id"),
            F.col("source").alias("model"),
            F.col("lang").alias("language"),
            F.when(F.col("quality") == 1, "positivo").when(F.col("quality").isNull(), UNLABELLED)
            .otherwise("negativo").alias("category"),
            question.alias("question"),
            F.col("text").alias("response"),
            F.when(F.pmod(F.col("doc_id"), F.lit(4)) == 0, question).otherwise(F.array_join(kept, ". "))
            .alias("reference"),
        )
    )


QA_SQL = """qa AS (
  SELECT d.doc_id AS session_id, d.source AS model, d.lang AS language,
         CASE WHEN l.quality = 1 THEN 'positivo' WHEN l.quality IS NULL THEN 'unlabelled' ELSE 'negativo' END AS category,
         coalesce(b.text, '') AS question, d.text AS response,
         CASE WHEN d.doc_id % 4 = 0 THEN coalesce(b.text, '')
              ELSE array_to_string(list_filter(string_split(d.text, '. '), lambda x, i: i % (d.doc_id % 9 + 2) <> 0), '. ')
         END AS reference
  FROM documents d
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
)"""


def attempts(spark: SparkSession, sf_dir: str, hot_rows: int | None = None) -> DataFrame:
    """Assistant turns as attempts; question = latest user turn before it; reference =
    the conversation's first user turn when it comes before the attempt.

    Running values per conversation use ``number_within``: a plain window for
    normal conversations, a range-partitioned scan for hot ones. The first user
    turn is a ``min_by`` aggregate joined back on the conversation id.
    """
    from assay.operators.skew import DEFAULT_HOT_ROWS, number_within
    hot = hot_rows or DEFAULT_HOT_ROWS
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user_text = F.when(F.col("role") == "user", F.col("text"))
    q = number_within(c.withColumn("_user_text", user_text), ["conv_id"], ["turn"], value_col="_user_text",
                      rn_col="_rn_all", prev_col="_question", hot_rows=hot)
    first = (c.filter(F.col("role") == "user").groupBy("conv_id")
             .agg(F.min_by(F.struct("turn", "text"), "turn").alias("_first")))
    a = number_within(q.filter(F.col("role") == "assistant"), ["conv_id"], ["turn"], rn_col="_rn", hot_rows=hot)
    a = a.join(first, "conv_id", "left")
    ref = F.when(F.col("_first.turn") < F.col("turn"), F.col("_first.text"))
    return a.select(
        F.col("conv_id").alias("session_id"),
        (F.col("_rn") - 1).alias("attempt"),
        F.col("turn"),
        F.coalesce(F.col("_question"), F.lit("")).alias("question"),
        F.coalesce(ref, F.lit("")).alias("reference"),
        F.col("text").alias("response"),
    )


ATTEMPTS_SQL = """conv_q AS (
  SELECT conv_id, turn, role, text,
         coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (
             PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS question,
         coalesce(first_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (
             PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS reference
  FROM conversations
),
attempts AS (
  SELECT conv_id AS session_id,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS attempt,
         turn, question, reference, text AS response
  FROM conv_q WHERE role = 'assistant'
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as retrieval chunks of a conversation (doc_id mod #conversations).

    The conversation count is a scalar subquery; the join is an equi-join on
    the computed key, so no side is broadcast unless AQE measures it small.
    """
    conv = read_table(spark, sf_dir, "conversations")
    n_conv = conv.select(F.countDistinct("conv_id")).scalar()
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return d.select(
        F.pmod(F.col("doc_id"), n_conv).alias("session_id"),
        F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("content"),
        rnd(F.pmod(F.col("n_chars"), F.lit(97)) / 97.0, 4).alias("chunk_score"),
    )


CHUNKS_SQL = """chunks AS (
  SELECT doc_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS session_id,
         doc_id AS chunk_id, text AS content, round((n_chars % 97) / 97.0, 4) AS chunk_score
  FROM documents
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long score table from events: one value per (model, session)."""
    e = read_table(spark, sf_dir, "events")
    return (
        e.groupBy("event_type", "user_id")
        .agg(rnd(F.avg("value"), 4).alias("value"))
        .select(
            F.col("event_type").alias("model"),
            F.when(F.pmod(F.col("user_id"), F.lit(2)) == 0, "positivo").otherwise("negativo").alias("category"),
            F.col("user_id").alias("session_id"),
            F.col("value"),
        )
    )


SCORES_SQL = """scores AS (
  SELECT event_type AS model,
         CASE WHEN user_id % 2 = 0 THEN 'positivo' ELSE 'negativo' END AS category,
         user_id AS session_id, round(avg(value), 4) AS value
  FROM events GROUP BY event_type, user_id
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a score table: model=returnflag, category=linestatus."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_linenumber").alias("attempt"),
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("category"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"),
    )


LINES_SQL = """lines AS (
  SELECT l_orderkey AS session_id, l_linenumber AS attempt, l_returnflag AS model,
         l_linestatus AS category, l_quantity AS quantity, l_discount AS discount,
         l_tax AS tax, l_extendedprice AS price
  FROM lineitem
)"""


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with a binary outcome; the priority is the model."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderpriority").alias("model"),
        (F.col("o_orderstatus") == "F").cast("double").alias("flag"),
    )


BINARY_SQL = """binary_v AS (
  SELECT o_orderkey AS session_id, o_custkey AS custkey, o_orderpriority AS model,
         CAST(o_orderstatus = 'F' AS DOUBLE) AS flag
  FROM orders
)"""
