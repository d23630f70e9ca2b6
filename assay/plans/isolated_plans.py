"""Plans of the failure-isolated scorers, the groundedness port, the trace table and the
dataset records (H14, H15, M6, B17, A7, A8, A10, A13, B12, B13, F2, F3)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import isolated as iso
from assay.plans.records_plans import RECORDS_SQL, records
from assay.sources import dataset as ds
from assay.sources import medallion as md
from assay.sources import traces as tr
from assay.sources.tables import read_table

CATEGORIES = ("positivo", "negativo", "absent")


# ---- scorers of a user: one that raises, one that answers None or N/A, and a judge's answers

def spaces_per_stop(*, inputs: dict, outputs: dict) -> float:
    """Raises on a response without a full stop."""
    text = outputs["response"] or ""
    return text.count(" ") / text.count(".")


def length_share(*, inputs: dict, outputs: dict, expectations: dict):
    """None on an empty response, not applicable on an empty reference."""
    if not expectations["expected_response"]:
        return iso.NotApplicable("N/A: empty reference")
    if not outputs["response"]:
        return None
    return min(1.0, len(outputs["response"]) / len(expectations["expected_response"]))


def _scorer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("content", F.col("reference"))
    return ds.scorer_inputs(ds.decode_records(r))


def isolated_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H14 + H15 + B13: cells of three user scorers and a judge's ingested answers for every
    record; a scorer that raises on a record empties that cell alone."""
    answer = F.when(F.col("data_category_QA") == "positivo", " Yes").when(F.col("data_category_QA") == "negativo", "no")
    named = F.when(F.col("chosen_class_id") < "c5", F.length("question"))  # a Column scorer: null is a plain None
    s = iso.score_isolated(_scorer_records(spark, sf_dir), {"spaces_per_stop": spaces_per_stop, "length_share": length_share, "question_size": named})
    s = s.withColumn("correctness", iso.judged_cell(answer))
    names = ["spaces_per_stop", "length_share", "question_size", "correctness"]
    values = iso.scores_of(s, ["session_id"], names).withColumn("error", F.lit(None).cast("string"))
    errors = iso.failures_of(s, ["session_id"], names).withColumn("value", F.lit(None).cast("double"))
    return values.unionByName(errors)


ISOLATED_SCORES_SQL = "WITH " + RECORDS_SQL + """,
p AS (SELECT *, length(response) - length(replace(response, ' ', '')) AS spaces,
             length(response) - length(replace(response, '.', '')) AS stops FROM records),
c AS (
  SELECT session_id, 'spaces_per_stop' AS scorer_name, CASE WHEN stops > 0 THEN spaces / stops END AS value,
         CASE WHEN coalesce(stops, 0) = 0 THEN 'ZeroDivisionError: division by zero' END AS error FROM p
  UNION ALL SELECT session_id, 'length_share',
         CASE WHEN coalesce(reference, '') = '' THEN NULL WHEN coalesce(response, '') = '' THEN 0.0
              ELSE least(1.0, length(response) / length(reference)) END,
         CASE WHEN coalesce(reference, '') = '' THEN 'N/A: empty reference' END FROM p
  UNION ALL SELECT session_id, 'question_size', CASE WHEN chosen_class_id < 'c5' THEN length(question) ELSE 0.0 END, NULL FROM p
  UNION ALL SELECT session_id, 'correctness', CASE data_category_QA WHEN 'positivo' THEN 1.0 WHEN 'negativo' THEN 0.0 END,
         CASE WHEN data_category_QA NOT IN ('positivo', 'negativo') THEN 'N/A: no judge answer' END FROM p
)
SELECT session_id, scorer_name, CAST(value AS DOUBLE) AS value, error FROM c"""


# ---- groundedness

def open_word_judge():
    """A judge in place of a model: the share of the statement's words that the source holds."""
    def judge(source: str, statement: str) -> tuple[float, str]:
        known, words = set(source.split(" ")), statement.split(" ")
        if statement.count("!") > 2:
            raise ValueError("too loud")
        hits = sum(w in known for w in words)
        return hits / len(words), f"{hits} of {len(words)} words"
    return judge


def groundedness_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 + B17: score and reason of every response against its reference; a failing judge
    leaves 0.0 and the reason scoring_error, a record without a reference is not judged."""
    ground = iso.groundedness_port(open_word_judge)
    r = records(spark, sf_dir).select("session_id", ground(F.col("reference"), F.col("response")).alias("judged"))
    return r.select("session_id", "judged.score", "judged.reason").filter("score is not null")


# printf rounds the binary value exactly, as the scorer does
GROUNDEDNESS_SQL = "WITH " + RECORDS_SQL + """,
w AS (SELECT session_id, list_distinct(string_split(reference, ' ')) AS known, string_split(coalesce(response, ''), ' ') AS words,
             length(coalesce(response, '')) - length(replace(coalesce(response, ''), '!', '')) AS loud
      FROM records WHERE coalesce(reference, '') <> ''),
h AS (SELECT *, len(list_filter(words, lambda x: list_contains(known, x))) AS hits FROM w)
SELECT session_id, CASE WHEN loud > 2 THEN 0.0 ELSE CAST(printf('%.4f', hits / len(words)) AS DOUBLE) END AS score,
       CASE WHEN loud > 2 THEN 'scoring_error' ELSE hits || ' of ' || len(words) || ' words' END AS reason FROM h"""


# ---- traces

def _trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("trace_id"),
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("attempt"), F.col("turn").cast("bigint").alias("created_at"),
        F.lit(None).cast("string").alias("input_text"), F.col("text").alias("output_text"),
        F.concat(F.lit("run-"), F.pmod(F.col("conv_id"), F.lit(8)).cast("string")).alias("run_id"))


def run_traces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: traces are appended to a table partitioned by run; those of the runs that an
    evaluation table names are read back with the runs' files alone."""
    path = md.scratch_path(spark, f"traces-{uuid.uuid4().hex}")
    tr.append_traces(_trace_rows(spark, sf_dir), path)
    runs = (read_table(spark, sf_dir, "conversations").filter("role = 'system'")
            .select(F.concat(F.lit("run-"), F.pmod(F.col("conv_id"), F.lit(8)).cast("string")).alias("run_id"))
            .groupBy("run_id").count().filter("run_id <> 'run-3'"))
    found = tr.search_traces(tr.read_traces(spark, path), runs)
    return found.groupBy("run_id", "session_id").agg(F.count(F.lit(1)).alias("n_traces"), F.max("created_at").alias("last_at"),
                                                     F.sum(F.length("output_text")).alias("output_chars"))


RUN_TRACES_SQL = """
SELECT 'run-' || (conv_id % 8) AS run_id, CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n_traces, max(turn) AS last_at,
       CAST(sum(length(text)) AS BIGINT) AS output_chars
FROM conversations WHERE role = 'assistant' AND conv_id % 8 <> 3
  AND conv_id % 8 IN (SELECT conv_id % 8 FROM conversations WHERE role = 'system') GROUP BY 1, 2"""


def trace_existence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sessions have a trace."""
    sessions = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id")).distinct()
    late = _trace_rows(spark, sf_dir).filter("created_at > 4")
    return tr.with_existence(sessions, late)


TRACE_EXISTENCE_SQL = """
SELECT CAST(conv_id AS VARCHAR) AS session_id, bool_or(role = 'assistant' AND turn > 4) AS has_trace FROM conversations GROUP BY conv_id"""


# ---- dataset records

def _json_chunks(r: DataFrame) -> DataFrame:
    """Records whose chunks are JSON text: one with a score, one without; none without a question."""
    chunks = F.array(F.struct(F.col("question").alias("content"), F.lit(0.25).alias("score")),
                     F.struct(F.col("name").alias("content"), F.lit(None).cast("double").alias("score")))
    return r.withColumn("chunks_big", F.when(F.col("question") != "", F.to_json(chunks)))


def dataset_records_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + B12 + F3: records whose chunks come as JSON text with missing scores, decoded with
    defaults, as nested structs; the first 500 of the categories by id."""
    r = _json_chunks(records(spark, sf_dir).withColumn("content", F.col("reference")))
    n = ds.nested_records(ds.load_filtered(r, CATEGORIES), limit=500)
    return n.select("tags.session_id", "tags.data_category_QA", F.length("inputs.question").cast("bigint").alias("question_size"), "inputs.language",
                    F.length("expectations.expected_response").cast("bigint").alias("reference_size"), "expectations.guidelines",
                    "expectations.chosen_class_id")


DATASET_RECORDS_SQL = "WITH " + RECORDS_SQL + f"""
SELECT id AS session_id, data_category_QA, length(question) AS question_size, CAST(language AS BIGINT) AS language,
       length(reference) AS reference_size, array_to_string(list_filter(instructions, lambda x: x IS NOT NULL), '; ') AS guidelines, chosen_class_id
FROM records WHERE data_category_QA IN {CATEGORIES} ORDER BY id LIMIT 500"""


def decoded_chunks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks decoded from JSON text; a missing score is 0.0, no chunks an empty array."""
    r = _json_chunks(records(spark, sf_dir))
    d = ds.load_filtered(r.select("session_id", "data_category_QA", "chunks_big", "classes", "instructions"), CATEGORIES)
    return d.select("session_id", F.size("chunks_big").alias("n_chunks"),
                    F.aggregate("chunks_big", F.lit(0.0), lambda a, c: a + c["score"]).alias("score_sum"),
                    F.aggregate("chunks_big", F.lit(0), lambda a, c: a + F.length(c["content"])).alias("content_chars"),
                    F.aggregate("classes", F.lit(0), lambda a, c: a + F.length(c["class"])).alias("class_chars"))


DECODED_CHUNKS_SQL = "WITH " + RECORDS_SQL + f"""
SELECT session_id, CASE WHEN question <> '' THEN 2 ELSE 0 END AS n_chunks, CAST(CASE WHEN question <> '' THEN 0.25 ELSE 0.0 END AS DOUBLE) AS score_sum,
       CASE WHEN question <> '' THEN length(question) + length(coalesce(name, '')) ELSE 0 END AS content_chars,
       CAST(list_sum(list_transform(classes, lambda c: length(coalesce(c.class, '')))) AS BIGINT) AS class_chars
FROM records WHERE data_category_QA IN {CATEGORIES}"""


def category_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count by category list, 0 for a category without records."""
    return ds.count_by_category(records(spark, sf_dir), CATEGORIES)


CATEGORY_COUNTS_SQL = "WITH " + RECORDS_SQL + f""",
c(data_category_QA) AS (VALUES {', '.join(f"('{c}')" for c in CATEGORIES)})
SELECT c.data_category_QA, count(r.id) AS n FROM c LEFT JOIN records r ON r.data_category_QA = c.data_category_QA GROUP BY 1"""


def ordered_output_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records written in the order of category and session over range-partitioned files;
    each row with its place, counted over the files in their order."""
    from assay.operators.prefix import prefix_scan
    path = md.scratch_path(spark, f"ordered-{uuid.uuid4().hex}")
    order = ["data_category_QA", "session_id"]
    ds.write_ordered(records(spark, sf_dir).select(*order), path, order)
    rows = ds.read_ordered(spark, path, order).withColumn("one", F.lit(1).cast("bigint"))
    placed = prefix_scan(rows, [], [F.col("file"), F.col("place")], sums=["one"])
    return placed.select(*order, F.col("one_before").alias("position"))


ORDERED_OUTPUT_SQL = "WITH " + RECORDS_SQL + """
SELECT data_category_QA, session_id, row_number() OVER (ORDER BY data_category_QA, session_id) - 1 AS position FROM records"""

QUERIES = {"isolated_scores": isolated_scores_query, "groundedness": groundedness_query, "run_traces": run_traces_query,
           "trace_existence": trace_existence_query, "dataset_records": dataset_records_query, "decoded_chunks": decoded_chunks_query,
           "category_counts": category_counts_query, "ordered_output": ordered_output_query}
ORACLE_SQL = {"isolated_scores": ISOLATED_SCORES_SQL, "groundedness": GROUNDEDNESS_SQL, "run_traces": RUN_TRACES_SQL,
              "trace_existence": TRACE_EXISTENCE_SQL, "dataset_records": DATASET_RECORDS_SQL, "decoded_chunks": DECODED_CHUNKS_SQL,
              "category_counts": CATEGORY_COUNTS_SQL, "ordered_output": ORDERED_OUTPUT_SQL}
