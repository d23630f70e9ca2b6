"""A5, D5 — the scored export: every metric of every attempt, and raw scores off it.

One row per attempt with the columns of ``medallion.PREDICTION_SCHEMA``. Scores of a response
(H2-H8, H11, H12, ingested judge answers) stand on its own row; scores of a session (H9, H10)
are copied to each of its attempts. A metric that does not apply stays null: class match
without a known class, attribution without chunks, pass@k and self-consistency of a single
attempt, a judge that gave no answer.

Attempts carry ``session_id, attempt, run_id, model, category, language, question, reference,
response`` and, where there are any, ``classes, chosen_class_id`` and the judges' raw answers
``correctness_raw, guidelines_raw, groundedness_raw``. A null run is the run ''. (run, session,
attempt) is unique. Texts are tokenised where they are read; joins move scores, not texts,
apart from one join of the flags to the scored rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from assay.functions.lcs import rouge_l
from assay.functions.text import class_exact_match, groundedness, judge_feedback
from assay.functions.tokens import tokens
from assay.operators.aggregate import completeness_gate, unpivot_metrics
from assay.operators.scoring import score_responses
from assay.operators.session_scores import chunk_attribution, pass_at_k, self_consistency
from assay.sources.medallion import PREDICTION_SCHEMA, write_predictions

# fixed values: the metrics that thresholds and tests read
STATISTICAL_METRICS = ["token_overlap_f1", "refusal_detection", "class_exact_match", "groundedness", "pass_at_k", "self_consistency",
                       "hedging_detection", "question_response_overlap", "response_length_ratio", "rouge_l", "chunk_attribution"]
PASS_THRESHOLD = 0.3


def scored_export(attempts: DataFrame, lexicon, timestamp: str, chunks: DataFrame | None = None) -> DataFrame:
    """Attempts -> export rows. ``chunks`` are ``session_id, chunk_id, content, chunk_score``."""
    base = attempts.withColumn("run_id", F.coalesce("run_id", F.lit("")))
    session, trace = ["run_id", "session_id"], ["run_id", "session_id", "attempt"]
    scored = score_responses(base, trace, lexicon)
    scored = scored.withColumn("rouge_l", rouge_l(tokens("response"), tokens("reference")))
    if {"classes", "chosen_class_id"} <= set(base.columns):
        scored = scored.withColumn("class_exact_match", class_exact_match("response", "classes", "chosen_class_id"))
    for raw, name in (("correctness_raw", "correctness_score"), ("guidelines_raw", "guidelines_score")):
        if raw in base.columns:
            scored = scored.withColumn(name, judge_feedback(raw))
    if "groundedness_raw" in base.columns:
        judged = F.when(F.col("groundedness_raw").isNotNull(), groundedness("groundedness_raw"))
        scored = scored.withColumn("groundedness_score", judged)
    passed = pass_at_k(scored.select(*session, "token_overlap_f1"), session, "token_overlap_f1", threshold=PASS_THRESHOLD).drop("k")
    agreed = self_consistency(base.select(*trace, "response"), session).drop("n_pairs")
    out = scored.join(passed, session, "left").join(agreed, session, "left")
    if chunks is not None:
        # chunks belong to a record, whichever run answers it
        who = base.select("session_id", F.struct("run_id", "attempt").alias("who"), "response")
        found = chunk_attribution(who, chunks, ["session_id"], attempt_col="who").select(
            F.col("who.run_id").alias("run_id"), "session_id", F.col("who.attempt").alias("attempt"), "chunk_attribution")
        out = out.join(found, trace, "left")
    named = {"id": F.col("session_id"), "timestamp": F.lit(timestamp), "prediction": F.col("response"), "data_category_QA": F.col("category")}
    return out.select(*[
        named.get(f.name, F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in PREDICTION_SCHEMA.fields])


def export_predictions(rows: DataFrame, path: str) -> int:
    """Append export rows as JSON lines; the number of rows written, counted while they are."""
    seen = Observation()
    write_predictions(rows.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return seen.get["n"]


def first_attempts(export: DataFrame) -> DataFrame:
    """The first attempt of each (run, session), which is not number 0 where that one failed."""
    key = ["run_id", "id"]
    others = [c for c in export.columns if c not in key]
    first = export.groupBy(*key).agg(F.min_by(F.struct(*others), F.col("attempt")).alias("_first"))
    return first.select(*key, "_first.*")


def collect_raw_scores(export: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """D5 — ``run_id, category, metric, session_id, value`` of first attempts; a metric stays in
    a category of a run only if each of its sessions has a value."""
    rows = first_attempts(export).withColumnsRenamed(
        {"id": "session_id", "data_category_QA": "category", "groundedness_score": "groundedness"})
    names = STATISTICAL_METRICS if metrics is None else metrics
    long = unpivot_metrics(rows, ["run_id", "category", "session_id"], names, name_col="metric", drop_nulls=False)
    return completeness_gate(long, ["run_id", "category"])
