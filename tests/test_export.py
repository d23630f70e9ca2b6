"""The scored export (A5), first attempts and raw scores."""

import uuid

import pytest

from assay.functions.lcs import rouge_l_value
from assay.functions.lexicon import default_rows
from assay.operators import export as ex
from assay.session import ensure_checkpoint_dir
from assay.sources import medallion as md

SCHEMA = ("session_id string, attempt int, run_id string, model string, category string, language long, question string, reference string, "
          "response string, classes array<struct<class: string, context: string, id: string>>, chosen_class_id string, "
          "correctness_raw string, guidelines_raw string, groundedness_raw double, note string")
CLASSES = [("open_late", "", "c0")]
ROWS = [
    ("s1", 0, "r1", "m", "positivo", 1, "when does it open", "it opens at nine", "it opens at nine", CLASSES, "c0", "Yes", None, 1.7, "x"),
    ("s1", 1, "r1", "m", "positivo", 1, "when does it open", "it opens at nine", "Maybe open late", CLASSES, "c0", "no", "other", None, "x"),
    ("s1", 0, "r2", "m", "positivo", 1, "when does it open", "it opens at nine", "we do not have that", CLASSES, "c9", None, "yes", -1.0, None),
    ("s2", 1, "r1", "m", "positivo", 1, None, None, None, None, None, None, None, None, None),
    ("s2", 2, "r1", "m", "positivo", 1, "q", "a b", "a b", None, None, None, None, None, None),
    ("s3", 0, None, "m", "negativo", 1, "", "", "", CLASSES, "", "", "", 0.5, None),
]
CHUNKS = [("s1", 1, "it opens at nine", 0.5), ("s1", 2, "other", 0.1)]


@pytest.fixture(scope="module")
def exported(spark):
    ensure_checkpoint_dir(spark)
    attempts = spark.createDataFrame(ROWS, SCHEMA)
    chunks = spark.createDataFrame(CHUNKS, "session_id string, chunk_id long, content string, chunk_score double")
    path = md.scratch_path(spark, f"export-test-{uuid.uuid4().hex}")
    rows = ex.scored_export(attempts, default_rows(), "2026-01-01T00:00:00", chunks)
    assert ex.export_predictions(rows, path) == len(ROWS)
    return spark, rows, path, {(r["run_id"], r["id"], r["attempt"]): r for r in md.read_predictions(spark, path).collect()}


def test_every_metric_of_every_attempt(exported):
    _, rows, _, got = exported
    assert [f.name for f in rows.schema] == [f.name for f in md.PREDICTION_SCHEMA]
    assert len(got) == len(ROWS)
    first, second = got["r1", "s1", 0], got["r1", "s1", 1]
    assert first["token_overlap_f1"] == first["rouge_l"] == first["chunk_attribution"] == 1.0
    assert second["rouge_l"] == rouge_l_value("Maybe open late".split(), "it opens at nine".split())
    assert second["hedging_detection"] and not first["hedging_detection"]
    assert second["class_exact_match"] and first["class_exact_match"] is False
    assert (first["correctness_score"], second["correctness_score"], second["guidelines_score"]) == (1.0, 0.0, 0.0)
    assert first["guidelines_score"] is None and first["groundedness_score"] == 1.0 and second["groundedness_score"] is None
    for r in (first, second):  # a session's scores stand on each of its attempts
        assert r["pass_at_k"] and r["pass_at_k_best_score"] == 1.0 and r["self_consistency"] == 0.0
    other = got["r2", "s1", 0]
    assert other["refusal_detection"] and other["failure_mode"] == "false_refusal"
    assert other["class_exact_match"] is None and other["pass_at_k"] is None and other["self_consistency"] is None
    assert other["groundedness_score"] == 0.0 and other["chunk_attribution"] is not None


def test_null_texts_runs_and_classes(exported):
    *_, got = exported
    empty = got["r1", "s2", 1]
    assert empty["prediction"] is None and empty["token_overlap_f1"] == 0.0 and empty["response_length_ratio"] is None
    assert empty["rouge_l"] == 0.0 and empty["chunk_attribution"] is None and empty["class_exact_match"] is None
    nameless = next(r for k, r in got.items() if k[1] == "s3")
    assert nameless["run_id"] in ("", None) and nameless["correctness_score"] == 0.0 and nameless["groundedness_score"] == 0.5


def test_raw_scores_take_first_attempts_and_whole_categories(exported):
    spark, _, path, _ = exported
    export = md.read_predictions(spark, path)
    firsts = {(r["run_id"], r["id"]): r["attempt"] for r in ex.first_attempts(export).collect()}
    assert firsts["r1", "s1"] == 0 and firsts["r1", "s2"] == 1 and len(firsts) == 4
    raw = {(r["run_id"], r["category"], r["metric"], r["session_id"]): r["value"] for r in ex.collect_raw_scores(export).collect()}
    assert raw["r1", "positivo", "token_overlap_f1", "s1"] == 1.0 and raw["r1", "positivo", "token_overlap_f1", "s2"] == 0.0
    # s2's first attempt has no length ratio: the metric goes from the whole category of that run
    assert not [k for k in raw if k[0] == "r1" and k[2] in ("response_length_ratio", "class_exact_match", "groundedness")]
    assert ("r2", "positivo", "response_length_ratio", "s1") in raw


def test_an_export_is_appended_to_and_may_be_empty(exported):
    spark, rows, path, _ = exported
    assert ex.export_predictions(rows.limit(0), path) == 0
    assert ex.export_predictions(rows.filter("id = 's3'"), path) == 1
    assert md.read_predictions(spark, path).count() == len(ROWS) + 1
    none = ex.scored_export(spark.createDataFrame([], SCHEMA), default_rows(), "t")
    assert none.count() == 0 and ex.collect_raw_scores(none).count() == 0
