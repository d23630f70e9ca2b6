"""The evaluation views keep every row of their tables."""

from assay.plans.stats_plans import against
from assay.sources.views import qa
from conftest import rows


def test_qa_keeps_unlabelled_and_unpaired_documents(spark, tmp_path):
    docs = [(4, "One. Two. Three.", "en", "a", 16), (9, "One. Two. Three. Four", "en", "a", 21), (10, "", "de", None, 0),
            (11, "One. Two. Three. Four", None, "b", 21)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "zero"), (7, "seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["session_id"]: r for r in rows(qa(spark, str(tmp_path)))}
    assert {k: r["category"] for k, r in out.items()} == {4: "positivo", 9: "unlabelled", 10: "negativo", 11: "unlabelled"}
    assert out[4]["question"] == out[4]["reference"] == "zero"   # every fourth document
    assert out[9]["question"] == ""                              # no benchmark item 1
    assert out[9]["reference"] == "One. Three"                   # without every second sentence
    assert out[11]["reference"] == "One. Two. Three"             # without every fourth
    assert out[10]["reference"] == "" and out[10]["model"] is None


def test_against_pairs_every_model_with_the_reference(spark):
    df = spark.createDataFrame([("r", "x", 1), ("r", "y", 2), ("a", "x", 3), ("b", "x", 4), ("b", "y", 5)],
                               "model string, category string, value int")
    got = sorted((r["model"], r["category"], r["side"], r["value"]) for r in rows(against(df, "r")))
    assert got == [("a", "x", "candidate", 3), ("a", "x", "reference", 1), ("b", "x", "candidate", 4),
                   ("b", "x", "reference", 1), ("b", "y", "candidate", 5), ("b", "y", "reference", 2)]


def test_weighted_sample_keeps_rows_without_category(spark):
    from assay.sources.medallion import weighted_sample
    df = spark.createDataFrame([(str(i), None if i % 2 else "x") for i in range(40)], "id string, data_category_QA string")
    out = rows(weighted_sample(df, 1.0, 42))
    assert len(out) == 40 and sum(r["data_category_QA"] is None for r in out) == 20
    assert len(rows(weighted_sample(df, 0.25, 42))) == 10
