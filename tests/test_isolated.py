"""Failure-isolated scorers, the groundedness port, traces and dataset records on edge cases."""

import math
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from assay.operators import isolated as iso
from assay.sources import dataset as ds
from assay.sources import traces as tr


def test_a_failure_stays_in_its_cell(spark):
    def moody(*, inputs, outputs, expectations):
        text = outputs.get("response")
        if text == "boom":
            raise KeyError("no such thing")
        return {"none": None, "na": iso.NotApplicable("N/A: asked not to"), "yes": True, "word": "seven"}.get(text, 0.25)

    def plain(*, inputs, outputs):
        return len(outputs["response"])

    texts = ["boom", "none", "na", "yes", "word", "other", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, response string").select(
        "id", F.struct(F.lit("q").alias("question")).alias("inputs"), F.struct("response").alias("outputs"),
        F.struct(F.lit("r").alias("expected_response")).alias("expectations"))
    s = iso.score_isolated(df, {"moody": moody, "plain": plain, "column": F.when(F.col("id") > 2, F.col("id"))})
    got = {r["id"]: r for r in s.collect()}
    assert [got[i]["moody"]["value"] for i in range(7)] == [None, 0.0, None, 1.0, None, 0.25, 0.25]
    assert got[0]["moody"]["error"] == "KeyError: 'no such thing'" and got[2]["moody"]["error"] == "N/A: asked not to"
    assert got[4]["moody"]["error"].startswith("ValueError") and got[6]["plain"]["error"].startswith("TypeError")
    assert [got[i]["plain"]["value"] for i in range(6)] == [4.0, 4.0, 2.0, 3.0, 4.0, 5.0]
    assert [got[i]["column"]["value"] for i in range(4)] == [0.0, 0.0, 0.0, 3.0]
    names = ["moody", "plain", "column"]
    assert iso.scores_of(s, ["id"], names).count() == 4 + 6 + 7 and iso.failures_of(s, ["id"], names).count() == 3 + 1
    assert iso.scores_of(iso.score_isolated(df.limit(0), {"moody": moody}), ["id"], ["moody"]).collect() == []


def test_groundedness_port(spark):
    def opened():
        def judge(source, statement):
            if statement == "raise":
                raise RuntimeError("down")
            return {"null": None, "nan": math.nan, "high": 7, "low": -1}.get(statement, 0.123456), f"about {source}"
        return judge

    def broken():
        raise OSError("no model")

    pairs = [("s", t) for t in ("raise", "null", "nan", "high", "low", "x", None)] + [("", "x"), (None, "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, source string, statement string")
    got = [r["g"] for r in df.select("id", iso.groundedness_port(opened)(F.col("source"), F.col("statement")).alias("g")).orderBy("id").collect()]
    assert [g and tuple(g) for g in got] == [
        (0.0, "scoring_error"), (0.0, "about s"), (0.0, "scoring_error"), (1.0, "about s"), (0.0, "about s"), (0.1235, "about s"), (0.1235, "about s"), None, None]
    lost = df.select(iso.groundedness_port(broken)(F.col("source"), F.col("statement")).alias("g")).filter("g is not null").select("g.*").distinct().collect()
    assert [tuple(r) for r in lost] == [(0.0, "scoring_error")]


def test_traces_by_run(spark, tmp_path):
    path = str(tmp_path / "traces")
    assert tr.read_traces(spark, path).count() == 0
    rows = [("t1", "s1", 0, 5, "in", "out", "a"), ("t2", "s1", 1, 3, "in", "out", "b"), ("t3", "s2", 0, 1, None, "", None), ("t1", "s1", 0, 5, "in", "out", "a")]
    tr.append_traces(spark.createDataFrame(rows, tr.TRACE_SCHEMA), path)
    tr.append_traces(spark.createDataFrame([("t4", "s3", 0, 9, "in", "out", "c")], tr.TRACE_SCHEMA), path)
    t = tr.read_traces(spark, path)
    assert sorted(r["trace_id"] for r in tr.search_traces(t, ["a", "c"]).collect()) == ["t1", "t1", "t4"]
    assert [r["trace_id"] for r in tr.search_traces(t, [None]).collect()] == ["t3"] and tr.search_traces(t, []).count() == 0
    runs = spark.createDataFrame([("b",), ("b",), (None,), ("zz",)], "run_id string")
    assert sorted(r["trace_id"] for r in tr.search_traces(t, runs).collect()) == ["t2", "t3"]
    plan = tr.search_traces(t, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*run_id", plan)
    assert [r["trace_id"] for r in tr.find_by_session(t, "s1").collect()] == ["t2", "t1", "t1"]
    sessions = spark.createDataFrame([("s1",), ("s9",), (None,)], "session_id string")
    assert {r["session_id"]: r["has_trace"] for r in tr.with_existence(sessions, t).collect()} == {"s1": True, "s9": False, None: False}
    with pytest.raises(AnalysisException):
        tr.append_traces(spark.createDataFrame([("t",)], "trace_id string"), path)


def test_decode_with_defaults(spark):
    df = spark.createDataFrame([
        (1, '[{"content": "a", "score": 0.5}, {"content": null}, null]', None, "7"), (2, "not json", ["x", None], "no"), (3, None, [], None)],
        "id long, chunks_big string, instructions array<string>, language string")
    got = {r["id"]: r for r in ds.decode_records(df).collect()}
    assert [tuple(c) for c in got[1]["chunks_big"]] == [("a", 0.5), ("", 0.0)] and got[1]["instructions"] == [] and got[1]["language"] == 7
    assert got[2]["chunks_big"] == [] and got[2]["instructions"] == ["x"] and got[2]["language"] == 0 and got[3]["classes"] == []
    typed = spark.createDataFrame([(1, [("a", "0.5"), ("b", "bad"), None])], "id long, chunks_big array<struct<content: string, score: string>>")
    assert [tuple(c) for c in ds.decode_records(typed).first()["chunks_big"]] == [("a", 0.5), ("b", 0.0)]


def test_ordered_files(spark, tmp_path):
    rows = [(i % 7, (i * 7919) % 1000) for i in range(1000)] + [(None, 5), (3, None)]
    path = str(tmp_path / "ordered")
    ds.write_ordered(spark.createDataFrame(rows, "a long, b long"), path, ["a", "b"], partitions=6)
    back = sorted(ds.read_ordered(spark, path, ["a", "b"]).collect(), key=lambda r: (r["file"], r["place"]))
    key = lambda v: (v is not None, v or 0)
    assert len({r["file"] for r in back}) > 2
    assert [(r["a"], r["b"]) for r in back] == sorted(rows, key=lambda r: (key(r[0]), key(r[1])))
