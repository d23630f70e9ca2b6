"""Streaming upsert (L1), profile JSON (A6), request/cache workflow (K, C9, E3, D21), exact top-n (F1)."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.operators import requests as rq
from assay.sources import medallion as md
from assay.sources.profile_io import load_profile, profile_document, save_profile
from assay.streaming.incremental_gold import append_batch, gold, incremental_gold, running_run_metrics, unseen
from conftest import rows


def _pred(spark, data):
    fields = [f for f in md.PREDICTION_SCHEMA.fields]
    full = []
    for run_id, pid, attempt, pred in data:
        d = {f.name: None for f in fields}
        d.update(run_id=run_id, id=pid, attempt=attempt, prediction=pred, token_overlap_f1=0.5)
        full.append(tuple(d[f.name] for f in fields))
    return spark.createDataFrame(full, md.PREDICTION_SCHEMA)


def test_incremental_gold_appends_only_new_keys(spark):
    base = tempfile.mkdtemp(prefix="assay-test-")
    src, target, ckpt = (os.path.join(base, x) for x in ("src", "gold", "ckpt"))
    _pred(spark, [("r1", "a", 0, "x"), ("r1", "b", 0, "y")]).write.mode("append").json(src)
    incremental_gold(spark, src, target, ckpt)
    _pred(spark, [("r1", "a", 0, "x"), ("r1", "c", 0, "z"), ("r2", "a", 0, "w"), ("r2", "a", 0, "w")]) \
        .write.mode("append").json(src)
    incremental_gold(spark, src, target, ckpt)
    got = sorted((r["run_id"], r["id"]) for r in spark.read.parquet(target).collect())
    assert got == [("r1", "a"), ("r1", "b"), ("r1", "c"), ("r2", "a")]
    assert sorted((r["run_id"], r["id"]) for r in gold(spark, target).collect()) == got
    incremental_gold(spark, src, target, os.path.join(base, "other"))  # all files again, as a new stream
    assert spark.read.parquet(target).count() == 4
    assert gold(spark, os.path.join(base, "none")).count() == running_run_metrics(spark, os.path.join(base, "none")).count() == 0


def test_replayed_batch_adds_nothing(spark):
    target = os.path.join(tempfile.mkdtemp(prefix="assay-test-"), "gold")
    one = _pred(spark, [("r1", "a", 0, "x"), (None, "a", 0, "x"), (None, "a", 0, "y"), ("", "a", None, "x")])
    two = _pred(spark, [("r1", "a", 0, "x"), ("r1", "b", 0, "z"), (None, "a", 0, "z"), ("", "a", None, "x")])
    for _ in range(2):
        append_batch(one, "s-0", target)
        append_batch(two, "s-1", target)
        assert sorted(((r["run_id"], r["id"], r["attempt"], r["prediction"]) for r in gold(spark, target).collect()), key=repr) == sorted(
            [("r1", "a", 0, "x"), (None, "a", 0, "y"), ("", "a", None, "x"), ("r1", "b", 0, "z")], key=repr)
        got = {(r["run_id"], r["metric"]): (r["n"], r["mean"]) for r in running_run_metrics(spark, target).collect()}
        assert got == {(run, m): (n, v) for run, n in (("r1", 2), (None, 1), ("", 1))
                       for m, v in (("token_overlap_f1", 0.5), ("failure_mode_none", 1.0))}
    append_batch(two.limit(0), "s-2", target)
    assert gold(spark, target).count() == 4


def test_unfinished_batch_is_not_read(spark):
    target = os.path.join(tempfile.mkdtemp(prefix="assay-test-"), "gold")
    append_batch(_pred(spark, [("r1", "a", 0, "x")]), "s-0", target)
    _pred(spark, [("r1", "b", 0, "x")]).withColumn("run_bucket", F.lit(0)).write.partitionBy("run_bucket").parquet(f"{target}/batch=s-1")
    assert gold(spark, target).count() == 1
    append_batch(_pred(spark, [("r1", "b", 0, "x"), ("r1", "c", 0, "x")]), "s-1", target)
    assert gold(spark, target).count() == 3


def test_known_keys_are_read_from_the_buckets_of_the_batch(spark, capsys):
    target = os.path.join(tempfile.mkdtemp(prefix="assay-test-"), "gold")
    append_batch(_pred(spark, [(f"r{i}", "a", 0, "x") for i in range(40)]), "s-0", target)
    unseen(_pred(spark, [("r1", "a", 0, "x")]), "s-1", target).explain("formatted")
    plan = capsys.readouterr().out
    filters = [x for x in plan.splitlines() if "PartitionFilters" in x]
    assert any("run_bucket" in x and "batch" in x for x in filters), plan


def test_unreadable_target_ends_the_batch(spark):
    target = os.path.join(tempfile.mkdtemp(prefix="assay-test-"), "gold")
    append_batch(_pred(spark, [("r1", "a", 0, "x")]), "s-0", target)
    folder = next(x for x in os.listdir(f"{target}/batch=s-0") if x.startswith("run_bucket"))
    with open(f"{target}/batch=s-0/{folder}/part-broken.parquet", "w") as f:
        f.write("no parquet file")
    with pytest.raises(Exception, match="(?i)parquet"):
        append_batch(_pred(spark, [("r1", "a", 0, "x")]), "s-1", target)


def test_profile_roundtrip(spark):
    flat = spark.createDataFrame(
        [("positivo", "token_overlap_f1", 0.3, 0.25, 0.35, "continuous", "wilcoxon", "mannwhitneyu", 0.5, 0.1, 200),
         ("positivo", "refusal_detection", 0.05, 0.02, 0.08, "binary", "mcnemar", "chi2", 0.1, 0.3, 200),
         ("global", "discrimination_delta", 0.1, 0.08, 0.12, "composite", "bootstrap", "bootstrap", 0.2, 0.05, 400)],
        "category string, metric string, value double, ci_lower double, ci_upper double, metric_type string, "
        "test_paired string, test_unpaired string, reference_mean double, reference_std double, sample_count long")
    doc = profile_document(flat, created_at="t", benchmark="b", reference_models=["m"], reference_run_ids=["r"],
                           total_sessions=400, bootstrap_b=1000, seed=42, percentile=5, alpha=0.05)
    path = os.path.join(tempfile.mkdtemp(prefix="assay-test-"), "profile")
    save_profile(doc, path)
    back = sorted((r["category"], r["metric"], r["value"]) for r in load_profile(spark, path).collect())
    assert back == sorted((r["category"], r["metric"], r["value"]) for r in flat.collect())
    assert load_profile(spark, path + "-missing") is None


def test_cache_resolution_and_attempt_numbering(spark):
    reqs = spark.createDataFrame([("k1", a) for a in range(3)] + [("k2", a) for a in range(3)],
                                 "cache_key string, attempt int")
    cache = spark.createDataFrame([("k1", 5, "t2", "second"), ("k1", 1, "t1", "first")],
                                  "cache_key string, created_at long, trace_id string, output_text string")
    numbered = rq.number_attempts(cache)
    assert {(r["attempt"], r["output_text"]) for r in numbered.collect()} == {(0, "first"), (1, "second")}
    hits, misses = rq.resolve_cache(reqs, numbered)
    assert hits.count() == 2 and misses.count() == 4
    assert rows(rq.cache_counts(reqs, numbered)) == [{"hits": 2, "misses": 4}]

    def responder(pdf: pd.DataFrame) -> pd.DataFrame:
        err = pdf["attempt"].map(lambda a: "boom" if a == 2 else None)
        return pd.DataFrame({"cache_key": pdf["cache_key"], "attempt": pdf["attempt"],
                             "output_text": "new", "error": err})
    answered = rq.respond(misses, responder, "cache_key string, attempt int, output_text string, error string")
    assert answered.count() == 2  # failed attempts are dropped


def test_upsert_keeps_latest(spark):
    cur = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, version int, v string")
    upd = spark.createDataFrame([("a", 2, "x2")], "id string, version int, v string")
    out = {r["id"]: r["v"] for r in rq.upsert_latest(cur, upd).collect()}
    assert out == {"a": "x2", "b": "y"}


def test_top_n_exact_matches_sort(spark):
    df = spark.range(0, 5000).select(F.col("id").cast("string").alias("id"),
                                     (F.col("id") * 7919 % 1000).cast("double").alias("k"))
    got = sorted(r["id"] for r in md.top_n_exact(df, "k", "id", 321, num_partitions=7).collect())
    exp = sorted(r["id"] for r in df.orderBy(F.col("k").desc(), F.col("id")).limit(321).collect())
    assert got == exp


def test_number_within_hot_path_equals_window(spark):
    from assay.operators.skew import number_within
    data = [("hot", t, f"u{t}" if t % 3 == 0 else None) for t in range(400)] + \
           [("k1", t, "a" if t == 1 else None) for t in range(5)] + [("k2", 0, None)]
    df = spark.createDataFrame(data, "k string, t long, v string")
    plain = number_within(df, ["k"], ["t"], value_col="v", hot_rows=10_000)
    split = number_within(df, ["k"], ["t"], value_col="v", hot_rows=50, num_partitions=6)
    a = sorted((r["k"], r["t"], r["rn"], r["prev_value"]) for r in plain.collect())
    b = sorted((r["k"], r["t"], r["rn"], r["prev_value"]) for r in split.collect())
    assert a == b
    assert ("hot", 4, 5, "u3") in a


def test_attempts_view_hot_path(spark):
    from assay.sources.views import attempts
    from conftest import SF001
    a = sorted(tuple(r) for r in attempts(spark, SF001).collect())
    b = sorted(tuple(r) for r in attempts(spark, SF001, hot_rows=3).collect())
    assert a == b


def test_attempt_numbering_hot_key_path(spark):
    cache = spark.createDataFrame([("hot", t, f"t{t:03d}", "x") for t in range(120)] + [("k", 0, "a", "y")],
                                  "cache_key string, created_at long, trace_id string, output_text string")
    plain = sorted((r["cache_key"], r["trace_id"], r["attempt"]) for r in rq.number_attempts(cache).collect())
    split = sorted((r["cache_key"], r["trace_id"], r["attempt"])
                   for r in rq.number_attempts(cache, hot_rows=10).collect())
    assert plain == split
    assert ("hot", "t119", 119) in plain and ("k", "a", 0) in plain


def test_profile_metadata_comes_back_whole(spark):
    from assay.sources.profile_io import load_profile_metadata
    flat = spark.createDataFrame([], "category string, metric string, value double, ci_lower double, ci_upper double, metric_type string, "
                                     "test_paired string, test_unpaired string, reference_mean double, reference_std double, sample_count long")
    doc = profile_document(flat, created_at="2024", benchmark="b", reference_models=["m1", "m2"], reference_run_ids=[], total_sessions=7,
                           bootstrap_b=1000, seed=3, percentile=10, alpha=0.01, version="2.0.0")
    path = os.path.join(tempfile.mkdtemp(prefix="assay-test-"), "profile")
    save_profile(doc, path)
    m = load_profile_metadata(spark, path).first().asDict()
    assert m == {"version": "2.0.0", "created_at": "2024", "benchmark": "b", "reference_models": ["m1", "m2"], "reference_run_ids": [],
                 "total_sessions": 7, "bootstrap_b": 1000, "bootstrap_seed": 3, "threshold_percentile": 10, "alpha": 0.01,
                 "correction_method": "benjamini-hochberg"}
    assert load_profile(spark, path).count() == 0
    assert load_profile_metadata(spark, path + "-missing") is None


def test_pipeline_without_a_profile_has_no_statistical_verdict(spark):
    from assay.plans.pipeline_plans import STATISTICAL_COLUMNS, run_pipeline
    for path in (None, "/tmp/assay-no-such-profile"):
        out = run_pipeline(spark, "/root/testdata/sf0.001", path)
        first = out.first()
        assert first["verdict"] and all(first[c] is None for c in STATISTICAL_COLUMNS)


def test_pipeline_scores_the_texts_once(spark, tmp_path, monkeypatch):
    from assay.plans import pipeline_plans as pp
    from assay.plans import qa_plans as qp
    from assay.plans import verdict_plans as vp
    texts = ["I cannot answer this. Perhaps later. Ask again.", "The river runs to the sea. It is long. Boats go there.", None]
    docs = [(i, texts[i % 3], "en", f"src{i % 4}", 10) for i in range(48)]
    for name, data, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
                               ("labels", [(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int"),
                               ("benchmark", [(0, "Where does the river run?"), (1, "Who answers?")], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    calls, scored_qa = [], qp.scored_qa

    def counted(spark, sf_dir):
        calls.append(sf_dir)
        return scored_qa(spark, sf_dir)

    for module in (qp, vp):
        monkeypatch.setattr(module, "scored_qa", counted)
    out = pp.pipeline_query(spark, str(tmp_path))
    assert calls == [str(tmp_path)]
    assert "documents.parquet" not in out._jdf.queryExecution().toString()  # nor read again when the verdicts are
    got = {r["model"]: r for r in rows(out)}
    rule = {r["model"]: r for r in rows(qp.qa_verdict_query(spark, str(tmp_path)))}
    assert set(got) == {f"src{i}" for i in range(4)}
    assert {m: {c: r[c] for c in rule[m]} for m, r in got.items()} == rule
    assert all(r["statistical_verdict"] and r["profile_version"] == "1.0.0" for r in got.values())
