"""The corpus pipeline against its stages done by brute force."""

from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as C
from assay.llm import language_id
from llm_fixtures import documents, edge, nothing  # noqa: F401
from llm_brute import brute_dedup, brute_groups, brute_passages

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "", "en", "s", 0), (-3, "12 34 !!", "en", "s", 8)], docs.schema)
    first = C.STAGES[0][1](spark, docs.unionByName(extra), SF)
    assert first.count() == docs.count() and first.columns == docs.columns
    now = docs
    for (name, stage), brute in zip(C.STAGES[1:4], ("dedup", "groups", "passages"), strict=True):
        before = [(r.doc_id, r.text) for r in now.collect()]
        after = stage(spark, now, SF).persist()
        got = {r.doc_id: r.text for r in after.collect()}
        if brute == "dedup":
            want = {i: t for i, t in before if (i, i) in {(x[0], x[1]) for x in brute_dedup(before)}}
        elif brute == "groups":
            want = {i: t for i, t in before if (i, i) in {(x[0], x[2]) for x in brute_groups(before)}}
        else:
            lost = {x[0]: x for x in brute_passages(before)}
            assert set(got) == {i for i, _ in before if not 0 < lost[i][1] == lost[i][2]}
            want = {i: t if lost[i][2] == 0 else got[i] for i, t in before if i in got}
            assert all(len(got[i].split()) == lost[i][1] - lost[i][2] for i in got)
        assert got == want and after.columns == docs.columns, name
        now = after
    packed = C.STAGES[4][1](spark, now, SF)
    assert packed.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("ok")).filter("not ok").count() == 0
    whole = E.queries()["pipeline"](spark, SF)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert whole.select("doc_id").distinct().count() == now.count() and set(cols) <= set(whole.columns)


def test_rows_without_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "no id", "en", "s", 5, 1), (7, "Same text", "en", "s", 9, 1), (7, "Same text", "en", "s", 9, 1),
                                  (8, "same TEXT", "en", "s", 9, 2)], "doc_id long, text string, lang string, source string, n_chars long, block long")
    net = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert language_id.with_language(docs, net).count() == 4
    for _, stage in C.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out
    assert sorted((r.doc_id is None, r.doc_id) for r in docs.collect() if r.doc_id) == [(False, 8)] and docs.count() == 2
    empty = docs.limit(0)
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in C.STAGES[1:])


def test_language_stage(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    held_out = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.col("lang")))
    for some in (unlabelled, held_out):  # nothing to learn from
        assert C.keep_languages(spark, some, SF).count() == docs.count()
    net = language_id.fit(docs)
    told = {r.doc_id: (r.lang_pred, r.score) for r in language_id.with_language(docs, net).collect()}
    monkeypatch.setattr(C, "OVER_CHANCE", 2.0)
    want = {i for i, (_, score) in told.items() if score > 2 / len(net.labels)}
    assert {r.doc_id for r in C.keep_languages(spark, docs, SF).collect()} == want and 0 < len(want) < len(told)
    want = {i for i in want if told[i][0] == "en"}
    assert {r.doc_id for r in C.keep_languages(spark, docs, SF, ("en",)).collect()} == want and want


def test_every_label_is_learned(spark):
    rows = [(3 * i, f"{chr(97 + i % 26) * 4} {chr(97 + i // 26) * 4} words of {i}", f"l{i // 3:03d}") for i in range(300)]
    labelled = spark.createDataFrame([*rows, (901, "   ", "blank"), (903, " ", "blank")], "doc_id long, text string, lang string")
    want = {r.lang for r in labelled.filter(~language_id.held_out(F.col("doc_id"))).collect()} - {"blank"}
    assert len(want) > 64 and set(language_id.training_windows(labelled)[2]) == want


def test_near_copies_of_repeated_ids(spark):
    near = [f"the same {k} " + " ".join(f"w{i}" for i in range(60)) for k in range(3)]
    rows = [(1, near[0]), (5, near[1]), (5, "a text of its own that links with no other one"),  # unlike texts of one id
            (9, "x " + " ".join(f"v{i}" for i in range(60))), (9, "y " + " ".join(f"v{i}" for i in range(60))),  # near copies
            (12, "one text and its copy again in full"), (12, "one text and its copy again in full"),
            (None, near[2]), (None, None), (20, None), (20, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, block long")
    out = C.drop_near_copies(spark, docs, SF)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns
    nines = [x for x in got if x[0] == 9]
    assert len(nines) == 1 and nines[0] in rows
    assert sorted(x for x in map(repr, got) if not x.startswith("(9")) == sorted(
        map(repr, [rows[0], rows[2], rows[5], rows[7], rows[8], rows[9], rows[10]]))


def test_told_language_reaches_the_windows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = {r.doc_id: r.lang_pred for r in language_id.with_language(docs, language_id.fit(docs)).collect()}
    # a wrong label of a held-out row, and one without a label
    wrong = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.when(F.col("doc_id") % 2 == 0, "xx")).otherwise(F.col("lang")))
    kept = C.keep_languages(spark, wrong, SF).persist()
    assert {r.doc_id: r.lang for r in kept.collect()} == told and kept.columns == docs.columns
    pieces = C.pack(spark, kept, SF).collect()
    held, filled = {}, {}
    for r in pieces:
        held.setdefault(r.sequence_id, set()).add(told[r.doc_id])
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(set(told.values())) > 1 and all(len(x) == 1 for x in held.values())
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
    for x in filled.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:])) and min(x)[0] == 0 and sum(n for _, n in x) <= 2048
