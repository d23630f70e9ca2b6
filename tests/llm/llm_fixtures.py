"""Fixtures of the operators' tests; ``spark`` comes from the folder above."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


#: Null, empty and very long texts, ties, repeated rows, copies that differ in case.
EDGE = [(1, None, "en"), (2, "", None), (3, "   \n\t ", "en"), (4, "One two THREE", "en"), (5, "one TWO three", None),
        (5, "one TWO three", "de"), (6, "É One two", "fr"), (7, "é one two", "fr"), (8, "x" * 70_000, "en"),
        (9, "X" * 70_000, "en"), (10, "word " * 9_000, "de"), (None, "no id at all here it is", "en"),
        (11, " ".join(f"w{i}" for i in range(60)), "es"), (12, " ".join(f"w{i}" for i in range(60)) + " end", "es"),
        (13, "start " + " ".join(f"w{i}" for i in range(20, 45)) + " stop", "es"), (14, "123 456 !!", "en")]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge cases, with extra columns whose names the operators use inside."""
    rows = [(i, t, lang, "s", 0, 7, "k", 3) for i, t, lang in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, name string, block int")


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
