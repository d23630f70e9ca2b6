"""Driver contract: entry(), queries() and oracle_sql(); oracle comparison on sf0.001."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from assay.sources.tables import TABLES, table_path
from conftest import SF0001


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "verdict" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _digest(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in data)).encode()).hexdigest()


CHEAP = ["qa_verdict", "qa_scores", "qa_breakdown", "pass_at_k", "self_consistency", "chunk_attribution",
         "wilcoxon_stats", "mannwhitney_stats", "chi2_stats", "mcnemar_stats", "bh_fdr", "descriptive_stats",
         "weighted_sample", "class_match", "prompts", "cache_counts", "sankey_edges", "complexity_bins"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF0001, t)}')")
    return c


@pytest.mark.parametrize("name", CHEAP)
def test_oracle_matches(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    exp = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(exp)
    assert _digest(df.columns, got) == _digest(rel.columns, exp)
