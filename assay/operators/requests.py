"""K1-K5 batch-response data work, C9 cache lookup, E3 attempt numbering, D21 hit/miss
counts, D18 token-usage sums, K5 upsert.

No network client ships here: K3 takes a user ``responder(pdf) -> pdf`` that
runs in ``mapInPandas`` on the misses only.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.text import cache_key, knowledge_content, prompt_hash, render_prompt
from assay.operators.session_scores import fan_out


def build_requests(records: DataFrame, model: str, k: int) -> DataFrame:
    """K1 — k requests per record: rendered prompt (H16), knowledge text (H17) and the
    cache key (H18); attempts 0..k-1 by fan-out (C8)."""
    r = records.withColumn("prompt", render_prompt("name", "adjective", "occupation", "chatbot_goal",
                                                   "instructions", "language", "classes"))
    r = r.withColumns({
        "knowledge": knowledge_content(F.transform("chunks_big", lambda c: c["content"])),
        "prompt_hash": prompt_hash("prompt"),
        "model": F.lit(model),
    })
    r = r.withColumn("cache_key", cache_key(F.col("id"), F.col("model"), F.col("prompt_hash")))
    return fan_out(r, k)


def number_attempts(cache: DataFrame, key_col: str = "cache_key", order_cols=("created_at", "trace_id"),
                    hot_rows: int | None = None) -> DataFrame:
    """E3 — attempt = row_number per key in arrival order - 1 (hot keys are split, see
    ``skew.number_within``)."""
    from assay.operators.skew import DEFAULT_HOT_ROWS, number_within
    out = number_within(cache, [key_col], list(order_cols), rn_col="_rn", hot_rows=hot_rows or DEFAULT_HOT_ROWS)
    return out.withColumn("attempt", F.col("_rn") - 1).drop("_rn")


def resolve_cache(requests: DataFrame, cache: DataFrame, key_col: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """C9/K2 — the n-th attempt of a key is served by the n-th cached response.
    Returns (hits, misses); misses are the requests left to run (left_anti)."""
    c = cache.select(key_col, "attempt", "output_text")
    hits = requests.join(c, [key_col, "attempt"], "inner")
    misses = requests.join(c, [key_col, "attempt"], "left_anti")
    return hits, misses


def cache_counts(requests: DataFrame, cache: DataFrame, key_col: str = "cache_key") -> DataFrame:
    """D21 — hit and miss counts of a request table against the cache (one row)."""
    c = cache.select(key_col, "attempt").withColumn("_hit", F.lit(True))
    j = requests.join(c, [key_col, "attempt"], "left")
    return j.agg(F.count_if(F.col("_hit").isNotNull()).alias("hits"),
                 F.count_if(F.col("_hit").isNull()).alias("misses"))


def respond(misses: DataFrame, responder: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """K3 — apply a user responder to the misses in Arrow batches; rows whose
    ``error`` column is set are dropped (a failed attempt)."""
    def run(batches):
        for pdf in batches:
            out = responder(pdf)
            if "error" in out.columns:
                out = out[out["error"].isna()]
            yield out
    return misses.mapInPandas(run, schema)


def assemble_sessions(responses: DataFrame, keys: list[str]) -> DataFrame:
    """K4 — attempts grouped per record as a sorted array (only where nesting is needed;
    the group is one record's k attempts)."""
    return responses.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("attempt", "output_text"))).alias("traces"),
        F.count(F.lit(1)).alias("n_traces"))


def upsert_latest(current: DataFrame, updates: DataFrame, id_col: str = "id", version_col: str = "version") -> DataFrame:
    """K5 — dataset registration as upsert by identity: keep the latest version per id."""
    u = current.unionByName(updates, allowMissingColumns=True)
    others = [c for c in u.columns if c != id_col]
    # max_by is partial-aggregated: an id with very many versions is reduced map-side
    return u.groupBy(id_col).agg(F.max_by(F.struct(*others), F.col(version_col)).alias("_r")) \
        .select(id_col, "_r.*")


def token_usage(calls: DataFrame, trace_col: str = "trace_id") -> DataFrame:
    """D18 — token usage of a response = sum over its calls."""
    return calls.groupBy(trace_col).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"))
