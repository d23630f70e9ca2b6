"""Join helpers (C-family) with explicit, checked broadcast decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only if it has at most this many rows (checked by a
# bounded ``limit(n+1).count()`` action); otherwise the join is left to the
# planner (sort-merge, with AQE's skew-join splitting).
DEFAULT_BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Return ``broadcast(df)`` when ``df`` has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows, so its cost is bounded even
    when the side turns out to be large.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def fixed_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a parameter table whose size is fixed by code (lexicons,
    critical-metric sets, metric registries) — never data-derived."""
    return F.broadcast(df)


def inner_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """C1/C2 — plain equi-join; AQE picks broadcast vs sort-merge at runtime."""
    return left.join(right, keys, "inner")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """C4 warning side — rows of ``left`` with no partner (left_anti)."""
    return left.join(right, keys, "left_anti")
