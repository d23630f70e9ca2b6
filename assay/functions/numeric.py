"""Numeric helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c, digits: int = 4) -> Column:
    """Round half away from zero on the binary value: ``round(x * 10^d) / 10^d``.

    Spark's ``round`` rounds the shortest decimal string of the double, so a
    mean of 0.04115 (binary 0.0411499999...) becomes 0.0412, where Python's
    ``round`` and DuckDB give 0.0411. Scaling first keeps the binary value.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.round(c * F.lit(scale), 0) / F.lit(scale)


def round_even(c, digits: int = 4) -> Column:
    """Scores and means as the scorers report them: exact ties (0.40625 at four
    digits) go to the even neighbour, as Python's ``round`` takes them."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.bround(c * F.lit(scale), 0) / F.lit(scale)


def round_even_sql(x: str, digits: int = 4) -> str:
    p = f"(({x}) * {float(10 ** digits)})"
    return f"(CASE WHEN {p} - floor({p}) = 0.5 THEN 2 * round({p} / 2) ELSE round({p}) END / {float(10 ** digits)})"


def _q(value) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.round(v * F.lit(10000.0), 0).cast("long")


def fixed_mean(value) -> Column:
    """Aggregate: mean of 4-decimal scores, summed exactly in ten-thousandths.

    Scorer values are rounded to 4 decimals, so ``round(x * 1e4)`` is exact and
    the integer sum does not depend on partitioning or summation order.
    """
    q = _q(value)
    return F.sum(q.cast("decimal(19,0)")).cast("double") / F.nullif(F.count(q), F.lit(0)) / F.lit(10000.0)


def fixed_var_pop(value) -> Column:
    """Aggregate: population variance of 4-decimal scores from exact integer sums."""
    q = _q(value)
    n = F.count(q)
    d = q.cast("decimal(19,0)")  # a product or sum of longs could leave 64 bits
    s1, s2 = F.sum(d).cast("decimal(38,0)"), F.sum(d * d).cast("decimal(38,0)")
    num = (s2 * n.cast("decimal(20,0)") - s1 * s1).cast("double")
    return num / (n.cast("double") * n.cast("double")) / F.lit(1e8)


# DuckDB spelling of the two aggregates (same integer arithmetic)
def fixed_mean_sql(v: str) -> str:
    return f"(sum(CAST(round({v} * 10000.0) AS BIGINT)) / count({v}) / 10000.0)"


def fixed_var_pop_sql(v: str) -> str:
    q = f"CAST(round({v} * 10000.0) AS BIGINT)"
    return (f"(CAST(sum(CAST({q} AS HUGEINT) * {q}) * count({v}) - sum({q}) * sum({q}) AS DOUBLE)"
            f" / (CAST(count({v}) AS DOUBLE) * CAST(count({v}) AS DOUBLE)) / 1e8)")
