"""H14, H15, M6 — scorers and judges that may fail, one cell at a time.

A scorer of the user's is a Python function over one record's ``inputs``, ``outputs`` and
(if it takes them) ``expectations``; a groundedness judge is a function of (source, statement).
Both run in Arrow batches on the executors. What goes wrong with one record stays in that
record's cell: an exception becomes the cell's error, other scorers and rows are not
touched and no task fails.

Rules of a cell (``struct<value double, error string>``):

* a plain result is the value; booleans are 1 and 0, ``None`` counts as 0.0;
* ``NotApplicable(reason)`` leaves the value null and is no failure: the reason is kept
  as the error, and the score is counted nowhere;
* an exception, or a result that is no number, leaves the value null with the exception's
  text as the error: the score is dropped.

A judge's cell is ``struct<score double, reason string>``: null counts as 0.0, scores are
clamped to 0..1 and rounded to four places; a failure is the score 0.0 with the reason
``scoring_error``. Rows without a source are not judged (null cell).
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.text import judge_feedback

CELL = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("error", T.StringType())])
JUDGED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("reason", T.StringType())])
# fixed value: reason of a judge that failed
JUDGE_FAILED = "scoring_error"
#: Characters of an exception's text that a cell keeps.
ERROR_LENGTH = 500


@dataclass(frozen=True)
class NotApplicable:
    """A scorer's answer where its metric has no meaning (no reference, no chunks ...)."""

    reason: str


def cell(fn: Callable, kwargs: dict) -> tuple[float | None, str | None]:
    """(value, error) of one call."""
    try:
        result = fn(**kwargs)
        if isinstance(result, NotApplicable):
            return None, result.reason
        return 0.0 if result is None else float(result), None
    except Exception as e:  # noqa: BLE001 - whatever a user's scorer raises stays in its cell
        return None, f"{type(e).__name__}: {e}"[:ERROR_LENGTH]


def _takes_expectations(fn: Callable) -> bool:
    return "expectations" in inspect.signature(fn).parameters


def isolated(fn: Callable) -> Callable[[Column, Column, Column], Column]:
    """A Column function of (inputs, outputs, expectations) structs that gives ``fn``'s cells."""
    wants = _takes_expectations(fn)

    @F.arrow_udf(CELL)
    def run(inputs: pa.Array, outputs: pa.Array, expectations: pa.Array) -> pa.Array:
        rows = zip(inputs.to_pylist(), outputs.to_pylist(), expectations.to_pylist() if wants else [None] * len(inputs), strict=True)
        found = [cell(fn, {"inputs": i or {}, "outputs": o or {}} | ({"expectations": e or {}} if wants else {})) for i, o, e in rows]
        return pa.StructArray.from_arrays([pa.array([v for v, _ in found], pa.float64()), pa.array([e for _, e in found], pa.string())], ["value", "error"])

    nothing = F.lit(True)  # a scorer that takes no expectations is sent none
    return lambda i, o, e: run(i, o, e if wants else nothing)


def score_isolated(records: DataFrame, scorers: dict[str, Callable | Column], *, inputs: str = "inputs", outputs: str = "outputs",
                   expectations: str = "expectations") -> DataFrame:
    """``records`` with one cell column for each scorer: a Python function (see the module), or
    a Column, whose null is a value of 0.0 as a plain result of None is."""
    cells = {}
    for name, scorer in scorers.items():
        if isinstance(scorer, Column):
            cells[name] = F.struct(F.coalesce(scorer.cast("double"), F.lit(0.0)).alias("value"), F.lit(None).cast("string").alias("error"))
        else:
            cells[name] = isolated(scorer)(F.col(inputs), F.col(outputs), F.col(expectations))
    return records.withColumns(cells)


def scores_of(scored: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys..., scorer_name, value) of the cells that hold a value."""
    return _cells(scored, keys, names).filter("cell.value is not null").select(*keys, "scorer_name", F.col("cell.value").alias("value"))


def failures_of(scored: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys..., scorer_name, error) of the cells without a value."""
    return _cells(scored, keys, names).filter("cell.value is null").select(*keys, "scorer_name", F.col("cell.error").alias("error"))


def _cells(scored: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scorer_name"), F.col(n).alias("cell")) for n in names])).alias("_each")
    return scored.select(*keys, each).select(*keys, "_each.scorer_name", "_each.cell")


def judged_cell(raw: Column) -> Column:
    """H14 — the cell of an ingested judge answer (text): yes and no are 1 and 0, other
    text 0.0, and no answer is not applicable (B16)."""
    value = judge_feedback(raw)
    return F.struct(value.alias("value"), F.when(value.isNull(), F.lit("N/A: no judge answer")).alias("error"))


def judge_result(fn: Callable, source: str | None, statement: str | None) -> tuple[float, str] | None:
    """(score, reason) of one pair."""
    if not source:
        return None
    try:
        score, reason = fn(source, statement or "")
        score = 0.0 if score is None else float(score)
        if math.isnan(score):
            raise ValueError("not a number")
        return round(min(1.0, max(0.0, score)), 4), str(reason)
    except Exception:  # noqa: BLE001 - whatever a user's judge raises stays in its cell
        return 0.0, JUDGE_FAILED


def groundedness_port(open_judge: Callable[[], Callable]) -> Callable[[Column, Column], Column]:
    """M6 — a Column function of (source, statement) that gives ``struct<score, reason>``.

    ``open_judge()`` gives the judge; it is called once for each task (a model or a client is
    loaded there), then the judge is called pair by pair over Arrow batches. If it can't
    be opened, every pair of the task is a failure of its own.
    """
    @F.arrow_udf(JUDGED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            judge = open_judge()
        except Exception:  # noqa: BLE001
            judge = None
        for source, statement in batches:
            found = [judge_result(judge, s, t) for s, t in zip(source.to_pylist(), statement.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array([None if f is None else f[0] for f in found], pa.float64()), pa.array([None if f is None else f[1] for f in found], pa.string())],
                ["score", "reason"], mask=pa.array([f is None for f in found]))

    # a judge may be a model: it is called once a row, wherever its cell is used
    return run.asNondeterministic()
