"""M1-M5 — scorer registry: named Column scorers with a metric type and the
columns they need.

A scorer is ``Scorer(name, metric_type, needs, fn)`` where ``fn`` maps the
needed Columns to one Column. ``apply_scorers`` adds the selected scorers as
columns, skipping a scorer whose inputs are missing (the reference passes
expectations only to scorers that accept them). Users register their own
Column functions or pandas UDFs the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.overlap import question_response_overlap, response_length_ratio, token_overlap_f1
from assay.functions.text import class_exact_match, groundedness
from assay.functions.tokens import tokens


@dataclass(frozen=True)
class Scorer:
    name: str
    metric_type: str                 # continuous | binary | composite
    needs: tuple[str, ...]           # input columns
    fn: Callable[..., Column]
    deterministic: bool = True       # False for ingested judge scores


def _tok(c):
    return tokens(c)


DEFAULT_SCORERS: dict[str, Scorer] = {s.name: s for s in [
    Scorer("token_overlap_f1", "continuous", ("response", "reference"),
           lambda r, f: token_overlap_f1(_tok(r), _tok(f))),
    Scorer("question_response_overlap", "continuous", ("response", "question"),
           lambda r, q: question_response_overlap(_tok(r), _tok(q))),
    Scorer("response_length_ratio", "continuous", ("response", "reference"),
           lambda r, f: response_length_ratio(_tok(r), _tok(f))),
    Scorer("class_exact_match", "binary", ("response", "classes", "chosen_class_id"),
           lambda r, c, i: class_exact_match(r, c, i)),
    Scorer("groundedness", "continuous", ("groundedness_raw",), lambda g: groundedness(g), deterministic=False),
]}


def register(registry: dict[str, Scorer], scorer: Scorer) -> dict[str, Scorer]:
    """Return a new registry with ``scorer`` added (or replaced)."""
    out = dict(registry)
    out[scorer.name] = scorer
    return out


def select_scorers(registry: dict[str, Scorer], deterministic_only: bool = True,
                   names: list[str] | None = None) -> list[Scorer]:
    """M4 — the scorer set: deterministic only, or with the judge-ingested ones."""
    chosen = [s for s in registry.values() if s.deterministic or not deterministic_only]
    return [s for s in chosen if names is None or s.name in names]


def apply_scorers(df: DataFrame, scorers: list[Scorer]) -> DataFrame:
    """M1/M3 — add one column per scorer whose inputs exist in ``df``."""
    cols = {s.name: s.fn(*[F.col(c) for c in s.needs]) for s in scorers if all(c in df.columns for c in s.needs)}
    return df.withColumns(cols)
