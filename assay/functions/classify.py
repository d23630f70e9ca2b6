"""H12 — failure-mode classification as one nested CASE (first match wins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: failure modes
FAILURE_MODES = ("correct_extraction", "correct_refusal", "false_refusal", "hallucination",
                 "hedging_answer", "off_topic", "partial_answer")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def classify_failure_mode(refusal, overlap_f1, hedging, category) -> Column:
    """Decision table (strict inequalities; a missing F1 counts as 0.0,
    a missing refusal/hedging flag as false)."""
    is_ref = F.coalesce(_c(refusal), F.lit(False))
    is_hedge = F.coalesce(_c(hedging), F.lit(False))
    f1 = F.coalesce(_c(overlap_f1).cast("double"), F.lit(0.0))
    cat = _c(category)
    return (F.when(is_ref & (cat == "positivo"), "false_refusal")
            .when(is_ref & (cat == "negativo"), "correct_refusal")
            .when((f1 > 0.5) & (cat == "positivo"), "correct_extraction")
            .when((f1 > 0.3) & (cat == "negativo"), "hallucination")
            .when((f1 < 0.1) & ~is_ref, "off_topic")
            .when(is_hedge & (cat == "positivo"), "hedging_answer")
            .otherwise("partial_answer"))


FAILURE_MODE_SQL = """CASE
    WHEN coalesce({ref}, false) AND {cat} = 'positivo' THEN 'false_refusal'
    WHEN coalesce({ref}, false) AND {cat} = 'negativo' THEN 'correct_refusal'
    WHEN coalesce({f1}, 0.0) > 0.5 AND {cat} = 'positivo' THEN 'correct_extraction'
    WHEN coalesce({f1}, 0.0) > 0.3 AND {cat} = 'negativo' THEN 'hallucination'
    WHEN coalesce({f1}, 0.0) < 0.1 AND NOT coalesce({ref}, false) THEN 'off_topic'
    WHEN coalesce({hedge}, false) AND {cat} = 'positivo' THEN 'hedging_answer'
    ELSE 'partial_answer' END"""
