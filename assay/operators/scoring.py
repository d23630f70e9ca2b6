"""Response-level scoring: tokenise once, compute every column scorer.

All metrics here are Catalyst expressions over token arrays kept as columns
(one projection, whole-stage codegen, no shuffle). The lexicon scorers add one
shuffle of lexicon *hits* only (see ``lexicon_scores``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.classify import classify_failure_mode
from assay.functions.lexicon import LEXICON_SCHEMA
from assay.functions.lexicon_inline import lexicon_inline
from assay.functions.overlap import question_response_overlap, response_length_ratio, token_overlap_f1
from assay.functions.tokens import tokens, words
from assay.operators.lexicon_scores import fill_lexicon_defaults, lexicon_flags


def with_tokens(df: DataFrame, **cols: str) -> DataFrame:
    """Add ``<name>_tok`` token arrays for each ``name=text_column``."""
    return df.withColumns({f"{k}_tok": tokens(v) for k, v in cols.items()})


def score_text_metrics(df: DataFrame, response="response", reference="reference",
                       question: str | None = "question") -> DataFrame:
    """H2, H3, H4 as columns (token arrays are dropped afterwards)."""
    cols = {"r": response, "f": reference}
    if question:
        cols["q"] = question
    t = with_tokens(df, **cols)
    out = {
        "token_overlap_f1": token_overlap_f1("r_tok", "f_tok"),
        "response_length_ratio": response_length_ratio("r_tok", "f_tok"),
    }
    if question:
        out["question_response_overlap"] = question_response_overlap("r_tok", "q_tok")
    return t.withColumns(out).drop(*[f"{k}_tok" for k in cols])


def score_responses(df: DataFrame, keys: list[str], lexicon,
                    response="response", reference="reference", question="question",
                    category="category", inline: bool = False) -> DataFrame:
    """Column scorers + lexicon scorers + failure mode for every response row.

    ``lexicon`` is a lexicon DataFrame or a list of ``(language, role, stem, word)`` rows.
    By default the lexicon scorers run as the exploded hit plan (one shuffle of
    lexicon hits). ``inline=True`` (lexicon rows only) evaluates them per
    row with array functions and no shuffle; it gives the same results but was
    about 3x slower locally at sf0.1 (higher-order functions are interpreted).
    """
    scored = score_text_metrics(df, response, reference, question)
    if inline:
        if not isinstance(lexicon, list):
            raise ValueError("inline lexicon scoring needs lexicon rows")
        # the word array is a column of its own, read (not recomputed) by the lambdas
        out = (scored.withColumn("_words", words(response))
               .withColumn("_lx", lexicon_inline("_words", lexicon))
               .select("*", "_lx.*").drop("_lx", "_words"))
    else:
        if isinstance(lexicon, list):
            lexicon = df.sparkSession.createDataFrame(lexicon, LEXICON_SCHEMA)
        flags = lexicon_flags(df, keys, response, lexicon)
        out = fill_lexicon_defaults(scored.join(flags, keys, "left"))
    return out.withColumn(
        "failure_mode",
        classify_failure_mode("refusal_detection", "token_overlap_f1", "hedging_detection", category),
    )
