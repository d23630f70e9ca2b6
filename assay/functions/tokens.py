"""H1 — tokenisation as Column expressions (JVM side, codegen'd).

The token unit is a regex word/punctuation split: runs of letters/digits, or
a single non-space symbol. It is case-sensitive. This is a declared deviation
from a byte-pair encoder: metric formulas are the same, absolute values differ.
The same pattern runs unchanged in DuckDB (RE2), which is what the oracle SQL
uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: token pattern (shared with the oracle SQL)
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"

# Word tokenisation for the lexicon scorers (refusal / hedging). Contractions
# are split the way a Treebank tokenizer does ("don't" -> "do", "n't";
# "cannot" -> "can", "not"; "I'm" -> "I", "'m"); words are then lower-cased.
# Hyphenated words and numbers with inner points or commas are one word each.
WORD_PATTERN = (r"n't|'[\p{L}]+|\p{N}+(?:[.,:]\p{N}+)+|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
                r"|[^\p{L}\p{N}\s]")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """array<string> of tokens; NULL text is treated as the empty string."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TOKEN_PATTERN), 0)


def token_count(text) -> Column:
    return F.size(tokens(text))


def words(text) -> Column:
    """Lower-cased word tokens with contraction splitting (for lexicon scorers)."""
    t = F.coalesce(_c(text), F.lit(""))
    t = F.regexp_replace(t, r"(?i)\b(can)(not)\b", "$1 $2")
    t = F.regexp_replace(t, r"(?i)(\p{L})(n't)\b", "$1 $2")
    t = F.regexp_replace(t, r"(?i)(\p{L})('(?:s|m|d|ll|re|ve))\b", "$1 $2")
    return F.regexp_extract_all(F.lower(t), F.lit(WORD_PATTERN), 0)
