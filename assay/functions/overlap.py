"""H2-H4, H10 pair metric — token-set overlap metrics as Column expressions.

Every function takes token arrays (see ``tokens.tokens``) so a caller can
tokenise once, keep the arrays as columns and feed several metrics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.numeric import round_even


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def set_f1(a_tokens, b_tokens, digits: int = 4, distinct_inputs: bool = False) -> Column:
    """Set precision/recall F1 of two token arrays.

    0.0 when either side is empty or nothing overlaps; else rounded F1.
    Arithmetic order is 2*(p*r)/(p+r). With ``distinct_inputs=True`` the arrays
    are already de-duplicated (done once per side before a pairwise join).
    """
    da = _c(a_tokens) if distinct_inputs else F.array_distinct(_c(a_tokens))
    db = _c(b_tokens) if distinct_inputs else F.array_distinct(_c(b_tokens))
    return f1_of_sizes(F.size(F.array_intersect(da, db)), F.size(da), F.size(db), digits)


def f1_of_sizes(common, a_size, b_size, digits: int = 4) -> Column:
    """The same F1 from the sizes of two sets and of their intersection (null: none)."""
    inter, na, nb = F.coalesce(_c(common), F.lit(0)), _c(a_size), _c(b_size)
    p = F.try_divide(inter, na)
    r = F.try_divide(inter, nb)
    f1 = F.try_divide(F.lit(2.0) * (p * r), p + r)
    return (F.when((na == 0) | (nb == 0) | (inter == 0), F.lit(0.0))
            .otherwise(round_even(f1, digits)))


def token_overlap_f1(response_tokens, reference_tokens) -> Column:
    """H2."""
    return set_f1(response_tokens, reference_tokens)


def question_response_overlap(response_tokens, question_tokens) -> Column:
    """H3 — same formula against the question."""
    return set_f1(response_tokens, question_tokens)


def response_length_ratio(response_tokens, reference_tokens) -> Column:
    """H4 — token-list length ratio; NULL when the reference has no tokens."""
    ref_n = F.size(_c(reference_tokens))
    return F.when(ref_n == 0, F.lit(None).cast("double")).otherwise(
        round_even(F.size(_c(response_tokens)) / ref_n, 4))
