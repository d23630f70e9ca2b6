"""H5 — ROUGE-L (LCS F1 over token sequences) as an Arrow UDF.

The longest common subsequence uses the bit-parallel recurrence of
Allison & Dix (1986) / Hyyrö (2004): one machine-word operation per 64
positions of the first sequence for every token of the second, i.e.
O(n * m / 64) instead of the O(n * m) cell-by-cell dynamic program, with
Python's arbitrary-precision integers as the bit vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two token sequences."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for tok in b:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def rouge_l_value(resp, ref) -> float:
    n, m = (0 if resp is None else len(resp)), (0 if ref is None else len(ref))
    if n == 0 or m == 0:
        return 0.0
    lcs = lcs_length(resp, ref)
    if lcs == 0:
        return 0.0
    p, r = lcs / n, lcs / m
    return round(2 * p * r / (p + r), 4)


#: Tokens (of both sides) that a worker holds as Python numbers at a time; a longer pair stands alone.
PART_TOKENS = 500_000


def _codes(a: pa.Array, b: pa.Array) -> Iterator[tuple[list[int], list[int]]]:
    """The token sequences of each pair as numbers, equal for equal tokens of a slice; a
    null sequence is empty, a null token equals a null token."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    part = np.cumsum(sizes[0] + sizes[1]) // PART_TOKENS
    cuts = np.flatnonzero(np.diff(part)) + 1
    for low, high in zip([0, *cuts], [*cuts, len(a)], strict=True):
        if low == high:
            continue
        flat = [x.slice(low, high - low).flatten() for x in (a, b)]
        code = pa.concat_arrays(flat).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        first, second = code[:len(flat[0])], code[len(flat[0]):]
        ends = [np.cumsum(n[low:high]) for n in sizes]
        for i in range(high - low):
            (p, q), (r, s) = ((e[i] - n[low + i], e[i]) for e, n in zip(ends, sizes, strict=True))
            yield first[p:q].tolist(), second[r:s].tolist()


@F.arrow_udf(DoubleType())
def rouge_l(response_tokens: pa.Array, reference_tokens: pa.Array) -> pa.Array:
    """ROUGE-L F1 of two ``array<string>`` token columns, rounded to 4 decimals. Only numbers
    of tokens become Python objects, a bounded slice at a time."""
    out = pa.array([rouge_l_value(a, b) for a, b in _codes(response_tokens, reference_tokens)], pa.float64())
    pa.default_memory_pool().release_unused()
    return out
