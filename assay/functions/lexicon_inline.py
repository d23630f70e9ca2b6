"""H7/H8 per row, for a lexicon fixed in code: no explode, no shuffle.

For each language the positions of each role's words are found with
``filter(sequence(0, n-1), i -> array_contains(role_words, w[i]))`` (the role
arrays are literals of a few entries). The proximity rules become set
operations on positions:

* refusal fires if a self-negating word occurs, or if a negation position lies in
  the capability positions dilated by ±4: ``arrays_overlap(neg, dilate(cap, 4))``;
* a hedging verb counts if its position lies in the subject positions dilated by
  ±3: ``array_intersect(verb, dilate(subj, 3))``.

``arrays_overlap``/``array_intersect`` are hash based, so the cost is linear in
the number of words. Results equal the exploded/windowed plan of
``operators.lexicon_scores`` (tested).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.lexicon import HEDGING_WINDOW, LANGUAGES, REFUSAL_WINDOW


def _roles(rows) -> dict[tuple[str, str], list[str]]:
    out: dict[tuple[str, str], list[str]] = {}
    for lang, role, _, word in rows:
        out.setdefault((lang, role), []).append(word)
    return out


def _stem_of(rows, lang: str) -> Column:
    pairs = {word: stem for row_lang, _, stem, word in rows if row_lang == lang}
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lexicon_inline(words_col: str, lexicon_rows) -> Column:
    """struct<refusal_detection, refusal_language, hedging_detection, hedging_count, hedging_matches>.

    ``words_col`` names a column that already holds the word array
    (``tokens.words(text)``): higher-order functions evaluate outer expressions
    inside every lambda call, so the array must be a plain column reference.
    """
    roles = _roles(lexicon_rows)
    w = F.col(words_col)
    n = F.size(w)
    # sequence(0, n-1) counts down to [0, -1] for an empty text: keep 0 <= i < n only
    idx = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i >= 0) & (i < n))

    def positions(lang, role):
        vals = roles.get((lang, role), [])
        if not vals:
            return F.array().cast("array<int>")
        arr = _lit_array(vals)
        return F.filter(idx, lambda i: F.array_contains(arr, F.get(w, i)))

    def dilate(pos, k):
        return F.flatten(F.transform(pos, lambda j: F.sequence(j - k, j + k)))

    fires = []
    hedge_parts = []
    counts = []
    for lang in LANGUAGES:
        stem_of = _stem_of(lexicon_rows, lang)
        sn = roles.get((lang, "self_negating"), [])
        self_neg = F.exists(w, lambda x: F.array_contains(_lit_array(sn), x)) if sn else F.lit(False)
        neg, cap = positions(lang, "negation"), positions(lang, "capability")
        fires.append((lang, self_neg | F.coalesce(F.arrays_overlap(neg, dilate(cap, REFUSAL_WINDOW)), F.lit(False))))
        solo_words = roles.get((lang, "solo"), [])
        solo = (F.array_distinct(F.transform(F.filter(w, lambda x: F.array_contains(_lit_array(solo_words), x)),
                                             lambda x: F.try_element_at(stem_of, x)))
                if solo_words else F.array().cast("array<string>"))
        vpos = F.array_intersect(positions(lang, "verb"), dilate(positions(lang, "subject"), HEDGING_WINDOW))
        verbs = F.array_except(F.array_distinct(F.transform(vpos, lambda i: F.try_element_at(stem_of, F.get(w, i)))), solo)
        counts.append(F.size(solo) + F.size(verbs))
        hedge_parts.append(F.concat(
            F.transform(F.array_sort(solo), lambda s: F.struct(F.lit(lang).alias("language"), s.alias("stem"),
                                                              F.lit("solo").alias("type"))),
            F.transform(F.array_sort(verbs), lambda s: F.struct(F.lit(lang).alias("language"), s.alias("stem"),
                                                               F.lit("verb+subject").alias("type")))))
    first = None
    for lang, f in reversed(fires):
        first = F.when(f, F.lit(lang)) if first is None else F.when(f, F.lit(lang)).otherwise(first)
    count = counts[0]
    for c in counts[1:]:
        count = count + c
    matches = F.array_sort(F.concat(*hedge_parts))
    return F.struct(
        first.isNotNull().alias("refusal_detection"),
        first.alias("refusal_language"),
        (count > 0).alias("hedging_detection"),
        count.cast("long").alias("hedging_count"),
        F.when(F.size(matches) > 0, matches).alias("hedging_matches"),
    )
