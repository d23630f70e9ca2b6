"""H7 refusal detection and H8 hedging detection by a table of surface forms.

Plan (no per-row Python on the hot path):
  1. ``posexplode`` the lower-cased word tokens of each response  (map side)
  2. broadcast-join the exploded tokens with the lexicon's inflected forms
     ``(word, language, role, stem)``, a parameter table (``functions.lexicon``),
     and keep only hits; only hits are ever shuffled
  3. proximity rule (E4) with a RANGE window over token positions per
     (response, language): a negation/verb hit looks for a capability/subject
     hit within ±w positions
  4. aggregate per response and left-join back so responses without hits get
     false / 0
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.lexicon import HEDGING_WINDOW, LANGUAGES, REFUSAL_WINDOW
from assay.functions.tokens import words
from assay.operators.joins import fixed_broadcast


def explode_words(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    return df.select(*keys, F.posexplode(words(text_col)).alias("pos", "word"))


def lexicon_hits(df: DataFrame, keys: list[str], text_col: str, lexicon: DataFrame) -> DataFrame:
    vocab = fixed_broadcast(lexicon.select("word", "language", "role", "stem"))
    return explode_words(df, keys, text_col).join(vocab, "word").select(*keys, "pos", "language", "role", "stem")


def _lang_order():
    m = F.create_map(*[x for i, lang in enumerate(LANGUAGES) for x in (F.lit(lang), F.lit(i))])
    return F.coalesce(F.try_element_at(m, F.col("language")), F.lit(len(LANGUAGES)))


def _per_language(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (response, language) with the refusal flag and the hedging stems.

    Both proximity rules (E4) run in one window pass: the two frames share the
    partitioning (response, language) and the order (position), so the hits
    are shuffled and sorted once. The aggregate that follows reuses that
    partitioning; its sets are bounded by the lexicon size.
    """
    w = Window.partitionBy(*keys, "language").orderBy("pos")
    near_cap = F.max((F.col("role") == "capability").cast("int")).over(
        w.rangeBetween(-REFUSAL_WINDOW, REFUSAL_WINDOW))
    near_subj = F.max((F.col("role") == "subject").cast("int")).over(
        w.rangeBetween(-HEDGING_WINDOW, HEDGING_WINDOW))
    h = hits.withColumns({"near_cap": near_cap, "near_subj": near_subj})
    fires = (F.col("role") == "self_negating") | ((F.col("role") == "negation") & (F.col("near_cap") == 1))
    solo = F.when(F.col("role") == "solo", F.col("stem"))
    verb = F.when((F.col("role") == "verb") & (F.col("near_subj") == 1), F.col("stem"))
    g = h.groupBy(*keys, "language").agg(
        F.bool_or(fires).alias("fires"),
        F.array_sort(F.collect_set(solo)).alias("solo"),
        F.array_sort(F.collect_set(verb)).alias("verb"))
    # a stem already matched as solo in a language is not matched again as a verb
    return g.withColumn("verb", F.array_except("verb", "solo"))


def lexicon_flags(df: DataFrame, keys: list[str], text_col: str, lexicon: DataFrame) -> DataFrame:
    """H7 + H8 for responses with at least one lexicon hit (keys + flags).

    Callers left-join this to their response table and fill the defaults with
    ``fill_lexicon_defaults`` — responses without hits never leave the map side.
    """
    per = _per_language(lexicon_hits(df, keys, text_col, lexicon), keys)
    order = _lang_order()

    def matches(col, kind):
        return F.transform(col, lambda st: F.struct(F.col("language").alias("language"), st.alias("stem"),
                                                   F.lit(kind).alias("type")))
    g = per.groupBy(*keys).agg(
        F.min(F.when(F.col("fires"), F.struct(order.alias("o"), F.col("language").alias("l")))).alias("_first"),
        F.sum(F.size("solo") + F.size("verb")).alias("hedging_count"),
        F.flatten(F.collect_list(F.concat(matches(F.col("solo"), "solo"), matches(F.col("verb"), "verb+subject"))))
        .alias("_m"),
    )
    return g.select(*keys,
                    F.col("_first").isNotNull().alias("refusal_detection"),
                    F.col("_first.l").alias("refusal_language"),
                    (F.col("hedging_count") > 0).alias("hedging_detection"),
                    F.col("hedging_count").cast("long").alias("hedging_count"),
                    F.when(F.size("_m") > 0, F.array_sort("_m")).alias("hedging_matches"))


def fill_lexicon_defaults(df: DataFrame) -> DataFrame:
    return (df.withColumn("refusal_detection", F.coalesce("refusal_detection", F.lit(False)))
            .withColumn("hedging_detection", F.coalesce("hedging_detection", F.lit(False)))
            .withColumn("hedging_count", F.coalesce("hedging_count", F.lit(0)).cast("long")))


def lexicon_scores(df: DataFrame, keys: list[str], text_col: str, lexicon: DataFrame) -> DataFrame:
    """H7 + H8 for every row of ``df``: keys + refusal/hedging columns."""
    flags = lexicon_flags(df, keys, text_col, lexicon)
    return fill_lexicon_defaults(df.select(*keys).join(flags, keys, "left"))
