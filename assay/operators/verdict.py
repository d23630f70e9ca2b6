"""J1 rule verdict, J2 statistical verdict, J3 critical set, J4 flattening.

Both verdicts are conditional aggregations to one row per run/model over
already-aggregated inputs (O(categories x metrics) rows), so they never touch
response-level data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.numeric import round_even

# fixed values: default thresholds of the rule verdict
OVERLAP_THRESHOLD = 0.3
REFUSAL_THRESHOLD = 0.3
DISCRIMINATION_THRESHOLD = 0.1

# fixed values: reason texts of the rule verdict ({x} = value with 3 decimals, {t} = threshold)
REASON_MISSING = "Missing category data — cannot determine capability"
REASON_POS_OK = "Positivo overlap ({x}) >= threshold ({t})"
REASON_POS_LOW = "Positivo overlap ({x}) < threshold ({t})"
REASON_NEG_REFUSES = "Negativo refusal rate ({x}) >= threshold ({t})"
REASON_NEG_LOW_OVERLAP = "Negativo overlap ({x}) < threshold — avoids hallucination"
REASON_NEG_RISK = "Negativo: low refusal ({x}) and high overlap ({y}) — hallucination risk"
REASON_DELTA_OK = "Discrimination delta ({x}) >= threshold ({t})"
REASON_DELTA_LOW = "Discrimination delta ({x}) < threshold ({t}) — model does not differentiate categories"

# fixed values: critical (metric, category) pairs of the statistical verdict
CRITICAL_METRICS = (
    ("token_overlap_f1", "positivo"),
    ("token_overlap_f1", "negativo"),
    ("refusal_detection", "negativo"),
    ("discrimination_delta", "global"),
)


def _fmt3(c: Column) -> Column:
    return F.format_string("%.3f", round_even(c, 3))


def _reason(template: str, **cols: Column) -> Column:
    """Build a reason string from a template with {name} slots."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [F.lit(pre), cols[name]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def rule_verdict(breakdown: DataFrame, outer: list[str], *,
                 overlap_threshold: float = OVERLAP_THRESHOLD,
                 refusal_threshold: float = REFUSAL_THRESHOLD,
                 discrimination_threshold: float = DISCRIMINATION_THRESHOLD,
                 category_col: str = "category", name_col: str = "scorer_name") -> DataFrame:
    """J1 — one verdict row per ``outer`` key from per-category rounded means."""
    def pick(cat, metric):
        return F.max(F.when((F.col(category_col) == cat) & (F.col(name_col) == metric), F.col("mean")))

    def has(cat):
        return F.max((F.col(category_col) == cat).cast("int")) == 1

    g = breakdown.groupBy(*outer).agg(
        F.coalesce(pick("positivo", "token_overlap_f1"), F.lit(0.0)).alias("positivo_overlap_mean"),
        F.coalesce(pick("negativo", "token_overlap_f1"), F.lit(0.0)).alias("negativo_overlap_mean"),
        F.coalesce(pick("positivo", "refusal_detection"), F.lit(0.0)).alias("positivo_refusal_rate"),
        F.coalesce(pick("negativo", "refusal_detection"), F.lit(0.0)).alias("negativo_refusal_rate"),
        (has("positivo") & has("negativo")).alias("_complete"),
    )
    po, no = F.col("positivo_overlap_mean"), F.col("negativo_overlap_mean")
    nr = F.col("negativo_refusal_rate")
    complete = F.col("_complete")
    delta = F.when(complete, F.abs(po - no)).otherwise(F.lit(0.0))
    ot, rt, dt = (F.lit(str(overlap_threshold)), F.lit(str(refusal_threshold)),
                  F.lit(str(discrimination_threshold)))
    pos_ok = po >= overlap_threshold
    neg_ok = (nr >= refusal_threshold) | (no < overlap_threshold)
    disc = delta >= discrimination_threshold
    r1 = F.when(pos_ok, _reason(REASON_POS_OK, x=_fmt3(po), t=ot)).otherwise(
        _reason(REASON_POS_LOW, x=_fmt3(po), t=ot))
    r2 = (F.when(nr >= refusal_threshold, _reason(REASON_NEG_REFUSES, x=_fmt3(nr), t=rt))
          .when(no < overlap_threshold, _reason(REASON_NEG_LOW_OVERLAP, x=_fmt3(no)))
          .otherwise(_reason(REASON_NEG_RISK, x=_fmt3(nr), y=_fmt3(no))))
    r3 = F.when(disc, _reason(REASON_DELTA_OK, x=_fmt3(delta), t=dt)).otherwise(
        _reason(REASON_DELTA_LOW, x=_fmt3(delta), t=dt))
    verdict = (F.when(~complete, "inconclusive")
               .when(pos_ok & neg_ok & disc, "capable")
               .when(~pos_ok & ~neg_ok, "not_capable")
               .otherwise("inconclusive"))
    reasons = F.when(~complete, F.array(F.lit(REASON_MISSING))).otherwise(F.array(r1, r2, r3))
    return g.select(*outer, verdict.alias("verdict"), po.alias("positivo_overlap_mean"),
                    no.alias("negativo_overlap_mean"), "positivo_refusal_rate",
                    nr.alias("negativo_refusal_rate"), delta.alias("discrimination_delta"),
                    reasons.alias("reasons"))


def critical_metrics(spark: SparkSession, pairs=CRITICAL_METRICS) -> DataFrame:
    """J3 — the critical set as a 4-row parameter table."""
    return spark.createDataFrame(list(pairs), "metric_name string, category string")


def statistical_verdict(results: DataFrame, critical: DataFrame, outer: list[str] | None = None,
                        *, alpha: float = 0.05, correction_method: str = "benjamini-hochberg",
                        profile_version: str = "1.0.0") -> DataFrame:
    """J2 — critical & rejected & medium/large -> not_capable; a critical small-effect
    rejection -> inconclusive; else capable. One row per ``outer`` key.

    ``critical`` is a fixed-size parameter table (broadcast).
    """
    outer = list(outer or [])
    crit = F.broadcast(critical.select("metric_name", "category").withColumn("_crit", F.lit(True)))
    r = results.join(crit, ["metric_name", "category"], "left").withColumn(
        "_crit", F.coalesce("_crit", F.lit(False)))
    big = F.col("effect_magnitude").isin("medium", "large")
    small = F.col("effect_magnitude") == "small"
    fail = F.col("_crit") & F.col("reject_null") & big
    weak = F.col("_crit") & F.col("reject_null") & small
    p = F.format_string("%.4f", round_even(F.col("p_value_adjusted"), 4))
    e = F.format_string("%.3f", round_even(F.col("effect_size"), 3))
    fail_reason = F.concat(F.col("metric_name"), F.lit(" ("), F.col("category"),
                           F.lit("): significant (p_adj="), p, F.lit("), effect="),
                           F.col("effect_magnitude"), F.lit(" ("), e, F.lit(")"))
    weak_reason = F.concat(F.col("metric_name"), F.lit(" ("), F.col("category"),
                           F.lit("): significant but small effect (p_adj="), p, F.lit(", d="), e,
                           F.lit(") — inconclusive signal"))
    reason = F.when(fail, fail_reason).when(weak, weak_reason)
    # the order of the tests: by category and metric, whole-run metrics after them, bootstrap tests last
    late = F.col("test_name") == "bootstrap" if "test_name" in r.columns else F.lit(False)
    order = [late.alias("late"), (F.col("category") == "global").alias("whole"), F.col("category"), F.col("metric_name")]
    g = (r.groupBy(*outer) if outer else r.groupBy()).agg(
        F.count_if(fail).alias("n_critical_failures"),
        F.bool_or(weak).alias("_weak"),
        F.transform(F.array_sort(F.collect_list(F.when(reason.isNotNull(), F.struct(*order, reason.alias("reason"))))),
                    lambda x: x["reason"]).alias("_reasons"),
        F.array_sort(F.collect_list(F.when(fail, F.concat_ws(":", "metric_name", "category"))))
        .alias("critical_failures"),
    )
    verdict = (F.when(F.col("n_critical_failures") > 0, "not_capable")
               .when(F.coalesce(F.col("_weak"), F.lit(False)), "inconclusive")
               .otherwise("capable"))
    reasons = F.when((F.size("_reasons") == 0) & (F.col("n_critical_failures") == 0)
                     & ~F.coalesce(F.col("_weak"), F.lit(False)),
                     F.array(F.lit("All critical metrics within reference thresholds"))) \
        .otherwise(F.col("_reasons"))
    return g.select(*outer, verdict.alias("verdict"), "n_critical_failures", "critical_failures",
                    reasons.alias("reasons"), F.lit(profile_version).alias("threshold_profile_version"),
                    F.lit(alpha).alias("alpha"), F.lit(correction_method).alias("correction_method"))


def flatten_verdict_metrics(results: DataFrame, outer: list[str] | None = None) -> DataFrame:
    """J4 — ``verdict_v2_{category}_{metric}_{stat}`` key/value rows."""
    outer = list(outer or [])
    stats = ["p_value", "p_value_adjusted", "effect_size", "candidate_value"]
    names = {"p_value": "p_value", "p_value_adjusted": "p_adjusted",
             "effect_size": "effect_size", "candidate_value": "candidate_value"}
    long = results.select(*outer, "category", "metric_name",
                          *[F.col(s).cast("double").alias(names[s]) for s in stats])
    u = long.unpivot([*outer, "category", "metric_name"], list(names.values()), "stat", "metric_value")
    return u.select(*outer, F.concat_ws("_", F.lit("verdict_v2"), "category", "metric_name", "stat")
                    .alias("metric_key"), "metric_value")


# fixed values: the rule verdict's metrics, logged as verdict_{name}
RULE_METRICS = ("positivo_overlap_mean", "negativo_overlap_mean", "positivo_refusal_rate", "negativo_refusal_rate",
                "discrimination_delta")


def rule_verdict_metrics(verdicts: DataFrame, outer: list[str]) -> DataFrame:
    """J4 — the rule verdict's five metrics as ``verdict_{name}`` key/value rows."""
    return verdicts.select(*outer, *[F.col(c).cast("double").alias(f"verdict_{c}") for c in RULE_METRICS]).unpivot(
        outer, [f"verdict_{c}" for c in RULE_METRICS], "metric_key", "metric_value")
