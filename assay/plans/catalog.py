"""Registry of the queries exposed through ``__spark_entry__`` (name -> plan, name -> oracle SQL)."""

from __future__ import annotations

from assay.plans import qa_plans as qp
from assay.plans import session_plans as sp
from assay.plans import stats_plans as tp
from assay.plans import verdict_plans as vp

QUERIES = {
    "qa_verdict": qp.qa_verdict_query,
    "rule_verdict_metrics": qp.rule_verdict_metrics_query,
    "qa_scores": qp.qa_scores_query,
    "qa_breakdown": qp.qa_breakdown_query,
    "qa_failure_rates": qp.qa_failure_rates_query,
    "rouge_l": qp.rouge_l_query,
    "attempt_scores": sp.attempt_scores_query,
    "pass_at_k": sp.pass_at_k_query,
    "self_consistency": sp.self_consistency_query,
    "chunk_attribution": sp.chunk_attribution_query,
    "wilcoxon_stats": tp.wilcoxon_stats_query,
    "wilcoxon_test": tp.wilcoxon_test_query,
    "mannwhitney_stats": tp.mannwhitney_stats_query,
    "mannwhitney_test": tp.mannwhitney_test_query,
    "mcnemar_stats": tp.mcnemar_query,
    "mcnemar_test": tp.mcnemar_test_query,
    "chi2_stats": tp.chi2_query,
    "chi2_test": tp.chi2_test_query,
    "pairing": tp.pairing_query,
    "bh_fdr": tp.bh_query,
    "welch_stats": tp.welch_query,
    "welch_test": tp.welch_test_query,
    "thresholds": vp.thresholds_query,
    "hypothesis_tests": vp.hypothesis_tests_query,
    "statistical_verdict": vp.statistical_verdict_query,
    "verdict_metrics": vp.verdict_metrics_query,
}

ORACLE_SQL = {
    "qa_verdict": qp.QA_VERDICT_SQL,
    "rule_verdict_metrics": qp.RULE_VERDICT_METRICS_SQL,
    "qa_scores": qp.QA_SCORES_SQL,
    "qa_breakdown": qp.QA_BREAKDOWN_SQL,
    "qa_failure_rates": qp.QA_FAILURE_RATES_SQL,
    "attempt_scores": sp.ATTEMPT_SCORES_SQL,
    "pass_at_k": sp.PASS_AT_K_SQL,
    "self_consistency": sp.SELF_CONSISTENCY_SQL,
    "chunk_attribution": sp.CHUNK_ATTRIBUTION_SQL,
    "wilcoxon_stats": tp.WILCOXON_STATS_SQL,
    "mannwhitney_stats": tp.MANNWHITNEY_STATS_SQL,
    "mcnemar_stats": tp.MCNEMAR_SQL,
    "chi2_stats": tp.CHI2_SQL,
    "pairing": tp.PAIRING_SQL,
    "bh_fdr": tp.BH_SQL,
    "welch_stats": tp.WELCH_SQL,
}

from assay.plans import dashboard_plans as dp  # noqa: E402

QUERIES.update({
    "silver": dp.silver_query,
    "weighted_sample": dp.weighted_sample_query,
    "sample_report": dp.sample_report_query,
    "descriptive_stats": dp.descriptive_stats_query,
    "zscores": dp.zscore_query,
    "kpi_cards": dp.kpi_query,
    "radar_profile": dp.radar_query,
    "failure_bars": dp.failure_bars_query,
    "sankey_edges": dp.sankey_query,
    "sankey_nodes": dp.sankey_nodes_query,
    "complexity_bins": dp.complexity_query,
    "filter_summary": dp.filtered_query,
    "filter_options": dp.filter_options_query,
    "metric_ranges": dp.metric_ranges_query,
    "low_sample_groups": dp.low_sample_query,
    "comparison_table": dp.comparison_query,
    "comparison_stats": dp.comparison_stats_query,
    "scatter_points": dp.scatter_query,
})
ORACLE_SQL.update({
    "silver": dp.SILVER_SQL,
    "weighted_sample": dp.WEIGHTED_SAMPLE_SQL,
    "sample_report": dp.SAMPLE_REPORT_SQL,
    "descriptive_stats": dp.DESCRIPTIVE_STATS_SQL,
    "zscores": dp.ZSCORE_SQL,
    "kpi_cards": dp.KPI_SQL,
    "radar_profile": dp.RADAR_SQL,
    "failure_bars": dp.FAILURE_BARS_SQL,
    "sankey_edges": dp.SANKEY_SQL,
    "sankey_nodes": dp.SANKEY_NODES_SQL,
    "complexity_bins": dp.COMPLEXITY_SQL,
    "filter_summary": dp.FILTERED_SQL,
    "filter_options": dp.FILTER_OPTIONS_SQL,
    "metric_ranges": dp.METRIC_RANGES_SQL,
    "low_sample_groups": dp.LOW_SAMPLE_SQL,
    "scatter_points": dp.SCATTER_SQL,
    "comparison_stats": dp.COMPARISON_STATS_SQL,
})

from assay.plans import records_plans as rp  # noqa: E402

QUERIES.update({
    "class_match": rp.class_match_query,
    "prompts": rp.prompts_query,
    "knowledge": rp.knowledge_query,
    "tool_args": rp.tool_args_query,
    "judge_normalisation": rp.judge_norm_query,
    "provider": rp.provider_query,
    "cache_counts": rp.cache_counts_query,
    "sessions": rp.sessions_query,
    "upsert": rp.upsert_query,
    "token_usage": rp.token_usage_query,
    "bookkeeping": rp.bookkeeping_query,
    "global_delta": rp.global_delta_query,
    "session_shape": rp.session_shape_query,
    "predictions_roundtrip": rp.predictions_roundtrip_query,
    "reference_scores": rp.reference_scores_query,
    "registry_scores": rp.registry_scores_query,
    "run_metrics": rp.run_metrics_query,
})
ORACLE_SQL.update({
    "class_match": rp.CLASS_MATCH_SQL,
    "prompts": rp.PROMPTS_SQL,
    "knowledge": rp.KNOWLEDGE_SQL,
    "tool_args": rp.TOOL_ARGS_SQL,
    "judge_normalisation": rp.JUDGE_NORM_SQL,
    "provider": rp.PROVIDER_SQL,
    "cache_counts": rp.CACHE_COUNTS_SQL,
    "upsert": rp.UPSERT_SQL,
    "sessions": rp.SESSIONS_SQL,
    "token_usage": rp.TOKEN_USAGE_SQL,
    "bookkeeping": rp.BOOKKEEPING_SQL,
    "global_delta": rp.GLOBAL_DELTA_SQL,
    "session_shape": rp.SESSION_SHAPE_SQL,
    "predictions_roundtrip": rp.PREDICTIONS_ROUNDTRIP_SQL,
    "reference_scores": rp.REFERENCE_SCORES_SQL,
    "registry_scores": rp.REGISTRY_SCORES_SQL,
    "run_metrics": rp.RUN_METRICS_SQL,
})

from assay.plans import pipeline_plans as pp  # noqa: E402

QUERIES.update({
    "incremental_gold": pp.incremental_gold_query,
    "running_metrics": pp.running_metrics_query,
    "profile_roundtrip": pp.profile_roundtrip_query,
    "profile_metadata": pp.profile_metadata_query,
    "trace_lookup": pp.trace_lookup_query,
    "lexicon_forms": pp.lexicon_forms_query,
    "verdict_pipeline": pp.pipeline_query,
    "medallion_build": pp.medallion_build_query,
})
ORACLE_SQL.update({
    "incremental_gold": pp.INCREMENTAL_GOLD_SQL,
    "running_metrics": pp.RUNNING_METRICS_SQL,
    "trace_lookup": pp.TRACE_LOOKUP_SQL,
    "profile_metadata": pp.PROFILE_METADATA_SQL,
    "lexicon_forms": pp.LEXICON_FORMS_SQL,
    "medallion_build": "WITH " + dp.RAW_SQL + ",\n" + dp.PREDS_SQL + pp.MEDALLION_BUILD_SQL_TAIL,
})

from assay.plans import isolated_plans as ip  # noqa: E402

QUERIES.update(ip.QUERIES)
ORACLE_SQL.update(ip.ORACLE_SQL)

from assay.plans import export_plans as xp  # noqa: E402

QUERIES.update(xp.QUERIES)
ORACLE_SQL.update(xp.ORACLE_SQL)
