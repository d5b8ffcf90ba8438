"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import q_decontaminate, q_filter_audit, q_html, q_jaccard_join, q_media, q_merkle, q_packing, q_pii, q_quality, q_secret_scan, q_simhash_trie, q_tool_calls, q_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": q_secret_scan.op1_secret_scan,
    "op2_html_mincut": q_html.op2_html_mincut,
    "op3_progressive_jpeg": q_media.op3_progressive_jpeg,
    "op4_pii_anchors": q_pii.op4_pii_anchors,
    "op5_tool_call_linking": q_tool_calls.op5_tool_call_linking,
    "op6_best_fit_packing": q_packing.op6_best_fit_packing,
    "op7_benchmark_simhash": q_decontaminate.op7_benchmark_simhash,
    "op8_ngram_jaccard_join": q_jaccard_join.op8_ngram_jaccard_join,
    "op9_quality_resampling": q_quality.op9_quality_resampling,
    "op10_toxicity_mil": q_toxicity.op10_toxicity_mil,
    "op11_merkle_manifest": q_merkle.op11_merkle_manifest,
    "op12_simhash_trie": q_simhash_trie.op12_simhash_trie,
    "op13_filter_audit": q_filter_audit.op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": q_secret_scan.ORACLE,
    "op4_pii_anchors": q_pii.ORACLE,
    "op5_tool_call_linking": q_tool_calls.ORACLE,
    "op7_benchmark_simhash": q_decontaminate.ORACLE,
    "op8_ngram_jaccard_join": q_jaccard_join.ORACLE,
    "op11_merkle_manifest": q_merkle.ORACLE,
    "op13_filter_audit": q_filter_audit.ORACLE,
}
