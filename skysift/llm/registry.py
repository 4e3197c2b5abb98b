"""Queries and SQL of the operators in this subpackage, and of the pipeline made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skysift.llm import conversations, decontamination, exact_dedup, hard_negatives, html_text, language, near_duplicates, online_packing, packing, quality, suffix_dedup, surrogates, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        decontamination.op1_benchmark_decontamination,
        language.op2_language_id,
        html_text.op3_html_extraction,
        packing.op4_best_fit_packing,
        exact_dedup.op5_exact_dedup,
        surrogates.op6_pii_surrogates,
        near_duplicates.op7_ngram_jaccard_join,
        token_store.op8_token_store,
        quality.op9_quality_classifier,
        suffix_dedup.op10_suffix_dedup,
        hard_negatives.op11_hard_negatives,
        online_packing.op12_online_packing,
        conversations.op13_conversation_repair,
    )
}

ORACLES: dict[str, str] = {"op1_benchmark_decontamination": decontamination.SQL, "op5_exact_dedup": exact_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL, "op13_conversation_repair": conversations.SQL}
