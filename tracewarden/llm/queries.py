"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewarden.llm import centroids, chat, divergence, html_extract, line_dedup, merkle, ngram_join, packing, pii, quality, segment, simhash, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_pii_surrogates": pii.op2_pii_surrogates,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_html_extraction": html_extract.op6_html_extraction,
    "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
    "op8_sentencepiece_sampling": segment.op8_sentencepiece_sampling,
    "op9_document_fingerprints": merkle.op9_document_fingerprints,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_simhash_near_dedup": simhash.op13_simhash_near_dedup,
}

SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.SQL,
    "op7_ngram_jaccard_join": ngram_join.SQL,
    "op10_chat_formatting": chat.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_centroid_clustering": centroids.SQL,
}
