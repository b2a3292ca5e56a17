"""Corpus pipeline: quality rules, line de-duplication, near-duplicate removal, surrogates for personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewarden.llm import common, line_dedup, ngram_join, packing, pii, quality

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("pii_surrogates", pii.stage),
    ("best_fit_packing", packing.stage),
]

#: Iterative estimates, byte-pair ids and packing have no SQL form; tests/llm/test_pipeline.py holds run() against a plain
#: version of quality rules, line dedup, near copies and pieces, and takes the surrogates, whose values are free, from their stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
