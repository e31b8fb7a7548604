"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddup, jaccard, langid, linededup, oracles, packing, pii, quality, tokencount, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_language_id": langid.op2_language_id,
        "op3_bpe": bpe.op3_bpe,
        "op4_packing": packing.op4_packing,
        "op5_quality": quality.op5_quality,
        "op6_url_filter": urlfilter.op6_url_filter,
        "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
        "op8_line_dedup": linededup.op8_line_dedup,
        "op9_token_counts": tokencount.op9_token_counts,
        "op10_embedding_dedup": embeddup.op10_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": oracles.quality_sql(), "op6_url_filter": urlfilter.ORACLE, "op7_ngram_jaccard": oracles.JACCARD, "op8_line_dedup": linededup.ORACLE, "op10_embedding_dedup": oracles.EMBEDDINGS}
