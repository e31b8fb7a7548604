"""A pipeline of corpus operators: language, line dedup, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
Empty inputs and null texts are what each operator's docstring says; columns other than the
id and the text pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, jaccard, langid, linededup, packing, pii
from tidemark.llm.bpe import default_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the trained model doesn't reject."""
    return langid.accepted(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document with a smaller id has."""
    return linededup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences."""
    return packing.pack_documents(docs, default_path())


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("pii", personal_data), ("packing", pack)]

#: A trained model and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written once and read by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs)
    return docs
