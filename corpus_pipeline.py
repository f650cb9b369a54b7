"""A training-data pipeline over documents: quality rules, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodeloom.llm.common import Held, held, holding, in_text_batches, table
from lodeloom.llm.lines import without_repeated_lines
from lodeloom.llm.minhash import keep_one_of_each
from lodeloom.llm.packing import pack
from lodeloom.llm.pii import redact_documents
from lodeloom.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed limits, or are outliers of their language and source, go."""
    return keep_good(in_text_batches(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-equal lines the first stays; a document with no line left goes."""
    return without_repeated_lines(in_text_batches(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return keep_one_of_each(in_text_batches(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to their kinds."""
    return redact_documents(in_text_batches(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096."""
    return pack(in_text_batches(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("packing", packing),
]
#: Robust estimates, edit distances and darts have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. When a stage's result is written, what the stage held and the result before it are deleted.

    Each run deletes its own tables only. The last stage's input stays, as the result reads it. Rows with nulls and an empty
    table go through as the stages' operators define; columns that are not those of documents are carried to the last stage.
    """
    docs, before = table(spark, sf_dir, "documents"), Held()
    for name, stage in STAGES[:-1]:
        with holding() as own:
            kept = stage(spark, docs, sf_dir)
        with holding() as written:
            docs = held(kept, f"pipeline-{name.lower().replace(' ', '-')}")
        own.drop(spark)
        before.drop(spark)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
