"""From raw documents to packed training sequences, stage by stage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as
Parquet and read again as the next one's `docs`; all but the last return the columns they were
given, those of `documents`.

A NULL text has no words and goes with the first stage; an empty one likewise. Rows that share an
id are one document: they stay or go together, and repeated rows stay repeated. Rows with
a NULL id are kept by the stages that drop documents by id. Empty tables go through all
stages, and an empty benchmark finds nothing. Texts of any length are looked at whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cilode.llm import decontaminate, jaccard, packing, quality, secrets
from cilode.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.good(docs)


# Two documents are near copies from this similarity of their shingles on. The query of operator 3 has
# a contract of its own, which does not bind the stage.
SHINGLE_WORDS = 5
ALIKE_PERCENT = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked ones: that with the smallest id."""
    return jaccard.representatives(docs, SHINGLE_WORDS, ALIKE_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secrets.redacted(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", packed_sequences),
]

# SQL has neither the tokenizer nor the curve; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
