"""Queries of this subpackage by name, and their expected rows as SQL."""

from __future__ import annotations

import corpus_pipeline
from cilode.llm import (
    bpe,
    centroids,
    chat,
    decontaminate,
    fim,
    jaccard,
    licenses,
    lm,
    packing,
    quality,
    secrets,
    sharding,
    warc,
)
from cilode.llm.common import table
from cilode.llm.oracle import ORACLE


def op1_secret_scans(spark, folder):
    return secrets.report(table(spark, folder, "documents"))


def op2_quality_rules(spark, folder):
    return quality.report(table(spark, folder, "documents"))


def op3_ngram_jaccard_join(spark, folder):
    return jaccard.classes(table(spark, folder, "documents"))


def op4_chat_formatting(spark, folder):
    return chat.report(chat.with_probe(table(spark, folder, "conversations")))


def op5_warc(spark, folder):
    return warc.report(table(spark, folder, "pages"))


def op6_packing(spark, folder):
    return packing.packed(table(spark, folder, "documents"))


def op7_license_scans(spark, folder):
    return licenses.report(table(spark, folder, "documents"))


def op8_benchmark_decontamination(spark, folder):
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_lm_scoring(spark, folder):
    return lm.scored(table(spark, folder, "documents"))


def op10_sharding(spark, folder):
    return sharding.sharded(table(spark, folder, "documents"))


def op11_fill_in_middle(spark, folder):
    return fim.report(table(spark, folder, "documents"))


def op12_bpe(spark, folder):
    return bpe.report(table(spark, folder, "documents"))


def op13_centroid_clustering(spark, folder):
    return centroids.report(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_license_scans": op7_license_scans,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_sharding": op10_sharding,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_bpe": op12_bpe,
    "op13_centroid_clustering": op13_centroid_clustering,
    "pipeline": corpus_pipeline.run,
}

__all__ = ["ORACLE", "QUERIES"]
