"""The corpus pipeline: stages that each call one operator of fleetbook.llm.

``run`` applies the stages to ``documents``, writing each stage's rows as
Parquet in the shared folder and reading them again as the next one's input.
All stages but the last return the columns of their input; the last returns a
row per document copy with its place in the packed bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetbook.llm import exact_dedup, langid, mixing, ngram_join, packing
from fleetbook.llm.common import id_crc, staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the language models recognise a language stay.

    The models learn from labelled documents whose crc32 of the id is not 2 modulo 4.
    """
    return langid.accepted_rows(docs, langid.train(docs, id_crc("doc_id") % 4 != 2))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their targets."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document copy gets its place in bins."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("best-fit packing", pack)]

#: SQL can't express the language models, so run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{k}")
    return docs
