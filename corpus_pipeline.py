"""Training-data pipeline: quality rules, exact dedup, near-duplicate join, source mix, tokens.

Each stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociq.llm.bpe import encode_documents
from lociq.llm.common import Stages, table
from lociq.llm.exact import keep_first_copies
from lociq.llm.mixing import Mix
from lociq.llm.ngram_join import keep_one_per_group
from lociq.llm.quality import keep_good
from lociq.llm.queries import vocabulary_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the learned decision list reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_first_copies(docs)


def one_per_near_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: four fifths of their five-word n-grams shared.

    The four words and 85 % of ``op9_ngram_join`` are that query's own.
    """
    return keep_one_per_group(docs, n=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice."""
    return Mix(docs).documents()


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document of the mix, a row per copy."""
    return encode_documents(docs, vocabulary_path())


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", first_copies),
    ("near duplicates", one_per_near_group),
    ("source mix", mixed_sources),
    ("tokens", tokens),
]

#: The rules are learned and the last stages run outside SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stages = Stages(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return result
        docs = stages.keep(result, f"stage{number}")
    return docs
