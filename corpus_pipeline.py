"""The corpus pipeline: quality rules, quality classifier, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of documents, the last one the packed
pieces. `run` writes each stage's rows as Parquet into the shared folder and reads them as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notecheck.llm import jaccard_join, mixing, packing, quality_cnn, quality_rules
from notecheck.llm.common import materialize, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject."""
    return quality_cnn.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id; documents without words or id stay."""
    return jaccard_join.keep_one(docs, jaccard_join.JoinParams(k=5, num=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, with its bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("packing", pack)]
#: A trained network cannot be written in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
