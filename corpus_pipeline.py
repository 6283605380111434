"""A training corpus from the documents: quality, language, near-duplicates, repeated passages, batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
the documents. ``run`` applies them one after the other, each result stored and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import grading, language, near_dedup, packing, substring_dedup
from tidemark.llm.registry import frugal
from tidemark.plans.durable import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than not, by a model of the graded ones among them."""
    frugal(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return grading.selected(docs, grading.learned(docs, labels))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels of the documents name."""
    frugal(spark)
    return language.in_language(docs, language.learned(docs.filter(~language.held_out())))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    frugal(spark)
    return near_dedup.first_of_each(docs)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has as well."""
    frugal(spark)
    return substring_dedup.without_repeats(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of each document that is left."""
    frugal(spark)
    return packing.packed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("language id", known_language),
    ("minhash near-dedup", distinct_documents),
    ("substring dedup", distinct_passages),
    ("packing", batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    sf_dir = sf_dir.rstrip("/")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


# The classifier and the language profiles have no counterpart in SQL.
ORACLE_SQL = None
