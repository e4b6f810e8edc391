"""The corpus pipeline: each stage works on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's docs. All but the last return the columns of ``documents``.

Every stage takes null ids and null, empty or very long texts, repeated rows, further columns of
any name and empty tables; the operators' docstrings say what comes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import ftrl_quality, jaccard, packing, toxicity
from graphloom.llm.common import written
from graphloom.llm.queries import table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return ftrl_quality.accepted(docs, table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more."""
    return jaccard.first_of_groups(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' tokens in sequences of at most 4096."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("n-gram jaccard join", near_duplicates),
    ("best-fit packing", pack),
]

#: The classifiers are trained and the packing is planned; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
