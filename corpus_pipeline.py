"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scissile.llm import exact_dedup, mixing, quality_rules, segmentation, simhash
from scissile.llm.common import table, written

#: Targets of the mix beside the clean domain, which stays whole.
MIX = (0.95, 0.046, 0.004)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.domain_of_labels(table(spark, sf_dir, "labels")), MIX, labelled_docs=table(spark, sf_dir, "documents"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segmentation.encode(docs)


STAGES = [
    ("quality_rules", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs


#: Sampling and clustering by fingerprints are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None
