"""The training corpus from the raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. The first four return the columns
of ``documents``, the last one the shard of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import decontamination, minhash_dedup, mixing, quality, sharding
from touchline.session import prepare, stage

#: Tokens of the mixture as a part of those left; with no source repeated, larger sources give way.
BUDGET_SHARE = 0.8
MAX_REPEATS = 1.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    prepare(spark)
    return quality.clean(docs, _table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    prepare(spark)
    return minhash_dedup.clean(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark windows go; the others stay as they are."""
    prepare(spark)
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources as flat as they get without repeating one."""
    return mixing.mixed(docs, mixing.Target(max_repeats=MAX_REPEATS), BUDGET_SHARE)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shards(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("source mixing", mixture),
    ("sharding", sharded),
]

#: The classifier is trained, so SQL cannot express the rows; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir))
    return docs
