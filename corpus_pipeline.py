"""The corpus pipeline: documents in, sharded training documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder named by ``spark.checkpoint.dir``
and reads it again as the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from casework.llm import decontaminate, mixing, quality, queries, sharding, simhash
from casework.session import checkpoint_dir
from casework.sources.tables import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranker accepts.  Null and empty texts are
    scored like any other, repeated rows alike, and null ids stay; without usable
    labels see ``quality.train``; an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the source weights; one taken in two epochs has two rows.
    Null languages and sources are leaves of their own, null and empty texts
    weigh nothing, rows of one id are taken together, null ids count as the
    empty id; columns of any name stay; an empty table stays empty."""
    return mixing.mix(docs, queries.MIX_WEIGHTS, queries.MIX_BUDGET, queries.MIX_EPOCHS, epoch_col=None)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.shard_documents(docs, queries.SHARDS)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix", mix),
    ("shard", shard),
]

#: the stages use hashes and models that SQL does not have; tests compare them with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
