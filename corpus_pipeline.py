"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing and sharding of documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, mixing, sharding, simhash, toxicity
from quarry.llm.common import fold, table, unused
from quarry.plans.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labels of four in five ids."""
    model = toxicity.train(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    score = unused(docs.columns, "_score")
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts with similar shingles of five words (0.8 or more)."""
    return simhash.drop_similar(docs, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in benchmark windows."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), share=0.05)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' temperature weights; every document stays at least once."""
    return mixing.mix(docs, marks=False)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it, of near equal bytes a shard."""
    return sharding.shard_by_bytes(docs, keep=docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No stage of learned scores can be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of sf_dir after all stages; each is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
