"""From raw documents to training shards: five stages over the tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqueue.llm import common
from sparkqueue.llm.decontamination import without_contaminated
from sparkqueue.llm.language_id import held_out
from sparkqueue.llm.mixing import mixed
from sparkqueue.llm.near_duplicates import without_near_duplicates
from sparkqueue.llm.quality import fit_quality, score_quality
from sparkqueue.llm.queries import MIX
from sparkqueue.llm.sharding import shard_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives at least 0.3."""
    net = fit_quality(docs, common.table(spark, sf_dir, "labels"), ~held_out(5, 0))
    (score,) = common.free_names(docs, "score")
    return score_quality(docs, net, tuple(docs.columns), score).where(F.col(score) >= 0.3).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each epoch."""
    return mixed(docs, MIX).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and slot."""
    return shard_documents(docs, shards=24)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The classifier can't be said in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop_written(before)
    return docs
