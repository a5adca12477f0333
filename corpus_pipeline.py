"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, mix, shard.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.
``run`` writes each stage's rows as Parquet in the shared folder and reads
them again as the next stage's input, so a lost executor never costs more
than the stage at hand. Texts reach Python workers in batches of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plansight.llm import apportion, decontaminate, jump_shards, knn_quality, near_dup
from plansight.llm.common import GROUP_BYTES, run_folder, written
from plansight.session import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the labelled neighbours vote down (operator 10)."""
    return knn_quality.good_documents(docs, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies: shingles of five words, similarity 0.8 (operator 9)."""
    return near_dup.one_of_each(docs, k=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item (operator 8)."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their target weights: a row per document and epoch that takes words of it (operator 2)."""
    return apportion.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each document and a gapless slot in it (operator 4)."""
    return jump_shards.assign(docs, shards=16)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminated),
          ("mix sources", mix_sources), ("shard", shard)]

#: The classifier, the signatures and the seeded mix have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = run_folder(spark, "pipeline")
    with small_batches(spark, GROUP_BYTES):
        for i, (_, stage) in enumerate(STAGES):
            docs = written(stage(spark, docs, sf_dir), f"{folder}/{i}")
    return docs
