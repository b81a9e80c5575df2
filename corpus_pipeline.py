"""From raw documents to training shards: each stage works on all that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontam, mixing, ngram_join, quality, sharding
from tidemill.session import scratch_dir, settle

#: Documents near enough share this much of their runs of five words.
SHINGLE, PERCENT = 5, 80
SHARDS = 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and do not stray from their language."""
    settle(spark)
    return quality.assess(docs).where("quality.kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    settle(spark)
    return ngram_join.one_per_group(docs, n=SHINGLE, percent=PERCENT).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    settle(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, some not at all."""
    settle(spark)
    mixed = mixing.mix(docs, F.col("source"), mixing.words_in(F.col("text")), F.xxhash64("doc_id", "text"))
    repeated = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it."""
    settle(spark)
    return sharding.shard(docs, [F.col("doc_id"), F.xxhash64(*docs.columns)], SHARDS)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_decontamination),
          ("mixing sources to target weights", source_mixing), ("sharding", shards)]

#: SQL cannot express the near-duplicate groups and the Newton steps; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
