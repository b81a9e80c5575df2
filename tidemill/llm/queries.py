"""Registered queries of the operators over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, stored
from . import decontam, divergence, minmax, mixing, ngram_join, passages, quality, secrets, sharding, suffix, urls, warc, whitening
from .sql import ORACLE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    docs = _table(spark, sf_dir, "documents")
    counts = stored(docs.select("doc_id", "lang", quality.counted(F.col("text")).alias("stats")), "counts")
    return quality.judge(counts, "lang", "stats").select("doc_id", *[F.col("quality")[c].alias(c) for c in (*quality.COUNTS, "base_failed", "kept")])


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the place."""
    return decontam.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a passage, with its places and class."""
    return passages.shared_passages(_table(spark, sf_dir, "documents"))


def op4_window_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", secrets.secrets(F.col("text")).alias("s")).select("doc_id", "s.*")


def capture_lists(captures: DataFrame) -> DataFrame:
    """Dated list entries for the hosts, domains and first path segments of the captures, drawn from their names."""
    def number(key: str):
        return F.conv(F.substring(F.md5(F.col(key)), 1, 6), 16, 10).cast("int")

    def entries(keys: DataFrame, day, action: str) -> DataFrame:
        return keys.select("key", F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("day"), F.lit(action).alias("action"))

    def keys_from(expression) -> DataFrame:
        return captures.select(expression.alias("key")).where("key is not null").distinct().withColumn("h", number("key"))

    h = F.col("h")
    host, segment = urls.host_of(F.col("url")), urls.segment_of(F.col("url"))
    hosts = keys_from(host).where(h % 5 == 0)
    domains = keys_from(F.substring_index(host, ".", -2))
    paths = keys_from(F.concat(host, F.lit("/"), segment)).where(h % 7 == 0)
    parts = [entries(hosts, h % 150, "block"), entries(hosts, h % 150 + 30 + h % 100, "remove"), entries(hosts.where(h % 2 == 0), h % 150 + 160, "block"),
             entries(domains, h % 200, "block"), entries(domains, h % 200 + 40, "remove"), entries(paths, h % 300, "allow")]
    lists = parts[0]
    for part in parts[1:]:
        lists = lists.union(part)
    return stored(lists, "lists")


def op5_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries active on the day it was fetched."""
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int"))
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("day"))
    return urls.evaluate(captures, capture_lists(captures))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of equal row counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
                                                     F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.shard(rows, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target of each document's source and the words the mix takes from the document."""
    docs = _table(spark, sf_dir, "documents")
    sizes = stored(docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size")), "sizes")
    mixed = mixing.mix(sizes, F.col("source"), F.col("size"), F.xxhash64("doc_id", "size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op8_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back from it."""
    records = warc.round_trip(spark, _table(spark, sf_dir, "pages"), columns=["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op9_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and group of near copies of every document."""
    return ngram_join.near_groups(_table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated byte strings."""
    return suffix.cut_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op11_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and group of near copies of every document, and the one kept of each group."""
    return minmax.near_groups(_table(spark, sf_dir, "documents"), n=5, percent=85)


def op12_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the first four whitened components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each source from the others of its language, and its overused terms."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


_ALL = (op1_distribution_divergence, op2_spaced_seeds, op3_compact_windows, op4_window_entropy, op5_temporal_lists, op6_feistel_shards,
        op7_entropy_balancing, op8_warc_ranges, op9_vertical_jaccard, op10_suffix_sort,
        op11_min_max_hashing, op12_cholesky_whitening, op13_source_divergence)


def _settled(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(settle(spark), sf_dir)
    return run


QUERIES = {query.__name__: _settled(query) for query in _ALL}
