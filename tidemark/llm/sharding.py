"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard depends on the key and the shard count only; there is no ring table, and when one
shard is appended only the keys that move into it change place.  Slots (places within a shard,
gapless from 0) are ranks within small hash buckets plus the sizes of the buckets before, so that
no task sorts a whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, spare_name

#: Rank buckets per shard, and how far rows of one key are spread over them by input partition.
BUCKETS, SALTS = 256, 16


def jump_shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of 64-bit keys; every key leaves the loop after about ln(shards) rounds."""
    state = keys.astype(np.uint64)
    place = np.zeros(len(state), dtype=np.int64)
    jump = np.zeros(len(state), dtype=np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        place[open_] = jump[open_]
        state[open_] = state[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump[open_] = ((place[open_] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        open_ = open_[jump[open_] < shards]
    return place


def jump_udf(shards: int):
    @F.pandas_udf("int")
    def shard(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump_shards(keys.to_numpy().astype(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: int = 8) -> DataFrame:
    """`docs` with `shard`, `slot` and `grown_shard` (the shard once another is appended).

    Input columns of those three names are replaced.  A null key is a key like any other; rows with
    equal keys share a shard and get different slots; an empty table gives an empty result.
    """
    docs = docs.drop("shard", "slot", "grown_shard")
    hashed, bucket, rank, start = (spare_name(docs, n) for n in ("hashed", "bucket", "rank", "start"))
    keyed = docs.withColumn(hashed, F.xxhash64(F.col(key)))
    keyed = keyed.withColumn("shard", jump_udf(shards)(hashed)).withColumn("grown_shard", jump_udf(shards + 1)(hashed))
    keyed = keyed.withColumn(bucket, F.pmod(hashed, F.lit(BUCKETS)) * SALTS + F.spark_partition_id() % SALTS)
    # Written once: the input partition in the bucket number must be the same for sizes and ranks.
    keyed = cut(keyed, "sharding")
    sizes = keyed.groupBy("shard", bucket).agg(F.count("*").alias(rank))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * BUCKETS * SALTS rows, whatever the input.
    starts = sizes.select("shard", bucket, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(start))
    ranked = keyed.withColumn(rank, F.row_number().over(Window.partitionBy("shard", bucket).orderBy(hashed)))
    placed = ranked.join(F.broadcast(starts), ["shard", bucket])
    slot = (F.col(start) + F.col(rank) - 1).cast("long").alias("slot")
    return placed.select(*docs.columns, "shard", slot, "grown_shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, checksum, shard, slot and shard after one more is appended of every document; a null text counts as empty.
    Equal ids share a shard; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(digest, "doc_id", 8).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the documents with their shard and slot."""
    return assign_shards(docs, "doc_id", 8)
