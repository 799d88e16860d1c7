"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks of keys in a shard; slots are numbered inside a block and blocks are offset by their counts.
BLOCKS = 1024


def _distance(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u uniform in (0, 1) from the hash of key and shard: the shard of least distance wins, in proportion to its weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _nearest(key: Column, weights: Sequence[float]) -> Column:
    places = [F.struct(_distance(key, s, w).alias("d"), F.lit(s).alias("s")) for s, w in enumerate(weights) if w > 0]
    return (F.least(*places) if len(places) > 1 else places[0])["s"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """Add the shard of each row; key and weights alone decide, so a shard that is added takes rows only into itself.

    Rows of equal key share a shard; a null key is a key of its own. Shards of weight 0 get nothing. An empty table stays empty;
    a column named as out is replaced.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("one shard at least needs a positive weight")
    return df.withColumn(out, _nearest(F.col(key), weights))


def number_slots(df: DataFrame, key: str, order: Sequence[str] = (), shard: str = "shard", out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, without bringing a shard into one task.

    Keys are hashed into BLOCKS blocks; rows are numbered inside (shard, block) and moved by the counts of the blocks before.
    The counts are at most shards * BLOCKS rows, whatever the input, so they may be broadcast. Ties of key are ordered by `order`,
    rows equal in those too get their numbers in any order.
    """
    block = F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.lit(BLOCKS)).cast("int")
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(F.col(shard).alias("_s"), F.col("_block").alias("_b")).agg(F.count("*").alias("_n"))
    before = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(shard, "_block").orderBy(key, *order)
    numbered = rows.withColumn("_rank", F.row_number().over(inside).cast("long"))
    on = (numbered[shard] == starts["_s"]) & (numbered["_block"] == starts["_b"])
    return numbered.join(F.broadcast(starts), on, "inner").withColumn(out, F.col("_start") + F.col("_rank") - 1).drop("_s", "_b", "_start", "_rank", "_block")


def op4_rendezvous_shards(spark, sf_dir: str) -> DataFrame:
    """All documents over 16 shards of equal weight by doc_id; grown_shard is the place among 17."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign_shards(assign_shards(rows, "doc_id", [1.0] * 16), "doc_id", [1.0] * 17, "grown_shard")
    rows = number_slots(rows, "doc_id", ["size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
