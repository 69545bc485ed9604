"""Sharding: weighted rendezvous hashing.

A record's shard is the one with the smallest ``-ln(u) / weight``, where u is
a hash of (key, shard) in (0, 1). Key and shard weights alone decide, so a
further shard only takes rows to itself: on average weight / total of them.
Hashing runs inside the scan; only keys and sizes are shuffled, to number the
rows inside each shard.

Slots are gapless without putting a shard into one task: rows (without texts)
are written once, fall into `buckets` by a hash of the key and their place
there, so that repeated rows spread too; bucket sizes give each bucket's first
slot (shards x buckets numbers, a fixed bound, so that table is broadcast), and
rows are numbered inside their bucket.

Defined results: a null key is a key like others; a null text has no bytes;
rows that repeat a key go to the same shard and get slots of their own; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_table, quoted, utf8


def rendezvous(key: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard of a key among len(weights) shards."""
    each = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(shard)), 11).cast("double") + 0.5) * 2.0**-53
        each.append(F.struct((-F.log(u) / float(weight)).alias("cost"), F.lit(shard).alias("shard")))
    return (F.least(*each) if len(each) > 1 else each[0])["shard"]


def shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", buckets: int = 256) -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard (with one more shard
    of mean weight)."""
    grown = [*weights, sum(weights) / len(weights)]
    body = utf8(quoted(text))
    name = quoted(key)
    rows = docs.select(
        name.alias("_key"), (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        rendezvous([name], weights).cast("int").alias("shard"), rendezvous([name], grown).cast("int").alias("grown_shard"),
    )
    rows = cut_table(rows).withColumn("_hash", F.xxhash64("_key", "text_crc32", F.monotonically_increasing_id()))
    rows = rows.withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)).cast("int"))
    filled = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = filled.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_hash", "_key", "size", "text_crc32")
    placed = rows.withColumn("_slot", F.row_number().over(inside) - 1).join(F.broadcast(first), ["shard", "_bucket"])
    return placed.select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_first") + F.col("_slot")).cast("long").alias("slot"), "grown_shard")
