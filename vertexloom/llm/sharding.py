"""Sharding by rendezvous hashing of stable record keys over weighted shards; DataFrame operations only.

A record goes to the shard with the least ``-ln(u) / weight``, u being a hash of key and shard in (0, 1). A new
shard therefore takes records only into itself, and from all others in proportion. Slots number the records of
a shard by hash: counts by hash range give each range its first slot, so that a task sorts one range, not a shard.

Null keys: the text stands in for the key, so that rows without a key don't meet in one shard. Null text has
size 1 and CRC 0. Repeated rows are rows like any other. An empty table gives an empty result. Columns of the input that are
named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash63, own_names, small, stored, table

#: Rows that one task numbers, about.
CELL_ROWS = 20_000


def rendezvous(key: F.Column, weights: list[float]) -> F.Column:
    """The shard, 0 to len(weights) - 1, for a string key."""
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def score(s):
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("#"), s["i"].cast("string"))), 1, 13), 16, 10).cast("double")
        return F.struct((F.ln((bits + 0.5) / float(1 << 52)) / s["w"]).alias("score"), (-s["i"]).alias("i"))

    return -F.array_max(F.transform(shards, score))["i"]


def shard_records(docs: DataFrame, weights: list[float], grown: float | None = None, thin: bool = False, key: str = "doc_id") -> DataFrame:
    """docs (key, text, ...) with __size, __text_crc32, __law, __shard, __slot and __grown_shard (with one shard more, of weight
    ``grown``; by default 1). thin: only these and the key; else all columns of docs are kept."""
    added = ("size", "text_crc32", "law", "shard", "grown_shard", "h", "cell", "n", "of", "at", "first", "slot")
    docs = docs.drop(*[f"__{c}" for c in added])
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), text))
    out = docs.select(
        *([key] if thin else ["*"]),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("__size"),
        F.crc32(F.encode(text, "UTF-8")).alias("__text_crc32"),
        F.lit("key").alias("__law"),
        rendezvous(name, weights).cast("int").alias("__shard"),
        rendezvous(name, [*weights, grown or 1.0]).cast("int").alias("__grown_shard"),
        hash63(F.lit("slot"), F.coalesce(F.col(key).cast("string"), F.lit("")), text).alias("__h"),
    )
    out = stored(out, "shards")
    rows = out.count()
    bits = max(0, math.ceil(math.log2(max(1, rows) / (len(weights) * CELL_ROWS)))) if rows else 0
    out = out.withColumn("__cell", F.shiftright("__h", 60 - bits))
    cells = out.groupBy("__shard", "__cell").count()
    before = Window.partitionBy("__shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("__shard").alias("__of"), F.col("__cell").alias("__at"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    number = F.row_number().over(Window.partitionBy("__shard", "__cell").orderBy("__h", F.col(key), "__text_crc32", "__size")) - 1
    out = out.withColumn("__n", number)
    out = out.join(small(cells, len(weights) << bits), (F.col("__shard") == F.col("__of")) & (F.col("__cell") == F.col("__at")))
    return out.withColumn("__slot", (F.col("__n") + F.col("__first")).cast("long")).drop("__h", "__cell", "__n", "__of", "__at", "__first")


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_names(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    out = shard_records(docs, [1.0] * 8, thin=True)
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")])
