"""Weighted rendezvous hashing of stable record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions, table, text_or_empty
from .mixing import uniform

#: Production parameters: shards of equal weight, parts of each shard that number their rows apart, equal rows that one task numbers.
SHARDS, PARTS, EQUAL = 16, 256, 100_000


def shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a string key: the least of -ln(u) / weight, u a uniform hashed from key and shard.

    Each shard's score depends on key and shard alone, so a shard that is added or gains weight only
    takes rows, one that goes only gives rows, and the rest stay. Shards of weight 0 or less get none.
    """
    scores = [F.struct((-F.ln(uniform(F.concat(key, F.lit(f"/{k}")))) / F.lit(float(w))).alias("s"), F.lit(k).alias("k")) for k, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("no shard has a weight")
    return F.array_min(F.array(*scores))["k"]


def key_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


def placed(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, parts: int = PARTS, equal: int = EQUAL) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs(doc_id, text)``.

    size is the UTF-8 bytes of the text plus 1, text_crc32 its unsigned CRC-32 (null: as empty); law is ``key``: doc_id (null:
    one key) and the shards' weights decide. grown_shard is the shard with one more of weight 1. slot
    numbers the rows of a shard from 0 without gaps: by parts of a hash of (doc_id, crc, size), then by these three, so the rows
    of one id with different texts are numbered in ``parts`` tasks too. Rows that are equal in all three are counted
    before they are shuffled and get slots that follow each other; more than ``equal`` of them are written out by several tasks.
    Other columns are not read. An empty table gives no rows.
    """
    text = text_or_empty().cast("binary")
    # Scores of the old shards are computed once: the new one only has to beat the best of them.
    score = [F.struct((-F.ln(uniform(F.concat(key_of(), F.lit(f"/{k}")))) / F.lit(float(w))).alias("s"), F.lit(k).alias("k")) for k, w in enumerate([*weights, 1.0]) if w > 0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    d = rows.groupBy("doc_id", "text_crc32", "size").agg(F.count("*").alias("rows"))
    d = d.withColumn("best", F.array_min(F.array(*score[:-1]))).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int"))
    d = checkpointed(d.select("doc_id", "size", "text_crc32", "rows", F.col("best.k").alias("shard"), F.least("best", score[-1])["k"].alias("grown_shard"), "part"))
    # At most shards * parts rows.
    counts = d.groupBy("shard", "part").agg(F.sum("rows").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("oshard"), F.col("part").alias("opart"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("rows").over(own), F.lit(0))).join(F.broadcast(offsets), (F.col("shard") == F.col("oshard")) & (F.col("part") == F.col("opart")))
    d = d.withColumn("slot", F.col("before") + F.col("at"))
    if not d.where(F.col("rows") > equal).isEmpty():
        cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / equal))).alias("_piece")
        many = d.where(F.col("rows") > equal).select("*", cut).repartition(partitions(docs.sparkSession), "slot", "_piece")
        many = many.withColumn("slot", F.col("slot") + F.col("_piece") * equal).withColumn("rows", F.least(F.lit(equal), F.col("rows") - F.col("_piece") * equal)).drop("_piece")
        d = d.where(F.col("rows") <= equal).unionByName(many)
    slots = F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("rows") - 1)).alias("slot")
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slots, "grown_shard").withColumn("slot", F.col("slot").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents"))
