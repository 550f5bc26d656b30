"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import table
from .columns import md5_bucket, unit_interval

#: Row groups in which the slots of a shard are counted: a fixed number, so the table of counts has at most shards x this many rows.
SLOT_BUCKETS = 1024


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score -w / ln(u) is highest, u being a uniform hash of (key, shard number).

    A shard's score depends on the key, its own number and its own weight only. A further shard therefore wins
    some rows for itself and moves no other row; a larger weight only pulls rows to that shard. Shards of weight 0
    get nothing. Null keys hash as one key of their own. Equal scores go to the lower number.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights: one number >= 0 for each shard, one of them above 0")
    scored = [
        F.struct((-F.lit(float(w)) / F.log(unit_interval(key, F.lit(s)))).alias("score"), F.lit(-s).alias("minus"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["minus"]).cast("int")


def assign_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds a number within each shard, gapless from 0.

    Rows are ordered by a hash bucket and then by `order`. Each (shard, bucket) counts its own rows, the bounded
    table of counts (shards x buckets rows) is summed up and broadcast, so no task sees a whole shard.
    """
    salted = df.withColumn("_bucket", md5_bucket(*[F.col(c) for c in order], buckets=buckets))
    counts = salted.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order)
    return (
        salted.join(F.broadcast(starts), [shard, "_bucket"])
        .withColumn(slot, (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_bucket", "_start")
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    size: UTF-8 bytes of the text and 1 (null text: 1). text_crc32: 0 for a null or empty text. grown_shard: the shard if
    one more shard of weight 1 were added. Rows with a null key share one shard. Repeated rows get the same shard
    and slots of their own. An empty table gives no rows; further columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col(key), weights).alias("shard"),
        rendezvous_shard(F.col(key), [*weights, 1.0]).alias("grown_shard"),
    )
    out = assign_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * 8)
