"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import table
from .columns import md5_bucket, unit_interval, word_count

#: Groups into which rows of one source and one size are dealt, so that a hot size is counted by many tasks.
SALTS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).

    Sources in order of code points, null last, take the weights in turn. The targets share the total by weight;
    none exceeds `most` times its source's size, and what is over is shared again by weight. That fixed point is a
    water level: with sources ordered by most * size / weight, the full ones are a prefix, and the level is
    what they leave over the weights of the rest. One row for each source is in the windows, not one for each document.
    """
    ranked = sizes.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("_cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_k")
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = caps.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("weight") >= F.col("_cap"))
    first = F.min(F.when(~F.col("_full"), F.struct((F.col("_cap") / F.col("weight")).alias("q"), F.col("_k"), F.col("_level")))).over(everything)
    target = F.when(F.col("_full") | first.isNull(), F.col("_cap")).otherwise(F.least(first["_level"] * F.col("weight"), F.col("_cap")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def prefix_ranks(df: DataFrame, group: str, order: str, key: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Adds rank: 1, 2, ... within `group` by (order, salt, key), without a task that holds a whole group.

    Rows are counted for each (group, order, salt); these counts are summed up in two small steps and joined back,
    and only rows of one (group, order, salt) are numbered together.
    """
    salted = df.withColumn("_salt", md5_bucket(*[F.col(k) for k in key], buckets=salts))
    cells = salted.groupBy(group, order, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    steps = cells.groupBy(group, order).agg(F.sum("_n").alias("_m"))
    up_to = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_base", F.coalesce(F.sum("_m").over(up_to(group, order)), F.lit(0))).drop("_m")
    cells = cells.withColumn("_in", F.coalesce(F.sum("_n").over(up_to(group, order, "_salt")), F.lit(0))).drop("_n")
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    starts = cells.alias("c").join(steps.alias("s"), same(cells, steps, [group, order])).select(cells[group], cells[order], cells["_salt"], (F.col("_base") + F.col("_in")).alias("_start"))
    inside = Window.partitionBy(group, order, "_salt").orderBy(*key)
    numbered = salted.withColumn("_row", F.row_number().over(inside))
    out = numbered.join(starts, same(numbered, starts, [group, order, "_salt"]), "inner")
    return out.select(*[numbered[c] for c in df.columns], (F.col("_start") + F.col("_row")).cast("long").alias("rank"))


def copies_of(rank: Column, expected: Column, offset: Column) -> Column:
    """Integer boundaries crossed by the expected copies summed up to this row, from the row before on."""
    return (F.floor(expected * rank + offset) - F.floor(expected * (rank - 1) + offset)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 20, key: str = "doc_id", text: str = "text", source: str = "source", payload: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, and payload columns) for every row.

    Every document of a source is expected target / source_size times, at most `most` times. These are summed up in
    order of size and key within the source, so that neighbours are alike and the words taken come near the target; one
    offset for each source, hashed from the seed and its name, makes reruns agree. A document is taken
    once for each integer that its share of the sum crosses. Sources of size 0 and the documents of an empty table are
    taken 0 times; a null source is a source; null texts have size 0. Repeated rows are rows of their own. Texts may be as long as a
    value of Spark. Payload columns with a name of the result's own are refused, other columns are ignored.
    """
    if {"doc_id", "source", "size", "source_size", "target", "copies"} & set(payload):
        raise ValueError("payload: no name of the result's own")
    inner = [f"payload_{k}" for k in range(len(payload))]
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *(F.col(f"`{p}`").alias(i) for p, i in zip(payload, inner, strict=True)))
    totals = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ranked = prefix_ranks(sized, "source", "size", ["doc_id"])
    joined = ranked.join(totals, ranked["source"].eqNullSafe(totals["source"])).drop(totals["source"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit_interval(F.lit(seed), F.col("source"))
    out = joined.withColumn("copies", copies_of(F.col("rank"), expected, offset)).drop("rank", "weight")
    return out.withColumnsRenamed(dict(zip(inner, payload, strict=True)))


def op5_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
