"""Validation metrics, selections and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def errors(df: DataFrame, keys: list[str], spread: bool = True) -> DataFrame:
    """rmse, mae, bias and population spread of pred - truth for each key."""
    e = F.col("pred") - F.col("truth")
    out = [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias")]
    return df.groupBy(*keys).agg(*out, *([F.stddev_pop(e).alias("std_error")] if spread else []))


def fold_errors(df: DataFrame, keys: list[str]) -> DataFrame:
    """rmse, mae, bias, correlation and count; with fewer than two rows all but the count are null."""
    e, n = F.col("pred") - F.col("truth"), F.count("pred")
    some = lambda c: F.when(n >= 2, c)
    return df.groupBy(*keys).agg(some(F.sqrt(F.avg(e * e))).alias("rmse"), some(F.avg(F.abs(e))).alias("mae"), some(F.avg(e)).alias("bias"), some(F.corr("pred", "truth")).alias("correlation"), n.alias("n_valid"))


def apart_from_tuning(df: DataFrame, keys: list[str], tuned: int = 3) -> DataFrame:
    """fold_errors of the fold that smoothing is tuned on and of the others, apart (column tuned): the former is too good."""
    return fold_errors(df.withColumn("tuned", F.col("fold") == tuned), [*keys, "tuned"])


def station_layer_errors(df: DataFrame, keys: list[str]) -> DataFrame:
    """rmse, mae and count; without rows that have both values rmse and mae are null."""
    e = F.col("pred") - F.col("truth")
    return df.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(e).alias("n_valid"))


def column_errors(df: DataFrame, layers: list[int], depth: int = 10) -> DataFrame:
    """For each station the sums of its layers, predicted and true, their error, and every layer's error in a column error_l<depth>."""
    e = F.col("pred") - F.col("truth")
    sums = [F.sum("pred").alias("total_pred"), F.sum("truth").alias("total_true")]
    wide = [F.max(F.when(F.col("layer") == k, e)).alias(f"error_l{depth * k}") for k in layers]
    out = df.groupBy("station").agg(*sums, *wide).withColumn("total_error", F.col("total_pred") - F.col("total_true"))
    return out.withColumn("total_abs_error", F.abs("total_error"))


def worst_groups(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k groups of the largest mean; missing values don't count, ties go to the smaller group."""
    return df.groupBy(group).agg(F.avg(value).alias("mean")).where("mean is not null").orderBy(F.desc("mean"), group).limit(k)


def worst_deep_fraction(weights: DataFrame, k: int = 3) -> DataFrame:
    """The k stations at which the largest part of the surface lies below all layers: (station, deep_fraction)."""
    return weights.groupBy("station").agg((1 - F.sum("w")).alias("deep_fraction")).orderBy(F.round("deep_fraction", 9).desc(), "station").limit(k)


def station_errors(df: DataFrame, least: float = 1e-9) -> DataFrame:
    """rmse and mae for each station that has observations: the largest is above `least`."""
    e = F.col("pred") - F.col("truth")
    has = F.max(F.abs("truth")) > least
    return df.groupBy("station").agg(F.when(has, F.sqrt(F.avg(e * e))).alias("rmse"), F.when(has, F.avg(F.abs(e))).alias("mae"), has.alias("has_obs"))


def rmss(pred: Column, truth: Column, std: Column) -> Column:
    z = (truth - pred) / (std + 1e-8)
    return F.sqrt(F.avg(z * z))


def best(trials: DataFrame, score: str = "mean_rmse", ties: tuple[str, ...] = ("lam", "lam_t")) -> DataFrame:
    return trials.where(F.col(score).isNotNull()).orderBy(score, *ties).limit(1)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: of rows with one key, the last stays."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Adds rank, from 0 on, by `order`: rows are sorted by range, each partition numbers its own, and the partitions' counts, a row
    each, are summed up before. No task sees all rows."""
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # a row for each partition
    return placed.withColumn("_row", inside).join(F.broadcast(starts), "_part").withColumn("rank", (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_start")


#: Bins of a round of counting.
BINS = 4096


def exact_quantiles(df: DataFrame, value: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q, quantile): exact quantiles with linear interpolation between the two values around each. Nulls and NaN don't count; a group without
    values has no row.

    Selection by counting: values fall into BINS equal bins between their group's extremes, and these into BINS again. The first
    round counts all bins, the second the bins within those that hold a wanted rank, and only values of the bins found then, counted by value,
    are put in order. Counts are summed where the values are; what comes together are BINS counts of a group, and the last bins' values.
    """
    one = [*by] or ["_one"]
    rows = (df if by else df.withColumn("_one", F.lit(0))).select(*one, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    spans = rows.groupBy(*one).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    spans = cut(spans)
    rank = F.col("_q") * (F.col("_n") - 1)
    wanted = spans.select("*", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("_q"))
    wanted = wanted.select(*one, "_n", "_q", F.explode(F.array(F.floor(rank), F.ceil(rank))).alias("_rank")).distinct()
    place = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS).otherwise(F.lit(0.0))
    first = F.least(F.floor(place), F.lit(BINS - 1))
    binned = rows.join(_sized(spans.select(*one, "_lo", "_hi")), one).withColumn("_a", first).withColumn("_b", F.least(F.floor((place - first) * BINS), F.lit(BINS - 1))).select(*one, "_v", "_a", "_b")

    a = binned.groupBy(*one, "_a").agg(F.count(F.lit(1)).alias("_m")).join(_sized(wanted.select(*one, "_q", "_rank")), one)
    a = a.withColumn("_end", F.sum("_m").over(Window.partitionBy(*one, "_q", "_rank").orderBy("_a"))).where("_end > _rank and _end - _m <= _rank")
    in_a = cut(a.select(*one, "_a", "_q", "_rank", (F.col("_rank") - F.col("_end") + F.col("_m")).alias("_left")))
    b = binned.join(_sized(in_a.select(*one, "_a").distinct()), [*one, "_a"]).groupBy(*one, "_a", "_b").agg(F.count(F.lit(1)).alias("_m"))
    b = b.join(_sized(in_a), [*one, "_a"]).withColumn("_end", F.sum("_m").over(Window.partitionBy(*one, "_q", "_rank").orderBy("_b"))).where("_end > _left and _end - _m <= _left")
    in_b = cut(b.select(*one, "_a", "_b", "_q", "_rank", (F.col("_left") - F.col("_end") + F.col("_m")).alias("_left")))
    last = binned.join(_sized(in_b.select(*one, "_a", "_b").distinct()), [*one, "_a", "_b"]).groupBy(*one, "_a", "_b", "_v").agg(F.count(F.lit(1)).alias("_m"))
    last = last.join(_sized(in_b), [*one, "_a", "_b"]).withColumn("_end", F.sum("_m").over(Window.partitionBy(*one, "_q", "_rank").orderBy("_v")))
    found = last.where("_end > _left and _end - _m <= _left").select(*one, "_q", "_rank", "_v")
    ends = found.groupBy(*one, "_q").agg(F.min_by("_v", "_rank").alias("_low"), F.max_by("_v", "_rank").alias("_high")).join(spans.select(*one, "_n"), one)
    part = F.col("_q") * (F.col("_n") - 1) - F.floor(F.col("_q") * (F.col("_n") - 1))
    return ends.select(*by, F.col("_q").alias("q"), (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias("quantile"))


def _sized(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if they are 100,000 at most."""
    return F.broadcast(rows) if rows.limit(100_001).count() <= 100_000 else rows


def rank_picks(df: DataFrame, value: str, key: str) -> DataFrame:
    """The rows at the lowest and highest rank and a third and two thirds between, each once."""
    rows = ranked(df, value, key)
    n = rows.agg(F.count(F.lit(1)).alias("_n"))  # one row
    wanted = F.array(F.lit(0).cast("long"), F.col("_n") - 1, F.floor(F.col("_n") / 3), F.floor(F.col("_n") * 2 / 3))
    return rows.crossJoin(F.broadcast(n)).where(F.array_contains(wanted, F.col("rank"))).drop("rank", "_n")


def interval_sums(df: DataFrame, bounds: list[tuple[float, float]]) -> DataFrame:
    """Sums over depth intervals that hold both their ends, for each station; without values 0."""
    spans = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in bounds])).alias("span")
    # each row meets as many intervals as were given
    inside = F.when(F.col("depth").between(F.col("span.lo"), F.col("span.hi")), F.col("value"))
    spread = df.select("station", "depth", "value", spans)
    return spread.groupBy("station", F.col("span.lo").alias("lo"), F.col("span.hi").alias("hi")).agg(F.coalesce(F.sum(inside), F.lit(0.0)).alias("total"))


def verdict(df: DataFrame, threshold: float) -> DataFrame:
    """Station rmse, their mean for each layer, the mean of these, and PASS or FAIL."""
    e = F.col("pred") - F.col("truth")
    stations = df.groupBy("layer", "station").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    layers = stations.groupBy("layer").agg(F.avg("rmse").alias("rmse"))
    return layers.agg(F.avg("rmse").alias("overall")).withColumn("result", F.when(F.col("overall") <= threshold, "PASS").otherwise("FAIL"))
