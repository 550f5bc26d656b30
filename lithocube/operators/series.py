"""Time-series operators: discovery, slices, gaps, sums, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def discover_epochs(labels: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels in order of the number at their end (unpadded names too) -> (label, epoch)."""
    found = labels.select(label).distinct().withColumn("_n", F.regexp_extract(label, r"(\d+)$", 1).cast("int"))
    return found.withColumn("epoch", (F.dense_rank().over(Window.orderBy("_n")) - 1).cast("int")).drop("_n")


def slice_epochs(df: DataFrame, start: int, end: int, epoch: str = "epoch") -> DataFrame:
    """Both ends included; epochs count from the start again."""
    return df.where(F.col(epoch).between(start, end)).withColumn(epoch, (F.col(epoch) - start).cast("int"))


def coverage(surface: DataFrame, total: int, fraction: float = 0.5) -> DataFrame:
    """(station, n_valid, kept): over all epochs, before any slice."""
    n = surface.groupBy("station").agg(F.count("d").alias("n_valid"))
    return n.withColumn("kept", F.col("n_valid") >= fraction * total)


def without(df: DataFrame, stations: DataFrame, held_out: int) -> DataFrame:
    """All rows but one station's, the others numbered from 0 on without a gap in column `index`."""
    left = stations.select("station").where(F.col("station") != held_out)
    # a row for each station
    numbers = left.withColumn("index", (F.row_number().over(Window.orderBy("station")) - 1).cast("int"))
    return df.join(F.broadcast(numbers), "station")


def valid_depths(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Layers with any value at any of the stations."""
    return obs.where(F.col("value").isNotNull()).join(stations.select("station"), "station", "left_semi").select("layer").distinct()


def densify(df: DataFrame, keys: list[str], epochs: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Every epoch for every key: the keys' own table times the bounded list of epochs, not a product of rows."""
    grid = df.select(*keys).distinct().withColumn(epoch, F.explode(F.sequence(F.lit(0), F.lit(_last(epochs, epoch)))))
    return grid.withColumn(epoch, F.col(epoch).cast("int")).join(df, [*keys, epoch], "left")


def _last(epochs: DataFrame | int, epoch: str) -> int:
    return epochs if isinstance(epochs, int) else epochs.agg(F.max(epoch)).first()[0]


def fill_gaps(df: DataFrame, keys: list[str], value: str, epoch: str = "epoch") -> DataFrame:
    """Linear inside, the nearest value outside, 0 for a series without values. One sort of each series."""
    order = Window.partitionBy(*keys).orderBy(epoch)
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(epoch).alias("e"), F.col(value).alias("v")))
    seen = df.withColumn("_p", F.last(at, True).over(back)).withColumn("_n", F.first(at, True).over(ahead))
    p, n = F.col("_p"), F.col("_n")
    line = p["v"] + (n["v"] - p["v"]) * (F.col(epoch) - p["e"]) / (n["e"] - p["e"])
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(p.isNotNull() & n.isNotNull(), line).otherwise(F.coalesce(n["v"], p["v"], F.lit(0.0)))
    return seen.withColumn(value, filled).drop("_p", "_n")


def running(keys: list[str], epoch: str = "epoch") -> Window:
    return Window.partitionBy(*keys).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)


def cumulate(df: DataFrame, keys: list[str], value: str, out: str = "cum", epoch: str = "epoch", sign: int = 1) -> DataFrame:
    return df.withColumn(out, sign * F.sum(value).over(running(keys, epoch)))


def safe_cumsum(df: DataFrame, keys: list[str], epoch: str, value: str, out: str = "cum") -> DataFrame:
    """Missing values count as 0; a series without any value stays null."""
    any_value = F.count(value).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(any_value > 0, F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(running(keys, epoch))))


def running_max(df: DataFrame, keys: list[str], value: str, out: str = "top", epoch: str = "epoch") -> DataFrame:
    return df.withColumn(out, F.max(value).over(running(keys, epoch)))


def difference(df: DataFrame, keys: list[str], value: str, out: str = "step", epoch: str = "epoch") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value, 1, 0.0).over(Window.partitionBy(*keys).orderBy(epoch)))


def folds(n_epochs: int) -> list[tuple[int, int, int, int]]:
    """(fold, last training epoch, first and last validation epoch): three windows at the end, an eighth of the epochs each,
    six at least. Fewer than 19 epochs leave nothing to train on."""
    size = max(6, n_epochs // 8)
    if n_epochs - 3 * size < 1:
        raise ValueError(f"{n_epochs} epochs are too few for three folds: 19 at least")
    starts = [n_epochs - k * size for k in (3, 2, 1)]
    return [(k + 1, s - 1, s, s + size - 1) for k, s in enumerate(starts)]


def fold_table(spark: SparkSession, n_epochs: int) -> DataFrame:
    """Three rows."""
    return spark.createDataFrame(folds(n_epochs), "fold int, train_end int, val_start int, val_end int")


def in_validation(df: DataFrame, fold_rows: DataFrame) -> DataFrame:
    """Rows of each fold's validation window, with its number (three fold rows are broadcast)."""
    return df.join(F.broadcast(fold_rows), F.col("epoch").between(F.col("val_start"), F.col("val_end")))


def spread_folds(per_fold: DataFrame, fold_rows: DataFrame, n_epochs: int) -> DataFrame:
    """Per-fold values as a step function of time: a fold holds until the next begins; the first goes back to 0."""
    order = Window.orderBy("fold")
    spans = fold_rows.withColumn("_from", F.when(F.row_number().over(order) == 1, 0).otherwise(F.col("val_start"))).withColumn("_to", F.coalesce(F.lead("val_start").over(order) - 1, F.lit(n_epochs - 1)))
    spans = spans.select("fold", F.explode(F.sequence("_from", "_to")).alias("epoch"))
    return per_fold.join(F.broadcast(spans), "fold")


def seasonal(epoch: Column, rate: float = 20 / 60, swing: float = 5.0) -> Column:
    return rate * epoch + swing * F.sin(2 * F.pi() * epoch / 12)
