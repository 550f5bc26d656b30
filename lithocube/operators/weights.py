"""Depth weights and what is predicted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAP = 0.99


def totals(model: DataFrame, insar: DataFrame, mode: str = "last", keys: tuple[str, ...] = ("station",)) -> DataFrame:
    """(keys, layer, total, surface): the last epoch of cumulative series, or sums over epochs (mode epoch_sum)."""
    if mode == "last":
        layers = model.groupBy(*keys, "layer").agg(F.max_by("m", "epoch").alias("total"))
        top = insar.groupBy(*keys).agg(F.max_by("d", "epoch").alias("surface"))
    else:
        layers = model.groupBy(*keys, "layer").agg(F.sum("m").alias("total"))
        top = insar.groupBy(*keys).agg(F.sum("d").alias("surface"))
    return layers.join(top, list(keys))


def depth_weights(totals_: DataFrame, cap: float | None = CAP, keys: tuple[str, ...] = ("station",)) -> DataFrame:
    """(keys, layer, w): a layer's part of the surface; a surface of 0 or less counts as 1; sums over the cap shrink to it."""
    w = totals_.withColumn("w", F.col("total") / F.when(F.col("surface") > 0, F.col("surface")).otherwise(F.lit(1.0)))
    if cap is not None:
        s = F.sum("w").over(Window.partitionBy(*keys))
        w = w.withColumn("_s", s).withColumn("w", F.when(F.col("_s") > cap, F.col("w") * (cap / F.col("_s"))).otherwise(F.col("w"))).drop("_s")
    return w.select(*keys, "layer", "w")


def well_shares(model: DataFrame) -> DataFrame:
    """(station, layer, w): a layer's part of the station's layers together, at the last epoch; they add up to 1. A total of 0 or less counts as 1."""
    last = model.groupBy("station", "layer").agg(F.max_by("m", "epoch").alias("total"))
    whole = F.sum("total").over(Window.partitionBy("station"))
    return last.select("station", "layer", (F.col("total") / F.when(whole > 0, whole).otherwise(F.lit(1.0))).alias("w"))


def fold_predictions(model: DataFrame, insar: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, station, layer, epoch, pred, truth): each fold's weights come from the series up to its train_end, and are applied to its
    window's surface."""
    # three fold rows
    f = F.broadcast(folds)
    keys = ("fold", "station")
    seen = lambda df: df.join(f, F.col("epoch") <= F.col("train_end"))
    w = depth_weights(totals(seen(model), seen(insar), keys=keys), keys=keys)
    inside = insar.join(f, F.col("epoch").between(F.col("val_start"), F.col("val_end"))).select("fold", "station", "epoch", "d")
    pred = predict(w, inside, ["fold", "station"])
    return pred.join(model, ["station", "layer", "epoch"]).select("fold", "station", "layer", "epoch", "pred", F.col("m").alias("truth"))


def mean_of_others(weights: DataFrame) -> DataFrame:
    """(station, layer, pred, truth): each station's weight as the mean of all others', of which it has no part. With one station null."""
    per = weights.groupBy("layer").agg(F.sum("w").alias("_s"), F.count("w").alias("_n"))
    # a row for each layer
    out = weights.join(F.broadcast(per), "layer")
    return out.select("station", "layer", ((F.col("_s") - F.col("w")) / F.nullif(F.col("_n") - 1, F.lit(0))).alias("pred"), F.col("w").alias("truth"))


def station_coverage(weights: DataFrame) -> DataFrame:
    return weights.groupBy("station").agg(F.sum("w").alias("coverage"))


def normalise(weights: DataFrame, key: str = "station", value: str = "w") -> DataFrame:
    """Negative weights are 0; sums over 1 are divided to 1."""
    clipped = weights.withColumn(value, F.greatest(F.col(value), F.lit(0.0)))
    s = F.sum(value).over(Window.partitionBy(key))
    return clipped.withColumn("_s", s).withColumn(value, F.when(F.col("_s") > 1, F.col(value) / F.col("_s")).otherwise(F.col(value))).drop("_s")


def predict(weights: DataFrame, insar: DataFrame, key: str | list[str] = "station") -> DataFrame:
    """Weight times surface, for each layer and epoch; with a column std also the predicted spread."""
    out = insar.join(weights, key).withColumn("pred", F.col("w") * F.col("d"))
    return out.withColumn("pred_std", F.col("std") * F.abs("d")) if "std" in weights.columns else out


def deep_residual(weights: DataFrame, insar: DataFrame, key: str = "station") -> DataFrame:
    """(key, epoch, d, residual): the surface less all layers, as d * (1 - sum of weights): sums before the join, a layer's
    factor fewer rows. A missing weight makes the residual null."""
    whole = weights.groupBy(key).agg(F.when(F.count("w") == F.count(F.lit(1)), F.sum("w")).alias("_w"))
    return insar.join(whole, key).select(key, "epoch", "d", (F.col("d") * (1 - F.col("_w"))).alias("residual"))


def deep_residual_std(weights: DataFrame, insar: DataFrame, key: str = "station") -> DataFrame:
    """(key, epoch, residual, residual_std): as `deep_residual` for weights with a column std, with the root of the layers' summed
    variances times the surface; a missing spread makes it null."""
    spread = weights.groupBy(key).agg(F.when(F.count("std") == F.count(F.lit(1)), F.sqrt(F.sum(F.col("std") * F.col("std")))).alias("_std"))
    out = deep_residual(weights, insar, key).join(spread, key)
    return out.select(key, "epoch", "residual", (F.col("_std") * F.abs("d")).alias("residual_std"))


def total_std(pred: DataFrame, layer_rmse: DataFrame, epoch_std: DataFrame) -> DataFrame:
    """Spread of the model, of the layer's validation error times the surface, and of the epoch's fold, in one."""
    both = pred.join(F.broadcast(layer_rmse), "layer", "left").join(epoch_std, ["layer", "epoch"], "left")
    r, t = F.coalesce(F.nanvl("rmse", F.lit(0.0)), F.lit(0.0)), F.coalesce(F.nanvl("sigma_t", F.lit(0.0)), F.lit(0.0))
    return both.withColumn("total_std", F.sqrt(F.col("pred_std") ** 2 + (r * F.col("d")) ** 2 + t * t))


def low_confidence(std: DataFrame, key: str, threshold: float) -> DataFrame:
    return std.groupBy(key).agg(F.coalesce(F.max("std") > threshold, F.lit(False)).alias("low_confidence"))


def sanity(residuals: DataFrame) -> DataFrame:
    return residuals.agg(F.count_if(F.col("residual") < -0.1).alias("below_01"), F.count_if(F.col("residual") < -1.0).alias("below_1"), F.count(F.lit(1)).alias("n"))
