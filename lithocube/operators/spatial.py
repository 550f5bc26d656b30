"""Spatial operators on tables: nearest pixels, empirical variograms, a screen for anisotropy."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.directions import rotated
from .metrics import exact_quantiles


def around() -> Column:
    """One row for each of the nine cells around a cell."""
    return F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))


def nearest_on_axis(points: DataFrame, axis: DataFrame, coordinate: str, out: str) -> DataFrame:
    """Adds the index of the nearest value of any axis (idx, coordinate) to each point; of two as near, the lower index. The axis, one
    side of a raster, travels as one array; points stay where they are."""
    whole = axis.agg(F.collect_list(F.struct(F.col(coordinate).alias("c"), F.col("idx").alias("i"))).alias("_axis"))
    # one row, as long as a raster is wide
    near = F.array_min(F.transform("_axis", lambda a: F.struct(F.abs(a["c"] - F.col(coordinate)).alias("d"), a["i"].alias("i"))))
    return points.crossJoin(F.broadcast(whole)).withColumn(out, near["i"]).drop("_axis")


def profile(stations: DataFrame, grid: DataFrame, axis_x: DataFrame, axis_y: DataFrame, columns: int) -> DataFrame:
    """What a raster (pixel, ...) holds at each station's nearest pixel."""
    placed = nearest_on_axis(nearest_on_axis(stations, axis_x, "x", "col"), axis_y, "y", "row")
    at = placed.select("station", (F.col("row") * columns + F.col("col")).cast("int").alias("pixel"))
    # a row for each station
    return grid.join(F.broadcast(at), "pixel")


def pairs(points: DataFrame, reach: float, key: str = "station", value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, dx, dy, dist, dv) of points a < b within reach that agree in the columns `by`, by an equi-join on square cells as wide as the
    reach."""
    placed = points.withColumn("_cx", F.floor(F.col("x") / reach)).withColumn("_cy", F.floor(F.col("y") / reach))
    a = placed.select(*by, F.col(key).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col(value).alias("av"), "_cx", "_cy").withColumn("_o", around())
    a = a.withColumn("_cx", F.col("_cx") + F.col("_o.i")).withColumn("_cy", F.col("_cy") + F.col("_o.j")).drop("_o")
    b = placed.select(*by, F.col(key).alias("b"), "x", "y", F.col(value).alias("v"), "_cx", "_cy")
    near = a.join(b, [*by, "_cx", "_cy"]).where("a < b").withColumns({"dx": F.col("ax") - F.col("x"), "dy": F.col("ay") - F.col("y"), "dv": F.col("av") - F.col("v")})
    return near.withColumn("dist", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where((F.col("dist") > 0) & (F.col("dist") <= reach)).select(*by, "a", "b", "dx", "dy", "dist", "dv")


def nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, others: bool = False) -> DataFrame:
    """(left_key, right_key, square) for each row of `left` the nearest row of `right` (both with x and y), of those as near the one of the smallest
    key; none if `right` is empty. Rows without coordinates have and are no neighbours. others: `right` are the same rows, and none is its own
    neighbour.

    Both lie in square cells, of a side that gives one point a cell on average, and of sides doubled again and again. If the nine cells around a
    row hold a point at some level, the nearest one is less than 2.83 sides away, and the nine cells two levels above hold all
    points within four. Rows of a cell of the lowest level take the first such level together, and candidates come by one equi-join.
    """
    points = right.where("x is not null and y is not null").select(F.col(right_key).alias("_k"), F.col("x").alias("_px"), F.col("y").alias("_py"))
    rows = left.where("x is not null and y is not null").select(left_key, "x", "y")
    box = points.agg(F.min("_px"), F.max("_px"), F.min("_py"), F.max("_py"), F.count(F.lit(1))).first()
    mine = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not box[4] or mine[0] is None:
        return rows.limit(0).select(left_key, F.lit(None).cast(points.schema["_k"].dataType).alias(right_key), F.lit(0.0).alias("square"))
    wide = max(box[1] - box[0], box[3] - box[2])
    side = (wide or 1.0) / max(1.0, box[4] ** 0.5)
    whole = max(box[1], mine[1]) - min(box[0], mine[0]), max(box[3], mine[3]) - min(box[2], mine[2])
    top = max(0, math.ceil(math.log2(max(1.0, max(whole) / side)))) + 1  # at this level the nine cells around a row hold everything
    x0, y0 = min(box[0], mine[0]), min(box[2], mine[2])
    cell = lambda v, o: F.floor((F.col(v) - o) / side).cast("long")
    up = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    levels = F.explode(F.sequence(F.lit(0), F.lit(top + 2))).alias("level")
    held = points.withColumns({"_cx": cell("_px", x0), "_cy": cell("_py", y0)}).select("*", levels).withColumns({"_cx": up("_cx"), "_cy": up("_cy")})
    spread = held.withColumn("_o", around()).withColumns({"_cx": F.col("_cx") + F.col("_o.i"), "_cy": F.col("_cy") + F.col("_o.j")}).drop("_o")
    filled = spread.groupBy("level", "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (1 if others else 0)).drop("_n")
    placed = rows.withColumns({"_hx": cell("x", x0), "_hy": cell("y", y0)})
    homes = placed.select("_hx", "_hy").distinct().select("_hx", "_hy", levels).withColumns({"_cx": up("_hx"), "_cy": up("_hy")})
    chosen = homes.join(filled, ["level", "_cx", "_cy"]).groupBy("_hx", "_hy").agg((F.least(F.min("level"), F.lit(top)) + 2).alias("level")).withColumns({"_cx": up("_hx"), "_cy": up("_hy")})
    given = placed.join(chosen, ["_hx", "_hy"]).join(spread, ["level", "_cx", "_cy"])
    square = (F.col("x") - F.col("_px")) * (F.col("x") - F.col("_px")) + (F.col("y") - F.col("_py")) * (F.col("y") - F.col("_py"))
    given = given.where(F.col("_k") != F.col(left_key)) if others else given
    best = given.groupBy(left_key).agg(F.min(F.struct(square.alias("square"), F.col("_k").alias("k"))).alias("b"))
    return best.select(left_key, F.col("b.k").alias(right_key), F.col("b.square").alias("square"))


def empirical_variogram(pairs_: DataFrame, width: float, n: int, keys: list[str] | None = None) -> DataFrame:
    """(bin, lag, semivariance, n_pairs): bins (lo, hi]."""
    binned = pairs_.withColumn("bin", (F.ceil(F.col("dist") / width) - 1).cast("int")).where(F.col("bin") < n)
    out = binned.groupBy(*(keys or []), "bin").agg((F.avg(F.col("dv") * F.col("dv")) / 2).alias("semivariance"), F.count(F.lit(1)).alias("n_pairs"))
    return out.withColumn("lag", (F.col("bin") + 0.5) * width)


def in_direction(pairs_: DataFrame, directions: list[float], tolerance: float = 22.5) -> DataFrame:
    """Pairs along each direction or against it, within the tolerance."""
    axis = F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(180.0))
    spread = pairs_.withColumn("direction", F.explode(F.array(*[F.lit(float(d)) for d in directions])))
    off = F.abs(axis - F.pmod(F.col("direction"), F.lit(180.0)))
    return spread.where(F.least(off, 180 - off) <= tolerance)


def farthest(points: DataFrame) -> float:
    """The largest distance between two points (x, y): tasks keep the corners of their points' convex hull, and so does one of these corners."""

    def corners(batches):
        kept = np.zeros((0, 2))
        for pdf in batches:
            kept = hull(np.vstack([kept, pdf[["x", "y"]].dropna().to_numpy(float)]))
        yield pd.DataFrame(kept, columns=["x", "y"])

    schema = "x double, y double"
    last = points.select("x", "y").mapInPandas(corners, schema).coalesce(1).mapInPandas(corners, schema).toPandas().to_numpy()
    return max((float(np.sqrt(((last - p) ** 2).sum(axis=1)).max()) for p in last), default=0.0)


def hull(at: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points, by a chain below and one above."""
    at = np.unique(at, axis=0)
    if len(at) < 3:
        return at

    def chain(rows: list) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    rows = at.tolist()
    return np.array(chain(rows)[:-1] + chain(rows[::-1])[:-1])


def lag_parameters(points: DataFrame, key: str = "station", least: int = 6, most: int = 30, wanted: int = 30) -> dict:
    """Width, reach and number of lags from median nearest-neighbour and largest distance. Neighbours come from `nearest`, the largest distance from
    hulls, so no table of all pairs is made; the loop over the number of lags is on two numbers."""
    n = points.count()
    near = nearest(points, points.withColumnRenamed(key, "_other"), key, "_other", others=True).select(F.sqrt("square").alias("nn"))
    found = exact_quantiles(near, "nn", [0.5]).first()
    nn, far = (found["quantile"] if found else 0.0), farthest(points)
    width = max(2 * nn, far * 0.01) or 1.0
    max_lag, total = far / 2, n * (n - 1) // 2
    lags = min(max(int(round(max_lag / width)), least), most)
    while total / lags < wanted and lags > least:
        lags -= 1
    return {"n_lags": lags, "lag_width": max_lag / lags, "max_lag": max_lag, "max_dist": far, "median_nn": nn, "n_total_pairs": total}


def anisotropy_screen(points: DataFrame, directions: int = 8, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """(by, angle, variance) for each direction, and the ratio of the extremes on every row. For a direction the points are cut
    into bins along the axis turned the other way round (the screen's own convention); the mean of the bins' population variances counts.

    A direction's extremes, its bins and the ratio are aggregations whose partial sums are made where the points are; only rows of a
    direction or a bin are joined.
    """
    angles = [180.0 * k / directions for k in range(directions)]
    turned = points.withColumn("angle", F.explode(F.array(*[F.lit(a) for a in angles])))
    along, _ = rotated(F.col("x"), F.col("y"), -F.col("angle"))
    turned = turned.withColumn("u", along)
    keys = [*by, "angle"]
    spans = turned.groupBy(*keys).agg(F.min("u").alias("_lo"), F.max("u").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.var_pop(value).alias("_all"))
    spans = spans.withColumn("_edges", F.least(F.lit(10), F.floor(F.col("_n") / 3)))
    index = F.floor((F.col("u") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (F.col("_edges") - 1)) + 1
    binned = turned.join(F.broadcast(spans) if not by else spans, keys).where("_edges >= 2").withColumn("bin", index).where(F.col("bin") < F.col("_edges"))
    bins = binned.groupBy(*keys, "bin").agg(F.var_pop(value).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").groupBy(*keys).agg(F.avg("v").alias("variance"))
    few = spans.where("_edges < 2").select(*keys, F.col("_all").alias("variance"))
    per = bins.unionByName(few)
    whole = per.groupBy(*by).agg(F.max("variance").alias("_top"), F.min("variance").alias("_low"))
    both = per.join(whole, list(by)) if by else per.crossJoin(F.broadcast(whole))  # one row
    ratio = F.col("_top") / (F.col("_low") + 1e-10)
    return both.select(*keys, "variance", ratio.alias("ratio"), (ratio > 1.5).alias("anisotropic"))
