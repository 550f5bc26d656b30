"""The engine's tables, bound to the star schema: a cube of layered series, surface series, stations and a raster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table

EPOCHS, LAYERS = 83, 7
#: Regular raster axes: (origin, step, cells).
X_AXIS, Y_AXIS = (160000.0, 500.0, 106), (2600000.0, 500.0, 121)


class Shared:
    """A query's cube, made once as a checkpoint, with what else is made of it once; tables take it in place of the folder."""

    def __init__(self, cube: DataFrame):
        self.cube, self.made = cut(cube), {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = cut(make())
        return self.made[name]


Source = str | Shared


def shared(spark: SparkSession, sf_dir: str) -> Shared:
    return Shared(cube(spark, sf_dir))


def cube(spark: SparkSession, sf_dir: Source) -> DataFrame:
    """(station, layer, epoch, value): increments, negative = subsidence. One shuffle, pre-aggregated in the scan's stage."""
    if isinstance(sf_dir, Shared):
        return sf_dir.cube
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_shipdate", "l_quantity")
    return items.groupBy(
        (F.col("l_suppkey") % 31).cast("int").alias("station"),
        F.col("l_linenumber").cast("int").alias("layer"),
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("epoch"),
    ).agg((-F.sum("l_quantity") / 100).alias("value"))


def observations(spark: SparkSession, sf_dir: Source) -> DataFrame:
    """The cube with about a ninth of its cells missing."""
    return cube(spark, sf_dir).where((F.col("station") * 7 + F.col("layer") * 3 + F.col("epoch")) % 11 != 0)


def surface(spark: SparkSession, sf_dir: Source) -> DataFrame:
    """(station, epoch, d): surface increments; the deep part is 15 % of the layers' sum. Some stations lack two thirds."""
    seen = ~((F.col("station") % 8 == 5) & (F.col("epoch") % 3 != 0))
    return cube(spark, sf_dir).where(seen).groupBy("station", "epoch").agg((F.sum("value") * 1.15).alias("d"))


def stations(spark: SparkSession, sf_dir: Source) -> DataFrame:
    """(station, x, y) in projected metres: the suppliers' stations, or those of a cube."""
    if isinstance(sf_dir, Shared):
        named = sf_dir.cube.select("station").distinct()
    else:
        named = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 31).cast("int").alias("station")).distinct()
    s = F.col("station")
    return named.select(s, (160000.0 + (s * 37 % 31) * 1700).cast("double").alias("x"), (2600000.0 + (s * 53 % 29) * 2100).cast("double").alias("y"))


def epochs(spark: SparkSession, sf_dir: Source) -> DataFrame:
    """(epoch): the months that the cube has."""
    return cube(spark, sf_dir).select("epoch").distinct()


def axis(spark: SparkSession, name: str) -> DataFrame:
    """(idx, x) or (idx, y): one side of the bound raster."""
    origin, step, cells = {"x": X_AXIS, "y": Y_AXIS}[name]
    return spark.range(cells).select(F.col("id").cast("int").alias("idx"), (origin + step * F.col("id")).alias(name))


def raster(spark: SparkSession, sf_dir: Source, rows: int = 12, columns: int = 10) -> DataFrame:
    """(t, y_idx, x_idx, x, y, depth, disp): a raster cube in long form, one block of cells for each station's series; the surface at depth
    0 and the layers below it. Missing cells are NaN, as files have them."""
    of = F.explode(F.sequence(F.lit(0), F.lit(rows * columns - 1))).alias("cell")
    cells = spark.range(1).select(of).select((F.col("cell") / columns).cast("int").alias("y_idx"), (F.col("cell") % columns).cast("int").alias("x_idx"), (F.col("cell") % 31).cast("int").alias("station"))
    layers = observations(spark, sf_dir).select("station", F.col("epoch").alias("t"), (F.col("layer") * 10).alias("depth"), "value")
    top = surface(spark, sf_dir).select("station", F.col("epoch").alias("t"), F.lit(0).alias("depth"), F.col("d").alias("value"))
    gone = (F.col("x_idx") + F.col("y_idx") + F.col("t")) % 13 == 0
    # cells: a bounded table
    both = layers.unionByName(top).join(F.broadcast(cells), "station")
    x, y = X_AXIS[0] + X_AXIS[1] * F.col("x_idx"), Y_AXIS[0] + Y_AXIS[1] * F.col("y_idx")
    return both.select("t", "y_idx", "x_idx", x.alias("x"), y.alias("y"), "depth", F.when(gone, F.lit(float("nan"))).otherwise(F.col("value")).alias("disp"))
