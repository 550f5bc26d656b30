"""The linear operators of the inversion as DataFrame expressions: no matrix is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def forward(model: DataFrame, dz: float = 1.0) -> DataFrame:
    """G: the surface each column of layers makes, (station, epoch, d)."""
    return model.groupBy("station", "epoch").agg((dz * F.sum("m")).alias("d"))


def at_wells(model: DataFrame, wells: DataFrame) -> DataFrame:
    """I_w: the model at stations with a well."""
    return model.join(wells.select("station"), "station", "left_semi")


def vertical(model: DataFrame) -> DataFrame:
    """L: each layer less the next deeper one; the last row of a column is 0."""
    below = F.lead("m").over(Window.partitionBy("station", "epoch").orderBy("layer"))
    return model.withColumn("lm", F.coalesce(F.col("m") - below, F.lit(0.0)))


def temporal(model: DataFrame) -> DataFrame:
    """L_t: each voxel's next epoch less this one; the last epoch has no row."""
    ahead = F.lead("m").over(Window.partitionBy("station", "layer").orderBy("epoch"))
    return model.withColumn("ltm", ahead - F.col("m")).where(F.col("ltm").isNotNull())


def neighbours(stations: DataFrame, radius: float) -> DataFrame:
    """(a, b, dist, weight): pairs a < b within radius, 1 / dist over its largest value.

    Stations go to square cells as wide as the radius and are compared with those of the nine cells around, so the join is an
    equi-join on cells and its rows grow with the pairs found, not with all pairs.
    """
    placed = stations.withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    a = placed.select(F.col("station").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy").withColumn("_o", around)
    a = a.withColumn("cx", F.col("cx") + F.col("_o.i")).withColumn("cy", F.col("cy") + F.col("_o.j")).drop("_o")
    b = placed.select(F.col("station").alias("b"), "x", "y", "cx", "cy")
    dist = F.sqrt((F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y")))
    pairs = a.join(b, ["cx", "cy"]).where("a < b").withColumn("dist", dist).where((F.col("dist") > 0) & (F.col("dist") <= radius))
    top = pairs.agg(F.max(1 / F.col("dist")).alias("top"))
    return pairs.crossJoin(F.broadcast(top)).select("a", "b", "dist", (1 / F.col("dist") / F.col("top")).alias("weight"))


def components(stations: DataFrame, edges: DataFrame) -> DataFrame:
    """(station, root): the smallest station of each component; minima spread until none changes, twice as far each round."""
    itself = stations.select(F.col("station").alias("a"), F.col("station").alias("b"))
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(itself))
    label = cut(both.groupBy("a").agg(F.min("b").alias("root")))
    while True:
        step = both.join(label.select(F.col("a").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("root"))
        after = cut(step.join(label.select(F.col("a").alias("root"), F.col("root").alias("top")), "root").groupBy("a").agg(F.min("top").alias("root")))
        if after.exceptAll(label).isEmpty():
            return after.select(F.col("a").alias("station"), "root")
        label = after


def smoothness(model: DataFrame, edges: DataFrame) -> DataFrame:
    """L_s: weighted differences along edges, one row for each edge, layer and epoch."""
    left = model.select(F.col("station").alias("a"), "layer", "epoch", F.col("m").alias("ma"))
    right = model.select(F.col("station").alias("b"), "layer", "epoch", F.col("m").alias("mb"))
    return left.join(edges, "a").join(right, ["b", "layer", "epoch"]).withColumn("lsm", F.col("weight") * (F.col("ma") - F.col("mb")))


def objective(model: DataFrame, insar: DataFrame, wells: DataFrame, lam: float, lam_t: float, dz: float = 1.0) -> DataFrame:
    """One row: the parts of |Gm - d|^2 + |m - w|^2 + lam |Lm|^2 + lam_t |L_t m|^2, and their sum."""
    square = lambda c: F.coalesce(F.sum(c * c), F.lit(0.0))
    parts = [
        forward(model, dz).withColumnRenamed("d", "gm").join(insar, ["station", "epoch"]).agg(square(F.col("gm") - F.col("d")).alias("insar_part")),
        model.join(wells, ["station", "layer", "epoch"]).agg(square(F.col("m") - F.col("w")).alias("well_part")),
        vertical(model).agg((lam * square(F.col("lm"))).alias("vertical_part")),
        temporal(model).agg((lam_t * square(F.col("ltm"))).alias("temporal_part")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # rows of one number each
    return out.withColumn("total", F.col("insar_part") + F.col("well_part") + F.col("vertical_part") + F.col("temporal_part"))


def valid_surface(insar: DataFrame, floor: float = 10.0) -> DataFrame:
    """(station, top, valid): whether a station's surface ever moves by `floor` or more; others give no data and no bound."""
    return insar.groupBy("station").agg(F.max(F.abs("d")).alias("top")).withColumn("valid", F.coalesce(F.col("top") >= floor, F.lit(False)))


def stacked(model: DataFrame, insar: DataFrame, wells: DataFrame, lam: float, lam_t: float, dz: float = 1.0) -> DataFrame:
    """The augmented least-squares system as rows (part, station, epoch, layer, left, right): G m and the surface, the wells, and the
    smoothness rows scaled by the roots of lam and lam_t against 0."""
    none = F.lit(None).cast("int")
    parts = [
        forward(model, dz).withColumnRenamed("d", "gm").join(insar, ["station", "epoch"]).select(F.lit("surface").alias("part"), "station", "epoch", none.alias("layer"), F.col("gm").alias("left"), F.col("d").alias("right")),
        model.join(wells, ["station", "layer", "epoch"]).select(F.lit("well").alias("part"), "station", "epoch", "layer", F.col("m").alias("left"), F.col("w").alias("right")),
        vertical(model).select(F.lit("vertical").alias("part"), "station", "epoch", "layer", (lam**0.5 * F.col("lm")).alias("left"), F.lit(0.0).alias("right")),
        temporal(model).select(F.lit("temporal").alias("part"), "station", "epoch", "layer", (lam_t**0.5 * F.col("ltm")).alias("left"), F.lit(0.0).alias("right")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def optimality(model: DataFrame, insar: DataFrame, wells: DataFrame, lam: float, lam_t: float, bound: float = 1e-6) -> DataFrame:
    """(station, n, least, off) of a solution (station, layer, epoch, m) of the joint problem, by its own operators: the least value, and how far the
    slope of the objective is from 0 where m > bound, and below 0 elsewhere. lam_t None: epochs by themselves."""
    over_layers, over_time = Window.partitionBy("station", "epoch").orderBy("layer"), Window.partitionBy("station", "layer").orderBy("epoch")
    sums = forward(model).withColumnRenamed("d", "gm").join(insar, ["station", "epoch"]).select("station", "epoch", (F.col("gm") - F.col("d")).alias("surface_off"))
    rows = model.join(wells, ["station", "layer", "epoch"]).join(sums, ["station", "epoch"])

    def bend(over: Window) -> Column:
        """What smoothness along an order adds to the slope: twice the value less both neighbours, as far as there are any."""
        back, ahead = F.lag("m").over(over), F.lead("m").over(over)
        return F.coalesce(F.col("m") - back, F.lit(0.0)) + F.coalesce(F.col("m") - ahead, F.lit(0.0))

    slope = F.col("surface_off") + F.col("m") - F.col("w") + lam * bend(over_layers) + (lam_t * bend(over_time) if lam_t is not None else F.lit(0.0))
    off = F.when(F.col("m") > bound, F.abs("slope")).otherwise(F.greatest(-F.col("slope"), F.lit(0.0)))
    return rows.withColumn("slope", slope).groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("least"), F.max(off).alias("off"))
