"""A run from its files to its product: station tables, coordinates and a raster of displacement, as the settings name them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics, series
from ..session import cut
from ..settings import RunConfig
from ..sources import arrays, files
from ..stages import Stages
from .inversion import run

#: Attributes of the product's columns.
ATTRIBUTES = {"residual": {"units": "mm"}, "residual_std": {"units": "mm"}, "d": {"units": "mm"}, "w": {"units": "1"}, "std": {"units": "1"}, "total_std": {"units": "mm"}, "pred": {"units": "mm"}}


@dataclass
class Inputs:
    """What `run` takes, and the names and depths behind its numbers."""

    model: DataFrame  # (station, layer, epoch, m)
    insar: DataFrame  # (station, epoch, d)
    stations: DataFrame  # (station, name, x, y)
    depths: DataFrame  # (layer, depth)
    epochs: int


def load_stations(config: RunConfig, spark: SparkSession) -> Inputs:
    """Stations with coordinates and enough of a surface series, numbered from 0 by name; layers are the depths that have any value, numbered from 1;
    epochs are the months in order of their number. Gaps are filled, series summed up and turned to positive subsidence; a depth without a
    value at a station is 0 there."""
    data, of = config["Paths", "data_dir"], lambda key: config["Dataset", key]
    suffix = of("csv_name_pattern").removeprefix("{name}").replace(".", r"\.")
    raw = cut(files.read_wide_csv(spark, f"{data}/{of('csv_dir_name')}", of("depth_col"), of("month_col_prefix"), suffix))
    labels = cut(series.discover_epochs(raw))  # a row for each month
    n = labels.count()
    obs = raw.withColumnRenamed("station", "name").join(F.broadcast(labels), "label").select("name", "depth", "epoch", "value")
    top = F.col("depth") == of("insar_surface_depth")
    surface = obs.where(top).select("name", "epoch", F.col("value").alias("d"))
    kept = series.coverage(surface.withColumnRenamed("name", "station"), n, of("min_insar_fraction")).where("kept").select(F.col("station").alias("name"))
    places = files.read_coordinates(spark, f"{data}/{of('station_coords_file')}", of("station_name_col"), of("x_col"), of("y_col"))
    stations = cut(metrics.ranked(places.join(kept, "name", "left_semi"), "name").select(F.col("rank").cast("int").alias("station"), "name", "x", "y"))
    inside = obs.where(~top & F.col("value").isNotNull()).join(stations.select("name"), "name", "left_semi")
    # a row for each depth
    depths = cut(inside.select("depth").distinct().select(F.row_number().over(Window.orderBy("depth")).cast("int").alias("layer"), "depth"))
    layers = [r["layer"] for r in depths.select("layer").collect()]
    cells = stations.select("station", F.explode(F.array(*[F.lit(k) for k in layers]).cast("array<int>")).alias("layer"))
    values = obs.join(stations.select("name", "station"), "name").join(F.broadcast(depths), "depth").select("station", "layer", "epoch", "value")
    every = cells.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    filled = series.fill_gaps(every.join(values, ["station", "layer", "epoch"], "left"), ["station", "layer"], "value")
    model = series.cumulate(filled, ["station", "layer"], "value", "m", sign=-1).select("station", "layer", "epoch", "m")
    tops = surface.join(stations.select("name", "station"), "name").select("station", "epoch", "d")
    dense = series.fill_gaps(series.densify(tops, ["station"], n - 1), ["station"], "d")
    insar = series.cumulate(dense, ["station"], "d", "cum", sign=-1).select("station", "epoch", F.col("cum").alias("d"))
    return Inputs(cut(model), cut(insar), stations, depths, n)


def load_grid(config: RunConfig, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(pixels (pixel, x, y), surface (pixel, epoch, d)) of the raster's pixels that have any value: NetCDF, or Parquet in long form. Its times
    are months in order, from the first month on."""
    path, of = config["Paths", "grid_nc"], lambda key: config["Dataset", key]
    if not path.endswith(".parquet"):
        t, y, x, var = of("time_dim"), of("y_dim"), of("x_dim"), of("displacement_var")
        raw = arrays.read_netcdf(spark, path, var)
        if of("nc_depth_dim") in raw.columns:
            raw = raw.where(F.col(f"`{of('nc_depth_dim')}`") == of("insar_surface_depth"))
        grid = raw.select(F.col(f"{t}_idx").cast("int").alias("t"), F.col(f"{y}_idx").cast("int").alias("y_idx"), F.col(f"{x}_idx").cast("int").alias("x_idx"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(var).cast("double").alias("disp"))
    else:
        grid = spark.read.parquet(path)
        grid = grid.where(F.col("depth") == of("insar_surface_depth")) if "depth" in grid.columns else grid
    summed = series.safe_cumsum(files.clean(grid, "disp"), ["y_idx", "x_idx"], "t", "disp").where("cum is not null")
    wide = (grid.agg(F.max("x_idx")).first()[0] or 0) + 1
    placed = cut(summed.select((F.col("y_idx") * wide + F.col("x_idx")).cast("int").alias("pixel"), "x", "y", F.col("t").cast("int").alias("epoch"), (-F.col("cum")).alias("d")))
    return placed.select("pixel", "x", "y").distinct(), placed.select("pixel", "epoch", "d")


def run_files(config: RunConfig, spark: SparkSession, store: Stages | None = None) -> dict[str, DataFrame]:
    """`run` on the files that the settings name. With an output folder its stages are kept there, so that a second call makes only what has changed,
    and the product's tables are written to `product` below it, with their attributes. Without a raster the pixels are the bound raster's and
    have the surface of their nearest station."""
    if not config["Paths", "data_dir"]:
        raise ValueError("data_dir in [Paths] is asked for")
    inputs, to = load_stations(config, spark), config["Paths", "output_dir"]
    store = store or (Stages(spark, f"{to}/stages") if to else None)
    pixels, surface = load_grid(config, spark) if config["Paths", "grid_nc"] else (None, None)
    out = run(config, spark, inputs.model, inputs.insar, inputs.stations.drop("name"), inputs.epochs, pixels, store, surface)
    out["stations"], out["depths"] = inputs.stations, inputs.depths
    if to:
        files.write_product({k: out[k] for k in ("grid", "product", "total_std", "stations", "depths") if k in out}, f"{to}/product", ATTRIBUTES, "epoch")
    return out
