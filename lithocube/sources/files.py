"""Readers and writers of the file formats: wide station files, coordinates, rasters, results, parameters, sidecars."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_wide_csv(spark: SparkSession, path: str, depth: str = "Depth", prefix: str = "Month_", suffix: str = "_insar_mlcw.csv") -> DataFrame:
    """One file for each station, a row for each depth, a column for each month -> (station, depth, label, value). NaN is null."""
    raw = spark.read.option("header", True).csv(path)
    months = [c for c in raw.columns if c.startswith(prefix)]
    # the header gives the columns, all of the same two types
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` {'double' if c in months else 'int' if c == depth else 'string'}" for c in raw.columns)).csv(path)
    named = raw.withColumn("station", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), f"(~[0-9]+)?{suffix}$", ""))
    return clean(unpivot_months(named.withColumn("depth", F.col(depth).cast("int")), ["station", "depth"], months))


def write_wide_csv(wide: DataFrame, path: str, station: str = "station", suffix: str = "_insar_mlcw.csv") -> None:
    """Wide station tables as one file for each station, named after it; where Spark splits a station's rows, the further files have ~1, ~2, ...
    after the name. Spark writes the files; a file system call each names them, and one that fails is an error. Without rows no file is written."""
    spark = wide.sparkSession
    wide.repartition(station).write.mode("overwrite").partitionBy(station).option("header", True).csv(path)
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(of(path)):
        name = folder.getPath().getName()
        if folder.isDirectory() and name.startswith(f"{station}="):
            parts = sorted(p.getPath().getName() for p in fs.listStatus(folder.getPath()) if p.getPath().getName().startswith("part-"))
            for k, part in enumerate(parts):
                to = of(f"{path}/{name.split('=', 1)[1]}{f'~{k}' if k else ''}{suffix}")
                if not fs.rename(of(folder.getPath(), part), to):
                    raise OSError(f"{part} of {name} can't be renamed to {to}")
            fs.delete(folder.getPath(), True)


def unpivot_months(wide: DataFrame, keys: list[str], months: list[str]) -> DataFrame:
    typed = wide.select(*keys, *[F.col(m).cast("double").alias(m) for m in months])
    return typed.unpivot(keys, months, "label", "value")


def clean(df: DataFrame, value: str = "value") -> DataFrame:
    """NaN to null: inside the engine missing values are null only."""
    return df.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def read_coordinates(spark: SparkSession, path: str, name: str = "Ename", x: str = "X_TWD97", y: str = "Y_TWD97") -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col(name).alias("name"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def read_raster(spark: SparkSession, path: str, cumulate: bool = True, negate: bool = True, depth: int | None = None) -> DataFrame:
    """Long raster Parquet (t, y_idx, x_idx, x, y, disp, and depth where it has layers): the slice at `depth`, if one is asked for,
    cumulated in time and negated if asked; a pixel without any value stays null."""
    from ..operators.series import safe_cumsum

    grid = clean(spark.read.parquet(path), "disp")
    keys = ["y_idx", "x_idx"] + (["depth"] if "depth" in grid.columns else [])
    if depth is not None:
        grid = grid.where(F.col("depth") == depth)
    if cumulate:
        grid = safe_cumsum(grid, keys, "t", "disp").withColumn("disp", F.col("cum")).drop("cum")
    return grid.withColumn("disp", -F.col("disp")) if negate else grid


def write_product(tables: Mapping[str, DataFrame], path: str, attributes: Mapping[str, Mapping[str, str]] | None = None, by: str = "t") -> None:
    """A gridded product: a Parquet table for each variable, floats of single precision, those that have a time split by it; a variable's
    attributes (units, long name) are metadata of its columns."""
    for name, df in tables.items():
        for column, of in (attributes or {}).items():
            if column in df.columns:
                df = df.withMetadata(column, dict(of))
        single = [F.col(f.name).cast("float").alias(f.name, metadata=f.metadata) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema]
        write_result(df.select(*single), f"{path}/{name}", by if by in df.columns else None)


def read_product(spark: SparkSession, path: str, variable: str) -> tuple[DataFrame, dict[str, dict]]:
    """(table, attributes of its columns) of a variable of a product."""
    df = spark.read.parquet(f"{path}/{variable}")
    return df, {f.name: f.metadata for f in df.schema if f.metadata}


def read_result(spark: SparkSession, path: str, tables: tuple[str, ...] = ("model", "weights")) -> dict[str, DataFrame]:
    """The tables of a stored inversion by name."""
    return {t: spark.read.parquet(f"{path}/{t}") for t in tables}


def axes_of(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The raster's axes as small tables (idx, coordinate)."""
    return grid.select("x_idx", "x").distinct(), grid.select("y_idx", "y").distinct()


def write_result(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_sidecar(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parse_params(lines: DataFrame, sep: str = ":") -> DataFrame:
    """Text lines `key: value` (value, file) -> (file, layer, key, value); layer is the number in the file's name."""
    at = F.instr("value", sep)
    parsed = lines.where(at > 0).select(
        "file",
        F.regexp_extract("file", r"layer_(\d+)", 1).cast("int").alias("layer"),
        F.trim(F.substring(F.col("value"), F.lit(1), at - 1)).alias("key"),
        F.trim(F.substring(F.col("value"), at + 1, F.length("value"))).alias("value"),
    )
    return parsed.orderBy("layer", "key")


def read_params(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return parse_params(lines)


def read_scenarios(text: str) -> tuple[dict, dict[str, int], dict[str, dict]]:
    """(grid, most points of each engine, scenarios by name) of a benchmark's YAML file; JSON where no YAML reader is installed."""
    try:
        import yaml
    except ImportError:
        import json

        found = json.loads(text)
    else:
        found = yaml.safe_load(text)
    grid, caps = found.pop("grid", {}), found.pop("engine_caps", {"gpr": 1500, "kriging": 2000})
    return grid, caps, found


def parse_key_values(lines: DataFrame) -> DataFrame:
    """Text lines `key=value` (value) -> (key, value); lines without a sign of equality don't count."""
    at = F.instr("value", "=")
    return lines.where(at > 0).select(F.trim(F.substring(F.col("value"), F.lit(1), at - 1)).alias("key"), F.trim(F.substring(F.col("value"), at + 1, F.length("value"))).alias("value"))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    return parse_key_values(spark.read.text(path))


def save_key_values(table: DataFrame, path: str) -> None:
    """(key, value) as lines `key=value`."""
    table.select(F.concat_ws("=", "key", "value").alias("value")).write.mode("overwrite").text(path)


def write_key_values(values: Mapping[str, object], spark: SparkSession) -> DataFrame:
    """One row for each key: the best parameters as a table."""
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")
