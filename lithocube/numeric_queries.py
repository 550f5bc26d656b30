"""Queries whose operators are numeric kernels; their invariants are tested, as SQL can't express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import fields
from .operators import metrics, series, system
from .plans import inversion
from .relational_queries import BASE, N, depth_weights, insar, model
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def rows(s: SparkSession, d: str) -> DataFrame:
    return inversion.station_rows(model(s, d), insar(s, d))


def layer_points(s: SparkSession, d: str) -> DataFrame:
    return depth_weights(s, d).join(tables.stations(s, d), "station").select("layer", "station", "x", "y", F.col("w").alias("v"))


@register
def q50_independent(s, d):
    return inversion.invert(rows(s, d), "independent", 0.01)


@register
def q51_joint(s, d):
    return inversion.invert(rows(s, d), "joint", 0.01, 3.0)


def _holds(s, d, solver: str, lam_t: float | None) -> DataFrame:
    d = tables.shared(s, d)
    wells, top = model(s, d).withColumnRenamed("m", "w"), insar(s, d)
    solved = inversion.cut(inversion.invert(inversion.station_rows(model(s, d), top), solver, 0.01, lam_t or 0.0).select("station", "layer", "epoch", "m"))
    out = system.optimality(solved, top, wells, 0.01, lam_t)
    return out.select("station", "n", ((F.col("least") >= 0) & (F.col("off") < 1e-6)).alias("holds"))


@register
def q108_joint_conditions(s, d):
    """Whether the joint solution of each station meets the conditions of its optimum, by the relational operators of the system."""
    return _holds(s, d, "joint", 3.0)


@register
def q109_independent_conditions(s, d):
    """The same for epochs by themselves."""
    return _holds(s, d, "independent", None)


@register
def q110_coupled_bounds(s, d):
    """Of the coupled solution, for each station: whether no layer is below 0, and no sum of layers above the surface where that has a signal."""
    d = tables.shared(s, d)
    top = insar(s, d)
    solved = inversion.invert_coupled(inversion.station_rows(model(s, d), top), system.neighbours(tables.stations(s, d), 15000.0), 0.01, 1.0)
    live = system.valid_surface(top)
    each = solved.groupBy("station", "epoch").agg(F.sum("m").alias("total"), F.min("m").alias("least"), F.count(F.lit(1)).alias("n")).join(top, ["station", "epoch"]).join(live, "station")
    inside = (F.col("least") >= 0) & (~F.col("valid") | (F.col("total") <= F.greatest("d", F.lit(0.0)) + 1e-6))
    return each.groupBy("station").agg(F.sum("n").alias("n"), F.min(inside).alias("holds"))


#: What the solutions' conditions come to: all stations and cells, and that they hold.
SQL = {name: BASE + " SELECT station, count(*)::BIGINT AS n, TRUE AS holds FROM cum GROUP BY 1" for name in ("q108_joint_conditions", "q109_independent_conditions", "q110_coupled_bounds")}


@register
def q52_qp(s, d):
    """Stations coupled along edges within 15 km, bounded by their surface."""
    return inversion.invert_coupled(rows(s, d), system.neighbours(tables.stations(s, d), 15000.0), 0.01, 1.0)


@register
def q53_bayes_iso(s, d):
    return inversion.bayes_epochs(rows(s, d), "isotropic")


@register
def q54_bayes_depth(s, d):
    return inversion.bayes_epochs(rows(s, d), "depth")


@register
def q55_post_std(s, d):
    return inversion.posterior_spread(rows(s, d), 0.01, 3.0)


@register
def q60_forward_cv(s, d):
    out = inversion.forward_validation(rows(s, d), series.fold_table(s, N), 0.01, 3.0)
    return metrics.fold_errors(out, ["fold", "layer"])


@register
def q61_loso(s, d):
    return metrics.errors(inversion.leave_one_out(layer_points(s, d)), ["layer"])


@register
def q91_loso_stations(s, d):
    """For each station left out the sums over its layers and every layer's error."""
    out = inversion.leave_one_out(layer_points(s, d))
    return metrics.column_errors(out, list(range(1, tables.LAYERS + 1)))


@register
def q92_forward_station_layers(s, d):
    return metrics.station_layer_errors(inversion.forward_validation(rows(s, d), series.fold_table(s, N), 0.01, 3.0), ["fold", "station", "layer"])


@register
def q93_solver_sweep(s, d):
    """Mean square error at the wells after inversion by both solvers, for five strengths of smoothing in time."""
    return inversion.solver_sweep(rows(s, d))


@register
def q98_layer_models(s, d):
    """The fitted model of each layer by kriging and by the rotated Gaussian process, in one schema."""
    p = layer_points(s, d)
    return inversion.fit_layers(p, "kriging").unionByName(inversion.fit_layers(p, "rotated")).drop("sx", "sy", "sv")


@register
def q62_grid_search(s, d):
    """All 143 cells of the grid, on the last fold."""
    last = series.folds(N)[-1]
    return inversion.grid_search(rows(s, d), last[1], last[3])


@register
def q70_gp(s, d):
    return inversion.interpolate(layer_points(s, d), inversion.grid_pixels(s), "gp")


@register
def q71_rotated_gp(s, d):
    return inversion.interpolate(layer_points(s, d), inversion.grid_pixels(s), "rotated")


@register
def q72_kriging(s, d):
    return inversion.interpolate(layer_points(s, d), inversion.grid_pixels(s), "kriging")


@register
def q73_grid_product(s, d):
    """Weights at pixels joined with the surface of each pixel's nearest station that has one."""
    pixels = inversion.grid_pixels(s)
    grid = inversion.pixel_surface(pixels, tables.stations(s, d), insar(s, d))
    return inversion.grid_product(inversion.interpolate(layer_points(s, d), pixels, "gp"), grid)


@register
def q77_tikhonov(s, d):
    """Per column of layers at each epoch, from the surface and every fourth station as a well: the unconstrained and the non-negative
    minimum. A group for each station; a column without a well has the surface only."""
    import pandas as pd

    from .kernels import least_squares as ls

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        station = int(pdf["station"].iloc[0])
        wide = pdf.pivot(index="epoch", columns="layer", values="w").sort_index()
        surface = pdf.groupby("epoch")["d"].first().sort_index().to_numpy()
        well = 1.0 if station % 4 == 0 else 0.0
        h = ls.layer_matrix(wide.shape[1], 0.01, 1.0, well)
        right = surface[:, None] + well * wide.to_numpy()
        free = np.array([ls.tikhonov(h, g) for g in right])
        bound = np.array([ls.bounded_minimum(h + 1e-12 * np.eye(len(h)), g)[0] for g in right])
        out = pd.DataFrame({"epoch": np.repeat(wide.index, wide.shape[1]), "layer": np.tile(wide.columns, len(wide)), "free": free.ravel(), "bounded": bound.ravel()})
        return out.assign(station=station)[["station", "epoch", "layer", "free", "bounded"]]

    return rows(s, d).groupBy("station").applyInPandas(solve, "station int, epoch int, layer int, free double, bounded double")


@register
def q78_bayes_aniso(s, d):
    return inversion.bayes_epochs(rows(s, d), "anisotropic")


@register
def q79_fold_validation(s, d):
    """Five spatial folds of each layer's stations: both engines with fixed parameters, refit without each fold."""
    import pandas as pd

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("station")
        x, y = pdf[["x", "y"]].to_numpy() / 1000, pdf["v"].to_numpy()
        folds, whole = fields.spatial_folds(x, 5), inversion.fit_engine(x, y, "gp")
        var, span = float(y.var()) or 1.0, float(np.ptp(x, axis=0).max()) or 1.0
        engines = {
            "gp": lambda a, b: fields.Field(a, b, whole.angle, whole.lengths, whole.signal, whole.noise),
            "kriging": lambda a, b: fields.Kriging(a, b, "spherical", var, span / 2, 0.1 * var),
        }
        out = []
        for name, fit in engines.items():
            got = fields.cross_validate(x, y, folds, fit)
            for station, fold, (pred, std), truth in zip(pdf["station"], folds, got, y, strict=True):
                out.append((int(pdf["layer"].iloc[0]), name, int(station), int(fold), pred, truth - pred, (truth - pred) / (std + 1e-8), abs(truth - pred)))
        return pd.DataFrame(out, columns=["layer", "engine", "station", "fold", "pred", "residual", "zscore", "abs_error"])

    return layer_points(s, d).groupBy("layer").applyInPandas(score, "layer int, engine string, station int, fold int, pred double, residual double, zscore double, abs_error double")


@register
def q80_run_summary(s, d):
    """One row for each figure of a run with preset smoothing: (stage, name, value)."""
    from .settings import RunConfig

    d = tables.shared(s, d)
    config = RunConfig.parse("[Inversion]\nsolver = joint\nlam = 0.01\nlam_t = 3.0\n")
    out = inversion.run(config, s, model(s, d), insar(s, d), tables.stations(s, d), N)
    parts = [
        out["model"].agg(F.max("kkt").alias("kkt"), F.max("m").alias("largest")),
        out["weights"].groupBy("station").agg(F.sum("w").alias("w")).agg(
            F.avg("w").alias("mean_coverage"), F.min("w").alias("least_coverage"), F.max("w").alias("largest_coverage"), *[F.percentile("w", F.lit(p / 100)).alias(f"coverage_p{p}") for p in (25, 50, 75)]
        ),
        metrics.errors(out["forward"], ["fold"]).agg(F.avg("rmse").alias("mean_fold_rmse"), F.max("rmse").alias("largest_fold_rmse")),
        metrics.errors(out["loso"], ["layer"]).agg(F.avg("rmse").alias("mean_loso_rmse"), F.max("rmse").alias("largest_loso_rmse")),
        out["product"].agg(F.avg("residual").alias("mean_residual"), F.avg("residual_std").alias("mean_residual_std")),
        out["total_std"].agg(F.avg("total_std").alias("mean_total_std"), F.max("total_std").alias("largest_total_std")),
    ]
    stages = ["inversion", "weights", "forward", "loso", "product", "total_std"]
    long = [p.unpivot([], p.columns, "name", "value").select(F.lit(k).alias("stage"), "name", F.col("value").cast("double").alias("value")) for k, p in zip(stages, parts, strict=True)]
    return functools.reduce(DataFrame.unionByName, long)
