"""Relational queries of the engine and their DuckDB SQL, on the cube that `sources.tables` binds to the star schema."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.directions import compass, rotated, turned
from .functions.variograms import variogram
from .operators import metrics, series, spatial, system, weights
from .session import shared_dir
from .sources import arrays, files, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
N = tables.EPOCHS

BASE = """
WITH cube AS (
  SELECT (l_suppkey % 31)::INT AS station, l_linenumber::INT AS layer,
         ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::INT AS epoch, -sum(l_quantity) / 100 AS value
  FROM lineitem GROUP BY 1, 2, 3),
obs AS (SELECT * FROM cube WHERE (station * 7 + layer * 3 + epoch) % 11 <> 0),
surf AS (SELECT station, epoch, sum(value) * 1.15::DOUBLE AS d FROM cube WHERE NOT (station % 8 = 5 AND epoch % 3 <> 0) GROUP BY 1, 2),
sta AS (SELECT i::INT AS station, (160000.0 + (i * 37 % 31) * 1700)::DOUBLE AS x, (2600000.0 + (i * 53 % 29) * 2100)::DOUBLE AS y FROM (SELECT DISTINCT s_suppkey % 31 AS i FROM supplier)),
ep AS (SELECT i::INT AS epoch FROM range(83) t(i)),
gap AS (
  SELECT k.station, k.layer, ep.epoch, o.value AS v,
         last_value(CASE WHEN o.value IS NOT NULL THEN ep.epoch END IGNORE NULLS) OVER b AS pe, last_value(o.value IGNORE NULLS) OVER b AS pv,
         first_value(CASE WHEN o.value IS NOT NULL THEN ep.epoch END IGNORE NULLS) OVER a AS ne, first_value(o.value IGNORE NULLS) OVER a AS nv
  FROM (SELECT DISTINCT station, layer FROM obs) k CROSS JOIN ep LEFT JOIN obs o ON o.station = k.station AND o.layer = k.layer AND o.epoch = ep.epoch
  WINDOW b AS (PARTITION BY k.station, k.layer ORDER BY ep.epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY k.station, k.layer ORDER BY ep.epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT station, layer, epoch, coalesce(v, pv + (nv - pv) * (epoch - pe) / (ne - pe), nv, pv, 0) AS value FROM gap),
cum AS (SELECT station, layer, epoch, -sum(value) OVER (PARTITION BY station, layer ORDER BY epoch) AS m FROM filled),
sgap AS (
  SELECT k.station, ep.epoch, o.d AS v,
         last_value(CASE WHEN o.d IS NOT NULL THEN ep.epoch END IGNORE NULLS) OVER b AS pe, last_value(o.d IGNORE NULLS) OVER b AS pv,
         first_value(CASE WHEN o.d IS NOT NULL THEN ep.epoch END IGNORE NULLS) OVER a AS ne, first_value(o.d IGNORE NULLS) OVER a AS nv
  FROM (SELECT DISTINCT station FROM surf) k CROSS JOIN ep LEFT JOIN surf o ON o.station = k.station AND o.epoch = ep.epoch
  WINDOW b AS (PARTITION BY k.station ORDER BY ep.epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY k.station ORDER BY ep.epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
scum AS (SELECT station, epoch, -sum(coalesce(v, pv + (nv - pv) * (epoch - pe) / (ne - pe), nv, pv, 0)) OVER (PARTITION BY station ORDER BY epoch) AS d FROM sgap),
lastm AS (SELECT c.station, c.layer, c.m AS total, s.d AS surface FROM cum c JOIN scum s ON c.station = s.station AND c.epoch = 82 AND s.epoch = 82),
raw AS (SELECT station, layer, total / CASE WHEN surface > 0 THEN surface ELSE 1 END AS w FROM lastm),
wt AS (SELECT station, layer, CASE WHEN sum(w) OVER p > 0.99::DOUBLE THEN w * (0.99::DOUBLE / sum(w) OVER p) ELSE w END AS w FROM raw WINDOW p AS (PARTITION BY station)),
fold AS (SELECT * FROM (VALUES (1, 52, 53, 62), (2, 62, 63, 72), (3, 72, 73, 82)) t(fold, train_end, val_start, val_end)),
ftot AS (SELECT fold, c.station, c.layer, c.m / CASE WHEN s.d > 0 THEN s.d ELSE 1 END AS w FROM fold JOIN cum c ON c.epoch = train_end JOIN scum s ON s.station = c.station AND s.epoch = train_end),
fw AS (SELECT fold, station, layer, CASE WHEN sum(w) OVER p > 0.99::DOUBLE THEN w * (0.99::DOUBLE / sum(w) OVER p) ELSE w END AS w FROM ftot WINDOW p AS (PARTITION BY fold, station)),
fpred AS (SELECT fold, fw.station, fw.layer, s.epoch, w * d AS pred, m AS truth FROM fw JOIN fold USING (fold) JOIN scum s ON s.station = fw.station AND s.epoch BETWEEN val_start AND val_end JOIN cum c ON c.station = fw.station AND c.layer = fw.layer AND c.epoch = s.epoch),
loo AS (SELECT station, layer, (sum(w) OVER p - w) / (count(w) OVER p - 1) AS pred, w AS truth FROM wt WINDOW p AS (PARTITION BY layer)),
pred AS (SELECT s.station, w.layer, s.epoch, w.w * s.d AS pred, c.m AS truth FROM scum s JOIN wt w USING (station) JOIN cum c ON c.station = s.station AND c.layer = w.layer AND c.epoch = s.epoch)
"""


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = BASE + sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def filled(s: SparkSession, d: str) -> DataFrame:
    dense = series.densify(tables.observations(s, d), ["station", "layer"], N - 1)
    return series.fill_gaps(dense, ["station", "layer"], "value")


def model(s: SparkSession, d: tables.Source) -> DataFrame:
    """Cumulative positive series of each layer: (station, layer, epoch, m)."""
    if isinstance(d, tables.Shared):
        return d.once("model", lambda: _model(s, d))
    return _model(s, d)


def _model(s: SparkSession, d: tables.Source) -> DataFrame:
    return series.cumulate(filled(s, d), ["station", "layer"], "value", "m", sign=-1).select("station", "layer", "epoch", "m")


def insar(s: SparkSession, d: tables.Source) -> DataFrame:
    """Cumulative positive surface series: (station, epoch, d)."""
    if isinstance(d, tables.Shared):
        return d.once("insar", lambda: _insar(s, d))
    return _insar(s, d)


def _insar(s: SparkSession, d: tables.Source) -> DataFrame:
    dense = series.fill_gaps(series.densify(tables.surface(s, d), ["station"], N - 1), ["station"], "d")
    return series.cumulate(dense, ["station"], "d", "cum", sign=-1).select("station", "epoch", F.col("cum").alias("d"))


def depth_weights(s: SparkSession, d: str) -> DataFrame:
    return weights.depth_weights(weights.totals(model(s, d), insar(s, d)))


def predicted(s: SparkSession, d: str) -> DataFrame:
    """Stand-in predictor of the metric queries: last-epoch weights times the surface, against the model."""
    return weights.predict(depth_weights(s, d), insar(s, d)).join(model(s, d), ["station", "layer", "epoch"]).select("station", "layer", "epoch", "pred", F.col("m").alias("truth"))


def fold_predicted(s: SparkSession, d: str) -> DataFrame:
    """What each fold's past says of its window."""
    return weights.fold_predictions(model(s, d), insar(s, d), series.fold_table(s, N))


def left_out(s: SparkSession, d: str) -> DataFrame:
    """Each station's weights as the others give them."""
    return weights.mean_of_others(depth_weights(s, d))


def points(s: SparkSession, d: str) -> DataFrame:
    """Stations with the weight of each layer: (layer, station, x, y, v)."""
    return tables.stations(s, d).join(depth_weights(s, d).select("layer", "station", F.col("w").alias("v")), "station")


@register("SELECT station, layer, epoch, round(value, 6) + 0.0 AS value FROM cube")
def q01_cube(s, d):
    return tables.cube(s, d).select("station", "layer", "epoch", r6("value").alias("value"))


@register("SELECT station, layer, 'Month_' || lpad((epoch + 1)::VARCHAR, 3, '0') AS label, round(value, 6) + 0.0 AS value FROM obs")
def q02_unpivot(s, d):
    months = [f"Month_{k + 1:03d}" for k in range(N)]
    named = tables.observations(s, d).withColumn("label", F.format_string("Month_%03d", F.col("epoch") + 1))
    wide = named.groupBy("station", "layer").pivot("label", months).agg(F.first("value"))
    return files.clean(files.unpivot_months(wide, ["station", "layer"], months)).where("value is not null").select("station", "layer", "label", r6("value").alias("value"))


@register("SELECT DISTINCT 'M_' || (epoch + 1) AS label, (dense_rank() OVER (ORDER BY epoch) - 1)::INT AS epoch FROM (SELECT DISTINCT epoch FROM cube)")
def q03_month_discovery(s, d):
    return series.discover_epochs(tables.cube(s, d).select(F.concat(F.lit("M_"), F.col("epoch") + 1).alias("label")))


@register("SELECT station, layer, (epoch - 12)::INT AS epoch, round(value, 6) + 0.0 AS value FROM obs WHERE epoch BETWEEN 12 AND 59")
def q04_epoch_slice(s, d):
    return series.slice_epochs(tables.observations(s, d), 12, 59).select("station", "layer", "epoch", r6("value").alias("value"))


@register("SELECT station, count(d)::BIGINT AS n_valid, count(d) >= 0.5 * 83 AS kept FROM surf GROUP BY 1")
def q05_coverage_filter(s, d):
    return series.coverage(tables.surface(s, d), N)


@register("SELECT DISTINCT layer * 10 AS depth FROM obs WHERE station IN (SELECT station FROM surf GROUP BY 1 HAVING count(d) >= 0.5 * 83)")
def q06_valid_depths(s, d):
    kept = series.coverage(tables.surface(s, d), N).where("kept")
    return series.valid_depths(tables.observations(s, d), kept).select((F.col("layer") * 10).alias("depth"))


@register("SELECT station, count(*)::BIGINT AS n FROM obs WHERE station NOT IN (SELECT station FROM surf GROUP BY 1 HAVING count(d) < 0.5 * 83) GROUP BY 1")
def q07_excluded_anti(s, d):
    out = series.coverage(tables.surface(s, d), N).where("not kept")
    return tables.observations(s, d).join(out, "station", "left_anti").groupBy("station").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT station, xi::INT AS col, yi::INT AS row, (yi * 106 + xi)::INT AS pixel FROM (
  SELECT station, (SELECT arg_min(k, (abs(x - (160000 + 500 * k)), k)) FROM range(106) t(k)) AS xi, (SELECT arg_min(k, (abs(y - (2600000 + 500 * k)), k)) FROM range(121) t(k)) AS yi FROM sta)""")
def q08_nearest_pixel(s, d):
    near = spatial.nearest_on_axis(tables.stations(s, d), tables.axis(s, "x"), "x", "col")
    both = spatial.nearest_on_axis(near, tables.axis(s, "y"), "y", "row")
    return both.select("station", "col", "row", (F.col("row") * 106 + F.col("col")).cast("int").alias("pixel"))


@register("SELECT station, layer, epoch, round(value, 6) + 0.0 AS value FROM filled")
def q09_gapfill(s, d):
    return filled(s, d).select("station", "layer", "epoch", r6("value").alias("value"))


@register("SELECT station, layer, epoch, round(m, 6) + 0.0 AS m FROM cum")
def q10_cumulate(s, d):
    return model(s, d).select("station", "layer", "epoch", r6("m").alias("m"))


@register("""SELECT station, layer, epoch, round(CASE WHEN count(v) OVER (PARTITION BY station, layer) > 0 THEN sum(coalesce(v, 0)) OVER (PARTITION BY station, layer ORDER BY epoch) END, 6) + 0.0 AS cum FROM (
  SELECT station, layer, epoch, CASE WHEN station % 5 <> 0 THEN v END AS v FROM gap)""")
def q11_nan_safe_cumsum(s, d):
    dense = series.densify(tables.observations(s, d), ["station", "layer"], N - 1).withColumn("value", F.when(F.col("station") % 5 != 0, F.col("value")))
    return series.safe_cumsum(dense, ["station", "layer"], "epoch", "value").select("station", "layer", "epoch", r6("cum").alias("cum"))


@register("SELECT fold, station, layer, epoch, round(sum(value) OVER (PARTITION BY fold, station, layer ORDER BY epoch), 6) + 0.0 AS cum FROM filled JOIN fold ON epoch BETWEEN val_start AND val_end")
def q12_reorigin(s, d):
    inside = series.in_validation(filled(s, d), series.fold_table(s, N))
    return series.cumulate(inside, ["fold", "station", "layer"], "value").select("fold", "station", "layer", "epoch", r6("cum").alias("cum"))


@register("SELECT station, layer, epoch, round(max(value) OVER (PARTITION BY station, layer ORDER BY epoch), 6) + 0.0 AS top FROM filled")
def q13_running_max(s, d):
    return series.running_max(filled(s, d), ["station", "layer"], "value").select("station", "layer", "epoch", r6("top").alias("top"))


@register("SELECT station, layer, epoch, round(m - coalesce(lag(m) OVER (PARTITION BY station, layer ORDER BY epoch), 0), 6) + 0.0 AS step FROM cum")
def q14_diff(s, d):
    return series.difference(model(s, d), ["station", "layer"], "m").select("station", "layer", "epoch", r6("step").alias("step"))


@register("SELECT * FROM fold")
def q15_folds(s, d):
    return series.fold_table(s, tables.cube(s, d).agg(F.max("epoch")).first()[0] + 1)


FOLD_RMSE = "frmse AS (SELECT fold, layer, sqrt(avg((pred - truth) * (pred - truth))) AS rmse FROM fpred GROUP BY 1, 2)"


def fold_rmse(s, d):
    return metrics.fold_errors(fold_predicted(s, d), ["fold", "layer"]).select("fold", "layer", "rmse")


@register(f", {FOLD_RMSE} SELECT epoch, layer, round(rmse, 6) + 0.0 AS sigma_t FROM frmse JOIN ep ON fold = CASE WHEN epoch < 63 THEN 1 WHEN epoch < 73 THEN 2 ELSE 3 END")
def q16_fold_rmse_expand(s, d):
    return series.spread_folds(fold_rmse(s, d), series.fold_table(s, N), N).select("epoch", "layer", r6("rmse").alias("sigma_t"))


@register("SELECT station, epoch, round(5 * sum(m), 6) + 0.0 AS d FROM cum GROUP BY 1, 2")
def q17_G(s, d):
    return system.forward(model(s, d), 5.0).select("station", "epoch", r6("d").alias("d"))


@register("SELECT station, layer, epoch, round(m, 6) + 0.0 AS m FROM cum WHERE station % 4 = 0")
def q18_I_wells(s, d):
    return system.at_wells(model(s, d), tables.stations(s, d).where("station % 4 = 0")).select("station", "layer", "epoch", r6("m").alias("m"))


@register("SELECT station, layer, epoch, round(coalesce(m - lead(m) OVER (PARTITION BY station, epoch ORDER BY layer), 0), 6) + 0.0 AS lm FROM cum")
def q19_L(s, d):
    return system.vertical(model(s, d)).select("station", "layer", "epoch", r6("lm").alias("lm"))


EDGES = "edge AS (SELECT a, b, dist, 1 / dist / max(1 / dist) OVER () AS weight FROM (SELECT p.station AS a, q.station AS b, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS dist FROM sta p JOIN sta q ON p.station < q.station) WHERE dist > 0 AND dist <= 15000)"


@register(f", {EDGES} SELECT a, b, round(dist, 6) + 0.0 AS dist, round(weight, 6) + 0.0 AS weight FROM edge")
def q20_L_spatial_edges(s, d):
    return system.neighbours(tables.stations(s, d), 15000.0).select("a", "b", r6("dist").alias("dist"), r6("weight").alias("weight"))


@register("SELECT station, layer, epoch, round(ltm, 6) + 0.0 AS ltm FROM (SELECT *, lead(m) OVER (PARTITION BY station, layer ORDER BY epoch) - m AS ltm FROM cum) WHERE ltm IS NOT NULL")
def q21_L_t(s, d):
    return system.temporal(model(s, d)).select("station", "layer", "epoch", r6("ltm").alias("ltm"))


@register("""SELECT round(a, 4) AS insar_part, round(b, 4) AS well_part, round(c, 4) AS vertical_part, round(e, 4) AS temporal_part, round(a + b + c + e, 4) AS total FROM
 (SELECT sum((g - d) * (g - d)) AS a FROM (SELECT station, epoch, sum(m) AS g FROM cum GROUP BY 1, 2) JOIN scum USING (station, epoch)),
 (SELECT coalesce(sum((c.m - -o.value) * (c.m - -o.value)), 0) AS b FROM cum c JOIN obs o USING (station, layer, epoch)),
 (SELECT 0.01::DOUBLE * sum(x * x) AS c FROM (SELECT coalesce(m - lead(m) OVER (PARTITION BY station, epoch ORDER BY layer), 0) AS x FROM cum)),
 (SELECT 3.0::DOUBLE * sum(x * x) AS e FROM (SELECT lead(m) OVER (PARTITION BY station, layer ORDER BY epoch) - m AS x FROM cum))""")
def q22_objective(s, d):
    d = tables.shared(s, d)
    wells = tables.observations(s, d).select("station", "layer", "epoch", (-F.col("value")).alias("w"))
    out = system.objective(model(s, d), insar(s, d), wells, 0.01, 3.0)
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@register("SELECT station, layer, round(w, 6) + 0.0 AS w FROM wt")
def q23_depth_weights_cap(s, d):
    return depth_weights(s, d).select("station", "layer", r6("w").alias("w"))


@register("SELECT station, round(sum(w), 6) + 0.0 AS coverage, sum(w) < 0.85 AS flagged FROM wt GROUP BY 1")
def q24_coverage(s, d):
    out = weights.station_coverage(depth_weights(s, d))
    return out.select("station", r6("coverage").alias("coverage"), (F.col("coverage") < 0.85).alias("flagged"))


@register("""SELECT station, layer, round(t / CASE WHEN f > 0 THEN f ELSE 1 END, 6) + 0.0 AS w FROM (SELECT station, layer, sum(m) AS t FROM cum GROUP BY 1, 2) JOIN (SELECT station, sum(d) AS f FROM scum GROUP BY 1) USING (station)""")
def q25_weights_epoch_sum(s, d):
    out = weights.depth_weights(weights.totals(model(s, d), insar(s, d), "epoch_sum"), None)
    return out.select("station", "layer", r6("w").alias("w"))


NORM = "nw AS (SELECT station, layer, CASE WHEN sum(c) OVER p > 1 THEN c / sum(c) OVER p ELSE c END AS w FROM (SELECT station, layer, greatest(1.3::DOUBLE * w - 0.02::DOUBLE * layer, 0) AS c FROM wt) WINDOW p AS (PARTITION BY station))"


@register(f", {NORM} SELECT station, layer, round(w, 6) + 0.0 AS w FROM nw")
def q26_normalise(s, d):
    off = depth_weights(s, d).withColumn("w", 1.3 * F.col("w") - 0.02 * F.col("layer"))
    return weights.normalise(off).select("station", "layer", r6("w").alias("w"))


@register("SELECT station, layer, epoch, round(pred, 6) + 0.0 AS pred FROM pred")
def q27_predict(s, d):
    return predicted(s, d).select("station", "layer", "epoch", r6("pred").alias("pred"))


def with_std(s, d):
    return depth_weights(s, d).withColumn("std", 0.01 * F.col("layer") + 0.001 * F.col("station"))


STD = "ws AS (SELECT station, layer, w, 0.01::DOUBLE * layer + 0.001::DOUBLE * station AS std FROM wt)"


@register(f", {STD} SELECT station, layer, epoch, round(w * d, 6) + 0.0 AS pred, round(std * abs(d), 9) + 0.0 AS pred_std FROM ws JOIN scum USING (station)")
def q28_layer_compaction(s, d):
    return weights.predict(with_std(s, d), insar(s, d)).select("station", "layer", "epoch", r6("pred").alias("pred"), F.round("pred_std", 9).alias("pred_std"))


@register("SELECT station, epoch, round(d, 6) + 0.0 AS d, round(d * (1 - t), 6) + 0.0 AS residual FROM scum JOIN (SELECT station, sum(w) AS t FROM wt GROUP BY 1) USING (station)")
def q29_deep_residual(s, d):
    d = tables.shared(s, d)
    return weights.deep_residual(depth_weights(s, d), insar(s, d)).select("station", "epoch", r6("d").alias("d"), r6("residual").alias("residual"))


@register(f""", {STD}, {FOLD_RMSE}, lr AS (SELECT layer, sqrt(avg((pred - truth) * (pred - truth))) AS rmse FROM loo WHERE layer <> 7 GROUP BY 1)
 SELECT station, ws.layer, epoch, round(sqrt((std * abs(d)) * (std * abs(d)) + (coalesce(lr.rmse, 0) * d) * (coalesce(lr.rmse, 0) * d) + f.rmse * f.rmse), 4) AS total_std FROM ws JOIN scum USING (station) LEFT JOIN lr ON lr.layer = ws.layer JOIN frmse f ON f.layer = ws.layer AND f.fold = CASE WHEN epoch < 63 THEN 1 WHEN epoch < 73 THEN 2 ELSE 3 END""")
def q30_total_std(s, d):
    """The deepest layer has no figure of the validation in space: it counts as 0."""
    d = tables.shared(s, d)
    sigma = series.spread_folds(fold_rmse(s, d), series.fold_table(s, N), N).select("epoch", "layer", F.col("rmse").alias("sigma_t"))
    layer = metrics.errors(left_out(s, d), ["layer"]).where("layer <> 7").select("layer", "rmse")
    out = weights.total_std(weights.predict(with_std(s, d), insar(s, d)), layer, sigma)
    return out.select("station", "layer", "epoch", F.round("total_std", 4).alias("total_std"))


@register(f", {STD} SELECT station, max(std) > 0.085 AS low_confidence FROM ws GROUP BY 1")
def q31_low_conf(s, d):
    return weights.low_confidence(with_std(s, d), "station", 0.085)


@register("SELECT layer, round(sqrt(avg((pred - truth) * (pred - truth))), 6) AS rmse, round(avg(abs(pred - truth)), 6) AS mae, round(avg(pred - truth), 6) + 0.0 AS bias, round(stddev_pop(pred - truth), 6) AS std_error FROM loo GROUP BY 1")
def q32_loso_metrics(s, d):
    out = metrics.errors(left_out(s, d), ["layer"])
    return out.select("layer", *[r6(c).alias(c) for c in ("rmse", "mae", "bias", "std_error")])


@register("""SELECT fold, layer, round(sqrt(avg((pred - truth) * (pred - truth))), 6) AS rmse, round(avg(abs(pred - truth)), 6) AS mae, round(avg(pred - truth), 6) + 0.0 AS bias, round(corr(pred, truth), 6) AS correlation, count(*)::BIGINT AS n_valid FROM fpred GROUP BY 1, 2""")
def q33_fold_metrics(s, d):
    out = metrics.fold_errors(fold_predicted(s, d), ["fold", "layer"])
    return out.select("fold", "layer", *[r6(c).alias(c) for c in ("rmse", "mae", "bias", "correlation")], "n_valid")


@register("""SELECT station, CASE WHEN max(abs(truth)) > 1e-9 THEN round(sqrt(avg((pred - truth) * (pred - truth))), 6) END AS rmse, CASE WHEN max(abs(truth)) > 1e-9 THEN round(avg(abs(pred - truth)), 6) END AS mae,
 max(abs(truth)) > 1e-9 AS has_obs FROM (SELECT station, pred, CASE WHEN station = 3 THEN 0 ELSE truth END AS truth FROM pred) GROUP BY 1""")
def q34_station_metrics(s, d):
    """Station 3 is taken to have no observations."""
    seen = predicted(s, d).withColumn("truth", F.when(F.col("station") != 3, F.col("truth")).otherwise(F.lit(0.0)))
    return metrics.station_errors(seen).select("station", r6("rmse").alias("rmse"), r6("mae").alias("mae"), "has_obs")


TRIALS = "trials AS (SELECT layer AS lam, (epoch % 4)::INT AS lam_t, avg(abs(value)) AS mean_rmse, max(abs(value)) AS max_rmse FROM cube GROUP BY 1, 2)"


def trials(s, d):
    return tables.cube(s, d).groupBy(F.col("layer").alias("lam"), (F.col("epoch") % 4).cast("int").alias("lam_t")).agg(F.avg(F.abs("value")).alias("mean_rmse"), F.max(F.abs("value")).alias("max_rmse"))


@register(f", {TRIALS} SELECT lam, " + ", ".join(f"round(max(mean_rmse) FILTER (lam_t = {k}), 6) + 0.0 AS lam_t_{k}" for k in range(4)) + " FROM trials GROUP BY 1")
def q35_pivot_grid(s, d):
    wide = trials(s, d).groupBy("lam").pivot("lam_t", [0, 1, 2, 3]).agg(F.first("mean_rmse"))
    return wide.select("lam", *[r6(F.col(str(k))).alias(f"lam_t_{k}") for k in range(4)])


@register(f", {TRIALS} SELECT lam, lam_t, round(mean_rmse, 6) + 0.0 AS mean_rmse FROM trials ORDER BY mean_rmse, lam, lam_t LIMIT 1")
def q36_argmin(s, d):
    return metrics.best(trials(s, d).withColumn("mean_rmse", F.col("mean_rmse"))).select("lam", "lam_t", r6("mean_rmse").alias("mean_rmse"))


@register("SELECT station, round(sum(total), 6) + 0.0 AS total FROM lastm GROUP BY 1 ORDER BY sum(total) DESC, station LIMIT 5")
def q37_topk_station(s, d):
    t = weights.totals(model(s, d), insar(s, d)).groupBy("station").agg(F.sum("total").alias("total"))
    return t.orderBy(F.desc("total"), "station").limit(5).select("station", r6("total").alias("total"))


@register("SELECT round(quantile_cont(c, 0.25), 6) AS p25, round(quantile_cont(c, 0.5), 6) AS p50, round(quantile_cont(c, 0.75), 6) AS p75 FROM (SELECT sum(w) AS c FROM raw GROUP BY station)")
def q38_coverage_percentiles(s, d):
    c = weights.station_coverage(weights.depth_weights(weights.totals(model(s, d), insar(s, d)), None))
    found = metrics.exact_quantiles(c, "coverage", [0.25, 0.5, 0.75])
    return found.agg(*[r6(F.max(F.when(F.col("q") == p / 100, F.col("quantile")))).alias(f"p{p}") for p in (25, 50, 75)])


@register("""SELECT station, lo, hi, round(coalesce(sum(value) FILTER (depth BETWEEN lo AND hi), 0), 6) + 0.0 AS total FROM (SELECT station, layer * 10.0::DOUBLE AS depth, value FROM filled) CROSS JOIN (VALUES (0.0::DOUBLE, 20.0::DOUBLE), (20.0, 50.0), (50.0, 70.0), (300.0, 400.0)) t(lo, hi) GROUP BY 1, 2, 3""")
def q39_depth_intervals(s, d):
    out = metrics.interval_sums(filled(s, d).withColumn("depth", F.col("layer") * 10.0), [(0, 20), (20, 50), (50, 70), (300, 400)])
    return out.select("station", "lo", "hi", r6("total").alias("total"))


@register("SELECT station, layer, epoch, round(value, 6) + 0.0 AS value FROM obs QUALIFY row_number() OVER (PARTITION BY station, layer ORDER BY epoch DESC) = 1")
def q40_upsert(s, d):
    return metrics.latest(tables.observations(s, d), ["station", "layer"], "epoch").select("station", "layer", "epoch", r6("value").alias("value"))


@register("SELECT station, round(x * cos(radians(30)) + y * sin(radians(30)), 4) AS u, round(y * cos(radians(30)) - x * sin(radians(30)), 4) AS v FROM (SELECT station, x / 1000 AS x, y / 1000 AS y FROM sta)")
def q41_rotate(s, d):
    u, v = rotated(F.col("x") / 1000, F.col("y") / 1000, 30.0)
    return tables.stations(s, d).select("station", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


PAIRS = "pr AS (SELECT a.layer, p.x - q.x AS dx, p.y - q.y AS dy, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS dist, a.w - b.w AS dv FROM sta p JOIN sta q ON p.station < q.station JOIN wt a ON a.station = p.station JOIN wt b ON b.station = q.station AND b.layer = a.layer)"


@register(f", {PAIRS} SELECT layer, (ceil(dist / 4000) - 1)::INT AS bin, round((ceil(dist / 4000) - 0.5) * 4000, 6) AS lag, round(avg(dv * dv) / 2, 6) + 0.0 AS semivariance, count(*)::BIGINT AS n_pairs FROM pr WHERE dist > 0 AND dist <= 40000 GROUP BY 1, 2, 3")
def q42_variogram_omni(s, d):
    out = spatial.empirical_variogram(spatial.pairs(points(s, d), 40000.0, by=["layer"]), 4000.0, 10, ["layer"])
    return out.select("layer", "bin", r6("lag").alias("lag"), r6("semivariance").alias("semivariance"), "n_pairs")


@register(f""", {PAIRS}, ang AS (SELECT *, ((degrees(atan2(dy, dx)) % 180) + 180) % 180 AS axis FROM pr WHERE dist > 0 AND dist <= 40000)
 SELECT layer, direction, (ceil(dist / 8000) - 1)::INT AS bin, round(avg(dv * dv) / 2, 6) + 0.0 AS semivariance, count(*)::BIGINT AS n_pairs FROM ang JOIN (VALUES (0.0::DOUBLE), (45.0), (90.0), (135.0)) t(direction) ON least(abs(axis - direction), 180 - abs(axis - direction)) <= 22.5 GROUP BY 1, 2, 3""")
def q43_variogram_dir(s, d):
    near = spatial.in_direction(spatial.pairs(points(s, d), 40000.0, by=["layer"]), [0.0, 45.0, 90.0, 135.0])
    return spatial.empirical_variogram(near, 8000.0, 5, ["layer", "direction"]).select("layer", "direction", "bin", r6("semivariance").alias("semivariance"), "n_pairs")


@register(f", {EDGES}" + """ SELECT a, b, round(h, 6) AS h, round(0.2 + 0.8 * (1 - exp(-pow(h / 10, 1.5))), 6) AS stable,
 round(CASE WHEN h <= 10 THEN 0.2 + 0.8 * (1 - 2 / pi() * (acos(h / 10) - h / 10 * sqrt(1 - h / 10 * h / 10))) ELSE 1.0 END, 6) AS circular,
 round(0.2 + 0.8 * (1 - pow(1 + h * h / (2 * 1.5 * 100), -1.5)), 6) AS rational, round(CASE WHEN h <= 10 THEN 0.2 + 0.8 * (1.5 * h / 10 - 0.5 * pow(h / 10, 3)) ELSE 1.0 END, 6) AS spherical,
 round(0.2 + 0.8 * (1 - exp(-3 * h / 10)), 6) AS exponential, round(0.2 + 0.8 * (1 - exp(-pow(h / (10 * 4.0 / 7), 2))), 6) AS gaussian, round(0.2 + 0.8 * (1 - (1 - 3 * h / 10) * exp(-3 * h / 10)), 6) AS hole,
 round(0.2 + 0.8 * (1 - exp(-3 * pow(h / 10, 2))), 6) AS practical, round(0.2 + 0.8 * pow(h / 10, 1.5), 6) AS power, round(0.2 + 0.8 * least(h / 10, 1.0), 6) AS linear FROM (SELECT a, b, dist / 1000 AS h FROM edge)""")
def q44_variogram_models(s, d):
    """Every model at the distances in km of neighbouring stations."""
    h = F.col("h")
    named = {"stable": "stable", "circular": "circular", "rational": "rational-quadratic", "spherical": "spherical", "exponential": "exponential", "gaussian": "gaussian", "hole": "hole-effect", "practical": "practical-gaussian", "power": "power", "linear": "linear"}
    steps = system.neighbours(tables.stations(s, d), 15000.0).select("a", "b", (F.col("dist") / 1000).alias("h"))
    return steps.select("a", "b", r6("h").alias("h"), *[F.round(variogram(m, h, 0.8, 10.0, 0.2, 1.5), 6).alias(c) for c, m in named.items()])


@register("SELECT a, b, round(angle, 6) + 0.0 AS angle, round(az, 6) + 0.0 AS azimuth, CASE WHEN az < 22.5 OR az >= 337.5 THEN 'N' WHEN az < 67.5 THEN 'NE' WHEN az < 112.5 THEN 'E' WHEN az < 157.5 THEN 'SE' WHEN az < 202.5 THEN 'S' WHEN az < 247.5 THEN 'SW' WHEN az < 292.5 THEN 'W' ELSE 'NW' END AS direction FROM (SELECT a, b, angle, ((90 - angle) % 360 + 360) % 360 AS az FROM (SELECT p.station AS a, q.station AS b, degrees(atan2(p.y - q.y, p.x - q.x)) AS angle FROM sta p JOIN sta q ON p.station < q.station WHERE sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 15000))")
def q45_azimuth(s, d):
    """Where each station's neighbours lie."""
    near = spatial.pairs(tables.stations(s, d).withColumn("v", F.lit(0.0)), 15000.0)
    out = near.select("a", "b", F.degrees(F.atan2("dy", "dx")).alias("angle")).withColumn("azimuth", turned(F.col("angle")))
    return out.withColumn("direction", compass(F.col("azimuth"))).select("a", "b", r6("angle").alias("angle"), r6("azimuth").alias("azimuth"), "direction")


@register("SELECT layer, round(sqrt(avg(pow((truth - pred) / (1 + abs(pred) + 1e-8::DOUBLE), 2))), 6) AS rmss FROM pred GROUP BY 1")
def q46_rmss(s, d):
    return predicted(s, d).groupBy("layer").agg(r6(metrics.rmss(F.col("pred"), F.col("truth"), 1 + F.abs("pred"))).alias("rmss"))


@register(""", pt AS (SELECT layer, s.x / 1000 AS x, s.y / 1000 AS y, w AS v FROM sta s JOIN wt ON wt.station = s.station), ne AS (SELECT layer, least(10, count(*) // 3) AS e FROM pt GROUP BY 1),
 tu AS (SELECT layer, angle, v, x * cos(radians(-angle)) + y * sin(radians(-angle)) AS u FROM pt CROSS JOIN (SELECT i * 22.5::DOUBLE AS angle FROM range(8) t(i))),
 pl AS (SELECT layer, angle, v, floor((u - min(u) OVER p) / (max(u) OVER p - min(u) OVER p) * (e - 1)) + 1 AS bin, e FROM tu JOIN ne USING (layer) WINDOW p AS (PARTITION BY layer, angle)),
 per AS (SELECT layer, angle, avg(vp) AS variance FROM (SELECT layer, angle, bin, var_pop(v) AS vp FROM pl WHERE bin < e GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1, 2)
 SELECT layer, angle, round(variance, 6) AS variance, round(max(variance) OVER l / (min(variance) OVER l + 1e-10::DOUBLE), 3) AS ratio, max(variance) OVER l / (min(variance) OVER l + 1e-10::DOUBLE) > 1.5 AS anisotropic FROM per WINDOW l AS (PARTITION BY layer)""")
def q47_anisotropy_screen(s, d):
    p = points(s, d).withColumns({"x": F.col("x") / 1000, "y": F.col("y") / 1000})
    return spatial.anisotropy_screen(p, by=["layer"]).select("layer", "angle", r6("variance").alias("variance"), F.round("ratio", 3).alias("ratio"), "anisotropic")


@register("SELECT epoch, round(20.0::DOUBLE / 60 * epoch + 5 * sin(2 * pi() * epoch / 12), 6) + 0.0 AS s FROM ep")
def q48_trend_season(s, d):
    return tables.epochs(s, d).select("epoch", r6(series.seasonal(F.col("epoch"))).alias("s"))


@register("SELECT station, round(total, 6) + 0.0 AS total FROM (SELECT *, row_number() OVER (ORDER BY total, station) - 1 AS r, count(*) OVER () AS n FROM (SELECT station, sum(total) AS total FROM lastm GROUP BY 1)) WHERE r IN (0, n - 1, n // 3, 2 * n // 3)")
def q49_rank_picks(s, d):
    t = weights.totals(model(s, d), insar(s, d)).groupBy("station").agg(F.sum("total").alias("total"))
    return metrics.rank_picks(t, "total", "station").select("station", r6("total").alias("total"))


@register("SELECT station, layer, round(w, 6) + 0.0 AS w FROM wt QUALIFY row_number() OVER (PARTITION BY station ORDER BY w DESC, layer) <= 3")
def q56_top_layers(s, d):
    order = Window.partitionBy("station").orderBy(F.desc("w"), "layer")
    return depth_weights(s, d).withColumn("_r", F.row_number().over(order)).where("_r <= 3").select("station", "layer", r6("w").alias("w"))


@register("SELECT count(*) FILTER (residual < -0.1)::BIGINT AS below_01, count(*) FILTER (residual < -1.0)::BIGINT AS below_1, count(*)::BIGINT AS n FROM (SELECT d * (1 - 1.05::DOUBLE * t) AS residual FROM scum JOIN (SELECT station, sum(w) AS t FROM wt GROUP BY 1) USING (station))")
def q57_sanity_counts(s, d):
    return weights.sanity(weights.deep_residual(depth_weights(s, d).withColumn("w", 1.05 * F.col("w")), insar(s, d)))


@register("SELECT layer, round(quantile_cont(abs(value), 0.95), 6) AS p95, round(quantile_cont(abs(value), 0.98), 6) AS p98 FROM obs GROUP BY 1")
def q58_colour_limits(s, d):
    found = metrics.exact_quantiles(tables.observations(s, d).withColumn("size", F.abs("value")), "size", [0.95, 0.98], ["layer"])
    return found.groupBy("layer").agg(*[r6(F.max(F.when(F.col("q") == p / 100, F.col("quantile")))).alias(f"p{p}") for p in (95, 98)])


@register(f""", lm AS (SELECT max(dist) AS far, median(nn) AS nn, count(*) AS n FROM (SELECT station, min(dist) AS nn, max(dist) AS dist FROM (SELECT p.station, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS dist FROM sta p JOIN sta q ON p.station <> q.station) GROUP BY 1)),
 k AS (SELECT *, greatest(6, least(30, round(far / 2 / greatest(2 * nn, far * 0.01)), n * (n - 1) // 2 // 30)) AS lags FROM lm) SELECT lags::INT AS n_lags, round(far / 2 / lags, 4) AS lag_width, round(far / 2, 4) AS max_lag, round(nn, 4) AS median_nn, (n * (n - 1) // 2)::BIGINT AS n_total_pairs FROM k""")
def q59_lag_parameters(s, d):
    p = spatial.lag_parameters(tables.stations(s, d))
    return s.createDataFrame([(p["n_lags"], round(p["lag_width"], 4), round(p["max_lag"], 4), round(p["median_nn"], 4), p["n_total_pairs"])], "n_lags int, lag_width double, max_lag double, median_nn double, n_total_pairs long")


@register("SELECT layer, round(max(rmse) FILTER (fold = 1), 6) AS fold_1, round(max(rmse) FILTER (fold = 2), 6) AS fold_2, round(max(rmse) FILTER (fold = 3), 6) AS fold_3 FROM (SELECT fold, layer, sqrt(avg((pred - truth) * (pred - truth))) AS rmse FROM fpred GROUP BY 1, 2) GROUP BY 1")
def q63_fold_matrix(s, d):
    wide = fold_rmse(s, d).groupBy("layer").pivot("fold", [1, 2, 3]).agg(F.first("rmse"))
    return wide.select("layer", *[r6(F.col(str(k))).alias(f"fold_{k}") for k in (1, 2, 3)])


@register("SELECT round(avg(r), 6) AS overall, CASE WHEN avg(r) <= 0.15 THEN 'PASS' ELSE 'FAIL' END AS result FROM (SELECT layer, avg(r) AS r FROM (SELECT layer, station, sqrt(avg((pred - truth) * (pred - truth))) AS r FROM pred GROUP BY 1, 2) GROUP BY 1)")
def q64_ground_truth(s, d):
    return metrics.verdict(predicted(s, d), 0.15).select(r6("overall").alias("overall"), "result")


@register("SELECT round(avg((pred - truth) * (pred - truth)), 4) AS mse FROM pred")
def q65_well_mse(s, d):
    e = F.col("pred") - F.col("truth")
    return predicted(s, d).agg(F.round(F.avg(e * e), 4).alias("mse"))


@register("SELECT layer, k AS key, v AS value FROM (SELECT layer, unnest(['n', 'top']) AS k, unnest([count(*)::VARCHAR, max(epoch)::VARCHAR]) AS v FROM cube GROUP BY layer)")
def q66_params_report(s, d):
    per = tables.cube(s, d).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("top"))
    lines = per.select(F.format_string("layer_%d_params.txt", "layer").alias("file"), F.explode(F.array(F.concat(F.lit("n: "), "n"), F.concat(F.lit(" top :  "), "top"))).alias("value"))
    return files.parse_params(lines).select("layer", "key", "value")


@register("SELECT (row_number() OVER (ORDER BY (station * 48271 + 11) % 2147483647, station))::INT AS pick, station FROM sta ORDER BY 1 LIMIT 12")
def q67_row_sample(s, d):
    first = tables.stations(s, d).select("station").orderBy((F.col("station").cast("long") * 48271 + 11) % 2147483647, "station").limit(12)
    order = Window.orderBy((F.col("station").cast("long") * 48271 + 11) % 2147483647, "station")  # of twelve rows
    return first.select(F.row_number().over(order).alias("pick"), "station")


@register("SELECT f.station AS fold, count(*)::BIGINT AS rows_left, count(DISTINCT o.station)::BIGINT AS stations_left FROM (SELECT DISTINCT station FROM obs) f JOIN obs o ON o.station <> f.station GROUP BY 1")
def q68_station_exclusion(s, d):
    # what a fold keeps is everything less its own station: two aggregates instead of a product of folds and rows
    per = tables.observations(s, d).groupBy("station").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    return per.select(F.col("station").alias("fold"), (F.sum("n").over(whole) - F.col("n")).alias("rows_left"), (F.count(F.lit(1)).over(whole) - 1).alias("stations_left"))


@register(f", {EDGES} SELECT a, b, layer, epoch, round(weight * (p.m - q.m), 6) + 0.0 AS lsm FROM edge JOIN cum p ON p.station = a JOIN cum q ON q.station = b AND q.layer = p.layer AND q.epoch = p.epoch".replace("SELECT a, b, layer, epoch", "SELECT a, b, p.layer, p.epoch"))
def q69_spatial_smoothness(s, d):
    return system.smoothness(model(s, d), system.neighbours(tables.stations(s, d), 15000.0)).select("a", "b", "layer", "epoch", r6("lsm").alias("lsm"))


@register("SELECT station, round(f, 6) + 0.0 AS deep_fraction FROM (SELECT station, 1 - sum(w) AS f FROM wt GROUP BY 1) ORDER BY round(f, 9) DESC, station LIMIT 3")
def q81_worst_deep_fraction(s, d):
    return metrics.worst_deep_fraction(depth_weights(s, d)).select("station", r6("deep_fraction").alias("deep_fraction"))


@register("SELECT station, round(avg(rmse), 6) + 0.0 AS mean FROM (SELECT station, layer, sqrt(avg((pred - truth) * (pred - truth))) AS rmse FROM fpred WHERE fold = 3 GROUP BY 1, 2) GROUP BY 1 ORDER BY avg(rmse) DESC, station LIMIT 5")
def q82_worst_group_mean(s, d):
    last = metrics.station_layer_errors(fold_predicted(s, d).where("fold = 3"), ["station", "layer"])
    return metrics.worst_groups(last, "station", "rmse", 5).select("station", r6("mean").alias("mean"))


@register(""", cell AS (SELECT c, (c % 10)::INT AS x_idx, (c // 10)::INT AS y_idx, epoch, CASE WHEN (c % 10 + c // 10 + epoch) % 13 <> 0 THEN d END AS v FROM surf JOIN range(120) r(c) ON c % 31 = station)
 SELECT p.station, epoch, round(v, 6) + 0.0 AS value FROM cell JOIN (
 SELECT station, (SELECT arg_min(k, (abs(y - (2600000 + 500 * k)), k)) FROM (SELECT DISTINCT y_idx AS k FROM cell)) * 10 + (SELECT arg_min(k, (abs(x - (160000 + 500 * k)), k)) FROM (SELECT DISTINCT x_idx AS k FROM cell)) AS c FROM sta) p USING (c)""")
def q83_station_profile(s, d):
    """Series of a raster's surface at the stations' nearest pixels."""
    grid = files.clean(tables.raster(s, d).where("depth = 0"), "disp")
    x, y = files.axes_of(grid)
    at = grid.select((F.col("y_idx") * 10 + F.col("x_idx")).alias("pixel"), F.col("t").alias("epoch"), "disp")
    out = spatial.profile(tables.stations(s, d), at, x.withColumnRenamed("x_idx", "idx"), y.withColumnRenamed("y_idx", "idx"), 10)
    return out.select("station", "epoch", r6("disp").alias("value"))


def scratch(s: SparkSession, name: str) -> str:
    """A new folder in the shared one for what a query writes and reads again."""
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


@register("""SELECT t, y_idx, x_idx, round(-(CASE WHEN count(v) OVER p > 0 THEN sum(coalesce(v, 0)) OVER (PARTITION BY y_idx, x_idx ORDER BY t) END), 6) + 0.0 AS disp FROM (
 SELECT epoch AS t, (c // 10)::INT AS y_idx, (c % 10)::INT AS x_idx, CASE WHEN (c % 10 + c // 10 + epoch) % 13 <> 0 THEN d END AS v FROM surf JOIN range(120) r(c) ON c % 31 = station) WINDOW p AS (PARTITION BY y_idx, x_idx)""")
def q84_raster_io(s, d):
    """A raster cube written, its surface slice read again, cumulated and negated."""
    path = scratch(s, "raster")
    files.write_result(tables.raster(s, d), path, "t")
    return files.read_raster(s, path, depth=0).select("t", "y_idx", "x_idx", r6("disp").alias("disp"))


@register("SELECT station, layer, round(w, 6) + 0.0 AS w, n FROM wt JOIN (SELECT station, layer, count(*)::BIGINT AS n FROM cum GROUP BY 1, 2) USING (station, layer)")
def q85_result_io(s, d):
    """An inversion's tables stored and read again."""
    path, d = scratch(s, "result"), tables.shared(s, d)
    files.write_result(model(s, d), f"{path}/model", "epoch")
    files.write_result(depth_weights(s, d), f"{path}/weights")
    found = files.read_result(s, path)
    n = found["model"].groupBy("station", "layer").agg(F.count(F.lit(1)).alias("n"))
    return found["weights"].join(n, ["station", "layer"]).select("station", "layer", r6("w").alias("w"), "n")


@register("SELECT station::VARCHAR AS station, layer * 10 AS depth, 'Month_' || lpad((epoch + 1)::VARCHAR, 3, '0') AS label, round(value, 6) + 0.0 AS value FROM obs")
def q86_wide_csv_io(s, d):
    """Wide files, one for each station, written and read again."""
    path, months = scratch(s, "csv"), [f"Month_{k + 1:03d}" for k in range(N)]
    named = tables.observations(s, d).withColumn("label", F.format_string("Month_%03d", F.col("epoch") + 1)).withColumn("Depth", F.col("layer") * 10)
    files.write_wide_csv(named.groupBy("station", "Depth").pivot("label", months).agg(F.first("value")), path)
    return files.read_wide_csv(s, f"{path}/*.csv").where("value is not null").select("station", "depth", "label", r6("value").alias("value"))


PRODUCT = {"residual": {"units": "mm", "long_name": "surface less all layers"}, "w": {"units": "1"}}


@register("SELECT station, epoch AS t, round((d * (1 - t.t))::FLOAT::DOUBLE, 3) + 0.0 AS residual FROM scum JOIN (SELECT station, sum(w) AS t FROM wt GROUP BY 1) t USING (station)")
def q87_product_io(s, d):
    """A product of two variables with attributes, in single precision, split by time."""
    path, d = scratch(s, "product"), tables.shared(s, d)
    deep = weights.deep_residual(depth_weights(s, d), insar(s, d)).withColumnRenamed("epoch", "t")
    files.write_product({"weights": depth_weights(s, d), "residual": deep.select("station", "t", "residual")}, path, PRODUCT)
    found, _ = files.read_product(s, path, "residual")
    return found.select("station", "t", (F.round(F.col("residual").cast("double"), 3) + F.lit(0.0)).alias("residual"))


@register("SELECT station, round(sum(pred), 6) + 0.0 AS total_pred, round(sum(truth), 6) + 0.0 AS total_true, round(sum(pred) - sum(truth), 6) + 0.0 AS total_error, round(abs(sum(pred) - sum(truth)), 6) + 0.0 AS total_abs_error, " + ", ".join(f"round(max(pred - truth) FILTER (layer = {k}), 6) + 0.0 AS error_l{10 * k}" for k in range(1, 8)) + " FROM loo GROUP BY 1")
def q88_column_errors(s, d):
    out = metrics.column_errors(left_out(s, d), list(range(1, 8)))
    return out.select("station", *[r6(c).alias(c) for c in out.columns if c != "station"])


@register("SELECT fold, station, layer, round(sqrt(avg((pred - truth) * (pred - truth))), 6) + 0.0 AS rmse, round(avg(abs(pred - truth)), 6) + 0.0 AS mae, count(*)::BIGINT AS n_valid FROM fpred GROUP BY 1, 2, 3")
def q89_station_layer_errors(s, d):
    return metrics.station_layer_errors(fold_predicted(s, d), ["fold", "station", "layer"]).select("fold", "station", "layer", r6("rmse").alias("rmse"), r6("mae").alias("mae"), "n_valid")


@register("SELECT station, round(max(abs(d)), 6) AS top, max(abs(d)) >= 10 AS valid FROM scum GROUP BY 1")
def q90_valid_surface(s, d):
    return system.valid_surface(insar(s, d)).select("station", r6("top").alias("top"), "valid")


@register("""SELECT part, count(*)::BIGINT AS n, round(sum((l - r) * (l - r)), 3) + 0.0 AS square FROM (
 SELECT 'surface' AS part, g AS l, d AS r FROM (SELECT station, epoch, sum(m) AS g FROM cum GROUP BY 1, 2) JOIN scum USING (station, epoch)
 UNION ALL SELECT 'well', c.m, -o.value FROM cum c JOIN obs o USING (station, layer, epoch)
 UNION ALL SELECT 'vertical', sqrt(0.01::DOUBLE) * coalesce(m - lead(m) OVER (PARTITION BY station, epoch ORDER BY layer), 0), 0 FROM cum
 UNION ALL SELECT 'temporal', sqrt(3.0::DOUBLE) * x, 0 FROM (SELECT lead(m) OVER (PARTITION BY station, layer ORDER BY epoch) - m AS x FROM cum) WHERE x IS NOT NULL) GROUP BY 1""")
def q94_augmented_stack(s, d):
    d = tables.shared(s, d)
    wells = tables.observations(s, d).select("station", "layer", "epoch", (-F.col("value")).alias("w"))
    out = system.stacked(model(s, d), insar(s, d), wells, 0.01, 3.0)
    e = F.col("left") - F.col("right")
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(e * e), 3) + F.lit(0.0)).alias("square"))


@register("SELECT 'cells' AS key, count(*)::VARCHAR AS value FROM cube UNION ALL SELECT 'stations', count(DISTINCT station)::VARCHAR FROM cube UNION ALL SELECT 'last_epoch', max(epoch)::VARCHAR FROM cube")
def q95_key_value_io(s, d):
    """Figures of the cube as lines key=value, written and read again."""
    path = scratch(s, "params")
    found = tables.cube(s, d).agg(F.count(F.lit(1)).cast("string").alias("cells"), F.countDistinct("station").cast("string").alias("stations"), F.max("epoch").cast("string").alias("last_epoch"))
    files.save_key_values(found.unpivot([], ["cells", "stations", "last_epoch"], "key", "value"), path)
    return files.read_key_values(s, path)


@register("SELECT station::VARCHAR AS name, x, y FROM sta")
def q96_coordinates_io(s, d):
    """Coordinates appended to a CSV file twice, and read again once each."""
    path = scratch(s, "coordinates")
    sta = tables.stations(s, d).select(F.col("station").cast("string").alias("Ename"), F.col("x").alias("X_TWD97"), F.col("y").alias("Y_TWD97"))
    files.append_csv(sta.where("Ename < '2'"), path)
    files.append_csv(sta.where("Ename >= '2'"), path)
    return files.read_coordinates(s, path)


@register("SELECT layer, round(max(w), 6) AS top, count(*)::BIGINT AS n FROM wt GROUP BY 1")
def q97_sidecar_io(s, d):
    """A sidecar of figures for each layer as JSON, written and read again."""
    path = scratch(s, "sidecar")
    files.write_sidecar(depth_weights(s, d).groupBy("layer").agg(r6(F.max("w")).alias("top"), F.count(F.lit(1)).alias("n")), path)
    return files.read_sidecar(s, path, "layer int, top double, n long")


@register("""SELECT DISTINCT 'x' AS axis, (c % 10)::INT AS idx, (160000.0 + 500 * (c % 10))::DOUBLE AS value FROM obs JOIN range(120) r(c) ON c % 31 = station
 UNION ALL SELECT DISTINCT 'y', (c // 10)::INT, (2600000.0 + 500 * (c // 10))::DOUBLE FROM obs JOIN range(120) r(c) ON c % 31 = station""")
def q101_raster_axes(s, d):
    """The axes of a raster cube."""
    x, y = files.axes_of(tables.raster(s, d))
    one = lambda df, name: df.select(F.lit(name).alias("axis"), F.col(f"{name}_idx").alias("idx"), F.col(name).alias("value"))
    return one(x, "x").unionByName(one(y, "y"))


@register("SELECT station, n.index, layer, epoch, round(value, 6) + 0.0 AS value FROM obs o JOIN (SELECT station, (row_number() OVER (ORDER BY station) - 1)::INT AS index FROM sta WHERE station <> 5) n USING (station)")
def q102_station_subset(s, d):
    """What is left without station 5."""
    return series.without(tables.observations(s, d), tables.stations(s, d), 5).select("station", "index", "layer", "epoch", r6("value").alias("value"))


@register(f", {STD} SELECT station, epoch, round(d * (1 - t), 6) + 0.0 AS residual, round(v * abs(d), 9) + 0.0 AS residual_std FROM scum JOIN (SELECT station, sum(w) AS t, sqrt(sum(std * std)) AS v FROM ws GROUP BY 1) USING (station)")
def q103_deep_residual_std(s, d):
    d = tables.shared(s, d)
    out = weights.deep_residual_std(with_std(s, d), insar(s, d))
    return out.select("station", "epoch", r6("residual").alias("residual"), (F.round("residual_std", 9) + F.lit(0.0)).alias("residual_std"))


@register(""" SELECT pixel, station, round(sqrt(square), 6) AS dist FROM (SELECT c::INT AS pixel, arg_min(sta.station, (square, sta.station)) AS station, min(square) AS square FROM (
 SELECT DISTINCT c, sta.station, (160000 + 500 * (c % 10) - sta.x) * (160000 + 500 * (c % 10) - sta.x) + (2600000 + 500 * (c // 10) - sta.y) * (2600000 + 500 * (c // 10) - sta.y) AS square FROM surf JOIN range(120) r(c) ON c % 31 = surf.station CROSS JOIN sta) sta GROUP BY 1)""")
def q104_nearest_station(s, d):
    """The station nearest to each pixel of a raster."""
    pixels = tables.raster(s, d).select((F.col("y_idx") * 10 + F.col("x_idx")).alias("pixel"), "x", "y").distinct()
    return spatial.nearest(pixels, tables.stations(s, d), "pixel", "station").select("pixel", "station", r6(F.sqrt("square")).alias("dist"))


@register("""SELECT epoch AS t, (c // 10)::INT AS y_idx, (c % 10)::INT AS x_idx, round(d, 6) + 0.0 AS disp FROM surf JOIN range(120) r(c) ON c % 31 = station WHERE (c % 10 + c // 10 + epoch) % 13 <> 0 AND epoch BETWEEN 20 AND 44""")
def q105_netcdf_io(s, d):
    """A raster's surface as NetCDF, a dense block for each time, and 25 times of it read again."""
    path = scratch(s, "netcdf")
    grid = tables.raster(s, d).where("depth = 0").select("t", "y_idx", "x_idx", "disp")
    arrays.write_netcdf(grid, path, ["t", "y_idx", "x_idx"])
    back = files.clean(arrays.read_netcdf(s, path, "disp", 20, 44), "disp").where("disp is not null")
    return back.select(*[F.col(c).cast("int").alias(c) for c in ("t", "y_idx", "x_idx")], r6("disp").alias("disp"))


@register("SELECT station, layer, round(w, 6) + 0.0 AS w FROM wt")
def q106_npz_io(s, d):
    """The weights of an inversion as NPZ, written and read again."""
    path = scratch(s, "npz")
    arrays.write_npz(depth_weights(s, d).select("station", "layer", "w"), path)
    return arrays.read_npz(s, path).select(F.col("station").cast("int").alias("station"), F.col("layer").cast("int").alias("layer"), r6("w").alias("w"))


@register("SELECT station, epoch AS t, round((d * (1 - t.t))::FLOAT::DOUBLE, 3) + 0.0 AS residual FROM scum JOIN (SELECT station, sum(w) AS t FROM wt GROUP BY 1) t USING (station)")
def q107_netcdf_product_io(s, d):
    """A product's residual in single precision as NetCDF, written and read again."""
    d, path = tables.shared(s, d), scratch(s, "product")
    deep = weights.deep_residual(depth_weights(s, d), insar(s, d))
    arrays.write_netcdf(deep.select(F.col("epoch").alias("t"), "station", F.col("residual").cast("float").alias("residual", metadata=PRODUCT["residual"])), path, ["t", "station"])
    back = files.clean(arrays.read_netcdf(s, path, "residual"), "residual").where("residual is not null")
    return back.select(F.col("station").cast("int").alias("station"), F.col("t").cast("int").alias("t"), (F.round("residual", 3) + F.lit(0.0)).alias("residual"))


@register(" SELECT station, layer, round(m / CASE WHEN sum(m) OVER p > 0 THEN sum(m) OVER p ELSE 1 END, 6) + 0.0 AS w FROM cum WHERE epoch = 82 WINDOW p AS (PARTITION BY station)")
def q111_well_shares(s, d):
    """Weights as shares of the layers' total, in place of the surface."""
    return weights.well_shares(model(s, d)).select("station", "layer", r6("w").alias("w"))


@register(" SELECT layer, fold = 3 AS tuned, round(sqrt(avg((pred - truth) * (pred - truth))), 6) AS rmse, round(avg(abs(pred - truth)), 6) AS mae, round(avg(pred - truth), 6) + 0.0 AS bias, round(corr(pred, truth), 6) AS correlation, count(*)::BIGINT AS n_valid FROM fpred GROUP BY 1, 2")
def q112_errors_apart_from_tuning(s, d):
    """Errors of each layer on the fold that smoothing is tuned on, and on the others."""
    out = metrics.apart_from_tuning(fold_predicted(s, d), ["layer"])
    return out.select("layer", "tuned", *[r6(c).alias(c) for c in ("rmse", "mae", "bias", "correlation")], "n_valid")
