"""Inversion, validation and gridding as jobs: each a grouped Arrow kernel over a key that really separates the problem."""

from __future__ import annotations

import itertools
import os
import pickle
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..kernels import bayes, fields
from ..kernels import least_squares as ls
from ..operators import metrics, series, spatial, system, weights
from ..session import cut, shared_dir
from ..settings import RunConfig
from ..sources import tables
from ..stages import Stages, fingerprint

for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")

#: Bounds of a Gaussian process's search, see FieldSearch.
Bounds = Mapping[str, float | None] | None
#: The search grid of the two smoothing parameters, as powers of ten.
LAM, LAM_T = [10.0 ** (-5 + 0.5 * k) for k in range(11)], [10.0 ** (-2 + 0.25 * k) for k in range(13)]
#: Trials of each engine's search.
TRIALS = {"gp": 200, "rotated": 200, "kriging": 50}


def station_rows(model: DataFrame, insar: DataFrame) -> DataFrame:
    """(station, epoch, layer, w, d): what one station's kernel needs."""
    return model.withColumnRenamed("m", "w").join(insar, ["station", "epoch"])


def _cube(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    wide = pdf.pivot(index="epoch", columns="layer", values="w").sort_index()
    return wide.index.to_numpy(), wide.columns.to_numpy(), wide.to_numpy(), pdf.groupby("epoch")["d"].first().sort_index().to_numpy()


def _long(pdf: pd.DataFrame, keys: dict, epochs: np.ndarray, layers: np.ndarray, m: np.ndarray, **more: float) -> pd.DataFrame:
    out = pd.DataFrame({"epoch": np.repeat(epochs, len(layers)), "layer": np.tile(layers, len(epochs)), "m": m.ravel()})
    for k, v in {**keys, **more}.items():
        out[k] = v
    return out


def invert(rows: DataFrame, solver: str = "joint", lam: float = 0.01, lam_t: float = 3.0, sigma: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(station, epoch, layer, m, kkt): non-negative compaction. The problem separates by station, so each is one task's group."""
    if solver not in ("joint", "independent"):
        raise ValueError(f"unknown solver {solver!r}: joint or independent; cvxpy is invert_coupled")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        epochs, layers, w, d = _cube(pdf)
        m, off = ls.solve_joint(d, w, lam, lam_t, sigma=sigma) if solver == "joint" else ls.solve_independent(d, w, lam, sigma=sigma)
        return _long(pdf, {"station": int(pdf["station"].iloc[0])}, epochs, layers, m, kkt=off)[["station", "epoch", "layer", "m", "kkt"]]

    return rows.groupBy("station").applyInPandas(solve, "station int, epoch int, layer int, m double, kkt double")


#: Strengths of smoothing in time that the sweep goes through.
SWEEP = (1.0, 3.0, 4.0, 5.0, 6.0)


def solver_sweep(rows: DataFrame, lam: float = 0.01, lams_t: tuple[float, ...] = SWEEP) -> DataFrame:
    """(solver, lam_t, mse): mean square difference from the wells after inversion. A station's rows go through all runs in one task."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, w, d = _cube(pdf)
        alone = float(((ls.solve_independent(d, w, lam)[0] - w) ** 2).sum())  # the independent solver has no smoothing in time
        found = [("independent", t, alone) for t in lams_t] + [("joint", t, float(((ls.solve_joint(d, w, lam, t)[0] - w) ** 2).sum())) for t in lams_t]
        return pd.DataFrame(found, columns=["solver", "lam_t", "sse"]).assign(n=float(w.size))

    per = rows.groupBy("station").applyInPandas(solve, "solver string, lam_t double, sse double, n double")
    return per.groupBy("solver", "lam_t").agg((F.sum("sse") / F.sum("n")).alias("mse"))


#: Rounds of consensus in one job, between checkpoints, and in all.
ROUNDS, MOST_ROUNDS = 8, 2000
#: A station's own row (sender null: what it knows, packed) or a neighbour's proposal.
MESSAGES = "station int, sender int, body binary, primal double, dual double"


def invert_coupled(rows: DataFrame, edges: DataFrame, lam: float = 0.01, lam_t: float = 1.0, tolerance: float = 1e-6, sigma: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(station, epoch, layer, m, primal, dual) with neighbours coupled along edges (a, b, weight) and layers bounded by the surface.

    Consensus among stations (`least_squares.Station`): in a round every station gets its neighbours' proposals by one shuffle on the station
    and sends its own, so that no task holds more than one station and what its edges tell it. Residuals are aggregated after each job
    of several rounds; the rounds go on until the largest is below the tolerance. Edges to stations without rows don't count.
    """
    known = rows.select("station").distinct()
    ends = edges.select(F.col("a").alias("station"), F.col("b").alias("other"), "weight").unionAll(edges.select(F.col("b").alias("station"), F.col("a").alias("other"), "weight"))
    ends = ends.join(known, "station", "left_semi").join(known.withColumnRenamed("station", "other"), "other", "left_semi")
    near = ends.groupBy("station").agg(F.sort_array(F.collect_list(F.struct("other", "weight"))).alias("near"))
    # a station's neighbours are within a radius; they travel on its first row only
    first = F.row_number().over(Window.partitionBy("station").orderBy("epoch", "layer")) == 1
    placed = rows.join(near, "station", "left").withColumn("near", F.when(first, F.col("near")))

    def told(station: int, others: list[int], part: ls.Station, axes: tuple, residuals: tuple[float, float]) -> pd.DataFrame:
        bodies = [pickle.dumps((others, part, axes)), *(np.ascontiguousarray(x).tobytes() for x in part.proposals())]
        out = pd.DataFrame({"station": [station, *others], "sender": pd.array([None] + [station] * len(others), "Int32"), "body": bodies})
        return out.assign(primal=residuals[0], dual=residuals[1])

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        found = next((x for x in pdf["near"] if x is not None), [])
        epochs, layers, w, d = _cube(pdf)
        part = ls.Station(d, w, np.array([e["weight"] for e in found]), lam, lam_t, sigma)
        part.rho, keep = part.rho * 0, part.rho  # no copies yet
        part.solve()
        part.rho = keep
        return told(int(pdf["station"].iloc[0]), [int(e["other"]) for e in found], part, (epochs, layers), (np.inf, np.inf))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["sender"].isna().to_numpy()
        others, part, axes = pickle.loads(pdf["body"][own].iloc[0])
        bodies = dict(zip(pdf["sender"][~own].astype(int), pdf["body"][~own], strict=True))
        theirs = np.stack([np.frombuffer(bodies[o]).reshape(part.x.shape) for o in others]) if others else np.zeros((0, *part.x.shape))
        residuals = part.agree(theirs)
        part.solve()
        return told(int(pdf["station"].iloc[0]), others, part, axes, residuals)

    now = placed.groupBy("station").applyInPandas(begin, MESSAGES)
    for _ in range(0, MOST_ROUNDS, ROUNDS):
        for _ in range(ROUNDS):
            now = now.groupBy("station").applyInPandas(step, MESSAGES)
        now = cut(now)
        worst = now.agg(F.max(F.greatest("primal", "dual"))).first()[0]
        if worst is None or worst < tolerance:
            break

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for station, body, primal, dual in zip(pdf["station"], pdf["body"], pdf["primal"], pdf["dual"], strict=True):
                _, part, (epochs, layers) = pickle.loads(body)
                yield _long(pdf, {"station": station}, epochs, layers, part.x, primal=primal, dual=dual)[["station", "epoch", "layer", "m", "primal", "dual"]]

    return now.where("sender is null").mapInPandas(unpacked, "station int, epoch int, layer int, m double, primal double, dual double")


#: Observations of an epoch at most, whose factor every worker gets (72 MB); epochs solved together, and voxels of a block.
MOST_OBSERVED, TOGETHER, VOXELS = 3000, 16, 512


def bayes_epochs(rows: DataFrame, kind: str = "isotropic", sigma: float = 3.0, length: float = 3.0, length_z: float = 0.5, noise: tuple[float, float] = (0.5, 0.1)) -> DataFrame:
    """(epoch, station, layer, mean, std) of all voxels, the stations on a square raster, every fourth a well; kind: isotropic, anisotropic or
    depth (a prior mean for each layer). Every epoch has the same voxels.

    What observations make of each other is the same at all epochs: one row for each observation, made in tasks by station, factored once and
    broadcast (MOST_OBSERVED at most). Some epochs at a time are solved in the space of observations, and voxels come in blocks that
    are met with these solutions one after the other, so that memory depends on neither the number of epochs nor that of voxels.
    """
    spark = rows.sparkSession
    voxels = rows.select("station", "layer").distinct()
    stations_, wells_ = (voxels.where(c).count() if c else voxels.select("station").distinct().count() for c in (None, "station % 4 = 0"))
    if stations_ + wells_ > MOST_OBSERVED:
        raise ValueError(f"{stations_ + wells_} observations: {MOST_OBSERVED} at most")
    known = voxels.orderBy("station", "layer").toPandas()  # each station is observed, so these are few
    s, layers = known["station"].to_numpy(), np.sort(known["layer"].unique())
    names = np.unique(s)
    side = int(np.ceil(np.sqrt(names.max(initial=0) + 1)))
    place = lambda station, layer: np.column_stack([station // side, station % side, np.searchsorted(layers, layer)]).astype(float)
    well = np.flatnonzero(s % 4 == 0)
    model = bayes.Observed(place(s, known["layer"].to_numpy()), np.searchsorted(names, s), well, sigma, length, None if kind == "isotropic" else length_z)
    many = len(names) + len(well)
    sent = spark.sparkContext.broadcast(model)

    def observe(pdf: pd.DataFrame) -> pd.DataFrame:
        of, cov = sent.value.covered(np.flatnonzero(s == pdf["station"].iloc[0]))
        return pd.DataFrame({"observation": of, "row": list(cov)})

    found = voxels.groupBy("station").applyInPandas(observe, "observation int, row array<double>").toPandas()
    gain = np.zeros((many, many))
    gain[found["observation"].to_numpy(int)] = np.array(found["row"].tolist()).reshape(-1, many)
    gain[np.arange(many), np.arange(many)] += np.r_[np.full(len(names), noise[0] ** 2), np.full(len(well), noise[1] ** 2)]
    factor = spark.sparkContext.broadcast(np.linalg.cholesky(gain) if many else gain)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        epochs = np.sort(pdf["epoch"].unique())
        w = pdf.pivot(index=["station", "layer"], columns="epoch", values="w").sort_index().to_numpy()
        d = pdf.groupby(["station", "epoch"])["d"].first().unstack().sort_index().to_numpy()
        if w.shape[0] != len(s) or np.isnan(w).any() or np.isnan(d).any():
            raise ValueError("every epoch has the same voxels and a surface at every station")
        prior = np.broadcast_to(w[well].mean(axis=0), w.shape).copy()
        if kind == "depth":
            for layer in layers:
                here, seen_ = known["layer"].to_numpy() == layer, well[known["layer"].to_numpy()[well] == layer]
                if len(seen_):
                    prior[here] = w[seen_].mean(axis=0)
        off = np.concatenate([d, w[well]]) - sent.value.seen(prior.T).T
        step = np.linalg.solve(factor.value.T, np.linalg.solve(factor.value, off))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "epochs": [epochs.tolist()], "step": [step.tobytes()], "prior": [prior.tobytes()]})

    parted = rows.withColumn("part", F.floor(F.col("epoch") / TOGETHER).cast("int"))
    steps = cut(parted.select("part", "epoch", "station", "layer", "w", "d").groupBy("part").applyInPandas(solve, "part int, epochs array<int>, step binary, prior binary"))
    numbers = spark.range(0, len(s), 1, max(1, len(s) // VOXELS)).select(F.floor(F.col("id") / VOXELS).cast("int").alias("block")).distinct()
    parts = [r["part"] for r in steps.select("part").collect()]  # a number for each TOGETHER epochs
    jobs = numbers.withColumn("part", F.explode(F.array(*[F.lit(k) for k in parts]).cast("array<int>"))).join(steps, "part")

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            for block, epochs, step, prior in zip(pdf["block"], pdf["epochs"], pdf["step"], pdf["prior"], strict=True):
                mine = np.arange(block * VOXELS, min(len(s), (block + 1) * VOXELS))
                if last != block:
                    cross = sent.value.cross(sent.value.place[mine] * sent.value.scale)
                    last, std = block, np.sqrt(sent.value.variance(cross, factor.value))
                mean = np.frombuffer(prior).reshape(len(s), -1)[mine] + cross @ np.frombuffer(step).reshape(many, -1)
                t = len(epochs)
                yield pd.DataFrame({"epoch": np.tile(epochs, len(mine)), "station": np.repeat(s[mine], t), "layer": np.repeat(known["layer"].to_numpy()[mine], t), "mean": mean.ravel(), "std": np.repeat(std, t)})

    dealt = jobs.repartition("block", "part").sortWithinPartitions("block", "part")
    return dealt.mapInPandas(predict, "epoch int, station int, layer int, mean double, std double")


def posterior_spread(rows: DataFrame, lam: float, lam_t: float) -> DataFrame:
    """(station, epoch, layer, std): exact spread of the joint solution, from the epochs and layers that each station has. It takes the place
    of an estimate by random probes."""

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        epochs, layers = np.sort(pdf["epoch"].unique()), np.sort(pdf["layer"].unique())
        std = ls.posterior_std(len(epochs), len(layers), lam, lam_t)
        return _long(pdf, {"station": int(pdf["station"].iloc[0])}, epochs, layers, std).rename(columns={"m": "std"})[["station", "epoch", "layer", "std"]]

    return rows.select("station", "epoch", "layer").groupBy("station").applyInPandas(spread, "station int, epoch int, layer int, std double")


def forward_validation(rows: DataFrame, folds: DataFrame, lam: float, lam_t: float, sigma: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(fold, station, epoch, layer, pred, truth): every fold trains on the epochs before its window; all folds in one job."""
    # three fold rows
    spread = rows.join(F.broadcast(folds), F.col("epoch") <= F.col("val_end"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        end = int(pdf["train_end"].iloc[0])
        epochs, layers, w, d = _cube(pdf)
        train = epochs <= end
        m, _ = ls.solve_joint(d[train], w[train], lam, lam_t, sigma=sigma)
        share = m[-1] / (d[train][-1] if d[train][-1] > 0 else 1.0)
        share = share * min(1.0, weights.CAP / max(share.sum(), 1e-9))
        pred = d[~train, None] * share[None, :]
        out = _long(pdf, {"fold": int(pdf["fold"].iloc[0]), "station": int(pdf["station"].iloc[0])}, epochs[~train], layers, pred)
        return out.assign(pred=out["m"], truth=w[~train].ravel())[["fold", "station", "epoch", "layer", "pred", "truth"]]

    return spread.groupBy("fold", "station").applyInPandas(solve, "fold int, station int, epoch int, layer int, pred double, truth double")


def engine_search(x: np.ndarray, y: np.ndarray, engine: str, trials: int | None = None, most_ratio: float = 10.0, splits: int = 5, bounds: Bounds = None) -> fields.FieldSearch | fields.KrigingSearch:
    """The search of an engine: gp (one length), rotated (angle and two lengths) or kriging."""
    trials = trials or TRIALS[engine]
    if engine == "kriging":
        return fields.KrigingSearch(x, y, most_ratio, trials, splits)
    return fields.FieldSearch(x, y, engine == "rotated", most_ratio, trials, bounds=bounds)


#: Trials that are scored together.
CHUNK = 25


def search_models(points: DataFrame, engine: str = "gp", trials: int | None = None, most_ratio: float = 10.0, hold_out: bool = False, splits: int = 5, bounds: Bounds = None) -> DataFrame:
    """(layer, held, points, params): each layer's best parameters, and if asked those without each station; null where all values are 0 or
    fewer than three points are left. points: (station, x, y, v) in km of the layer, a few thousand at most.

    Trials are rows: chunks of them are dealt out as (layer, station held out, chunk) and scored, the best of each sector of angles is
    found by aggregation; these starts are rows again and refined, and so is the best of them. No job is one layer's.
    """
    count, parts = trials or TRIALS[engine], 4 * points.sparkSession.sparkContext.defaultParallelism
    point = F.struct("station", (F.col("x") / 1000).alias("x"), (F.col("y") / 1000).alias("y"), F.col("v").cast("double").alias("v"))
    layers = cut(points.groupBy("layer").agg(F.sort_array(F.collect_list(point)).alias("points")))
    jobs = layers.withColumn("held", F.explode("points.station") if hold_out else F.lit(None).cast("int"))
    key = ["layer", "held"]

    def search_of(points_: list, held: object) -> fields.FieldSearch | fields.KrigingSearch | None:
        left = [p for p in points_ if held is None or p["station"] != held]
        x, y = np.array([[p["x"], p["y"]] for p in left]).reshape(-1, 2), np.array([p["v"] for p in left])
        return engine_search(x, y, engine, count, most_ratio, splits, bounds) if np.any(y) and (held is None or len(y) >= 3) else None

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        last, search = None, None
        for pdf in batches:
            for r in pdf.to_dict("records"):
                held = None if pd.isna(r["held"]) else int(r["held"])
                if last != (r["layer"], held):
                    last, search = (r["layer"], held), search_of(r["points"], held)
                if search is not None:
                    yield r, held, search

    def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"held": "Int32"})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, held, search in rows_of(batches):
            part = slice(r["chunk"] * CHUNK, (r["chunk"] + 1) * CHUNK)
            scores, sectors = search.scores(part), search.sectors(part)
            best = [int(np.flatnonzero(sectors == c)[scores[sectors == c].argmin()]) for c in np.unique(sectors)]
            yield frame([(r["layer"], held, int(sectors[k]), float(scores[k]), part.start + k, search.trials[part.start + k].tolist()) for k in best], [*key, "sector", "score", "trial", "params"])

    def refine(rounds_of: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for r, held, search in rows_of(batches):
                p, found = search.refine(np.array(r["params"]), getattr(search, rounds_of))
                yield frame([(r["layer"], held, 1, float(found), r["trial"], p.tolist())], [*key, "step", "score", "trial", "params"])

        return run

    def best(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
        picked = F.min_by(F.struct("score", "trial", "params"), F.struct("score", *order)).alias("b")
        return rows.groupBy(*keys).agg(picked).select(*keys, "b.*")

    def dealt(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(parts, *keys).sortWithinPartitions(*key)

    def with_points(rows: DataFrame) -> DataFrame:
        # a row for each layer
        return rows.join(F.broadcast(layers), "layer")

    chunk = F.explode(F.sequence(F.lit(0), F.lit((count + (engine != "kriging") - 1) // CHUNK))).alias("chunk")
    ints = "layer int, held int"
    scored = dealt(jobs.select("layer", "held", "points", chunk), *key, "chunk").mapInPandas(score, f"{ints}, sector int, score double, trial int, params array<double>")
    starts = best(scored, [*key, "sector"], "trial")
    kind = fields.KrigingSearch if engine == "kriging" else fields.FieldSearch
    if kind.refined:  # a few sectors for each layer and station
        starts = starts.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("score", "trial"))).where(F.col("_r") <= kind.refined).drop("_r")
    starts = cut(starts)
    ends = dealt(with_points(starts), *key, "sector").mapInPandas(refine("rounds"), f"{ints}, step int, score double, trial int, params array<double>")
    ends = best(ends.unionByName(starts.select(*key, F.lit(0).alias("step"), "score", "trial", "params")), key, "step", "trial")
    if kind.last:
        ends = dealt(with_points(cut(ends)), *key).mapInPandas(refine("last"), f"{ints}, step int, score double, trial int, params array<double>")
    found = ends.select(F.col("layer").alias("_l"), F.col("held").alias("_h"), "params")
    return jobs.join(found, (F.col("layer") == F.col("_l")) & F.col("held").eqNullSafe(F.col("_h")), "left").drop("_l", "_h")


def leave_one_out(points: DataFrame, engine: str = "gp", trials: int | None = None, most_ratio: float = 10.0, splits: int = 5, bounds: Bounds = None) -> DataFrame:
    """(layer, station, pred, std, truth): for each layer and station the value at its place from all other stations. The engine's
    whole search is made again without the station held out (`search_models`). The inversion separates by station, so the others' solutions
    are reused."""
    found = search_models(points, engine, trials, most_ratio, hold_out=True, splits=splits, bounds=bounds)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                at = {bool(p["station"] == r["held"]): [] for p in r["points"]}
                for p in r["points"]:
                    at[p["station"] == r["held"]].append((p["x"], p["y"], p["v"]))
                (x0, y0, truth), left = at[True][0], np.array(at.get(False, [])).reshape(-1, 3)
                pred, std = np.nan, np.nan
                if r["params"] is not None:
                    try:
                        mean, spread = engine_search(left[:, :2], left[:, 2], engine, 1, most_ratio, splits, bounds).made(np.array(r["params"])).predict(np.array([[x0, y0]]))
                        pred, std = float(mean[0]), float(spread[0])
                    except np.linalg.LinAlgError:
                        pass
                elif not np.any(left[:, 2]):  # others of zeros are 0 without a fit
                    pred, std = 0.0, 0.0
                out.append((r["layer"], int(r["held"]), pred, std, truth))
            yield pd.DataFrame(out, columns=["layer", "station", "pred", "std", "truth"])

    return found.mapInPandas(predict, "layer int, station int, pred double, std double, truth double")


def grid_search(rows: DataFrame, train_end: int, val_end: int, lams: Sequence[float] = LAM, lams_t: Sequence[float] = LAM_T, solver: str = "joint", sigma: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(lam, lam_t, mean_rmse, max_rmse): the whole grid on one fold. A station's rows come to one task once, which goes through all
    cells of the grid. The coupled solver is scored as the joint one, station by station."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        epochs, layers, w, d = _cube(pdf)
        train = epochs <= train_end
        out = []
        for lam, lam_t in itertools.product(lams, lams_t):
            m, _ = ls.solve_independent(d[train], w[train], lam, sigma=sigma) if solver == "independent" else ls.solve_joint(d[train], w[train], lam, lam_t, sigma=sigma)
            share = m[-1] / (d[train][-1] if d[train][-1] > 0 else 1.0)
            e = d[~train, None] * share[None, :] - w[~train]
            out.append(pd.DataFrame({"lam": lam, "lam_t": lam_t, "layer": layers, "sse": (e * e).sum(axis=0), "n": float(len(e))}))
        return pd.concat(out)

    per = rows.where(F.col("epoch") <= val_end).groupBy("station").applyInPandas(solve, "lam double, lam_t double, layer int, sse double, n double")
    layers = per.groupBy("lam", "lam_t", "layer").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))
    return layers.groupBy("lam", "lam_t").agg(F.avg("rmse").alias("mean_rmse"), F.max("rmse").alias("max_rmse"))


def grid_pixels(spark: SparkSession) -> DataFrame:
    """(pixel, x, y): every cell of the bound raster."""
    (x0, dx, nx), (y0, dy, ny) = tables.X_AXIS, tables.Y_AXIS
    p = F.col("id").cast("int")
    return spark.range(0, nx * ny, 1, max(1, nx * ny // 4096)).select(p.alias("pixel"), (x0 + (p % nx) * dx).alias("x"), (y0 + F.floor(p / nx) * dy).alias("y"))


def fit_engine(x: np.ndarray, y: np.ndarray, engine: str, trials: int | None = None, most_ratio: float = 10.0) -> fields.Field | fields.Kriging:
    """One layer's model by the whole search of its engine, in one place."""
    search = engine_search(x, y, engine, trials, most_ratio)
    return search.made(fields.searched(search))


def held_out_error(x: np.ndarray, y: np.ndarray, model: fields.Field | fields.Kriging, clusters: int = 5) -> float:
    """Root mean square error at clusters of points left out in turn, by the model's parameters on the others."""
    folds = fields.spatial_folds(x, clusters)
    if isinstance(model, fields.Kriging):
        return float(np.sqrt(fields.kriging_score(x, y, folds, {k: getattr(model, k) for k in ("model", "sill", "reach", "nugget", "shape", "angle", "ratio")})))
    got = fields.cross_validate(x, y, folds, lambda a, b: fields.Field(a, b, model.angle, model.lengths, model.signal, model.noise))
    return float(np.sqrt(np.nanmean((got[:, 0] - y) ** 2)))


#: What a fitted model is, the same for all engines: a row for each layer.
MODEL = "layer int, engine string, variogram string, angle double, ratio double, major double, minor double, sill double, nugget double, shape double, sx array<double>, sy array<double>, sv array<double>"


def fit_layers(points: DataFrame, engine: str = "gp", trials: int | None = None, most_ratio: float = 10.0, splits: int = 5, bounds: Bounds = None) -> DataFrame:
    """(layer, engine, variogram, angle, ratio, major, minor, sill, nugget, shape, sx, sy, sv): each layer's model with its points in km, a
    few thousand at most, by `search_models`. A layer of zeros has no engine."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                at = np.array([(p["x"], p["y"], p["v"]) for p in r["points"]]).reshape(-1, 3)
                out = {"layer": int(r["layer"]), "engine": None, "variogram": None, "angle": 0.0, "ratio": 1.0, "major": 0.0, "minor": 0.0, "sill": 0.0, "nugget": 0.0, "shape": 1.0, "sx": at[:, 0].tolist(), "sy": at[:, 1].tolist(), "sv": at[:, 2].tolist()}
                if r["params"] is not None:
                    m = engine_search(at[:, :2], at[:, 2], engine, 1, most_ratio, splits, bounds).made(np.array(r["params"]))
                    if engine == "kriging":
                        out |= {"engine": engine, "variogram": m.model, "angle": m.angle, "ratio": m.ratio, "major": m.reach, "minor": m.reach / m.ratio, "sill": m.sill, "nugget": m.nugget, "shape": m.shape}
                    else:
                        out |= {"engine": engine, "variogram": "matern52", "angle": m.angle, "ratio": m.lengths[0] / m.lengths[1], "major": m.lengths[0], "minor": m.lengths[1], "sill": m.signal, "nugget": m.noise}
                yield pd.DataFrame([out])

    return search_models(points, engine, trials, most_ratio, splits=splits, bounds=bounds).mapInPandas(describe, MODEL)


#: Points of all models that are sent to every worker at most, 24 bytes each.
MOST_POINTS = 1_000_000
PREDICTED = "layer int, pixel int, w double, std double, angle double, ratio double"


def predict_layers(models: DataFrame, pixels: DataFrame) -> DataFrame:
    """(layer, pixel, w, std, angle, ratio) of all pixels, each from all points of its layer. The fitted models are one broadcast value that
    workers read, of MOST_POINTS points at most; for more, `predict_near` deals points and pixels out by cell."""
    many = models.agg(F.sum(F.size("sx"))).first()[0] or 0
    if many > MOST_POINTS:
        raise ValueError(f"models of {many} points: predict_near takes them by cell")
    sent = pixels.sparkSession.sparkContext.broadcast([r.asDict() for r in models.orderBy("layer").collect()])

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = [(m, _refitted(m)) for m in sent.value]
        for pdf in batches:
            at = pdf[["x", "y"]].to_numpy() / 1000
            for m, model in fitted:
                mean, std = model.predict(at) if model else (np.zeros(len(at)), np.zeros(len(at)))
                yield pd.DataFrame({"layer": m["layer"], "pixel": pdf["pixel"], "w": mean, "std": std, "angle": m["angle"], "ratio": m["ratio"]})

    return pixels.select("pixel", "x", "y").mapInPandas(predict, PREDICTED)


def predict_near(models: DataFrame, pixels: DataFrame, cell: float, least: int = 50) -> DataFrame:
    """As predict_layers, each pixel from the points of the cells around it (side `cell` in metres): those of the nine cells around its own,
    or of cells twice as wide until they hold `least` points or all of them. A group is a layer's pixels of one cell; points go
    to it by an equi-join on cells. Where the nine cells hold all points the result is that of all points."""
    half = cell / 1000
    point = F.explode(F.arrays_zip("sx", "sy", "sv")).alias("p")
    points = models.where("engine is not null").select("layer", point).select("layer", F.col("p.sx").alias("px"), F.col("p.sy").alias("py"), F.col("p.sv").alias("pv"))
    box = points.agg(F.max(F.greatest(F.abs("px"), F.abs("py")))).first()[0] or half
    levels = max(1, int(np.ceil(np.log2(max(2.0, 2 * box / half)))) + 1)
    at_level = lambda v: F.floor(F.col(v) / (half * F.pow(F.lit(2.0), F.col("level")))).cast("long")
    every = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    held = points.select("*", every).withColumns({"cx": at_level("px"), "cy": at_level("py")})
    spread = held.withColumn("o", around).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o")
    counts = spread.groupBy("layer", "level", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    km = pixels.select("pixel", (F.col("x") / 1000).alias("px"), (F.col("y") / 1000).alias("py"))
    own = {"hx": F.floor(F.col("px") / half).cast("long"), "hy": F.floor(F.col("py") / half).cast("long")}
    homes = km.withColumns(own).select("hx", "hy").distinct().select("hx", "hy", every)
    up = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    layers = models.select("layer", "engine", "variogram", "angle", "ratio", "major", "minor", "sill", "nugget", "shape", F.size("sx").alias("all"), F.expr("aggregate(sx, 0D, (a, v) -> a + v) / size(sx)").alias("mx"), F.expr("aggregate(sy, 0D, (a, v) -> a + v) / size(sy)").alias("my"), F.expr("aggregate(sv, 0D, (a, v) -> a + v) / size(sv)").alias("mv"), F.expr("sqrt(aggregate(sv, 0D, (a, v) -> a + v * v) / size(sv) - pow(aggregate(sv, 0D, (a, v) -> a + v) / size(sv), 2))").alias("sd"))
    reach = homes.withColumns({"cx": up("hx"), "cy": up("hy")}).join(counts, ["level", "cx", "cy"]).join(F.broadcast(layers.select("layer", "all")), "layer")
    chosen = reach.where((F.col("n") >= least) | (F.col("n") >= F.col("all"))).groupBy("layer", "hx", "hy").agg(F.min("level").alias("level")).withColumns({"cx": up("hx"), "cy": up("hy")})
    given = chosen.join(spread, ["layer", "level", "cx", "cy"]).select("layer", "hx", "hy", "px", "py", "pv")
    names = F.explode(F.array(*[F.lit(r["layer"]) for r in models.select("layer").collect()])).alias("layer")
    asked = km.withColumns(own).select("*", names).join(F.broadcast(layers), "layer")  # a row for each layer

    def predict(key: tuple, wanted: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return pd.DataFrame({c.split()[0]: [] for c in PREDICTED.split(", ")})
        m, at = wanted.iloc[0], wanted[["px", "py"]].to_numpy()
        mean, std = np.zeros(len(at)), np.zeros(len(at))
        if m["engine"] is not None:
            found = found.sort_values(["px", "py", "pv"])
            model = {**m.to_dict(), "sx": found["px"], "sy": found["py"], "sv": found["pv"], "scaling": (m["mx"], m["my"], m["mv"], m["sd"])}
            mean, std = _refitted(model).predict(at)
        return pd.DataFrame({"layer": int(m["layer"]), "pixel": wanted["pixel"], "w": mean, "std": std, "angle": m["angle"], "ratio": m["ratio"]})

    return asked.groupBy("layer", "hx", "hy").cogroup(given.groupBy("layer", "hx", "hy")).applyInPandas(predict, PREDICTED)


def _refitted(m: dict) -> fields.Field | fields.Kriging | None:
    x, y = np.column_stack([m["sx"], m["sy"]]), np.array(m["sv"])
    if m["engine"] is None:
        return None
    if m["engine"] == "kriging":
        return fields.Kriging(x, y, m["variogram"], m["sill"], m["major"], m["nugget"], m["shape"], m["angle"], m["ratio"])
    return fields.Field(x, y, m["angle"], (m["major"], m["minor"]), m["sill"], m["nugget"], scaling=m.get("scaling"))


def interpolate(points: DataFrame, pixels: DataFrame, engine: str = "gp", trials: int | None = None, most_ratio: float = 10.0) -> DataFrame:
    """(layer, pixel, w, std, angle, ratio): a model for each layer, fitted once, predicted at the pixels of every partition."""
    return predict_layers(cut(fit_layers(points, engine, trials, most_ratio)), pixels)


def pixel_surface(pixels: DataFrame, stations: DataFrame, insar: DataFrame) -> DataFrame:
    """(pixel, epoch, d): the surface of each pixel's nearest station that has one, of stations as near the one of the smallest number."""
    near = spatial.nearest(pixels, stations.join(insar, "station", "left_semi"), "pixel", "station")
    return near.join(insar, "station").select("pixel", "epoch", "d")


def grid_product(weights_: DataFrame, insar_grid: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(pixel, epoch, d, residual, residual_std, low_confidence): layers are summed before the join with time. Pixels with a layer of a spread
    above the threshold have low confidence."""
    safe = weights.normalise(weights_, "pixel")
    spread = safe.groupBy("pixel").agg(F.sqrt(F.sum(F.col("std") * F.col("std"))).alias("s"), F.max("std").alias("top"))
    deep = weights.deep_residual(safe, insar_grid, "pixel")
    return deep.join(spread, "pixel").select("pixel", "epoch", "d", "residual", (F.col("s") * F.abs("d")).alias("residual_std"), F.coalesce(F.col("top") > threshold, F.lit(False)).alias("low_confidence"))


def _window(df: DataFrame, value: str, keys: list[str], start: int, end: int) -> DataFrame:
    """A cumulative series of the months start to end, from 0 before start; epochs count from start."""
    before = df.where(F.col("epoch") == start - 1).select(*keys, F.col(value).alias("_before"))
    cut = df.where(F.col("epoch").between(start, end)).join(before, keys, "left")
    return cut.withColumn(value, F.col(value) - F.coalesce("_before", F.lit(0.0))).withColumn("epoch", (F.col("epoch") - start).cast("int")).drop("_before")


def run(config: RunConfig, spark: SparkSession, model: DataFrame, insar: DataFrame, stations: DataFrame, n_epochs: int, pixels: DataFrame | None = None, store: Stages | None = None, surface: DataFrame | None = None) -> dict[str, DataFrame]:
    """The orchestrated run over the months of the settings: tuning unless smoothing is preset, inversion, validation, gridding, the
    product and, if both validations are asked for, its total spread; tables by name, their epochs count from month_start. pixels (pixel, x, y):
    the bound raster if there are none. surface (pixel, epoch, d): cumulative series of the pixels, those of their nearest stations if there are none.

    Each stage is a stored table in the `store` (one of this run's own in the shared folder if none is given), under a key of the settings it
    looks at and of what it is made from: what is there is taken, and a changed setting makes only what depends on it. Solver cvxpy couples
    stations within 15 km. Leaving a station out reuses the others' solutions, which is exact but for cvxpy.
    """
    store = store or Stages(spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}")
    start, end = config.months
    end = n_epochs - 1 if end is None else min(end, n_epochs - 1)
    n = end - start + 1
    out: dict[str, DataFrame] = {}
    keys: dict[str, str] = {"model_": fingerprint(model), "insar_": fingerprint(insar), "stations_": fingerprint(stations)}
    pixels = grid_pixels(spark) if pixels is None else pixels
    keys["pixels_"] = fingerprint(pixels)
    keys["surface_"] = fingerprint(surface) if surface is not None else ""

    def stage(name: str, settings: dict, inputs: Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
        out[name], keys[name] = store.stage(name, settings, [keys[k] for k in inputs], make)
        return out[name]

    months = {"start": start, "end": end}
    model, insar = _window(model, "m", ["station", "layer"], start, end), _window(insar, "d", ["station"], start, end)
    rows = station_rows(model, insar)
    lam, lam_t = config.smoothing
    solver, sigma = config.solver, config.sigma
    data = ("model_", "insar_")
    if lam is None or lam_t is None:
        last = series.folds(n)[-1]
        lams, lams_t = config["Tuning", "lam_candidates"] or LAM, config["Tuning", "lam_t_candidates"] or LAM_T
        score = "independent" if solver == "independent" else "joint"
        trials = stage("trials", {**months, "lam": lams, "lam_t": lams_t, "solver": score, "sigma": sigma}, data, lambda: grid_search(rows, last[1], last[3], lams, lams_t, score, sigma))
        best = metrics.best(trials).first()
        lam, lam_t = best["lam"], best["lam_t"]
    smoothing = {**months, "solver": solver, "sigma": sigma, "lam": lam, "lam_t": lam_t}
    if solver == "cvxpy":
        edges = cut(system.neighbours(stations, 15000.0))
        solved = lambda r: invert_coupled(r, edges, lam, lam_t, sigma=sigma)
    else:
        solved = lambda r: invert(r, solver, lam, lam_t, sigma)
    solved_from = (*data, "stations_") if solver == "cvxpy" else data
    stage("model", smoothing, solved_from, lambda: solved(rows))
    stage("weights", months, ("model", "insar_"), lambda: weights.depth_weights(weights.totals(out["model"], insar)))

    def forward() -> DataFrame:
        if solver == "joint":
            return forward_validation(rows, series.fold_table(spark, n), lam, lam_t, sigma)
        parts = []
        for fold, last_train, first, last in series.folds(n):
            seen = F.col("epoch") <= last_train
            w = weights.depth_weights(weights.totals(solved(rows.where(seen)), insar.where(seen)))
            pred = weights.predict(w, insar.where(F.col("epoch").between(first, last)))
            parts.append(pred.join(model.withColumnRenamed("m", "truth"), ["station", "layer", "epoch"]).select(F.lit(fold).alias("fold"), "station", "epoch", "layer", "pred", "truth"))
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    points = out["weights"].join(stations, "station").select("layer", "station", "x", "y", F.col("w").alias("v"))
    if config["CV", "run_temporal_cv"]:
        stage("forward", smoothing, solved_from, forward)
    if config["CV", "run_spatial_cv"]:
        stage("loso", config.engine, ("weights", "stations_"), lambda: leave_one_out(points, **config.engine))
    stage("models", config.engine, ("weights", "stations_"), lambda: fit_layers(points, **config.engine))
    stage("grid", {}, ("models", "pixels_"), lambda: predict_layers(out["models"], pixels))
    surface = pixel_surface(pixels, stations, insar) if surface is None else _window(surface, "d", ["pixel"], start, end)
    threshold = config["GP", "std_threshold"]
    stage("product", {**months, "threshold": threshold}, ("grid", "pixels_", "stations_", "insar_", "surface_"), lambda: grid_product(out["grid"], surface, threshold))

    def total() -> DataFrame:
        spread = series.spread_folds(metrics.errors(out["forward"], ["fold", "layer"]).select("fold", "layer", "rmse"), series.fold_table(spark, n), n)
        sigma_t = spread.select("epoch", "layer", F.col("rmse").alias("sigma_t"))
        pred = weights.predict(weights.normalise(out["grid"], "pixel"), surface, "pixel")
        return weights.total_std(pred, metrics.errors(out["loso"], ["layer"]).select("layer", "rmse"), sigma_t).select("pixel", "layer", "epoch", "pred", "total_std")

    if config["CV", "run_temporal_cv"] and config["CV", "run_spatial_cv"]:
        stage("total_std", months, ("grid", "pixels_", "stations_", "insar_", "surface_", "forward", "loso"), total)
    return out
