"""Gaussian processes, ordinary kriging, k-means folds, a simplex search, and generators, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from ..functions.variograms import ARRAYS, SHAPED


def simplex_search(f: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Nelder-Mead within a box."""
    n = len(start)
    inside = lambda p: np.clip(p, low, high)
    points = [inside(start)] + [inside(start + step) for step in np.diag((high - low) * 0.1)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) < 1e-9 * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        trial = inside(centre + (centre - points[-1]))
        v = f(trial)
        if v < values[0]:
            far = inside(centre + 2 * (centre - points[-1]))
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (trial, v)
        elif v < values[-2]:
            points[-1], values[-1] = trial, v
        else:
            near = centre + 0.5 * (points[-1] - centre)
            w = f(near)
            if w < values[-1]:
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], values[k]


def turn(x: np.ndarray, degrees: float) -> np.ndarray:
    a = np.radians(degrees)
    return np.column_stack([x[:, 0] * np.cos(a) + x[:, 1] * np.sin(a), x[:, 1] * np.cos(a) - x[:, 0] * np.sin(a)])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def matern52(r: np.ndarray) -> np.ndarray:
    q = np.sqrt(5.0) * r
    return (1 + q + q * q / 3) * np.exp(-q)


@dataclass
class Field:
    """A fitted Gaussian process: angle, the lengths along and across it, signal and noise variance (of normalised values)."""

    x: np.ndarray
    y: np.ndarray
    angle: float
    lengths: tuple[float, float]
    signal: float
    noise: float
    score: float = 0.0
    scaling: tuple[float, float, float, float] | None = None  # centre (x, y), mean and spread, if not those of the points

    def __post_init__(self) -> None:
        cx, cy, mean, spread = self.scaling or (*self.x.mean(axis=0), self.y.mean(), self.y.std())
        self.centre, self.mean, self.spread = np.array([cx, cy]), float(mean), float(spread) or 1.0
        self.placed = self._place(self.x)
        z, n, least = (self.y - self.mean) / self.spread, len(self.x), self.noise + 1e-10
        k = np.empty((n + 1, n + 1))
        k[:n, :n] = self.signal * matern52(distances(self.placed, self.placed))
        k[np.arange(n), np.arange(n)] += least
        k[n, :n] = k[:n, n] = z
        k[n, n] = 1 + z @ z / least
        whole = np.linalg.cholesky(k)  # the last row is root^-1 z, so a score needs no other solution
        self.root, self.half = whole[:n, :n], whole[n, :n]
        self.score = float(0.5 * self.half @ self.half + np.log(np.diag(self.root)).sum())

    @cached_property
    def weights(self) -> np.ndarray:
        return np.linalg.solve(self.root.T, self.half)

    def _place(self, x: np.ndarray) -> np.ndarray:
        return turn(x - self.centre, self.angle) / np.array(self.lengths)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and spread, the noise included."""
        c = self.signal * matern52(distances(self._place(x), self.placed))
        half = np.linalg.solve(self.root, c.T)
        var = self.signal + self.noise - (half * half).sum(axis=0)
        return self.mean + self.spread * (c @ self.weights), self.spread * np.sqrt(np.maximum(var, 0))


class FieldSearch:
    """Trials of a Gaussian process by marginal likelihood: rows of log length, log signal, log noise and, if rotated, log ratio and angle."""

    refined, last = None, 200  # every sector of angles is refined, the best of them to the end

    def __init__(self, x: np.ndarray, y: np.ndarray, rotated: bool, most_ratio: float = 10.0, trials: int = 60, seed: int = 42, bounds: Mapping[str, float | None] | None = None):
        """bounds: length_scale, noise_level (where the search begins), each with _min and _max, angle_min and angle_max; what is missing or None
        comes from the extent of the points."""
        self.x, self.y, self.rotated, self.rounds = x, y, rotated, 40 if rotated else 0
        span = float(np.ptp(x, axis=0).max()) or 1.0
        of = lambda name, default: default if (bounds or {}).get(name) is None else bounds[name]
        angles = (of("angle_min", 0.0), of("angle_max", 180.0))
        logs = lambda length, signal, noise, ratio: np.log([length, signal, noise] + ([ratio] if rotated else []))
        last = lambda p, angle: np.r_[p, angle] if rotated else p
        self.low = last(logs(of("length_scale_min", span * 0.01), 1e-2, of("noise_level_min", 1e-8), 1.0), angles[0])
        self.high = last(logs(of("length_scale_max", span * 4), 1e2, of("noise_level_max", 1.0), most_ratio), angles[1])
        start = np.clip(last(logs(of("length_scale", span * 0.2), 1.0, of("noise_level", 1e-2), 1.5), 0.0), self.low, self.high)
        self.dx, self.dy = (x[:, k, None] - x[None, :, k] for k in (0, 1))
        self.r = np.sqrt(self.dx * self.dx + self.dy * self.dy)
        self.z = (y - y.mean()) / (float(y.std()) or 1.0)
        self.trials = np.vstack([start, self.low + (self.high - self.low) * np.random.default_rng(seed).random((trials, len(start)))])

    def made(self, p: np.ndarray) -> Field:
        length, signal, noise = np.exp(p[:3])
        return Field(self.x, self.y, float(p[4]) if self.rotated else 0.0, (length, length / np.exp(p[3]) if self.rotated else length), signal, noise)

    def cost(self, p: np.ndarray) -> float:
        """`Field.score` of these parameters, from differences of coordinates that are made once."""
        length, signal, noise = np.exp(p[:3])
        if self.rotated:
            a = np.radians(p[4])
            u, v = (self.dx * np.cos(a) + self.dy * np.sin(a)) / length, (self.dy * np.cos(a) - self.dx * np.sin(a)) * (np.exp(p[3]) / length)
            r = np.sqrt(u * u + v * v)
        else:
            r = self.r / length
        n, least = len(self.z), noise + 1e-10
        k = np.empty((n + 1, n + 1))
        k[:n, :n] = signal * matern52(r)
        k[np.arange(n), np.arange(n)] += least
        k[n, :n] = k[:n, n] = self.z
        k[n, n] = 1 + self.z @ self.z / least
        try:
            whole = np.linalg.cholesky(k)
        except np.linalg.LinAlgError:
            return np.inf
        half = whole[n, :n]
        return float(0.5 * half @ half + np.log(np.diag(whole)[:n]).sum())

    def scores(self, part: slice) -> np.ndarray:
        return np.array([self.cost(p) for p in self.trials[part]])

    def sectors(self, part: slice) -> np.ndarray:
        return (self.trials[part, 4] // 45).astype(int) if self.rotated else np.zeros(len(self.trials[part]), int)

    def refine(self, p: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        return simplex_search(self.cost, p, self.low, self.high, rounds) if rounds else (p, self.cost(p))


def searched(search: FieldSearch | KrigingSearch) -> np.ndarray:
    """The whole search in one place: the best trial of each sector of angles is refined a little, the best of these to the end."""
    scores, sector = search.scores(slice(None)), search.sectors(slice(None))
    starts = {int(c): int(np.flatnonzero(sector == c)[scores[sector == c].argmin()]) for c in np.unique(sector)}
    chosen = sorted(starts.values(), key=lambda k: (scores[k], k))[: search.refined]
    ends = [(scores[k], 0, j, search.trials[k]) for j, k in enumerate(chosen[:1])] + [(v, 1, j, p) for j, k in enumerate(chosen) for p, v in [search.refine(search.trials[k], search.rounds)]]
    best = min(ends, key=lambda e: e[:3])[3]
    return search.refine(best, search.last)[0] if search.last else best


def fit_field(x: np.ndarray, y: np.ndarray, rotated: bool = False, most_ratio: float = 10.0, trials: int = 60, seed: int = 42) -> Field:
    """By marginal likelihood: a seeded random search, then a simplex from the best. rotated: angle and two lengths are searched too."""
    search = FieldSearch(x, y, rotated, most_ratio, trials, seed)
    return search.made(searched(search))


@dataclass
class Kriging:
    """Ordinary kriging with a named variogram, an angle and a ratio of scales across it."""

    x: np.ndarray
    y: np.ndarray
    model: str
    sill: float
    reach: float
    nugget: float
    shape: float = 1.0
    angle: float = 0.0
    ratio: float = 1.0

    def __post_init__(self) -> None:
        n = len(self.x)
        self.placed = self._place(self.x)
        a = np.ones((n + 1, n + 1))
        a[:n, :n] = self._gamma(distances(self.placed, self.placed))
        np.fill_diagonal(a, 0.0)
        self.inverse = np.linalg.inv(a + 1e-12 * np.eye(n + 1))

    def _place(self, x: np.ndarray) -> np.ndarray:
        return turn(x, self.angle) * np.array([1.0, self.ratio])

    def _gamma(self, h: np.ndarray) -> np.ndarray:
        return np.where(h < 1e-9, 0.0, ARRAYS[self.model](np.maximum(h, 1e-12), self.sill, self.reach, self.nugget, self.shape))

    def predict(self, x: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        mean, std = np.empty(len(x)), np.empty(len(x))
        for k in range(0, len(x), block):
            g = np.ones((len(self.x) + 1, len(x[k : k + block])))
            g[:-1] = self._gamma(distances(self.placed, self._place(x[k : k + block])))
            w = self.inverse @ g
            mean[k : k + block] = w[:-1].T @ self.y
            std[k : k + block] = np.sqrt(np.abs((w * g).sum(axis=0)))
        return mean, std


def spatial_folds(x: np.ndarray, k: int, seed: int = 42, starts: int = 10) -> np.ndarray:
    """k-means clusters, the best of several seeded starts."""
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), int))
    for _ in range(starts):
        centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(50):
            of = distances(x, centre).argmin(axis=1)
            moved = np.array([x[of == c].mean(axis=0) if (of == c).any() else centre[c] for c in range(len(centre))])
            if np.allclose(moved, centre):
                break
            centre = moved
        cost = float((distances(x, centre).min(axis=1) ** 2).sum())
        if cost < best[0]:
            best = (cost, of)
    return best[1]


def cross_validate(x: np.ndarray, y: np.ndarray, folds: np.ndarray, fit: Callable[[np.ndarray, np.ndarray], object], least: int = 5) -> np.ndarray:
    """(prediction, spread) of each point by the fit without its fold; folds with too little left stay NaN."""
    out = np.full((len(x), 2), np.nan)
    for f in np.unique(folds):
        train = folds != f
        if train.sum() >= least:
            try:
                out[~train] = np.column_stack(fit(x[train], y[train]).predict(x[~train]))
            except np.linalg.LinAlgError:
                continue
    return out


def kriging_trials(x: np.ndarray, y: np.ndarray, n: int, most_ratio: float = 10.0, seed: int = 42) -> list[dict]:
    """Seeded candidates: nine models, and parameters in the search's ranges."""
    rng, var = np.random.default_rng(seed), float(y.var()) or 1.0
    span = float(np.ptp(x, axis=0).max()) or 1.0
    names = [m for m in ARRAYS if m != "practical-gaussian"]
    return [
        {"model": names[int(rng.integers(len(names)))], "sill": var * rng.uniform(0.05, 3), "reach": span * rng.uniform(0.02, 1.5), "nugget": var * rng.uniform(0, 0.8), "shape": rng.uniform(0.1, 2.0), "angle": rng.uniform(0, 180), "ratio": rng.uniform(1, most_ratio)}
        for _ in range(n)
    ]


def kriging_score(x: np.ndarray, y: np.ndarray, folds: np.ndarray, trial: dict, least: int = 5) -> float:
    """Mean square error of each fold by kriging without it. All folds come from one inverse: with B the inverse of the bordered
    matrix of all points, a fold's errors are B_ff^-1 (B y)_f."""
    shape = trial["shape"] if trial["model"] in SHAPED else 1.0
    errors = []
    try:
        b = Kriging(x, y, **{**trial, "shape": shape}).inverse
        by = b[:, :-1] @ y
        for f in np.unique(folds):
            held = np.flatnonzero(folds == f)
            if len(x) - len(held) >= least:
                errors.append(np.linalg.solve(b[np.ix_(held, held)], by[held]))
    except np.linalg.LinAlgError:
        return np.inf
    score = float(np.mean(np.concatenate(errors) ** 2)) if errors else np.inf
    return score if np.isfinite(score) else np.inf


class KrigingSearch:
    """Trials of ordinary kriging by the error of spatial folds: rows of the model's number, sill, reach, nugget, shape, angle and ratio."""

    names = ("sill", "reach", "nugget", "shape", "angle", "ratio")
    refined, rounds, last = 4, 20, 0  # the best trials of four sectors of angles

    def __init__(self, x: np.ndarray, y: np.ndarray, most_ratio: float = 10.0, trials: int = 50, splits: int = 5):
        self.x, self.y, self.folds = x, y, spatial_folds(x, splits)
        var, span = float(y.var()) or 1.0, float(np.ptp(x, axis=0).max()) or 1.0
        self.low = np.array([0.05 * var, 0.02 * span, 0.0, 0.1, -90.0, 1.0])
        self.high = np.array([3 * var, 1.5 * span, 0.8 * var, 2.0, 270.0, max(most_ratio, 1.0 + 1e-9)])
        models = list(ARRAYS)
        self.trials = np.array([[models.index(t["model"]), *(t[n] for n in self.names)] for t in kriging_trials(x, y, trials, most_ratio)])

    def trial(self, p: np.ndarray) -> dict:
        return {"model": list(ARRAYS)[int(p[0])], **dict(zip(self.names, p[1:].tolist(), strict=True))}

    def cost(self, p: np.ndarray) -> float:
        return kriging_score(self.x, self.y, self.folds, self.trial(p))

    def scores(self, part: slice) -> np.ndarray:
        return np.array([self.cost(p) for p in self.trials[part]])

    def sectors(self, part: slice) -> np.ndarray:
        return (self.trials[part, 5] // 45).astype(int)

    def refine(self, p: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        if not rounds:
            return p, self.cost(p)
        end, score = simplex_search(lambda q: self.cost(np.r_[p[0], q]), p[1:], self.low, self.high, rounds)
        end[4] %= 180
        return np.r_[p[0], end], score

    def made(self, p: np.ndarray) -> Kriging:
        t = self.trial(p)
        return Kriging(self.x, self.y, **{**t, "shape": t["shape"] if t["model"] in SHAPED else 1.0})
