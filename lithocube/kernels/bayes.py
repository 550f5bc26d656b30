"""Linear Gaussian inversion of voxels in the space of their observations."""

from __future__ import annotations

import numpy as np


class Observed:
    """How observations see voxels: a sum for each column of layers, then each voxel of `wells`.

    at: voxel coordinates (row, column, layer); column: the number of the column of layers that each voxel is in, or -1. Prior covariance
    sigma^2 exp(-r / length), or exp(-r) of coordinates scaled by length and length_z. Observations see covariances as sums over columns
    and as picked voxels: rows of voxels x observations are made block by block, voxels x voxels never.
    """

    def __init__(self, at: np.ndarray, column: np.ndarray, wells: np.ndarray, sigma: float, length: float, length_z: float | None = None):
        self.scale, self.sigma, self.wells, self.column = np.array([length, length, length_z or length]), sigma, wells, column
        self.place = at / self.scale
        self.columns = int(column.max(initial=-1)) + 1
        order = np.argsort(column, kind="stable")
        self.order = order[column[order] >= 0]
        self.starts = np.searchsorted(column[self.order], np.arange(self.columns))

    def seen(self, values: np.ndarray) -> np.ndarray:
        """What the observations see of values (n, voxels): (n, observations)."""
        sums = np.add.reduceat(values[:, self.order], self.starts, axis=1) if self.columns else np.zeros((len(values), 0))
        return np.concatenate([sums, values[:, self.wells]], axis=1)

    def cross(self, at: np.ndarray) -> np.ndarray:
        """Covariances of voxels at these coordinates with the observations."""
        a = at / self.scale
        square = (a * a).sum(1)[:, None] + (self.place * self.place).sum(1)[None, :] - 2 * a @ self.place.T
        return self.seen(self.sigma**2 * np.exp(-np.sqrt(np.maximum(square, 0))))

    def covered(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(observations, their covariances with all): of those that see only the voxels k, whole columns."""
        rows = self.cross(self.place[k] * self.scale)
        of = self.column[k]
        names = np.unique(of[of >= 0])
        sums = [rows[of == c].sum(axis=0) for c in names]
        picked = [(self.columns + j, rows[np.flatnonzero(k == v)[0]]) for j, v in enumerate(self.wells.tolist()) if v in set(k.tolist())]
        return np.array([*names, *(j for j, _ in picked)], int), np.array([*sums, *(r for _, r in picked)]).reshape(-1, self.columns + len(self.wells))

    def variance(self, cross: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Posterior variance of voxels with these covariances; root: the Cholesky factor of what observations make of each other."""
        half = np.linalg.solve(root, cross.T)
        return np.maximum(self.sigma**2 - (half * half).sum(axis=0), 0)


def posterior(at: np.ndarray, data: np.ndarray, column: np.ndarray, wells: np.ndarray, noise: np.ndarray, prior: np.ndarray, sigma: float, length: float, length_z: float | None = None, block: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of every voxel in one place. data: a sum for each column, then a value for each voxel of `wells`."""
    model = Observed(at, column, wells, sigma, length, length_z)
    cross = np.concatenate([model.cross(at[k : k + block]) for k in range(0, len(at), block)])
    gain = model.seen(cross.T) + np.diag(noise)
    root = np.linalg.cholesky(gain)
    step = np.linalg.solve(gain, data - model.seen(prior[None])[0])
    var = np.concatenate([model.variance(cross[k : k + block], root) for k in range(0, len(at), block)])
    return prior + cross @ step, var
