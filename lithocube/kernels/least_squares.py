"""Non-negative least squares on dense Hessians, and the structure of the space-time inversion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def bounded_minimum(hessian: np.ndarray, gradient: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """min x'Hx/2 - g'x over x >= 0 for H positive definite, and the largest violation of the optimality conditions."""

    def solve(free: np.ndarray) -> np.ndarray:
        x = np.zeros(len(gradient))
        if free.any():
            x[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        return x

    return pivoted(solve, lambda x: hessian @ x, gradient, rounds)


def pivoted(solve: Callable[[np.ndarray], np.ndarray], times: Callable[[np.ndarray], np.ndarray], gradient: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """As `bounded_minimum`. solve: the minimum over the free indices, the others 0; times: H x.

    Block pivoting: all indices on the wrong side change sets at once; when that stops to help, only the last of them does, which
    always ends.
    """
    n = len(gradient)
    free = np.ones(n, bool)
    best, patience = n + 1, 3
    x = np.zeros(n)
    for _ in range(rounds + 3 * n):
        x = solve(free)
        wrong = np.where(free, x < -1e-12, times(x) - gradient < -1e-10)
        count = int(wrong.sum())
        if not count:
            break
        if count < best:
            best, patience = count, 3
        elif patience:
            patience -= 1
        else:
            wrong[: np.flatnonzero(wrong)[-1]] = False
        free = free ^ wrong
    x = np.maximum(x, 0.0)
    slope = times(x) - gradient
    return x, float(max(np.abs(slope[x > 0]).max(initial=0.0), np.maximum(-slope, 0).max(initial=0.0)))


def banded_solver(layer: np.ndarray, epochs: int, lam_t: float, right: np.ndarray) -> tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """(solve, times) of the space-time Hessian, whose blocks of layers couple neighbouring epochs by -lam_t I only: elimination epoch by
    epoch, in epochs x layers^3 steps. Indices that aren't free are taken out by rows and columns of the identity."""
    n = len(layer)
    degree = np.full(epochs, 2.0 if epochs > 1 else 0.0)
    degree[[0, -1]] = 1.0 if epochs > 1 else 0.0

    def solve(free: np.ndarray) -> np.ndarray:
        f = free.reshape(epochs, n)
        g = np.where(f, right, 0.0)
        backs, values = np.empty((epochs, n, n)), np.empty((epochs, n))
        for t in range(epochs):
            block = np.where(np.outer(f[t], f[t]), layer, 0.0)
            block[np.arange(n), np.arange(n)] = np.where(f[t], np.diag(layer) + lam_t * degree[t], 1.0)
            b = g[t]
            if t:
                link = lam_t * (f[t] & f[t - 1])  # the block below the diagonal is -diag(link)
                block -= link[:, None] * backs[t - 1]
                b = b + link * values[t - 1]
            ahead = lam_t * (f[t] & f[t + 1]) if t + 1 < epochs else np.zeros(n)
            both = np.linalg.solve(block, np.concatenate([np.diag(ahead), b[:, None]], axis=1))
            backs[t], values[t] = both[:, :n], both[:, n]
        x = np.empty((epochs, n))
        x[-1] = values[-1]
        for t in range(epochs - 2, -1, -1):
            x[t] = values[t] + backs[t] @ x[t + 1]
        return np.where(f, x, 0.0).ravel()

    def times(x: np.ndarray) -> np.ndarray:
        m = x.reshape(epochs, n)
        out = m @ layer
        step = lam_t * np.diff(m, axis=0)
        out[:-1] -= step
        out[1:] += step
        return out.ravel()

    return solve, times


def first_difference(n: int) -> np.ndarray:
    return np.eye(n - 1, n) - np.eye(n - 1, n, 1) if n > 1 else np.zeros((0, n))


def layer_matrix(layers: int, lam: float, dz: float, well: np.ndarray | float = 1.0, surface: float = 1.0) -> np.ndarray:
    """Hessian of one epoch's layers: surface sum, wells, vertical smoothness."""
    d = first_difference(layers)
    return surface * dz * dz * np.ones((layers, layers)) + np.diag(np.broadcast_to(well, layers)) + lam * d.T @ d


def station_hessian(epochs: int, layers: int, lam: float, lam_t: float, dz: float = 1.0) -> np.ndarray:
    """I_T x (dz^2 11' + I + lam L'L) + lam_t D'D x I_L, epochs outside."""
    d = first_difference(epochs)
    return np.kron(np.eye(epochs), layer_matrix(layers, lam, dz)) + lam_t * np.kron(d.T @ d, np.eye(layers))


def solve_joint(surface: np.ndarray, wells: np.ndarray, lam: float, lam_t: float, dz: float = 1.0, sigma: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """Compaction (T, L) of one station from its surface series (T) and its layers' series (T, L), m >= 0. sigma: spreads of surface and wells."""
    t, n = wells.shape
    ws, ww = 1 / sigma[0] ** 2, 1 / sigma[1] ** 2
    right = ws * dz * surface[:, None] + ww * wells
    layer, d = layer_matrix(n, lam, dz, ww, ws), first_difference(t)
    a, u = np.linalg.eigh(layer)
    b, v = np.linalg.eigh(d.T @ d)
    whole = v @ ((v.T @ right @ u) / (lam_t * b[:, None] + a[None, :])) @ u.T
    if whole.min() >= 0:  # no bound is met: two small eigendecompositions solve it
        return whole, float(np.abs(whole @ layer + lam_t * (d.T @ d) @ whole - right).max())
    x, off = pivoted(*banded_solver(layer, t, lam_t, right), right.ravel())
    return x.reshape(t, n), off


def solve_independent(surface: np.ndarray, wells: np.ndarray, lam: float, dz: float = 1.0, sigma: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """Each epoch by itself."""
    ws, ww = 1 / sigma[0] ** 2, 1 / sigma[1] ** 2
    h, right = layer_matrix(wells.shape[1], lam, dz, ww, ws), ws * dz * surface[:, None] + ww * wells
    m = np.linalg.solve(h, right.T).T
    off = float(np.abs(m @ h - right).max(initial=0.0))
    for t in np.flatnonzero(m.min(axis=1) < 0):  # in all other epochs no bound is met
        m[t], worst = bounded_minimum(h, right[t])
        off = max(off, worst)
    return m, off


def tikhonov(hessian: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """The unconstrained minimum; of several the shortest."""
    return np.linalg.lstsq(hessian, gradient, rcond=None)[0]


def posterior_std(epochs: int, layers: int, lam: float, lam_t: float, dz: float = 1.0) -> np.ndarray:
    """Exact square roots of diag(H^-1) by two small eigendecompositions: (T, L)."""
    a, u = np.linalg.eigh(layer_matrix(layers, lam, dz))
    d = first_difference(epochs)
    b, v = np.linalg.eigh(d.T @ d)
    return np.sqrt(np.einsum("ti,lj,ij->tl", v * v, u * u, 1 / (lam_t * b[:, None] + a[None, :])))


def capped_projection(x: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """The nearest points with entries >= 0 and sums along the last axis <= cap."""
    low = np.maximum(x, 0)
    order = -np.sort(-x, axis=-1)
    sums = np.cumsum(order, axis=-1) - cap[..., None]
    k = np.arange(1, x.shape[-1] + 1)
    rho = np.maximum((order - sums / k > 0).sum(axis=-1), 1)
    shift = np.take_along_axis(sums, rho[..., None] - 1, -1) / rho[..., None]
    return np.where((low.sum(axis=-1) > cap)[..., None], np.maximum(x - np.maximum(shift, 0), 0), low)


def solve_coupled(surface: np.ndarray, wells: np.ndarray, pairs: np.ndarray, weight: np.ndarray, lam: float, lam_t: float, sigma: tuple[float, float] = (1.0, 1.0), floor: float = 10.0, rounds: int = 400) -> tuple[np.ndarray, float, float]:
    """(T, S, L) with neighbours coupled by |L_s m|^2, sums of layers at most the surface, m >= 0; and the primal and dual residuals.

    ADMM: a linear system by conjugate gradients, then a projection for each epoch and station. Stations whose surface stays below
    `floor` have neither surface data nor a bound.
    """
    t, s, n = wells.shape
    live = np.abs(surface).max(axis=0) >= floor
    ws, ww = live / sigma[0] ** 2, 1 / sigma[1] ** 2
    cap = np.where(live[None, :], np.maximum(surface, 0), np.inf)

    def apply(m: np.ndarray, rho: float) -> np.ndarray:
        out = (ww + rho) * m + ws[None, :, None] * m.sum(axis=2, keepdims=True)
        if len(pairs):
            e = (weight**2)[None, :, None] * (m[:, pairs[:, 0]] - m[:, pairs[:, 1]])
            np.add.at(out, (slice(None), pairs[:, 0]), lam * e)
            np.add.at(out, (slice(None), pairs[:, 1]), -lam * e)
        d = np.diff(m, axis=0)
        out[:-1] -= lam_t * d
        out[1:] += lam_t * d
        return out

    data = ws[None, :, None] * surface[:, :, None] + ww * wells
    rho, z, u = 1.0 + lam_t, np.maximum(wells, 0), np.zeros_like(wells)
    x = z.copy()
    primal = dual = np.inf
    for _ in range(rounds):
        right = data + rho * (z - u)
        r = right - apply(x, rho)
        p, rr = r.copy(), float((r * r).sum())
        for _ in range(30):
            if rr < 1e-18 * (1 + float((right * right).sum())):
                break
            q = apply(p, rho)
            a = rr / float((p * q).sum())
            x, r = x + a * p, r - a * q
            new = float((r * r).sum())
            p, rr = r + new / rr * p, new
        before, z = z, capped_projection(x + u, cap)
        u = u + x - z
        primal, dual = float(np.abs(x - z).max()), float(rho * np.abs(z - before).max())
        if max(primal, dual) < 1e-6:
            break
    return z, primal, dual


class Station:
    """One station's part of the coupled problem: its data, its bound, and what it agrees on with its neighbours.

    Consensus by alternating directions: each edge has a copy of either end, pulled together by lam weight^2 / 2 |a - b|^2. A round takes the
    neighbours' proposals, sets the copies, which has a closed form, moves the prices, solves the station's own bounded problem with the copies as
    further data, and makes the next proposals. All a station knows of others are proposals along its edges.
    """

    def __init__(self, surface: np.ndarray, wells: np.ndarray, weight: np.ndarray, lam: float, lam_t: float, sigma: tuple[float, float] = (1.0, 1.0), floor: float = 10.0):
        t, n = wells.shape
        live = bool(np.abs(surface).max(initial=0.0) >= floor)
        self.ws, self.ww = live / sigma[0] ** 2, 1 / sigma[1] ** 2
        self.data = self.ws * surface[:, None] + self.ww * wells
        self.cap = np.maximum(surface, 0) if live else np.full(t, np.inf)
        self.pull = lam * weight**2
        self.rho = np.maximum(np.sqrt(self.pull * self.ww), 1e-12)  # between an edge's pull and the hold of the data
        self.inner = self.ww + lam_t + self.rho.sum()
        layer = (self.ww + self.rho.sum() + self.inner) * np.eye(n) + self.ws * np.ones((n, n))
        d = first_difference(t)
        a, self.u = np.linalg.eigh(layer)
        b, self.v = np.linalg.eigh(d.T @ d)
        self.scale = lam_t * b[:, None] + a[None, :]
        self.x, self.price = np.maximum(wells, 0), np.zeros((t, n))
        self.copies, self.prices = np.zeros((len(weight), t, n)), np.zeros((len(weight), t, n))

    def solve(self, tolerance: float = 1e-10, rounds: int = 2000) -> None:
        """The bounded problem with the copies as data, from where it stood: one linear system by two small eigendecompositions and a
        projection, in turn."""
        right = self.data + np.tensordot(self.rho, self.copies - self.prices, 1)
        for _ in range(rounds):
            m = self.v @ ((self.v.T @ (right + self.inner * (self.x - self.price)) @ self.u) / self.scale) @ self.u.T
            before, self.x = self.x, capped_projection(m + self.price, self.cap)
            self.price = self.price + m - self.x
            if max(np.abs(m - self.x).max(initial=0.0), self.inner * np.abs(self.x - before).max(initial=0.0)) < tolerance:
                return

    def proposals(self) -> np.ndarray:
        """What the station tells each neighbour."""
        return self.x[None] + self.prices

    def agree(self, theirs: np.ndarray) -> tuple[float, float]:
        """(primal, dual) residuals after the copies are set from the neighbours' proposals, one for each edge."""
        mine = self.proposals()
        share = (self.rho / (self.rho + 2 * self.pull))[:, None, None]
        copies = (mine + theirs) / 2 + share * (mine - theirs) / 2
        primal, dual = np.abs(self.x[None] - copies).max(initial=0.0), np.abs(copies - self.copies).max(initial=0.0)
        self.copies, self.prices = copies, mine - copies
        return float(primal), float(dual)
