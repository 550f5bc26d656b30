"""Worlds and fields that tests compare with: made up, and no part of the library."""

from __future__ import annotations

import numpy as np


def smooth(a: np.ndarray, sigmas: tuple[float, ...]) -> np.ndarray:
    """A Gaussian filter with mirrored edges along each axis."""
    for axis, sigma in enumerate(sigmas):
        reach = int(4 * sigma + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        padded = np.pad(a, [(reach, reach) if k == axis else (0, 0) for k in range(a.ndim)], mode="symmetric")
        a = np.apply_along_axis(lambda v: np.convolve(v, kernel / kernel.sum(), "valid"), axis, padded)  # noqa: B023
    return a


def layered_field(rng: np.random.Generator, side: int, layers: int, mean: float, spread: float) -> np.ndarray:
    """(pixels, layers): smoothed noise, scaled to a mean and a spread, no value below 0."""
    field = smooth(rng.standard_normal((side, side, layers)), (2.0, 2.0, 0.5))
    return np.clip(mean + spread * field / field.std(), 0, None).reshape(-1, layers)


def observed(rng: np.random.Generator, truth: np.ndarray, wells: tuple[int, ...], sigma: tuple[float, float], dz: float) -> tuple[np.ndarray, np.ndarray]:
    """(surface, wells) that a world (..., pixels, layers) shows, with noise of each kind's spread."""
    surface, seen = dz * truth.sum(axis=-1), truth[..., list(wells), :]
    return surface + rng.normal(0, sigma[0], surface.shape) if sigma[0] else surface, seen + rng.normal(0, sigma[1], seen.shape) if sigma[1] else seen


#: The toy world's pixels with a well, and the spreads of surface and well noise.
WELLS, NOISE = (11, 33, 55, 77, 89), (0.5, 0.1)


def static_world(side: int = 10, layers: int = 5, wells: tuple[int, ...] = WELLS, sigma: tuple[float, float] = NOISE, dz: float = 1.0, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(truth (pixels, layers), surface, wells (n, layers)): a mean of 5 and a spread of 3."""
    rng = np.random.default_rng(seed)
    truth = layered_field(rng, side, layers, 5.0, 3.0)
    return truth, *observed(rng, truth, wells, sigma, dz)


def timed_world(side: int = 10, layers: int = 5, epochs: int = 12, wells: tuple[int, ...] = WELLS, sigma: tuple[float, float] = NOISE, dz: float = 1.0, drift: float = 0.05, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(truth (epochs, pixels, layers), surface (epochs, pixels), wells (epochs, n, layers)): a field of mean 1 and spread 1 that grows
    along a logistic curve from a tenth to all of it, with drift, never shrinking."""
    rng = np.random.default_rng(seed)
    base = layered_field(rng, side, layers, 1.0, 1.0)
    curve = 1 / (1 + np.exp(-np.linspace(-3, 3, epochs)))
    share = np.interp(curve, (curve[0], curve[-1]), (0.1, 1.0)) if epochs > 1 else np.ones(1)
    truth = np.maximum.accumulate(np.clip(share[:, None, None] * base + rng.normal(0, drift, (epochs, *base.shape)), 0, None), axis=0)
    return truth, *observed(rng, truth, wells, sigma, dz)


def random_wells(pixels: int, wells: int, seed: int = 42) -> tuple[int, ...]:
    """Different pixels for wells, in ascending order."""
    return tuple(np.sort(np.random.default_rng(seed).choice(pixels, wells, replace=False)).tolist())


def random_field(side: int, cell: float, angle: float, major: float, minor: float, sill: float, nugget: float, seed: int) -> np.ndarray:
    """A Gaussian random field of Gaussian covariance on a square raster, by the spectrum of its covariance."""
    rng = np.random.default_rng(seed)
    k = 2 * np.pi * np.fft.fftfreq(side, cell)
    kx, ky = np.meshgrid(k, k)
    a = np.radians(angle)
    u, v = kx * np.cos(a) + ky * np.sin(a), ky * np.cos(a) - kx * np.sin(a)
    root = np.exp(-((u * major) ** 2 + (v * minor) ** 2) / 24)  # of the spectrum of exp(-3 (h / a)^2)
    field = np.fft.ifft2(np.fft.fft2(rng.standard_normal((side, side))) * root).real
    return (field - field.mean()) / field.std() * np.sqrt(sill) + rng.normal(0, np.sqrt(nugget), (side, side))
