"""Variogram models as column expressions and as numpy functions of the same name."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Columns:
    exp, sqrt, cos, sin, abs = F.exp, F.sqrt, F.cos, F.sin, F.abs
    arccos = F.acos
    minimum = staticmethod(lambda a, b: F.least(a, F.lit(b)))
    where = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))


def _models(lib) -> dict[str, Callable]:
    """name -> f(h, sill, range, nugget, shape): gamma(h) of each model, sill being the partial sill."""

    def spherical(h, p, r, n, s):
        u = lib.minimum(h / r, 1.0)
        return n + p * (1.5 * u - 0.5 * u * u * u)

    def circular(h, p, r, n, s):
        u = lib.minimum(h / r, 1.0)
        return n + p * (1 - 2 / math.pi * (lib.arccos(u) - u * lib.sqrt(1 - u * u)))

    return {
        "linear": lambda h, p, r, n, s: n + p * lib.minimum(h / r, 1.0),
        "power": lambda h, p, r, n, s: n + p * (h / r) ** s,
        "gaussian": lambda h, p, r, n, s: n + p * (1 - lib.exp(-((h / (r * 4 / 7)) ** 2))),
        "spherical": spherical,
        "exponential": lambda h, p, r, n, s: n + p * (1 - lib.exp(-3 * h / r)),
        "hole-effect": lambda h, p, r, n, s: n + p * (1 - (1 - 3 * h / r) * lib.exp(-3 * h / r)),
        "stable": lambda h, p, r, n, s: n + p * (1 - lib.exp(-((h / r) ** s))),
        "circular": circular,
        "rational-quadratic": lambda h, p, r, n, s: n + p * (1 - (1 + h * h / (2 * s * r * r)) ** (-s)),
        "practical-gaussian": lambda h, p, r, n, s: n + p * (1 - lib.exp(-3 * (h / r) ** 2)),
    }


ARRAYS: dict[str, Callable] = _models(np)
_COLUMNS = _models(_Columns)
SHAPED = {"power", "stable", "rational-quadratic"}


def variogram(name: str, h: Column, sill: float, reach: float, nugget: float, shape: float = 1.0) -> Column:
    return _COLUMNS[name](h, sill, reach, nugget, shape)
