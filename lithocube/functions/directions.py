"""Angles: counter-clockwise from east, and clockwise from north."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight directions, clockwise from north.
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def turned(angle: Column) -> Column:
    """Azimuth of a Cartesian angle, or the other way round: both are 90 - angle, in [0, 360)."""
    return F.pmod(90.0 - angle, F.lit(360.0))


def compass(azimuth: Column) -> Column:
    """The nearest of eight directions; half-way angles go clockwise."""
    sector = (F.floor((F.pmod(azimuth, F.lit(360.0)) + 22.5) / 45) % 8).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), sector + 1)


def rotated(x: Column, y: Column, degrees: Column | float) -> tuple[Column, Column]:
    """Coordinates along and across an axis at this angle."""
    a = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    return x * F.cos(a) + y * F.sin(a), y * F.cos(a) - x * F.sin(a)
