"""Colours and bytes for exported views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(c: Column) -> Column:
    """Clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def byte(c: Column, low: float, high: float) -> Column:
    """0 to 255, linear between low and high, clamped."""
    return F.round(unit((c - low) / (high - low)) * 255).cast("int")


# Limits, in metres, of the shades by height and depth.


def by_height(z: Column) -> Column:
    """Shade of a point by its height: down to five metres below, and over twelve metres."""
    return F.when(z < 0, unit(-z / 5)).otherwise(unit((z + 4) / 12))


def by_depth(d: Column) -> Column:
    return unit(d / 40)


def jet(s: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue (bytes) of a shade: three shifted triangles."""
    ramp = lambda mid: F.round(unit(1.5 - F.abs(4 * s - mid)) * 255).cast("int")
    return ramp(3.0), ramp(2.0), ramp(1.0)


# Red, green, blue of the kinds of tracks; white for others.
TYPE_COLOURS = {"Car": (0, 255, 0), "Pedestrian": (255, 255, 0), "Person": (255, 255, 0), "Cyclist": (255, 0, 0)}


def of_type(kind: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue (bytes) of a track's kind."""
    return tuple(F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, c in TYPE_COLOURS.items() for x in (k, c[a]))), kind), F.lit(255)) for a in range(3))
