"""Projection of occupied columns forward in time along their motion: where a column goes is a plain expression."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeweave.functions.grid_index import GridSpec
from rangeweave.operators.occupancy import EMPTY, by_scan

STEP = 0.001


def travelled(h: Column, v: Column, w: Column, dt: float) -> tuple[Column, Column]:
    """Way in x and y after dt in Euler steps of STEP.

    The headings of the steps are an arithmetic progression; sums of their cosines and sines have a
    closed form, so no loop is needed.
    """
    n = math.ceil(dt / STEP - 1e-9)
    half = w * STEP / 2
    small = F.abs(half) < 1e-9
    ratio = F.when(small, F.lit(float(n))).otherwise(F.sin(half * n) / F.when(small, F.lit(1.0)).otherwise(F.sin(half)))
    mid = h + half * (n - 1)
    return v * STEP * ratio * F.cos(mid), v * STEP * ratio * F.sin(mid)


def _target(spec: GridSpec, dt: float, x: Column, y: Column) -> tuple[Column, Column]:
    """Where the column i, j with the motion h, v, w from x, y is after dt: where it was if that isn't known."""
    dx, dy = travelled(F.col("h"), F.col("v"), F.col("w"), dt)
    return F.coalesce(spec.nearest(x + dx, 0), F.col("i")), F.coalesce(spec.nearest(y + dy, 1), F.col("j"))


def project_grid(cells: DataFrame, motion: DataFrame, spec: GridSpec, dt: float) -> DataFrame:
    """frame, i, j, k, val: cells moved with their column's motion, sums where several meet.

    cells: frame, i, j, k, val; motion: frame, i, j, h, v, w, and x, y if the motion starts elsewhere than at
    the column's centre (a tracklet's place). Columns without motion stay; what leaves the grid is dropped.
    """
    start = [c for c in ("x", "y") if c in motion.columns]
    met = cells.join(motion.select("frame", "i", "j", "h", "v", "w", *start), ["frame", "i", "j"], "left")
    i2, j2 = _target(spec, dt, *((F.col("x"), F.col("y")) if start else (spec.metres(F.col("i"), 0), spec.metres(F.col("j"), 1))))
    out = met.select("frame", i2.alias("i"), j2.alias("j"), "k", "val")
    return out.where(spec.inside(F.col("i"), F.col("j"))).groupBy("frame", "i", "j", "k").agg(F.sum("val").alias("val"))


def project_scans(points: DataFrame, motion: DataFrame, spec: GridSpec, dt: float) -> DataFrame:
    """project_grid of the grid of points (frame, x, y, z), without its empty cells, along motion (frame, i, j, x, y, h, v, w).

    A scan's cells move in the task that traces them: they are no rows before they have moved.
    """
    i2, j2 = _target(spec, dt, F.col("x"), F.col("y"))
    moved = motion.where(spec.inside(F.col("i"), F.col("j"))).select("frame", (F.col("i") * spec.n1 + F.col("j")).alias("column"), F.when(spec.inside(i2, j2), i2 * spec.n1 + j2).otherwise(-1).alias("to"))

    def made(free: np.ndarray, occupied: np.ndarray, moves: pa.Table) -> dict[str, np.ndarray]:
        val = (10 * occupied - free) / 10
        cell = np.flatnonzero(np.abs(val) >= EMPTY)
        column, level = np.divmod(cell, spec.n2)
        to, start = (moves.column(c).to_numpy().astype(np.int64) for c in ("to", "column"))
        to = np.append(to[np.lexsort((to, start))], -1)
        n = np.bincount(start, minlength=spec.n0 * spec.n1)
        first, n = (np.cumsum(n) - n)[column], n[column]
        each = np.repeat(np.arange(len(cell)), np.maximum(n, 1))  # a cell goes with every motion of its column, or stays
        nth = np.arange(len(each)) - np.searchsorted(each, each)
        at = np.where(n[each] > 0, to[first[each] + nth], column[each])
        each, at = each[at >= 0], at[at >= 0]
        key = at * spec.n2 + level[each]
        there = np.flatnonzero(np.bincount(key, minlength=len(val)))
        total = np.bincount(key, weights=val[cell[each]], minlength=len(val))[there].astype(float)
        i, j, k = np.unravel_index(there, spec.dims)
        return {"i": i.astype(np.int32), "j": j.astype(np.int32), "k": k.astype(np.int32), "val": total}

    return by_scan(points, spec, made, "i int, j int, k int, val double", moved)
