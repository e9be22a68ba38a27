"""Voxel occupancy from range scans: rays to cells, log-odds, and what is asked of the grid.

A ray's cells depend on its end cell alone, so returns are counted per end cell before any ray is
walked; the walk then expands distinct end cells with weights. Cells are counted, not summed in
floating point, which makes the result independent of the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeweave.functions.geometry import rigid
from rangeweave.functions.grid_index import GridSpec
from rangeweave.operators.background import columns
from rangeweave.session import by_frame, ship

# Fixed values of the sensor model.
ORIGIN = (0.0, 0.0, 1.73)
OCCUPIED, FREE = 1.0, -0.1
LOG_MAX, LOG_MIN = 3.0, -1.0
EMPTY = 1e-2
#: Steps of walks that a task holds at once.
AT_ONCE = 100_000


def own_body(x: Column, y: Column) -> Column:
    """Returns from the vehicle itself: they free cells but occupy none."""
    return (F.abs(x - 1.5) < 3) & (F.abs(y) < 1.75)


def posed(points: DataFrame, poses: DataFrame, origin: tuple[float, float, float] = ORIGIN) -> DataFrame:
    """points (frame, x, y, z) moved by their frame's pose (frame, x, y, z, r, p, h), with ox, oy, oz, the moved
    origin of their rays, and body, whether they are of the vehicle itself (which is told before the move)."""
    pose = poses.select("frame", *(F.col(c).alias(f"_{c}") for c in "xyzrph"))
    met = points.select("frame", "x", "y", "z").join(pose, "frame")
    at = tuple(F.col(f"_{c}") for c in "xyzrph")
    hit, start = rigid((F.col("x"), F.col("y"), F.col("z")), at), rigid(tuple(map(F.lit, origin)), at)
    named = [*zip("xyz", hit, strict=True), *zip(("ox", "oy", "oz"), start, strict=True)]
    return met.select("frame", *(c.alias(n) for n, c in named), own_body(F.col("x"), F.col("y")).alias("body"))


def ends(points: DataFrame, spec: GridSpec, masked: bool = True) -> DataFrame:
    """frame, e0, e1, e2 (end cell, maybe outside), rays, hits; of posed points also o0, o1, o2, the origin's cell.

    These few rows become many when they are walked, so they are dealt to all shuffle partitions (by size alone they
    would be put together in one task) and by frame, so that the cells of the walks are added up where they arise.
    """
    moved = "body" in points.columns
    hit = ~(F.col("body") if moved else own_body(F.col("x"), F.col("y"))) if masked else F.lit(True)
    cells = [spec.endpoint(F.col(c), a).alias(f"e{a}") for a, c in enumerate("xyz")]
    cells += [spec.endpoint(F.col(f"o{c}"), a).alias(f"o{a}") for a, c in enumerate("xyz")] if moved else []
    counted = points.select("frame", *cells, hit.cast("long").alias("h")).groupBy("frame", *(c for n in ("e", "o")[: 1 + moved] for c in (f"{n}0", f"{n}1", f"{n}2"))).agg(F.count("*").alias("rays"), F.sum("h").alias("hits"))
    return by_frame(counted)


def origin_cell(spec: GridSpec, origin: tuple[float, float, float]) -> tuple[int, int, int]:
    return tuple(round(o / spec.res) + n // 2 for o, n in zip(origin, spec.dims, strict=True))


def _stepped(rays: DataFrame, spec: GridSpec, origin: tuple[float, float, float], max_cells: int | None) -> DataFrame:
    """rays with a row for each cell of their walk that is inside the grid: adds key, and last for the end cell.

    The walk takes one step along the dominant axis at a time; the other axes advance by rounded
    integer proportion. It passes free cells up to the end cell, the grid's edge or max_cells - 1 cells,
    and none if the origin is outside the grid; the end cell comes in any case. What a ray's steps share is
    worked out before the expansion, so that little is left to do for each of the many rows after it.
    """
    p0 = [F.col(f"o{a}") for a in range(3)] if "o0" in rays.columns else [F.lit(p) for p in origin_cell(spec, origin)]
    names = rays.columns
    far = F.greatest(*(F.abs(F.col(f"e{a}") - p0[a]) for a in range(3)))
    rays = rays.withColumn("_n", far)
    way = [F.when(F.col(f"e{a}") < p0[a], -1).otherwise(1).alias(f"_w{a}") for a in range(3)]
    twice = [(2 * F.abs(F.col(f"e{a}") - p0[a])).alias(f"_d{a}") for a in range(3)]
    free = F.when(spec.inside(*p0), F.least(F.col("_n"), F.lit((max_cells or max(spec.dims)) - 1))).otherwise(0)
    rays = rays.select(*names, "_n", F.greatest(2 * F.col("_n"), F.lit(1)).alias("_m"), *way, *twice, free.alias("_free"))
    each = rays.withColumn("_s", F.explode(F.sequence(F.lit(0), "_free")))
    each = each.withColumn("_t", F.when(F.col("_s") == F.col("_free"), F.col("_n")).otherwise(F.col("_s")))
    cell = [(p0[a] + F.expr(f"CAST(_w{a} * ((_d{a} * _t + _n) div _m) AS INT)")) for a in range(3)]
    each = each.where(spec.inside(*cell))
    return each.select(*names, ((cell[0].cast("long") * spec.n1 + cell[1]) * spec.n2 + cell[2]).alias("key"), (F.col("_s") == F.col("_free")).alias("last"))


def walk(rays: DataFrame, spec: GridSpec, origin: tuple[float, float, float] = ORIGIN, max_cells: int | None = None) -> DataFrame:
    """rays with a row for each free cell inside the grid on the way to the end cell: adds key."""
    return _stepped(rays, spec, origin, max_cells).where("NOT last").drop("last")


def accumulate(points: DataFrame, spec: GridSpec, origin: tuple[float, float, float] = ORIGIN, masked: bool = True, max_cells: int | None = None) -> DataFrame:
    """frame, key, n_free, n_occ, val: the sparse grid of every frame. val is not clamped. points: frame, x, y, z, or posed ones."""
    each = _stepped(ends(points, spec, masked), spec, origin, max_cells).where("NOT last OR hits > 0")
    nothing = F.lit(0).cast("long")
    return totals(each.select("frame", "key", F.when(F.col("last"), nothing).otherwise(F.col("rays")).alias("n_free"), F.when(F.col("last"), F.col("hits")).otherwise(nothing).alias("n_occ")), "frame", "key")


def totals(counts: DataFrame, *by: str) -> DataFrame:
    """Counts summed by key, with val: the log-odds."""
    out = counts.groupBy(*by).agg(F.sum("n_free").alias("n_free"), F.sum("n_occ").alias("n_occ"))
    return out.withColumn("val", (10 * F.col("n_occ") - F.col("n_free")) / 10)


def traced(end: np.ndarray, rays: np.ndarray, hits: np.ndarray, spec: GridSpec, origin: tuple[float, float, float] = ORIGIN, max_cells: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Free and occupied evidence of every cell of a scan, by key: the counts of `accumulate`. end: rows e0, e1, e2 (distinct or not)."""
    start, dims, size = np.array(origin_cell(spec, origin)), np.array(spec.dims), spec.n0 * spec.n1 * spec.n2
    key = lambda c: (c[0] * spec.n1 + c[1]) * spec.n2 + c[2]
    there = ((end >= 0) & (end < dims)).all(axis=1)
    occupied = np.bincount(key(end[there].T), weights=hits[there], minlength=size).astype(np.int64)
    free = np.zeros(size, dtype=np.int64)
    if ((start < 0) | (start >= dims)).any():
        return free, occupied
    off = end - start
    n = np.abs(off).max(axis=1, initial=0)
    steps = np.minimum(n, (max_cells or max(spec.dims)) - 1)
    stride = (spec.n1 * spec.n2, spec.n2, 1)
    for rows in np.array_split(np.argsort(steps), len(end) * max(spec.dims) // AT_ONCE + 1):
        s = np.arange(steps[rows].max(initial=0), dtype=float)[:, None]
        ok, cell = s < steps[rows], np.full((len(s), len(rows)), key(start))
        for a in range(3):
            # The rounded proportion is the floor of a quotient of integers far below 2 ** 53, so doubles have it exactly.
            c = np.multiply(2.0 * np.abs(off[rows, a]), s)
            c += n[rows]
            c /= np.maximum(2 * n[rows], 1)
            if not there[rows].all():
                ok &= c < np.where(off[rows, a] < 0, start[a] + 1, dims[a] - start[a])
            c = c.astype(np.int64)
            c *= np.sign(off[rows, a]) * stride[a]
            cell += c
        np.add.at(free, cell[ok], np.broadcast_to(rays[rows], ok.shape)[ok])
    return free, occupied


def by_scan(points: DataFrame, spec: GridSpec, made: Callable[..., dict[str, np.ndarray]], schema: str, beside: DataFrame | None = None) -> DataFrame:
    """frame and the columns (schema) that `made` makes of a scan's free and occupied evidence, and of its rows of beside; a scan is a group.

    Walks are added up in numpy: of a scan only its counted ends come in, and what is made of its grid goes out. For many scans; the
    ends of a few are better dealt to all tasks, by `accumulate`.
    """

    def run(key: tuple, scan: pa.Table, *others: pa.Table) -> pa.Table:
        end = np.stack([scan.column(f"e{a}").to_numpy().astype(np.int64) for a in range(3)], axis=1)
        out = made(*traced(end, scan.column("rays").to_numpy(), scan.column("hits").to_numpy(), spec), *others)
        return pa.table({"frame": pa.repeat(key[0], len(next(iter(out.values()))))} | {c: pa.array(x) for c, x in out.items()})

    ship(points.sparkSession)
    schema = f"frame {points.schema['frame'].dataType.simpleString()}, {schema}"
    scans = ends(points, spec).where("e0 IS NOT NULL AND e1 IS NOT NULL AND e2 IS NOT NULL").groupBy("frame")
    if beside is None:
        return scans.applyInArrow(lambda key, scan: run(key, scan), schema)
    return scans.cogroup(beside.groupBy("frame")).applyInArrow(lambda key, scan, other: run(key, scan, other), schema)


def scan_occupied(points: DataFrame, spec: GridSpec) -> DataFrame:
    """frame, i, j, k of the cells whose log-odds are above 0 in the grid of points; the free ones, which are many, are no rows."""

    def made(free: np.ndarray, occupied: np.ndarray) -> dict[str, np.ndarray]:
        ijk = np.unravel_index(np.flatnonzero(10 * occupied > free), spec.dims)
        return {c: x.astype(np.int32) for c, x in zip("ijk", ijk, strict=True)}

    return by_scan(points, spec, made, "i int, j int, k int")


def merge(*grids: DataFrame) -> DataFrame:
    """key, n_free, n_occ, val of all grids and frames together."""
    out = grids[0].select("key", "n_free", "n_occ")
    for g in grids[1:]:
        out = out.unionByName(g.select("key", "n_free", "n_occ"))
    return totals(out, "key")


def clean(grid: DataFrame) -> DataFrame:
    return grid.where(F.abs("val") >= EMPTY)


def probability(val: Column, filtered: Column | None = None) -> Column:
    """Of being occupied, the log-odds clipped first; a half where the column is filtered (1)."""
    p = 1 - 1 / (1 + F.exp(F.greatest(F.lit(LOG_MIN), F.least(F.lit(LOG_MAX), val))))
    return p if filtered is None else F.when(filtered == 1, 0.5).otherwise(p)


def state(val: Column, filtered: Column | None = None) -> Column:
    """The likelier state: 0 unknown, 1 free, 2 occupied; unknown where the column is filtered (1)."""
    s = F.when(val < 0, 1).when(val > 0, 2).otherwise(0)
    return s if filtered is None else F.when(filtered == 1, 0).otherwise(s)


def sign(val: Column) -> Column:
    return F.when(val < 0, -1).when(val > 0, 1).otherwise(0)


def column_counts(grid: DataFrame, spec: GridSpec) -> DataFrame:
    """frame, i, j, n: cells of a column whose log-odds exceed the clamp."""
    return grid.select("frame", *spec.ijk(), "val").groupBy("frame", "i", "j").agg(F.count_if(F.col("val") > LOG_MAX).alias("n"))


def levels(points: DataFrame, spec: GridSpec, n: int) -> DataFrame:
    """level, frame, key, n_free, n_occ, val: each level traced from the points at twice the cell."""
    out, limit = None, max(spec.dims)
    for level in range(n):
        g = accumulate(points, spec, max_cells=limit).withColumn("level", F.lit(level))
        out = g if out is None else out.unionByName(g)
        spec, limit = spec.coarser(), -(-limit // 2)
    return out


def densify(grid: DataFrame, frames: DataFrame, spec: GridSpec) -> DataFrame:
    """frame, key, val for every cell of every frame, 0 where the grid has none."""
    cells = frames.select("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spec.n0 * spec.n1 * spec.n2 - 1).cast("long"))).alias("key"))
    return cells.join(grid, ["frame", "key"], "left").select("frame", "key", F.coalesce("val", F.lit(0.0)).alias("val"))


def dense_slice(grid: DataFrame, spec: GridSpec, k: int) -> DataFrame:
    """frame, i, j, s: the sign of level k in every column of every frame, 0 where the grid has none."""
    cells = grid.select("frame", *spec.ijk(), "val").where(F.col("k") == k)
    every = columns(grid.select("frame").distinct(), spec)
    return every.join(cells, ["frame", "i", "j"], "left").select("frame", "i", "j", F.coalesce(sign(F.col("val")), F.lit(0)).alias("s"))


def occluded(targets: DataFrame, grid: DataFrame, spec: GridSpec, origin: tuple[float, float, float] = ORIGIN) -> DataFrame:
    """frame, e0, e1, e2 of the target cells with an occupied cell on the way there."""
    way = walk(targets.select("frame", "e0", "e1", "e2").distinct(), spec, origin)
    return way.join(grid.where("val > 0").select("frame", "key"), ["frame", "key"], "left_semi").select("frame", "e0", "e1", "e2").distinct()


def resample(grid: DataFrame, spec: GridSpec, target: GridSpec, move: tuple[float, float, float]) -> DataFrame:
    """frame, key, val of the target grid: each of its cells takes the source cell nearest to its
    centre moved by the planar pose (x, y, h); cells that are empty there are left out."""
    x, y, h = (F.lit(v) for v in move)
    cells = grid.sparkSession.range(target.n0 * target.n1 * target.n2).withColumnRenamed("id", "key")
    cells = cells.select("key", *target.ijk())
    px, py, pz = (target.metres(F.col(c), a) for a, c in enumerate("ijk"))
    sx, sy = F.cos(h) * px - F.sin(h) * py + x, F.sin(h) * px + F.cos(h) * py + y
    at = spec.key(spec.nearest(sx, 0), spec.nearest(sy, 1), spec.nearest(pz, 2))
    near = cells.select("key", at.alias("from"))
    source = clean(grid).select("frame", F.col("key").alias("from"), "val")
    return near.where("from >= 0").join(source, "from").select("frame", "key", "val")
