"""What a ray of view meets first: oriented boxes and occupied cells.

A ray is dealt to the tiles of the ground plane that it crosses, which are worked out in closed form: a range of tiles on one axis,
and in each of these slabs the range on the other. Boxes lie in the tiles that they touch, cells in columns of their own, so both are
equi-joins; a slab test along the box's axes follows. Tiles beyond those that a frame's boxes or cells lie in are skipped. By Spark's
estimate a ray's tiles take no more room than the ray, so the joins are told to merge: a broadcast of them would go through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeweave.functions.geometry import rotation
from rangeweave.functions.grid_index import GridSpec
from rangeweave.operators import tracks
from rangeweave.session import by_frame

#: Metres after which a ray ends; share of a cell that its box takes.
REACH, CELL_SHARE = 120.0, 0.75


def _crossed(rays: DataFrame, held: DataFrame, tile: float, shift: tuple[float, float], reach: float, names: tuple[str, str]) -> DataFrame:
    """rays (ox, oy, oz, dx, dy, dz) once for each tile of the plane that they cross within the span of their frame's tiles in held.

    shift: where tile 0 begins; names: a tile's numbers. The rays are dealt anew, as few files may hold them.
    """
    a, b = (F.col("ox") - shift[0]) / tile, (F.col("oy") - shift[1]) / tile
    size = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    du, dv = F.col("dx") / size * reach / tile, F.col("dy") / size * reach / tile
    ends = [f(n).alias(f"_{f.__name__}{x}") for x, n in enumerate(names) for f in (F.min, F.max)]
    r = by_frame(rays).withColumns({"_a": a, "_b": b, "_u": du, "_v": dv}).join(held.groupBy("frame").agg(*ends), "frame")
    low, high = F.least(F.col("_a"), F.col("_a") + F.col("_u")), F.greatest(F.col("_a"), F.col("_a") + F.col("_u"))
    r = _spread(r, names[0], F.floor(low).cast("int"), F.floor(high).cast("int"), 0)
    # The stretch of the ray in the slab; a ray along the other axis stays in one slab.
    steep = F.col("_u") == 0
    at = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(steep, 0.0).otherwise((c - F.col("_a")) / F.when(steep, 1.0).otherwise(F.col("_u")))))
    s, t = at(F.col(names[0])), F.when(steep, 1.0).otherwise(at(F.col(names[0]) + 1))
    ends = [F.col("_b") + x * F.col("_v") for x in (s, t)]
    # A hair to both sides, so that rounding loses no tile.
    r = _spread(r, names[1], F.floor(F.least(*ends) - 1e-9).cast("int"), F.floor(F.greatest(*ends) + 1e-9).cast("int"), 1)
    return r.drop("_a", "_b", "_u", "_v", "_min0", "_max0", "_min1", "_max1")


def _spread(rows: DataFrame, name: str, low: Column, high: Column, axis: int) -> DataFrame:
    """rows, once for each number from low to high that is within the axis's span."""
    low, high = F.greatest(low, F.col(f"_min{axis}")), F.least(high, F.col(f"_max{axis}"))
    return rows.withColumn(name, F.explode(F.when(low <= high, F.sequence(low, high))))


def _met(met: DataFrame, origin: list[Column], direction: list[Column], half: list[Column], what: Column, reach: float) -> DataFrame:
    """Rows whose ray (origin and direction seen from a box of these half sizes around 0) enters the box within reach; from inside, at once.

    Each step is a column of its own: an expression of all of it would be more than a generated method can hold.
    """
    met = met.withColumns({f"_o{a}": o for a, o in enumerate(origin)} | {f"_d{a}": d for a, d in enumerate(direction)})
    beside = F.lit(False)
    for a, h in enumerate(half):
        o, d = F.col(f"_o{a}"), F.col(f"_d{a}")
        met = met.withColumns({f"_s{a}": F.try_divide(-h - o, d), f"_t{a}": F.try_divide(h - o, d)})
        beside = beside | ((d == 0) & (F.abs(o) > h))
    near = F.greatest(F.lit(0.0), *(F.least(f"_s{a}", f"_t{a}") for a in range(3)))
    far = F.least(F.lit(float("inf")), *(F.greatest(f"_s{a}", f"_t{a}") for a in range(3)))
    met = met.where(~beside).withColumns({"_near": near, "_far": far}).where("_near <= _far")
    met = met.withColumn("dist", F.col("_near") * F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)).where(F.col("dist") <= reach)
    return met.select("ray", "dist", *((F.col(f"o{c}") + F.col("_near") * F.col(f"d{c}")).alias(c) for c in "xyz"), what.alias("what"))


def box_hits(rays: DataFrame, boxes: DataFrame, reach: float = REACH) -> DataFrame:
    """ray, dist, x, y, z, what (`track:<id>`): where rays (frame, ray, ox, oy, oz, dx, dy, dz) enter boxes of their frame.

    boxes: frame, track_id, tx, ty, tz, rx, ry, rz, l, w, h. A hit may come several times, from several tiles.
    """
    b = tracks.tiled3(boxes, tracks.TILE, flat=True)
    met = _crossed(rays, b, tracks.TILE, (0.0, 0.0), reach, ("tx_", "ty_")).join(b.hint("merge"), ["frame", "tx_", "ty_"])
    turn = rotation(F.col("rx"), F.col("ry"), F.col("rz"))
    off = [F.col(f"o{c}") - F.col(f"t{c}") for c in "xyz"]
    into = lambda v: [turn[0][a] * v[0] + turn[1][a] * v[1] + turn[2][a] * v[2] for a in range(3)]
    return _met(met, into(off), into([F.col(f"d{c}") for c in "xyz"]), [F.col(c) / 2 for c in ("l", "w", "h")], F.concat(F.lit("track:"), F.col("track_id")), reach)


def cell_hits(rays: DataFrame, cells: DataFrame, spec: GridSpec, reach: float = REACH) -> DataFrame:
    """ray, dist, x, y, z, what (`cell:<i>:<j>:<k>`): where rays enter the boxes of occupied cells (frame, i, j, k)."""
    shift = tuple(-(n // 2 + 0.5) * spec.res for n in spec.dims[:2])
    c = cells.select("frame", "i", "j", "k")
    met = _crossed(rays, c, spec.res, shift, reach, ("i", "j")).join(c.hint("merge"), ["frame", "i", "j"])
    off = [F.col(f"o{c}") - spec.metres(F.col(n), a) for a, (c, n) in enumerate(zip("xyz", "ijk", strict=True))]
    half = [F.lit(CELL_SHARE * spec.res / 2)] * 3
    return _met(met, off, [F.col(f"d{c}") for c in "xyz"], half, F.concat_ws(":", F.lit("cell"), "i", "j", "k"), reach)


def pick(rays: DataFrame, boxes: DataFrame, cells: DataFrame, spec: GridSpec, reach: float = REACH) -> DataFrame:
    """ray, x, y, z, dist, what: what each ray meets first; rays that meet nothing have no row. Of equally near ones the box, then the least name."""
    hits = box_hits(rays, boxes, reach).unionByName(cell_hits(rays, cells, spec, reach))
    least = hits.groupBy("ray").agg(F.min(F.struct("dist", (~F.col("what").startswith("track")).alias("cell"), "what", "x", "y", "z")).alias("m"))
    return least.select("ray", "m.x", "m.y", "m.z", "m.dist", "m.what")
