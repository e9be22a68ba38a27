"""Labelled object tracks: what is active when, what a point belongs to, where it goes next.

A box join would compare every point with every box. Boxes are dealt to the square tiles that they
touch and points to the tile that holds them, so that the join is an equi-join on (frame, tile).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeweave.functions.geometry import compose, relative, rigid, rotation

#: Edge of a tile in metres.
TILE = 8.0
NOTHING = "NO_OBJECT"
#: Fixed value: how far above its pose a track's box is shown, in metres.
LIFT = 0.8


def active(tracks: DataFrame) -> DataFrame:
    """track_id, frame and the pose's fields: nested poses (tx, ty, rz, ...) laid out from first_frame."""
    flat = tracks.select("track_id", "objectType", "l", "w", "first_frame", F.posexplode("poses").alias("_p", "_pose"))
    return flat.select("track_id", "objectType", "l", "w", (F.col("first_frame") + F.col("_p")).alias("frame"), "_pose.*")


def _tile(c: str):
    return F.floor(F.col(c) / TILE).cast("int")


def _tiled(boxes: DataFrame) -> DataFrame:
    """boxes with tx_, ty_: a row for each tile that the box's bounding circle may touch."""
    r = F.sqrt(F.col("l") * F.col("l") + F.col("w") * F.col("w")) / 2
    span = lambda c: F.sequence(F.floor((F.col(c) - r) / TILE).cast("int"), F.floor((F.col(c) + r) / TILE).cast("int"))
    return boxes.withColumn("tx_", F.explode(span("tx"))).withColumn("ty_", F.explode(span("ty")))


def inside(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """A row for each point (frame, x, y, ...) and box (frame, track_id, tx, ty, rz, l, w, ...) around it."""
    met = points.withColumn("tx_", _tile("x")).withColumn("ty_", _tile("y")).join(_tiled(boxes), ["frame", "tx_", "ty_"])
    at = relative((F.col("tx"), F.col("ty"), F.col("rz")), (F.col("x"), F.col("y"), F.lit(0.0)))
    return met.where((F.abs(at[0]) < F.col("l") / 2) & (F.abs(at[1]) < F.col("w") / 2)).drop("tx_", "ty_")


def object_at(points: DataFrame, boxes: DataFrame, key: tuple[str, ...] = ("frame", "x", "y")) -> DataFrame:
    """key (distinct), type: of the box with the least track_id around the point (frame, x, y); key names its place."""
    p = points.select(*key, *(c for c in ("frame", "x", "y") if c not in key)).distinct()
    hit = inside(p, boxes).groupBy(*key).agg(F.min_by("objectType", "track_id").alias("type"))
    return p.join(hit, list(key), "left").select(*key, F.coalesce("type", F.lit(NOTHING)).alias("type"))


def correspondence(points: DataFrame, boxes: DataFrame, moved: DataFrame, key: tuple[str, ...] = ("frame", "x", "y")) -> DataFrame:
    """moved with x2, y2 as the point's place in the next frame, and is_tracklet, for each distinct point.

    A point in a box whose track goes on moves with the box of least track_id; any other moves as the
    ground does (moved: key, x, y, x2, y2 from the vehicle's poses). key names a point (frame, x, y).
    """
    later = boxes.select((F.col("frame") - 1).alias("frame"), "track_id", *(F.col(c).alias(f"n_{c}") for c in ("tx", "ty", "rz")))
    both = boxes.join(later, ["frame", "track_id"])
    p = points.select(*key, *(c for c in ("frame", "x", "y") if c not in key)).distinct()
    local = relative((F.col("tx"), F.col("ty"), F.col("rz")), (F.col("x"), F.col("y"), F.lit(0.0)))
    hit = inside(p, both).withColumn("_lx", local[0]).withColumn("_ly", local[1])
    to = compose((F.col("n_tx"), F.col("n_ty"), F.col("n_rz")), (F.col("_lx"), F.col("_ly"), F.lit(0.0)))
    hit = hit.select(*key, "track_id", to[0].alias("bx"), to[1].alias("by"))
    carried = hit.groupBy(*key).agg(F.min_by(F.struct("bx", "by"), "track_id").alias("_c"))
    out = moved.join(carried, list(key), "left").withColumn("x2", F.coalesce("_c.bx", "x2")).withColumn("y2", F.coalesce("_c.by", "y2"))
    return out.withColumn("is_tracklet", F.col("_c").isNotNull().cast("int")).drop("_c")


# -- boxes in space ------------------------------------------------------------------------------


def tiled3(boxes: DataFrame, tile: float = TILE, flat: bool = False) -> DataFrame:
    """boxes (tx, ty, tz, rx, ry, rz, l, w, h) with tx_, ty_, tz_: a row for each tile that their turned extents touch. flat: no tz_."""
    turn = rotation(F.col("rx"), F.col("ry"), F.col("rz"))
    for a, c in enumerate("xy" if flat else "xyz"):
        r = sum((F.abs(turn[a][b]) * F.col(n) / 2 for b, n in enumerate(("l", "w", "h"))), F.lit(0.0))
        boxes = boxes.withColumn(f"t{c}_", F.explode(F.sequence(F.floor((F.col(f"t{c}") - r) / tile).cast("int"), F.floor((F.col(f"t{c}") + r) / tile).cast("int"))))
    return boxes


def inside3(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """A row for each point (frame, x, y, z, ...) and box around it, with _lx, _ly, _lz: the point seen from the box."""
    named = points.withColumns({f"t{c}_": _tile(c) for c in "xyz"})
    met = named.join(tiled3(boxes), ["frame", "tx_", "ty_", "tz_"])
    turn, off = rotation(F.col("rx"), F.col("ry"), F.col("rz")), [F.col(c) - F.col(f"t{c}") for c in "xyz"]
    met = met.withColumns({f"_l{c}": turn[0][a] * off[0] + turn[1][a] * off[1] + turn[2][a] * off[2] for a, c in enumerate("xyz")})
    return met.where((F.abs("_lx") < F.col("l") / 2) & (F.abs("_ly") < F.col("w") / 2) & (F.abs("_lz") < F.col("h") / 2)).drop("tx_", "ty_", "tz_")


def object_at3(points: DataFrame, boxes: DataFrame, key: tuple[str, ...] = ("frame", "x", "y", "z")) -> DataFrame:
    """key (distinct), type: of the box with the least track_id around the point in space."""
    p = points.select(*key, *(c for c in ("frame", "x", "y", "z") if c not in key)).distinct()
    hit = inside3(p, boxes).groupBy(*key).agg(F.min_by("objectType", "track_id").alias("type"))
    return p.join(hit, list(key), "left").select(*key, F.coalesce("type", F.lit(NOTHING)).alias("type"))


def correspondence3(points: DataFrame, boxes: DataFrame, moved: DataFrame, key: tuple[str, ...] = ("frame", "x", "y", "z")) -> DataFrame:
    """moved (key, x2, y2, z2) with the point's place in the next frame, and is_tracklet.

    As `correspondence`, in space: a point in a box whose track goes on keeps its place in the box of least track_id, as that turns and moves.
    """
    fields = ("tx", "ty", "tz", "rx", "ry", "rz")
    later = boxes.select((F.col("frame") - 1).alias("frame"), "track_id", *(F.col(c).alias(f"n_{c}") for c in fields))
    p = points.select(*key, *(c for c in ("frame", "x", "y", "z") if c not in key)).distinct()
    hit = inside3(p, boxes.join(later, ["frame", "track_id"]))
    to = rigid((F.col("_lx"), F.col("_ly"), F.col("_lz")), tuple(F.col(f"n_{c}") for c in fields))
    carried = hit.groupBy(*key).agg(F.min_by(F.struct(*(c.alias(n) for c, n in zip(to, ("bx", "by", "bz"), strict=True))), "track_id").alias("_c"))
    out = moved.join(carried, list(key), "left")
    out = out.withColumns({f"{c}2": F.coalesce(F.col(f"_c.b{c}"), F.col(f"{c}2")) for c in "xyz"})
    return out.withColumn("is_tracklet", F.col("_c").isNotNull().cast("int")).drop("_c")
