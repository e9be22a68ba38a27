"""Vehicle poses: from positioning records, pairwise relations and projections between frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeweave.functions.geometry import angles, compose, mercator, relative, relative6
from rangeweave.operators.registration import POSE, matrix_of
from rangeweave.session import ship, stored


def from_positions(records: DataFrame, log: str = "log") -> DataFrame:
    """log, frame, x, y, z, r, p, h, v_f, v_h from lat, lon, alt, roll, pitch, yaw, vf, wu.

    The map scale of a log is the cosine of its first frame's latitude; the first frame is an
    aggregate, so no log is sorted in one task.
    """
    first = records.groupBy(log).agg(F.min_by("lat", "frame").alias("_lat0"))
    x, y = mercator(F.col("lat"), F.col("lon"), F.cos(F.radians("_lat0")))
    return records.join(first, log).select(
        log, "frame", x.alias("x"), y.alias("y"), F.col("alt").alias("z"), F.col("roll").alias("r"),
        F.col("pitch").alias("p"), F.col("yaw").alias("h"), F.col("vf").alias("v_f"), F.col("wu").alias("v_h"),
    )


def steps(poses: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, dx, dy, dh: each pose seen from the one before it in its sequence."""
    w = Window.partitionBy(key).orderBy(order)
    before = [F.lag(c).over(w).alias(f"_{c}") for c in ("x", "y", "h")]
    both = poses.select(key, order, "x", "y", "h", *before).where("_x IS NOT NULL")
    move = relative((F.col("_x"), F.col("_y"), F.col("_h")), (F.col("x"), F.col("y"), F.col("h")))
    return both.select(key, order, *(m.alias(n) for m, n in zip(move, ("dx", "dy", "dh"), strict=True)))


def steps6(poses: DataFrame, key: str, order: str) -> DataFrame:
    """key, order and dx, dy, dz, dr, dp, dh: each pose (x, y, z, r, p, h) seen from the one before it in its sequence."""
    w = Window.partitionBy(key).orderBy(order)
    both = poses.select(key, order, *POSE, *(F.lag(c).over(w).alias(f"_{c}") for c in POSE)).where("_x IS NOT NULL")
    move = relative6(tuple(F.col(f"_{c}") for c in POSE), tuple(F.col(c) for c in POSE))
    return both.select(key, order, *(m.alias(f"d{c}") for m, c in zip(move, POSE, strict=True)))


def project_points(points: DataFrame, poses: DataFrame) -> DataFrame:
    """points (frame, x, y, ...) with x2, y2: where a place that stands still is in the next frame.

    poses: frame, x, y, h. Points of the last frame drop out.
    """
    a = poses.select("frame", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("h").alias("ah"))
    b = poses.select((F.col("frame") - 1).alias("frame"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("h").alias("bh"))
    met = points.join(a.join(b, "frame"), "frame")
    world = compose((F.col("ax"), F.col("ay"), F.col("ah")), (F.col("x"), F.col("y"), F.lit(0.0)))
    met = met.withColumn("_wx", world[0]).withColumn("_wy", world[1])
    there = relative((F.col("bx"), F.col("by"), F.col("bh")), (F.col("_wx"), F.col("_wy"), F.lit(0.0)))
    return met.withColumn("x2", there[0]).withColumn("y2", there[1]).select(*points.columns, "x2", "y2")


def chain(moves: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, x, y, h: planar steps composed left to right.

    Headings are a running sum; turned by the heading before it, a step's share of x and y is a running
    sum as well. Window sums take the place of an ordered fold.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = moves.withColumn("h", F.sum("dh").over(w))
    before = F.col("h") - F.col("dh")
    x, y = F.cos(before) * F.col("dx") - F.sin(before) * F.col("dy"), F.sin(before) * F.col("dx") + F.cos(before) * F.col("dy")
    return turned.withColumn("_x", x).withColumn("_y", y).select(key, order, F.sum("_x").over(w).alias("x"), F.sum("_y").over(w).alias("y"), "h")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Motion a followed by motion b, [..., 3, 4] each."""
    out = a[..., :3] @ b
    out[..., 3] += a[..., 3]
    return out


def running(m: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Products of motions [n, 3, 4] from the beginning of each one's run up to it. begin: index at which its run begins.

    Each step doubles how far back a product reaches, so the number of steps is the logarithm of the longest run.
    """
    m, at, reach = m.copy(), np.arange(len(m)), 1
    while len(go := np.flatnonzero(at - reach >= begin)):
        m[go] = _times(m[go - reach], m[go])
        reach *= 2
    return m


def chain6(moves: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, x, y, z, r, p, h: the steps (x, y, z, r, p, h) of each sequence composed left to right.

    Turns in space do not commute, so no window sum does it. Steps are sorted over the whole cluster, so that a
    sequence may lie in many partitions; each partition composes what it has. The products of whole
    partitions, a row a partition, are composed on the driver, and what comes before a partition is applied to its first sequence.
    Steps with a null order come first; equal orders of one sequence are composed in any order.
    """
    ship(moves.sparkSession)
    kinds = [moves.schema[c].dataType.simpleString() for c in (key, order)]
    own = moves.select(key, order, *(F.col(c).cast("double").alias(f"_{c}") for c in POSE))
    own = own.repartitionByRange(F.col(key).asc_nulls_first(), F.col(order).asc_nulls_first()).sortWithinPartitions(key, order)
    names = [key, order, "_pid", "_row", "_head", "_m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, rows, carried, head = TaskContext.get().partitionId(), 0, None, True
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b.column(0).to_pylist()
            edge = np.array([i == 0 or keys[i] != keys[i - 1] for i in range(n)])
            begin = np.flatnonzero(edge)[np.cumsum(edge) - 1]
            m = running(matrix_of(np.stack([b.column(f"_{c}").to_numpy() for c in POSE], axis=1)), begin)
            first = begin == 0
            goes_on = carried is not None and carried[0] == keys[0]
            if goes_on:
                m[first] = _times(carried[1][None], m[first])
            at_head = first & (head and (goes_on or carried is None))
            carried, head = (keys[-1], m[-1]), bool(at_head[-1])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 12 * n + 1, 12, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(n, pid)), pa.array(rows + np.arange(n)), pa.array(at_head), flat], names=names)
            rows += n

    part = stored(own.mapInArrow(run, f"{key} {kinds[0]}, {order} {kinds[1]}, _pid bigint, _row bigint, _head boolean, _m array<double>"), "chain")
    ends = part.groupBy("_pid").agg(F.min_by(F.struct(key), "_row").alias("first"), F.max_by(F.struct(key, "_head", "_m"), "_row").alias("last"))
    before, offsets = None, []
    for r in sorted(ends.collect(), key=lambda r: r["_pid"]):
        offset = before[1] if before is not None and before[0] == r["first"][0] else None
        if offset is not None:
            offsets.append((r["_pid"], offset.ravel().tolist()))
        last = np.array(r["last"]["_m"]).reshape(3, 4)
        before = (r["last"][0], _times(offset, last) if offset is not None and r["last"]["_head"] else last)
    known = F.broadcast(moves.sparkSession.createDataFrame(offsets, "_pid bigint, _before array<double>"))
    met = part.join(known, "_pid", "left")
    at = lambda c: [[F.element_at(c, 4 * i + j + 1) for j in range(4)] for i in range(3)]
    a, b = at("_before"), at("_m")
    whole = F.array(*(a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] + (a[i][3] if j == 3 else F.lit(0.0)) for i in range(3) for j in range(4)))
    met = met.withColumn("_m", F.when(F.col("_head") & F.col("_before").isNotNull(), whole).otherwise(F.col("_m")))
    m = at("_m")
    return met.select(key, order, *(c.alias(n) for c, n in zip((m[0][3], m[1][3], m[2][3], *angles(m)), POSE, strict=True)))


def trail(poses: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, x, y: a sequence's poses seen from its last one's place (not turned). The last pose is an aggregate."""
    last = poses.groupBy(key).agg(F.max_by(F.struct("x", "y"), order).alias("_l"))
    return poses.join(last, key).select(key, order, (F.col("x") - F.col("_l.x")).alias("x"), (F.col("y") - F.col("_l.y")).alias("y"))
