"""Text and XML sources of a drive: positions, matched poses, calibration, models and tracks."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.session import ship

from .scans import frame_of, log_of, unbroken

# The record's fields in order.
FLOATS = (
    "lat lon alt roll pitch yaw vn ve vf vl vu ax ay az af al au wx wy wz wf wl wu posacc velacc"
).split()
INTS = "navstat numsats posmode velmode orimode".split()
TRACK_POSE = "tx double, ty double, tz double, rx double, ry double, rz double, state int, occlusion int, occlusion_kf int, truncation int, amt_occlusion float, amt_occlusion_kf int, amt_border_l float, amt_border_r float, amt_border_kf int"


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """log, frame and the record's fields: single-precision floats, then integers (null where the row is shorter)."""
    rows = spark.read.text(path).withColumn("_path", F.input_file_name())
    rows = rows.select(log_of(F.col("_path")).alias("log"), frame_of(F.col("_path")).alias("frame"), F.split(F.trim("value", F.lit(" \t\r\n")), r"\s+").alias("f"))
    fields = [F.get("f", F.lit(k)).cast("float").alias(c) for k, c in enumerate(FLOATS)]
    fields += [F.get("f", F.lit(len(FLOATS) + k)).cast("int").alias(c) for k, c in enumerate(INTS)]
    return unbroken(rows.select("log", "frame", *fields))


def read_matched_poses(spark: SparkSession, path: str) -> DataFrame:
    """frame, x, y, z, r, p, h from a file of six numbers a line; the frame is the first of a line's number."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value", F.lit(" \t\r\n")), r"\R")).alias("frame", "line"))
    part = F.split(F.trim("line"), r"[\s,]+")
    return rows.select("frame", *(F.get(part, F.lit(a)).cast("double").alias(c) for a, c in enumerate("xyzrph")))


def matched_poses(spark: SparkSession, path: str, compute) -> DataFrame:
    """read_matched_poses of path; where there is nothing yet, compute() (frame, x, y, z, r, p, h) is written there first."""
    try:
        return read_matched_poses(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyzrph"))
    # A line's number is its frame, so a log's lines are one file.
    compute().orderBy("frame").select(line).coalesce(1).write.text(path)
    return read_matched_poses(spark, path)


def read_intensities(spark: SparkSession, path: str) -> DataFrame:
    """laser (sorted), raw, mapped: a file of the number of lasers, 256, and 256 numbers a laser."""
    n = spark.read.text(path, wholetext=True).select(F.slice(F.split(F.trim("value", F.lit(" \t\r\n")), r"\s+"), 3, 1 << 30).alias("n"))
    rows = n.select(F.posexplode("n").alias("at", "v"))
    return rows.select(F.expr("CAST(at div 256 AS INT)").alias("laser"), (F.col("at") % 256).cast("int").alias("raw"), F.col("v").cast("int").alias("mapped"))


def write_intensities(table: DataFrame, path: str) -> None:
    """What read_intensities reads, one file (256 numbers a laser)."""
    lines = table.groupBy("laser").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("raw", "mapped"))), lambda x: x["mapped"].cast("string")), " ").alias("v"))
    head = table.agg(F.countDistinct("laser").cast("string").alias("v")).select(F.lit(-2).alias("laser"), "v")
    size = head.select(F.lit(-1).alias("laser"), F.lit("256").alias("v"))
    head.unionByName(size).unionByName(lines).orderBy("laser").select("v").coalesce(1).write.mode("overwrite").text(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """name, numbers: a row for each "name: numbers" line."""
    line = F.regexp_extract("value", r"^(\w+):\s*(.*)$", 1).alias("name"), F.split(F.trim(F.regexp_extract("value", r"^(\w+):\s*(.*)$", 2)), r"\s+").cast("array<double>").alias("numbers")
    return spark.read.text(path).where(F.col("value").rlike(r"^\w+:\s*[-+.\d]")).select(*line)


def camera_matrix(camera: DataFrame, sensor: DataFrame, number: int = 2) -> list[float]:
    """The row-major 3x4 matrix that takes a point of the sensor to a pixel: P R T of two calibration files.

    camera, sensor: name, numbers (see read_calibration). P is P_rect of the camera, R is R_rect_00; T is the
    sensor's R and T. A few rows come to the driver, as the matrix is a parameter of the queries.
    """
    c, s = ({r["name"]: np.array(r["numbers"]) for r in t.where(F.col("name").isin(names)).collect()} for t, names in ((camera, [f"P_rect_{number:02d}", "R_rect_00"]), (sensor, ["R", "T"])))
    rect, move = np.eye(4), np.eye(4)
    rect[:3, :3] = c["R_rect_00"].reshape(3, 3)
    move[:3, :3], move[:3, 3] = s["R"].reshape(3, 3), s["T"]
    return (c[f"P_rect_{number:02d}"].reshape(3, 4) @ rect @ move).ravel().tolist()


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """di, dj, k, w from a file of 350 numbers in (di, dj, k) order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value", F.lit(" \t\r\n")), r"[\s,]+")).alias("n", "w"))
    return rows.select(F.expr("CAST(n div 70 - 2 AS INT)").alias("di"), F.expr("CAST(n div 14 % 5 - 2 AS INT)").alias("dj"), F.expr("CAST(n % 14 AS INT)").alias("k"), F.col("w").cast("double").alias("w"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """track_id, objectType, h, w, l, first_frame, finished, poses (array of structs) of a track file.

    Fields that a file's version lacks are -1, as they are for poses that state none.
    """
    item = f"struct<objectType: string, h: float, w: float, l: float, first_frame: int, poses: struct<count: int, item: array<struct<{TRACK_POSE.replace(' ', ': ').replace(',:', ',')}>>>, finished: int>"
    rows = spark.read.format("xml").schema(f"count int, item array<{item}>").option("rowTag", "tracklets").load(path)
    flat = rows.select(F.posexplode("item").alias("track_id", "t")).select("track_id", "t.objectType", "t.h", "t.w", "t.l", "t.first_frame", "t.finished", F.col("t.poses.item").alias("poses"))
    optional = [f.split(" ")[0] for f in TRACK_POSE.split(", ")][6:]
    full = F.transform("poses", lambda p: reduce(lambda q, c: q.withField(c, F.coalesce(p[c], F.lit(-1))), optional, p))
    return flat.withColumn("poses", full)


def write_tracks(tracks: DataFrame, path: str) -> None:
    """Tracks as read_tracks reads them: a track file is one element, so a log's tracks (all, without a column log) are one row."""
    by = ["log"] if "log" in tracks.columns else []
    item = F.struct("objectType", "h", "w", "l", "first_frame", F.struct(F.size("poses").alias("count"), F.col("poses").alias("item")).alias("poses"), "finished")
    one = tracks.groupBy(*by).agg(F.count("*").alias("count"), F.transform(F.array_sort(F.collect_list(F.struct("track_id", item.alias("t")))), lambda x: x["t"]).alias("item"))
    out = one.write.format("xml").option("rowTag", "tracklets").option("rootTag", "boost_serialization").mode("overwrite")
    (out.partitionBy("log") if by else out).save(path)


# The layout of a pose message after its 8-byte type mark: time, position, velocity, orientation
# (quaternion), turn rate and acceleration, big-endian.
POSE_MESSAGE = ">q3d3d4d3d3d"


def encode_pose(messages: DataFrame, mark: int) -> DataFrame:
    """messages (utime, pos, vel, orientation, rotation_rate, accel: arrays) with content (binary)."""
    fields = ["pos", "vel", "orientation", "rotation_rate", "accel"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [struct.pack(">Q", mark) + struct.pack(POSE_MESSAGE, t, *(x for v in vs for x in v)) for t, *vs in zip(*(b.column(c).to_pylist() for c in ("utime", *fields)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("utime"), pa.array(raw, pa.binary())], ["utime", "content"])

    ship(messages.sparkSession)
    return messages.select("utime", *fields).mapInArrow(run, "utime bigint, content binary")


def decode_pose(messages: DataFrame, mark: int) -> DataFrame:
    """utime, pos, vel, orientation, rotation_rate, accel of encode_pose's content; messages of another mark or length are left out."""
    width = [3, 3, 4, 3, 3]
    names = ["pos", "vel", "orientation", "rotation_rate", "accel"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [struct.unpack(POSE_MESSAGE, raw[8:]) for raw in b.column("content").to_pylist() if raw and len(raw) == 8 + struct.calcsize(POSE_MESSAGE) and struct.unpack(">Q", raw[:8])[0] == mark]
            cols, at = [pa.array([g[0] for g in got], pa.int64())], 1
            for w in width:
                cols.append(pa.array([g[at : at + w] for g in got], pa.list_(pa.float64())))
                at += w
            yield pa.RecordBatch.from_arrays(cols, ["utime", *names])

    ship(messages.sparkSession)
    return messages.select("content").mapInArrow(run, "utime bigint, " + ", ".join(f"{n} array<double>" for n in names))
