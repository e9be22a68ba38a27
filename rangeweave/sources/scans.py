"""Range scan files: binary and text point clouds, packets and grid files, as DataFrames and back."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeweave.session import bounded, ship

POINT = "log string, frame int, point_id int, x float, y float, z float, intensity smallint"
_NUMBER = r"(\d+)\.[^./]+$"


def frame_of(path: Column) -> Column:
    """The number that a file is named by."""
    return F.regexp_extract(path, _NUMBER, 1).cast("int")


def log_of(path: Column) -> Column:
    """The folder that a file is in: the sequence that it belongs to."""
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def unbroken(files: DataFrame) -> DataFrame:
    """Files (log, frame, ...) of each log up to its first gap from frame 0."""
    n = files.select("log", "frame").distinct()
    # In an unbroken run a frame's number is its rank in its log.
    good = n.withColumn("r", F.row_number().over(Window.partitionBy("log").orderBy("frame")) - 1).where("r = frame").select("log", "frame")
    return files.join(good, ["log", "frame"], "left_semi")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Scans of little-endian float32 records x, y, z, intensity; intensity becomes 0 to 255.

    A file without a byte counts as missing, so the sequence ends before it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    files = unbroken(files.select(log_of(F.col("path")).alias("log"), frame_of(F.col("path")).alias("frame"), "content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for log, frame, raw in zip(*(b.column(c).to_pylist() for c in ("log", "frame", "content")), strict=True):
                p = np.frombuffer(raw[: len(raw) // 16 * 16], dtype="<f4").reshape(-1, 4)
                n = np.arange(len(p), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([log] * len(p), pa.string()), pa.array(np.full(len(p), frame, dtype=np.int32)), pa.array(n), *(pa.array(np.ascontiguousarray(p[:, a])) for a in range(3)), pa.array((p[:, 3] * 255).astype(np.int16))],
                    ["log", "frame", "point_id", "x", "y", "z", "intensity"],
                )

    ship(spark)
    return files.select("log", "frame", "content").mapInArrow(run, POINT)


def encode_binary(points: DataFrame) -> DataFrame:
    """frame, content: a scan's points as the records that read_binary reads."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("point_id")
        p = np.stack([t.column(c).to_numpy().astype("<f4") for c in "xyz"] + [t.column("intensity").to_numpy().astype("<f4") / np.float32(255)], axis=1)
        return pa.table({"frame": pa.array([t.column("frame")[0].as_py()], pa.int32()), "content": pa.array([p.astype("<f4").tobytes()], pa.binary())})

    ship(points.sparkSession)
    return points.select("frame", "point_id", "x", "y", "z", "intensity").groupBy("frame").applyInArrow(run, "frame int, content binary")


def _text_rows(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).withColumn("_path", F.input_file_name())
    return files.select(log_of(F.col("_path")).alias("log"), frame_of(F.col("_path")).alias("frame"), F.split(F.trim("value", F.lit(" \t\r\n")), r"\R").alias("rows"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """log, frame, point_id, x, y, z of text scans: four rows of sensor places, a count, then x,y,z rows."""
    lines = _text_rows(spark, path).select("log", "frame", F.posexplode(F.slice("rows", 6, 1 << 30)).alias("point_id", "line"))
    part = lambda a: F.get(F.split("line", ","), F.lit(a)).cast("double")
    return lines.select("log", "frame", "point_id", part(0).alias("x"), part(1).alias("y"), part(2).alias("z"))


def read_text_sensors(spark: SparkSession, path: str) -> DataFrame:
    """log, frame, sensor, x_vs (array of float): the places of the four sensors of text scans."""
    lines = _text_rows(spark, path).select("log", "frame", F.posexplode(F.slice("rows", 1, 4)).alias("sensor", "line"))
    return lines.select("log", "frame", "sensor", F.split(F.trim("line"), r"[,\s]+").cast("array<float>").alias("x_vs"))


# Fixed values of a packet: block and return sizes, a block's mark, radians of an angle's unit, metres of a
# range's, the spin (radians a microsecond) and microseconds between the lasers of a block.
PACKET, BLOCKS, RETURNS, BLOCK_BYTES, MARK = 1206, 12, 32, 100, 0xEEFF
ANGLE_UNIT, RANGE_UNIT, SPIN_RATE, LASER_DELAY = 0.00017453293, 0.002, 0.00006283185, 1.152
NEAREST = 0.1
# The lasers' elevations in radians, in firing order.
ELEVATIONS = (
    -0.535292, -0.162839, -0.511905, -0.139626, -0.488692, -0.116239, -0.465305, -0.093026,
    -0.442092, -0.069813, -0.418879, -0.046600, -0.395666, -0.023213, -0.372279, 0.000000,
    -0.349066, 0.023213, -0.325853, 0.046600, -0.302466, 0.069813, -0.279253, 0.093026,
    -0.256040, 0.116413, -0.232652, 0.139626, -0.209440, 0.162839, -0.186227, 0.186227,
)


def laser_table(spark: SparkSession, elevations: tuple[float, ...] = ELEVATIONS) -> DataFrame:
    """firing, sorted (rank by elevation), phi of a sensor's lasers."""
    rank = {f: r for r, f in enumerate(sorted(range(len(elevations)), key=elevations.__getitem__))}
    return spark.createDataFrame([(f, rank[f], float(p)) for f, p in enumerate(elevations)], "firing int, sorted int, phi double")


def decode_packets(packets: DataFrame, lasers: DataFrame | None = None, keep: Column | None = None, intensities: DataFrame | None = None) -> DataFrame:
    """packet_id, block, firing, sorted, range, theta, phi, intensity, x, y, z of 1206-byte packets (packet_id, packet).

    A block has a 2-byte mark, a 2-byte angle in hundredths of a degree and 32 returns of a 2-byte range
    in 2 mm and an intensity. A laser fires after the ones before it, so the sensor has turned on; angles are kept
    below 2 pi. Packets of other sizes and blocks with another mark have no returns.

    lasers: firing, sorted, phi (without: the stock table). keep: a condition on firing, sorted, theta, range, which
    takes the place of "range is at least NEAREST". intensities: laser (sorted), raw, mapped.
    """
    p = packets.where(F.octet_length("packet") == PACKET)
    # Bytes are cut from the block and the return that they are in, as numbers once: hex text is searched from its beginning.
    part = lambda c, at, n: F.substring(c, at + 1, F.lit(n))
    number = lambda c: F.conv(F.hex(c), 16, 10).cast("int")
    low_first = lambda n: n % 256 * 256 + F.shiftright(n, 8)
    p = p.select("packet_id", "packet", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    p = p.select("packet_id", "block", part(F.col("packet"), F.col("block") * BLOCK_BYTES, BLOCK_BYTES).alias("_b"))
    turn = low_first(number(part(F.col("_b"), F.lit(2), 2))) * ANGLE_UNIT
    p = p.where(low_first(number(part(F.col("_b"), F.lit(0), 2))) == MARK).withColumn("_turn", F.when(turn >= 2 * math.pi, 0.0).otherwise(turn))
    p = p.withColumn("firing", F.explode(F.sequence(F.lit(0), F.lit(RETURNS - 1))))
    late = F.col("_turn") + SPIN_RATE * F.col("firing") * LASER_DELAY
    p = p.select("packet_id", "block", "firing", F.when(late >= 2 * math.pi, late - 2 * math.pi).otherwise(late).alias("theta"), number(part(F.col("_b"), 4 + 3 * F.col("firing"), 3)).alias("_v"))
    p = p.select("packet_id", "block", "firing", "theta", (low_first(F.shiftright("_v", 8)) * RANGE_UNIT).alias("range"), (F.col("_v") % 256).alias("intensity"))
    p = p.join(bounded(laser_table(p.sparkSession) if lasers is None else lasers, 1_000), "firing")
    p = p.where(F.col("range") >= NEAREST if keep is None else keep)
    if intensities is not None:
        remap = bounded(intensities.select(F.col("laser").alias("sorted"), F.col("raw").alias("intensity"), "mapped"), 256_000)
        p = p.join(remap, ["sorted", "intensity"], "left").withColumn("intensity", F.coalesce("mapped", "intensity")).drop("mapped")
    r, t, f = F.col("range"), F.col("theta"), F.col("phi")
    return p.select(
        "packet_id", "block", "firing", "sorted", "range", "theta", "phi", "intensity",
        (r * F.cos(t) * F.cos(f)).alias("x"), (-r * F.sin(t) * F.cos(f)).alias("y"), (r * F.sin(f)).alias("z"),
    )


def append(*clouds: DataFrame) -> DataFrame:
    """The points of several clouds, columns by name; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), clouds)


_GRID_HEAD = "<3qf6dqi"


def encode_grid(grid: DataFrame, dims: tuple[int, int, int], res: float, poses: DataFrame | None = None) -> DataFrame:
    """frame, content: each frame's sparse grid (frame, key, val) as one binary: int64 dims, float res, double pose
    of 6 (poses: frame, x, y, z, r, p, h; without: zeros), int64 time (frame), int32 count, int64 keys, float values."""
    pose = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in "xyzrph"]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        frame, key, val = t.column("frame")[0].as_py(), t.column("key").to_numpy(), t.column("val").to_numpy()
        head = struct.pack(_GRID_HEAD, *dims, res, *(t.column(c)[0].as_py() for c in "xyzrph"), frame, len(key))
        return pa.table({"frame": pa.array([frame], pa.int32()), "content": pa.array([head + key.astype("<i8").tobytes() + val.astype("<f4").tobytes()], pa.binary())})

    ship(grid.sparkSession)
    g = grid.select(F.col("frame").cast("int").alias("frame"), "key", "val")
    g = g.join(poses.select("frame", *"xyzrph"), "frame", "left") if poses is not None else g.withColumns({c: F.lit(0.0) for c in "xyzrph"})
    return g.select("frame", "key", "val", *pose).groupBy("frame").applyInArrow(run, "frame int, content binary")


def decode_grid(files: DataFrame) -> DataFrame:
    """frame, key, val from encode_grid's binaries (content)."""
    head = struct.calcsize(_GRID_HEAD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content").to_pylist():
                *_, frame, n = struct.unpack_from(_GRID_HEAD, raw)
                key = np.frombuffer(raw, "<i8", n, head)
                val = np.frombuffer(raw, "<f4", n, head + 8 * n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, frame, dtype=np.int32)), pa.array(key), pa.array(val)], ["frame", "key", "val"])

    ship(files.sparkSession)
    return files.select("content").mapInArrow(run, "frame int, key bigint, val float")


def grid_heads(files: DataFrame) -> DataFrame:
    """frame, dims, res, pose, n: a row for each of encode_grid's binaries (content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [struct.unpack_from(_GRID_HEAD, raw) for raw in b.column("content").to_pylist()]
            cols = [h[10] for h in heads], [h[:3] for h in heads], [h[3] for h in heads], [h[4:10] for h in heads], [h[11] for h in heads]
            kinds = pa.int32(), pa.list_(pa.int64()), pa.float32(), pa.list_(pa.float64()), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["frame", "dims", "res", "pose", "n"])

    ship(files.sparkSession)
    return files.select("content").mapInArrow(run, "frame int, dims array<bigint>, res float, pose array<double>, n int")


def write_trits(dense: DataFrame, path: str) -> None:
    """A folder frame=N of text files for each frame: a line of -1, 0 or 1 for every cell, in key order (dense: frame, key, val)."""
    trit = F.when(F.col("val") > 0.1, "1").when(F.col("val") < -0.1, "-1").otherwise("0")
    lines = dense.select("frame", "key", trit.alias("value")).repartitionByRange("frame", "key").sortWithinPartitions("frame", "key")
    lines.select("frame", "value").write.mode("overwrite").partitionBy("frame").text(path)


def write_flow_csv(flow: DataFrame, dims: tuple[int, int], scale: float, path: str) -> None:
    """A folder frame=N for each frame: three stacked matrices, n0 lines of n1 values: u and v times scale, then valid (flow: frame, i, j, u, v, valid)."""
    whole = F.map_from_entries(F.collect_list(F.struct("j", F.array(F.col("u") * scale, F.col("v") * scale, F.col("valid").cast("double")).alias("x"))))
    held = flow.groupBy("frame", "i").agg(whole.alias("m"))
    every = flow.select("frame").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(dims[0] - 1)))).join(held, ["frame", "i"], "left")
    every = every.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(2))))
    value = lambda j: F.coalesce(F.try_element_at("m", j)[F.col("part")], F.lit(0.0))
    shown = lambda j: F.when(F.col("part") == 2, value(j).cast("int").cast("string")).otherwise(F.format_string("%.6f", value(j)))
    lines = every.select("frame", "part", "i", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(dims[1] - 1)), shown), ",").alias("value"))
    lines.repartitionByRange("frame", "part", "i").sortWithinPartitions("frame", "part", "i").select("frame", "value").write.mode("overwrite").partitionBy("frame").text(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """log, frame, content of each image sequence up to its first gap."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return unbroken(files.select(log_of(F.col("path")).alias("log"), frame_of(F.col("path")).alias("frame"), "content"))


def encode_flow(flow: DataFrame, dims: tuple[int, int], res: float, dt: float) -> DataFrame:
    """frame, content: each frame's motion (frame, i, j, u, v, valid) as one binary: two int32 dims, float res and
    dt, then the int32 planes u, v and valid, zero where there is no row."""

    def run(t: pa.Table) -> pa.Table:
        planes = np.zeros((3, *dims), dtype="<i4")
        at = t.column("i").to_numpy(), t.column("j").to_numpy()
        for k, c in enumerate(("u", "v", "valid")):
            planes[k][at] = t.column(c).to_numpy()
        raw = struct.pack("<2i2f", *dims, res, dt) + planes.tobytes()
        return pa.table({"frame": pa.array([t.column("frame")[0].as_py()], pa.int32()), "content": pa.array([raw], pa.binary())})

    ship(flow.sparkSession)
    return flow.select(F.col("frame").cast("int").alias("frame"), "i", "j", "u", "v", "valid").groupBy("frame").applyInArrow(run, "frame int, content binary")


def decode_flow(files: DataFrame) -> DataFrame:
    """frame, i, j, u, v, valid of every cell from encode_flow's binaries (frame, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for frame, raw in zip(b.column("frame").to_pylist(), b.column("content").to_pylist(), strict=True):
                n0, n1, _, _ = struct.unpack_from("<2i2f", raw)
                planes = np.frombuffer(raw, "<i4", 3 * n0 * n1, 16).reshape(3, -1)
                i, j = (x.ravel().astype(np.int32) for x in np.indices((n0, n1)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n0 * n1, frame, dtype=np.int32), i, j, *planes)], ["frame", "i", "j", "u", "v", "valid"])

    ship(files.sparkSession)
    return files.select("frame", "content").mapInArrow(run, "frame int, i int, j int, u int, v int, valid int")
