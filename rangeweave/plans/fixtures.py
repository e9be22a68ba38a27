"""Scan, pose, track and model views derived from the star-schema tables.

Each view is one select list (or statement) in SQL that Spark and DuckDB read alike, so queries and
their oracles start from the same rows. Integer arithmetic is kept until the last scaling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.functions.grid_index import GridSpec

SPEC = GridSpec()
FRAMES = 3
#: Projection of the fixture camera (vehicle x ahead, y left, z up), row-major 3x4.
CAMERA = [609.0, -721.0, 0.0, 44.0, 172.0, 0.0, -721.0, 0.0, 1.0, 0.0, 0.0, 0.0]

RAW_SCAN = "CAST(l_linenumber AS INT) AS frame, l_quantity - 25.5 AS x, (l_suppkey % 50) - 24.5 AS y, l_tax * 40 - 1.7 AS z"
#: Orders of one drive, and their share of suppliers; frames of different drives never follow each other.
DRIVE_ORDERS, DRIVE_SUPPLIERS, DRIVE_FRAMES = 32_768, 218, 16
DRIVE = f"CAST(l_orderkey DIV_ {DRIVE_ORDERS} AS INT) AS drive"
#: Frame f of a drive.
FRAME = f"CAST(drive * {DRIVE_FRAMES} + f AS INT) AS frame"
#: Frames of scan_cells that have a next one.
FOLLOWED = f"frame % {DRIVE_FRAMES} < {FRAMES - 1}"
BASE_CELL = DRIVE + (
    ", CAST(20 + (l_partkey * 7919) % 127 AS INT) AS i0, CAST(20 + (l_orderkey * 104729 + l_suppkey) % 127 AS INT) AS j0, "
    "CAST(l_linenumber + 2 AS INT) AS k"
)
MOVE = "CAST(i0 + 2 * f AS INT) AS i, CAST(j0 - f AS INT) AS j"
OBSERVED = (
    "user_id AS key, event_id, ts, value / 50 AS y, (event_id % 628) / CAST(100 AS DOUBLE) - CAST(3.14 AS DOUBLE) AS h, value / 50 AS v_f, CAST(0.01 AS DOUBLE) AS v_h, value"
)
#: A pose in space of every observation, and a step from it to the next.
FULL_POSE = "key, seq, x, y, CAST(0.01 * seq AS DOUBLE) AS z, CAST(h / 10 AS DOUBLE) AS r, CAST(-h / 20 AS DOUBLE) AS p, h"
FULL_MOVE = "key, seq, v_f / 10 AS x, v_f / 40 AS y, CAST(0.02 * h AS DOUBLE) AS z, CAST(0.01 * h AS DOUBLE) AS r, CAST(-0.02 * h AS DOUBLE) AS p, CAST(0.05 * h AS DOUBLE) AS h"
POSITIONS = (
    "CAST(o_custkey % 20 AS INT) AS log, o_orderkey AS frame, CAST(49 + (o_custkey % 1000) * 0.0001 AS DOUBLE) AS lat, CAST(8.4 + (o_orderkey % 1000) * 0.0001 AS DOUBLE) AS lon, "
    "CAST(0 AS DOUBLE) AS alt, CAST(0 AS DOUBLE) AS roll, CAST(0 AS DOUBLE) AS pitch, (o_orderkey % 628) / CAST(100 AS DOUBLE) - CAST(3.14 AS DOUBLE) AS yaw, CAST(1 AS DOUBLE) AS vf, CAST(0 AS DOUBLE) AS wu"
)
TRACKS = (
    "s_suppkey AS track_id, CAST(((s_suppkey * 37) % 83 - 41) + 0.6 * f AS DOUBLE) AS tx, CAST(((s_suppkey * 53) % 83 - 41) - 0.3 * f AS DOUBLE) AS ty, "
    "CAST((s_suppkey % 7) * 0.4 AS DOUBLE) AS rz, CAST(4.5 AS DOUBLE) AS l, CAST(2.0 AS DOUBLE) AS w, "
    "CASE s_nationkey % 3 WHEN 0 THEN 'Car' WHEN 1 THEN 'Pedestrian' ELSE 'Cyclist' END AS objectType"
)
#: Tracks as boxes in space, and from over the vehicle a ray past each of them.
BOX = (
    "CAST(0.3 * (track_id % 5) - 0.6 AS DOUBLE) AS tz, CAST(0.1 * (track_id % 3) - 0.1 AS DOUBLE) AS rx, CAST(0.05 * (track_id % 4) AS DOUBLE) AS ry, "
    "CAST(1.6 AS DOUBLE) AS h"
)
RAY = (
    "frame, CAST(track_id AS BIGINT) * 1000 + frame AS ray, CAST(0 AS DOUBLE) AS ox, CAST(0 AS DOUBLE) AS oy, CAST(1.73 AS DOUBLE) AS oz, "
    "CAST(tx + (track_id % 4) * 0.3 AS DOUBLE) AS dx, CAST(ty AS DOUBLE) AS dy, CAST(-1.6 - (track_id % 3) * 0.1 AS DOUBLE) AS dz"
)
WF = "(((di + 2) * 31 + (dj + 2) * 17 + k * 7) % 41) - 20"
WO = "(((di + 2) * 13 + (dj + 2) * 29 + k * 11) % 61) - 30"
LEVEL_WEIGHT = "40 + (k * 7) % 21"
LEVEL_WEIGHTS = [40 + (k * 7) % 21 for k in range(SPEC.n2)]
#: The scans of a drive are the line numbers.
DRIVE_SCAN = f"CAST(l_orderkey DIV_ {DRIVE_ORDERS} * {DRIVE_FRAMES} + l_linenumber AS INT) AS frame, " + RAW_SCAN.split(", ", 1)[1]
#: Offset of the column match and of the background filter, in hundredths.
MATCH_OFFSET, FILTER_OFFSET = -141, -20
#: Of the background filter on the traced grids of the drives, which have many more free cells.
DRIVE_FILTER_OFFSET = 40
#: The vehicle's place in frame f of a drive is (0.3 f, 0, 0.01 f).
POSE = "CAST(0.3 * f AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(0.01 * f AS DOUBLE) AS h"
SUPPLIER_DRIVE = f"*, CAST(s_suppkey DIV_ {DRIVE_SUPPLIERS} AS INT) AS drive"


#: Of the vehicle in the frames of raw_scan.
FRAME_POSE = (
    "frame, CAST(0.3 AS DOUBLE) * frame AS x, CAST(-0.2 AS DOUBLE) * frame AS y, CAST(0.05 AS DOUBLE) AS z, CAST(0.01 AS DOUBLE) AS r, CAST(-0.02 AS DOUBLE) AS p, CAST(0.03 AS DOUBLE) * frame AS h"
)
#: The items of 64 orders, in order, fill packets of 384 returns.
PACKET_ITEM = "l_orderkey DIV_ 64 AS g, row_number() OVER (PARTITION BY l_orderkey DIV_ 64 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS n, (l_partkey * 31 % 65536) * 256 + l_suppkey % 256 AS v"
PACKET_SLOT = "CAST(g * 1000 + n DIV_ 384 AS BIGINT) AS packet_id, CAST(n % 384 AS BIGINT) AS slot, CAST(v AS BIGINT) AS v"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(text: str) -> list[str]:
    out, depth, item = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item.strip())
            item = ""
        else:
            item += c
    return [*out, item.strip()]


def pick(df: DataFrame, *lists: str) -> DataFrame:
    return df.selectExpr(*(x.replace("DIV_", "div") for text in lists for x in _items(text)))


def _frames(df: DataFrame, n: int = FRAMES) -> DataFrame:
    return df.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(table(spark, sf_dir, "lineitem"), RAW_SCAN)


def drive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_scan in drives: the more orders, the more drives, each of up to 7 frames."""
    return pick(table(spark, sf_dir, "lineitem"), DRIVE_SCAN)


def frame_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, z, r, p, h of every frame of raw_scan."""
    return pick(table(spark, sf_dir, "lineitem").selectExpr("CAST(l_linenumber AS INT) AS frame").distinct(), FRAME_POSE)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packet_id, packet: every line item as a return, 384 in a packet of 1206 bytes, the packets of 64 orders by themselves."""
    slots = pick(pick(table(spark, sf_dir, "lineitem"), PACKET_ITEM), PACKET_SLOT)
    # Slots are numbered without a gap, so an array in their order has each at its number.
    held = slots.groupBy("packet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "v"))), lambda x: x["v"]).alias("m"))

    def ret(slot):
        v = F.coalesce(F.get("m", slot), F.lit(0).cast("long"))
        raw = F.shiftright(v, 8)
        return F.lpad(F.hex(raw % 256 * 65536 + F.shiftright(raw, 8) * 256 + v % 256), 6, "0")

    def block(b):
        angle = (F.col("packet_id") * 97 + b * 40) % 36000
        return F.concat(F.lit("FFEE"), F.lpad(F.hex(angle % 256 * 256 + F.shiftright(angle, 8)), 4, "0"), F.array_join(F.transform(F.sequence(b * 32, b * 32 + 31), ret), ""))

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), block), "")
    return held.select("packet_id", F.unhex(F.concat(body, F.lit("00" * 6))).alias("packet"))


def scan_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, i, j, k of occupied cells with a planted motion of (2, -1) cells a frame: of every drive, three frames."""
    base = pick(table(spark, sf_dir, "lineitem"), BASE_CELL).distinct()
    return pick(_frames(base), FRAME, "k", MOVE).select("frame", "i", "j", "k")


def valued_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_cells with val: occupied, or free where a checker pattern says so."""
    return scan_cells(spark, sf_dir).selectExpr("frame", "i", "j", "k", "CASE WHEN (i + j + k) % 3 = 0 THEN -0.5 ELSE 1.0 END AS val").withColumn("val", F.col("val").cast("double"))


def pose_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = pick(table(spark, sf_dir, "events"), OBSERVED)
    seq = F.row_number().over(Window.partitionBy("key").orderBy("ts", "event_id")).cast("long")
    return rows.withColumn("seq", seq).selectExpr("key", "seq", "seq * value / 100 AS x", "y", "h", "v_f", "v_h")


def full_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(pose_observations(spark, sf_dir), FULL_POSE)


def full_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(pose_observations(spark, sf_dir), FULL_MOVE)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(table(spark, sf_dir, "orders"), POSITIONS)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(_frames(pick(table(spark, sf_dir, "supplier"), SUPPLIER_DRIVE)), FRAME, TRACKS)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(tracks(spark, sf_dir), "*", BOX)


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(tracks(spark, sf_dir).where("tx <> 0 OR ty <> 0"), RAY)


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, h of the vehicle in the frames that each drive's scans have and one more."""
    return pick(_frames(pick(table(spark, sf_dir, "lineitem"), DRIVE).distinct(), FRAMES + 1), FRAME, POSE)


def _grid_of(spark: SparkSession, sf_dir: str, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    df = table(spark, sf_dir, "region").limit(1).select(F.lit(1).alias("_"))
    for c, (a, b) in ranges.items():
        df = df.withColumn(c, F.explode(F.sequence(F.lit(a), F.lit(b))))
    return df.drop("_")


def bg_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(_grid_of(spark, sf_dir, {"di": (-2, 2), "dj": (-2, 2), "k": (0, 13)}), f"di, dj, k, {WF} AS wf, {WO} AS wo")


def level_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(_grid_of(spark, sf_dir, {"k": (0, 13)}), f"k, {LEVEL_WEIGHT} AS wo")


def _times(n: int) -> str:
    return f"(SELECT CAST(t AS INT) AS f FROM range({n}) r(t))"


# The same views for DuckDB.
SQL = {
    "raw_scan": f"SELECT {RAW_SCAN} FROM lineitem",
    "drive_scan": f"SELECT {DRIVE_SCAN} FROM lineitem",
    "frame_poses": f"SELECT {FRAME_POSE} FROM (SELECT DISTINCT CAST(l_linenumber AS INT) AS frame FROM lineitem)",
    "slots": f"SELECT {PACKET_SLOT} FROM (SELECT {PACKET_ITEM} FROM lineitem)",
    "boxes": f"SELECT *, {BOX} FROM tracks",
    "rays": f"SELECT {RAY} FROM tracks WHERE tx <> 0 OR ty <> 0",
    "scan_cells": f"SELECT {FRAME}, {MOVE}, k FROM (SELECT DISTINCT {BASE_CELL} FROM lineitem) CROSS JOIN {_times(FRAMES)}",
    "valued_cells": "SELECT *, CAST(CASE WHEN (i + j + k) % 3 = 0 THEN -0.5 ELSE 1.0 END AS DOUBLE) AS val FROM scan_cells",
    "pose_obs": f"SELECT key, seq, seq * value / 100 AS x, y, h, v_f, v_h FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS seq FROM (SELECT {OBSERVED} FROM events))",
    "full_poses": f"SELECT {FULL_POSE} FROM pose_obs",
    "full_moves": f"SELECT {FULL_MOVE} FROM pose_obs",
    "positions": f"SELECT {POSITIONS} FROM orders",
    "tracks": f"SELECT {FRAME}, {TRACKS} FROM (SELECT {SUPPLIER_DRIVE} FROM supplier) CROSS JOIN {_times(FRAMES)}",
    "poses": f"SELECT {FRAME}, {POSE} FROM (SELECT DISTINCT {DRIVE} FROM lineitem) CROSS JOIN {_times(FRAMES + 1)}",
    "bg_model": f"SELECT di, dj, k, {WF} AS wf, {WO} AS wo FROM (SELECT CAST(a - 2 AS INT) AS di, CAST(b - 2 AS INT) AS dj, CAST(c AS INT) AS k FROM range(5) x(a), range(5) y(b), range(14) z(c))",
    "level_weights": f"SELECT k, {LEVEL_WEIGHT} AS wo FROM (SELECT CAST(c AS INT) AS k FROM range(14) z(c))",
}


def with_views(query: str, *names: str, **more: str) -> str:
    """A statement with the named views, and more, before it."""
    parts = [f"{n} AS ({SQL[n].replace('DIV_', '//')})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {query}"
