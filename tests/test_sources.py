"""Sources and sinks: round trips and the formats' edges."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeweave.sources import logs, scans


def test_binary_scans(spark, tmp_path):
    rng = np.random.default_rng(1)
    clouds = [rng.random((n, 4)).astype("<f4") for n in (5, 2, 7)]
    for f, c in zip((0, 1, 3), clouds, strict=True):
        (tmp_path / f"{f:010d}.bin").write_bytes(c.tobytes())
    got = scans.read_binary(spark, str(tmp_path)).orderBy("frame", "point_id").collect()
    assert [r["frame"] for r in got] == [0] * 5 + [1] * 2  # frame 2 is missing, so frame 3 is not read
    assert [r["x"] for r in got[:5]] == clouds[0][:, 0].tolist()
    assert [r["intensity"] for r in got[:5]] == (clouds[0][:, 3] * 255).astype(int).tolist()
    (tmp_path / f"{2:010d}.bin").write_bytes(clouds[1].tobytes())
    points = scans.read_binary(spark, str(tmp_path))
    back = {r["frame"]: np.frombuffer(r["content"], "<f4").reshape(-1, 4) for r in scans.encode_binary(points).collect()}
    assert np.array_equal(back[3][:, :3], clouds[2][:, :3])


def test_sequences_of_two_logs(spark, tmp_path):
    for log, frames in (("a", (0, 1, 3)), ("b", (0, 1, 2, 3)), ("c", (1,))):
        (tmp_path / log).mkdir()
        for f in frames:
            (tmp_path / log / f"{f:010d}.bin").write_bytes(np.ones((f + 1, 4), dtype="<f4").tobytes())
    got = scans.read_binary(spark, f"{tmp_path}/*").groupBy("log", "frame").count().collect()
    assert sorted((r["log"].rsplit("/", 1)[1], r["frame"], r["count"]) for r in got) == [("a", 0, 1), ("a", 1, 2), ("b", 0, 1), ("b", 1, 2), ("b", 2, 3), ("b", 3, 4)]


def test_text_scan(spark, tmp_path):
    (tmp_path / "0000000004.txt").write_text("1,2,3\n" * 3 + "4,5,6\n2\n1.5,2,3,9\n-1,0,4\n")
    got = scans.read_text(spark, str(tmp_path)).orderBy("point_id").drop("log").collect()
    assert [tuple(r) for r in got] == [(4, 0, 1.5, 2.0, 3.0), (4, 1, -1.0, 0.0, 4.0)]
    sensors = scans.read_text_sensors(spark, str(tmp_path)).orderBy("sensor").collect()
    assert [r["x_vs"] for r in sensors] == [[1.0, 2.0, 3.0]] * 3 + [[4.0, 5.0, 6.0]]


def _packet(*blocks):
    body = bytearray(1206)
    for b, angle, mark, returns in blocks:
        struct.pack_into("<HH", body, 100 * b, mark, angle)
        for laser, distance, shade in returns:
            struct.pack_into("<HB", body, 100 * b + 4 + 3 * laser, distance, shade)
    return body


def test_packets(spark):
    marked = scans.MARK
    packets = [(1, _packet((1, 9000, marked, [(5, 1000, 77), (31, 20_000, 9)]), (2, 35_999, marked, [(31, 500, 3)]), (3, 100, 0xDDFF, [(0, 900, 1)]))), (2, bytearray(512)), (3, _packet((0, 40_000, marked, [(2, 30, 8)])))]
    df = spark.createDataFrame(packets, "packet_id int, packet binary")
    got = {(r["packet_id"], r["block"], r["firing"]): r for r in scans.decode_packets(df).collect()}
    assert set(got) == {(1, 1, 5), (1, 1, 31), (1, 2, 31)}  # another mark and another size have none; 0.06 m is too near
    ranks = sorted(range(32), key=scans.ELEVATIONS.__getitem__)
    for (_, b, f), angle, distance, shade in (((1, 1, 5), 9000, 2.0, 77), ((1, 1, 31), 9000, 40.0, 9), ((1, 2, 31), 35_999, 1.0, 3)):
        r = got[1, b, f]
        t = (angle * 0.00017453293 + 0.00006283185 * f * 1.152) % (2 * np.pi)
        p = scans.ELEVATIONS[f]
        assert r["theta"] == pytest.approx(t, abs=1e-12) and r["range"] == pytest.approx(distance) and r["intensity"] == shade and ranks[r["sorted"]] == f
        assert (r["x"], r["y"], r["z"]) == pytest.approx((distance * np.cos(t) * np.cos(p), -distance * np.sin(t) * np.cos(p), distance * np.sin(p)), abs=1e-12)
    assert got[1, 2, 31]["theta"] < 0.003 and got[1, 1, 31]["x"] < -0.08  # wrapped; turned on since the block began
    near = scans.decode_packets(df, keep=(F.col("range") > 0) & (F.col("firing") < 10)).collect()
    assert {(r["packet_id"], r["firing"], r["theta"] < 0.001) for r in near} == {(1, 5, False), (3, 2, True)}


def test_intensities(spark, tmp_path):
    table = spark.range(32 * 256).selectExpr("CAST(id div 256 AS INT) laser", "CAST(id % 256 AS INT) raw", "CAST((id % 256 + id div 256) % 256 AS INT) mapped")
    logs.write_intensities(table, str(tmp_path / "cal"))
    back = logs.read_intensities(spark, str(tmp_path / "cal"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))
    df = spark.createDataFrame([(1, _packet((0, 0, scans.MARK, [(0, 1000, 7), (31, 1000, 250)])))], "packet_id int, packet binary")
    assert {r["firing"]: r["intensity"] for r in scans.decode_packets(df, intensities=back).collect()} == {0: 7, 31: (250 + 31) % 256}


def test_calibration_matrix(spark, tmp_path):
    p, r = np.arange(1.0, 13).reshape(3, 4), np.array([[0.0, 1, 0], [-1, 0, 0], [0, 0, 1]])
    (tmp_path / "cam.txt").write_text("calib_time: now\nR_rect_00: " + " ".join(map(str, r.ravel())) + "\nP_rect_02: " + " ".join(map(str, p.ravel())) + "\n")
    (tmp_path / "velo.txt").write_text("calib_time: now\nR: " + " ".join(map(str, r.T.ravel())) + "\nT: 1 2 3\n")
    got = logs.camera_matrix(logs.read_calibration(spark, str(tmp_path / "cam.txt")), logs.read_calibration(spark, str(tmp_path / "velo.txt")))
    at = p @ np.append(r @ (r.T @ [4.0, 5, 6] + [1, 2, 3]), 1)
    assert np.array(got).reshape(3, 4) @ [4, 5, 6, 1] == pytest.approx(at)


def test_matched_poses_are_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1, 4.0, 5.0, 6.0, 0.0, 0.0, 0.25), (0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.5)], "frame int, x double, y double, z double, r double, p double, h double")

    for _ in range(2):
        got = logs.matched_poses(spark, str(tmp_path / "sm"), compute).orderBy("frame").collect()
        assert [(r["frame"], r["x"], r["h"]) for r in got] == [(0, 1.0, 0.5), (1, 4.0, 0.25)]
    assert len(calls) == 1


def test_pose_messages(spark):
    rows = [(5, [1.0, 2.0, 3.0], [0.0] * 3, [1.0, 0.0, 0.0, 0.0], [0.1] * 3, [9.0] * 3)]
    df = spark.createDataFrame(rows, "utime bigint, pos array<double>, vel array<double>, orientation array<double>, rotation_rate array<double>, accel array<double>")
    sent = logs.encode_pose(df, 0x1234)
    assert sent.first()["content"][:16] == struct.pack(">Qq", 0x1234, 5)
    assert logs.decode_pose(sent, 0x1234).collect() == df.collect() and logs.decode_pose(sent, 1).count() == 0


def test_matrix_files(spark, tmp_path):
    flow = spark.createDataFrame([(0, 1, 2, 3, -1, 1), (2, 0, 0, 1, 1, 0)], "frame int, i int, j int, u int, v int, valid int")
    scans.write_flow_csv(flow, (4, 3), 0.5, str(tmp_path / "flow"))
    lines = [r["value"] for f in sorted((tmp_path / "flow" / "frame=0").glob("part*")) for r in spark.read.text(str(f)).collect()]
    zero = ",".join(["0.000000"] * 3)
    assert lines == [zero, "0.000000,0.000000,1.500000", zero, zero, zero, "0.000000,0.000000,-0.500000", zero, zero, "0,0,0", "0,0,1", "0,0,0", "0,0,0"]
    dense = spark.createDataFrame([(0, k, v) for k, v in enumerate((0.05, 3.0, -0.2, -0.1))], "frame int, key long, val double")
    scans.write_trits(dense, str(tmp_path / "trits"))
    assert [r["value"] for f in sorted((tmp_path / "trits" / "frame=0").glob("part*")) for r in spark.read.text(str(f)).collect()] == ["0", "1", "-1", "0"]


def test_grid_files(spark):
    grid = spark.createDataFrame([(0, 7, 1.5), (0, 3, -0.5), (2, 9, 3.0)], "frame int, key bigint, val double")
    back = scans.decode_grid(scans.encode_grid(grid, (167, 167, 14), 0.3))
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in grid.collect())
    poses = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 0.1, 0.2, 0.3)], "frame int, x double, y double, z double, r double, p double, h double")
    heads = {r["frame"]: r for r in scans.grid_heads(scans.encode_grid(grid, (167, 167, 14), 0.5, poses)).collect()}
    assert heads[0]["pose"] == [1.0, 2.0, 3.0, 0.1, 0.2, 0.3] and heads[2]["pose"] == [0.0] * 6 and heads[0]["dims"] == [167, 167, 14] and heads[0]["n"] == 2 and heads[0]["res"] == 0.5


def test_text_logs(spark, tmp_path):
    d = tmp_path / "oxts"
    d.mkdir()
    for f in (0, 1):
        (d / f"{f:010d}.txt").write_text(" ".join(str(f + k / 4) for k in range(25)) + " 4 8 4 4 0")
    r = logs.read_positions(spark, str(d)).orderBy("frame").collect()
    assert r[1]["lat"] == 1.0 and r[1]["velacc"] == 7.0 and r[0]["numsats"] == 8
    (tmp_path / "sm.txt").write_text("1 2 3 0 0 0.5\n4 5 6 0 0 0.25\n")
    assert [x["h"] for x in logs.read_matched_poses(spark, str(tmp_path / "sm.txt")).orderBy("frame").collect()] == [0.5, 0.25]
    (tmp_path / "calib.txt").write_text("calib_time: now\nP_rect_02: 1 2 3\nR: 4.5 -1\n")
    assert {x["name"]: x["numbers"] for x in logs.read_calibration(spark, str(tmp_path / "calib.txt")).collect()} == {"P_rect_02": [1, 2, 3], "R": [4.5, -1]}
    (tmp_path / "wf.csv").write_text(",".join(str(k) for k in range(350)))
    w = {(x["di"], x["dj"], x["k"]): x["w"] for x in logs.read_weights(spark, str(tmp_path / "wf.csv")).collect()}
    assert w[-2, -2, 3] == 3 and w[2, 2, 13] == 349 and w[0, -1, 0] == 2 * 70 + 14


def test_track_files(spark, tmp_path):
    pose = F.struct(*(F.lit(1.5).alias(c) for c in ("tx", "ty", "tz", "rx", "ry", "rz")), *(F.lit(2).alias(c) for c in ("state", "occlusion", "occlusion_kf", "truncation")))
    one = spark.range(2).select(F.col("id").cast("int").alias("track_id"), F.lit("Car").alias("objectType"), *(F.lit(1.0).alias(c) for c in "hwl"), F.lit(3).alias("first_frame"), F.lit(1).alias("finished"), F.array(pose, pose).alias("poses"))
    logs.write_tracks(one, str(tmp_path / "t"))
    got = logs.read_tracks(spark, str(tmp_path / "t")).orderBy("track_id").collect()
    assert [r["track_id"] for r in got] == [0, 1] and got[0]["objectType"] == "Car" and len(got[1]["poses"]) == 2
    assert got[1]["poses"][0]["tx"] == 1.5 and got[0]["first_frame"] == 3
    assert got[1]["poses"][0]["occlusion"] == 2 and got[1]["poses"][0]["amt_border_l"] == -1.0


def test_pose_stream_equals_batch(spark, data, tmp_path):
    from rangeweave.operators.filters import filter_poses
    from rangeweave.plans.fixtures import pose_observations
    from rangeweave.streaming import pose_stream

    seen = pose_observations(spark, data).where("key < 5")
    for k, cond in enumerate(("seq <= 20", "seq > 20")):
        seen.where(cond).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    out = pose_stream.filter_stream(pose_stream.read_observations(spark, str(tmp_path / "in")))
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r["key"], r["seq"]): r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["key"], r["seq"]): r["x"] for r in filter_poses(seen).collect()}
    assert got == pytest.approx(want)


def test_flow_files_and_images(spark, tmp_path):
    flow = spark.createDataFrame([(0, 1, 2, 3, -1, 1), (0, 4, 0, 0, 0, 0), (5, 0, 0, -2, 2, 1)], "frame int, i int, j int, u int, v int, valid int")
    back = scans.decode_flow(scans.encode_flow(flow, (5, 3), 0.3, 0.1))
    assert back.count() == 30
    assert sorted(tuple(r) for r in back.where("valid = 1").collect()) == sorted(tuple(r) for r in flow.where("valid = 1").collect())
    for f in (0, 1, 3):
        (tmp_path / f"{f:010d}.png").write_bytes(bytes([f, 1]))
    assert sorted(r["frame"] for r in scans.read_images(spark, str(tmp_path)).collect()) == [0, 1]
