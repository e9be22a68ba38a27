"""Bucketed grid stores and the scan data source."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeweave import catalog
from rangeweave.operators import gridstore, occupancy
from rangeweave.sources import scan_source, scans


@pytest.fixture(scope="module")
def grid(spark, data):
    return catalog._grid(spark, data).select("frame", "key", "n_free", "n_occ", "val").cache()


def rows(df):
    return sorted((r["key"], r["n_free"], r["n_occ"], float(r["val"])) for r in df.collect())


def test_store_merges_without_a_shuffle(spark, grid, tmp_path):
    gridstore.open_store(spark, "grids_a", str(tmp_path / "g"), 8)
    gridstore.add(grid.where("frame < 4"), "grids_a", 2)
    gridstore.add(grid.where("frame >= 4"), "grids_a", 2)
    got = gridstore.merged(spark, "grids_a")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    want = rows(occupancy.merge(grid))
    assert rows(got) == want
    # Adding a block again changes nothing; blocks can be taken in part; another session finds what is there.
    gridstore.add(grid.where("frame in (2, 3)"), "grids_a", 2)
    assert rows(gridstore.merged(spark, "grids_a")) == want
    part = gridstore.merged(spark, "grids_a", 1, 2)
    assert rows(part) == rows(occupancy.merge(grid.where("frame BETWEEN 2 AND 5")))
    assert "PartitionFilters: [isnotnull(block" in part._jdf.queryExecution().executedPlan().toString()
    gridstore.open_store(spark, "grids_b", str(tmp_path / "g"), 8)
    assert rows(gridstore.merged(spark, "grids_b")) == want
    gridstore.compact(spark, "grids_a", 0, 2)
    assert [r["block"] for r in spark.table("grids_a").select("block").distinct().orderBy("block").collect()] == [0, 3]
    assert rows(gridstore.merged(spark, "grids_a")) == want
    gridstore.compact(spark, "grids_a", 0, 0)
    assert rows(gridstore.merged(spark, "grids_a")) == want


def test_empty_store(spark, grid, tmp_path):
    gridstore.open_store(spark, "grids_c", str(tmp_path / "g"), 4)
    gridstore.add(grid.limit(0), "grids_c")
    assert gridstore.merged(spark, "grids_c").count() == 0


def write(folder, frame, n=3, size=None):
    os.makedirs(folder, exist_ok=True)
    p = np.arange(4 * n, dtype="<f4").reshape(n, 4) / 7 + frame
    p[:, 3] = 0.5
    with open(f"{folder}/{frame:010d}.bin", "wb") as f:
        f.write(p.tobytes()[:size])


@pytest.fixture
def logs(tmp_path):
    top = str(tmp_path / "logs")
    for frame in range(7):
        write(f"{top}/a/data", frame, 3 + frame)
    for frame in (0, 1, 3, 4):
        write(f"{top}/b/data", frame)
    write(f"{top}/c/data", 0)
    write(f"{top}/c/data", 1, size=0)
    write(f"{top}/c/data", 2)
    write(f"{top}/d/data", 1)
    return top


def scan_rows(df):
    return sorted(tuple(r) for r in df.select("frame", "point_id", "x", "y", "z", "intensity").collect())


def test_source_reads_what_the_reader_reads(spark, logs):
    scan_source.register(spark)
    got = spark.read.format("range_scans").option("frames", 2).load(logs)
    assert scan_rows(got) == scan_rows(scans.read_binary(spark, f"{logs}/*/data"))
    assert got.select("log", "frame").distinct().count() == 7 + 2 + 1
    assert spark.read.format("range_scans").load(f"{logs}/d").count() == 0


def test_source_opens_the_files_that_are_asked_for(spark, logs):
    scan_source.register(spark)
    all_rows = spark.read.format("range_scans").load(logs)
    reader = scan_source.ScanReader(logs, 16)
    left = list(reader.pushFilters([scan_source.GreaterThan(("frame",), 2), scan_source.LessThanOrEqual(("frame",), 4), scan_source.EqualTo(("x",), 1.0)]))
    assert [f.attribute for f in left] == [("x",)]
    assert [(r.first, len(r.files)) for r in reader.partitions()] == [(3, 2)]
    got = all_rows.where((F.col("frame") > 2) & (F.col("frame") <= 4) & F.col("log").endswith("a/data"))
    assert sorted({r["frame"] for r in got.collect()}) == [3, 4]
    assert got.rdd.getNumPartitions() == 1


def test_source_streams_up_to_the_first_gap(spark, tmp_path):
    scan_source.register(spark)
    top, out, mark = (str(tmp_path / n) for n in ("logs", "out", "mark"))

    def run():
        q = spark.readStream.format("range_scans").load(top).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return sorted(tuple(r) for r in spark.read.schema(scan_source.SCHEMA).parquet(out).selectExpr("right(log, 1)", "frame").distinct().collect())

    write(f"{top}/a", 0)
    write(f"{top}/a", 2)
    write(f"{top}/b", 1)
    assert run() == [("a", 0)]
    write(f"{top}/a", 1)
    assert run() == [("a", 0), ("a", 1), ("a", 2)]
    write(f"{top}/b", 0)
    write(f"{top}/a", 4)
    assert run() == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert spark.read.schema(scan_source.SCHEMA).parquet(out).count() == 15
