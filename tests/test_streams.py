"""Streams against their batch forms: frames split over micro-batches, out of order, restarts, ended sequences."""

import random
import time

import pytest

from rangeweave.operators import filters
from rangeweave.streaming import tracklet_stream as ts


def motions(rng):
    rows = []
    for s in (1, 2, 7):
        for f in (0, 1, 2, 3, 5, 6, 7):
            taken = set()
            for _ in range(40):
                i, j, u, v = rng.randrange(20), rng.randrange(20), rng.randrange(-1, 3), rng.randrange(-1, 2)
                if (i, j) not in taken and (i + u, j + v, "to") not in taken:
                    taken |= {(i, j), (i + u, j + v, "to")}
                    rows.append((s, f, i, j, u, v, int(rng.random() < 0.9)))
    return rows


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    ts.use_rocksdb(spark)
    yield
    spark.conf.set(name, old)


def until_read(q, n, more=lambda: True, seconds=60):
    """Waits for n rows (timers keep such a query in motion, so it never becomes idle), then stops it."""
    end = time.time() + seconds
    while time.time() < end and not (sum(p["numInputRows"] for p in q.recentProgress) >= n and more()):
        assert q.isActive, q.exception()
        time.sleep(0.2)
    q.stop()


def rounded(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_streamed_tracklets_are_the_batch_ones(spark, tmp_path, rocksdb):
    rng = random.Random(8)
    rows = motions(rng)
    # Frames are split at random and swapped with their neighbours: what comes is at most one frame behind.
    parts = {}
    for r in rows:
        parts.setdefault(r[1] + rng.choice([0, 0, 1]), []).append(r)
    inputs, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def put(k):
        spark.createDataFrame(parts[k], ts.MOTION).coalesce(1).write.mode("append").parquet(inputs)

    def run(idle, n, more=lambda: True):
        found = ts.follow_stream(ts.read_motions(spark, inputs), 0.3, (40, 40), lag=2, idle=idle)
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").start()
        until_read(q, n, more)

    # Every run but the first is a restart, with frames waiting.
    def found():
        return spark.read.schema(ts.FOLLOWED).parquet(out).select(*spark.createDataFrame([], ts.FOLLOWED).columns)

    want = rounded(filters.tracklets(spark.createDataFrame(rows, ts.MOTION), 0.3, (40, 40)))
    order = sorted(parts)
    for k in order:
        put(k)
        last = k == order[-1]
        run(1 if last else 10**8, len(parts[k]), (lambda: found().count() >= len(want)) if last else (lambda: True))
    got = rounded(found())
    assert got == want and max(r[-1] for r in got) >= 2


def test_late_rows_are_left_out(spark, tmp_path, rocksdb):
    inputs = str(tmp_path / "in")
    found = []

    def put(*rows):
        spark.createDataFrame([(1, f, i, 5, 1, 0, 1) for f, i in rows], ts.MOTION).coalesce(1).write.mode("append").parquet(inputs)

    for rows in ([(0, 3)], [(1, 4)], [(0, 9), (2, 5)], [(3, 6), (1, 8)]):
        put(*rows)
        q = ts.follow_stream(ts.read_motions(spark, inputs), 0.3, (40, 40), lag=1, idle=10**8).writeStream.outputMode("append")
        q = q.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "mark")).start()
        until_read(q, len(rows))
    assert [(r[1], r[2], r[-1]) for r in sorted(found)] == [(0, 3, 0), (1, 4, 1), (2, 5, 2)]


def test_windowed_counts_are_the_batch_ones(spark, tmp_path):
    from pyspark.sql import functions as F

    from rangeweave.streaming.pose_stream import windowed_counts

    inputs, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (0, 20, 40, 600):  # the last file moves the watermark on
        spark.range(n, n + 20).selectExpr("timestamp_seconds(id * 7) AS ts").coalesce(1).write.mode("append").parquet(inputs)
    seen = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(inputs)
    q = windowed_counts(seen, "ts", "1 minute", "10 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {r["start"]: r["n"] for r in spark.read.parquet(out).collect()}
    want = {r["start"]: r["n"] for r in spark.read.parquet(inputs).groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n")).select("w.start", "n").collect()}
    assert len(got) >= 7 and all(want[k] == n for k, n in got.items())
