"""PNG decoding, patches with pixels and binary match rows."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeweave.functions.grid_index import GridSpec
from rangeweave.plans.fixtures import CAMERA
from rangeweave.sources import images, match_file

SPEC = GridSpec(167, 167, 14, 0.3)


def png(pixels, kind=2, filters=(0, 1, 2, 3, 4), palette=None):
    """A PNG of pixels [height, width, channels], with rows filtered in turn."""
    high, wide, n = pixels.shape
    out, above = b"", np.zeros((wide, n), dtype=np.int32)
    for y in range(high):
        f, row = filters[y % len(filters)], pixels[y].astype(np.int32)
        left = np.vstack([np.zeros((1, n), dtype=np.int32), row[:-1]])
        corner = np.vstack([np.zeros((1, n), dtype=np.int32), above[:-1]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * row, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][f]
        out += bytes([f]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = zlib.compress(out)
    parts = [chunk(b"IHDR", struct.pack(">2I5B", wide, high, 8, kind, 0, 0, 0))] + ([chunk(b"PLTE", palette.tobytes())] if palette is not None else [])
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts) + chunk(b"IDAT", data[:50]) + chunk(b"IDAT", data[50:]) + chunk(b"IEND", b"")


def test_png():
    rng = np.random.default_rng(0)
    rgba = rng.integers(0, 256, (11, 9, 4), dtype=np.uint8)
    assert (images.decode_png(png(rgba[..., :3])) == rgba[..., :3]).all()
    assert (images.decode_png(png(rgba, 6)) == rgba[..., :3]).all()
    assert (images.decode_png(png(rgba[..., :1], 0)) == rgba[..., :1]).all()
    assert (images.decode_png(png(rgba[..., :2], 4)) == rgba[..., :1]).all()
    palette = rng.integers(0, 256, (256, 3), dtype=np.uint8)
    assert (images.decode_png(png(rgba[..., :1], 3, palette=palette)) == palette[rgba[..., 0]]).all()
    for bad in (b"no", png(rgba[..., :3]).replace(b"\x08\x02\x00\x00\x00", b"\x10\x02\x00\x00\x00", 1)):
        with pytest.raises(ValueError):
            images.decode_png(bad)


def plain_patch(i, j, image, depth, across, up):
    m = np.array(CAMERA).reshape(3, 4)
    out = np.zeros((across, up, 4), dtype=np.uint8)
    for a in range(across):
        for b in range(up):
            p = np.array([(i - 83) * 0.3 - 0.15, (j - 83) * 0.3 - 0.15 + (a + 0.5) * 0.3 / across, (b + 0.5) * 4.2 / up - 2.1, 1.0])
            u, v, d = m @ p
            out[a, b, 3] = 255
            if d > 0:
                w, h = (int(np.sign(x) * np.floor(abs(x) + 0.5)) for x in (u / d, v / d))
                if 0 <= w < image.shape[1] and 0 <= h < image.shape[0]:
                    out[a, b, :3] = image[max(h - 1, 0), w]
                    if depth.get((w, h), 0.0) >= 1e-3:
                        e = (depth[w, h] - d) * 100
                        out[a, b, 3] = min(255, max(0, int(np.sign(e) * np.floor(abs(e) + 0.5)) + 127))
    return out.tobytes()


@pytest.mark.parametrize(("across", "up", "n"), [(16, 224, 12), (5, 7, 60)])
def test_patches_are_a_plain_loop(spark, across, up, n):
    rng = np.random.default_rng(1)
    pixels = [rng.integers(0, 256, (375, 1242, 3), dtype=np.uint8) for _ in range(2)]
    shots = spark.createDataFrame([(f, bytearray(png(p, filters=(1, 2)))) for f, p in enumerate(pixels)], "frame int, content binary")
    columns = sorted({(int(f), int(i), int(j)) for f, i, j in zip(rng.integers(0, 2, n), rng.integers(70, 167, n), rng.integers(40, 130, n))} | {(0, 166, 83), (1, 95, 84)})
    depths = [{(int(w), int(h)): float(d) for w, h, d in zip(rng.integers(0, 1242, 90_000), rng.integers(0, 375, 90_000), rng.uniform(1, 25, 90_000))} for _ in range(2)]
    known = spark.createDataFrame([(f, w, h, d) for f in range(2) for (w, h), d in depths[f].items()], "frame int, w int, h int, depth double")
    got = images.patches(spark.createDataFrame(columns, "frame int, i int, j int"), images.tiles(shots), known, CAMERA, SPEC, 1242, 375, across, up)
    rows = {(r["frame"], r["i"], r["j"]): bytes(r["content"]) for r in got.collect()}
    assert set(rows) == set(columns) and {len(x) for x in rows.values()} == {across * up * 4}
    for f, i, j in columns:
        assert rows[f, i, j] == plain_patch(i, j, pixels[f], depths[f], across, up)
    assert sum(len(set(x)) > 2 for x in rows.values()) > 3


def records(folder, size):
    raw = b"".join(open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if n.endswith(".bin"))
    assert len(raw) % size == 0
    return sorted(raw[k : k + size] for k in range(0, len(raw), size))


def test_match_rows(spark, tmp_path):
    match_file.register(spark)
    rng = np.random.default_rng(2)
    levels = [(0, i, 3, i + 1, 4, i % 2, [float(x) for x in rng.random(14)], [0.5] * 14) for i in range(20)]
    held = [(f, i, j, bytearray(rng.bytes(16 * 224 * 4))) for f, j in ((0, 3), (1, 4)) for i in range(19)]
    both = match_file.with_patches(
        spark.createDataFrame(levels, "frame int, i int, j int, i2 int, j2 int, label int, p1 array<double>, p2 array<double>"),
        spark.createDataFrame(held, "frame int, i int, j int, content binary"),
    )
    out = str(tmp_path / "rows")
    both.repartition(4).write.format("match_rows").mode("append").save(out)
    patch = {(f, i, j): bytes(c) for f, i, j, c in held}
    want = []
    for f, i, j, i2, j2, label, p1, p2 in levels:
        if (f, i, j) in patch and (f + 1, i2, j2) in patch:
            want.append(struct.pack("<14f", *p1) + patch[f, i, j] + struct.pack("<14f", *p2) + patch[f + 1, i2, j2] + struct.pack("<i", label))
    assert len(want) == 18 and records(out, 28_788) == sorted(want)
    both.limit(3).write.format("match_rows").mode("append").save(out)
    assert len(records(out, 28_788)) == 21
    with pytest.raises(Exception, match="new one instead"):
        both.write.format("match_rows").mode("overwrite").save(out)
    # A job that fails leaves what was there.
    bad = both.withColumn("patch1", F.when(F.col("label") == 1, F.lit(b"short")).otherwise(F.col("patch1"))).coalesce(1)
    with pytest.raises(Exception, match="a record of"):
        bad.write.format("match_rows").mode("append").save(out)
    assert len(records(out, 28_788)) == 21


def test_retried_tasks_leave_no_half_file(tmp_path):
    import pyarrow as pa

    row = {"p1": [0.5, 1.0], "patch1": b"ab", "p2": [0.0, 0.25], "patch2": b"cd", "label": 7}
    batch = pa.RecordBatch.from_pylist([row] * 3)

    def broken():
        yield batch
        raise OSError("lost")

    w = match_file.MatchWriter(str(tmp_path / "out"))
    with pytest.raises(OSError):
        w.write(broken())
    again, other = w.write(iter([batch])), w.write(iter([]))
    w.commit([again, other, None])
    assert len(records(tmp_path / "out", 24)) == 3 and os.listdir(tmp_path / "out/_writing") == []
    w = match_file.MatchWriter(str(tmp_path / "out"))
    w.abort([w.write(iter([batch]))])
    assert len(records(tmp_path / "out", 24)) == 3
