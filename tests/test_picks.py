"""Rays and boxes in space against nested loops; loops for tracklet arrows, projected tracklets and depth fill."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeweave.functions.grid_index import GridSpec
from rangeweave.operators import depth, filters, picks, projection, tracks
from rangeweave.operators.registration import matrix_of

SPEC = GridSpec(41, 36, 10, 0.5)
BOX = "frame int, track_id int, objectType string, tx double, ty double, tz double, rx double, ry double, rz double, l double, w double, h double"


def boxes(rng, n, frames=2, turned=True):
    out = []
    for t in range(n):
        place, turn, size = rng.uniform(-12, 12, 3) * [1, 1, 0.2], rng.uniform(-0.6, 0.6, 3) * (1 if turned else [0, 0, 5]), rng.uniform(0.8, 6, 3)
        for f in range(frames):
            out.append((f, t, f"kind{t % 3}", *map(float, place + f * 0.7), *map(float, turn + f * 0.1 * turned), *map(float, size)))
    return out


def seen_from(box, p):
    m = matrix_of(np.array(box[3:9]))
    return (np.asarray(p) - m[:, 3]) @ m[:, :3]


def enters(o, d, half):
    lo, hi = 0.0, math.inf
    for a in range(3):
        if d[a] == 0:
            if abs(o[a]) > half[a]:
                return None
            continue
        s, t = sorted(((-half[a] - o[a]) / d[a], (half[a] - o[a]) / d[a]))
        lo, hi = max(lo, s), min(hi, t)
    return lo if lo <= hi else None


def test_picks_are_the_nearest_hits(spark):
    rng = np.random.default_rng(1)
    given, n = boxes(rng, 14), 160
    cells = {(f, int(i), int(j), int(k)) for f in (0, 1) for i, j, k in zip(rng.integers(0, 41, 300), rng.integers(0, 36, 300), rng.integers(0, 10, 300))}
    rays = [(int(r % 2), r, *map(float, rng.uniform(-9, 9, 3) * [1, 1, 0.3]), *map(float, rng.normal(0, 1, 3) * rng.choice([0, 1, 1, 1], 3))) for r in range(n)]
    rays = [r for r in rays if any(r[5:])] + [(0, 900, 0.0, 0.0, 50.0, 0.0, 0.0, -3.0), (1, 901, -30.0, 0.0, 0.2, 2.0, 0.0, 0.0)]
    got = {r["ray"]: r for r in picks.pick(spark.createDataFrame(rays, "frame int, ray bigint, ox double, oy double, oz double, dx double, dy double, dz double"), spark.createDataFrame(given, BOX), spark.createDataFrame(sorted(cells), "frame int, i int, j int, k int"), SPEC, 40.0).collect()}
    found = 0
    for f, ray, *v in rays:
        o, d = np.array(v[:3]), np.array(v[3:])
        hits = []
        for b in given:
            if b[0] == f and (t := enters(seen_from(b, o), d @ matrix_of(np.array(b[3:9]))[:, :3], np.array(b[9:]) / 2)) is not None:
                hits.append((t * np.linalg.norm(d), f"track:{b[1]}"))
        for g, i, j, k in cells:
            if g == f and (t := enters(o - [(i - 20) * 0.5, (j - 18) * 0.5, (k - 5) * 0.5], d, [0.1875] * 3)) is not None:
                hits.append((t * np.linalg.norm(d), f"cell:{i}:{j}:{k}"))
        hits = [h for h in hits if h[0] <= 40.0]
        assert (ray in got) == bool(hits)
        if hits:
            found += 1
            least = min(h[0] for h in hits)
            assert got[ray]["dist"] == pytest.approx(least, abs=1e-9) and got[ray]["what"] in {h[1] for h in hits if h[0] < least + 1e-9}
            assert [got[ray][c] for c in "xyz"] == pytest.approx(o + d / np.linalg.norm(d) * least)
    assert 40 < found < len(rays)


def test_tiles_of_rays_are_not_broadcast(spark, data):
    from rangeweave import catalog

    plan = catalog.ray_picks(spark, data)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [frame#" in line and ("i#" in line or "tx_#" in line)]
    assert joins and not any("BroadcastHashJoin" in line for line in joins)


def test_boxes_in_space_are_a_nested_loop(spark):
    rng = np.random.default_rng(2)
    given = boxes(rng, 12)
    points = [(int(f), *map(float, p)) for f, p in zip(rng.integers(0, 2, 900), rng.uniform(-14, 14, (900, 3)) * [1, 1, 0.25])]
    p, b = spark.createDataFrame(points, "frame int, x double, y double, z double"), spark.createDataFrame(given, BOX)
    types = {tuple(r)[:4]: r["type"] for r in tracks.object_at3(p, b).collect()}
    still = p.select("*", *(F.col(c).alias(f"{c}2") for c in "xyz"))
    moved = {tuple(r)[:4]: r for r in tracks.correspondence3(p, b, still).collect()}
    held = 0
    for point in points:
        around = [x for x in given if x[0] == point[0] and (np.abs(seen_from(x, point[1:])) < np.array(x[9:]) / 2).all()]
        assert types[point] == (min(around, key=lambda x: x[1])[2] if around else tracks.NOTHING)
        going = [x for x in around if x[0] == 0]
        r = moved[point]
        assert r["is_tracklet"] == bool(going)
        want = point[1:]
        if going:
            held += 1
            x = min(going, key=lambda x: x[1])
            (y,) = (y for y in given if y[0] == 1 and y[1] == x[1])
            m = matrix_of(np.array(y[3:9]))
            want = m[:, :3] @ seen_from(x, point[1:]) + m[:, 3]
        assert [r["x2"], r["y2"], r["z2"]] == pytest.approx(list(want))
    assert held > 20


def test_flat_boxes_are_todays_rows(spark):
    rng = np.random.default_rng(3)
    given = [(*b[:5], 0.0, 0.0, 0.0, *b[8:11], 100.0) for b in boxes(rng, 12, turned=False)]
    points = [(int(f), *map(float, p), 0.5) for f, p in zip(rng.integers(0, 2, 700), rng.uniform(-14, 14, (700, 2)))]
    p, b = spark.createDataFrame(points, "frame int, x double, y double, z double"), spark.createDataFrame(given, BOX)
    flat = tracks.object_at(p, b).collect()
    assert sorted(map(tuple, flat)) == sorted((r["frame"], r["x"], r["y"], r["type"]) for r in tracks.object_at3(p, b).collect())
    assert {r["type"] for r in flat} > {tracks.NOTHING}


def test_arrows_are_a_loop(spark):
    rng = np.random.default_rng(4)
    tracked = [(0, int(i), int(j), float(h), float(v), int(a)) for i, j, h, v, a in zip(*np.divmod(rng.permutation(400)[:150], 20), rng.uniform(-3, 3, 150), rng.uniform(0, 12, 150), rng.integers(0, 6, 150))]
    cells = [(int(f), int(i), int(j), int(k)) for f, i, j, k in zip(rng.integers(0, 2, 500), rng.integers(0, 20, 500), rng.integers(0, 20, 500), rng.integers(0, 10, 500))]
    got = filters.arrows(spark.createDataFrame(tracked, "frame int, si int, sj int, h double, v double, age int"), spark.createDataFrame(cells, "frame int, i int, j int, k int"), SPEC)
    known = {t[:3]: t[3:] for t in tracked}
    want = []
    for f, i, j, k in cells:
        if (f, i, j) in known:
            h, v, age = known[f, i, j]
            dx, dy = -0.1 * v * math.cos(h), -0.1 * v * math.sin(h)
            if age >= 3 and (abs(dx) >= 0.5 or abs(dy) >= 0.5):
                x, y, z = (i - 20) * 0.5, (j - 18) * 0.5, (k - 5) * 0.5
                want.append((f, x, y, z, x + dx, y + dy))
    assert len(want) > 10 and np.allclose(sorted(map(tuple, got.collect())), sorted(want))


def test_projected_grid_is_a_loop(spark):
    rng = np.random.default_rng(5)
    at = rng.permutation(41 * 36 * 10)[:600]
    cells = [(0, int(c // 360), int(c // 10 % 36), int(c % 10), float(v)) for c, v in zip(at, rng.choice([-0.7, 0.9, 2.0], 600))]
    motion = {(c[1], c[2]): tuple(map(float, (rng.uniform(-3, 3), rng.uniform(-6, 9), rng.uniform(-1, 1)))) for c in cells if rng.random() < 0.7}
    m = spark.createDataFrame([(0, *c, *v) for c, v in motion.items()], "frame int, i int, j int, h double, v double, w double")
    got = {(r["i"], r["j"], r["k"]): r["val"] for r in projection.project_grid(spark.createDataFrame(cells, "frame int, i int, j int, k int, val double"), m, SPEC, 0.5).collect()}
    want: dict = {}
    for _, i, j, k, val in cells:
        h, v, w = motion.get((i, j), (0.0, 0.0, 0.0))
        x, y = (i - 20) * 0.5, (j - 18) * 0.5
        for t in range(500):
            x, y = x + v * 0.001 * math.cos(h + w * 0.001 * t), y + v * 0.001 * math.sin(h + w * 0.001 * t)
        to = (round(x / 0.5) + 20, round(y / 0.5) + 18, k)
        if 0 <= to[0] < 41 and 0 <= to[1] < 36:
            want[to] = want.get(to, 0.0) + val
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in got) and len(got) > 300


def plain_fill(image, rounds):
    """The fill pixel by pixel, from its description."""
    now, before = image.tolist(), image.tolist()
    wide, high = image.shape
    for _ in range(rounds):
        new = [row[:] for row in now]
        for a in range(wide):
            for b in range(high):
                if image[a, b] > 0:
                    continue
                near = []
                for c in range(max(0, a - 1), min(wide, a + 2)):
                    for d in range(max(0, b - 1), min(high, b + 2)):
                        n = now[c][d]
                        if (c, d) != (a, b) and n > 0 and (before[a][b] < 1e-3 or n - before[a][b] < 1):
                            near.append(n)
                if near:
                    new[a][b] = sum(near) / len(near)
        before, now = now, new
    return now


def test_depth_fill_is_a_loop():
    rng = np.random.default_rng(6)
    image = np.where(rng.random((9, 11)) < 0.2, rng.uniform(2, 30, (9, 11)), 0.0)
    for rounds in (1, 4, 10):
        assert np.allclose(depth.fill_image(image.copy(), rounds), plain_fill(image, rounds))
