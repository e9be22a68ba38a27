"""Registered queries against their DuckDB statements on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rangeweave import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    rel = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(cols).collect())
    want = sorted(tuple(map(plain, r)) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall())
    assert got and got == want


def test_planted_motion(spark, data):
    rows = catalog.flow_solve(spark, data).where("valid = 1").groupBy("u", "v").count().orderBy("count", ascending=False).collect()
    assert (rows[0]["u"], rows[0]["v"]) == (2, -1)
    assert rows[0]["count"] > 0.7 * sum(r["count"] for r in rows)


def test_pose_filter_is_the_stated_recursion(spark, data):
    from rangeweave.operators.filters import Motion
    from rangeweave.plans import fixtures as fx

    seen = sorted(tuple(r) for r in fx.pose_observations(spark, data).where("key = 1").collect())
    got = sorted(tuple(r) for r in catalog.pose_filter(spark, data).where("key = 1").collect())
    f = Motion.at_pose(*seen[0][2:])
    for s, g in zip(seen, got, strict=True):
        if s is not seen[0]:
            f.predict()
            f.observe_pose(*s[2:])
        assert g[2:5] == pytest.approx(f.place)


def test_pose_filter_in_small_batches(spark, data):
    from rangeweave.operators.filters import filter_poses
    from rangeweave.plans import fixtures as fx

    seen = fx.pose_observations(spark, data).where("key < 20")
    want = {(r["key"], r["seq"]): tuple(r)[2:] for r in filter_poses(seen).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r["key"], r["seq"]): tuple(r)[2:] for r in filter_poses(seen).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) > 100 and all(got[k] == pytest.approx(v) for k, v in want.items()) and got.keys() == want.keys()


def test_tracklets_follow_columns(spark):
    import random

    from rangeweave.operators import filters

    rng = random.Random(4)
    rows = []
    for s in (1, 2):
        for f in (0, 1, 2, 3, 5, 6):
            taken = set()
            for _ in range(60):
                i, j, u, v = rng.randrange(20), rng.randrange(20), rng.randrange(-1, 3), rng.randrange(-1, 2)
                if (i, j) not in taken and (i + u, j + v, "to") not in taken:
                    taken |= {(i, j), (i + u, j + v, "to")}
                    rows.append((s, f, i, j, u, v, 1))
            rows.append((s, f, 30, 30, 0, 0, 0))
    flow = spark.createDataFrame(rows, "sequence long, frame int, i int, j int, u int, v int, valid int").repartition(3)
    got = {(r["sequence"], r["frame"], r["si"], r["sj"]): r for r in filters.tracklets(flow, 0.3, (40, 40)).collect()}
    want, now = {}, {}
    for s, f, i, j, u, v, ok in sorted(rows):
        if (s, f - 1) not in {(a, b) for a, b, *_ in rows}:
            now[s, f] = {}
        if ok:
            x, y = (i + u - 20) * 0.3, (j + v - 20) * 0.3
            m = now[s, f].get((i, j))
            if m is None:
                m = filters.Motion.from_flow(x - u * 0.3, y - v * 0.3, u * 0.3 / 0.1, v * 0.3 / 0.1)
            else:
                m.predict()
                if m.observe_position(x, y) >= filters.GATE:
                    continue
            now.setdefault((s, f + 1), {})[i + u, j + v] = m
            want[s, f, i, j] = (i + u, j + v, *m.place, m.mu[3], m.mu[4], m.age)
    assert got.keys() == want.keys() and max(r["age"] for r in got.values()) >= 2
    for k, r in got.items():
        assert (r["i"], r["j"], r["x"], r["y"], r["h"], r["v"], r["w"], r["age"]) == pytest.approx(want[k])


def test_full_match_against_loops():
    import numpy as np

    from rangeweave.functions.grid_index import GridSpec
    from rangeweave.operators import flow, matcher

    rng = np.random.default_rng(5)
    spec, w = GridSpec(9, 8, 14), 2
    cells = np.array([(i, j) for i in range(9) for j in range(8)])
    occupied = rng.integers(0, 1 << 14, (2, 72)) & rng.integers(0, 1 << 14, (2, 72))
    free = rng.integers(0, 1 << 14, (2, 72)) & ~occupied
    source = np.nonzero(rng.random(72) < 0.6)[0]
    a = np.concatenate([cells[source], free[0, source, None], occupied[0, source, None]], axis=1).astype(np.int32)
    b = np.concatenate([cells, free[1, :, None], occupied[1, :, None]], axis=1).astype(np.int32)[:60]
    win = matcher.window_scores(a, b, spec, matcher.WEIGHTS, matcher.OFFSET, w)
    later = {(i, j): (f, o) for i, j, f, o in b.tolist()}

    def score(i, j, f, o, du, dv):
        f2, o2 = later.get((i + du, j + dv), (0, 0))
        s = matcher.OFFSET
        for k in range(14):
            x, y = ("f" if f >> k & 1 else "o" if o >> k & 1 else ""), ("f" if f2 >> k & 1 else "o" if o2 >> k & 1 else "")
            if x and y:
                s += (matcher.FREE_WEIGHTS if x + y == "ff" else matcher.OCCUPIED_WEIGHTS if x + y == "oo" else matcher.MIXED_WEIGHTS)[k]
        return round(-np.log1p(np.exp(-s / 100)) * 1000)

    moves = [(du, dv) for du in range(-w, w + 1) for dv in range(-w, w + 1)]
    mine = {(i, j): [score(i, j, f, o, *m) for m in moves] for i, j, f, o in a.tolist()}
    for n, (i, j, *_) in enumerate(a.tolist()):
        for d in range(len(moves)):
            around = [(i + x, j + y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
            want = sum(flow.OUTSIDE_SCORE if not (0 <= p < 9 and 0 <= q < 8) else mine[p, q][d] if (p, q) in mine else flow.EMPTY_SCORE for p, q in around)
            assert win[n, d] == want

    held, last = {}, {}  # target: (source, score); source: (u, v, valid, score)
    for r in range(4):
        proposed = {}
        for n, (i, j, *_) in enumerate(a.tolist()):
            best = None
            near = [last[i + x, j + y] for x in range(-2, 3) for y in range(-2, 3) if (x or y) and last.get((i + x, j + y), (0, 0, 0))[2]] if r else []
            for d, (du, dv) in enumerate(moves):
                to = (i + du, j + dv)
                s = int(win[n, d]) - du * du - dv * dv - sum((du - p[0]) ** 2 + (dv - p[1]) ** 2 for p in near)
                if 0 <= to[0] < 9 and 0 <= to[1] < 8 and (to not in held or s > held[to][1] or held[to][0] == (i, j)) and (best is None or s > best[2]):
                    best = (du, dv, s)
            proposed[i, j] = best
        held = {}
        for at, p in sorted(proposed.items()):
            if p and ((to := (at[0] + p[0], at[1] + p[1])) not in held or p[2] > held[to][1]):
                held[to] = (at, p[2])
        last = {at: (0, 0, 0, None) if p is None else (p[0], p[1], int(held[at[0] + p[0], at[1] + p[1]][0] == at), p[2]) for at, p in proposed.items()}
        u, v, valid, got = matcher.settle(win, a[:, 0], a[:, 1], spec, w, r + 1)
        assert [(x, y, z, None if q == matcher._NONE else q) for x, y, z, q in zip(u.tolist(), v.tolist(), valid.tolist(), got.tolist(), strict=True)] == [last[i, j] for i, j, *_ in a.tolist()]


def test_training_lines_and_eval_files(spark, data, tmp_path):
    from rangeweave.operators import evaluate, filters
    from rangeweave.plans import fixtures as fx

    rows = catalog.train_filter_rows(spark, data).cache()
    evaluate.write_training(rows, fx.SPEC, str(tmp_path / "train"))
    lines = [r["value"].split(",") for r in spark.read.text(str(tmp_path / "train")).collect()]
    assert len(lines) == rows.select("frame", "i", "j").distinct().count() and {len(x) for x in lines} == {701}
    assert sum(float(v) != 0 for x in lines for v in x[:700]) == rows.selectExpr("sum(int(lp1 <> 0) + int(lp2 <> 0))").first()[0]
    seen = catalog._eval(spark, data)
    tracked = filters.tracklets(catalog.flow_solve(spark, data).selectExpr("0L AS sequence", "*"), 0.3, (167, 167))
    for n in (1, 2):
        evaluate.write_eval(seen, tracked, str(tmp_path / "eval"))
        assert spark.read.csv(str(tmp_path / "eval" / "eval")).count() == n * seen.count()
    assert spark.read.csv(str(tmp_path / "eval" / "eval_tracklets")).count() == 2 * seen.where("is_tracklet = 1").count()
    assert len(spark.read.csv(str(tmp_path / "eval" / "eval_ft")).columns) == 10


def test_small_operators(spark):
    import math

    from rangeweave.operators import evaluate, filters, occupancy, patches

    hits = spark.createDataFrame([(1, 5.0, 1.0, 0.0, 0.0), (1, 2.0, 3.0, 0.0, 0.0), (2, 4.0, 9.0, 0.0, 0.0)], "ray int, dist double, x double, y double, z double")
    assert {r["ray"]: r["x"] for r in evaluate.nearest_hit(hits).collect()} == {1: 3.0, 2: 9.0}
    patch = spark.createDataFrame([(bytearray(range(16)),)], "c binary")
    value = lambda a, b: patch.select(patches.patch_value(F.col("c"), F.lit(a), F.lit(b), F.lit(3), 2, 2)).first()[0]
    assert (value(0, 0), value(1, 1), value(2, 0)) == (3 * 255.0, 15 * 255.0, -1.0)
    m = filters.Motion.from_flow(0.0, 0.0, 3.0, 4.0)
    assert m.observe_velocity(3.0, 4.0) == pytest.approx(0.0) and m.mu[3] == pytest.approx(5.0)
    assert m.observe_velocity(6.0, 8.0) > 1 and 5.0 < m.mu[3] < 10.0 and m.mu[2] == pytest.approx(math.atan2(4, 3))
    point = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "frame int, x double, y double, z double")
    pose = spark.createDataFrame([(0, 10.0, 20.0, 30.0, 0.0, 0.0, math.pi / 2)], "frame int, x double, y double, z double, r double, p double, h double")
    r = occupancy.posed(point, pose).first()
    assert (r["x"], r["y"], r["z"], r["oz"], r["body"]) == (pytest.approx(8.0), pytest.approx(21.0), 33.0, 31.73, False)
    counts = spark.createDataFrame([(k,) for k in range(5)], "k int")
    from rangeweave.session import bounded

    with pytest.raises(ValueError):
        bounded(counts, 4)


def test_depth_fill_keeps_measured(spark):
    import numpy as np

    from rangeweave.operators.depth import fill_image

    image = np.zeros((6, 6))
    image[1, 1], image[4, 4] = 5.0, 9.0
    full = fill_image(image, 10)
    assert full[1, 1] == 5.0 and full[4, 4] == 9.0 and (full > 0).all()


def test_depth_fill_is_of_the_whole_image(spark, data):
    measured = catalog.zbuffer(spark, data).withColumnRenamed("depth", "measured")
    full = catalog.depth_fill(spark, data).cache()
    met = measured.join(full, ["frame", "w", "h"], "left")
    assert met.where("depth IS NULL OR abs(depth - measured) > 1e-5").count() == 0
    assert full.count() > 2 * measured.count()
    assert full.where("w > 620").count() and full.where("h > 187").count()


def test_scan_match_recovers_a_motion(spark):
    import numpy as np

    from rangeweave.operators.matching import match_scans

    rng = np.random.default_rng(3)
    world = rng.uniform(-20, 20, (400, 3))
    c, s = np.cos(0.02), np.sin(0.02)
    local = (world[:, :2] - [0.3, -0.2]) @ np.array([[c, -s], [s, c]])  # the same places seen from the pose (0.3, -0.2, 0.02)
    rows = [(0, i, *map(float, p)) for i, p in enumerate(world)] + [(1, i, float(a), float(b), float(p[2])) for i, ((a, b), p) in enumerate(zip(local, world, strict=True))]
    points = spark.createDataFrame(rows, "frame int, point_id long, x double, y double, z double")
    seeds = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "frame int, x double, y double, h double")
    (r,) = match_scans(points, seeds, 6, 2.0).collect()
    assert (r["x"], r["y"], r["h"]) == pytest.approx((0.3, -0.2, 0.02), abs=1e-6)


def test_motion_seen_from_another_pose():
    import numpy as np

    from rangeweave.operators.filters import Motion

    m = Motion.at_pose(3.0, 4.0, 0.5, 2.0, 0.1)
    m.predict()
    same, turned = m.seen_from(0.0, 0.0, 0.0), m.seen_from(1.0, 2.0, 0.5)
    assert same.place == pytest.approx(m.place) and np.allclose(same.sigma, m.sigma, atol=1e-9)
    assert turned.place[2] == pytest.approx(m.place[2] - 0.5) and np.trace(turned.sigma) == pytest.approx(np.trace(m.sigma))


def test_full_evaluation_is_a_loop(spark, data):
    """Motion, mask and ground of eval_rows_full, put together cell by cell."""
    from rangeweave.operators import poses
    from rangeweave.plans import fixtures as fx

    flow = {tuple(r)[:3]: r for r in catalog.flow_cells_full(spark, data).collect()}
    mask = {tuple(r)[:3] if len(r) == 4 else (r["frame"], r["i"], r["j"]): r["background"] for r in catalog.background_filter(spark, data).collect()}
    ground = {(r["frame"], r["i"], r["j"]): (r["x2"], r["y2"]) for r in poses.project_points(catalog._places(spark, data), catalog._filtered_poses(spark, data)).collect()}
    raw = {(r["frame"], r["i"], r["j"]): (r["x2"], r["y2"]) for r in poses.project_points(catalog._places(spark, data), fx.poses(spark, data)).collect()}
    rows = catalog._eval_full(spark, data).collect()
    assert len(rows) > 500 and any(ground[k] != raw[k] for k in ground)
    moved = lost = 0
    for r in rows:
        at = r["frame"], r["i"], r["j"]
        f = flow.get(at)
        if (f is None or not f["valid"]) and mask[at]:
            lost += 1
            want = ground[at][0] - r["x"], ground[at][1] - r["y"]
        else:
            moved += f is not None
            want = (f["u"] * 0.3, f["v"] * 0.3) if f else (0.0, 0.0)
        assert (r["u"], r["v"]) == pytest.approx(want) and r["filter"] == mask[at]
        assert r["is_tracklet"] or (r["x2"], r["y2"]) == pytest.approx(raw[at])
    assert moved > 50 and lost > 50
    assert not any(mask[k] for k in flow)
