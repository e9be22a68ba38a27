"""What is made of a scan where it is traced, against the grid's rows; and how much work the match of a pair is."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeweave import catalog
from rangeweave.functions.grid_index import GridSpec
from rangeweave.operators import filters, matcher, occupancy, projection
from rangeweave.plans import fixtures as fx

SPEC = GridSpec(31, 24, 14, 0.3)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = [(int(f), *map(float, p)) for f, p in zip(rng.integers(0, 4, 900), rng.normal(0, (4, 3, 1), (900, 3)), strict=True)]
    rows += [(1, 0.0, 0.0, 1.73), (1, 0.0, 0.0, -0.5), (2, 300.0, -2.0, 0.1), (2, -4.0, 900.0, 50.0), (9, 9e5, 9e5, 0.0), (0, None, 1.0, 1.0), (7, None, None, None)]
    return spark.createDataFrame(rows, "frame int, x double, y double, z double").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()))


def walked(df):
    """Whether walks are rows: the column of their length is in the plan."""
    return "_free#" in df._jdf.queryExecution().optimizedPlan().toString()


def test_traced_scans_are_the_grid(points):
    near = points.where("abs(x) < 1000 OR x IS NULL")  # so far away the expressions of the walk overflow
    grid = occupancy.accumulate(near, SPEC)
    got, want = matcher.scan_columns(near, SPEC), matcher.columns(grid, SPEC)
    assert rows(got) == rows(want) and got.schema.simpleString() == want.schema.simpleString() and not walked(got) and walked(want)
    assert {r["frame"] for r in matcher.scan_columns(points, SPEC).collect()} == {0, 1, 2, 3, 9}
    low = occupancy.traced(np.array([[3, 3, 3]]), np.ones(1, int), np.ones(1, int), SPEC, (90.0, 0.0, 0.0))
    assert [int(x.sum()) for x in low] == [0, 1]  # an origin outside: no walk, but the end


def test_traced_background_is_not_evident(spark, points):
    rng = np.random.default_rng(6)
    model = spark.createDataFrame([(a, b, k, int(rng.integers(-3, 5)), int(rng.integers(-15, 16))) for a in range(-2, 3) for b in range(-2, 3) for k in range(14)], "di int, dj int, k int, wf int, wo int")
    near, mask = points.where("abs(x) < 1000"), matcher.Filter.of(model, SPEC, -2)
    cols = matcher.columns(occupancy.accumulate(near, SPEC), SPEC)
    want = rows(matcher.flow(cols, SPEC, w=3, filter=mask).select("frame", "i", "j", "u", "v", "valid"))
    got = rows(matcher.flow(matcher.scan_columns(near, SPEC, mask), SPEC, w=3).select("frame", "i", "j", "u", "v", "valid"))
    assert got == want and 0 < len(got) < matcher.flow(cols, SPEC, w=3).count()


def test_projected_scans_are_the_projected_grid(spark, points):
    near = points.where("abs(x) < 1000")
    cells = occupancy.clean(occupancy.accumulate(near, SPEC)).select("frame", *SPEC.ijk(), "val")
    rng = np.random.default_rng(7)
    moved = [(int(f), int(i), int(j), *(float(x) for x in rng.normal(0, 2, 2)), float(rng.uniform(-4, 4)), float(rng.uniform(0, 9)), float(rng.normal())) for f in (0, 1, 2, 8) for i, j in zip(rng.integers(-2, 33, 90), rng.integers(-2, 26, 90), strict=True)]
    moved += [(0, 5, 5, None, None, None, None, None), (1, 7, 7, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 7, 7, 1.0, 1.0, 0.0, 0.0, 0.0)]
    motion = spark.createDataFrame(moved, "frame int, i int, j int, x double, y double, h double, v double, w double")
    want = projection.project_grid(cells, motion, SPEC, 0.5)
    got = projection.project_scans(near, motion, SPEC, 0.5)
    a, b = rows(got), rows(want)
    assert [r[:4] for r in a] == [r[:4] for r in b] and all(math.isclose(x[4], y[4], abs_tol=1e-9) for x, y in zip(a, b, strict=True))
    assert got.schema.simpleString() == want.schema.simpleString()


def test_project_tracklets_makes_no_row_of_a_cell_that_has_not_moved(spark, data):
    got = catalog.project_tracklets(spark, data)
    assert not walked(got)
    motion = catalog.tracklets(spark, data).select((F.col("frame") + 1).alias("frame"), "i", "j", "x", "y", "h", "v", "w")
    cells = occupancy.clean(occupancy.accumulate(fx.drive_scan(spark, data), fx.SPEC)).select("frame", *fx.SPEC.ijk(), "val")
    want = projection.project_grid(cells, motion, fx.SPEC, 0.5)
    six = lambda df: rows(df.select("frame", "i", "j", "k", (F.round("val", 6) + 0.0).alias("val")))
    assert six(got) == six(want)


def test_scores_of_many_different_columns_are_looked_up_once(monkeypatch):
    """More pairs of levels than scores: no displacement takes all sources' levels by itself."""
    rng, spec, w = np.random.default_rng(9), GridSpec(50, 41, 14, 0.3), 6

    def scan(n):
        x = rng.integers(0, 1 << 14, (n, 2))
        x[:, 1] &= ~x[:, 0]
        return np.concatenate([np.stack(np.divmod(rng.choice(50 * 41, n, replace=False), 41), axis=1), x], axis=1).astype(np.int32)

    source, later = scan(700), scan(1900)
    calls, plain = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = matcher.all_scores(source, later, spec, matcher.WEIGHTS, matcher.OFFSET, w)
    assert not calls
    free, occupied, mixed = np.array(matcher.WEIGHTS)
    at = {(i, j): (f, o) for i, j, f, o in later.tolist()}
    for r in range(0, 700, 23):
        i, j, f, o = source[r].tolist()
        for d, (u, v) in enumerate((u, v) for u in range(-w, w + 1) for v in range(-w, w + 1)):
            f2, o2 = at.get((i + u, j + v), (0, 0))
            s = sum(int(free[k]) * (f >> k & f2 >> k & 1) + int(occupied[k]) * (o >> k & o2 >> k & 1) + int(mixed[k]) * ((f >> k & o2 >> k & 1) + (o >> k & f2 >> k & 1)) for k in range(14))
            assert got[r, d] == np.rint(-np.log1p(np.exp(-(s + matcher.OFFSET) / 100.0)) * matcher.SCALE)


@pytest.mark.parametrize("w", [2, 5])
def test_rounds_ask_again_only_where_something_stirred(monkeypatch, w):
    rng, spec = np.random.default_rng(w), GridSpec(60, 50, 14, 0.3)
    i, j = (x.astype(np.int32) for x in np.divmod(rng.choice(3000, 200, replace=False), 50))
    win = rng.integers(-9000, -8000, (200, (2 * w + 1) ** 2)).astype(np.int32)
    asked, plain = [], matcher.moves
    monkeypatch.setattr(matcher, "moves", lambda win, *a: asked.append(len(win)) or plain(win, *a))
    few = matcher.settle(win, i, j, spec, w, 40)
    n = sum(asked)
    assert n < 0.7 * 200 * len(asked) and len(asked) > 3
    # All of them in every round, as flow.propose has it.
    monkeypatch.setattr(matcher, "_stirred", lambda win, i, *a: np.ones(len(i), dtype=bool), raising=False)
    every = matcher.settle(win, i, j, spec, w, 40)
    assert all((a == b).all() for a, b in zip(few, every, strict=True)) and sum(asked) - n > n


def test_arrows_make_rows_of_occupied_cells_alone(spark, points, data):
    near = points.where("abs(x) < 1000 OR x IS NULL")
    want = occupancy.accumulate(near, SPEC).where("val > 0").select("frame", *SPEC.ijk())
    got = occupancy.scan_occupied(near, SPEC)
    assert rows(got) == rows(want) and got.schema.simpleString() == want.schema.simpleString()
    arrows = catalog.tracklet_arrows(spark, data)
    assert not walked(arrows)
    cells = occupancy.accumulate(fx.drive_scan(spark, data), fx.SPEC).where("val > 0").select("frame", *fx.SPEC.ijk())
    assert rows(arrows) == rows(filters.arrows(catalog.tracklets(spark, data), cells, fx.SPEC))


@pytest.mark.parametrize("rounds", [1, 4])
def test_tiles_make_their_columns_once(spark, points, rounds):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    cols = matcher.scan_columns(points.where("abs(x) < 1000"), SPEC)
    seen = cols.mapInArrow(counted, cols.schema)
    got = rows(matcher.flow_tiles(seen, SPEC, w=3, rounds=rounds, edge=10))
    assert got == rows(matcher.flow(cols, SPEC, w=3, rounds=rounds)) and got and made.value == cols.count()
