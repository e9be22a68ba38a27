"""The full match: background mask and tiles against the plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeweave.functions.grid_index import GridSpec
from rangeweave.operators import background, matcher

SPEC = GridSpec(40, 33, 14, 0.3)


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(1)
    rows = [(a, b, k, int(rng.integers(-9, 4)), int(rng.integers(-15, 16))) for a in range(-2, 3) for b in range(-2, 3) for k in range(14)]
    return spark.createDataFrame(rows, "di int, dj int, k int, wf int, wo int")


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(2)
    rows = [(f, int(i), int(j), int(k), float(v)) for f in (0, 1, 2, 5) for i, j, k, v in zip(rng.integers(0, 40, 900), rng.integers(0, 33, 900), rng.integers(0, 14, 900), rng.choice([-0.4, 1.0, 2.0, 0.0], 900))]
    return spark.createDataFrame(rows, "frame int, i int, j int, k int, val double").dropDuplicates(["frame", "i", "j", "k"])


@pytest.fixture(scope="module")
def cols(cells):
    level = lambda sign: F.bit_or(F.when(sign, F.expr("shiftleft(1, k)")).otherwise(0))
    return cells.groupBy("frame", "i", "j").agg(level(F.col("val") < 0).alias("free"), level(F.col("val") > 0).alias("occupied"), (F.max("val") > 0.5).alias("evident"))


def test_mask_is_the_classifier(cells, cols, model):
    filter = matcher.Filter.of(model, SPEC, -12)
    want = {(r["frame"], r["i"], r["j"]): r["background"] for r in background.classify(cells, model, SPEC, -12).collect()}
    for f in (0, 5):
        x = np.array([[r["i"], r["j"], r["free"], r["occupied"]] for r in cols.where(f"frame = {f}").collect()])
        got = filter.background(x, SPEC)
        assert got.tolist() == [bool(want[f, i, j]) for i, j in x[:, :2].tolist()] and 0 < got.mean() < 1
    assert not len(filter.background(x[:0], SPEC))


def test_background_has_no_motion_and_is_empty_to_others(cells, cols, model):
    filter = matcher.Filter.of(model, SPEC, -12)
    filtered = background.classify(cells, model, SPEC, -12).where("background = 1").select("frame", "i", "j")
    both = cols.join(filtered.withColumn("b", F.lit(True)), ["frame", "i", "j"], "left")
    # By hand, a pair at a time: the earlier scan without its background, the later one as it is.
    want = None
    for f in (0, 1):
        a = both.where(f"frame = {f} AND b IS NULL").drop("b")
        pair = matcher.flow(a.unionByName(cols.where(f"frame = {f + 1}")), SPEC, w=3, rounds=4).where(f"frame = {f}")
        want = pair if want is None else want.unionByName(pair)
    got = matcher.flow(cols, SPEC, w=3, rounds=4, filter=filter)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize(("edge", "w", "rounds", "masked"), [(8, 3, 1, True), (11, 4, 12, False), (64, 3, 3, True), (5, 6, 5, True)])
def test_tiles_are_the_whole(cols, model, edge, w, rounds, masked):
    filter = matcher.Filter.of(model, SPEC, -12) if masked else None
    want = sorted(map(tuple, matcher.flow(cols, SPEC, w=w, rounds=rounds, filter=filter).collect()), key=str)
    got = sorted(map(tuple, matcher.flow_tiles(cols, SPEC, w=w, rounds=rounds, filter=filter, edge=edge).collect()), key=str)
    assert got == want and {r[0] for r in got} == {0, 1}


def test_rounds_end_where_nothing_changes(monkeypatch):
    rng = np.random.default_rng(3)
    i, j = np.divmod(rng.choice(400, 120, replace=False).astype(np.int32), 20)
    win = rng.integers(-9000, -8900, (120, 49)).astype(np.int32)
    win[:, 10] = -100
    calls, plain = [], matcher.moves
    monkeypatch.setattr(matcher, "moves", lambda *a: calls.append(1) or plain(*a))
    few, n = matcher.settle(win, i, j, SPEC, 3, 6), len(calls)
    many = matcher.settle(win, i, j, SPEC, 3, 60)
    assert all((a == b).all() for a, b in zip(few, many)) and len(calls) - n < 10


def test_memory_of_a_dense_pair():
    import tracemalloc

    spec = GridSpec(120, 120, 14)
    i, j = np.divmod(np.arange(120 * 120, dtype=np.int32), 120)
    win = np.random.default_rng(4).integers(-9000, -100, (len(i), 961), dtype=np.int32)
    tracemalloc.start()
    matcher.settle(win, i, j, spec, 15, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < win.nbytes / 4


def test_tiles_of_nothing(spark, cols):
    assert matcher.flow_tiles(cols.limit(0), SPEC, w=2, rounds=3).count() == 0


def test_kernel_and_joins_agree(spark, cols, cells):
    """The plain joins of flow.py (levels that are occupied in both scans alone) against the kernel."""
    from rangeweave.operators import flow

    weights = [30 + 5 * k for k in range(14)]
    only = ([0] * 14, weights, [0] * 14)
    occupied = cells.where("val > 0")
    evident = matcher.columns_of(occupied).withColumn("evident", F.lit(True))
    model = spark.createDataFrame(list(enumerate(weights)), "k int, wo int")
    alone = flow.column_scores(occupied.select("frame", "i", "j", "k"), model, SPEC, 2, -141).where("frame < 2")
    win = flow.windowed(alone, SPEC)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(matcher.scored(evident, SPEC, only, -141, 2, windowed=False)) == rows(alone)
    assert rows(matcher.scored(evident, SPEC, only, -141, 2)) == rows(win)
    first = rows(flow.propose(win, SPEC))
    assert rows(matcher.proposed(evident, SPEC, only, -141, 2)) == first
    assert rows(matcher.flow(evident, SPEC, only, -141, 2, 2)) == rows(flow.solve(win, SPEC, 2))


def test_marked_cells_are_the_classified_columns(spark):
    from rangeweave.plans import fixtures as fx

    rng = np.random.default_rng(8)
    rows = [(int(f), int(i), int(j), int(k), float(v)) for f, i, j, k, v in zip(rng.integers(0, 3, 900), rng.integers(-3, 12, 900), rng.integers(-2, 13, 900), rng.integers(0, 16, 900), rng.choice([-0.5, 0.0, 1.0], 900), strict=True)]
    cells = spark.createDataFrame(rows, "frame int, i int, j int, k int, val double").repartition(5)
    spec = type(fx.SPEC)(10, 11, 14, 0.3)
    model = fx.bg_model(spark, "/root/testdata/sf0.001")
    want = {(r["frame"], r["i"], r["j"]): r["background"] for r in background.classify(cells, model, spec, -12).collect()}
    got = background.marked(cells, model, spec, -12).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(rows)
    assert all(r["background"] == want.get((r["frame"], r["i"], r["j"])) for r in got)
    assert {r["background"] for r in got} == {0, 1, None}
    left = background.foreground(cells, model, spec, -12)
    assert left.columns == cells.columns and left.count() == sum(r["background"] != 1 for r in got)
