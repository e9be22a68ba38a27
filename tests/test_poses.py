"""Poses in space: composition over partitions against a plain loop, and its inverse."""

import numpy as np
import pytest

from rangeweave.operators import poses
from rangeweave.operators.registration import POSE, matrix_of, pose_of

SCHEMA = "log string, n bigint, x double, y double, z double, r double, p double, h double, _m string"


def plain_chain(rows):
    at, out = {}, {}
    for log, n, *move in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        m = np.vstack([matrix_of(np.array(move)), [0, 0, 0, 1]])
        at[log] = at.get(log, np.eye(4)) @ m
        out[log, n] = pose_of(at[log][:3])
    return out


def moves(rng, sizes):
    return [(log, int(i), *map(float, rng.normal(0, (1, 1, 0.2, 0.1, 0.1, 0.3)))) for log, size in sizes.items() for i in rng.permutation(size)]


@pytest.mark.parametrize("batch", [10_000, 7])
def test_chain_of_any_length(spark, batch):
    rng = np.random.default_rng(0)
    rows = moves(rng, {"a": 1, "b": 900, None: 30, "c": 2, "d": 40})
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r["log"], r["n"]): [r[c] for c in POSE] for r in poses.chain6(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(6), "log", "n").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = plain_chain(rows)
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(matrix_of(np.array(got[k])), matrix_of(want[k]), atol=1e-9)


def test_chain_of_nothing(spark):
    assert poses.chain6(spark.createDataFrame([], SCHEMA), "log", "n").count() == 0


def test_steps_undo_a_chain(spark):
    rows = moves(np.random.default_rng(1), {"a": 60, "b": 3})
    chained = poses.chain6(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), "log", "n")
    got = {(r["log"], r["n"]): [r[f"d{c}"] for c in POSE] for r in poses.steps6(chained, "log", "n").collect()}
    want = {r[:2]: r[2:] for r in rows if r[1]}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_running_products():
    m = matrix_of(np.random.default_rng(2).normal(size=(50, 6)))
    begin = np.array([0] * 20 + [20] * 30)
    got = poses.running(m, begin)
    now = None
    for i in range(50):
        now = np.vstack([m[i], [0, 0, 0, 1]]) if i in (0, 20) else now @ np.vstack([m[i], [0, 0, 0, 1]])
        assert np.allclose(got[i], now[:3])
