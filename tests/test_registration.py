"""Plane-to-plane alignment against a plain loop, and known motions."""

import numpy as np
import pytest

from rangeweave.operators import registration as reg


def scene(rng, n):
    """Points on a ground plane, two walls and a slanted roof."""
    u, v = rng.uniform(-14, 14, n), rng.uniform(-14, 14, n)
    kind = rng.integers(0, 4, n)
    z = np.zeros(n)
    out = np.stack([u, v, z], axis=1)
    out[kind == 1] = np.stack([u, 0 * u + 9, np.abs(v) / 3], axis=1)[kind == 1]
    out[kind == 2] = np.stack([0 * u - 11, v, np.abs(u) / 3], axis=1)[kind == 2]
    out[kind == 3] = np.stack([u / 4 + 6, v / 4, 2 + u / 8], axis=1)[kind == 3]
    return out + rng.normal(0, 0.005, out.shape)


def there_and_back(points, m):
    return (points - m[:, 3]) @ m[:, :3]


def frame(spark, *scans):
    rows = [(f, i, *map(float, p)) for f, s in enumerate(scans) if s is not None for i, p in enumerate(s)]
    return spark.createDataFrame(rows, "frame int, point_id bigint, x double, y double, z double").repartition(7)


def plain_normals(p, k):
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    out = []
    for row in np.argsort(d, axis=1, kind="stable")[:, :k]:
        off = p[row] - p[row].mean(axis=0)
        out.append(np.linalg.svd(off)[2][-1])
    return np.array(out)


def plain_match(source, target, m, k, rounds, reach):
    """One pair, point by point."""
    pn, qn = plain_normals(source, k), plain_normals(target, k)
    c = np.diag([reg.EPSILON, 1, 1])

    def spread(n):
        u = np.linalg.svd(n[None])[2]
        return u.T @ c @ u

    for r in range(1, rounds + 1):
        moved = source @ m[:, :3].T + m[:, 3]
        pairs = []
        for i, x in enumerate(moved):
            d = ((target - x) ** 2).sum(axis=1)
            j = int(d.argmin())
            if d[j] <= reach**2:
                turn = m[:, :3]
                pairs.append((source[i], target[j], np.linalg.inv(spread(qn[j]) + turn @ spread(pn[i]) @ turn.T)))
        new = m.copy()
        for _ in range(reg.STEPS):
            a, b = np.zeros((6, 6)), np.zeros(6)
            for p, q, w in pairs:
                x = new[:, :3] @ p + new[:, 3]
                j = np.hstack([-np.array([[0, -x[2], x[1]], [x[2], 0, -x[0]], [-x[1], x[0], 0]]), np.eye(3)])
                a += j.T @ w @ j
                b += j.T @ w @ (q - x)
            s = np.linalg.solve(a, b)
            t = np.linalg.norm(s[:3])
            k3 = np.array([[0, -s[2], s[1]], [s[2], 0, -s[0]], [-s[1], s[0], 0]]) / max(t, 1e-300)
            new = (np.eye(3) + np.sin(t) * k3 + (1 - np.cos(t)) * k3 @ k3) @ new
            new[:, 3] += s[3:]
        small = np.abs(new - m)
        m = new
        if (small[:, :3] < reg.TURN_END).all() and (small[:, 3] < reg.MOVE_END).all():
            return m, r
    return m, rounds


def test_nearest():
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.uniform(-5, 5, (300, 3)), rng.normal(0, 0.05, (200, 3)), np.zeros((40, 3))])
    q = np.concatenate([rng.uniform(-9, 9, (80, 3)), p[::50]])
    for k, reach in ((1, 3.0), (20, 1.5), (7, 0.3)):
        found, d2 = reg.nearest(p, q, k, reach)
        for i, x in enumerate(q):
            d = ((p - x) ** 2).sum(axis=1)
            want = [j for j in np.lexsort((np.arange(len(p)), d)) if d[j] <= reach**2][:k]
            assert [j for j in found[i] if j >= 0] == want
            assert np.allclose(d2[i][: len(want)], d[want]) and np.isinf(d2[i][len(want) :]).all()
    assert (reg.nearest(p[:0], q, 2, 1.0)[0] == -1).all() and len(reg.nearest(p, q[:0], 2, 1.0)[0]) == 0


def test_normals_of_all_points(spark):
    rng = np.random.default_rng(1)
    far = np.array([[60.0, 0, 0], [61, 1, 0], [62, 3, 0.5]])
    p = np.concatenate([scene(rng, 500), far])
    got = sorted((r["point_id"], r["nx"], r["ny"], r["nz"]) for r in reg.surfaces(frame(spark, p), 8).collect())
    want = plain_normals(p, 8)
    assert len(got) == len(p)
    assert np.allclose(np.abs([np.dot(g[1:], w) for g, w in zip(got, want)]), 1, atol=1e-6)


def test_matrix_and_pose_are_inverse():
    rng = np.random.default_rng(2)
    pose = rng.uniform(-1.5, 1.5, (50, 6))
    assert np.allclose(reg.pose_of(reg.matrix_of(pose)), pose)


def test_match_is_the_plain_loop_and_finds_known_motions(spark):
    rng = np.random.default_rng(3)
    world, k = scene(rng, 700), 10
    moves = reg.matrix_of(np.array([[0.5, -0.3, 0.1, 0.02, -0.015, 0.06], [-0.4, 0.2, -0.05, -0.01, 0.02, -0.08]]))
    a = world
    b = there_and_back(a, moves[0])
    c = there_and_back(b, moves[1])
    seeds = spark.createDataFrame([(0, *[0.0] * 6), (1, *[0.0] * 6), (5, *[0.0] * 6)], "frame int, x double, y double, z double, r double, p double, h double")
    rows = {r["frame"]: r for r in reg.match_scans(frame(spark, a, b, c), seeds, k=k).collect()}
    assert set(rows) == {0, 1, 5}
    for f, (target, source) in enumerate(((a, b), (b, c))):
        got = np.array([rows[f][x] for x in reg.POSE])
        assert rows[f]["converged"] and np.allclose(got, reg.pose_of(moves[f]), atol=2e-3)
        m, rounds = plain_match(source, target, np.eye(4)[:3], k, reg.ROUNDS, reg.REACH)
        assert rows[f]["rounds"] == rounds and np.allclose(got, reg.pose_of(m), atol=1e-6)
    assert not rows[5]["converged"] and rows[5]["n"] == 0 and [rows[5][x] for x in reg.POSE] == [0.0] * 6


def test_failed_matches_are_zeros(spark):
    rng = np.random.default_rng(4)
    p = scene(rng, 300)
    m = reg.matrix_of(np.array([0.6, 0.2, 0, 0, 0, 0.05]))
    seeds = spark.createDataFrame([(0, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0)], "frame int, x double, y double, z double, r double, p double, h double")
    (row,) = reg.match_scans(frame(spark, p, there_and_back(p, m)), seeds, rounds=2, k=8).collect()
    assert (row["converged"], row["rounds"], row["x"], row["h"]) == (False, 2, 0.0, 0.0)
    assert reg.match_scans(frame(spark, p), seeds.limit(0), k=8).count() == 0


def test_tiles_do_not_matter(spark):
    rng = np.random.default_rng(5)
    p = scene(rng, 400)
    m = reg.matrix_of(np.array([0.3, -0.2, 0.05, 0.01, 0, 0.03]))
    both = frame(spark, p, there_and_back(p, m))
    seeds = spark.createDataFrame([(0, *[0.0] * 6)], "frame int, x double, y double, z double, r double, p double, h double")
    poses = [[reg.match_scans(both, seeds, k=8, tile=t).first()[c] for c in reg.POSE] for t in (5.0, 40.0)]
    assert np.allclose(*poses, atol=1e-7)
    assert poses[0] == pytest.approx(reg.pose_of(m), abs=2e-3)


def test_a_pair_as_a_whole_is_its_tiles_and_travels_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a = scene(rng, 500)
    moves = reg.matrix_of(np.array([[0.3, -0.2, 0.05, 0.01, 0, 0.03], [0.2, 0.1, 0.0, 0.0, 0.01, -0.02]]))
    b = there_and_back(a, moves[0])
    points = frame(spark, a, b, there_and_back(b, moves[1]))
    seeds = spark.createDataFrame([(f, *[0.0] * 6) for f in (0, 1, 4)], "frame int, x double, y double, z double, r double, p double, h double")
    with monkeypatch.context() as patch:
        patch.setattr(reg, "_round", None)  # no job a round
        whole = reg.match_scans(points, seeds, 12, k=8)
    want = {r["frame"]: r for r in reg.match_scans(points, seeds, 12, k=8, whole=0).collect()}
    got = {r["frame"]: r for r in whole.collect()}
    assert set(got) == set(want) == {0, 1, 4}
    for f, r in got.items():
        assert [r[c] for c in ("rounds", "converged", "n")] == [want[f][c] for c in ("rounds", "converged", "n")]
        assert np.allclose([r[c] for c in reg.POSE], [want[f][c] for c in reg.POSE], atol=1e-9)
        assert (r["error"] is None) == (want[f]["error"] is None) and (r["error"] is None or r["error"] == pytest.approx(want[f]["error"], abs=1e-4))
    # a pair of more points than `whole` goes by tiles beside those that don't
    mixed = {r["frame"]: r for r in reg.match_scans(points.where("frame < 2 OR point_id < 450"), seeds, 12, k=8, whole=950).collect()}
    assert set(mixed) == {0, 1, 4} and all(mixed[f]["converged"] for f in (0, 1))


def test_nearest_in_a_sparse_space_is_searched_by_voxel():
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.uniform(-5000, 5000, (60, 3)), rng.normal(0, 0.3, (300, 3))])
    q = np.concatenate([p[:5] + 0.01, rng.normal(0, 0.3, (20, 3))])
    found, d2 = reg.nearest(p, q, 5, 2.0)
    for i, x in enumerate(q):
        d = ((p - x) ** 2).sum(axis=1)
        want = [j for j in np.lexsort((np.arange(len(p)), d)) if d[j] <= 4.0][:5]
        assert [j for j in found[i] if j >= 0] == want and np.allclose(d2[i][: len(want)], d[want])
