"""Plane-to-plane alignment of consecutive scans, in six dimensions.

Each point carries the normal of the plane through its nearest neighbours; its covariance is narrow along the normal and wide
across. A round finds each source point's nearest target point and weighs the offset by both covariances. Given the
pairs, the error is a quadratic form in the twelve entries of the motion, so 73 sums a pair of scans
say all that the Gauss-Newton steps of the round need to know; no point is visited again until the next round.

Spark deals the points to pairs of scans, each to the pair that it is the source of and the one that it is the target of, and a pair is matched where its
points meet: they are shuffled once, whatever the rounds. That holds for pairs of up to `WHOLE` points, more than a sensor gives. Larger pairs go by
square tiles (targets also to the tiles that they are within reach of): Spark brings source and target of a tile together and adds up the tiles' sums
every round; a task holds one tile of one pair. Pairs that have converged leave the loop. Both give the same motions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeweave.session import by_frame, ship, stored

# Neighbours that span a plane, variance along the normal, metres beyond which points are no pair,
# rounds after which a match has failed, and Gauss-Newton steps of a round.
NEIGHBOURS, EPSILON, REACH, ROUNDS, STEPS = 20, 1e-3, 3.0, 50, 8
#: A round that changes no entry of the rotation and no translation (metres) by more ends the loop for its pair.
TURN_END, MOVE_END = 2e-3, 5e-4
#: Edge of a tile in metres; beyond `FAR` metres no neighbour is looked for.
TILE, FAR = 12.0, 96.0
#: Candidate pairs that a task measures at once.
AT_ONCE = 300_000
#: 27 voxels hold this many times what a ball with their edge as radius does.
BALL = 7
#: Points of both scans together up to which a task takes a pair as a whole; the sensor's largest scan has 130,000.
WHOLE = 400_000


# -- nearest points within a tile ----------------------------------------------------------------


def nearest(points: np.ndarray, queries: np.ndarray, k: int, reach: float, cell: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(indices [queries, k] of the k nearest points within reach, -1 where there are fewer; squared distances).

    Points are hashed to voxels; a query looks into the 27 around it and is done when k of its candidates are
    within one edge, beyond which something could be missed. Others look again, into larger voxels; edges at which these hold
    too few candidates are passed over. Queries of a voxel have the same candidates, which are gathered once for all of them.
    Equally near points come in the order of their indices.
    """
    found = np.full((len(queries), k), -1)
    far = np.full((len(queries), k), np.inf)
    todo = np.arange(len(queries))
    if not len(points) or not len(queries):
        return found, far
    low, high = np.minimum(points.min(axis=0), queries.min(axis=0)), np.maximum(points.max(axis=0), queries.max(axis=0))
    runs = np.stack(np.meshgrid([-1, 0, 1], [-1, 0, 1], indexing="ij"), axis=-1).reshape(-1, 2)
    while len(todo):
        cell = min(cell, reach)
        span = np.floor((high - low) / cell).astype(np.int64) + 4
        code = lambda x, cell=cell, span=span: ((c := np.floor((x - low) / cell).astype(np.int64) + 1)[:, 0] * span[1] + c[:, 1]) * span[2] + c[:, 2]
        key = code(points)
        order = np.argsort(key, kind="stable")
        key = key[order]
        voxel, mine = np.unique(code(queries[todo]), return_inverse=True)
        # Voxels that follow each other in z have codes in a row: nine runs of three.
        around = voxel + ((runs[:, 0] * span[1] + runs[:, 1]) * span[2])[:, None]
        if span.prod() <= 64 * (len(points) + len(queries)):  # what comes before each voxel, by its number; where they are too many, by a search
            before = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=span.prod() + 1))])
            begin, end = before[around.T - 1], before[around.T + 2]
        else:
            begin, end = (np.ascontiguousarray(x.T) for x in (np.searchsorted(key, around - 1), np.searchsorted(key, around + 1, side="right")))
        work = (end - begin).sum(axis=1)
        if cell < reach and np.median(work[mine]) < BALL * k:
            cell *= float(np.clip((BALL * k / max(np.median(work[mine]), 1)) ** (1 / 3), 1.1, 2.0))
            continue
        left = []
        by = np.lexsort((mine, work[mine]))
        for part in np.split(by, np.flatnonzero(np.diff(np.cumsum(work[mine[by]]) // AT_ONCE)) + 1):
            here, row = np.unique(mine[part], return_inverse=True)
            n = end[here] - begin[here]
            width = max(int(work[here].max()), 1)
            held = np.full((len(here), width), len(points))
            flat = n.ravel()
            held[np.arange(width) < work[here][:, None]] = order[np.repeat(begin[here].ravel() - np.cumsum(flat) + flat, flat) + np.arange(flat.sum())]
            held.sort(axis=1)
            q, d2 = queries[todo[part]], None
            there = held < len(points)
            for a in range(3):
                off = np.where(there, points[np.where(there, held, 0), a], np.inf)[row]
                off -= q[:, a, None]
                off *= off
                d2 = off if d2 is None else np.add(d2, off, out=d2)
            near = d2 <= cell * cell
            done = (near.sum(axis=1) >= k) | (cell >= reach)
            left.append(part[~done])
            if not done.any():
                continue
            d2, near, row, asked = d2[done], near[done], row[done], todo[part[done]]
            if width > k:
                last = np.partition(d2, k - 1, axis=1)[:, k - 1]
                near &= d2 <= last[:, None]
            r, c = np.nonzero(near)
            v = d2[r, c]
            if width > k:  # of those as far as the last one, the first by index
                tie = v == last[r]
                count = np.cumsum(tie)
                starts = np.searchsorted(r, np.arange(len(asked)))
                before = np.append(0, count)[starts]
                open_ = k - np.bincount(r[~tie], minlength=len(asked))
                keep = ~tie | (count - before[r] <= open_[r])
                r, c, v = r[keep], c[keep], v[keep]
            at = np.arange(len(r)) - np.searchsorted(r, np.arange(len(asked)))[r]
            which, dist = np.full((len(asked), k), -1), np.full((len(asked), k), np.inf)
            which[r, at], dist[r, at] = held[row[r], c], v
            by_distance = np.argsort(dist, axis=1, kind="stable")
            found[asked], far[asked] = np.take_along_axis(which, by_distance, axis=1), np.take_along_axis(dist, by_distance, axis=1)
        todo = todo[np.concatenate(left)]
        if cell >= reach:
            break
        cell *= 1.5
    return found, far


def normals(points: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Unit normal of the plane through each row's points (-1: none): the direction in which they spread least."""
    there = found >= 0
    off = points[found]  # -1, the last point, counts as none below
    if there.all():
        off -= off.mean(axis=1)[:, None, :]
    else:
        off[~there] = 0.0
        off -= (off.sum(axis=1) / np.maximum(there.sum(axis=1), 1)[:, None])[:, None, :]
        off[~there] = 0.0
    return np.linalg.eigh(off.transpose(0, 2, 1) @ off)[1][:, :, 0]


# -- points to tiles -----------------------------------------------------------------------------

_KEYS = ["frame", "tx", "ty"]


def _tile(c, tile: float):
    return F.floor(c / tile).cast("long")


def _touched(points: DataFrame, tile: float, reach: float) -> DataFrame:
    """points, once for every tile that they are within reach of, with tx, ty."""
    for c, t in (("x", "tx"), ("y", "ty")):
        points = points.withColumn(t, F.explode(F.sequence(_tile(F.col(c) - reach, tile), _tile(F.col(c) + reach, tile))))
    return points


def _xyz(t: pa.Table, names: tuple[str, str, str] = ("x", "y", "z")) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().astype(float) for c in names], axis=1)


def _last_reach(tile: float) -> float:
    """Metres to which a point's neighbours are looked for at last: a quarter of a tile, doubled while it stays within FAR."""
    reach = tile / 4
    while 2 * reach <= FAR:
        reach *= 2
    return reach


def surfaces(points: DataFrame, k: int = NEIGHBOURS, tile: float = TILE) -> DataFrame:
    """points (frame, point_id, x, y, z) with nx, ny, nz: the normal of the plane through the k nearest points of the scan, itself included.

    A point that has fewer within a quarter of a tile looks again in tiles of twice the size, until `FAR`;
    there, those that it has are taken. Which normal a point gets whose neighbours lie on a line or in one place is undefined.
    """
    spark = points.sparkSession
    ship(spark)
    own = stored(points.select("frame", "point_id", *(F.col(c).cast("double").alias(c) for c in "xyz")), "points")
    todo, out = own, None
    kinds = own.schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", nx double, ny double, nz double, n int"
    reach = tile / 4
    while True:

        def planes(near: pa.Table, asking: pa.Table) -> pa.Table:  # pickled with this round's reach before the loop goes on
            p, q = _xyz(near), _xyz(asking)
            found, _ = nearest(p, q, k, reach)  # noqa: B023
            n = normals(p, found) if len(p) else np.zeros((len(q), 3))
            cols = [asking.column(f.name) for f in kinds] + [pa.array(n[:, a]) for a in range(3)] + [pa.array((found >= 0).sum(axis=1).astype(np.int32))]
            return pa.Table.from_arrays(cols, names=[*kinds.names, "nx", "ny", "nz", "n"])

        asking = todo.withColumn("tx", _tile(F.col("x"), 4 * reach)).withColumn("ty", _tile(F.col("y"), 4 * reach))
        near = _touched(own.toDF(*own.columns).join(todo.select("frame").distinct(), "frame", "left_semi"), 4 * reach, reach)
        got = stored(near.groupBy(*_KEYS).cogroup(asking.groupBy(*_KEYS)).applyInArrow(planes, schema), "surfaces")
        last = 2 * reach > FAR
        done = (got if last else got.where(F.col("n") >= k)).drop("n")
        out = done if out is None else out.unionByName(done)
        todo = got.where(F.col("n") < k).select(*kinds.names)
        if last or todo.isEmpty():
            return out
        reach *= 2


# -- motions -------------------------------------------------------------------------------------


def matrix_of(pose: np.ndarray) -> np.ndarray:
    """[..., 3, 4] of poses [..., 6] (x, y, z, r, p, h): R = Rz(h) Ry(p) Rx(r), then the place."""
    cr, cp, ch = (np.cos(pose[..., a]) for a in (3, 4, 5))
    sr, sp, sh = (np.sin(pose[..., a]) for a in (3, 4, 5))
    rows = [[ch * cp, ch * sp * sr - sh * cr, ch * sp * cr + sh * sr], [sh * cp, sh * sp * sr + ch * cr, sh * sp * cr - ch * sr], [-sp, cp * sr, cp * cr]]
    return np.stack([np.stack([*r, pose[..., a]], axis=-1) for a, r in enumerate(rows)], axis=-2)


def pose_of(m: np.ndarray) -> np.ndarray:
    """The inverse of `matrix_of`, pitch within half a turn."""
    p = np.arctan2(-m[..., 2, 0], np.hypot(m[..., 0, 0], m[..., 1, 0]))
    return np.stack([m[..., 0, 3], m[..., 1, 3], m[..., 2, 3], np.arctan2(m[..., 2, 1], m[..., 2, 2]), p, np.arctan2(m[..., 1, 0], m[..., 0, 0])], axis=-1)


def pair_sums(m: np.ndarray, p: np.ndarray, pn: np.ndarray, q: np.ndarray, qn: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    """The 73 sums of source points p and target points q (normals pn, qn) under the motion m [3, 4].

    Error: sum of (q - m (p, 1))' W (q - m (p, 1)), W the inverse of the covariance of q plus the turned one of p.
    In order: 10 x 6 of pp' by W (upper triangles), 4 x 3 of p by W q, 1 of q' W q.
    """
    turned = pn @ m[:, :3].T
    narrow = lambda n: np.eye(3) - (1 - epsilon) * n[:, :, None] * n[:, None, :]
    w = np.linalg.inv(narrow(qn) + narrow(turned))
    one = np.concatenate([p, np.ones((len(p), 1))], axis=1)
    a, b = np.triu_indices(4)
    c, d = np.triu_indices(3)
    wq = np.einsum("nab,nb->na", w, q)
    return np.concatenate([((one[:, a] * one[:, b]).T @ w[:, c, d]).ravel(), (one.T @ wq).ravel(), [np.sum(wq * q)]])


def error_of(m: np.ndarray, sums: np.ndarray) -> float:
    h, g, c = _form(sums)
    theta = m.T.ravel()
    return float(theta @ h @ theta - 2 * g @ theta + c)


def _form(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The error as theta' h theta - 2 g theta + c; theta: the motion's columns one after another."""
    a, b = np.triu_indices(4)
    c, d = np.triu_indices(3)
    s = sums[:60].reshape(10, 6)
    full = np.empty((4, 4, 3, 3))
    for x, y in ((a, b), (b, a)):
        full[x[:, None], y[:, None], c, d] = s
        full[x[:, None], y[:, None], d, c] = s
    return full.transpose(0, 2, 1, 3).reshape(12, 12), sums[60:72], sums[72]


def descend(m: np.ndarray, sums: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Gauss-Newton steps from m on the error of the sums. Directions that the pairs leave open are not moved in."""
    h, g, _ = _form(sums)
    turns = np.zeros((3, 3, 3))
    for a, (b, c) in enumerate(((1, 2), (2, 0), (0, 1))):
        turns[a, c, b], turns[a, b, c] = 1, -1
    for _ in range(steps):
        j = np.zeros((12, 6))
        for a in range(3):
            j[:, a] = (turns[a] @ m).T.ravel()
            j[9 + a, 3 + a] = 1
        step = np.linalg.lstsq(j.T @ h @ j, j.T @ (g - h @ m.T.ravel()), rcond=1e-10)[0]
        angle = np.linalg.norm(step[:3])
        k = np.tensordot(step[:3] / angle, turns, 1) if angle else np.zeros((3, 3))
        m = (np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k) @ m
        m[:, 3] += step[3:]
        if np.abs(step).max() < 1e-9:
            break
    return m


# -- the loop ------------------------------------------------------------------------------------

POSE = ["x", "y", "z", "r", "p", "h"]
STATE = "frame bigint, m array<double>, rounds int, done boolean, n bigint, error double"


def _moved(old: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, float | None, bool]:
    """The motion that a round's sums of n points lead to, its error, and whether the loop ends with it."""
    if not n:
        return old, None, False
    new = descend(old, sums)
    error = float(np.sqrt(max(error_of(new, sums), 0.0) / n))
    return new, error, bool((np.abs(new - old)[:, :3] < TURN_END).all() and (np.abs(new - old)[:, 3] < MOVE_END).all())


def _state(frame: int, m: np.ndarray, rounds: int, done: bool, n: int, error: float | None) -> pa.Table:
    return pa.table({"frame": pa.array([frame], pa.int64()), "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64())), "rounds": pa.array([rounds], pa.int32()),
                     "done": [done], "n": pa.array([n], pa.int64()), "error": pa.array([error], pa.float64())})


def _whole(points: DataFrame, going: DataFrame, rounds: int, reach: float, k: int, far: float) -> DataFrame:
    """STATE of the pairs in going (frame, m, rounds) after all their rounds; a task holds the two scans of a pair."""

    def match(asked: pa.Table, here: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _state(0, np.eye(3, 4), 0, False, 0, None).schema})
        later = here.column("later").to_numpy(zero_copy_only=False)
        scans = []
        for side in (later, ~later):
            p = _xyz(here)[side]
            p = p[np.lexsort(p.T[::-1])]  # equally near points in an order that doesn't depend on how rows arrive
            scans.append((p, normals(p, nearest(p, p, k, far)[0]) if len(p) else p))
        (p, pn), (q, qn) = scans
        m, n, error, done, r = np.array(asked.column("m")[0].as_py()).reshape(3, 4), 0, None, False, 0
        while r < rounds and not done:
            found = nearest(q, p @ m[:, :3].T + m[:, 3], 1, reach)[0][:, 0]
            met = np.flatnonzero(found >= 0)
            n, r = len(met), r + 1
            if not n:  # nor in any other round: the motion stays
                error, r = None, rounds
                break
            m, error, done = _moved(m, n, pair_sums(m, p[met], pn[met], q[found[met]], qn[found[met]]))
        return _state(asked.column("frame")[0].as_py(), m, r, done, n, error)

    both = points.select("frame", *"xyz").withColumn("later", F.explode(F.array(F.lit(False), F.lit(True))))
    both = both.withColumn("frame", F.col("frame") - F.col("later").cast("int")).join(going.select("frame"), "frame", "left_semi")
    return by_frame(going).groupBy("frame").cogroup(by_frame(both).groupBy("frame")).applyInArrow(match, STATE)


def _targets(planes: DataFrame, tile: float, reach: float) -> DataFrame:
    return _touched(planes.select("frame", "x", "y", "z", "nx", "ny", "nz"), tile, reach)


def _round(source: DataFrame, target: DataFrame, going: DataFrame, tile: float, reach: float) -> DataFrame:
    """STATE after one more round of the pairs in going (frame, m, rounds)."""
    names = ("px", "py", "pz", "mx", "my", "mz")

    def meet(near: pa.Table, asking: pa.Table) -> pa.Table:
        out = {"frame": [], "n": [], "sums": []}
        if near.num_rows and asking.num_rows:
            m = np.array(asking.column("m")[0].as_py()).reshape(3, 4)
            p, q = _xyz(asking, names[:3]), _xyz(near)
            found, _ = nearest(q, p @ m[:, :3].T + m[:, 3], 1, reach)
            met = np.flatnonzero(found[:, 0] >= 0)
            to = found[met, 0]
            if len(met):
                s = pair_sums(m, p[met], _xyz(asking, names[3:])[met], q[to], _xyz(near, ("nx", "ny", "nz"))[to])
                out = {"frame": [asking.column("frame")[0].as_py()], "n": [len(met)], "sums": [s.tolist()]}
        return pa.table({"frame": pa.array(out["frame"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "sums": pa.array(out["sums"], pa.list_(pa.float64()))})

    moved = source.join(going, "frame")
    place = lambda a: sum((F.element_at("m", 4 * a + b + 1) * F.col(c) for b, c in enumerate(names[:3])), F.element_at("m", 4 * a + 4))
    asking = moved.select("frame", *names, "m", _tile(place(0), tile).alias("tx"), _tile(place(1), tile).alias("ty"))
    near = target.toDF(*target.columns).join(going.select("frame"), "frame", "left_semi")
    sums = near.groupBy(*_KEYS).cogroup(asking.groupBy(*_KEYS)).applyInArrow(meet, "frame bigint, n bigint, sums array<double>")

    def step(t: pa.Table) -> pa.Table:
        """One pair: the sums of its tiles, and the motion that they lead to."""
        old = np.array(t.column("m")[0].as_py()).reshape(3, 4)
        n = sum(x or 0 for x in t.column("n").to_pylist())
        new, error, done = _moved(old, n, np.sum([x for x in t.column("sums").to_pylist() if x], axis=0))
        return _state(t.column("frame")[0].as_py(), new, t.column("rounds")[0].as_py() + 1, done, n, error)

    return going.join(sums, "frame", "left").groupBy("frame").applyInArrow(step, STATE)


def _by_tiles(points: DataFrame, going: DataFrame, rounds: int, reach: float, k: int, tile: float) -> DataFrame:
    """STATE of the pairs in going (frame, m, rounds) after all their rounds."""
    scans = going.select(F.explode(F.array("frame", F.col("frame") + 1)).alias("frame")).distinct()
    planes = surfaces(points.join(scans, "frame", "left_semi"), k, tile)
    target = stored(_targets(planes, tile, reach), "targets")
    source = planes.select((F.col("frame") - 1).alias("frame"), *(F.col(c).alias(n) for c, n in zip(("x", "y", "z", "nx", "ny", "nz"), ("px", "py", "pz", "mx", "my", "mz"), strict=True)))
    ended = []
    for r in range(rounds):
        now = stored(_round(source, target, going, tile, reach), "motions")
        ended.append(now.where("done" if r < rounds - 1 else "true"))
        going = now.where("NOT done").select("frame", "m", "rounds")
        if going.isEmpty():
            break
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out


def match_scans(points: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, reach: float = REACH, k: int = NEIGHBOURS, tile: float = TILE, whole: int = WHOLE) -> DataFrame:
    """frame, x, y, z, r, p, h, rounds, converged, n, error: the pose of scan frame + 1 seen from scan frame.

    points: frame, point_id, x, y, z; seeds: frame, x, y, z, r, p, h (the motion that is expected), a row a pair. A match
    has converged if it took fewer than `rounds` rounds; all other poses are zeros. n: points with a partner in the last
    round; error: root of the mean weighted square distance. Pairs with an empty scan, or too far apart to have partners, do not converge.
    whole: points of a pair beyond which it goes by tiles.
    """
    spark = points.sparkSession
    ship(spark)
    points = stored(points.select(F.col("frame").cast("long").alias("frame"), "point_id", *(F.col(c).cast("double").alias(c) for c in "xyz")), "points")

    def begin(batches):
        for b in batches:
            m = matrix_of(np.stack([b.column(c).to_numpy() for c in POSE], axis=1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 12 * len(m) + 1, 12, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("frame"), flat], names=["frame", "m"])

    first = seeds.select(F.col("frame").cast("long").alias("frame"), *(F.col(c).cast("double").alias(c) for c in POSE))
    sizes = points.groupBy("frame").agg(F.count("*").alias("size"))
    sizes = sizes.unionByName(sizes.select((F.col("frame") - 1).alias("frame"), "size")).groupBy("frame").agg(F.sum("size").alias("size"))
    asked = first.mapInArrow(begin, "frame bigint, m array<double>").withColumn("rounds", F.lit(0)).join(sizes, "frame", "left")
    asked = stored(asked.withColumn("large", F.coalesce("size", F.lit(0)) > whole).drop("size"), "motions")
    out = stored(_whole(points, asked.where("NOT large").drop("large"), rounds, reach, k, _last_reach(tile)), "motions")
    large = asked.where("large").drop("large")
    if not large.isEmpty():
        out = out.unionByName(_by_tiles(points, large, rounds, reach, k, tile))
    at = lambda a, b: F.element_at("m", 4 * a + b + 1)
    pose = [at(0, 3), at(1, 3), at(2, 3), F.atan2(at(2, 1), at(2, 2)), F.atan2(-at(2, 0), F.hypot(at(0, 0), at(1, 0))), F.atan2(at(1, 0), at(0, 0))]
    good = F.col("done") & (F.col("rounds") < rounds)
    return out.select("frame", *(F.when(good, c).otherwise(0.0).alias(n) for c, n in zip(pose, POSE, strict=True)), "rounds", good.alias("converged"), "n", "error")
