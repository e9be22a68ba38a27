"""Extended Kalman filter of planar motion: state (x, y, heading, speed, turn rate).

The recursion is the one thing here that has to be a fold. Spark deals the sequences, orders each and
hands them over in Arrow batches; a step is numpy over all sequences (or tracklets) that take it at
once, and what is kept between batches is the states, so no sequence has to fit in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeweave.functions.grid_index import GridSpec
from rangeweave.session import ship

DT = 0.1
# Standard deviations of the start, of the process and of the observations.
POSE_START = (0.1, 0.1, 0.1, 0.01, 0.001)
FLOW_START = (0.1, 0.1, 0.2, 1.5, 0.2)
PROCESS_SPEED, PROCESS_TURN = 0.5, 0.3
OBSERVE_POSITION = 0.15
OBSERVE_POSE = (1.0, 1.0, 0.1, 0.01, 0.001)
GATE = 5.9915


def wrapped(a):
    """To [-pi, pi]; both ends stay as they are."""
    return np.where(np.abs(a) <= math.pi, a, a - 2 * math.pi * np.ceil((a - math.pi) / (2 * math.pi)))


def predicted(mu: np.ndarray, sigma: np.ndarray, dt: float = DT) -> tuple[np.ndarray, np.ndarray]:
    """Means [..., 5] and covariances [..., 5, 5] after dt."""
    h, v, w = mu[..., 2], mu[..., 3], mu[..., 4]
    c, s = np.cos(h), np.sin(h)
    g = np.zeros(sigma.shape) + np.eye(5)
    g[..., 0, 2], g[..., 0, 3], g[..., 1, 2], g[..., 1, 3], g[..., 2, 4] = -v * s * dt, c * dt, v * c * dt, s * dt, dt
    q = np.diag([0, 0, 0, (PROCESS_SPEED * dt) ** 2, (PROCESS_TURN * dt) ** 2])
    moved = mu + np.stack([v * c * dt, v * s * dt, w * dt, 0 * v, 0 * v], axis=-1)
    moved[..., 2] = wrapped(moved[..., 2])
    return moved, g @ sigma @ np.swapaxes(g, -1, -2) + q


def updated(mu: np.ndarray, sigma: np.ndarray, h: np.ndarray, r: np.ndarray, innovation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and covariances after an observation, and its Mahalanobis distance before the update."""
    t = lambda x: np.swapaxes(x, -1, -2)
    s = h @ sigma @ t(h) + r
    d = (innovation * np.linalg.solve(s, innovation[..., None])[..., 0]).sum(axis=-1)
    k = t(np.linalg.solve(s, h @ sigma))
    new = mu + (k @ innovation[..., None])[..., 0]
    new[..., 2] = wrapped(new[..., 2])
    i = np.eye(5) - k @ h
    return new, i @ sigma @ t(i) + k @ r @ t(k), np.sqrt(np.maximum(d, 0.0))


def pose_innovation(mu: np.ndarray, z: np.ndarray) -> np.ndarray:
    off = z - mu
    off[..., 2] = wrapped(off[..., 2])
    return off


class Motion:
    """Mean and covariance, relative to the place where the filter began."""

    def __init__(self, mu, std, x0: float = 0.0, y0: float = 0.0, age: int = 0, sigma=None):
        self.mu = np.array(mu, dtype=float)
        self.sigma = np.diag(np.square(std)) if sigma is None else np.array(sigma, dtype=float).reshape(5, 5)
        self.x0, self.y0, self.age = x0, y0, age

    @classmethod
    def at_pose(cls, x, y, h, v_f, v_h) -> Motion:
        return cls((0, 0, h, v_f, v_h), POSE_START, x, y)

    @classmethod
    def from_flow(cls, x, y, vx, vy) -> Motion:
        return cls((x, y, math.atan2(vy, vx), math.hypot(vx, vy), 0), FLOW_START)

    def predict(self, dt: float = DT) -> None:
        self.mu, self.sigma = predicted(self.mu, self.sigma, dt)
        self.age += 1

    def _update(self, h: np.ndarray, r: np.ndarray, innovation: np.ndarray) -> float:
        self.mu, self.sigma, d = updated(self.mu, self.sigma, h, r, innovation)
        return float(d)

    def observe_position(self, x: float, y: float) -> float:
        """Mahalanobis distance before the update, which happens in any case."""
        h = np.eye(2, 5)
        return self._update(h, np.eye(2) * OBSERVE_POSITION**2, np.array([x - self.x0, y - self.y0]) - self.mu[:2])

    def observe_velocity(self, vx: float, vy: float, std: tuple[float, float] = (0.3, 0.1)) -> float:
        """Along and across the heading."""
        _, _, a, v, _ = self.mu
        c, s = math.cos(a), math.sin(a)
        h = np.array([[0, 0, -v * s, c, 0], [0, 0, v * c, s, 0]])
        turn = np.array([[c, -s], [s, c]])
        return self._update(h, turn @ np.diag(np.square(std)) @ turn.T, np.array([vx - v * c, vy - v * s]))

    def observe_pose(self, x, y, h, v_f, v_h) -> float:
        z = np.array([x - self.x0, y - self.y0, h, v_f, v_h])
        return self._update(np.eye(5), np.diag(np.square(OBSERVE_POSE)), pose_innovation(self.mu, z))

    def seen_from(self, x: float, y: float, h: float, delta: float = 1e-3) -> Motion:
        """The same motion in the frame of another planar pose; the covariance by a numeric Jacobian."""
        c, s = math.cos(h), math.sin(h)

        def move(mu: np.ndarray) -> np.ndarray:
            dx, dy = mu[0] + self.x0 - x, mu[1] + self.y0 - y
            return np.array([c * dx + s * dy, c * dy - s * dx, mu[2] - h, mu[3], mu[4]])

        base = move(self.mu)
        j = np.stack([(move(self.mu + delta * e) - base) / delta for e in np.eye(5)], axis=1)
        base[2] = wrapped(base[2])
        return Motion(base, None, age=self.age, sigma=j @ self.sigma @ j.T)

    @property
    def place(self) -> tuple[float, float, float]:
        return self.mu[0] + self.x0, self.mu[1] + self.y0, self.mu[2]


def filter_poses(observed: DataFrame) -> DataFrame:
    """key, seq, x, y, h, v, w: a filter per key over its observations (key, seq, x, y, h, v_f, v_h) by seq.

    The first observation starts the filter; each later one is a prediction and an update. A key's
    observations pass through one task in order; all keys of a batch take their steps together.
    """
    values = ["x", "y", "h", "v_f", "v_h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the key that the batch before ended with, and its state
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").fill_null(-(2**63)).to_numpy()
            z = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in values], axis=1)
            begin = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1])
            size = np.diff(np.append(begin, len(key)))
            origin = z[begin] * [1, 1, 0, 0, 0]
            mu, sigma = z[begin] - origin, np.tile(np.diag(np.square(POSE_START)), (len(begin), 1, 1))
            known = np.zeros(len(begin), dtype=bool)
            if held is not None and key[0] == last:
                mu[0], sigma[0], origin[0] = held
                known[0] = True
            out = np.empty_like(z)
            for step in range(size.max()):
                live = np.nonzero(size > step)[0]
                go = live if step else live[known[live]]
                m, p = predicted(mu[go], sigma[go])
                m, p, _ = updated(m, p, np.eye(5), np.diag(np.square(OBSERVE_POSE)), pose_innovation(m, z[begin[go] + step] - origin[go]))
                mu[go], sigma[go] = m, p
                out[begin[live] + step] = mu[live] + origin[live]
            last, held = key[-1], (mu[-1], sigma[-1], origin[-1])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("seq"), *(pa.array(out[:, k]) for k in range(5))], ["key", "seq", "x", "y", "h", "v", "w"])

    ship(observed.sparkSession)
    ordered = observed.select(F.col("key").cast("long").alias("key"), F.col("seq").cast("long").alias("seq"), *values).repartition("key").sortWithinPartitions("key", "seq")
    return ordered.mapInArrow(run, "key bigint, seq bigint, x double, y double, h double, v double, w double")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows equal in keys, from batches that are sorted by them; a run may span batches."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        k = np.stack([t.column(c).to_numpy() for c in keys])
        edge = [0, *(np.nonzero((k[:, 1:] != k[:, :-1]).any(axis=0))[0] + 1), t.num_rows]
        for a, z in zip(edge[:-2], edge[1:-1], strict=True):
            yield t.slice(a, z - a)
        rest = t.slice(edge[-2])
    if rest is not None:
        yield rest


TRACKLET = "frame int, si int, sj int, i int, j int, x double, y double, h double, v double, w double, age int"


class Followed:
    """The tracklets of one sequence after a frame: at most one a column. cells: the columns they are in, ascending."""

    def __init__(self, res: float, dims: tuple[int, int]):
        self.res, self.dims, self.last = res, dims, None
        self._none()

    def _none(self) -> None:
        self.cells, self.mu, self.sigma, self.age = np.zeros(0, dtype=np.int64), np.zeros((0, 5)), np.zeros((0, 5, 5)), np.zeros(0, dtype=np.int32)

    def step(self, frame: int, i: np.ndarray, j: np.ndarray, u: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        """The columns of TRACKLET of the frame, whose valid motions are given."""
        if self.last is None or frame != self.last + 1:
            self._none()
        self.last = frame
        i, j, u, v = (np.asarray(x).astype(np.int64) for x in (i, j, u, v))
        at = np.searchsorted(self.cells, i * self.dims[1] + j)
        old = (at < len(self.cells)) & (np.append(self.cells, -1)[at] == i * self.dims[1] + j)
        target = np.stack([i + u - self.dims[0] // 2, j + v - self.dims[1] // 2], axis=1) * self.res
        step = np.stack([u, v], axis=1) * self.res
        m = np.concatenate([target - step, np.arctan2(step[:, 1], step[:, 0])[:, None], np.hypot(*(step / DT).T)[:, None], np.zeros((len(i), 1))], axis=1)
        p, n, ok = np.tile(np.diag(np.square(FLOW_START)), (len(i), 1, 1)), np.zeros(len(i), dtype=np.int32), np.ones(len(i), dtype=bool)
        a, b = predicted(self.mu[at[old]], self.sigma[at[old]])
        a, b, d = updated(a, b, np.eye(2, 5), np.eye(2) * OBSERVE_POSITION**2, target[old] - a[:, :2])
        m[old], p[old], n[old], ok[old] = a, b, self.age[at[old]] + 1, d < GATE
        to = ((i + u) * self.dims[1] + j + v)[ok]
        order = np.argsort(to)
        self.cells, self.mu, self.sigma, self.age = to[order], m[ok][order], p[ok][order], n[ok][order]
        ints = {"frame": np.full(len(to), frame), "si": i[ok], "sj": j[ok], "i": (i + u)[ok], "j": (j + v)[ok]}
        return {k: x.astype(np.int32) for k, x in ints.items()} | {k: m[ok][:, c] for c, k in enumerate("xyhvw")} | {"age": n[ok]}

    def packed(self) -> tuple[int, bytes, bytes, bytes, bytes]:
        return self.last, *(x.tobytes() for x in (self.cells, self.mu, self.sigma, self.age))

    def unpack(self, last: int, cells: bytes, mu: bytes, sigma: bytes, age: bytes) -> Followed:
        self.last, self.cells, self.age = last, np.frombuffer(cells, np.int64), np.frombuffer(age, np.int32)
        self.mu, self.sigma = np.frombuffer(mu).reshape(-1, 5), np.frombuffer(sigma).reshape(-1, 5, 5)
        return self


def tracklets(flow: DataFrame, res: float, dims: tuple[int, int], by: str = "sequence") -> DataFrame:
    """by, frame, si, sj (the column), i, j (where the tracklet now is), x, y, h, v, w, age: motion of columns followed over frames.

    flow: by, frame, i, j, u, v, valid. A valid column without a tracklet starts one at its place; one with
    a tracklet predicts, observes the target's centre and keeps the tracklet if it is inside the gate. In
    either case it moves to the target column for the next frame; a frame that is missing ends them all. A
    sequence passes through one task frame by frame; its state is at most one tracklet per column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None
        for t in grouped(batches, [by, "frame"]):
            here = t.column(by)[0].as_py()
            if now is None or here != last:
                last, now = here, Followed(res, dims)
            out = now.step(t.column("frame")[0].as_py(), *(t.column(c).to_numpy() for c in ("i", "j", "u", "v")))
            yield pa.RecordBatch.from_arrays([pa.array([here] * len(out["age"]), t.schema.field(by).type), *map(pa.array, out.values())], [by, *out])

    ship(flow.sparkSession)
    kind = flow.schema[by].dataType.simpleString()
    ordered = flow.where("valid = 1").select(by, "frame", "i", "j", "u", "v").repartition(by).sortWithinPartitions(by, "frame")
    return ordered.mapInArrow(run, f"{by} {kind}, {TRACKLET}")


def arrows(tracked: DataFrame, cells: DataFrame, spec: GridSpec, least_age: int = 3) -> DataFrame:
    """frame, x, y, z, x_from, y_from: each occupied cell (frame, i, j, k) of a tracklet's column, and where it was DT ago.

    Young tracklets, and those that move less than a cell on both axes, have no arrows.
    """
    met = cells.join(tracked.select("frame", F.col("si").alias("i"), F.col("sj").alias("j"), "h", "v", "age"), ["frame", "i", "j"])
    dx, dy = -DT * F.col("v") * F.cos("h"), -DT * F.col("v") * F.sin("h")
    moving = (F.col("age") >= least_age) & ((F.abs(dx) >= spec.res) | (F.abs(dy) >= spec.res))
    x, y, z = (spec.metres(F.col(c), a) for a, c in enumerate("ijk"))
    return met.where(moving).select("frame", x.alias("x"), y.alias("y"), z.alias("z"), (x + dx).alias("x_from"), (y + dy).alias("y_from"))


def fold_batch(state: tuple | None, batches: Iterator[pd.DataFrame], key) -> tuple[tuple | None, pd.DataFrame]:
    """One key's new observations onto its state (seq, mu, sigma, x0, y0, age); late ones are left out."""
    last, f = (None, None) if state is None else (state[0], Motion(state[1], None, state[3], state[4], state[5], state[2]))
    out = []
    rows = pd.concat(list(batches))
    for r in rows.sort_values("seq").itertuples():
        if last is not None and r.seq <= last:
            continue
        if f is None:
            f = Motion.at_pose(r.x, r.y, r.h, r.v_f, r.v_h)
        else:
            f.predict()
            f.observe_pose(r.x, r.y, r.h, r.v_f, r.v_h)
        last = int(r.seq)
        out.append((key, last, *map(float, f.place), float(f.mu[3]), float(f.mu[4])))
    new = None if f is None else (last, f.mu.tolist(), f.sigma.ravel().tolist(), float(f.x0), float(f.y0), int(f.age))
    return new, pd.DataFrame(out, columns=["key", "seq", "x", "y", "h", "v", "w"])
