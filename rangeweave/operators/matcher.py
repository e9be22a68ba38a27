"""Motion of grid columns with the full learned match: every displacement of the search, all rounds.

`flow` takes a pair of scans as one group: at most n0 * n1 columns a scan, two bit masks each, whatever the log's
length; the number of pairs is what grows. `flow_tiles` takes square tiles of a pair instead, for grids of any size: a tile
sees the columns around it that its scores and claims depend on, and between rounds the claims are settled by a
shuffle on their targets and dealt to the tiles that they concern. Both give the same rows. Spark makes the columns from
the grid and deals them; inside a task numpy scores and proposes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeweave.functions.grid_index import GridSpec
from rangeweave.operators.background import MODEL_ROWS, WINDOW
from rangeweave.operators.flow import EMPTY_SCORE, LENGTH_COST, OUTSIDE_SCORE, SCALE, SMOOTH, resolve
from rangeweave.operators.occupancy import LOG_MAX, LOG_MIN, by_scan, probability
from rangeweave.session import bounded, by_frame, ship, stored

# Fixed values, in hundredths: what a level adds that is free in both scans, occupied in both, or free
# in one and occupied in the other; and the offset of the sum.
FREE_WEIGHTS = (40, 64, 48, 23, 8, 1, 10, 6, 14, 6, 8, 10, 19, 34)
OCCUPIED_WEIGHTS = (56, 69, 105, 148, 149, 149, 165, 137, 158, 149, 236, 318, 320, 0)
MIXED_WEIGHTS = (32, 39, 1, -44, -60, -52, -53, -45, -58, -69, -15, 37, 40, 0)
WEIGHTS = (FREE_WEIGHTS, OCCUPIED_WEIGHTS, MIXED_WEIGHTS)
OFFSET = -141
#: Cells searched to each side, rounds, and the probability from which a column isn't empty.
SEARCH, ROUNDS, EVIDENT = 15, 20, 0.6
_NONE = np.iinfo(np.int32).min


def columns(grid: DataFrame, spec: GridSpec) -> DataFrame:
    """frame, i, j, free, occupied (bit masks of levels), evident (some level is likely occupied) of a grid's columns."""
    return columns_of(grid.select("frame", *spec.ijk(), "val"))


def columns_of(cells: DataFrame) -> DataFrame:
    """The same of cells (frame, i, j, k, val)."""
    level = lambda sign: F.bit_or(F.when(sign, F.expr("shiftleft(1, k)")).otherwise(0))
    return cells.groupBy("frame", "i", "j").agg(
        level(F.col("val") < 0).alias("free"), level(F.col("val") > 0).alias("occupied"), F.bool_or(probability(F.col("val")) > EVIDENT).alias("evident")
    )


def _shifts(w: int) -> tuple[np.ndarray, np.ndarray]:
    du, dv = np.mgrid[-w : w + 1, -w : w + 1].reshape(2, -1).astype(np.int32)
    return du, dv


def _box(plane: np.ndarray, r: int) -> np.ndarray:
    """Sums of the (2r+1)**2 cells around each cell of a plane that is padded by r."""
    for axis in (0, 1):
        size = plane.shape[axis] - 2 * r
        plane = sum(plane[k : k + size] if axis == 0 else plane[:, k : k + size] for k in range(2 * r + 1))
    return plane


def _bits(masks: np.ndarray, n: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(n) & 1).astype(np.float32)


@dataclass
class Filter:
    """Weights [2 * WINDOW + 1, 2 * WINDOW + 1, level] of free and of occupied cells around a column, and the offset of their sum."""

    free: np.ndarray
    occupied: np.ndarray
    offset: int

    @classmethod
    def of(cls, model: DataFrame, spec: GridSpec, offset: int) -> Filter:
        """model: di, dj, k, wf, wo, as for background.classify; it comes to the driver, refused beyond MODEL_ROWS rows."""
        free, occupied = (np.zeros((2 * WINDOW + 1, 2 * WINDOW + 1, spec.n2), dtype=np.float32) for _ in range(2))
        for r in bounded(model, MODEL_ROWS).collect():
            at = r["di"] + WINDOW, r["dj"] + WINDOW, r["k"]
            free[at], occupied[at] = r["wf"], r["wo"]
        return cls(free, occupied, offset)

    def background(self, cols: np.ndarray, spec: GridSpec) -> np.ndarray:
        """Whether each column of a scan (rows i, j, free, occupied) is background: background.classify of those columns."""
        if not len(cols):
            return np.zeros(0, dtype=bool)
        i, j = (cols[:, a] - cols[:, a].min() + WINDOW for a in (0, 1))
        f, o = _bits(cols[:, 2], spec.n2), _bits(cols[:, 3], spec.n2)
        score = np.zeros((i.max() + 2 * WINDOW + 1, j.max() + 2 * WINDOW + 1))
        sent = self.free.reshape(-1, spec.n2) @ f.T + self.occupied.reshape(-1, spec.n2) @ o.T
        at = i * score.shape[1] + j
        for w, (a, b) in zip(sent, np.ndindex(*self.free.shape[:2]), strict=True):
            score.ravel()[at - (a - WINDOW) * score.shape[1] - b + WINDOW] += w
        return score[i, j] + self.offset <= 0


def _distinct(masks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(free bits, occupied bits, which of them each row has) of the distinct pairs of masks (free, occupied)."""
    pair, which = np.unique(masks[:, 0].astype(np.int64) << 32 | masks[:, 1], return_inverse=True)
    return _bits(pair >> 32, n), _bits(pair & 0xFFFFFFFF, n), which


#: Numbers that a task holds at once while it scores.
AT_ONCE = 500_000


def all_scores(source: np.ndarray, later: np.ndarray, spec: GridSpec, weights: Sequence[Sequence[int]], offset: int, w: int) -> np.ndarray:
    """[source column, displacement]: the log match score in 1 / SCALE.

    source, later: rows (i, j, free, occupied); a later column outside the grid has no level known. What a pair of columns scores
    depends on their levels alone, so distinct ones are scored, each pair once, and displacements look that up. If there are more such
    pairs than scores, squares of sources are scored with all that is in their reach, some 2 (at most 2.25) pairs for each score.
    """
    out = np.empty((len(source), (2 * w + 1) ** 2), dtype=np.int32)
    if not len(source):
        return out
    free, occupied, mixed = (np.array(x, dtype=np.float32) for x in weights)
    most = int(np.abs(np.stack([free, occupied, mixed])).max(axis=0).sum()) + 1
    logs = np.rint(-np.log1p(np.exp(-(np.arange(-most, most + 1, dtype=np.float64) + offset) / 100.0)) * SCALE).astype(np.int32)
    low, size = source[:, :2].min(axis=0), np.ptp(source[:, :2], axis=0) + 1
    later = later[((later[:, :2] >= low - w) & (later[:, :2] < low + size + w)).all(axis=1)]
    f, o, which = _distinct(np.concatenate([later[:, 2:4], np.zeros((1, 2), dtype=later.dtype)]), spec.n2)
    ahead = np.concatenate([free * f + mixed * o, occupied * o + mixed * f], axis=1).T
    at = np.full(size + 2 * w, which[-1], dtype=np.int64)  # the last is the column of which nothing is known
    at[tuple((later[:, :2] - low + w).T)] = which[:-1]
    around = np.lib.stride_tricks.sliding_window_view(at, (2 * w + 1, 2 * w + 1))
    f, o, mine = _distinct(source[:, 2:4], spec.n2)
    own = np.concatenate([f, o], axis=1)
    order, (i, j) = np.argsort(mine, kind="stable"), (source[:, :2] - low).T
    if len(own) * ahead.shape[1] > out.size:
        # Sources that are close together see much the same later columns: a square of them meets those within its reach in one product.
        edge, wide, side = w + 1, 3 * w + 1, 2 * w + 1
        place = np.full(size + 3 * w, which[-1], dtype=np.int64)
        place[: at.shape[0], : at.shape[1]] = at
        own, ahead = np.pad(own, [(0, 0), (0, 1)], constant_values=1), np.pad(ahead, [(0, 1), (0, 0)], constant_values=most)[:, place]
        square = i // edge * size[1] + j // edge
        order = np.argsort(square, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(square[order])) + 1):
            a, b = i[rows[0]] // edge * edge, j[rows[0]] // edge * edge
            score = own[mine[rows]] @ ahead[:, a : a + wide, b : b + wide].reshape(len(ahead), -1)
            seen = np.lib.stride_tricks.sliding_window_view(score.reshape(-1, wide, wide), (side, side), axis=(1, 2))
            out[rows] = logs[seen[np.arange(len(rows)), i[rows] - a, j[rows] - b].reshape(len(rows), -1).astype(np.int64)]
        return out
    for rows in np.array_split(order, max(1, -(-len(order) * max(out.shape[1], ahead.shape[1]) // AT_ONCE))):
        first = mine[rows[0]] if len(rows) else 0
        if len(rows):
            score = logs[(own[first : mine[rows[-1]] + 1] @ ahead).astype(np.int64) + most].ravel()
            near = around[i[rows], j[rows]].reshape(len(rows), -1)
            near += ((mine[rows] - first) * ahead.shape[1])[:, None]
            out[rows] = score[near]
    return out


def displaced_scores(source: np.ndarray, later: np.ndarray, spec: GridSpec, weights: Sequence[Sequence[int]], offset: int, w: int) -> Iterator[np.ndarray]:
    """For each displacement in turn, all_scores of every source column."""
    yield from all_scores(source, later, spec, weights, offset, w).T


def window_scores(source: np.ndarray, later: np.ndarray, spec: GridSpec, weights: Sequence[Sequence[int]], offset: int, w: int, own: np.ndarray | None = None) -> np.ndarray:
    """[source column, displacement]: 3x3 sums of displaced_scores. own: the source rows that are wanted (all).

    A neighbour that is no source counts as EMPTY_SCORE, one outside the grid as OUTSIDE_SCORE. The sums take the scores' place,
    some displacements at a time.
    """
    own = np.ones(len(source), dtype=bool) if own is None else own
    if not own.any():
        return np.empty((0, (2 * w + 1) ** 2), dtype=np.int32)
    n = len(source)
    out = all_scores(source, later, spec, weights, offset, w)
    low, size = source[:, :2].min(axis=0), np.ptp(source[:, :2], axis=0) + 1
    i, j = (source[:, :2] - low).T
    row = np.full(size + 2, n + 1)
    a, b = (slice(max(0, 1 - low[k]), spec.dims[k] - low[k] + 1) for k in (0, 1))
    row[a, b] = n
    row[i + 1, j + 1] = np.arange(n)
    near = np.stack([row[i[own] + a, j[own] + b] for a in range(3) for b in range(3)])
    still = ((near == n) * EMPTY_SCORE + (near == n + 1) * OUTSIDE_SCORE).sum(axis=0, dtype=np.int32)[:, None]
    met = [(r, x[r]) for x in near for r in [np.flatnonzero(x < n)]]
    held = np.flatnonzero(own)
    step = max(1, AT_ONCE // n)
    for d in range(0, out.shape[1], step):
        part = out[:, d : d + step].copy()
        total = np.repeat(still, part.shape[1], axis=1)
        for r, x in met:
            total[r] += part[x]
        out[held, d : d + step] = total
    return out if own.all() else out[held]


def moves(win: np.ndarray, i: np.ndarray, j: np.ndarray, spec: GridSpec, w: int, weight: int = 1, near: np.ndarray | None = None, owners: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """u, v, score (the least int, and no motion, where none is admissible): each source's best displacement.

    near: rows (i, j, u, v) of what moved in the round before; they pull the sources within SMOOTH. owners: rows (target
    i, j, source i, j, score); a target is open to its owner and to sources that score higher. Sources are gone through some at
    a time, so that what is held beside win is bounded.
    """
    top, at = np.full(len(i), _NONE, dtype=np.int32), np.zeros(len(i), dtype=np.int64)
    du, dv = _shifts(w)
    if len(i):
        pad, side = max(w, SMOOTH), 2 * w + 1
        low = np.array([i.min() - pad, j.min() - pad])
        shape = tuple(np.array([i.max() + pad + 1, j.max() + pad + 1]) - low)
        x, y = i - low[0], j - low[1]
        inside = lambda c: ((c >= low) & (c < low + shape)).all(axis=1)
        a = np.arange(-w, w + 1, dtype=np.int32)
        ways = [LENGTH_COST * a * a + np.zeros((len(i), 1), dtype=np.int32)] * 2  # what a step on one axis takes off the score
        if near is not None and len(near):
            near = near[inside(near[:, :2])]

            def around(value: np.ndarray) -> np.ndarray:
                plane = np.zeros(shape, dtype=np.int32)
                plane[tuple((near[:, :2] - low).T)] = value
                return (_box(plane, SMOOTH)[x - SMOOTH, y - SMOOTH] - plane[x, y])[:, None]

            u, v = near[:, 2], near[:, 3]
            n = around(np.ones_like(u))
            ways = [c + weight * (n * a * a - 2 * around(m) * a) for c, m in zip(ways, (u, v), strict=True)]
            ways[0] = ways[0] + weight * around(u * u + v * v)
        # Beyond the grid no score is high enough; inside, one has to exceed the owner's.
        best, mine = np.full(shape, np.iinfo(np.int32).max, dtype=np.int32), np.full(shape, -1, dtype=np.int64)
        p, q = (slice(max(0, -low[k]), max(0, spec.dims[k] - low[k])) for k in (0, 1))
        best[p, q] = _NONE
        if owners is not None and len(owners):
            owners = owners[inside(owners[:, :2])]
            best[tuple((owners[:, :2] - low).T)] = owners[:, 4]
            owners = owners[inside(owners[:, 2:4]) & (np.abs(owners[:, :2] - owners[:, 2:4]) <= w).all(axis=1)]
            mine[tuple((owners[:, 2:4] - low).T)] = (owners[:, 0] - owners[:, 2] + w) * side + owners[:, 1] - owners[:, 3] + w
        least = np.lib.stride_tricks.sliding_window_view(best, (side, side))
        kept = mine[x, y]
        step = max(1, AT_ONCE // len(du))
        for begin in range(0, len(i), step):
            rows = slice(begin, begin + step)
            s = win[rows].reshape(-1, side, side) - ways[0][rows][:, :, None]
            s -= ways[1][rows][:, None, :]
            shut = (s <= least[x[rows] - w, y[rows] - w]).reshape(len(s), -1)
            has = np.flatnonzero(kept[rows] >= 0)
            shut[has, kept[rows][has]] = False
            s = s.reshape(len(s), -1)
            s = np.where(shut, np.int32(_NONE), s)
            at[rows] = s.argmax(axis=1)  # of equals the first: least du, then least dv
            top[rows] = s[np.arange(len(s)), at[rows]]
    there = top > _NONE
    return np.where(there, du[at], 0), np.where(there, dv[at], 0), top


def _stirred(win: np.ndarray, i: np.ndarray, j: np.ndarray, w: int, before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Whether each source may propose something else after the state now (u, v, valid, score) than it did after the one before.

    It does only if it moved itself, if a pull on it changed, or if among the targets of sources that moved are its own choice or one that it
    wants as much: pulls only lower a score, so one without them tells. Where that is as much work as to propose anew, all may.
    """
    moved = (before != now).any(axis=0)
    if moved.sum() * (1 + 8 * len(i) / ((np.ptp(i) + 1) * (np.ptp(j) + 1))) > len(i) / 2:
        return np.ones(len(i), dtype=bool)
    pad, side = max(w, SMOOTH), 2 * w + 1
    x, y = i - i.min() + pad, j - j.min() + pad
    shape = x.max() + pad + 1, y.max() + pad + 1
    held = np.concatenate([np.stack([x + s[0], y + s[1]])[:, moved & (s[2] == 1)] for s in (before, now)], axis=1)
    pulled, open_, best = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool), np.full(shape, _NONE)
    ok = now[2] == 1
    best[x[ok] + now[0, ok], y[ok] + now[1, ok]] = now[3, ok]
    open_[tuple(held)] = True
    for a, b in np.ndindex(2 * SMOOTH + 1, 2 * SMOOTH + 1):
        pulled[x[moved] + a - SMOOTH, y[moved] + b - SMOOTH] = True
    out = moved | pulled[x, y] | open_[x + now[0], y + now[1]]
    there = np.full((shape[0] + 2 * pad, shape[1] + 2 * pad), -1)
    there[x + pad, y + pad] = np.arange(len(i))
    around = np.lib.stride_tricks.sliding_window_view(there, (side, side))
    length = (LENGTH_COST * np.add.outer(np.arange(-w, w + 1) ** 2, np.arange(-w, w + 1) ** 2)).ravel()
    to = np.argwhere(open_)
    for t in np.array_split(to, len(to) * side * side // AT_ONCE + 1):
        near = around[t[:, 0] + pad - w, t[:, 1] + pad - w].reshape(len(t), side * side)[:, ::-1]  # by the displacement to the target
        k, d = np.nonzero(near >= 0)
        source = near[k, d]
        most = win[source, d] - length[d]
        out[source[(most >= now[3, source]) & (most > best[t[k, 0], t[k, 1]])]] = True
    return out


def settle(win: np.ndarray, i: np.ndarray, j: np.ndarray, spec: GridSpec, w: int, rounds: int, weight: int = 1) -> tuple[np.ndarray, ...]:
    """u, v, valid, score (no admissible displacement: the least int) of the sources after the rounds of flow.propose and flow.resolve.

    Ends before, once a round changes nothing. From the third round on, only sources that the last one can have stirred propose anew.
    """
    i, j = i.astype(np.int32), j.astype(np.int32)
    before = last = near = owners = None
    u, v, score = np.zeros((3, len(i)), dtype=np.int32)
    for _ in range(rounds):
        rows = np.ones(len(i), dtype=bool) if before is None or weight < 0 else _stirred(win, i, j, w, before, last)
        all_ = rows.all()
        new = moves(win if all_ else win[rows], i[rows], j[rows], spec, w, weight, near, owners)
        u, v, score = new if all_ else (np.copy(x) for x in (u, v, score))
        if not all_:
            u[rows], v[rows], score[rows] = new
        there = score > _NONE
        to = np.where(there, (i + u).astype(np.int64) * spec.n1 + j + v, -1)
        order = np.lexsort((j, i, -score.astype(np.int64), to))
        valid = np.zeros(len(i), dtype=np.int32)
        valid[order[np.diff(to[order], prepend=-2) != 0]] = 1
        valid[~there] = 0
        now = np.stack([u, v, valid, score])
        if last is not None and (now == last).all():
            break
        before, last, ok = last, now, valid == 1
        near, owners = np.stack([i, j, u, v], axis=1)[ok], np.stack([i + u, j + v, i, j, score], axis=1)[ok]
    return u, v, valid, score


_COLUMNS = ["i", "j", "free", "occupied"]


def _rows(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().astype(np.int32) for c in _COLUMNS], axis=1)


def scan_columns(points: DataFrame, spec: GridSpec, filter: Filter | None = None) -> DataFrame:
    """`columns` of the grid of points (frame, x, y, z), made where their scan is traced: its cells are no rows.

    filter: columns that it takes for background aren't evident, so that they have no motion in `flow`, which then needs no filter.
    """
    bits = 1 << np.arange(spec.n2, dtype=np.int32)

    def made(free: np.ndarray, occupied: np.ndarray) -> dict[str, np.ndarray]:
        known = np.flatnonzero((free + occupied).reshape(-1, spec.n2).any(axis=1))
        val = (10 * occupied - free).reshape(-1, spec.n2)[known] / 10
        evident = (1 - 1 / (1 + np.exp(np.clip(val, LOG_MIN, LOG_MAX))) > EVIDENT).any(axis=1)
        i, j = np.divmod(known.astype(np.int32), np.int32(spec.n1))
        masks = [x.dot(bits).astype(np.int32) for x in (val < 0, val > 0)]
        if filter is not None:
            evident &= ~filter.background(np.stack([i, j, *masks], axis=1), spec)
        return dict(zip((*_COLUMNS, "evident"), (i, j, *masks, evident), strict=True))

    return by_scan(points, spec, made, "i int, j int, free int, occupied int, evident boolean")


def _sources(t: pa.Table, spec: GridSpec, filter: Filter | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns of the earlier scan that have a motion to be found, columns of the later scan)."""
    x, later, evident = _rows(t), t.column("later").to_numpy(), t.column("evident").to_numpy()
    first, ahead = x[~later], x[later]
    known = evident[~later] if filter is None else evident[~later] & ~filter.background(first, spec)
    return first[known], ahead


def _paired(cols: DataFrame, filter: Filter | None) -> DataFrame:
    """cols of every frame, and once more, as later ones, of the frame before. Earlier ones that aren't evident matter to a filter alone."""
    both = cols.withColumn("later", F.explode(F.array(F.lit(False), F.lit(True))))  # one pass: a union would make the columns twice
    if filter is None:
        both = both.where("later OR evident")
    return both.select((F.col("frame") - F.col("later").cast("int")).cast("int").alias("frame"), "later", *_COLUMNS, "evident")


def _pairs(cols: DataFrame, filter: Filter | None = None) -> DataFrame:
    """Pairs of scans, dealt to all shuffle partitions: by size alone a task would get many, and each is much work."""
    return by_frame(_paired(cols, filter)).groupBy("frame")


FOUND = "frame int, i int, j int, u int, v int, valid int, score bigint"


def _found(frame: int, *cols: np.ndarray, score: np.ndarray) -> pa.Table:
    out = [pa.array(np.full(len(score), frame, dtype=np.int32)), *(pa.array(c.astype(np.int32)) for c in cols)]
    return pa.table([*out, pa.array(score.astype(np.int64), mask=score == _NONE)], names=["frame", "i", "j", "u", "v", "valid", "score"])


def flow(cols: DataFrame, spec: GridSpec, weights: Sequence[Sequence[int]] = WEIGHTS, offset: int = OFFSET, w: int = SEARCH, rounds: int = ROUNDS, filter: Filter | None = None) -> DataFrame:
    """frame, i, j, u, v, valid, score of the evident columns of every frame that has a next one.

    cols: frame, i, j, free, occupied, evident (see columns). score is null where no displacement is admissible.
    filter: columns that it takes for background have no motion, and are empty to those around them; as targets they stay.
    """

    def run(key: tuple, pair: pa.Table) -> pa.Table:
        source, ahead = _sources(pair, spec, filter)
        if not len(ahead):
            source = source[:0]
        i, j = source[:, 0], source[:, 1]
        u, v, valid, score = settle(window_scores(source, ahead, spec, weights, offset, w), i, j, spec, w, rounds)
        return _found(key[0].as_py(), i, j, u, v, valid, score=score)

    ship(cols.sparkSession)
    return _pairs(cols, filter).applyInArrow(run, FOUND)


def scored(cols: DataFrame, spec: GridSpec, weights: Sequence[Sequence[int]] = WEIGHTS, offset: int = OFFSET, w: int = SEARCH, windowed: bool = True) -> DataFrame:
    """frame, i, j, du, dv and win (of the 3x3 window) or score (of the column alone): a row for each evident column and displacement."""
    name = "win" if windowed else "score"

    def run(key: tuple, pair: pa.Table) -> pa.Table:
        source, ahead = _sources(pair, spec, None)
        source = source if len(ahead) else source[:0]
        n, (du, dv) = len(source), _shifts(w)
        if windowed or not n:
            value = window_scores(source, ahead, spec, weights, offset, w)
        else:
            value = all_scores(source, ahead, spec, weights, offset, w)
        cols = [np.full(n * len(du), key[0].as_py(), dtype=np.int32), *(np.repeat(source[:, a], len(du)) for a in (0, 1)), np.tile(du, n), np.tile(dv, n)]
        return pa.table([*(pa.array(c.astype(np.int32)) for c in cols), pa.array(value.ravel().astype(np.int64))], names=["frame", "i", "j", "du", "dv", name])

    ship(cols.sparkSession)
    return _pairs(cols).applyInArrow(run, f"frame int, i int, j int, du int, dv int, {name} bigint")


def proposed(cols: DataFrame, spec: GridSpec, weights: Sequence[Sequence[int]] = WEIGHTS, offset: int = OFFSET, w: int = SEARCH) -> DataFrame:
    """The first proposals of `flow`, before targets are settled: flow.propose of the windows."""

    def run(key: tuple, pair: pa.Table) -> pa.Table:
        source, ahead = _sources(pair, spec, None)
        source = source if len(ahead) else source[:0]
        i, j = source[:, 0], source[:, 1]
        u, v, score = moves(window_scores(source, ahead, spec, weights, offset, w), i, j, spec, w)
        return _found(key[0].as_py(), i, j, u, v, score > _NONE, score=score)

    ship(cols.sparkSession)
    return _pairs(cols).applyInArrow(run, FOUND)


# -- tiles ---------------------------------------------------------------------------------------

#: Edge of a tile in columns.
EDGE = 64
_TILE = ["frame", "tx", "ty"]


def _dealt(rows: DataFrame, spec: GridSpec, edge: int, reach, i: str = "i", j: str = "j") -> DataFrame:
    """rows, once for every tile that their place is within reach of (a number or a column), with tx, ty."""
    for c, n, t in ((i, spec.n0, "tx"), (j, spec.n1, "ty")):
        low, high = F.greatest(F.floor((F.col(c) - reach) / edge), F.lit(0)), F.least(F.floor((F.col(c) + reach) / edge), F.lit((n - 1) // edge))
        rows = rows.withColumn(t, F.explode(F.when(low <= high, F.sequence(low, high))))
    return rows


def flow_tiles(cols: DataFrame, spec: GridSpec, weights: Sequence[Sequence[int]] = WEIGHTS, offset: int = OFFSET, w: int = SEARCH, rounds: int = ROUNDS, filter: Filter | None = None, edge: int = EDGE) -> DataFrame:
    """The rows of `flow`, by tiles: a task holds (edge + 2 * w + 2) ** 2 columns a scan at most, whatever the grid.

    After a round, only the tiles that a change can reach propose anew; the rounds end when nothing has changed.
    """
    ship(cols.sparkSession)
    halo = F.when(F.col("later"), w + 1).otherwise(1 if filter is None else 1 + 2 * WINDOW)
    paired = _paired(stored(cols, "columns"), filter)
    followed = paired.where("later").select("frame").distinct()
    given = _dealt(paired, spec, edge, halo).join(followed, "frame", "left_semi")

    def propose(key: tuple, here: pa.Table, state: pa.Table) -> pa.Table:
        frame, tx, ty = (k.as_py() for k in key)
        if not here.num_rows:
            nothing = np.zeros(0, dtype=np.int32)
            return _found(frame, *[nothing] * 5, score=nothing)
        source, ahead = _sources(here, spec, filter)
        ring = ((source[:, :2] >= [tx * edge - 1, ty * edge - 1]) & (source[:, :2] <= [(tx + 1) * edge, (ty + 1) * edge])).all(axis=1)
        source = source[ring]
        own = (source[:, :2] // edge == [tx, ty]).all(axis=1)
        i, j = source[own, 0], source[own, 1]
        known = np.stack([state.column(c).to_numpy().astype(np.int32) for c in "abcde"], axis=1) if state.num_rows else np.zeros((0, 5), dtype=np.int32)
        pulls = state.column("pull").to_numpy(zero_copy_only=False) if state.num_rows else np.zeros(0, dtype=bool)
        u, v, score = moves(window_scores(source, ahead, spec, weights, offset, w, own), i, j, spec, w, 1, known[pulls, :4], known[~pulls])
        return _found(frame, i, j, u, v, score > _NONE, score=score)

    def proposed(tiles: DataFrame, state: DataFrame) -> DataFrame:
        return tiles.groupBy(*_TILE).cogroup(state.groupBy(*_TILE)).applyInArrow(propose, FOUND)

    tile = [F.floor(F.col("i") / edge).alias("tx"), F.floor(F.col("j") / edge).alias("ty")]
    state = given.sparkSession.createDataFrame([], "frame int, tx bigint, ty bigint, pull boolean, a int, b int, c int, d int, e bigint")
    claims = stored(proposed(given, state), "claims")
    found, changed = stored(resolve(claims), "moves"), None
    for _ in range(1, rounds):
        held = found.where("valid = 1")
        pull = _dealt(held.selectExpr("frame", "i", "j", "true AS pull", "i AS a", "j AS b", "u AS c", "v AS d", "0L AS e"), spec, edge, SMOOTH)
        owner = _dealt(held.selectExpr("frame", "i + u AS i", "j + v AS j", "false AS pull", "i + u AS a", "j + v AS b", "i AS c", "j AS d", "score AS e"), spec, edge, w)
        state = pull.unionByName(owner).drop("i", "j")
        if changed is None:
            anew = proposed(given, state)
        else:
            anew = proposed(given.join(changed.toDF(*_TILE), _TILE, "left_semi"), state.join(changed.toDF(*_TILE), _TILE, "left_semi"))
            kept = claims.select("*", *tile).join(changed.toDF(*_TILE), _TILE, "left_anti").select(*claims.columns)
            anew = anew.unionByName(kept)
        claims = stored(anew, "claims")
        now = stored(resolve(claims), "moves")
        old = found.toDF("frame", "i", "j", *(f"_{c}" for c in ("u", "v", "valid", "score")))
        same = (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v")) & (F.col("valid") == F.col("_valid")) & F.col("score").eqNullSafe(F.col("_score"))
        differ = now.join(old, ["frame", "i", "j"]).where(~same).select("frame", "i", "j")
        changed = stored(_dealt(differ, spec, edge, 2 * w + SMOOTH).select(*_TILE).distinct(), "changed")
        found = now
        if changed.isEmpty():
            break
    return found
