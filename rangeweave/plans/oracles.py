"""DuckDB statements that answer the registered queries on their own."""

from __future__ import annotations

from rangeweave.functions.geometry import VIEW_HEIGHT, VIEW_WIDTH
from rangeweave.functions.grid_index import GridSpec
from rangeweave.operators import matcher
from rangeweave.plans.fixtures import CAMERA, DRIVE_FILTER_OFFSET, FILTER_OFFSET, FOLLOWED, MATCH_OFFSET, SPEC, SQL, with_views
from rangeweave.sources import scans

SEARCH, ROUNDS = 3, 3
RES = f"CAST({SPEC.res!r} AS DOUBLE)"
ORIGIN = (0.0, 0.0, 1.73)


def _key(s: GridSpec, i: str, j: str, k: str) -> str:
    return f"CASE WHEN {i} BETWEEN 0 AND {s.n0 - 1} AND {j} BETWEEN 0 AND {s.n1 - 1} AND {k} BETWEEN 0 AND {s.n2 - 1} THEN (CAST({i} AS BIGINT) * {s.n1} + {j}) * {s.n2} + {k} ELSE -1 END"


def _rays(s: GridSpec) -> str:
    end = ", ".join(f"CAST(round_even({c} / {s.res!r}, 0) AS INT) + {n // 2} AS e{a}" for a, (c, n) in enumerate(zip("xyz", s.dims, strict=True)))
    return f"SELECT frame, {end}, CASE WHEN abs(x - 1.5) < 3 AND abs(y) < 1.75 THEN 0 ELSE 1 END AS hit FROM raw_scan"


def _walked(s: GridSpec, limit: int, rays: str = "rays", p: list[str] | None = None) -> str:
    p = p or [round(o / s.res) + n // 2 for o, n in zip(ORIGIN, s.dims, strict=True)]
    far = "greatest(" + ", ".join(f"abs(e{a} - {p[a]})" for a in range(3)) + ")"
    cell = [f"(CASE WHEN e{a} < {p[a]} THEN -1 ELSE 1 END * ((2 * abs(e{a} - {p[a]}) * s + n) // (2 * n)) + {p[a]})" for a in range(3)]
    there = f"CASE WHEN {_key(s, *map(str, p))} >= 0 THEN least(n, {limit - 1}) ELSE 0 END"
    return f"SELECT *, {_key(s, *cell)} AS key FROM (SELECT *, CAST(unnest(range({there})) AS INT) AS s FROM (SELECT *, {far} AS n FROM {rays}) WHERE n > 0)"


def _grid(s: GridSpec, limit: int | None = None) -> str:
    end = _key(s, "e0", "e1", "e2")
    return (
        f"SELECT frame, key, CAST(sum(f) AS BIGINT) AS n_free, CAST(sum(o) AS BIGINT) AS n_occ, (10 * sum(o) - sum(f)) / 10 AS val FROM ("
        f"SELECT frame, key, 1 AS f, 0 AS o FROM ({_walked(s, limit or max(s.dims), f'({_rays(s)})')}) WHERE key >= 0 "
        f"UNION ALL SELECT frame, {end} AS key, 0, 1 FROM ({_rays(s)}) WHERE hit = 1 AND {end} >= 0) GROUP BY ALL"
    )


def _posed() -> str:
    """The grid of raw_scan moved by frame_poses, its rays from the moved origin."""
    cr, sr, cp, sp, ch, sh = (f"{f}(q.{a})" for a in "rph" for f in ("cos", "sin"))
    m = [
        [f"{ch} * {cp}", f"({ch} * {sp} * {sr} - {sh} * {cr})", f"({ch} * {sp} * {cr} + {sh} * {sr})"],
        [f"{sh} * {cp}", f"({sh} * {sp} * {sr} + {ch} * {cr})", f"({sh} * {sp} * {cr} - {ch} * {sr})"],
        [f"-{sp}", f"{cp} * {sr}", f"{cp} * {cr}"],
    ]
    place = lambda a, v: " + ".join(f"{m[a][b]} * {v[b]}" for b in range(3)) + f" + q.{'xyz'[a]}"
    cell = lambda c, a: f"CAST(round_even(({c}) / {SPEC.res!r}, 0) AS INT) + {SPEC.dims[a] // 2}"
    start = [f"CAST({o!r} AS DOUBLE)" for o in ORIGIN]
    cols = ", ".join(f"{cell(place(a, ('s.x', 's.y', 's.z')), a)} AS e{a}, {cell(place(a, start), a)} AS o{a}" for a in range(3))
    end = _key(SPEC, "e0", "e1", "e2")
    return with_views(
        "SELECT frame, key, CAST(sum(f) AS BIGINT) AS n_free, CAST(sum(o) AS BIGINT) AS n_occ, (10 * sum(o) - sum(f)) / 10 AS val FROM ("
        f"SELECT frame, key, 1 AS f, 0 AS o FROM ({_walked(SPEC, max(SPEC.dims), 'rays', ['o0', 'o1', 'o2'])}) WHERE key >= 0 "
        f"UNION ALL SELECT frame, {end} AS key, 0, 1 FROM rays WHERE hit = 1 AND {end} >= 0) GROUP BY ALL",
        "raw_scan", "frame_poses",
        rays=f"SELECT s.frame, {cols}, CASE WHEN abs(s.x - 1.5) < 3 AND abs(s.y) < 1.75 THEN 0 ELSE 1 END AS hit FROM raw_scan s JOIN frame_poses q ON q.frame = s.frame",
    )


def _packets() -> str:
    rank = {f: r for r, f in enumerate(sorted(range(len(scans.ELEVATIONS)), key=scans.ELEVATIONS.__getitem__))}
    lasers = ", ".join(f"({f}, {rank[f]}, CAST({p!r} AS DOUBLE))" for f, p in enumerate(scans.ELEVATIONS))
    number = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    return with_views(
        f"SELECT packet_id, block, firing, sorted, intensity, {_rounded('range', 'theta', 'phi')}, round(range * cos(theta) * cos(phi), 6) AS x, round(-range * sin(theta) * cos(phi), 6) AS y, round(range * sin(phi), 6) AS z FROM turned JOIN lasers USING (firing) WHERE range >= {number(scans.NEAREST)}",
        "slots", lasers=f"SELECT * FROM (VALUES {lasers}) t(firing, sorted, phi)",
        late=f"SELECT packet_id, CAST(slot // 32 AS INT) AS block, CAST(slot % 32 AS INT) AS firing, CAST(v % 256 AS INT) AS intensity, (v // 256) * {number(scans.RANGE_UNIT)} AS range, ((packet_id * 97 + (slot // 32) * 40) % 36000) * {number(scans.ANGLE_UNIT)} + {number(scans.SPIN_RATE)} * (slot % 32) * {number(scans.LASER_DELAY)} AS a FROM slots",
        turned="SELECT *, CASE WHEN a >= 2 * pi() THEN a - 2 * pi() ELSE a END AS theta FROM late",
    )


def _ijk(s: GridSpec = SPEC) -> str:
    return f"CAST(key // {s.n1 * s.n2} AS INT) AS i, CAST(key // {s.n2} % {s.n1} AS INT) AS j, CAST(key % {s.n2} AS INT) AS k"


def on_grid(query: str) -> str:
    return with_views(query, "raw_scan", grid=_grid(SPEC), cells=f"SELECT *, {_ijk()} FROM grid")


def _levels() -> str:
    s, limit, parts = SPEC, max(SPEC.dims), []
    for level in range(3):
        parts.append(f"SELECT {level} AS level, * FROM ({_grid(s, limit)})")
        s, limit = s.coarser(), -(-limit // 2)
    return with_views(" UNION ALL ".join(parts), "raw_scan")


def _subset() -> str:
    t = GridSpec(80, 80, 14, 0.3)
    at = [f"(i - {t.n0 // 2}) * {t.res!r} * cos(0.0) - (j - {t.n1 // 2}) * {t.res!r} * sin(0.0) + 1.5", f"(i - {t.n0 // 2}) * {t.res!r} * sin(0.0) + (j - {t.n1 // 2}) * {t.res!r} * cos(0.0) + -0.6", f"(k - {t.n2 // 2}) * {t.res!r}"]
    cell = [f"(CAST(round(({a}) / {RES}) AS INT) + {n // 2})" for a, n in zip(at, SPEC.dims, strict=True)]
    target = f"SELECT key, {_key(SPEC, *cell)} AS src FROM (SELECT key, {_ijk(t)} FROM (SELECT r AS key FROM range({t.n0 * t.n1 * t.n2}) x(r)))"
    return with_views("SELECT g.frame, t.key, g.val FROM target t JOIN grid g ON g.key = t.src WHERE abs(g.val) >= 0.01", "raw_scan", grid=_grid(SPEC), target=target)


_FILTER = {
    "hits": "SELECT c.frame, c.i - m.di AS i, c.j - m.dj AS j, CASE WHEN c.val < 0 THEN m.wf ELSE m.wo END AS w FROM valued_cells c JOIN bg_model m ON c.k = m.k",
    "score": "SELECT frame, i, j, sum(w) AS s FROM hits GROUP BY ALL",
    "every": f"SELECT frame, CAST(a AS INT) AS i, CAST(b AS INT) AS j FROM (SELECT DISTINCT frame FROM valued_cells), range({SPEC.n0}) x(a), range({SPEC.n1}) y(b)",
    "filtered": f"SELECT e.frame, e.i, e.j, CAST(coalesce(s, 0) + {FILTER_OFFSET} AS BIGINT) AS score, CASE WHEN coalesce(s, 0) + {FILTER_OFFSET} > 0 THEN 0 ELSE 1 END AS background FROM every e LEFT JOIN score c ON e.frame = c.frame AND e.i = c.i AND e.j = c.j",
}


def on_filter(query: str, **more: str) -> str:
    return with_views(query, "scan_cells", "valued_cells", "bg_model", **_FILTER, **more)


_N0, _N1 = SPEC.n0, SPEC.n1
_WIN = {
    "disp": f"SELECT CAST(a - {SEARCH} AS INT) AS du, CAST(b - {SEARCH} AS INT) AS dv FROM range({2 * SEARCH + 1}) x(a), range({2 * SEARCH + 1}) y(b)",
    "src": f"SELECT DISTINCT frame, i, j FROM scan_cells WHERE {FOLLOWED}",
    "hit": "SELECT c.frame, c.i, c.j, d.du, d.dv, sum(w.wo) AS s FROM scan_cells c CROSS JOIN disp d JOIN scan_cells n ON n.frame = c.frame + 1 AND n.i = c.i + d.du AND n.j = c.j + d.dv AND n.k = c.k JOIN level_weights w ON w.k = c.k GROUP BY ALL",
    "scores": f"SELECT s.frame, s.i, s.j, d.du, d.dv, CAST(round(-ln(1 + exp(-(coalesce(h.s, 0) + {MATCH_OFFSET}) / 100.0)) * 1000) AS BIGINT) AS score FROM src s CROSS JOIN disp d LEFT JOIN hit h ON h.frame = s.frame AND h.i = s.i AND h.j = s.j AND h.du = d.du AND h.dv = d.dv",
    "around": "SELECT CAST(a - 1 AS INT) AS a, CAST(b - 1 AS INT) AS b FROM range(3) x(a), range(3) y(b)",
    "win": f"SELECT s.frame, s.i, s.j, s.du, s.dv, CAST(sum(CASE WHEN s.i + o.a < 0 OR s.i + o.a >= {_N0} OR s.j + o.b < 0 OR s.j + o.b >= {_N1} THEN -17289 ELSE coalesce(n.score, -693) END) AS BIGINT) AS win FROM scores s CROSS JOIN around o LEFT JOIN scores n ON n.frame = s.frame AND n.i = s.i + o.a AND n.j = s.j + o.b AND n.du = s.du AND n.dv = s.dv GROUP BY ALL",
    "cand0": f"SELECT frame, i, j, du, dv, win - (du * du + dv * dv) AS score, i + du AS i2, j + dv AS j2 FROM win WHERE i + du BETWEEN 0 AND {_N0 - 1} AND j + dv BETWEEN 0 AND {_N1 - 1}",
}


def _step(cand: str, e: str, m: str) -> dict[str, str]:
    best = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, i, j ORDER BY score DESC, du, dv) AS r FROM {cand}) WHERE r = 1"
    return {
        e: f"SELECT s.frame, s.i, s.j, coalesce(b.du, 0) AS u, coalesce(b.dv, 0) AS v, CASE WHEN b.score IS NULL THEN 0 ELSE 1 END AS valid, b.score FROM src s LEFT JOIN ({best}) b ON b.frame = s.frame AND b.i = s.i AND b.j = s.j",
        m: f"SELECT frame, i, j, u, v, CASE WHEN valid = 1 AND row_number() OVER (PARTITION BY frame, valid, i + u, j + v ORDER BY score DESC, i, j) = 1 THEN 1 ELSE 0 END AS valid, score FROM {e}",
    }


def _again(last: str, n: int) -> dict[str, str]:
    return {
        f"near{n}": f"SELECT frame, i + a AS i, j + b AS j, count(*) AS n, sum(u) AS su, sum(v) AS sv, sum(u * u + v * v) AS s2 FROM {last}, (SELECT CAST(a - 2 AS INT) AS a, CAST(b - 2 AS INT) AS b FROM range(5) x(a), range(5) y(b) WHERE a <> 2 OR b <> 2) WHERE valid = 1 GROUP BY ALL",
        f"cand{n}": f"SELECT c.frame, c.i, c.j, c.du, c.dv, c.score - CAST(coalesce(n.s2 + n.n * (du * du + dv * dv) - 2 * (du * n.su + dv * n.sv), 0) AS BIGINT) AS score, i2, j2 FROM cand0 c LEFT JOIN near{n} n ON n.frame = c.frame AND n.i = c.i AND n.j = c.j",
        f"ok{n}": f"SELECT c.* FROM cand{n} c LEFT JOIN (SELECT frame, i, j, i + u AS i2, j + v AS j2, score AS os FROM {last} WHERE valid = 1) o ON o.frame = c.frame AND o.i2 = c.i2 AND o.j2 = c.j2 WHERE o.os IS NULL OR c.score > o.os OR (o.i = c.i AND o.j = c.j)",
        **_step(f"ok{n}", f"e{n}", f"m{n}"),
    }


def _rounds(rounds: int) -> dict[str, str]:
    views = {**_WIN, **_step("cand0", "e1", "m1")}
    for n in range(2, rounds + 1):
        views |= _again(f"m{n - 1}", n)
    return views


def on_flow(query: str, rounds: int = 1, **more: str) -> str:
    views = _rounds(rounds)
    return with_views(query, "scan_cells", "level_weights", **views, **more)


def _step_full() -> str:
    """The first round of the full match: 31 x 31 displacements, all weights, on the foreground of the grid of the drives' scans."""
    rows = [f"(({m} >> {k}) & 1) * {w}" for m, ws in zip(("ff", "oo", "mixed"), matcher.WEIGHTS, strict=True) for k, w in enumerate(ws) if w]
    n = 2 * matcher.SEARCH + 1
    met = "SELECT s.frame, s.i, s.j, d.du, d.dv, s.free & coalesce(n.free, 0) AS ff, s.occ & coalesce(n.occ, 0) AS oo, (s.free & coalesce(n.occ, 0)) | (s.occ & coalesce(n.free, 0)) AS mixed FROM src s CROSS JOIN disp d LEFT JOIN cols n ON n.frame = s.frame + 1 AND n.i = s.i + d.du AND n.j = s.j + d.dv"
    grid = _grid(SPEC).replace("raw_scan", "drive_scan")
    return with_views(
        "SELECT * FROM m1", "drive_scan", "bg_model", grid=grid,
        reached=f"SELECT c.frame, c.i - m.di AS i, c.j - m.dj AS j, sum(CASE WHEN c.val < 0 THEN m.wf ELSE m.wo END) AS s FROM (SELECT *, {_ijk()} FROM grid WHERE val <> 0) c JOIN bg_model m ON c.k = m.k GROUP BY ALL",
        cols=f"SELECT frame, i, j, bit_or(CASE WHEN val < 0 THEN 1 << k ELSE 0 END) AS free, bit_or(CASE WHEN val > 0 THEN 1 << k ELSE 0 END) AS occ, bool_or(1 - 1 / (1 + exp(greatest(-1.0, least(3.0, val)))) > {matcher.EVIDENT}) AS evident FROM (SELECT *, {_ijk()} FROM grid) GROUP BY ALL",
        src=f"SELECT c.* FROM cols c JOIN reached r ON r.frame = c.frame AND r.i = c.i AND r.j = c.j WHERE evident AND r.s + {DRIVE_FILTER_OFFSET} > 0 AND c.frame + 1 IN (SELECT frame FROM cols)",
        disp=f"SELECT CAST(a - {matcher.SEARCH} AS INT) AS du, CAST(b - {matcher.SEARCH} AS INT) AS dv FROM range({n}) x(a), range({n}) y(b)",
        scores=f"SELECT frame, i, j, du, dv, CAST(round(-ln(1 + exp(-({matcher.OFFSET} + {' + '.join(rows)}) / 100.0)) * 1000) AS BIGINT) AS score FROM ({met})",
        around=_WIN["around"], win=_WIN["win"], cand0=_WIN["cand0"], **_step("cand0", "e1", "m1"),
    )


def _xy(a: str = "") -> str:
    return f"({a}i - {SPEC.n0 // 2}) * {RES} AS x, ({a}j - {SPEC.n1 // 2}) * {RES} AS y"


def _in_view(x: str, y: str) -> str:
    u, v, d = (f"({CAMERA[4 * a]} * {x} + {CAMERA[4 * a + 1]} * {y} + {CAMERA[4 * a + 2]} * 0.0 + {CAMERA[4 * a + 3]})" for a in range(3))
    return f"coalesce({d} >= 0 AND {u} / nullif({d}, 0) BETWEEN 0 AND {VIEW_WIDTH} AND {v} / nullif({d}, 0) BETWEEN 0 AND {VIEW_HEIGHT}, false)"


def _wrap(a: str) -> str:
    return f"CASE WHEN {a} BETWEEN -pi() AND pi() THEN {a} ELSE {a} - 2 * pi() * ceil(({a} - pi()) / (2 * pi())) END"


_LOCAL = ("(cos(rz) * (x - tx) + sin(rz) * (y - ty))", "(-sin(rz) * (x - tx) + cos(rz) * (y - ty))")
_TRACKED = {
    "places": f"SELECT DISTINCT frame, i, j, {_xy()} FROM scan_cells",
    "pts": "SELECT DISTINCT frame, x, y FROM places",
    "boxed": f"SELECT p.*, t.track_id, t.objectType, t.tx, t.ty, t.rz, {_LOCAL[0]} AS lx, {_LOCAL[1]} AS ly FROM pts p JOIN tracks t ON p.frame = t.frame WHERE abs({_LOCAL[0]}) < t.l / 2 AND abs({_LOCAL[1]}) < t.w / 2",
    "types": "SELECT p.frame, p.x, p.y, coalesce(b.type, 'NO_OBJECT') AS type FROM pts p LEFT JOIN (SELECT frame, x, y, arg_min(objectType, track_id) AS type FROM boxed GROUP BY ALL) b ON b.frame = p.frame AND b.x = p.x AND b.y = p.y",
    "world": "SELECT p.frame, p.x, p.y, a.x + cos(a.h) * p.x - sin(a.h) * p.y - b.x AS dx, a.y + sin(a.h) * p.x + cos(a.h) * p.y - b.y AS dy, b.h AS bh FROM pts p JOIN poses a ON a.frame = p.frame JOIN poses b ON b.frame = p.frame + 1",
    "ground": "SELECT frame, x, y, cos(bh) * dx + sin(bh) * dy AS x2, -sin(bh) * dx + cos(bh) * dy AS y2 FROM world",
    "carried": "SELECT b.frame, b.x, b.y, arg_min(n.tx + cos(n.rz) * lx - sin(n.rz) * ly, b.track_id) AS bx, arg_min(n.ty + sin(n.rz) * lx + cos(n.rz) * ly, b.track_id) AS by_ FROM boxed b JOIN tracks n ON n.track_id = b.track_id AND n.frame = b.frame + 1 GROUP BY b.frame, b.x, b.y",
    "match": "SELECT g.frame, g.x, g.y, coalesce(c.bx, g.x2) AS x2, coalesce(c.by_, g.y2) AS y2, CASE WHEN c.bx IS NULL THEN 0 ELSE 1 END AS is_tracklet FROM ground g LEFT JOIN carried c ON c.frame = g.frame AND c.x = g.x AND c.y = g.y",
}


def on_tracks(query: str, **more: str) -> str:
    return with_views(query, "scan_cells", "tracks", "poses", **_TRACKED, **more)


_SEEN = {
    "evaluated": f"""SELECT a.frame, a.x, a.y, m.x2, m.y2,
      CASE WHEN coalesce(f.valid, 0) = 0 AND coalesce(b.background, 0) = 1 THEN g.x2 - g.x ELSE coalesce(f.u, 0) * {RES} END AS u,
      CASE WHEN coalesce(f.valid, 0) = 0 AND coalesce(b.background, 0) = 1 THEN g.y2 - g.y ELSE coalesce(f.v, 0) * {RES} END AS v,
      coalesce(b.background, 0) AS filter, m.is_tracklet, t.type
      FROM (SELECT frame, i, j, {_xy()} FROM scan_cells) a
      JOIN match m ON m.frame = a.frame AND m.x = a.x AND m.y = a.y
      JOIN types t ON t.frame = a.frame AND t.x = a.x AND t.y = a.y
      JOIN ground g ON g.frame = a.frame AND g.x = a.x AND g.y = a.y
      LEFT JOIN m3 f ON f.frame = a.frame AND f.i = a.i AND f.j = a.j
      LEFT JOIN filtered b ON b.frame = a.frame AND b.i = a.i AND b.j = a.j
      WHERE {_in_view("a.x", "a.y")} AND {_in_view("m.x2", "m.y2")}"""
}


def on_eval(query: str) -> str:
    return with_views(query, "scan_cells", "valued_cells", "bg_model", "level_weights", "tracks", "poses", **_FILTER, **_rounds(ROUNDS), **_TRACKED, **_SEEN)


def _rounded(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def _travel() -> tuple[str, str]:
    steps = "range(500)"
    return tuple(f"list_sum(list_transform({steps}, lambda t: v * 0.001 * {f}(h + w * 0.001 * t)))" for f in ("cos", "sin"))


def _unit(c: str) -> str:
    return f"greatest(0, least(1, {c}))"


def _samples() -> str:
    h = SPEC.n2 * SPEC.res
    x = f"((i - {_N0 // 2}) * {RES} - {SPEC.res / 2!r})"
    y = f"((j - {_N1 // 2}) * {RES} - {SPEC.res / 2!r} + (a + 0.5) * {SPEC.res / 4!r})"
    z = f"((b + 0.5) * {h / 8!r} - {h / 2!r})"
    u, v, d = (f"({CAMERA[4 * a]} * {x} + {CAMERA[4 * a + 1]} * {y} + {CAMERA[4 * a + 2]} * {z} + {CAMERA[4 * a + 3]})" for a in range(3))
    return f"SELECT frame, i, j, a, b, CAST(round({u} / {d}) AS INT) AS w, CAST(round({v} / {d}) AS INT) AS h, {d} AS depth FROM (SELECT DISTINCT frame, i, j FROM scan_cells), (SELECT CAST(a AS INT) AS a FROM range(4) t(a)), (SELECT CAST(b AS INT) AS b FROM range(8) t(b)) WHERE {d} > 0"


def _match_round(last: str, n: int) -> dict[str, str]:
    return {
        f"put{n}": f"SELECT p.frame - 1 AS frame, p.id, p.x AS px, p.y AS py, p.z AS pz, s.x + cos(s.h) * p.x - sin(s.h) * p.y AS sx, s.y + sin(s.h) * p.x + cos(s.h) * p.y AS sy FROM pts p JOIN {last} s ON s.frame = p.frame - 1",
        f"near{n}": f"SELECT a.frame, a.id, min({{'d': (sx - q.x) ** 2 + (sy - q.y) ** 2 + (pz - q.z) ** 2, 'qx': q.x, 'qy': q.y, 'px': px, 'py': py}}) AS m FROM put{n} a JOIN pts q ON q.frame = a.frame AND q.x BETWEEN sx - 0.9 AND sx + 0.9 AND q.y BETWEEN sy - 0.9 AND sy + 0.9 WHERE (sx - q.x) ** 2 + (sy - q.y) ** 2 + (pz - q.z) ** 2 <= CAST(0.9 AS DOUBLE) * CAST(0.9 AS DOUBLE) GROUP BY ALL",
        f"sums{n}": f"SELECT frame, count(*) AS n, avg(m.d) AS e, avg(m.px) AS px, avg(m.py) AS py, avg(m.qx) AS qx, avg(m.qy) AS qy, sum(m.px * m.qy - m.py * m.qx) AS s, sum(m.px * m.qx + m.py * m.qy) AS c FROM near{n} GROUP BY frame",
        f"turn{n}": f"SELECT *, atan2(s - n * (px * qy - py * qx), c - n * (px * qx + py * qy)) AS h FROM sums{n}",
        f"pose{n}": f"SELECT frame, qx - cos(h) * px + sin(h) * py AS x, qy - sin(h) * px - cos(h) * py AS y, h, n, sqrt(e) AS error FROM turn{n}",
    }


def _turn(r: str, p: str, h: str) -> list[list[str]]:
    """Rz(h) Ry(p) Rx(r)."""
    s, c = "sin({})".format, "cos({})".format
    return [
        [f"{c(h)} * {c(p)}", f"({c(h)} * {s(p)} * {s(r)} - {s(h)} * {c(r)})", f"({c(h)} * {s(p)} * {c(r)} + {s(h)} * {s(r)})"],
        [f"{s(h)} * {c(p)}", f"({s(h)} * {s(p)} * {s(r)} + {c(h)} * {c(r)})", f"({s(h)} * {s(p)} * {c(r)} - {c(h)} * {s(r)})"],
        [f"(-{s(p)})", f"{c(p)} * {s(r)}", f"{c(p)} * {c(r)}"],
    ]


def _pose_of(m: list[list[str]], place: list[str], digits: int, names: list[str]) -> str:
    turn = (f"atan2({m[2][1]}, {m[2][2]})", f"atan2(-({m[2][0]}), sqrt(({m[0][0]}) ** 2 + ({m[1][0]}) ** 2))", f"atan2({m[1][0]}, {m[0][0]})")
    return ", ".join(f"round({c}, {digits}) AS {n}" for c, n in zip((*place, *turn), names, strict=True))


def _space() -> dict[str, str]:
    """Relative poses in space, and chains of them, a step a recursion."""
    pose = list("xyzrph")
    a, b = _turn("pr", "pp", "ph"), _turn("r", "p", "h")
    back = [[" + ".join(f"{a[k][i]} * {b[k][j]}" for k in range(3)) for j in range(3)] for i in range(3)]
    off = [" + ".join(f"{a[k][i]} * ({c} - p{c})" for k, c in enumerate("xyz")) for i in range(3)]
    lags = ", ".join(f"lag({c}) OVER (PARTITION BY key ORDER BY seq) AS p{c}" for c in pose)
    entries = [f"m{i}{j}" for i in range(3) for j in range(4)]
    first = [f"{b[i][j]} AS m{i}{j}" if j < 3 else f"{'xyz'[i]} AS m{i}3" for i in range(3) for j in range(4)]
    then = [" + ".join(f"c.m{i}{k} * t.m{k}{j}" for k in range(3)) + (f" + c.m{i}3" if j == 3 else "") for i in range(3) for j in range(4)]
    chain = f"SELECT * FROM turns WHERE seq = 1 UNION ALL SELECT t.key, t.seq, {', '.join(then)} FROM chained c JOIN turns t ON t.key = c.key AND t.seq = c.seq + 1"
    m = [[f"m{i}{j}" for j in range(3)] for i in range(3)]
    turns = f"SELECT key, seq, {', '.join(first)} FROM full_moves"
    composed = f"SELECT key, seq, {_pose_of(m, ['m03', 'm13', 'm23'], 4, pose)} FROM chained"
    return {
        "relative_pose6": with_views(f"SELECT key, seq, {_pose_of(back, off, 6, ['d' + c for c in pose])} FROM (SELECT *, {lags} FROM full_poses) WHERE px IS NOT NULL", "pose_obs", "full_poses"),
        "pose_chain6": with_views(composed, "pose_obs", "full_moves", turns=turns, **{f"chained(key, seq, {', '.join(entries)})": chain}).replace("WITH ", "WITH RECURSIVE ", 1),
    }


def _boxes_3d() -> dict[str, str]:
    """Points in turned boxes, where they go, and what rays meet, each by a nested loop over the frame."""
    m, n = _turn("rx", "ry", "rz"), _turn("n.rx", "n.ry", "n.rz")
    off = [f"({c} - t{c})" for c in "xyz"]
    local = ", ".join(f"{' + '.join(f'{m[b][a]} * {off[b]}' for b in range(3))} AS l{c}" for a, c in enumerate("xyz"))
    pts = f"SELECT DISTINCT frame, {_xy()}, (k - {SPEC.n2 // 2}) * {RES} AS z FROM scan_cells"
    boxed = f"SELECT * FROM (SELECT p.frame, p.x, p.y, p.z, t.track_id, t.objectType, t.l, t.w, t.h, {local} FROM pts p JOIN boxes t ON p.frame = t.frame) WHERE abs(lx) < l / 2 AND abs(ly) < w / 2 AND abs(lz) < h / 2"
    names = ("scan_cells", "tracks", "boxes")
    to = ", ".join(f"arg_min(n.t{c} + {' + '.join(f'{n[a][b]} * l{d}' for b, d in enumerate('xyz'))}, b.track_id) AS {c}2" for a, c in enumerate("xyz"))
    moved = f"SELECT b.frame, b.x, b.y, b.z, {to} FROM boxed b JOIN boxes n ON n.track_id = b.track_id AND n.frame = b.frame + 1 GROUP BY b.frame, b.x, b.y, b.z"

    def slab(source: str, half: list[str]) -> str:
        """Rows of source (o0 to o2, d0 to d2: a ray seen from a box) that meet it, with t."""
        near = ", ".join(f"CASE WHEN d{a} <> 0 THEN least((-({h}) - o{a}) / d{a}, (({h}) - o{a}) / d{a}) END" for a, h in enumerate(half))
        far = ", ".join(f"CASE WHEN d{a} <> 0 THEN greatest((-({h}) - o{a}) / d{a}, (({h}) - o{a}) / d{a}) END" for a, h in enumerate(half))
        beside = " AND ".join(f"(d{a} <> 0 OR abs(o{a}) <= {h})" for a, h in enumerate(half))
        return f"SELECT ray, ox, oy, oz, dx, dy, dz, what, t, t * sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM (SELECT *, greatest(0.0, {near}) AS t, least({far}) AS e FROM ({source}) WHERE {beside}) WHERE t <= e AND t * sqrt(dx * dx + dy * dy + dz * dz) <= 120"

    ray = "r.ray, r.ox, r.oy, r.oz, r.dx, r.dy, r.dz"
    turned = ", ".join(f"{' + '.join(f'{m[b][a]} * (r.o{c} - t{c})' for b, c in enumerate('xyz'))} AS o{a}, {' + '.join(f'{m[b][a]} * r.d{c}' for b, c in enumerate('xyz'))} AS d{a}" for a in range(3))
    at = ", ".join(f"r.o{c} - (c.{k} - {size // 2}) * {RES} AS o{a}, r.d{c} AS d{a}" for a, (c, k, size) in enumerate(zip("xyz", "ijk", SPEC.dims, strict=True)))
    first = f"SELECT ray, dist, what, ox + t * dx AS x, oy + t * dy AS y, oz + t * dz AS z, row_number() OVER (PARTITION BY ray ORDER BY dist, starts_with(what, 'cell'), what) AS n FROM (SELECT * FROM onbox UNION ALL SELECT * FROM oncell)"
    return {
        "object_at_3d": with_views(f"SELECT p.frame, {_rounded('p.x', 'p.y', 'p.z').replace('AS p.', 'AS ')}, coalesce(b.type, 'NO_OBJECT') AS type FROM pts p LEFT JOIN (SELECT frame, x, y, z, arg_min(objectType, track_id) AS type FROM boxed GROUP BY ALL) b ON b.frame = p.frame AND b.x = p.x AND b.y = p.y AND b.z = p.z", *names, pts=pts, boxed=boxed),
        "correspondence_3d": with_views(f"SELECT frame, {_rounded('x', 'y', 'z', 'x2', 'y2', 'z2')} FROM moved", *names, pts=pts, boxed=boxed, moved=moved),
        "ray_picks": with_views(
            f"SELECT ray, {_rounded('x', 'y', 'z', 'dist')}, what FROM ({first}) WHERE n = 1", *names, "rays",
            onbox=slab(f"SELECT {ray}, l, w, h, 'track:' || track_id AS what, {turned} FROM rays r JOIN boxes ON boxes.frame = r.frame", ["l / 2", "w / 2", "h / 2"]),
            oncell=slab(f"SELECT {ray}, 'cell:' || i || ':' || j || ':' || k AS what, {at} FROM rays r JOIN (SELECT DISTINCT * FROM scan_cells) c ON c.frame = r.frame", [repr(0.75 * SPEC.res / 2)] * 3),
        ),
        "grid_merge_stored": with_views("SELECT key, CAST(sum(n_free) AS BIGINT) AS n_free, CAST(sum(n_occ) AS BIGINT) AS n_occ, (10 * sum(n_occ) - sum(n_free)) / 10 AS val FROM grid GROUP BY key", "drive_scan", grid=_grid(SPEC).replace("raw_scan", "drive_scan")),
    }


def all_oracles() -> dict[str, str]:
    x, y, h = ("lag({0}) OVER (PARTITION BY key ORDER BY seq) AS p{0}".format(c) for c in "xyh")
    dx, dy = _travel()
    u, v, dep = (f"({CAMERA[4 * a]} * x + {CAMERA[4 * a + 1]} * y + {CAMERA[4 * a + 2]} * z + {CAMERA[4 * a + 3]})" for a in range(3))
    xyz = f"{_xy()}, (k - {SPEC.n2 // 2}) * {RES} AS z"
    image = f"SELECT frame, CAST(trunc(u + 0.5) AS INT) AS w, CAST(trunc(v + 0.5) AS INT) AS h, min(d) AS measured FROM (SELECT frame, {u} / {dep} AS u, {v} / {dep} AS v, {dep} AS d FROM pts WHERE {dep} > 0) WHERE u > -1.5 AND v > -1.5 GROUP BY ALL"
    cell = ", ".join(f"CAST(round({c} / {RES}) AS INT) + {n // 2} AS {k}" for c, n, k in (("x", _N0, "i"), ("y", _N1, "j"), ("x2", _N0, "i2"), ("y2", _N1, "j2")))
    ramp = [f"CAST(round({_unit(f'1.5 - abs(4 * s - {m})')} * 255) AS INT) AS {c}" for c, m in zip("rgb", (3.0, 2.0, 1.0), strict=True)]
    ground = "(cos(a.h) * (b.x - a.x) + sin(a.h) * (b.y - a.y))", "(-sin(a.h) * (b.x - a.x) + cos(a.h) * (b.y - a.y))"
    world = on_flow(
        f"SELECT frame, i, j, k, {_rounded('x', 'y', 'z')}, round(cos(mh) * (fx - mx) + sin(mh) * (fy - my), 6) AS x_from, round(-sin(mh) * (fx - mx) + cos(mh) * (fy - my), 6) AS y_from FROM arrows JOIN moved USING (frame)", ROUNDS,
        poses=SQL["poses"].replace("DIV_", "//"), moved=f"SELECT a.frame, {ground[0]} AS mx, {ground[1]} AS my, {_wrap('(b.h - a.h)')} AS mh FROM poses a JOIN poses b ON b.frame = a.frame + 1",
        arrows=f"SELECT c.frame, c.i, c.j, c.k, {_xy('c.')}, (c.k - {SPEC.n2 // 2}) * {RES} AS z, (c.i - {SPEC.n0 // 2}) * {RES} - m.u * {RES} AS fx, (c.j - {SPEC.n1 // 2}) * {RES} - m.v * {RES} AS fy FROM scan_cells c JOIN m{ROUNDS} m ON m.frame = c.frame AND m.i = c.i AND m.j = c.j WHERE m.valid = 1",
    )
    return _space() | _boxes_3d() | {
        "flow_arrows_world": world,
        "train_match_rows": on_tracks(
            f"SELECT p.frame, p.i, p.j, p.i2, p.j2, 1 AS label FROM paired p SEMI JOIN scan_cells c ON c.frame = p.frame + 1 AND c.i = p.i2 AND c.j = p.j2 UNION ALL "
            f"SELECT frame, i, j, i + n // 31 - 15, j + n % 31 - 15, 0 FROM (SELECT *, (i * 31 + j * 17) % 961 AS n FROM paired WHERE (i * 7919 + j * 104729) % 10 = 0) WHERE (i + n // 31 - 15 <> i2 OR j + n % 31 - 15 <> j2) AND i + n // 31 - 15 BETWEEN 0 AND {_N0 - 1} AND j + n % 31 - 15 BETWEEN 0 AND {_N1 - 1}",
            paired=f"SELECT frame, {cell} FROM match",
        ),
        "pick_lookup": on_eval(
            f"SELECT p.frame, round(p.x, 6) AS x, round(p.y, 6) AS y, p.i, p.j, coalesce(f.u, 0) AS u, coalesce(f.v, 0) AS v, coalesce(f.valid, 0) AS valid, coalesce(b.background, 0) AS background, coalesce(t.type, 'NO_OBJECT') AS type, CAST({_in_view('p.x', 'p.y')} AS INT) AS seen "
            f"FROM (SELECT DISTINCT frame, tx AS x, ty AS y, CAST(round(tx / {RES}) AS INT) + {_N0 // 2} AS i, CAST(round(ty / {RES}) AS INT) + {_N1 // 2} AS j FROM tracks) p "
            "LEFT JOIN m3 f ON f.frame = p.frame AND f.i = p.i AND f.j = p.j LEFT JOIN filtered b ON b.frame = p.frame AND b.i = p.i AND b.j = p.j "
            "LEFT JOIN (SELECT q.frame, q.tx AS x, q.ty AS y, arg_min(k.objectType, k.track_id) AS type FROM (SELECT DISTINCT frame, tx, ty FROM tracks) q JOIN tracks k ON k.frame = q.frame AND abs(cos(k.rz) * (q.tx - k.tx) + sin(k.rz) * (q.ty - k.ty)) < k.l / 2 AND abs(-sin(k.rz) * (q.tx - k.tx) + cos(k.rz) * (q.ty - k.ty)) < k.w / 2 GROUP BY ALL) t ON t.frame = p.frame AND t.x = p.x AND t.y = p.y"
        ),
        "scan_match": with_views(
            f"SELECT frame, {_rounded('x', 'y', 'h', 'error', digits=4)}, n FROM pose2",
            "scan_cells", "poses", pts=f"SELECT frame, row_number() OVER () AS id, {xyz} FROM scan_cells", seeds=f"SELECT frame, CAST(-0.5 AS DOUBLE) AS x, CAST(0.25 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS h FROM poses WHERE {FOLLOWED}",
            **_match_round("seeds", 1), **_match_round("pose1", 2),
        ),
        "roi_samples": with_views("SELECT frame, i, j, a, b, w, h, round(depth, 6) AS depth FROM samples", "scan_cells", samples=_samples()),
        "depth_errors": with_views(
            "SELECT frame, i, j, count(*) FILTER (e < 255) AS known, CAST(sum(e) AS BIGINT) AS total FROM (SELECT s.frame, s.i, s.j, CASE WHEN coalesce(m.measured, 0) < 1e-3 THEN 255 ELSE greatest(0, least(255, CAST(round((m.measured - s.depth) * 100) AS INT) + 127)) END AS e FROM samples s LEFT JOIN image m ON m.frame = s.frame AND m.w = s.w AND m.h = s.h AND m.w BETWEEN 0 AND 1241 AND m.h BETWEEN 0 AND 374) GROUP BY ALL",
            "scan_cells", samples=_samples(), pts=f"SELECT frame, {xyz} FROM scan_cells", image=image,
        ),
        "point_colours": with_views(f"SELECT z8, height, {', '.join(ramp)}, count(*) AS n FROM (SELECT CAST(round({_unit('(z + 2) / 5')} * 255) AS INT) AS z8, CAST(round(CASE WHEN z < 0 THEN {_unit('-z / 5')} ELSE {_unit('(z + 4) / 12')} END * 255) AS INT) AS height, {_unit('sqrt(x * x + y * y) / 40')} AS s FROM raw_scan) GROUP BY ALL", "raw_scan"),
        "flow_table": on_flow(f"SELECT frame, i, j, round(u * {RES} / CAST(0.1 AS DOUBLE), 6) AS u, round(v * {RES} / CAST(0.1 AS DOUBLE), 6) AS v, valid FROM m3", ROUNDS),
        "occupancy_grid": on_grid("SELECT * FROM grid"),
        "grid_merge": on_grid("SELECT key, CAST(sum(n_free) AS BIGINT) AS n_free, CAST(sum(n_occ) AS BIGINT) AS n_occ, (10 * sum(n_occ) - sum(n_free)) / 10 AS val FROM grid GROUP BY key"),
        "grid_clean": on_grid("SELECT frame, key, val FROM grid WHERE abs(val) >= 0.01"),
        "column_occupancy": on_grid("SELECT frame, i, j, count(*) FILTER (val > 3) AS n FROM cells GROUP BY ALL"),
        "z_slice": on_grid("SELECT frame, i, j, CAST(sign(val) AS INT) AS s FROM cells WHERE k = 7"),
        "mle_state": on_grid("SELECT frame, CASE WHEN val < 0 THEN 1 WHEN val > 0 THEN 2 ELSE 0 END AS state, count(*) AS n FROM grid GROUP BY ALL"),
        "occupancy_prob": on_grid("SELECT frame, key, round(1 - 1 / (1 + exp(greatest(-1.0, least(3.0, val)))), 6) AS p FROM grid"),
        "multires_grid": _levels(),
        "occluded_cells": with_views("SELECT DISTINCT frame, e0, e1, e2 FROM way w SEMI JOIN (SELECT frame, key FROM grid WHERE val > 0) g ON g.frame = w.frame AND g.key = w.key", "raw_scan", grid=_grid(SPEC), goals=f"SELECT DISTINCT frame, e0, e1, e2 FROM ({_rays(SPEC)})", way=_walked(SPEC, max(SPEC.dims), "goals")),
        "grid_subset": _subset(),
        "dense_trits": on_grid(f"SELECT d.frame, r AS key, CASE WHEN coalesce(val, 0) > 0.1 THEN 1 WHEN coalesce(val, 0) < -0.1 THEN -1 ELSE 0 END AS t FROM (SELECT DISTINCT frame FROM grid) d CROSS JOIN range({SPEC.n0 * SPEC.n1 * SPEC.n2}) x(r) LEFT JOIN grid g ON g.frame = d.frame AND g.key = r"),
        "count_nonzero": on_grid("SELECT frame, count(*) FILTER (abs(val) > 1e-3) AS n FROM grid GROUP BY frame"),
        "z_slice_dense": on_grid(f"SELECT d.frame, CAST(a AS INT) AS i, CAST(b AS INT) AS j, CAST(coalesce(sign(val), 0) AS INT) AS s FROM (SELECT DISTINCT frame FROM grid) d CROSS JOIN range({_N0}) x(a) CROSS JOIN range({_N1}) y(b) LEFT JOIN (SELECT * FROM cells WHERE k = 7) c ON c.frame = d.frame AND c.i = a AND c.j = b"),
        "posed_grid": _posed(),
        "packet_returns": _packets(),
        "filtered_states": on_filter("SELECT c.frame, CASE WHEN background = 1 THEN 0 WHEN val < 0 THEN 1 WHEN val > 0 THEN 2 ELSE 0 END AS state, round(CASE WHEN background = 1 THEN 0.5 ELSE 1 - 1 / (1 + exp(greatest(-1.0, least(3.0, val)))) END, 6) AS p, count(*) AS n FROM valued_cells c JOIN filtered b ON b.frame = c.frame AND b.i = c.i AND b.j = c.j GROUP BY ALL"),
        "foreground_boxes": on_filter(f"SELECT frame, {_rounded('x', 'y', 'z')}, CAST(0.225 AS DOUBLE) AS size FROM (SELECT c.frame, {_xy('c.')}, (c.k - {SPEC.n2 // 2}) * {RES} AS z FROM valued_cells c ANTI JOIN (SELECT * FROM filtered WHERE background = 1) b ON b.frame = c.frame AND b.i = c.i AND b.j = c.j WHERE c.val > 0)"),
        "column_boxes": with_views(f"SELECT frame, i, j, k, {_rounded('x', 'y', 'z')} FROM (SELECT *, {xyz} FROM (SELECT DISTINCT frame, CAST(round(tx / {RES}) AS INT) + {_N0 // 2} AS i, CAST(round(ty / {RES}) AS INT) + {_N1 // 2} AS j FROM tracks), (SELECT CAST(c AS INT) AS k FROM range({SPEC.n2}) t(c)) WHERE i BETWEEN 0 AND {_N0 - 1} AND j BETWEEN 0 AND {_N1 - 1})", "tracks"),
        "track_boxes": with_views("SELECT track_id, frame, round(tx, 6) AS x, round(ty, 6) AS y, CAST(0.8 AS DOUBLE) AS z, round(rz, 6) AS rz, l, w, CASE objectType WHEN 'Car' THEN 0 ELSE 255 END AS r, CASE objectType WHEN 'Cyclist' THEN 0 ELSE 255 END AS g, CASE WHEN objectType IN ('Car', 'Pedestrian', 'Person', 'Cyclist') THEN 0 ELSE 255 END AS b FROM tracks", "tracks"),
        "image_flow_lines": on_flow(
            f"SELECT frame, i, j, k, {_rounded('u1', 'v1', 'u2', 'v2', digits=4)} FROM (SELECT frame, i, j, k, " + ", ".join(f"{u} / nullif({dep}, 0) AS u{e}, {v} / nullif({dep}, 0) AS v{e}, {dep} AS d{e}".replace("* x ", f"* {px} ").replace("* y ", f"* {py} ") for e, px, py in ((1, "x", "y"), (2, "x2", "y2")))
            + f" FROM (SELECT c.*, (c.i - {_N0 // 2}) * {RES} AS x, (c.j - {_N1 // 2}) * {RES} AS y, (c.k - {SPEC.n2 // 2}) * {RES} AS z, (c.i - {_N0 // 2}) * {RES} + f.u * {RES} AS x2, (c.j - {_N1 // 2}) * {RES} + f.v * {RES} AS y2 FROM scan_cells c JOIN m3 f ON f.frame = c.frame AND f.i = c.i AND f.j = c.j WHERE f.valid = 1)) WHERE d1 > 0 AND u1 BETWEEN 0 AND 1242 AND v1 BETWEEN 0 AND 375 AND d2 > 0 AND u2 BETWEEN 0 AND 1242 AND v2 BETWEEN 0 AND 375", ROUNDS),
        "roi_outlines": with_views(
            f"SELECT frame, i, j, corner, round({u} / {dep}, 3) AS u, round({v} / {dep}, 3) AS v FROM faces WHERE {dep} > 0", "scan_cells",
            faces=f"SELECT frame, i, j, corner, (i - {_N0 // 2}) * {RES} - {SPEC.res / 2!r} AS x, (j - {_N1 // 2}) * {RES} + CASE WHEN corner IN (0, 3) THEN -0.5 ELSE 0.5 END * {RES} AS y, CASE WHEN corner < 2 THEN -0.5 ELSE 0.5 END * CAST({SPEC.n2 * SPEC.res!r} AS DOUBLE) AS z FROM (SELECT DISTINCT frame, i, j FROM scan_cells), (SELECT CAST(c AS INT) AS corner FROM range(4) t(c))",
        ),
        "train_match_levels": on_tracks(
            "SELECT p.frame, p.i, p.j, p.i2, p.j2, p.label, p.k, round(coalesce(a.p, 0.5), 6) AS p1, round(coalesce(b.p, 0.5), 6) AS p2 FROM (SELECT * FROM chosen, (SELECT CAST(c AS INT) AS k FROM range(14) t(c))) p LEFT JOIN prob a ON a.frame = p.frame AND a.i = p.i AND a.j = p.j AND a.k = p.k LEFT JOIN prob b ON b.frame = p.frame + 1 AND b.i = p.i2 AND b.j = p.j2 AND b.k = p.k",
            valued="SELECT *, CAST(CASE WHEN (i + j + k) % 3 = 0 THEN -0.5 ELSE 1.0 END AS DOUBLE) AS val FROM scan_cells",
            prob="SELECT *, 1 - 1 / (1 + exp(greatest(-1.0, least(3.0, val)))) AS p FROM valued",
            paired=f"SELECT frame, {cell} FROM match",
            chosen="SELECT p.frame, p.i, p.j, p.i2, p.j2, 1 AS label FROM paired p SEMI JOIN scan_cells c ON c.frame = p.frame + 1 AND c.i = p.i2 AND c.j = p.j2 UNION ALL "
            f"SELECT frame, i, j, i + n // 31 - 15, j + n % 31 - 15, 0 FROM (SELECT *, (i * 31 + j * 17) % 961 AS n FROM paired WHERE (i * 7919 + j * 104729) % 10 = 0) WHERE (i + n // 31 - 15 <> i2 OR j + n % 31 - 15 <> j2) AND i + n // 31 - 15 BETWEEN 0 AND {_N0 - 1} AND j + n % 31 - 15 BETWEEN 0 AND {_N1 - 1}",
        ),
        "background_filter": on_filter("SELECT * FROM filtered"),
        "filter_smooth": on_filter("SELECT f.frame, f.i, f.j, CASE WHEN 2 * sum(n.background) >= count(*) THEN 1 ELSE 0 END AS background FROM filtered f JOIN filtered n ON n.frame = f.frame AND n.i BETWEEN f.i - 1 AND f.i + 1 AND n.j BETWEEN f.j - 1 AND f.j + 1 GROUP BY ALL"),
        "foreground_cells": on_filter("SELECT c.* FROM valued_cells c ANTI JOIN (SELECT * FROM filtered WHERE background = 1) b ON b.frame = c.frame AND b.i = c.i AND b.j = c.j"),
        "column_scores": on_flow("SELECT * FROM scores"),
        "windowed_scores": on_flow("SELECT * FROM win"),
        "flow_estep": on_flow("SELECT * FROM e1"),
        "flow_mstep": on_flow("SELECT * FROM m1"),
        "flow_solve": on_flow(f"SELECT * FROM m{ROUNDS}", ROUNDS),
        "flow_step_full": _step_full(), "flow_step_tiles": _step_full(),
        "flow_reverse": on_flow("SELECT frame + 1 AS frame, i + u AS i, j + v AS j, -u AS u, -v AS v FROM m3 WHERE valid = 1", ROUNDS),
        "poses_mercator": with_views("SELECT log, frame, round(c * lon * pi() * 6378137.0 / 180, 3) AS x, round(c * 6378137.0 * ln(tan((90 + lat) * pi() / 360)), 3) AS y, alt AS z, round(yaw, 6) AS h FROM (SELECT p.*, cos(radians(f.lat0)) AS c FROM positions p JOIN (SELECT log, arg_min(lat, frame) AS lat0 FROM positions GROUP BY log) f ON f.log = p.log)", "positions"),
        "relative_pose": with_views(f"SELECT key, seq, round(cos(ph) * (x - px) + sin(ph) * (y - py), 6) AS dx, round(-sin(ph) * (x - px) + cos(ph) * (y - py), 6) AS dy, round({_wrap('(h - ph)')}, 6) AS dh FROM (SELECT *, {x}, {y}, {h} FROM pose_obs) WHERE px IS NOT NULL", "pose_obs"),
        "pose_chain": with_views("SELECT key, seq, round(sum(cos(t - h / 100) * v_f / 10) OVER w, 4) AS x, round(sum(sin(t - h / 100) * v_f / 10) OVER w, 4) AS y, round(t, 4) AS h FROM (SELECT *, sum(h / 100) OVER (PARTITION BY key ORDER BY seq) AS t FROM pose_obs) WINDOW w AS (PARTITION BY key ORDER BY seq)", "pose_obs"),
        "ego_project": on_tracks(f"SELECT frame, {_rounded('x', 'y', 'x2', 'y2')} FROM ground"),
        "object_at": on_tracks(f"SELECT frame, {_rounded('x', 'y')}, type FROM types"),
        "active_tracks": with_views("SELECT track_id, objectType, l, w, frame, tx, ty, rz FROM tracks", "tracks"),
        "correspondence": on_tracks(f"SELECT frame, {_rounded('x', 'y', 'x2', 'y2')}, is_tracklet FROM match"),
        "camera_visible": on_tracks(f"SELECT frame, i, j, CAST({_in_view('x', 'y')} AS INT) AS seen FROM places"),
        "eval_rows": on_eval(f"SELECT frame, {_rounded('x', 'y', 'x2', 'y2', 'u', 'v')}, filter, is_tracklet, type FROM evaluated"),
        "eval_by_type": on_eval("SELECT type, filter, count(*) AS n, round(avg(sqrt((x2 - x - u) ** 2 + (y2 - y - v) ** 2)), 4) AS mean_error FROM evaluated GROUP BY CUBE (type, filter)"),
        "train_filter_rows": with_views(
            "SELECT frame, i, j, label, di, dj, k, coalesce(max(lp1), 0) AS lp1, coalesce(max(lp2), 0) AS lp2 FROM ("
            "SELECT a.frame, a.i, a.j, label, di, dj, c.k, c.val AS lp1, NULL AS lp2 FROM moved a JOIN valued_cells c ON c.frame = a.frame AND c.i = a.i + di AND c.j = a.j + dj UNION ALL "
            f"SELECT a.frame, a.i, a.j, label, di, dj, c.k, NULL, c.val FROM moved a JOIN valued_cells c ON c.frame = a.frame + 1 AND c.i = CAST(round(x2 / {RES}) AS INT) + {_N0 // 2} AND c.j = CAST(round(y2 / {RES}) AS INT) + {_N1 // 2}) GROUP BY ALL",
            "scan_cells", "valued_cells", "tracks", "poses", **_TRACKED,
            around5=f"SELECT p.frame, p.i, p.j, m.is_tracklet AS label, CAST(a - 2 AS INT) AS di, CAST(b - 2 AS INT) AS dj, p.x + CAST(a - 2 AS INT) * {RES} AS x, p.y + CAST(b - 2 AS INT) * {RES} AS y FROM places p JOIN match m ON m.frame = p.frame AND m.x = p.x AND m.y = p.y, range(5) s(a), range(5) t(b) WHERE {_in_view('m.x', 'm.y')} AND {_in_view('m.x2', 'm.y2')} AND (m.is_tracklet = 1 OR (p.i * 7919 + p.j * 104729) % 10 = 0)",
            moved="SELECT *, cos(bh) * dx + sin(bh) * dy AS x2, -sin(bh) * dx + cos(bh) * dy AS y2 FROM (SELECT p.*, a.x + cos(a.h) * p.x - sin(a.h) * p.y - b.x AS dx, a.y + sin(a.h) * p.x + cos(a.h) * p.y - b.y AS dy, b.h AS bh FROM around5 p JOIN poses a ON a.frame = p.frame JOIN poses b ON b.frame = p.frame + 1)",
        ),
        "project_grid": with_views(
            f"SELECT frame, i2 AS i, j2 AS j, k, sum(val) AS val FROM (SELECT frame, k, val, CAST(round(((i - {_N0 // 2}) * {RES} + {dx}) / {RES}) AS INT) + {_N0 // 2} AS i2, CAST(round(((j - {_N1 // 2}) * {RES} + {dy}) / {RES}) AS INT) + {_N1 // 2} AS j2 FROM moving) WHERE i2 BETWEEN 0 AND {_N0 - 1} AND j2 BETWEEN 0 AND {_N1 - 1} GROUP BY ALL",
            "scan_cells", "valued_cells", moving="SELECT *, (i % 7) * 0.3 - 0.9 AS h, CAST(j % 11 AS DOUBLE) AS v, CAST(((i + j) % 5) * 0.1 AS DOUBLE) AS w FROM valued_cells",
        ),
        "zbuffer": with_views(f"SELECT frame, CAST(trunc(u + 0.5) AS INT) AS w, CAST(trunc(v + 0.5) AS INT) AS h, round(min(d), 6) AS depth FROM (SELECT frame, {u} / {dep} AS u, {v} / {dep} AS v, {dep} AS d FROM pts WHERE {dep} > 0) WHERE u > -1.5 AND v > -1.5 AND trunc(u + 0.5) BETWEEN 0 AND 1241 AND trunc(v + 0.5) BETWEEN 0 AND 374 GROUP BY ALL", "scan_cells", pts=f"SELECT frame, {xyz} FROM scan_cells"),
        "occupied_boxes": on_grid(f"SELECT frame, {_rounded('x', 'y', 'z')}, CAST(0.225 AS DOUBLE) AS size FROM (SELECT frame, {xyz} FROM cells WHERE val > 0)"),
        "flow_arrows": on_flow(f"SELECT frame, {_rounded('x', 'y')}, round(x - u * {RES}, 6) AS x_from, round(y - v * {RES}, 6) AS y_from FROM (SELECT *, {_xy()} FROM m3 WHERE valid = 1)", ROUNDS),
        "pose_trail": with_views("SELECT p.key, p.seq, round(p.x - l.x, 6) AS x, round(p.y - l.y, 6) AS y FROM pose_obs p JOIN (SELECT key, arg_max(x, seq) AS x, arg_max(y, seq) AS y FROM pose_obs GROUP BY key) l ON l.key = p.key", "pose_obs"),
    }
