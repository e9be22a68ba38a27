"""The registered queries and their SQL oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.functions import colour
from rangeweave.functions.geometry import in_view, project, relative
from rangeweave.operators import background, depth, evaluate, filters, flow, gridstore, matcher, matching, occupancy, patches, picks, poses, projection, registration, tracks
from rangeweave.plans import fixtures as fx
from rangeweave.plans import oracles
from rangeweave.session import stored_path
from rangeweave.sources import scans

SPEC = fx.SPEC
#: Displacements searched, and rounds, by the flow queries that SQL repeats; the _full ones take the operators' own.
SEARCH, ROUNDS = 3, 3


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return occupancy.accumulate(fx.raw_scan(spark, d), SPEC)


# Occupancy


def occupancy_grid(spark, d):
    return _grid(spark, d)


def grid_merge(spark, d):
    g = _grid(spark, d)
    return occupancy.merge(g.where("frame <= 2"), g.where("frame > 2"))


def grid_clean(spark, d):
    return occupancy.clean(_grid(spark, d)).select("frame", "key", "val")


def column_occupancy(spark, d):
    return occupancy.column_counts(_grid(spark, d), SPEC)


def z_slice(spark, d):
    g = _grid(spark, d).select("frame", *SPEC.ijk(), "val").where("k = 7")
    return g.select("frame", "i", "j", occupancy.sign(F.col("val")).alias("s"))


def mle_state(spark, d):
    return _grid(spark, d).groupBy("frame", occupancy.state(F.col("val")).alias("state")).agg(F.count("*").alias("n"))


def occupancy_prob(spark, d):
    return _grid(spark, d).select("frame", "key", _r(occupancy.probability(F.col("val"))).alias("p"))


def multires_grid(spark, d):
    return occupancy.levels(fx.raw_scan(spark, d), SPEC, 3)


def occluded_cells(spark, d):
    e = occupancy.ends(fx.raw_scan(spark, d), SPEC)
    return occupancy.occluded(e, _grid(spark, d), SPEC)


def grid_subset(spark, d):
    target = type(SPEC)(80, 80, 14, 0.3)
    return occupancy.resample(_grid(spark, d), SPEC, target, (1.5, -0.6, 0.0))


def dense_trits(spark, d):
    g = _grid(spark, d)
    dense = occupancy.densify(g, g.select("frame").distinct(), SPEC)
    return dense.select("frame", "key", F.when(F.col("val") > 0.1, 1).when(F.col("val") < -0.1, -1).otherwise(0).alias("t"))


def z_slice_dense(spark, d):
    return occupancy.dense_slice(_grid(spark, d), SPEC, 7)


def posed_grid(spark, d):
    return occupancy.accumulate(occupancy.posed(fx.raw_scan(spark, d), fx.frame_poses(spark, d)), SPEC)


def packet_returns(spark, d):
    out = scans.decode_packets(fx.packets(spark, d))
    return out.select("packet_id", "block", "firing", "sorted", "intensity", *(_r(c).alias(c) for c in ("range", "theta", "phi", "x", "y", "z")))


def count_nonzero(spark, d):
    return _grid(spark, d).groupBy("frame").agg(F.count_if(F.abs("val") > 1e-3).alias("n"))


# Background


def background_filter(spark, d):
    return background.classify(fx.valued_cells(spark, d), fx.bg_model(spark, d), SPEC, fx.FILTER_OFFSET)


def filter_smooth(spark, d):
    return background.smooth(background_filter(spark, d), SPEC)


def foreground_cells(spark, d):
    return background.foreground(fx.valued_cells(spark, d), fx.bg_model(spark, d), SPEC, fx.FILTER_OFFSET)


def filtered_states(spark, d):
    both = background.marked(fx.valued_cells(spark, d), fx.bg_model(spark, d), SPEC, fx.FILTER_OFFSET)
    p = _r(occupancy.probability(F.col("val"), F.col("background")))
    return both.groupBy("frame", occupancy.state(F.col("val"), F.col("background")).alias("state"), p.alias("p")).agg(F.count("*").alias("n"))


def foreground_boxes(spark, d):
    g = foreground_cells(spark, d).where("val > 0")
    return g.select("frame", *(_r(SPEC.metres(F.col(c), a)).alias(n) for a, (c, n) in enumerate(zip("ijk", "xyz", strict=True))), F.lit(round(0.75 * SPEC.res, 6)).alias("size"))


# Flow


def _occupied_columns(spark, d):
    cells = fx.scan_cells(spark, d)
    return cells.groupBy("frame", "i", "j").agg(F.lit(0).alias("free"), F.bit_or(F.expr("shiftleft(1, k)")).alias("occupied"), F.lit(True).alias("evident"))


#: Weights of levels that are occupied in both scans; no others count.
OCCUPIED_ONLY = ([0] * SPEC.n2, fx.LEVEL_WEIGHTS, [0] * SPEC.n2)


def column_scores(spark, d):
    return matcher.scored(_occupied_columns(spark, d), SPEC, OCCUPIED_ONLY, fx.MATCH_OFFSET, SEARCH, windowed=False)


def windowed_scores(spark, d):
    return matcher.scored(_occupied_columns(spark, d), SPEC, OCCUPIED_ONLY, fx.MATCH_OFFSET, SEARCH)


def flow_estep(spark, d):
    return matcher.proposed(_occupied_columns(spark, d), SPEC, OCCUPIED_ONLY, fx.MATCH_OFFSET, SEARCH)


def flow_mstep(spark, d):
    return flow.resolve(flow_estep(spark, d))


def flow_solve(spark, d):
    return matcher.flow(_occupied_columns(spark, d), SPEC, OCCUPIED_ONLY, fx.MATCH_OFFSET, SEARCH, ROUNDS)


def _drive_columns(spark, d):
    """Of the traced drives; background columns aren't evident."""
    mask = matcher.Filter.of(fx.bg_model(spark, d), SPEC, fx.DRIVE_FILTER_OFFSET)
    return matcher.scan_columns(fx.drive_scan(spark, d), SPEC, mask)


def flow_step_full(spark, d):
    """The first round of the full match of the foreground columns."""
    return matcher.flow(_drive_columns(spark, d), SPEC, rounds=1)


def flow_step_tiles(spark, d):
    """The same by tiles of 64 columns."""
    return matcher.flow_tiles(_drive_columns(spark, d), SPEC, rounds=1)


def flow_solve_full(spark, d):
    return matcher.flow(_drive_columns(spark, d), SPEC)


def flow_reverse(spark, d):
    return flow.reverse(flow_solve(spark, d))


# Poses and tracks


def poses_mercator(spark, d):
    p = poses.from_positions(fx.positions(spark, d))
    return p.select("log", "frame", _r("x", 3).alias("x"), _r("y", 3).alias("y"), "z", _r("h").alias("h"))


def relative_pose(spark, d):
    s = poses.steps(fx.pose_observations(spark, d), "key", "seq")
    return s.select("key", "seq", *(_r(c).alias(c) for c in ("dx", "dy", "dh")))


def pose_chain(spark, d):
    s = fx.pose_observations(spark, d).selectExpr("key", "seq", "v_f / 10 AS dx", "CAST(0 AS DOUBLE) AS dy", "h / 100 AS dh")
    return poses.chain(s, "key", "seq").select("key", "seq", *(_r(c, 4).alias(c) for c in ("x", "y", "h")))


def relative_pose6(spark, d):
    s = poses.steps6(fx.full_poses(spark, d), "key", "seq")
    return s.select("key", "seq", *(_r(f"d{c}").alias(f"d{c}") for c in registration.POSE))


def pose_chain6(spark, d):
    s = poses.chain6(fx.full_moves(spark, d), "key", "seq")
    return s.select("key", "seq", *(_r(c, 4).alias(c) for c in registration.POSE))


def _places(spark, d):
    cells = fx.scan_cells(spark, d).select("frame", "i", "j").distinct()
    return cells.select("frame", "i", "j", SPEC.metres(F.col("i"), 0).alias("x"), SPEC.metres(F.col("j"), 1).alias("y"))


def _ground(spark, d):
    return poses.project_points(_places(spark, d).select("frame", "x", "y"), fx.poses(spark, d))


def ego_project(spark, d):
    return _ground(spark, d).select("frame", *(_r(c).alias(c) for c in ("x", "y", "x2", "y2")))


def object_at(spark, d):
    out = tracks.object_at(_places(spark, d), fx.tracks(spark, d))
    return out.select("frame", _r("x").alias("x"), _r("y").alias("y"), "type")


def active_tracks(spark, d):
    nested = fx.tracks(spark, d).groupBy("track_id", "objectType", "l", "w").agg(F.min("frame").alias("first_frame"), F.transform(F.array_sort(F.collect_list(F.struct("frame", "tx", "ty", "rz"))), lambda x: F.struct(x["tx"].alias("tx"), x["ty"].alias("ty"), x["rz"].alias("rz"))).alias("poses"))
    return tracks.active(nested)


def _match(spark, d, places=None):
    """By column (of places, or of all): frame, i, j, x, y, x2, y2, gx, gy, is_tracklet."""
    p = _places(spark, d) if places is None else places
    ground = poses.project_points(p, fx.poses(spark, d)).withColumn("gx", F.col("x2")).withColumn("gy", F.col("y2"))
    return tracks.correspondence(p, fx.tracks(spark, d), ground, ("frame", "i", "j"))


def correspondence(spark, d):
    return _match(spark, d).select("frame", *(_r(c).alias(c) for c in ("x", "y", "x2", "y2")), "is_tracklet")


def camera_visible(spark, d):
    p = _places(spark, d)
    return p.select("frame", "i", "j", in_view(F.col("x"), F.col("y"), fx.CAMERA).cast("int").alias("seen"))


# Evaluation and training


def _in_camera(columns: DataFrame) -> DataFrame:
    """Those (frame, i, j, ...) whose place is in view: no others are evaluated, so they needn't meet anything."""
    return columns.where(in_view(SPEC.metres(F.col("i"), 0), SPEC.metres(F.col("j"), 1), fx.CAMERA))


def _eval(spark, d):
    seen = _in_camera(_places(spark, d))
    types = tracks.object_at(seen, fx.tracks(spark, d), ("frame", "i", "j"))
    cells, flow_, filtered = (_in_camera(x) for x in (fx.scan_cells(spark, d), flow_solve(spark, d), background_filter(spark, d)))
    return evaluate.eval_rows(cells, flow_, filtered, _match(spark, d, seen), types, fx.CAMERA, SPEC)


def eval_tracklets(spark, d):
    f = flow_solve(spark, d).withColumn("sequence", F.expr(f"CAST(frame div {fx.DRIVE_FRAMES} AS BIGINT)"))
    rows = evaluate.tracklet_rows(_eval(spark, d), filters.tracklets(f, SPEC.res, SPEC.dims[:2]))
    return rows.select("frame", "i", "j", *(_r(c).alias(c) for c in ("x", "y", "x2", "y2", "ft_x", "ft_y")), "filter", "is_tracklet", "age", "type")


def eval_rows(spark, d):
    return _eval(spark, d).select("frame", *(_r(c).alias(c) for c in ("x", "y", "x2", "y2", "u", "v")), "filter", "is_tracklet", "type")


def eval_by_type(spark, d):
    return evaluate.errors_by(_eval(spark, d)).withColumn("mean_error", _r("mean_error", 4))


def train_filter_rows(spark, d):
    return evaluate.training_columns(fx.valued_cells(spark, d), _match(spark, d), fx.poses(spark, d), fx.CAMERA, SPEC)


def train_match_rows(spark, d):
    return evaluate.match_rows(_match(spark, d), fx.scan_cells(spark, d), SPEC)


def train_match_levels(spark, d):
    pairs = evaluate.match_rows(_match(spark, d), fx.scan_cells(spark, d), SPEC)
    out = evaluate.match_levels(pairs, fx.valued_cells(spark, d), SPEC)
    both = out.select("frame", "i", "j", "i2", "j2", "label", F.posexplode(F.arrays_zip("p1", "p2")).alias("k", "p"))
    return both.select("frame", "i", "j", "i2", "j2", "label", "k", _r("p.p1").alias("p1"), _r("p.p2").alias("p2"))


def pick_lookup(spark, d):
    picks = fx.tracks(spark, d).selectExpr("frame", "tx AS x", "ty AS y").distinct()
    out = evaluate.lookup(picks, flow_solve(spark, d), background_filter(spark, d), tracks.object_at(picks, fx.tracks(spark, d)), fx.CAMERA, SPEC)
    return out.withColumn("x", _r("x")).withColumn("y", _r("y"))


def object_at_3d(spark, d):
    out = tracks.object_at3(_points(spark, d), fx.boxes(spark, d))
    return out.select("frame", *(_r(c).alias(c) for c in "xyz"), "type")


def correspondence_3d(spark, d):
    """Of points on a track alone: where they go with it as it turns in space."""
    p = _points(spark, d).distinct()
    still = p.select("frame", "x", "y", "z", *(F.col(c).alias(f"{c}2") for c in "xyz"))
    out = tracks.correspondence3(p, fx.boxes(spark, d), still).where("is_tracklet = 1")
    return out.select("frame", *(_r(c).alias(c) for c in ("x", "y", "z", "x2", "y2", "z2")))


def ray_picks(spark, d):
    out = picks.pick(fx.rays(spark, d), fx.boxes(spark, d), fx.scan_cells(spark, d), SPEC)
    return out.select("ray", *(_r(c).alias(c) for c in ("x", "y", "z", "dist")), "what")


# With all displacements and rounds, the foreground mask and filtered poses


def flow_cells_full(spark, d):
    mask = matcher.Filter.of(fx.bg_model(spark, d), SPEC, fx.FILTER_OFFSET)
    return matcher.flow(matcher.columns_of(fx.valued_cells(spark, d)), SPEC, filter=mask)


def _filtered_poses(spark, d):
    """The vehicle's poses by the pose filter, a filter a drive."""
    seen = fx.poses(spark, d).selectExpr(f"CAST(frame div {fx.DRIVE_FRAMES} AS BIGINT) AS key", "CAST(frame AS BIGINT) AS seq", "x", "y", "h", "3.0D AS v_f", "0.1D AS v_h")
    return filters.filter_poses(seen).select(F.col("seq").cast("int").alias("frame"), "x", "y", "h")


def _eval_full(spark, d):
    p = _in_camera(_places(spark, d))
    raw = poses.project_points(p, fx.poses(spark, d))
    ground = poses.project_points(p, _filtered_poses(spark, d)).select("frame", "i", "j", F.col("x2").alias("gx"), F.col("y2").alias("gy"))
    match = tracks.correspondence(p, fx.tracks(spark, d), raw.join(ground, ["frame", "i", "j"]), ("frame", "i", "j"))
    types = tracks.object_at(p, fx.tracks(spark, d), ("frame", "i", "j"))
    cells, flow_, filtered = (_in_camera(x) for x in (fx.scan_cells(spark, d), flow_cells_full(spark, d), background_filter(spark, d)))
    return evaluate.eval_rows(cells, flow_, filtered, match, types, fx.CAMERA, SPEC)


def eval_rows_full(spark, d):
    return _eval_full(spark, d).select("frame", "i", "j", *(_r(c).alias(c) for c in ("x", "y", "x2", "y2", "u", "v")), "filter", "is_tracklet", "type")


def grid_merge_stored(spark, d):
    """The grid of all drives from a store of blocks of frames, merged without a shuffle."""
    name = f"grids_{uuid.uuid4().hex}"
    g = occupancy.accumulate(fx.drive_scan(spark, d), SPEC)
    gridstore.open_store(spark, name, stored_path(spark, name), 16)
    gridstore.add(g, name, fx.DRIVE_FRAMES)
    return gridstore.merged(spark, name)


# Filters, projection, depth


def pose_filter(spark, d):
    return filters.filter_poses(fx.pose_observations(spark, d))


def _drive_tracklets(spark, d):
    f = flow_solve_full(spark, d).withColumn("sequence", F.expr(f"CAST(frame div {fx.DRIVE_FRAMES} AS BIGINT)"))
    return filters.tracklets(f, SPEC.res, SPEC.dims[:2])


def tracklets(spark, d):
    return _drive_tracklets(spark, d)


def tracklet_arrows(spark, d):
    return filters.arrows(_drive_tracklets(spark, d), occupancy.scan_occupied(fx.drive_scan(spark, d), SPEC), SPEC)


def project_tracklets(spark, d):
    """The grid of a frame, carried on by the tracklets that the frame before left in its columns."""
    motion = _drive_tracklets(spark, d).select((F.col("frame") + 1).alias("frame"), "i", "j", "x", "y", "h", "v", "w")
    return projection.project_scans(fx.drive_scan(spark, d), motion, SPEC, 0.5)


def project_grid(spark, d):
    motion = _places(spark, d).selectExpr("frame", "i", "j", "(i % 7) * 0.3 - 0.9 AS h", "CAST(j % 11 AS DOUBLE) AS v", "CAST(((i + j) % 5) * 0.1 AS DOUBLE) AS w")
    return projection.project_grid(fx.valued_cells(spark, d), motion, SPEC, 0.5)


def _points(spark, d):
    cells = fx.scan_cells(spark, d)
    return cells.select("frame", *(SPEC.metres(F.col(c), a).alias(n) for a, (c, n) in enumerate(zip("ijk", "xyz", strict=True))))


def zbuffer(spark, d):
    return depth.zbuffer(_points(spark, d), fx.CAMERA, 1242, 375).withColumn("depth", _r("depth"))


def depth_fill(spark, d):
    return depth.fill(depth.zbuffer(_points(spark, d), fx.CAMERA, 1242, 375), 1242, 375)


def scan_match(spark, d):
    p = _points(spark, d).select("frame", ((F.col("frame") * 1000 + F.round(F.col("x") / SPEC.res + 83)) * 1000000 + F.round(F.col("y") / SPEC.res + 83) * 1000 + F.round(F.col("z") / SPEC.res + 7)).cast("long").alias("point_id"), "x", "y", "z")
    seeds = fx.poses(spark, d).where(fx.FOLLOWED).select("frame", F.lit(-0.5).alias("x"), F.lit(0.25).alias("y"), F.lit(0.0).alias("h"))
    out = matching.match_scans(p, seeds, 2, 0.9)
    return out.select("frame", _r("x", 4).alias("x"), _r("y", 4).alias("y"), _r("h", 4).alias("h"), "n", _r("error", 4).alias("error"))


def _scan_moves(spark, d):
    """Of every drive's points, the motion from each scan to the next; expected: a bit less than the planted one."""
    p = _points(spark, d).withColumn("point_id", F.xxhash64("x", "y", "z"))
    zero = F.lit(0.0)
    seeds = fx.poses(spark, d).where(fx.FOLLOWED).select("frame", F.lit(-0.5).alias("x"), F.lit(0.2).alias("y"), zero.alias("z"), zero.alias("r"), zero.alias("p"), F.lit(0.002).alias("h"))
    return registration.match_scans(p, seeds)


def scan_match_full(spark, d):
    return _scan_moves(spark, d).select("frame", *(_r(c, 4).alias(c) for c in registration.POSE), "rounds", "converged", "n")


def scan_match_log(spark, d):
    """The matched motions of each drive, composed: where each scan was taken, seen from the drive's first."""
    moves = _scan_moves(spark, d).withColumn("drive", F.expr(f"frame div {fx.DRIVE_FRAMES}"))
    return poses.chain6(moves, "drive", "frame").select("drive", "frame", *(_r(c, 4).alias(c) for c in registration.POSE))


def roi_samples(spark, d):
    cells = fx.scan_cells(spark, d).select("frame", "i", "j").distinct()
    return patches.samples(cells, fx.CAMERA, SPEC, 4, 8).withColumn("depth", _r("depth"))


def depth_errors(spark, d):
    cells = fx.scan_cells(spark, d).select("frame", "i", "j").distinct()
    pixels = depth.zbuffer(_points(spark, d), fx.CAMERA, 1242, 375)
    return patches.depth_errors(cells, pixels, fx.CAMERA, SPEC, 4, 8).groupBy("frame", "i", "j").agg(F.count_if(F.col("error") < 255).alias("known"), F.sum("error").alias("total"))


# Views


def point_colours(spark, d):
    p = fx.raw_scan(spark, d)
    far = colour.by_depth(F.hypot("x", "y"))
    r, g, b = colour.jet(far)
    return p.groupBy(colour.byte(F.col("z"), -2.0, 3.0).alias("z8"), colour.byte(colour.by_height(F.col("z")), 0.0, 1.0).alias("height"), r.alias("r"), g.alias("g"), b.alias("b")).agg(F.count("*").alias("n"))


def flow_table(spark, d):
    f = flow_solve(spark, d)
    return f.select("frame", "i", "j", _r(F.col("u") * SPEC.res / 0.1).alias("u"), _r(F.col("v") * SPEC.res / 0.1).alias("v"), "valid")


def occupied_boxes(spark, d):
    g = _grid(spark, d).where("val > 0").select("frame", *SPEC.ijk())
    return g.select("frame", *(_r(SPEC.metres(F.col(c), a)).alias(n) for a, (c, n) in enumerate(zip("ijk", "xyz", strict=True))), F.lit(round(0.75 * SPEC.res, 6)).alias("size"))


def flow_arrows(spark, d):
    f = flow_solve(spark, d).where("valid = 1")
    x, y = SPEC.metres(F.col("i"), 0), SPEC.metres(F.col("j"), 1)
    return f.select("frame", _r(x).alias("x"), _r(y).alias("y"), _r(x - F.col("u") * SPEC.res).alias("x_from"), _r(y - F.col("v") * SPEC.res).alias("y_from"))


def flow_arrows_world(spark, d):
    """Arrows of occupied cells over the ground, with their heights."""
    at = fx.poses(spark, d)
    both = at.join(at.selectExpr("frame - 1 AS frame", "x AS bx", "y AS by", "h AS bh"), "frame")
    moved = relative((F.col("x"), F.col("y"), F.col("h")), (F.col("bx"), F.col("by"), F.col("bh")))
    moved = both.select("frame", *(c.alias(n) for c, n in zip(moved, ("mx", "my", "mh"), strict=True)))
    out = evaluate.flow_arrows(fx.scan_cells(spark, d), flow_solve(spark, d), SPEC, moved)
    return out.select("frame", "i", "j", "k", *(_r(c).alias(c) for c in ("x", "y", "z", "x_from", "y_from")))


def column_boxes(spark, d):
    """The boxes of the columns that the tracks' centres pick."""
    picks = fx.tracks(spark, d).select("frame", SPEC.nearest(F.col("tx"), 0).alias("i"), SPEC.nearest(F.col("ty"), 1).alias("j")).distinct().where(SPEC.inside(F.col("i"), F.col("j")))
    c = picks.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SPEC.n2 - 1))))
    return c.select("frame", "i", "j", "k", *(_r(SPEC.metres(F.col(c), a)).alias(n) for a, (c, n) in enumerate(zip("ijk", "xyz", strict=True))))


def track_boxes(spark, d):
    red, green, blue = colour.of_type(F.col("objectType"))
    return active_tracks(spark, d).select("track_id", "frame", _r("tx").alias("x"), _r("ty").alias("y"), F.lit(tracks.LIFT).alias("z"), _r("rz").alias("rz"), "l", "w", red.alias("r"), green.alias("g"), blue.alias("b"))


def image_flow_lines(spark, d):
    """Where an occupied cell of a moving column and the place it moves to are in the image, if both are."""
    cells = fx.scan_cells(spark, d).join(flow_solve(spark, d).where("valid = 1").select("frame", "i", "j", "u", "v"), ["frame", "i", "j"])
    x, y, z = (SPEC.metres(F.col(c), a) for a, c in enumerate("ijk"))
    a = project((x, y, z), fx.CAMERA)
    b = project((x + F.col("u") * SPEC.res, y + F.col("v") * SPEC.res, z), fx.CAMERA)
    named = [c.alias(n) for c, n in zip((*a, *b), ("u1", "v1", "d1", "u2", "v2", "d2"), strict=True)]
    inside = " AND ".join(f"d{e} > 0 AND u{e} BETWEEN 0 AND 1242 AND v{e} BETWEEN 0 AND 375" for e in (1, 2))
    return cells.select("frame", "i", "j", "k", *named).where(inside).select("frame", "i", "j", "k", *(_r(c, 4).alias(c) for c in ("u1", "v1", "u2", "v2")))


def roi_outlines(spark, d):
    cells = fx.scan_cells(spark, d).select("frame", "i", "j").distinct()
    return patches.outlines(cells, fx.CAMERA, SPEC).select("frame", "i", "j", "corner", _r("u", 3).alias("u"), _r("v", 3).alias("v"))


def pose_trail(spark, d):
    p = poses.trail(fx.pose_observations(spark, d), "key", "seq")
    return p.select("key", "seq", _r("x").alias("x"), _r("y").alias("y"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        occupancy_grid, grid_merge, grid_clean, column_occupancy, z_slice, mle_state, occupancy_prob, multires_grid, occluded_cells,
        grid_subset, dense_trits, z_slice_dense, posed_grid, packet_returns, count_nonzero, filtered_states, foreground_boxes, background_filter, filter_smooth, foreground_cells, column_scores, windowed_scores,
        flow_estep, flow_mstep, flow_solve, flow_step_full, flow_step_tiles, flow_solve_full, flow_reverse, poses_mercator, relative_pose, pose_chain, relative_pose6, pose_chain6, ego_project, object_at, active_tracks,
        correspondence, camera_visible, eval_rows, eval_by_type, eval_tracklets, flow_cells_full, eval_rows_full, object_at_3d, correspondence_3d, ray_picks, grid_merge_stored, train_filter_rows, pose_filter, tracklets, tracklet_arrows, project_tracklets, project_grid, zbuffer,
        depth_fill, train_match_rows, train_match_levels, pick_lookup, column_boxes, track_boxes, image_flow_lines, roi_outlines, scan_match, scan_match_full, scan_match_log, roi_samples, depth_errors, point_colours, flow_table, occupied_boxes, flow_arrows, flow_arrows_world, pose_trail,
    )}


def oracle_sql() -> dict[str, str]:
    return oracles.all_oracles()
