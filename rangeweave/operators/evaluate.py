"""Evaluation and training rows: motion against labelled correspondence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeweave.functions.geometry import in_view, relative
from rangeweave.functions.grid_index import GridSpec
from rangeweave.operators.occupancy import probability
from rangeweave.operators.poses import project_points


CELL = ["frame", "i", "j"]


def eval_rows(cells: DataFrame, flow: DataFrame, filtered: DataFrame, match: DataFrame, types: DataFrame, camera: list[float], spec: GridSpec, per: str = "cell") -> DataFrame:
    """frame, i, j, x, y, x2, y2, u, v, filter, is_tracklet, type.

    One row for each occupied cell whose place and its correspondence are both in view (per="column":
    one for each such column). Where a column has no valid motion and is background, the motion is that
    of the ground. match: frame, i, j, x, y, x2, y2, gx, gy (where the ground there goes by the filtered
    poses), is_tracklet; all inputs meet by column.
    """
    at = cells.select(*CELL) if per == "cell" else cells.select(*CELL).distinct()
    seen = match.where(in_view(F.col("x"), F.col("y"), camera) & in_view(F.col("x2"), F.col("y2"), camera))
    seen = at.join(seen, CELL).join(types, CELL)
    seen = seen.join(flow.select(*CELL, "u", "v", "valid"), CELL, "left").join(filtered.select(*CELL, "background"), CELL, "left")
    filter_ = F.coalesce("background", F.lit(0))
    lost = (F.coalesce("valid", F.lit(0)) == 0) & (filter_ == 1)
    u = F.when(lost, F.col("gx") - F.col("x")).otherwise(F.coalesce("u", F.lit(0)) * spec.res)
    v = F.when(lost, F.col("gy") - F.col("y")).otherwise(F.coalesce("v", F.lit(0)) * spec.res)
    return seen.select(*CELL, "x", "y", "x2", "y2", u.alias("u"), v.alias("v"), filter_.alias("filter"), "is_tracklet", "type")


def tracklet_rows(rows: DataFrame, tracked: DataFrame) -> DataFrame:
    """frame, i, j, x, y, x2, y2, ft_x, ft_y (filtered velocity, metres a second), filter, is_tracklet, age, type:
    eval_rows of the columns that have a tracklet (tracked: frame, si, sj, h, v, age)."""
    t = tracked.select("frame", F.col("si").alias("i"), F.col("sj").alias("j"), (F.col("v") * F.cos("h")).alias("ft_x"), (F.col("v") * F.sin("h")).alias("ft_y"), "age")
    return rows.join(t, CELL).select(*CELL, "x", "y", "x2", "y2", "ft_x", "ft_y", "filter", "is_tracklet", "age", "type")


def write_eval(rows: DataFrame, tracked: DataFrame, path: str, mode: str = "append") -> None:
    """Three folders of CSV files without a header: eval, eval_tracklets (of columns on a track), eval_ft (of those with a tracklet)."""
    out = ["x", "y", "x2", "y2", "u", "v", "filter", "is_tracklet", "type"]
    rows.select(out).write.mode(mode).csv(f"{path}/eval")
    rows.where("is_tracklet = 1").select(out).write.mode(mode).csv(f"{path}/eval_tracklets")
    tracklet_rows(rows, tracked).drop(*CELL).write.mode(mode).csv(f"{path}/eval_ft")


def errors_by(rows: DataFrame) -> DataFrame:
    """type, filter (null: all), n, mean_error in metres: cube over both."""
    e = F.hypot(F.col("x2") - F.col("x") - F.col("u"), F.col("y2") - F.col("y") - F.col("v"))
    return rows.withColumn("e", e).cube("type", "filter").agg(F.count("*").alias("n"), F.avg("e").alias("mean_error"))


def sampled(a, b, n: int = 10):
    """A fixed pseudo-random tenth (1 / n) of integer pairs."""
    return (a * 7919 + b * 104729) % n == 0


def match_rows(match: DataFrame, columns: DataFrame, spec: GridSpec, span: int = 15) -> DataFrame:
    """frame, i, j, i2, j2, label: pairs of columns to learn matching from.

    columns: frame, i, j of columns with an occupied cell; match: frame, x, y, x2, y2 of their places.
    A column and the column of its correspondence are a positive pair if the next scan has the latter;
    a sampled part of the columns also gives a negative pair, displaced by a fixed pseudo-random step.
    """
    at = match.select("frame", *(spec.nearest(F.col(c), a).alias(n) for a, c, n in ((0, "x", "i"), (1, "y", "j"), (0, "x2", "i2"), (1, "y2", "j2"))))
    later = columns.select((F.col("frame") - 1).alias("frame"), F.col("i").alias("i2"), F.col("j").alias("j2")).distinct()
    good = at.join(later, ["frame", "i2", "j2"]).select("frame", "i", "j", "i2", "j2", F.lit(1).alias("label"))
    side = 2 * span + 1
    pick = (F.col("i") * 31 + F.col("j") * 17) % (side * side)
    moved = at.where(sampled(F.col("i"), F.col("j"))).select("frame", "i", "j", "i2", "j2", (F.col("i") + F.expr(f"CAST(((i * 31 + j * 17) % {side * side}) div {side} AS INT)") - span).alias("n2"), (F.col("j") + pick % side - span).alias("m2"))
    bad = moved.where("n2 <> i2 OR m2 <> j2").where(spec.inside(F.col("n2"), F.col("m2"))).select("frame", "i", "j", F.col("n2").alias("i2"), F.col("m2").alias("j2"), F.lit(0).alias("label"))
    return good.unionByName(bad)


def match_levels(pairs: DataFrame, cells: DataFrame, spec: GridSpec) -> DataFrame:
    """pairs (frame, i, j, i2, j2, label) with p1, p2: arrays of the levels' probabilities in both columns, a half where unknown."""
    key = ["frame", "i", "j"]
    # A column a level, each a maximum: what an aggregate by hash holds in a row, where collected lists are sorted by key first.
    names = [f"_p{k}" for k in range(spec.n2)]
    p = probability(F.col("val"))
    held = cells.where("val <> 0").groupBy(*key).agg(*(F.max(F.when(F.col("k") == k, p)).alias(n) for k, n in enumerate(names)))
    held = held.select(*key, F.array(*(F.coalesce(n, F.lit(0.5)) for n in names)).alias("m"))
    later = held.select((F.col("frame") - 1).alias("frame"), F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("m").alias("m2"))
    none = F.array(*[F.lit(0.5)] * spec.n2)
    met = pairs.join(held, key, "left").join(later, ["frame", "i2", "j2"], "left")
    return met.select(*key, "i2", "j2", "label", F.coalesce("m", none).alias("p1"), F.coalesce("m2", none).alias("p2"))


def lookup(points: DataFrame, flow: DataFrame, filtered: DataFrame, types: DataFrame, camera: list[float], spec: GridSpec) -> DataFrame:
    """points (frame, x, y) with i, j (its cell), u, v, valid, background, type, seen: all that is known of a place."""
    at = points.select("frame", "x", "y", spec.nearest(F.col("x"), 0).alias("i"), spec.nearest(F.col("y"), 1).alias("j"))
    at = at.join(flow.select(*CELL, "u", "v", "valid"), CELL, "left").join(filtered.select(*CELL, "background"), CELL, "left").join(types, ["frame", "x", "y"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return at.select("frame", "x", "y", "i", "j", zero("u"), zero("v"), zero("valid"), zero("background"), "type", in_view(F.col("x"), F.col("y"), camera).cast("int").alias("seen"))


def flow_arrows(cells: DataFrame, flow: DataFrame, spec: GridSpec, moved: DataFrame | None = None) -> DataFrame:
    """frame, i, j, k, x, y, z, x_from, y_from: each occupied cell (frame, i, j, k) of a column with a valid motion, and where it comes from.

    moved: frame, mx, my, mh, the vehicle's motion; the place that a cell comes from is then seen from there,
    so that arrows show motion over the ground, not against the vehicle.
    """
    met = cells.join(flow.where("valid = 1").select(*CELL, "u", "v"), CELL)
    x, y, z = (spec.metres(F.col(c), a) for a, c in enumerate("ijk"))
    met = met.select(*CELL, "k", x.alias("x"), y.alias("y"), z.alias("z"), (x - F.col("u") * spec.res).alias("x_from"), (y - F.col("v") * spec.res).alias("y_from"))
    if moved is None:
        return met
    met = met.join(moved, "frame")
    there = relative((F.col("mx"), F.col("my"), F.col("mh")), (F.col("x_from"), F.col("y_from"), F.lit(0.0)))
    return met.select(*CELL, "k", "x", "y", "z", there[0].alias("x_from"), there[1].alias("y_from"))


def nearest_hit(hits: DataFrame, by: str = "ray") -> DataFrame:
    """by, x, y, z, dist: of each ray's intersections (by, dist, x, y, z) the nearest one."""
    return hits.groupBy(by).agg(F.min(F.struct("dist", "x", "y", "z")).alias("m")).select(by, "m.x", "m.y", "m.z", "m.dist")


def training_columns(cells: DataFrame, labels: DataFrame, poses: DataFrame, camera: list[float], spec: GridSpec) -> DataFrame:
    """frame, i, j, label, di, dj, k, lp1, lp2: what the 25 columns around sampled columns hold, in long form.

    cells: frame, i, j, k, val; labels: frame, i, j, x, y, x2, y2, is_tracklet (columns whose place and its
    correspondence are in view count). Columns on a track all stay, of the others the sampled part. lp1 is the
    neighbour's value in the frame; lp2 that of the column of the next frame where the neighbour's place is
    by the unfiltered poses (frame, x, y, h). Levels that are 0 in both have no row.
    """
    kept = labels.where(in_view(F.col("x"), F.col("y"), camera) & in_view(F.col("x2"), F.col("y2"), camera))
    kept = kept.where((F.col("is_tracklet") == 1) | sampled(F.col("i"), F.col("j"))).select(*CELL, "x", "y", F.col("is_tracklet").alias("label"))
    around = kept.withColumn("di", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("dj", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    around = around.withColumn("x", F.col("x") + F.col("di") * spec.res).withColumn("y", F.col("y") + F.col("dj") * spec.res)
    there = project_points(around, poses)
    named = [*CELL, "label", "di", "dj", "k"]
    value = lambda f, c: cells.where("val <> 0").select((F.col("frame") - f).alias("frame"), F.col("i").alias("ci"), F.col("j").alias("cj"), "k", F.col("val").alias(c))
    one = there.withColumn("ci", F.col("i") + F.col("di")).withColumn("cj", F.col("j") + F.col("dj")).join(value(0, "lp1"), ["frame", "ci", "cj"])
    two = there.withColumn("ci", spec.nearest(F.col("x2"), 0)).withColumn("cj", spec.nearest(F.col("y2"), 1)).join(value(1, "lp2"), ["frame", "ci", "cj"])
    both = one.select(*named, "lp1", F.lit(None).cast("double").alias("lp2")).unionByName(two.select(*named, F.lit(None).cast("double").alias("lp1"), "lp2"))
    zero = lambda c: F.coalesce(F.max(c), F.lit(0.0)).alias(c)
    return both.groupBy(*named).agg(zero("lp1"), zero("lp2"))


def write_training(rows: DataFrame, spec: GridSpec, path: str) -> None:
    """A CSV line for each sampled column: lp1, lp2 of 25 columns' levels in (di, dj, k) order, then the label."""
    n = 25 * spec.n2
    at = ((F.col("di") + 2) * 5 + F.col("dj") + 2) * spec.n2 + F.col("k")
    short = lambda c: F.format_string("%3.1f", c)
    pair = F.concat_ws(",", short(F.col("lp1")), short(F.col("lp2")))
    held = rows.groupBy(*CELL, "label").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), pair.alias("v")))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit("0.0,0.0"))), ",")
    held.select(F.concat_ws(",", line, "label")).write.mode("overwrite").text(path)
