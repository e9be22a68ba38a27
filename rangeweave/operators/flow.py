"""Two-dimensional motion of grid columns between consecutive scans.

Only columns with an occupied cell have scores that vary, so scores exist for those alone; what empty
and outside neighbours add to a window are constants times counts. All scores are integers (units of
1 / SCALE), so that ties and sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeweave.functions.grid_index import GridSpec
from rangeweave.session import bounded

SCALE = 1000
#: Score of an empty column inside the grid, log 0.5; of a column outside, for 14 levels.
EMPTY_SCORE, OUTSIDE_SCORE = -693, -17289
#: Cost of a displacement's squared length.
LENGTH_COST = 1
SMOOTH = 2


def _span(w: int):
    return F.explode(F.sequence(F.lit(-w), F.lit(w)))


def _scaled_log_sigmoid(s):
    return F.round(-F.log1p(F.exp(-s / 100.0)) * SCALE).cast("long")


def column_scores(cells: DataFrame, weights: DataFrame, spec: GridSpec, w: int, offset: int) -> DataFrame:
    """frame, i, j, du, dv, score for the columns with an occupied cell and every |du|, |dv| <= w.

    cells: frame, i, j, k (occupied); weights: k, wo (hundredths) of a level occupied in both scans;
    the column at (i + du, j + dv) of the next frame is compared level by level.
    """
    source = cells.select("frame", "i", "j").distinct().withColumn("du", _span(w)).withColumn("dv", _span(w))
    moved = cells.withColumn("du", _span(w)).withColumn("dv", _span(w)).select("frame", "i", "j", "k", "du", "dv", (F.col("i") + F.col("du")).alias("i2"), (F.col("j") + F.col("dv")).alias("j2"))
    ahead = cells.select((F.col("frame") - 1).alias("frame"), F.col("i").alias("i2"), F.col("j").alias("j2"), "k")
    both = moved.join(ahead, ["frame", "i2", "j2", "k"]).join(bounded(weights, spec.n2), "k")
    sums = both.groupBy("frame", "i", "j", "du", "dv").agg(F.sum("wo").alias("s"))
    score = _scaled_log_sigmoid(F.coalesce("s", F.lit(0)) + offset)
    return source.join(sums, ["frame", "i", "j", "du", "dv"], "left").select("frame", "i", "j", "du", "dv", score.alias("score"))


def windowed(scores: DataFrame, spec: GridSpec) -> DataFrame:
    """frame, i, j, du, dv, win: the 3x3 sum around every scored column."""
    to = scores.withColumn("a", _span(1)).withColumn("b", _span(1))
    to = to.select("frame", (F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j"), "du", "dv", "score")
    sums = to.groupBy("frame", "i", "j", "du", "dv").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    edge = lambda c, n: F.when((F.col(c) > 0) & (F.col(c) < n - 1), 3).otherwise(2)
    inside = edge("i", spec.n0) * edge("j", spec.n1)
    win = F.col("s") + (inside - F.col("n")) * EMPTY_SCORE + (9 - inside) * OUTSIDE_SCORE
    return scores.select("frame", "i", "j", "du", "dv").join(sums, ["frame", "i", "j", "du", "dv"]).select("frame", "i", "j", "du", "dv", win.alias("win"))


def propose(win: DataFrame, spec: GridSpec, last: DataFrame | None = None, weight: int = 1) -> DataFrame:
    """frame, i, j, u, v, valid, score: every source's best admissible displacement.

    A target is admissible inside the grid, and if nobody holds it, the source would score higher than
    who holds it, or the source holds it itself. last: the assignment before (frame, i, j, u, v, valid,
    score); its valid neighbours in the 5x5 pull displacements towards theirs.
    """
    score = F.col("win") - LENGTH_COST * (F.col("du") * F.col("du") + F.col("dv") * F.col("dv"))
    c = win.select("frame", "i", "j", "du", "dv", score.alias("score"), (F.col("i") + F.col("du")).alias("i2"), (F.col("j") + F.col("dv")).alias("j2"))
    c = c.where(spec.inside(F.col("i2"), F.col("j2")))
    if last is not None:
        held = last.where("valid = 1")
        near = held.withColumn("a", _span(SMOOTH)).withColumn("b", _span(SMOOTH)).where("a <> 0 OR b <> 0")
        near = near.groupBy("frame", (F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j")).agg(
            F.count("*").alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv"), F.sum(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("s2")
        )
        c = c.join(near, ["frame", "i", "j"], "left")
        du, dv = F.col("du"), F.col("dv")
        pull = F.coalesce(F.col("s2") + F.col("n") * (du * du + dv * dv) - 2 * (du * F.col("su") + dv * F.col("sv")), F.lit(0))
        owners = held.select("frame", (F.col("i") + F.col("u")).alias("i2"), (F.col("j") + F.col("v")).alias("j2"), F.col("i").alias("oi"), F.col("j").alias("oj"), F.col("score").alias("os"))
        c = c.withColumn("score", F.col("score") - weight * pull).join(owners, ["frame", "i2", "j2"], "left")
        c = c.where("os IS NULL OR score > os OR (oi = i AND oj = j)")
    # The best by score, then least du, then least dv: an aggregate with map-side combining, not a sort.
    best = c.groupBy("frame", "i", "j").agg(F.max(F.struct("score", (-F.col("du")).alias("du"), (-F.col("dv")).alias("dv"))).alias("b"))
    best = best.select("frame", "i", "j", (-F.col("b.du")).alias("du"), (-F.col("b.dv")).alias("dv"), "b.score")
    every = win.select("frame", "i", "j").distinct().join(best, ["frame", "i", "j"], "left")
    return every.select("frame", "i", "j", F.coalesce("du", F.lit(0)).alias("u"), F.coalesce("dv", F.lit(0)).alias("v"), F.when(F.col("score").isNull(), 0).otherwise(1).alias("valid"), "score")


def resolve(proposed: DataFrame) -> DataFrame:
    """The same rows; of the valid sources with one target only the best stays valid (ties: lowest i, then j)."""
    w = Window.partitionBy("frame", "valid", F.col("i") + F.col("u"), F.col("j") + F.col("v")).orderBy(F.desc("score"), "i", "j")
    return proposed.withColumn("_r", F.row_number().over(w)).withColumn("valid", F.when((F.col("valid") == 1) & (F.col("_r") == 1), 1).otherwise(0)).drop("_r")


def solve(win: DataFrame, spec: GridSpec, rounds: int, weight: int = 1, keep=lambda df: df) -> DataFrame:
    """frame, i, j, u, v, valid, score after `rounds` of propose and resolve.

    keep: called with each round's assignment; give a function that checkpoints for many rounds.
    """
    last = None
    for _ in range(rounds):
        last = keep(resolve(propose(win, spec, last, weight)))
    return last


def reverse(flow: DataFrame) -> DataFrame:
    """The valid motions seen from the later scan: frame, i, j, u, v."""
    return flow.where("valid = 1").select((F.col("frame") + 1).alias("frame"), (F.col("i") + F.col("u")).alias("i"), (F.col("j") + F.col("v")).alias("j"), (-F.col("u")).alias("u"), (-F.col("v")).alias("v"))
