"""Background columns: a learned linear window over the cells around each column.

The window's contributions go out from the occupied and free cells (the sparse side): each cell adds
its weight to the 25 columns around it. A column that no cell reaches keeps the offset alone. Cells travel by frame
before they go out, so the weights are added up where they arise. `marked` tells each cell whether its column is background without a join:
a group is one scan, whose cells travel once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from rangeweave.functions.grid_index import GridSpec
from rangeweave.session import bounded, by_frame, ship

WINDOW = 2
#: Rows of a model that may be broadcast; that of 14 levels has 350.
MODEL_ROWS = 10_000


def _offsets(n: int):
    return F.explode(F.sequence(F.lit(-n), F.lit(n)))


def columns(frames: DataFrame, spec: GridSpec) -> DataFrame:
    """frame, i, j of every column of every frame."""
    every = frames.select("frame", F.explode(F.sequence(F.lit(0), F.lit(spec.n0 - 1))).alias("i"))
    return every.select("frame", "i", F.explode(F.sequence(F.lit(0), F.lit(spec.n1 - 1))).alias("j"))


def _sent(cells: DataFrame, model: DataFrame) -> DataFrame:
    """frame, i, j, w: what each cell adds to the columns around it, in the grid or not."""
    around = cells.where("val <> 0").withColumn("di", _offsets(WINDOW)).withColumn("dj", _offsets(WINDOW))
    met = around.join(bounded(model, MODEL_ROWS), ["di", "dj", "k"])
    weight = F.when(F.col("val") < 0, F.col("wf")).otherwise(F.col("wo"))
    return met.select("frame", (F.col("i") - F.col("di")).alias("i"), (F.col("j") - F.col("dj")).alias("j"), weight.alias("w"))


def scores(cells: DataFrame, model: DataFrame, spec: GridSpec) -> DataFrame:
    """frame, i, j, score (without the offset) of columns that some cell reaches.

    cells: frame, i, j, k, val; model: di, dj, k, wf, wo. The cell at (i + di, j + dj, k) adds wf to
    column (i, j) if it is free, wo if it is occupied.
    """
    to = _sent(by_frame(cells), model)
    return to.where(spec.inside(F.col("i"), F.col("j"))).groupBy("frame", "i", "j").agg(F.sum("w").alias("score"))


def classify(cells: DataFrame, model: DataFrame, spec: GridSpec, offset) -> DataFrame:
    """frame, i, j, score, background (1 unless the score with the offset is above 0), every column."""
    found = scores(cells, model, spec)
    every = columns(by_frame(cells.select("frame").distinct()), spec).select("frame", "i", "j", F.lit(0).cast(found.schema["score"].dataType).alias("score"))
    total = F.sum("score") + offset
    # The columns, in one and the same partition with their frame's scores, are added to them: a join would deal both by column.
    out = found.unionByName(every).groupBy("frame", "i", "j").agg(total.alias("score"))
    return out.select("frame", "i", "j", "score", F.when(F.col("score") > 0, 0).otherwise(1).alias("background"))


def smooth(filtered: DataFrame, spec: GridSpec) -> DataFrame:
    """frame, i, j, background: the majority in the 3x3 around; a tie is background."""
    around = filtered.withColumn("di", _offsets(1)).withColumn("dj", _offsets(1))
    to = around.select("frame", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "background")
    n = to.where(spec.inside(F.col("i"), F.col("j"))).groupBy("frame", "i", "j").agg(F.sum("background").alias("b"), F.count("*").alias("n"))
    return n.select("frame", "i", "j", F.when(2 * F.col("b") >= F.col("n"), 1).otherwise(0).alias("background"))


def marked(cells: DataFrame, model: DataFrame, spec: GridSpec, offset) -> DataFrame:
    """cells with background: that of their column, as `classify` has it; null outside the grid. model comes to the driver, refused beyond MODEL_ROWS rows."""
    rows = bounded(model, MODEL_ROWS).select("di", "dj", "k", "wf", "wo").collect()
    levels = np.unique(np.array([r["k"] for r in rows], dtype=np.int64))
    weights = np.zeros((2, 2 * WINDOW + 1, 2 * WINDOW + 1, len(levels) + 1))  # the last level: one that the model doesn't have
    for r in rows:
        if max(abs(r["di"]), abs(r["dj"])) <= WINDOW:
            weights[:, r["di"] + WINDOW, r["dj"] + WINDOW, np.searchsorted(levels, r["k"])] += r["wf"], r["wo"]
    bias = float(offset)

    def run(scan: pa.Table) -> pa.Table:
        i, j, k = (scan.column(c).to_numpy().astype(np.int64) for c in "ijk")
        val = scan.column("val").to_numpy(zero_copy_only=False).astype(float)
        at = np.searchsorted(levels, k)
        level = np.where((at < len(levels)) & (np.append(levels, 0)[at] == k), at, len(levels))
        sent = np.flatnonzero(np.abs(val) > 0)
        kind = (val[sent] > 0).astype(np.int64)
        score = np.full(spec.n0 * spec.n1, bias)
        inside = lambda a, b: (a >= 0) & (a < spec.n0) & (b >= 0) & (b < spec.n1)
        for di in range(-WINDOW, WINDOW + 1):
            for dj in range(-WINDOW, WINDOW + 1):
                a, b = i[sent] - di, j[sent] - dj
                w, ok = weights[kind, di + WINDOW, dj + WINDOW, level[sent]], inside(a, b)
                score += np.bincount((a * spec.n1 + b)[ok], weights=w[ok], minlength=len(score))
        there = inside(i, j)
        back = (score[np.where(there, i * spec.n1 + j, 0)] <= 0).astype(np.int32)
        return scan.append_column("background", pa.array(back, mask=~there))

    ship(cells.sparkSession)
    return by_frame(cells).groupBy("frame").applyInArrow(run, StructType([*cells.schema.fields]).add("background", IntegerType()))


def foreground(cells: DataFrame, model: DataFrame, spec: GridSpec, offset) -> DataFrame:
    """The cells whose column is not background."""
    return marked(cells, model, spec, offset).where("background IS NULL OR background <> 1").drop("background")
