"""Image patches of grid columns: where a column's face falls in the image, and how far off its depth is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeweave.functions.geometry import project
from rangeweave.functions.grid_index import GridSpec

#: Samples across and up the face of a column.
ACROSS, UP = 16, 224


def samples(columns: DataFrame, matrix: list[float], spec: GridSpec, across: int = ACROSS, up: int = UP) -> DataFrame:
    """columns (frame, i, j) with a, b (sample), w, h (pixel, rounded) and depth: the face that looks back
    along x, sampled evenly; samples behind the camera are left out."""
    height = spec.n2 * spec.res
    x, y = spec.metres(F.col("i"), 0) - spec.res / 2, spec.metres(F.col("j"), 1)
    s = columns.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(up - 1))))
    u, v, d = project((x, y - spec.res / 2 + (F.col("a") + 0.5) * (spec.res / across), (F.col("b") + 0.5) * (height / up) - height / 2), matrix)
    s = s.select("frame", "i", "j", "a", "b", u.alias("u"), v.alias("v"), d.alias("depth")).where("depth > 0")
    return s.select("frame", "i", "j", "a", "b", F.round("u").cast("int").alias("w"), F.round("v").cast("int").alias("h"), "depth")


def error_byte(measured: Column, expected: Column) -> Column:
    """Centimetres between measured and expected depth around 127; 255 where nothing was measured."""
    off = F.round((measured - expected) * 100) + 127
    return F.when(F.coalesce(measured, F.lit(0.0)) < 1e-3, 255).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), off.cast("int"))))


def depth_errors(columns: DataFrame, pixels: DataFrame, matrix: list[float], spec: GridSpec, across: int = ACROSS, up: int = UP) -> DataFrame:
    """frame, i, j, a, b, error: the samples' error bytes under a depth image (frame, w, h, depth)."""
    image = pixels.select("frame", "w", "h", F.col("depth").alias("measured"))
    met = samples(columns, matrix, spec, across, up).join(image, ["frame", "w", "h"], "left")
    return met.select("frame", "i", "j", "a", "b", error_byte(F.col("measured"), F.col("depth")).alias("error"))


def patch_value(content: Column, a: Column, b: Column, channel: Column, across: int = ACROSS, up: int = UP, channels: int = 4) -> Column:
    """The byte at sample (a, b) of a column's patch (binary, [across][up][channels]) times 255; -1 outside of it."""
    at = (a * up + b) * channels + channel
    inside = a.between(0, across - 1) & b.between(0, up - 1) & channel.between(0, channels - 1)
    return F.when(inside, F.conv(F.hex(F.substring(content, at.cast("int") + 1, F.lit(1))), 16, 10).cast("double") * 255.0).otherwise(-1.0)


def outlines(columns: DataFrame, matrix: list[float], spec: GridSpec) -> DataFrame:
    """frame, i, j, corner, u, v: the corners of the face that patches sample, in the image, of columns (frame, i, j) before the camera."""
    height = spec.n2 * spec.res
    x = spec.metres(F.col("i"), 0) - spec.res / 2
    c = columns.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(3))))
    side, top = F.when(F.col("corner").isin(0, 3), -0.5).otherwise(0.5), F.when(F.col("corner") < 2, -0.5).otherwise(0.5)
    u, v, d = project((x, spec.metres(F.col("j"), 1) + side * spec.res, top * height), matrix)
    return c.select("frame", "i", "j", "corner", u.alias("u"), v.alias("v"), d.alias("d")).where("d > 0").drop("d")
