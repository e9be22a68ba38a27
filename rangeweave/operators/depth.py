"""Depth images of a scan: nearest return per pixel, and filling of the pixels between."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeweave.functions.geometry import project
from rangeweave.session import ship


def zbuffer(points: DataFrame, matrix: list[float], width: int, height: int) -> DataFrame:
    """frame, w, h, depth: the least depth of the points that fall on a pixel."""
    u, v, d = project((F.col("x"), F.col("y"), F.col("z")), matrix)
    p = points.select("frame", u.alias("u"), v.alias("v"), d.alias("depth")).where("depth > 0 AND u > -1.5 AND v > -1.5")
    p = p.select("frame", (F.col("u") + 0.5).cast("int").alias("w"), (F.col("v") + 0.5).cast("int").alias("h"), "depth")
    return p.where(F.col("w").between(0, width - 1) & F.col("h").between(0, height - 1)).groupBy("frame", "w", "h").agg(F.min("depth").alias("depth"))


def fill_image(depth: np.ndarray, rounds: int) -> np.ndarray:
    """Measured pixels (above 0) stay. The others take, each round, the mean of their known neighbours
    that are empty two rounds back or no more than 1 nearer than that value."""
    fixed, now, before = depth > 0, depth.copy(), depth.copy()
    for _ in range(rounds):
        pad = np.pad(now, 1)
        total, count = np.zeros_like(now), np.zeros_like(now)
        for a in (0, 1, 2):
            for b in (0, 1, 2):
                if (a, b) != (1, 1):
                    n = pad[a : a + now.shape[0], b : b + now.shape[1]]
                    ok = (n > 0) & ((np.abs(before) < 1e-3) | (before + 1 > n))
                    total += np.where(ok, n, 0)
                    count += ok
        new = np.where(fixed, depth, np.where(count > 0, total / np.maximum(count, 1), now))
        before, now = now, new
    return now


def fill(pixels: DataFrame, width: int, height: int, rounds: int = 10) -> DataFrame:
    """frame, w, h, depth of all pixels that a value reaches; an image (one frame) is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((width, height))
        image[pdf["w"], pdf["h"]] = pdf["depth"]
        full = fill_image(image, rounds)
        w, h = np.nonzero(full > 0)
        return pd.DataFrame({"frame": int(pdf["frame"].iloc[0]), "w": w, "h": h, "depth": full[w, h]})

    ship(pixels.sparkSession)
    return pixels.groupBy("frame").applyInPandas(run, "frame int, w int, h int, depth double")
