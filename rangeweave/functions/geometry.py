"""Rigid motions, map projection and camera projection as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
#: The camera's extent used by the visibility test.
VIEW_WIDTH, VIEW_HEIGHT = 1392, 512


def rotation(r: Column, p: Column, h: Column) -> list[list[Column]]:
    """Rz(h) Ry(p) Rx(r)."""
    cr, sr, cp, sp, ch, sh = F.cos(r), F.sin(r), F.cos(p), F.sin(p), F.cos(h), F.sin(h)
    return [
        [ch * cp, ch * sp * sr - sh * cr, ch * sp * cr + sh * sr],
        [sh * cp, sh * sp * sr + ch * cr, sh * sp * cr - ch * sr],
        [-sp, cp * sr, cp * cr],
    ]


def rigid(point: tuple[Column, Column, Column], pose: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """R(r, p, h) * point + (x, y, z) for a pose (x, y, z, r, p, h)."""
    m = rotation(*pose[3:])
    return tuple(m[a][0] * point[0] + m[a][1] * point[1] + m[a][2] * point[2] + pose[a] for a in range(3))


def wrap(angle: Column) -> Column:
    """To [-pi, pi]; both ends stay as they are."""
    turned = angle - 2 * math.pi * F.ceil((angle - math.pi) / (2 * math.pi))
    return F.when(angle.between(-math.pi, math.pi), angle).otherwise(turned)


def compose(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Planar head-to-tail: pose a followed by pose b (x, y, h each)."""
    c, s = F.cos(a[2]), F.sin(a[2])
    return a[0] + c * b[0] - s * b[1], a[1] + s * b[0] + c * b[1], wrap(a[2] + b[2])


def relative(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Planar tail-to-tail: pose b seen from pose a."""
    c, s = F.cos(a[2]), F.sin(a[2])
    dx, dy = b[0] - a[0], b[1] - a[1]
    return c * dx + s * dy, -s * dx + c * dy, wrap(b[2] - a[2])


def angles(m: list[list[Column]]) -> tuple[Column, Column, Column]:
    """r, p, h of a rotation, pitch within half a turn: the inverse of `rotation`."""
    return F.atan2(m[2][1], m[2][2]), F.atan2(-m[2][0], F.hypot(m[0][0], m[1][0])), F.atan2(m[1][0], m[0][0])


def _product(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(3)] for i in range(3)]


def compose6(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """Head-to-tail: pose a followed by pose b (x, y, z, r, p, h each)."""
    return *rigid(b[:3], a), *angles(_product(rotation(*a[3:]), rotation(*b[3:])))


def relative6(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """Tail-to-tail: pose b seen from pose a."""
    back = [list(c) for c in zip(*rotation(*a[3:]), strict=True)]
    off = [b[k] - a[k] for k in range(3)]
    return *(r[0] * off[0] + r[1] * off[1] + r[2] * off[2] for r in back), *angles(_product(back, rotation(*b[3:])))


def mercator(lat: Column, lon: Column, scale: Column) -> tuple[Column, Column]:
    """Metres east and north; scale: the cosine of the log's first latitude."""
    x = scale * lon * math.pi * EARTH_RADIUS / 180
    y = scale * EARTH_RADIUS * F.log(F.tan((90 + lat) * math.pi / 360))
    return x, y


def project(point: tuple[Column, Column, Column], matrix: list[float]) -> tuple[Column, Column, Column]:
    """Pixel column, pixel row (null at depth 0) and depth of a point under a row-major 3x4 matrix."""
    u, v, d = (matrix[4 * a] * point[0] + matrix[4 * a + 1] * point[1] + matrix[4 * a + 2] * point[2] + matrix[4 * a + 3] for a in range(3))
    return F.try_divide(u, d), F.try_divide(v, d), d


def in_view(x: Column, y: Column, matrix: list[float]) -> Column:
    """Whether the ground point (x, y, 0) is before the camera and in its extent."""
    u, v, d = project((x, y, F.lit(0.0)), matrix)
    return F.coalesce((d >= 0) & u.between(0, VIEW_WIDTH) & v.between(0, VIEW_HEIGHT), F.lit(False))
