"""Index algebra of voxel grids as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """Cells in x, y, z and their edge in metres."""

    n0: int = 167
    n1: int = 167
    n2: int = 14
    res: float = 0.3

    @property
    def dims(self) -> tuple[int, int, int]:
        return self.n0, self.n1, self.n2

    def coarser(self) -> GridSpec:
        """The next level of a multi-resolution grid."""
        return GridSpec(-(-self.n0 // 2), -(-self.n1 // 2), -(-self.n2 // 2), 2 * self.res)

    def inside(self, i: Column, j: Column, k: Column | None = None) -> Column:
        ok = i.between(0, self.n0 - 1) & j.between(0, self.n1 - 1)
        return ok if k is None else ok & k.between(0, self.n2 - 1)

    def key(self, i: Column, j: Column, k: Column) -> Column:
        """One long for a cell inside the grid, -1 outside."""
        at = (i.cast("long") * self.n1 + j) * self.n2 + k
        return F.when(self.inside(i, j, k), at).otherwise(F.lit(-1).cast("long"))

    def ijk(self, key: str = "key") -> list[Column]:
        """Columns i, j, k of a key."""
        return [
            F.expr(f"CAST({key} div {self.n1 * self.n2} AS INT)").alias("i"),
            F.expr(f"CAST({key} div {self.n2} % {self.n1} AS INT)").alias("j"),
            F.expr(f"CAST({key} % {self.n2} AS INT)").alias("k"),
        ]

    def metres(self, index: Column, axis: int) -> Column:
        """Of a cell's centre."""
        return (index - self.dims[axis] // 2) * F.lit(self.res)

    def nearest(self, metres: Column, axis: int) -> Column:
        """The cell of a place, halves away from zero."""
        return F.round(metres / self.res).cast("int") + self.dims[axis] // 2

    def endpoint(self, metres: Column, axis: int) -> Column:
        """The cell of a ray's end, halves to even."""
        return F.rint(metres / self.res).cast("int") + self.dims[axis] // 2
