"""The grid contract: how cells lie in the plane, and whether two grids agree."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A north-up grid of square cells; rows count from the top, columns from the left."""

    xmin: float
    ymax: float
    res: float
    width: int
    height: int

    def __post_init__(self):
        if not all(map(math.isfinite, (self.xmin, self.ymax, self.res))) or self.res <= 0 or self.width < 1 or self.height < 1:
            raise ValueError(f"not a grid: {self}")

    @property
    def xmax(self) -> float:
        return self.xmin + self.width * self.res

    @property
    def ymin(self) -> float:
        return self.ymax - self.height * self.res

    @classmethod
    def covering(cls, xmin: float, xmax: float, ymin: float, ymax: float, res: float) -> Grid:
        """The canonical grid of an extent: anchored at its upper left corner, cell counts rounded half up, one at least."""
        if not (xmax > xmin and ymax > ymin and res > 0):
            raise ValueError("an extent needs a width, a height and a resolution")
        count = lambda span: max(1, math.floor(span / res + 0.5))
        return cls(xmin, ymax, res, count(xmax - xmin), count(ymax - ymin))

    def x(self, col: str) -> Column:
        """Easting of a column's centre."""
        return F.lit(self.xmin) + (F.col(col) + 0.5) * self.res

    def y(self, row: str) -> Column:
        return F.lit(self.ymax) - (F.col(row) + 0.5) * self.res

    def col(self, x: str) -> Column:
        return F.floor((F.col(x) - self.xmin) / self.res)

    def row(self, y: str) -> Column:
        return F.floor((F.lit(self.ymax) - F.col(y)) / self.res)

    def inside(self, row: str, col: str) -> Column:
        return F.col(row).between(0, self.height - 1) & F.col(col).between(0, self.width - 1)

    def cells(self, spark: SparkSession) -> DataFrame:
        """All (r, c) of the grid, made on the executors."""
        return spark.range(self.width * self.height).select(F.expr(f"id DIV {self.width}").alias("r"), (F.col("id") % self.width).alias("c"))

    def window(self, xmin: float, xmax: float, ymin: float, ymax: float) -> tuple[int, int, int, int]:
        """First and last row and column of the cells that a box touches, inside the grid."""
        clip = lambda v, n: min(max(v, 0), n)
        r0, r1 = clip(math.floor((self.ymax - ymax) / self.res), self.height), clip(math.ceil((self.ymax - ymin) / self.res), self.height)
        c0, c1 = clip(math.floor((xmin - self.xmin) / self.res), self.width), clip(math.ceil((xmax - self.xmin) / self.res), self.width)
        return r0, r1 - 1, c0, c1 - 1

    def mismatches(self, other: Grid, extent_tol: float | None = None, res_tol: float | None = None) -> list[str]:
        """Names of the fields in which two grids differ; sizes exactly, extents and resolution within tolerances."""
        extent_tol = self.res * 1e-6 if extent_tol is None else extent_tol
        res_tol = self.res * 1e-9 if res_tol is None else res_tol
        if extent_tol >= self.res * 0.01:
            raise ValueError("a tolerance has to be under a hundredth of a cell")
        out = [k for k in ("width", "height") if getattr(self, k) != getattr(other, k)]
        out += [k for k in ("xmin", "xmax", "ymin", "ymax") if abs(getattr(self, k) - getattr(other, k)) > extent_tol]
        return out + ["resolution"] * (abs(self.res - other.res) > res_tol)
