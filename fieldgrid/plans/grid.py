"""Raster grids: affine arithmetic as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class CrsError(ValueError):
    """A coordinate reference system is missing or geographic."""


@dataclass(frozen=True)
class Grid:
    """A north-up grid. (x0, y0) is the upper left corner; NoData is NULL inside the engine and ``nodata`` in files."""

    x0: float
    y0: float
    res: float
    width: int
    height: int
    srid: int | None = None
    nodata: float = -9999.0

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.y0) - y) / self.res).cast("int")

    def col(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.x0)) / self.res).cast("int")

    def center_x(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + 0.5) * self.res

    def center_y(self, row: Column) -> Column:
        return F.lit(self.y0) - (row + 0.5) * self.res

    def holds(self, row: Column, col: Column) -> Column:
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)

    def tile(self, row: Column, col: Column, size: int = 256) -> Column:
        """Key for partitioning and pruning."""
        return F.struct(F.floor(row / size).cast("int").alias("tr"), F.floor(col / size).cast("int").alias("tc"))

    def bounds(self) -> tuple[float, float, float, float]:
        return self.x0, self.y0 - self.height * self.res, self.x0 + self.width * self.res, self.y0

    def with_resolution(self, res: float) -> Grid:
        """The same corner at another pixel size, large enough to cover this grid."""
        return Grid(self.x0, self.y0, res, -int(-self.width * self.res // res), -int(-self.height * self.res // res), self.srid, self.nodata)

    @classmethod
    def covering(cls, bounds: tuple[float, float, float, float], res: float, srid: int | None = None, nodata: float = -9999.0) -> Grid:
        """The grid whose corners are multiples of the resolution and that covers the bounds."""
        x0, y0 = bounds[0] // res * res, -(-bounds[3] // res) * res
        return cls(x0, y0, res, int(-((x0 - bounds[2]) // res)), int(-((bounds[1] - y0) // res)), srid, nodata)


def is_geographic(srid: int) -> bool:
    """The common longitude/latitude systems."""
    return srid in {4326, 4258, 4269, 4267, 4283, 4674, 4979}


def require_projected(srid: int | None) -> int:
    if srid is None:
        raise CrsError("a coordinate reference system is needed")
    if is_geographic(srid):
        raise CrsError(f"EPSG:{srid} is geographic; distances need a projected system")
    return srid
