"""Majority filter of class rasters, and lookups into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldgrid.plans.grid import Grid


def majority_filter(pixels: DataFrame, grid: Grid, size: int = 3, label: str = "label", tile: int = 256) -> DataFrame:
    """pixels(prow, pcol, label) -> prow, pcol, label: the most frequent class of a size x size window.

    NoData neighbours don't count and NoData centres stay out; beyond the border the border cells repeat; ties go to
    the centre's class if it is among the winners, else to the least.

    Pixels are dealt by tile, those near a border also to the neighbour (the halo), which moves each pixel about once.
    Within a tile a pixel gives its class to the centres around it; a border cell counts as often as it is repeated.
    All aggregates are keyed by the tile first, so they need no further exchange."""
    if size < 1 or size % 2 == 0:
        raise ValueError("the window size must be odd and positive")
    k = size // 2
    last_row, last_col = grid.height - 1, grid.width - 1
    pixels = pixels.select("prow", "pcol", F.col(label).alias("v")).filter(F.col("v").isNotNull())

    def tiles(c: Column, last: int) -> Column:
        return F.sequence(F.floor(F.greatest(c - k, F.lit(0)) / tile), F.floor(F.least(c + k, F.lit(last)) / tile))

    dealt = pixels.withColumn("tr", F.explode(tiles(F.col("prow"), last_row))).withColumn("tc", F.explode(tiles(F.col("pcol"), last_col))).repartition("tr", "tc")

    def centres(c: Column, t: Column, last: int) -> Column:
        low = F.greatest(c - k, t * tile, F.lit(0))
        high = F.least(c + k, t * tile + tile - 1, F.lit(last))
        return F.sequence(low.cast("int"), high.cast("int"))

    def times(c: Column, at: Column, last: int) -> Column:
        """How many cells of the window around ``at`` show c: 1, or more where c is a repeated border cell."""
        below = F.when(c == 0, F.greatest(F.lit(k) - at, F.lit(0))).otherwise(F.lit(0))
        above = F.when(c == last, F.greatest(F.lit(k) - (F.lit(last) - at), F.lit(0))).otherwise(F.lit(0))
        return F.lit(1) + below + above

    given = dealt.withColumn("r", F.explode(centres(F.col("prow"), F.col("tr"), last_row))).withColumn("c", F.explode(centres(F.col("pcol"), F.col("tc"), last_col)))
    weight = times(F.col("prow"), F.col("r"), last_row) * times(F.col("pcol"), F.col("c"), last_col)
    own = (F.col("r") == F.col("prow")) & (F.col("c") == F.col("pcol"))
    votes = given.withColumn("w", weight).withColumn("own", own).groupBy("tr", "tc", "r", "c", "v").agg(F.sum("w").alias("n"), F.max("own").alias("own"))
    won = votes.groupBy("tr", "tc", "r", "c").agg(F.max_by("v", F.struct("n", "own", -F.col("v"))).alias("best"), F.max("own").alias("valid"))
    return won.filter("valid").select(F.col("r").alias("prow"), F.col("c").alias("pcol"), F.col("best").alias(label))


def lookup(points: DataFrame, raster: DataFrame, grid: Grid, label: str = "label") -> DataFrame:
    """points(x, y, ...) with the raster's class at their pixel; NULL on NoData or off the grid."""
    placed = points.withColumn("prow", grid.row(F.col("y"))).withColumn("pcol", grid.col(F.col("x")))
    return placed.join(raster.select("prow", "pcol", F.col(label).alias("found")), ["prow", "pcol"], "left")


def halo(row0: int, col0: int, height: int, width: int, grid: Grid, reach: int) -> tuple[int, int, int, int]:
    """The window grown by ``reach`` on each side, within the grid: (row0, col0, height, width)."""
    r0, c0 = max(row0 - reach, 0), max(col0 - reach, 0)
    r1, c1 = min(row0 + height + reach, grid.height), min(col0 + width + reach, grid.width)
    return r0, c0, r1 - r0, c1 - c0
