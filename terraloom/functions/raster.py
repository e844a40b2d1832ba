"""Rasters as cells: (raster_id, band, row, col, value), row 0 in the north, null for no data."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Edge of the square tiles that neighbourhoods are dealt by.
TILE = 256


@dataclass(frozen=True)
class Grid:
    """Where cells lie: size, affine transform (x = a*col + b*row + c, y = d*col + e*row + f), CRS, no-data value."""

    width: int
    height: int
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f: float = 0.0
    crs: str | None = None
    nodata: float | None = None
    bands: int = 1

    @classmethod
    def from_bounds(cls, xmin: float, ymin: float, xmax: float, ymax: float, width: int, height: int, **kw: object) -> Grid:
        return cls(width, height, a=(xmax - xmin) / width, c=xmin, e=-(ymax - ymin) / height, f=ymax, **kw)

    @property
    def extent(self) -> tuple[float, float, float, float]:
        x, y = self.c + self.a * self.width, self.f + self.e * self.height
        return min(self.c, x), min(self.f, y), max(self.c, x), max(self.f, y)

    @property
    def resolution(self) -> tuple[float, float]:
        return abs(self.a), abs(self.e)

    def x(self, col: Column, row: Column | None = None) -> Column:
        """The x of a cell's centre."""
        out = F.lit(self.c) + self.a * (col + 0.5)
        return out if row is None or not self.b else out + self.b * (row + 0.5)

    def y(self, row: Column, col: Column | None = None) -> Column:
        out = F.lit(self.f) + self.e * (row + 0.5)
        return out if col is None or not self.d else out + self.d * (col + 0.5)

    def column(self, x: Column) -> Column:
        """The fractional column of an x; its floor is the cell's."""
        return (x - self.c) / self.a

    def row(self, y: Column) -> Column:
        return (y - self.f) / self.e

    def window(self, xmin: float, ymin: float, xmax: float, ymax: float) -> tuple[int, int, int, int]:
        """(first row, first col, rows, cols) of the cells whose centres are inside, clipped to the grid."""
        c0, c1 = sorted(((xmin - self.c) / self.a, (xmax - self.c) / self.a))
        r0, r1 = sorted(((ymin - self.f) / self.e, (ymax - self.f) / self.e))
        first = max(0, math.ceil(r0 - 0.5)), max(0, math.ceil(c0 - 0.5))
        last = min(self.height, math.ceil(r1 - 0.5)), min(self.width, math.ceil(c1 - 0.5))
        return *first, max(0, last[0] - first[0]), max(0, last[1] - first[1])

    def cut(self, row: int, col: int, rows: int, cols: int) -> Grid:
        return replace(self, width=cols, height=rows, c=self.c + self.a * col + self.b * row, f=self.f + self.e * row + self.d * col)


def cells_from(df: DataFrame, row: Column, col: Column, value: Column, raster_id: Column | None = None, band: Column | None = None) -> DataFrame:
    return df.select((F.lit("0") if raster_id is None else raster_id).cast("string").alias("raster_id"), (F.lit(1) if band is None else band).cast("int").alias("band"), row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("double").alias("value"))


def full_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """(row, col) for every cell of a grid; nothing is held on the driver."""
    n = F.col("id")
    return spark.range(grid.width * grid.height).select(F.floor(n / grid.width).cast("int").alias("row"), (n % grid.width).cast("int").alias("col"))


def valid(value: Column, nodata: float | None) -> Column:
    """Neither null, nor not-a-number, nor the no-data value."""
    ok = value.isNotNull() & ~F.isnan(value)
    return ok if nodata is None else ok & (value != F.lit(float(nodata)))


def with_neighbours(cells: DataFrame, value: str = "value", names: tuple[str, ...] = ("n", "s", "w", "e"), tile: int = TILE, diagonals: bool = False) -> DataFrame:
    """cells plus the values beside each: n, s, w, e, and with diagonals nw, ne, sw, se.

    One shuffle: cells are dealt by tile with a margin of one cell, and both orders of windows
    are kept inside a tile. Nulls stand for cells that are null or not there.
    """
    r, c = F.col("row"), F.col("col")
    tr, tc = F.floor(r / tile).cast("int"), F.floor(c / tile).cast("int")
    near = lambda x, t: F.array_distinct(F.array(t, F.floor((x - 1) / tile).cast("int"), F.floor((x + 1) / tile).cast("int")))
    dealt = cells.withColumn("_tr", F.explode(near(r, tr))).withColumn("_tc", F.explode(near(c, tc)))
    keys = ["raster_id", "band", "_tr", "_tc"]
    dealt = dealt.repartition(*keys)
    across = Window.partitionBy(*keys, "row").orderBy("col")
    down = Window.partitionBy(*keys, "col").orderBy("row")

    def beside(name: str, over: Column, axis: str, step: int) -> Column:
        f = F.lag if step < 0 else F.lead
        return F.when(f(axis).over(over) == F.col(axis) + step, f(name).over(over))

    out = dealt.withColumns({names[2]: beside(value, across, "col", -1), names[3]: beside(value, across, "col", 1)})
    more = {names[0]: beside(value, down, "row", -1), names[1]: beside(value, down, "row", 1)}
    if diagonals:
        more |= {"nw": beside(names[2], down, "row", -1), "ne": beside(names[3], down, "row", -1), "sw": beside(names[2], down, "row", 1), "se": beside(names[3], down, "row", 1)}
    return out.withColumns(more).where((F.col("_tr") == tr) & (F.col("_tc") == tc)).drop("_tr", "_tc")
