"""Slope, aspect and hillshade: column expressions over each cell's neighbours.

Gradients are central differences, one-sided at the edges of the grid and zero along an axis of
one cell. Slope and aspect take no-data values as they are into gradients and mask no-data
cells afterwards; hillshade takes them as missing, so a cell beside one is no data too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.raster import Grid, valid, with_neighbours

UNITS = ("degrees", "percent", "radians", "m_m")


def _check(grid: Grid) -> None:
    if grid.width == 1 and grid.height == 1:
        raise ValueError("a gradient needs two cells")
    if not grid.a or not grid.e:
        raise ValueError("cell size is zero")


def _gradient(grid: Grid) -> tuple[Column, Column]:
    """(dz/dx, dz/dy) of column _z, by columns to the east and rows to the south."""
    dx, dy = grid.resolution
    z, row, col = F.col("_z"), F.col("row"), F.col("col")
    along = lambda lo, hi, at, n, d: F.lit(0.0) if n == 1 else F.when(at == 0, (hi - z) / d).when(at == n - 1, (z - lo) / d).otherwise((hi - lo) / (2 * d))
    return along(F.col("w"), F.col("e"), col, grid.width, dx), along(F.col("n"), F.col("s"), row, grid.height, dy)


def _raw(cells: DataFrame, nodata: float | None) -> DataFrame:
    return cells.withColumn("_z", F.coalesce("value", F.lit(math.nan if nodata is None else float(nodata))))


def _masked(cells: DataFrame, nodata: float | None, out: Column, output_nodata: float) -> DataFrame:
    return cells.select("raster_id", "band", "row", "col", F.when(valid(F.col("_z"), nodata), out).otherwise(F.lit(float(output_nodata))).alias("value"))


def slope(cells: DataFrame, grid: Grid, units: str = "degrees", nodata: float | None = None, output_nodata: float = -9999.0) -> DataFrame:
    """Steepness in degrees, percent, radians or metres per metre."""
    if units not in UNITS:
        raise ValueError(f"units must be one of {UNITS}")
    _check(grid)
    nodata = grid.nodata if nodata is None else nodata
    gx, gy = _gradient(grid)
    tan = F.sqrt(gx * gx + gy * gy)
    out = {"degrees": F.degrees(F.atan(tan)), "percent": tan * 100, "radians": F.atan(tan), "m_m": tan}[units]
    return _masked(with_neighbours(_raw(cells, nodata), "_z"), nodata, out, output_nodata)


def aspect(cells: DataFrame, grid: Grid, nodata: float | None = None, output_nodata: float = -9999.0, flat_value: float = -1.0, convention: str = "compass") -> DataFrame:
    """The direction a cell faces, in degrees: compass (clockwise from north) or math (counter-clockwise from east)."""
    if convention not in ("compass", "math"):
        raise ValueError("convention must be compass or math")
    _check(grid)
    nodata = grid.nodata if nodata is None else nodata
    gx, gy = _gradient(grid)
    angle = F.degrees(F.atan2(gy, -gx))
    angle = F.when(angle < 0, angle + 360).otherwise(angle)
    if convention == "compass":
        angle = F.lit(90.0) - angle
        angle = F.when(angle < 0, angle + 360).otherwise(angle)
        angle = F.when(angle >= 360, angle - 360).otherwise(angle)
    out = F.when(F.sqrt(gx * gx + gy * gy) == 0, F.lit(float(flat_value))).otherwise(angle)
    return _masked(with_neighbours(_raw(cells, nodata), "_z"), nodata, out, output_nodata)


def hillshade(cells: DataFrame, grid: Grid, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0, nodata: float | None = None, output_nodata: float = 0.0, scaled: bool = False) -> DataFrame:
    """Light on the surface, 0 to 255 (whole numbers), or 0 to 1 if scaled."""
    if not (0 <= azimuth <= 360 and 0 <= altitude <= 90 and z_factor > 0):
        raise ValueError("azimuth must be 0 to 360, altitude 0 to 90, z_factor positive")
    if not scaled and (output_nodata != int(output_nodata) or not 0 <= output_nodata <= 255):
        raise ValueError("output_nodata must be a whole number from 0 to 255 unless scaled")
    _check(grid)
    nodata = grid.nodata if nodata is None else nodata
    known = cells.withColumn("_z", F.when(valid(F.col("value"), nodata), F.col("value") * z_factor))
    gx, gy = _gradient(grid)
    steep, facing = F.atan(F.sqrt(gx * gx + gy * gy)), F.atan2(gy, -gx)
    zenith, to = math.radians(90 - altitude), math.radians(90 - azimuth)
    light = math.cos(zenith) * F.cos(steep) + math.sin(zenith) * F.sin(steep) * F.cos(F.lit(to) - facing)
    light = F.greatest(F.lit(0.0), F.least(F.lit(1.0), light))
    light = light if scaled else F.floor(light * 255).cast("double")
    gone = F.col("_z").isNull() | gx.isNull() | gy.isNull()
    return with_neighbours(known, "_z").select("raster_id", "band", "row", "col", F.when(gone, F.lit(float(output_nodata))).otherwise(light).alias("value"))
