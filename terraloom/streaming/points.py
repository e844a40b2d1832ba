"""Point streams to cells: the latest value of each cell, and counts by window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions.raster import Grid


def latest_cells(points: DataFrame, grid: Grid, value: str, at: str, x: str = "x", y: str = "y") -> DataFrame:
    """(row, col, value, at) of the point that is last by time in each cell; for output mode update or complete.

    Points outside the grid and without coordinates are left out. State is one row per cell.
    """
    keyed = points.select(F.floor(grid.row(F.col(y))).cast("int").alias("row"), F.floor(grid.column(F.col(x))).cast("int").alias("col"), F.col(value).alias("value"), F.col(at).alias("at"))
    inside = keyed.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    return inside.groupBy("row", "col").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def passes(points: DataFrame, grid: Grid, value: str, at: str, window: str = "1 hour", late: str = "10 minutes", x: str = "x", y: str = "y") -> DataFrame:
    """(window, row, col, value, confidence): mean and count by cell and window of time, as passes of a mosaic.

    Windows are final once the watermark has passed them, in append mode; later points are dropped.
    """
    keyed = points.withWatermark(at, late).select(F.window(at, window).alias("window"), F.floor(grid.row(F.col(y))).cast("int").alias("row"), F.floor(grid.column(F.col(x))).cast("int").alias("col"), F.col(value).alias("value"))
    inside = keyed.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    return inside.groupBy("window", "row", "col").agg(F.avg("value").alias("value"), F.count("value").alias("confidence"))
