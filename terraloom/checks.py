"""Checks of datasets: each is one aggregate row at most."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions import crs as C
from terraloom.functions.raster import Grid, valid, with_neighbours
from terraloom.model import FILE, Dataset, State, Verdict


def _of(name: str, ok: bool, message: str, otherwise: State = State.INVALID) -> Verdict:
    return Verdict(name, State.VALID if ok else otherwise, message)


def crs_valid(d: Dataset) -> Verdict:
    if not d.crs:
        return Verdict("crs_valid", State.INVALID, "no CRS")
    try:
        return Verdict("crs_valid", State.VALID, f"EPSG:{C.epsg(d.crs)}")
    except ValueError as e:
        return Verdict("crs_valid", State.INVALID, str(e))


def crs_matches_target(d: Dataset, target: str) -> Verdict:
    code = str(C.epsg(target))
    return _of("crs_matches_target", code in (d.crs or ""), f"{d.crs} for {target}")


def extent_sane(d: Dataset) -> Verdict:
    """Invalid without an area; a warning beyond degrees unless the CRS is known to be projected."""
    e = d.extent
    if e is None or not all(map(math.isfinite, e)):
        return Verdict("extent_sane", State.INVALID, "no extent")
    if e[0] >= e[2] or e[1] >= e[3]:
        return Verdict("extent_sane", State.INVALID, f"degenerate: {e}")
    geographic = d.crs is None or "4326" in d.crs
    far = e[0] < -180 or e[2] > 180 or e[1] < -90 or e[3] > 90
    return Verdict("extent_sane", State.WARN if geographic and far else State.VALID, str(e))


def backing_accessible(d: Dataset) -> Verdict:
    """Whether the files behind a dataset are there, by way of Spark's file systems."""
    if d.store != FILE:
        return Verdict("backing_accessible", State.WARN, f"{d.store} isn't read until it is used")
    spark = d.df.sparkSession if d.df is not None else None
    if spark is None:
        return Verdict("backing_accessible", State.INVALID, "no rows")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(d.uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return Verdict("backing_accessible", State.INVALID, f"{d.uri} doesn't exist")
    return _of("backing_accessible", fs.getContentSummary(path).getLength() > 0, d.uri, State.WARN)


def extent_within_input(out: Grid, source: Grid, tolerance: float = 1e-6) -> Verdict:
    a, b = out.extent, source.extent
    ok = a[0] >= b[0] - tolerance and a[1] >= b[1] - tolerance and a[2] <= b[2] + tolerance and a[3] <= b[3] + tolerance
    return _of("extent_within_input", ok, f"{a} in {b}")


def no_interior_pits(cells: DataFrame, grid: Grid, nodata: float | None = None) -> Verdict:
    near = with_neighbours(cells.withColumn("z", F.when(valid(F.col("value"), nodata), F.col("value"))), "z", diagonals=True)
    inner = F.col("row").between(1, grid.height - 2) & F.col("col").between(1, grid.width - 2)
    least = F.least("n", "s", "w", "e", "nw", "ne", "sw", "se")
    n = near.where(inner & (F.col("z") < least)).count()
    return _of("no_interior_pits", n == 0, f"{n} cells lie below all their neighbours")


def elevation_only_raised(before: DataFrame, after: DataFrame, tolerance: float = 1e-10) -> Verdict:
    keys = ["raster_id", "band", "row", "col"]
    both = before.select(*keys, F.col("value").alias("a")).join(after.select(*keys, F.col("value").alias("b")), keys)
    n = both.where(F.col("b") < F.col("a") - tolerance).count()
    return _of("elevation_only_raised", n == 0, f"{n} cells are lower")


def valid_range(cells: DataFrame, low: float, high: float, nodata: float | None = None) -> Verdict:
    n = cells.where(valid(F.col("value"), nodata) & ~F.col("value").between(low, high)).count()
    return _of("valid_range", n == 0, f"{n} cells outside {low} to {high}")


def nodata_preserved(before: DataFrame, after: DataFrame, nodata: float | None, output_nodata: float) -> Verdict:
    a = before.where(~valid(F.col("value"), nodata)).count()
    b = after.where(~valid(F.col("value"), output_nodata)).count()
    return _of("nodata_preserved", a == b, f"{a} before, {b} after", State.WARN)


def resolution_consistent(a: Grid, b: Grid) -> Verdict:
    ok = all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a.resolution, b.resolution, strict=True))
    return _of("resolution_consistent", ok, f"{a.resolution}, {b.resolution}")


def d8_checks(codes: DataFrame, grid: Grid, valid_cells: int) -> list[Verdict]:
    """valid_code_set, no_pits, no_internal_outlets and all_valid_assigned from one aggregate."""
    v = F.col("value")
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == grid.height - 1) | (F.col("col") == grid.width - 1)
    r = codes.agg(F.count(F.when(~v.between(-1, 9), 1)).alias("odd"), F.count(F.when(v == 9, 1)).alias("pits"), F.count(F.when((v == 8) & ~edge, 1)).alias("inside"), F.count(F.when(v >= 0, 1)).alias("given")).collect()[0]
    arrows = internal_outlets(codes)
    return [
        _of("valid_code_set", r["odd"] == 0, f"{r['odd']} other codes"),
        _of("no_pits", r["pits"] == 0, f"{r['pits']} pits", State.WARN),
        _of("no_internal_outlets", r["inside"] == 0 and arrows == 0, f"{r['inside']} outlets inside, {arrows} arrows into no data", State.WARN),
        _of("all_valid_assigned", r["given"] == valid_cells, f"{r['given']} of {valid_cells}"),
    ]


def internal_outlets(codes: DataFrame) -> int:
    """Cells whose direction points at a cell without one."""
    near = with_neighbours(codes, diagonals=True)
    to = F.element_at(F.array("e", "se", "s", "sw", "w", "nw", "n", "ne"), F.least(F.col("value"), F.lit(7.0)).cast("int") + 1)
    return near.where(F.col("value").between(0, 7)).where(to < 0).count()


def accumulation_checks(codes: DataFrame, acc: DataFrame, weight: float = 1.0) -> list[Verdict]:
    """nonnegative and conservation: what reaches outlets and pits is the weight of all valid cells."""
    keys = ["raster_id", "band", "row", "col"]
    both = codes.select(*keys, F.col("value").alias("code")).join(acc.select(*keys, F.col("value").alias("acc")), keys)
    r = both.agg(F.count(F.when(F.col("code") >= 0, 1)).alias("n"), F.sum(F.when(F.col("code") >= 8, F.col("acc"))).alias("out"), F.min(F.when(F.col("code") >= 0, F.col("acc"))).alias("least")).collect()[0]
    want = (r["n"] or 0) * weight
    return [
        Verdict("no_cycles", State.VALID, "accumulation came to an end"),
        _of("nonnegative", (r["least"] or 0) >= 0, f"least {r['least']}"),
        _of("conservation", abs((r["out"] or 0) - want) <= 1e-6 * max(1.0, want), f"{r['out']} of {want}"),
    ]


def row_count_matches(df: DataFrame, expected: int) -> Verdict:
    n = df.count()
    return _of("row_count_matches", n == expected, f"{n} of {expected}")


def schema_complete(df: DataFrame, names: tuple[str, ...]) -> Verdict:
    missing = [n for n in names if n not in df.columns]
    return _of("schema_complete", not missing, f"missing: {missing}")


def left_features_preserved(left: DataFrame, joined: DataFrame) -> Verdict:
    a, b = left.count(), joined.count()
    return _of("left_features_preserved", b >= a, f"{a} before, {b} after")


def schema_no_collision(left: DataFrame, right: DataFrame, geom: str = "geom") -> Verdict:
    both = sorted((set(left.columns) & set(right.columns)) - {geom})
    return _of("schema_no_collision", not both, f"renamed: {both}", State.WARN)


def dimensions_sane(grid: Grid, most: int = 100_000) -> Verdict:
    return _of("dimensions_sane", 0 < grid.width <= most and 0 < grid.height <= most, f"{grid.width} x {grid.height}")


def nodata_background(cells: DataFrame, nodata: float) -> Verdict:
    return _of("nodata_background", bool(cells.where(F.col("value") == nodata).take(1)), "cells without a feature", State.WARN)


def is_cog(tiled: DataFrame) -> Verdict:
    """Tiles and at least one overview."""
    return _of("is_cog", bool(tiled.where("level > 0").take(1)), "overviews")


def sigma0_checks(cells: DataFrame) -> list[Verdict]:
    r = cells.agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("some"), F.count(F.when(F.col("value") < 0, 1)).alias("low")).collect()[0]
    share = r["some"] / r["n"] if r["n"] else 0.0
    finite = State.INVALID if not r["some"] else State.VALID if share > 0.01 else State.WARN
    low = r["low"] / r["some"] if r["some"] else 0.0
    return [Verdict("sigma0_finite", finite, f"{share:.1%}"), Verdict("sigma0_nonnegative", State.VALID if low < 0.1 else State.WARN, f"{low:.1%} negative")]


def min_observations(mosaic: DataFrame, least: int = 1) -> Verdict:
    n = mosaic.where((F.col("mask") == 1) & (F.col("confidence") >= least)).count()
    return _of("min_observations", n > 0, f"{n} cells seen {least} times or more", State.WARN)


def gcp_count_sufficient(n: int, least: int = 16) -> Verdict:
    return _of("gcp_count_sufficient", n >= least, f"{n} control points", State.WARN)
