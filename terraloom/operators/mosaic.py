"""Water surface elevation from passes, overviews, radar calibration, and scatter to grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.raster import Grid, valid, with_neighbours
from terraloom.operators.warp import REACH, kernel
from terraloom.plans.session import cut

FILL_LIMIT = 1e20
RESAMPLING = ("nearest", "bilinear", "cubic", "average", "mode")


def finite(c: Column) -> Column:
    """c, or null where it isn't a finite number."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def block_mean(cells: DataFrame, grid: Grid, rows: int, cols: int) -> tuple[DataFrame, Grid]:
    """Means over blocks of cells, nulls left out; partial blocks at the end are left off. The extent stays."""
    h, w = grid.height // rows, grid.width // cols
    out = cells.where((F.col("row") < h * rows) & (F.col("col") < w * cols)).groupBy("raster_id", "band", F.floor(F.col("row") / rows).cast("int").alias("row"), F.floor(F.col("col") / cols).cast("int").alias("col")).agg(F.avg(finite(F.col("value"))).alias("value"))
    return out, Grid.from_bounds(*grid.extent, w, h, crs=grid.crs, nodata=grid.nodata, bands=grid.bands)


def sigma0(slc: DataFrame, xfactor: DataFrame, noise: DataFrame) -> DataFrame:
    """(row, col, value): (|slc|^2 - noise) / xfactor, null where any part of it is missing.

    slc has row, col, re, im; the others row, col, value. Parts of 1e20 or more, and those not
    finite, are missing; so is a whole line without any finite positive power, and a factor of
    zero. noise may be per line: without a column col, it counts for every column.
    """
    part = lambda c: F.when(F.abs(c) < FILL_LIMIT, finite(c))
    power = slc.select("row", "col", (F.pow(part(F.col("re").cast("double")), 2) + F.pow(part(F.col("im").cast("double")), 2)).alias("_power"))
    live = power.groupBy("row").agg(F.max(F.col("_power")).alias("_most")).where("_most > 0").select("row")
    x = xfactor.select("row", "col", part(F.col("value").cast("double")).alias("_x")).where("_x != 0")
    keys = ["row", "col"] if "col" in noise.columns else ["row"]
    n = noise.select(*keys, part(F.col("value").cast("double")).alias("_n"))
    joined = power.join(x, ["row", "col"], "left").join(n, keys, "left").join(live.withColumn("_live", F.lit(True)), "row", "left")
    return joined.select("row", "col", F.when(F.col("_live"), (F.col("_power") - F.col("_n")) / F.col("_x")).alias("value"))


def slc_calibrate(slc: DataFrame, xfactor: DataFrame, noise: DataFrame, grid: Grid, az_looks: int = 4, rg_looks: int = 4) -> tuple[DataFrame, Grid]:
    """Calibrated backscatter averaged over looks, and its grid over the whole extent of the input."""
    if az_looks < 1 or rg_looks < 1:
        raise ValueError("looks must be positive")
    cells = sigma0(slc, xfactor, noise).select(F.lit("0").alias("raster_id"), F.lit(1).alias("band"), "row", "col", "value")
    return block_mean(cells, grid, az_looks, rg_looks)


def multilook_complex(data: DataFrame, az_looks: int, rg_looks: int, height: int, width: int) -> DataFrame:
    """(row, col, re, im): complex means over blocks, missing parts left out."""
    h, w = height // az_looks, width // rg_looks
    kept = data.where((F.col("row") < h * az_looks) & (F.col("col") < w * rg_looks))
    re, im = finite(F.col("re").cast("double")), finite(F.col("im").cast("double"))
    both = re.isNotNull() & im.isNotNull()
    return kept.groupBy(F.floor(F.col("row") / az_looks).cast("int").alias("row"), F.floor(F.col("col") / rg_looks).cast("int").alias("col")).agg(F.avg(F.when(both, re)).alias("re"), F.avg(F.when(both, im)).alias("im"))


def normalize_interferogram(interf: DataFrame, plus: DataFrame, minus: DataFrame, az_looks: int, rg_looks: int, height: int, width: int) -> DataFrame:
    """(row, col, re, im): the multilooked interferogram over the root of both powers, of magnitude 1 at most."""
    top = multilook_complex(interf, az_looks, rg_looks, height, width)
    power = lambda d, name: multilook_complex(d.select("row", "col", (F.pow(F.col("re").cast("double"), 2) + F.pow(F.col("im").cast("double"), 2)).alias("re"), F.lit(0.0).alias("im")), az_looks, rg_looks, height, width).select("row", "col", F.col("re").alias(name))
    joined = top.join(power(plus, "_p"), ["row", "col"]).join(power(minus, "_m"), ["row", "col"])
    scale = F.sqrt(F.col("_p") * F.col("_m"))
    re, im = F.col("re") / F.when(scale > 0, scale), F.col("im") / F.when(scale > 0, scale)
    size = F.sqrt(re * re + im * im)
    return joined.select("row", "col", (re / F.greatest(size, F.lit(1.0))).alias("re"), (im / F.greatest(size, F.lit(1.0))).alias("im"))


def regrid(cells: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(..., row, col, value) on a grid of the target's (height, width): row i is source row floor(i * source / target)."""
    if source == target:
        return cells
    (h, w), (th, tw) = source, target
    span = lambda i, n, t: F.sequence(F.ceil(i * t / n).cast("int"), F.ceil((i + 1) * t / n).cast("int") - 1)
    some = lambda i, n, t: F.when(F.ceil((i + 1) * t / n) > F.ceil(i * t / n), span(i, n, t)).otherwise(F.array().cast("array<int>"))
    out = cells.withColumn("_r", F.explode(some(F.col("row"), h, th))).withColumn("_c", F.explode(some(F.col("col"), w, tw)))
    return out.withColumns({"row": F.col("_r"), "col": F.col("_c")}).drop("_r", "_c")


def water_elevation_mosaic(frequency: DataFrame, passes: DataFrame, grid: Grid, pass_size: tuple[int, int] | None = None, threshold: float = 0.3, aggregation: str = "median", height_band: int = 2, fof_band: int = 1, max_rounds: int | None = None) -> tuple[DataFrame, Grid]:
    """(row, col, wse, confidence, mask): elevations over water, holes filled from their sides.

    frequency: cells of how often a place is water; it is water from the threshold up. passes:
    cells with raster_id for the pass; band 2 is the height. confidence is how many passes have
    a finite height. Then, in rounds, water cells without a height get the mean of the
    neighbours that have one, all at once, until none is left to fill.
    """
    if aggregation not in ("median", "mean", "max"):
        raise ValueError("aggregation must be median, mean or max")
    size = (grid.height, grid.width)
    mask = frequency.where(F.col("band") == fof_band).select("row", "col", (F.coalesce(finite(F.col("value")), F.lit(-1.0)) >= threshold).alias("mask"))
    heights = regrid(passes.where(F.col("band") == height_band), pass_size or size, size)
    v = finite(F.col("value"))
    f = {"median": F.median, "mean": F.avg, "max": F.max}[aggregation]
    seen = heights.groupBy("row", "col").agg(f(v).alias("wse"), F.count(v).cast("int").alias("confidence"))
    now = mask.join(seen, ["row", "col"], "left").select(F.lit("0").alias("raster_id"), F.lit(1).alias("band"), "row", "col", "mask", F.when(F.col("mask"), F.col("wse")).alias("wse"), F.when(F.col("mask"), F.coalesce("confidence", F.lit(0))).otherwise(0).alias("confidence"))
    now = cut(now)
    left = None
    for _ in range(max_rounds if max_rounds is not None else max(size)):
        todo = now.where(F.col("mask") & F.col("wse").isNull()).count()
        if todo in (0, left):
            break
        left = todo
        near = with_neighbours(now, "wse")
        sides = F.array_compact(F.array("n", "s", "w", "e"))
        mean = F.aggregate(sides, F.lit(0.0), lambda a, x: a + x) / F.size(sides)
        now = near.withColumn("wse", F.when(F.col("mask") & F.col("wse").isNull() & (F.size(sides) > 0), mean).otherwise(F.col("wse"))).drop("n", "s", "w", "e")
        now = cut(now)
    return now.select("row", "col", "wse", "confidence", F.col("mask").cast("int").alias("mask")), Grid.from_bounds(*grid.extent, grid.width, grid.height, crs="EPSG:4326", bands=3)


def overview_factors(height: int, width: int, blocksize: int) -> list[int]:
    """2, 4, 8, ... while the shorter side over the factor is a block or more; [2] if only the side itself is."""
    out, f = [], 2
    while min(height, width) // f >= blocksize:
        out.append(f)
        f *= 2
    return out or ([2] if min(height, width) > blocksize else [])


def overview(cells: DataFrame, factor: int, resampling: str = "nearest") -> DataFrame:
    """Cells at a coarser level: the first (north-west) cell, the mean, or the most common value (least of ties).

    bilinear and cubic are means weighted by the kernel, stretched by the factor: cells up to one
    or two coarser cells away from a coarser cell's centre count, those that have a value.
    """
    if resampling not in RESAMPLING:
        raise ValueError(f"resampling must be one of {RESAMPLING}")
    v, down = F.col("value"), lambda c: F.floor(F.col(c) / factor).cast("int")
    keys = ["raster_id", "band", down("row").alias("row"), down("col").alias("col")]
    if resampling == "mode":
        counted = cells.where(v.isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy("raster_id", "band", "row", "col").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    if resampling in ("nearest", "average"):
        out = F.min_by("value", F.struct("at_row", "at_col")) if resampling == "nearest" else F.avg(v)
        return cells.withColumn("at_row", F.col("row")).withColumn("at_col", F.col("col")).groupBy(*keys).agg(out.alias("value"))
    reach = REACH[resampling]
    spread = cells.select("raster_id", "band", "value", F.col("row").alias("r"), F.col("col").alias("c"))
    for name, at in (("row", "r"), ("col", "c")):
        spread = spread.withColumn(name, F.explode(F.sequence(down(at) - reach, down(at) + reach)))
    weight = kernel(resampling, (F.col("r") + 0.5) / factor - (F.col("row") + 0.5)) * kernel(resampling, (F.col("c") + 0.5) / factor - (F.col("col") + 0.5))
    # Coarser cells are those that hold a cell; a place beyond the edge gets weight but is none of them.
    own = F.max((F.col("row") == down("r")) & (F.col("col") == down("c")))
    sums = spread.withColumn("w", weight).where("w != 0").groupBy("raster_id", "band", "row", "col").agg(F.sum(v * F.col("w")).alias("total"), F.sum(F.when(v.isNotNull(), F.col("w"))).alias("weights"), own.alias("own"))
    return sums.where("own").select("raster_id", "band", "row", "col", F.when(F.abs("weights") > 1e-12, F.col("total") / F.col("weights")).alias("value"))


def tiles(cells: DataFrame, blocksize: int = 256) -> DataFrame:
    """(raster_id, band, trow, tcol, h, w, data): square tiles, data row by row, nulls where cells are missing."""
    at = cells.withColumn("trow", F.floor(F.col("row") / blocksize).cast("int")).withColumn("tcol", F.floor(F.col("col") / blocksize).cast("int"))
    cell = F.struct(F.col("row"), F.col("col"), F.col("value"))
    made = at.groupBy("raster_id", "band", "trow", "tcol").agg(F.array_sort(F.collect_list(cell)).alias("_x"), F.max(F.col("row") % blocksize + 1).cast("int").alias("h"), F.max(F.col("col") % blocksize + 1).cast("int").alias("w"))
    return made.select("raster_id", "band", "trow", "tcol", "h", "w", F.transform("_x", lambda s: s["value"]).alias("data"))


def build_cog(cells: DataFrame, grid: Grid, blocksize: int = 256, overview_resampling: str = "nearest") -> DataFrame:
    """Tiles of the raster (level 0) and of each overview (level is its factor), ready to be written by level."""
    if blocksize < 16 or blocksize % 16:
        raise ValueError("blocksize must be a multiple of 16")
    out = tiles(cells, blocksize).withColumn("level", F.lit(0))
    for f in overview_factors(grid.height, grid.width, blocksize):
        out = out.unionByName(tiles(overview(cells, f, overview_resampling), blocksize).withColumn("level", F.lit(f)))
    return out


def write_cog(tiled: DataFrame, path: str, compress: str = "deflate") -> None:
    """Tiles as Parquet by level, so that a reader of one level touches no other."""
    codec = {"deflate": "gzip", "lz4": "lz4_raw", "zstd": "zstd", "lzw": "snappy", "none": "uncompressed"}[compress]
    tiled.write.mode("overwrite").option("compression", codec).partitionBy("level").parquet(path)


def untile(tiled: DataFrame, blocksize: int = 256) -> DataFrame:
    """Cells from tiles."""
    out = tiled.select("raster_id", "band", "trow", "tcol", "w", F.posexplode("data").alias("_i", "value"))
    return out.select("raster_id", "band", (F.col("trow") * blocksize + F.floor(F.col("_i") / F.col("w"))).cast("int").alias("row"), (F.col("tcol") * blocksize + F.col("_i") % F.col("w")).cast("int").alias("col"), "value")


def scatter(points: DataFrame, grid: Grid, x: str, y: str, values: tuple[str, ...], order: str) -> DataFrame:
    """Cells of a grid from points, a band per value: of points in a cell the last by `order` wins.

    Cells are truncated towards zero and clipped to the grid, so points outside fall on its edge.
    """
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c.cast("int")))
    keyed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(clip(grid.row(F.col(y)), grid.height).alias("row"), clip(grid.column(F.col(x)), grid.width).alias("col"), F.col(order).alias("_o"), F.struct(*values).alias("_v"))
    last = keyed.groupBy("row", "col").agg(F.max_by("_v", "_o").alias("_v"))
    bands = F.array(*[F.struct(F.lit(i + 1).alias("band"), F.col(f"_v.{v}").cast("double").alias("value")) for i, v in enumerate(values)])
    return last.select(F.lit("0").alias("raster_id"), "row", "col", F.inline(bands)).select("raster_id", "band", "row", "col", "value")


def mask_valid(cells: DataFrame, nodata: float | None) -> DataFrame:
    """Cells with no-data values made null."""
    return cells.withColumn("value", F.when(valid(F.col("value"), nodata), F.col("value")))
