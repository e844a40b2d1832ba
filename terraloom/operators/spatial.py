"""Joins of geometries with cells and with each other, by buckets of a grid.

A geometry is written to each bucket that its box meets, a cell or a point to its one bucket,
and the two are joined on the bucket, then tested exactly. The side of geometries is broadcast
only where its counted rows are few; otherwise both sides are shuffled by bucket, which
adaptive execution splits where one is crowded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions import geometry as G
from terraloom.functions.raster import Grid, full_grid, valid

#: A side is broadcast up to so many rows that take up to so many bytes as JSON.
BROADCAST_ROWS, BROADCAST_BYTES = 10_000, 16 << 20
#: Cells along the edge of a bucket.
BUCKET = 64
STATISTICS = ("count", "sum", "mean", "min", "max", "std")


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows of at most `most` bytes; measuring stops at the limit."""
    n, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).collect()[0]
    return F.broadcast(df) if n <= limit and size <= most else df


def _cell_buckets(zones: DataFrame, grid: Grid, geom: str = "geom", bucket: int = BUCKET) -> DataFrame:
    """zones with one row per bucket of cells that their boxes meet, as columns _br and _bc."""
    b = G.bbox(F.col(geom))
    c0, c1 = grid.column(b["xmin"]), grid.column(b["xmax"])
    r0, r1 = grid.row(b["ymax"]), grid.row(b["ymin"])
    span = lambda lo, hi, n: F.sequence(F.greatest(F.lit(0), F.floor(F.least(lo, hi) / bucket)).cast("int"), F.least(F.lit((n - 1) // bucket), F.floor(F.greatest(lo, hi) / bucket)).cast("int"))
    inside = (F.greatest(c0, c1) >= 0) & (F.least(c0, c1) <= grid.width) & (F.greatest(r0, r1) >= 0) & (F.least(r0, r1) <= grid.height)
    # Boxes that end before the grid begins would give a falling sequence.
    kept = zones.where(~G.is_empty(F.col(geom))).where(inside & (F.least(c0, c1) < grid.width) & (F.least(r0, r1) < grid.height))
    return kept.withColumn("_br", F.explode(span(r0, r1, grid.height))).withColumn("_bc", F.explode(span(c0, c1, grid.width)))


def cells_in(cells: DataFrame, zones: DataFrame, grid: Grid, geom: str = "geom") -> DataFrame:
    """Cells with the zones whose geometry holds the cell's centre; one row for each pair."""
    keyed = cells.withColumn("_br", F.floor(F.col("row") / BUCKET).cast("int")).withColumn("_bc", F.floor(F.col("col") / BUCKET).cast("int"))
    x, y = grid.x(F.col("col"), F.col("row")), grid.y(F.col("row"), F.col("col"))
    b = F.col("_box")
    # Boxes are a cheap test before the exact one; edges that a box has on its right or at its bottom are left to that.
    near = (x >= b["xmin"]) & (x <= b["xmax"]) & (y >= b["ymin"]) & (y <= b["ymax"])
    pairs = keyed.join(small(_cell_buckets(zones.withColumn("_box", G.bbox(F.col(geom))), grid, geom)), ["_br", "_bc"])
    return pairs.where(F.when(near, G.covers_place(F.col(geom), x, y)).otherwise(F.lit(False))).drop("_br", "_bc", "_box")


def zonal_stats(cells: DataFrame, zones: DataFrame, grid: Grid, band: int = 1, zone_id_field: str | None = None, nodata: float | None = None, by_raster: bool = False) -> DataFrame:
    """(fid, zone_id, count, sum, mean, min, max, std) for each zone, std of the population.

    Zones without a valid cell have not-a-number everywhere, count included. zones has fid and
    geom; zone_id is the named field as text, or fid. cells are of one raster; with by_raster they
    may be of several on the grid, and each has rows of its own, with raster_id first.
    """
    one = ["raster_id"] if by_raster else []
    name = F.col(zone_id_field if zone_id_field else "fid").cast("string").alias("zone_id")
    zones = zones.select("fid", name, "geom")
    nodata = grid.nodata if nodata is None else nodata
    known = cells.where((F.col("band") == band) & F.col("value").isNotNull())
    if nodata is not None:
        known = known.where(valid(F.col("value"), nodata))
    v = F.col("value")
    found = cells_in(known, zones.select("fid", "geom"), grid).groupBy(*one, "fid").agg(F.count(v).cast("double").alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))
    every = zones.select("fid", "zone_id")
    if by_raster:
        every = every.crossJoin(small(cells.select("raster_id").distinct()))
    return every.join(found, [*one, "fid"], "left").select(*one, "fid", "zone_id", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in STATISTICS])


def sample_raster(cells: DataFrame, points: DataFrame, grid: Grid, bands: tuple[int, ...] = (), nodata: float | None = None, x: str = "x", y: str = "y", point_id: str = "point_id", by_raster: bool = False) -> DataFrame:
    """points plus band_1, band_2, ...: the values of the cells they lie in.

    Not-a-number outside the extent, on its right and bottom edge, at no data, and for points
    without coordinates. Points are never dropped. cells are of one raster; with by_raster they may
    be of several on the grid, and points have a row for each, with raster_id last.
    """
    nodata = grid.nodata if nodata is None else nodata
    which = bands or tuple(range(1, grid.bands + 1))
    col, row = F.floor(grid.column(F.col(x))).cast("int"), F.floor(grid.row(F.col(y))).cast("int")
    one = ["raster_id"] if by_raster else []
    keyed = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("point"), row.alias("at_row"), col.alias("at_col"))
    # Only cells that some point is in are looked at any further.
    wanted = small(keyed.where("at_row IS NOT NULL AND at_col IS NOT NULL").select(F.col("at_row").alias("row"), F.col("at_col").alias("col")).distinct())
    known = cells.where(F.col("band").isin(*which)).where(valid(F.col("value"), nodata)).join(wanted, ["row", "col"], "left_semi")
    wide = known.groupBy(*one, F.col("row").alias("r"), F.col("col").alias("c")).agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"band_{b}") for b in which])
    here = (F.col("at_row") == F.col("r")) & (F.col("at_col") == F.col("c"))
    if by_raster:
        keyed = keyed.crossJoin(small(cells.select(F.col("raster_id").alias("of")).distinct()))
        here &= F.col("of") == F.col("raster_id")
    got = [F.coalesce(f"band_{b}", F.lit(float("nan"))).alias(f"band_{b}") for b in which]
    return keyed.join(wide, here, "left").select(*[F.col("point")[c].alias(c) for c in points.columns], *got, *([F.col("of").alias("raster_id")] if by_raster else []))


def clip_bounds(cells: DataFrame, grid: Grid, xmin: float, ymin: float, xmax: float, ymax: float) -> tuple[DataFrame, Grid]:
    """The cells whose centres lie in the bounds, counted from 0 again, and their grid."""
    if xmin >= xmax or ymin >= ymax:
        raise ValueError("bounds must rise")
    row, col, rows, cols = grid.window(xmin, ymin, xmax, ymax)
    if not rows or not cols:
        raise ValueError("bounds don't meet the raster")
    kept = cells.where(F.col("row").between(row, row + rows - 1) & F.col("col").between(col, col + cols - 1))
    return kept.withColumns({"row": (F.col("row") - row).cast("int"), "col": (F.col("col") - col).cast("int")}), grid.cut(row, col, rows, cols)


def clip_mask(cells: DataFrame, grid: Grid, mask: DataFrame, crop: bool = True) -> tuple[DataFrame, Grid]:
    """Cells outside all geometries of mask become null, in every raster on the grid; with crop the grid shrinks to their box."""
    area = mask.where(~G.is_empty(F.col("geom"))).select("geom")
    inside = cells_in(cells.select("row", "col").distinct(), area, grid).select("row", "col").distinct().withColumn("_in", F.lit(True))
    masked = cells.join(inside, ["row", "col"], "left").select("raster_id", "band", "row", "col", F.when(F.col("_in"), F.col("value")).alias("value"))
    if not crop:
        return masked, grid
    b = area.select(G.bbox(F.col("geom")).alias("b")).agg(F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax")).collect()[0]
    if b[0] is None:
        raise ValueError("the mask is empty")
    return clip_bounds(masked, grid, *b)


def rasterize(features: DataFrame, resolution: tuple[float, float], extent: tuple[float, float, float, float] | None = None, burn_value: float = 1.0, burn_attribute: str | None = None, nodata: float = 0.0, all_touched: bool = False, burn_attributes: tuple[str, ...] | None = None, crs: str | None = None) -> tuple[DataFrame, Grid]:
    """A raster with a band for each attribute burnt, or one; of features over a cell the last fid wins.

    A feature without a number in the attribute is left out. Width and height are the extent over the
    resolution, rounded up, and cells are stretched to fit. all_touched: every cell whose square
    the geometry meets, instead of those whose centre it holds.
    """
    if burn_attribute and burn_attributes:
        raise ValueError("give burn_attribute or burn_attributes, not both")
    if resolution[0] <= 0 or resolution[1] <= 0:
        raise ValueError("resolution must be positive")
    some = features.where(~G.is_empty(F.col("geom")))
    if extent is None:
        extent = tuple(some.select(G.bbox(F.col("geom")).alias("b")).agg(F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax")).collect()[0])
        if extent[0] is None:
            raise ValueError("no geometry to take the extent from")
    names = burn_attributes or ((burn_attribute,) if burn_attribute else (None,))
    up = lambda x: max(1, -int(-x // 1))
    grid = Grid.from_bounds(*extent, up((extent[2] - extent[0]) / resolution[0]), up((extent[3] - extent[1]) / resolution[1]), crs=crs, nodata=nodata, bands=len(names))
    values = F.array(*[F.lit(float(burn_value)) if n is None else F.col(f"`{n}`").try_cast("double") for n in names])
    burnt = some.select("fid", "geom", F.posexplode(values).alias("_band", "_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    keyed = _cell_buckets(burnt, grid)
    spread = keyed.withColumn("row", F.explode(F.sequence(F.col("_br") * BUCKET, F.least(F.col("_br") * BUCKET + BUCKET, F.lit(grid.height)) - 1))).withColumn("col", F.explode(F.sequence(F.col("_bc") * BUCKET, F.least(F.col("_bc") * BUCKET + BUCKET, F.lit(grid.width)) - 1)))
    x, y = grid.x(F.col("col")), grid.y(F.col("row"))
    hx, hy = grid.resolution[0] / 2, grid.resolution[1] / 2
    hit = G.intersects(F.col("geom"), G.box(x - hx, y - hy, x + hx, y + hy)) if all_touched else F.when(G.is_area(F.col("geom")), G.covers_place(F.col("geom"), x, y)).otherwise(G.intersects(F.col("geom"), G.box(x - hx, y - hy, x + hx, y + hy)))
    won = spread.where(hit).groupBy("row", "col", "_band").agg(F.max_by("_value", "fid").alias("_value"))
    base = full_grid(features.sparkSession, grid).withColumn("_band", F.explode(F.array(*[F.lit(i) for i in range(len(names))])))
    cells = base.join(won, ["row", "col", "_band"], "left").select(F.lit("0").alias("raster_id"), (F.col("_band") + 1).cast("int").alias("band"), "row", "col", F.coalesce("_value", F.lit(float(nodata))).alias("value"))
    return cells, grid


def spatial_join(left: DataFrame, right: DataFrame, predicate: str = "intersects", geom: str = "geom", cell: float | None = None) -> DataFrame:
    """Every row of left with the attributes of each row of right for which predicate(left, right) holds.

    Rows without a match, and those of an empty geometry, stay, with nulls. Columns of right that left has too
    get the suffix _right. Right rows without a geometry match nothing. cell is the edge of a
    bucket; by default the mean extent of the right geometries, from one aggregate.
    """
    if predicate not in G.PREDICATES:
        raise ValueError(f"predicate must be one of {tuple(G.PREDICATES)}")
    taken = set(left.columns)
    attributes = []
    for c in right.columns:
        if c != geom:
            name = c
            while name in taken:
                name += "_right"
            taken.add(name)
            attributes.append((c, name))
    solid = right.where(~G.is_empty(F.col(geom)))
    if cell is None:
        b = solid.select(G.bbox(F.col(geom)).alias("b")).agg(F.avg(F.greatest(F.col("b.xmax") - F.col("b.xmin"), F.col("b.ymax") - F.col("b.ymin"))), F.max(F.abs("b.xmax"))).collect()[0]
        cell = max(float(b[0] or 0), 1e-9 * float(b[1] or 1), 1e-12) or 1.0
    keyed = left.withColumn("_lid", F.monotonically_increasing_id())

    def dealt(df: DataFrame, b: Column) -> DataFrame:
        df = df.withColumn("_box", b)
        ends = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
        return df.withColumn("_bx", F.explode(ends("_box.xmin", "_box.xmax"))).withColumn("_by", F.explode(ends("_box.ymin", "_box.ymax")))

    r = dealt(solid.select(F.col(geom).alias("_g"), *[F.col(f"`{c}`").alias(n) for c, n in attributes]), G.bbox(F.col("_g"))).withColumnRenamed("_box", "_rbox")
    pairs = dealt(keyed.where(~G.is_empty(F.col(geom))).select("_lid", geom), G.bbox(F.col(geom))).join(small(r), ["_bx", "_by"])
    # Boxes that meet share buckets; the pair counts in the first of them only.
    first = (F.col("_bx") == F.floor(F.greatest("_box.xmin", "_rbox.xmin") / cell)) & (F.col("_by") == F.floor(F.greatest("_box.ymin", "_rbox.ymin") / cell))
    met = pairs.where(first & G.boxes_meet(F.col("_box"), F.col("_rbox"))).where(G.PREDICATES[predicate](F.col(geom), F.col("_g")))
    return keyed.join(met.select("_lid", *[n for _, n in attributes]), "_lid", "left").drop("_lid")
