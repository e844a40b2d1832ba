"""The registered queries over the test tables, with the SQL that must give the same.

Rasters are derived from tables with dense keys: cell (floor(key / W), key % W). The same
expressions stand in the SQL, which is plain and runs without a spatial extension.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import crs as C
from terraloom.functions import geometry as G
from terraloom.functions.raster import Grid, cells_from
from terraloom.operators import hydrology, mosaic, spatial, terrain, warp

Query = Callable[[SparkSession, str], DataFrame]
W, PW = 50, 40
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _height(df: DataFrame, key: str, width: int) -> int:
    return int((df.agg(F.max(key)).collect()[0][0] or 0) // width + 1)


def dem(spark: SparkSession, sf_dir: str, holes: bool = True) -> tuple[DataFrame, Grid]:
    """Order prices on a raster 50 wide; every 17th cell without a value."""
    orders = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    value = F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("o_totalprice")) if holes else F.col("o_totalprice")
    h = _height(orders, "o_orderkey", W)
    return cells_from(orders, F.floor(k / W), k % W, value), Grid.from_bounds(0, 0, W, h, W, h, crs="EPSG:32610")


def small_dem(spark: SparkSession, sf_dir: str, nodata: float | None = None) -> tuple[DataFrame, Grid]:
    """Part prices on a raster 40 wide; with nodata every 13th cell has it."""
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    value = F.col("p_retailprice") if nodata is None else F.when(k % 13 == 0, F.lit(nodata)).otherwise(F.col("p_retailprice"))
    h = _height(part, "p_partkey", PW)
    return cells_from(part, F.floor(k / PW), k % PW, value), Grid.from_bounds(0, 0, PW, h, PW, h, crs="EPSG:32610", nodata=nodata)


DEM = f"cells AS (SELECT CAST(floor(o_orderkey / {W}) AS INT) AS r, CAST(o_orderkey % {W} AS INT) AS c, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders), size AS (SELECT max(r) + 1 AS h FROM cells)"
PART = f"cells AS (SELECT CAST(floor(p_partkey / {PW}) AS INT) AS r, CAST(p_partkey % {PW} AS INT) AS c, p_retailprice AS v FROM part), size AS (SELECT max(r) + 1 AS h FROM cells)"
PARTN = PART.replace("p_retailprice AS v", "CASE WHEN p_partkey % 13 = 0 THEN -9999.0 ELSE p_retailprice END AS v")


def zones(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """A rectangle for each nation, 5 by 5, each 12 wide and 40 high in rows from the north."""
    k = F.col("n_nationkey")
    x0 = (k % 5) * 12.0
    top = F.lit(float(grid.height)) - F.floor(k / 5) * 40.0
    return read(spark, sf_dir, "nation").select(k.cast("long").alias("fid"), F.col("n_name"), G.box(x0, top - 40.0, x0 + 12.0, top).alias("geom"))


def triangles(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """A triangle for each region, side by side, 10 wide and as high as the raster."""
    k = F.col("r_regionkey").cast("double")
    h = float(grid.height)
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("fid"), F.col("r_name"), G.polygon([(k * 10, F.lit(0.0)), (k * 10 + 10, F.lit(0.0)), (k * 10 + 5.3, F.lit(h)), (k * 10, F.lit(0.0))]).alias("geom"))


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def _stats(df: DataFrame) -> DataFrame:
    n = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.select("zone_id", n("count").cast("long").alias("cnt"), F.round(n("sum"), 2).alias("total"), F.round(n("mean"), 4).alias("mean"), n("min").alias("least"), n("max").alias("most"), F.round(n("std"), 4).alias("std"))


_STATS = "nullif(count(k.v), 0) AS cnt, round(sum(k.v), 2) AS total, round(avg(k.v), 4) AS mean, min(k.v) AS least, max(k.v) AS most, round(stddev_pop(k.v), 4) AS std"


@query(
    "zonal_stats",
    f"""WITH {DEM}, zones AS (SELECT n_name AS zone_id, (n_nationkey % 5) * 12 AS x0, floor(n_nationkey / 5) * 40 AS y0 FROM nation)
SELECT zone_id, {_STATS} FROM zones LEFT JOIN cells k ON k.c + 0.5 >= x0 AND k.c + 0.5 < x0 + 12 AND k.r + 0.5 >= y0 AND k.r + 0.5 < y0 + 40 GROUP BY zone_id""",
)
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = dem(spark, sf_dir)
    return _stats(spatial.zonal_stats(cells, zones(spark, sf_dir, grid), grid, zone_id_field="n_name"))


@query(
    "zonal_stats_triangles",
    f"""WITH {DEM}, zones AS (SELECT r_name AS zone_id, r_regionkey * 10.0 AS x0 FROM region),
inside AS (SELECT zone_id, v FROM zones, size, (SELECT r, c + 0.5 AS x, (SELECT h FROM size) - r - 0.5 AS y, v FROM cells) k
  WHERE x >= x0 + y * 5.3 / h AND x < x0 + 10 - y * 4.7 / h)
SELECT z.zone_id, {_STATS} FROM zones z LEFT JOIN inside k USING (zone_id) GROUP BY z.zone_id""",
)
def zonal_stats_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = dem(spark, sf_dir)
    return _stats(spatial.zonal_stats(cells, triangles(spark, sf_dir, grid), grid, zone_id_field="r_name"))


_POINTS = f"CAST((event_id * 7919) % {W + 3} AS DOUBLE) + 0.25"


@query(
    "sample_raster",
    f"""WITH {DEM}, p AS (SELECT event_id, {_POINTS} AS x, CAST((event_id * 104729) % (h + 2) AS DOUBLE) + 0.25 AS y, h FROM events, size)
SELECT event_id, k.v AS value FROM p LEFT JOIN cells k ON k.c = floor(p.x) AND k.r = floor(h - p.y)""",
)
def sample_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = dem(spark, sf_dir)
    k = F.col("event_id")
    points = read(spark, sf_dir, "events").select("event_id", ((k * 7919) % (W + 3) + 0.25).alias("x"), ((k * 104729) % (grid.height + 2) + 0.25).alias("y"))
    out = spatial.sample_raster(cells, points, grid)
    return out.select("event_id", F.when(~F.isnan("band_1"), F.col("band_1")).alias("value"))


@query("clip_bounds", f"WITH {DEM} SELECT r - 5 AS row, c - 10 AS col, v AS value FROM cells WHERE r BETWEEN 5 AND 24 AND c BETWEEN 10 AND 29")
def clip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = dem(spark, sf_dir)
    return spatial.clip_bounds(cells, grid, 10, grid.height - 25, 30, grid.height - 5)[0].select("row", "col", "value")


@query(
    "clip_mask",
    f"""WITH {DEM}, inside AS (SELECT DISTINCT r, c FROM cells, size, (SELECT r_regionkey * 10.0 AS x0 FROM region)
  WHERE c + 0.5 >= x0 + (h - r - 0.5) * 5.3 / h AND c + 0.5 < x0 + 10 - (h - r - 0.5) * 4.7 / h)
SELECT k.r AS row, k.c AS col, CASE WHEN i.r IS NOT NULL THEN k.v END AS value FROM cells k LEFT JOIN inside i ON k.r = i.r AND k.c = i.c""",
)
def clip_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = dem(spark, sf_dir)
    return spatial.clip_mask(cells, grid, triangles(spark, sf_dir, grid), crop=False)[0].select("row", "col", "value")


@query(
    "rasterize_vector",
    f"""WITH {DEM}, z AS (SELECT n_nationkey AS fid, n_nationkey % 5 * 12 AS x0, h - floor(n_nationkey / 5) * 40 AS top FROM nation, size),
g AS (SELECT x, y FROM (SELECT unnest(range(0, 60)) AS x), (SELECT unnest(range(0, CAST(200 AS BIGINT))) AS y))
SELECT CAST(y AS INT) AS row, CAST(x AS INT) AS col, coalesce(max_by(CAST(fid AS DOUBLE), fid), -1.0) AS value
FROM g LEFT JOIN z ON x + 0.5 >= x0 AND x + 0.5 < x0 + 12 AND (SELECT h FROM size) - y - 0.5 <= top AND (SELECT h FROM size) - y - 0.5 > top - 40 GROUP BY x, y""",
)
def rasterize_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, grid = dem(spark, sf_dir)
    features = zones(spark, sf_dir, grid).withColumn("burn", F.col("fid"))
    h = float(grid.height)
    return spatial.rasterize(features, (1.0, 1.0), (0.0, h - 200, 60.0, h), burn_attribute="burn", nodata=-1.0)[0].select("row", "col", "value")


@query(
    "spatial_join",
    """WITH p AS (SELECT c_custkey, c_custkey * 7919 % 70 + 0.5 AS x, c_custkey * 104729 % 230 + 0.5 AS y FROM customer),
z AS (SELECT n_name, n_nationkey % 5 * 12 AS x0, floor(n_nationkey / 5) * 40 AS y0 FROM nation)
SELECT c_custkey, n_name FROM p LEFT JOIN z ON x > x0 AND x < x0 + 12 AND y > y0 AND y < y0 + 40""",
)
def spatial_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    points = read(spark, sf_dir, "customer").select("c_custkey", G.point(k * 7919 % 70 + 0.5, k * 104729 % 230 + 0.5).alias("geom"))
    n = F.col("n_nationkey")
    boxes = read(spark, sf_dir, "nation").select("n_name", G.box((n % 5) * 12.0, F.floor(n / 5) * 40.0, (n % 5) * 12.0 + 12.0, F.floor(n / 5) * 40.0 + 40.0).alias("geom"))
    return spatial.spatial_join(points, boxes).drop("geom")


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Supplier boxes and nation boxes that overlap, touch, hold each other and stand apart."""
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    x, y, size = s * 31 % 60, s * 17 % 100, s % 4 * 3 + 2
    left = read(spark, sf_dir, "supplier").select("s_suppkey", G.box(x, y, x + size, y + size).alias("geom"))
    right = read(spark, sf_dir, "nation").select("n_name", G.box((n % 5) * 12.0, F.floor(n / 5) * 20.0, (n % 5) * 12.0 + 10.0, F.floor(n / 5) * 20.0 + 15.0).alias("geom"))
    return left, right


_BOXES = """WITH l AS (SELECT s_suppkey, s_suppkey * 31 % 60 AS x0, s_suppkey * 17 % 100 AS y0, s_suppkey % 4 * 3 + 2 AS d FROM supplier),
z AS (SELECT n_name, n_nationkey % 5 * 12 AS a0, n_nationkey % 5 * 12 + 10 AS a1, floor(n_nationkey / 5) * 20 AS b0, floor(n_nationkey / 5) * 20 + 15 AS b1 FROM nation)
SELECT s_suppkey, n_name FROM l LEFT JOIN z ON """


def _join_query(name: str, condition: str) -> None:
    @query(f"spatial_join_{name}", _BOXES + condition)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spatial.spatial_join(*_boxes(spark, sf_dir), predicate=name).drop("geom")


_MEET = "x0 <= a1 AND x0 + d >= a0 AND y0 <= b1 AND y0 + d >= b0"
_join_query("intersects", _MEET)
_join_query("contains", "a0 >= x0 AND a1 <= x0 + d AND b0 >= y0 AND b1 <= y0 + d")
_join_query("within", "x0 >= a0 AND x0 + d <= a1 AND y0 >= b0 AND y0 + d <= b1")
_join_query("touches", f"{_MEET} AND NOT (x0 < a1 AND x0 + d > a0 AND y0 < b1 AND y0 + d > b0)")


def _stencil(cells: str) -> str:
    """SQL of numpy-like gradients gx and gy of column v."""
    return f"""{cells}, near AS (SELECT k.r, k.c, k.v, w.v AS wv, e.v AS ev, n.v AS nv, s.v AS sv, h, (SELECT max(c) FROM cells) AS mc FROM cells k CROSS JOIN size
  LEFT JOIN cells w ON w.r = k.r AND w.c = k.c - 1 LEFT JOIN cells e ON e.r = k.r AND e.c = k.c + 1 LEFT JOIN cells n ON n.r = k.r - 1 AND n.c = k.c LEFT JOIN cells s ON s.r = k.r + 1 AND s.c = k.c),
g AS (SELECT *, CASE WHEN c = 0 THEN ev - v WHEN c = mc THEN v - wv ELSE (ev - wv) / 2 END AS gx, CASE WHEN r = 0 THEN sv - v WHEN r = h - 1 THEN v - nv ELSE (sv - nv) / 2 END AS gy FROM near)"""


def _value(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("row", "col", F.round("value", digits).alias("value"))


@query("slope", f"WITH {_stencil(PARTN)} SELECT r AS row, c AS col, round(CASE WHEN v = -9999 THEN -9999 ELSE degrees(atan(sqrt(gx * gx + gy * gy))) END, 6) AS value FROM g")
def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(terrain.slope(*small_dem(spark, sf_dir, -9999.0)))


@query("slope_percent", f"WITH {_stencil(PART)} SELECT r AS row, c AS col, round(sqrt(gx * gx + gy * gy) * 100, 6) AS value FROM g")
def slope_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(terrain.slope(*small_dem(spark, sf_dir), units="percent"))


_ASPECT = "degrees(atan2(gy, -gx))"


@query(
    "aspect",
    f"""WITH {_stencil(PARTN)}, a AS (SELECT *, 90 - CASE WHEN {_ASPECT} < 0 THEN {_ASPECT} + 360 ELSE {_ASPECT} END AS d FROM g)
SELECT r AS row, c AS col, round(CASE WHEN v = -9999 THEN -9999 WHEN gx = 0 AND gy = 0 THEN -1 WHEN d < 0 THEN d + 360 ELSE d END, 6) AS value FROM a""",
)
def aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(terrain.aspect(*small_dem(spark, sf_dir, -9999.0)))


@query(
    "hillshade",
    f"""WITH {_stencil(PARTN.replace("-9999.0", "NULL"))}, l AS (SELECT *, cos(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy))) + sin(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(90 - 315) - atan2(gy, -gx)) AS s FROM g)
SELECT r AS row, c AS col, round(CASE WHEN v IS NULL OR gx IS NULL OR gy IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, s)) END, 6) AS value FROM l""",
)
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(terrain.hillshade(*small_dem(spark, sf_dir, -9999.0), scaled=True))


@query(
    "d8_pass_one",
    f"""WITH {PART}, o AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)) t(d, dr, dc)),
s AS (SELECT k.r, k.c, d, (k.v - n.v) / CASE WHEN d % 2 = 1 THEN sqrt(2) ELSE 1 END AS slope FROM cells k, o JOIN cells n ON n.r = k.r + dr AND n.c = k.c + dc),
b AS (SELECT r, c, max(slope) AS most FROM s GROUP BY r, c)
SELECT s.r AS row, s.c AS col, CAST(min(d) AS INT) AS code FROM s JOIN b USING (r, c) WHERE slope = most AND most > 0 GROUP BY s.r, s.c""",
)
def d8_pass_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of the cells that have a lower neighbour."""
    cells, grid = small_dem(spark, sf_dir)
    codes = hydrology.d8_flow_direction(cells, grid)
    from terraloom.functions.raster import with_neighbours

    near = with_neighbours(cells, diagonals=True)
    lower = F.least(*[F.coalesce(n, F.lit(float("inf"))) for n in ("n", "s", "w", "e", "nw", "ne", "sw", "se")]) < F.col("value")
    return codes.join(near.where(lower).select("row", "col"), ["row", "col"]).select("row", "col", F.col("value").cast("int").alias("code"))


@query(
    "fill_depressions",
    f"""WITH RECURSIVE {PART}, levels AS (SELECT DISTINCT v AS t FROM cells), n AS (SELECT a.r, a.c, b.r AS r2, b.c AS c2, greatest(a.v, b.v) AS v FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
edge AS (SELECT r, c, v FROM cells, size WHERE r = 0 OR c = 0 OR r = h - 1 OR c = (SELECT max(c) FROM cells)),
w(i, r, c, v) AS (SELECT 0, r, c, v FROM edge UNION ALL SELECT i + 1, r, c, min(v) FROM (SELECT w.i, n.r2 AS r, n.c2 AS c, greatest(w.v, n.v) AS v FROM w JOIN n ON n.r = w.r AND n.c = w.c WHERE w.i < 60) GROUP BY i, r, c)
SELECT r AS row, c AS col, round(min(v), 6) AS value FROM w GROUP BY r, c""",
)
def fill_depressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = small_dem(spark, sf_dir)
    return _value(hydrology.fill_depressions(cells, grid, apply_gradient=False))


_WAYS = "o AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)) t(d, dr, dc))"


def _pass_one(cells: str) -> str:
    """SQL of directions by the steepest drop, among cells (r, c, v) that have a value; size has the height."""
    return f"""{_WAYS}, s AS (SELECT k.r, k.c, d, dr, dc, (k.v - n.v) / CASE WHEN d % 2 = 1 THEN sqrt(2) ELSE 1 END AS slope FROM {cells} k, o JOIN {cells} n ON n.r = k.r + dr AND n.c = k.c + dc),
best AS (SELECT r, c, d, dr, dc FROM s QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY slope DESC, d) = 1 AND slope > 0),
codes AS (SELECT k.r, k.c, k.v, dr, dc, CAST(coalesce(d, CASE WHEN k.r = 0 OR k.c = 0 OR k.r = h - 1 OR k.c = {PW - 1} THEN 8 ELSE 9 END) AS INT) AS code FROM {cells} k CROSS JOIN size LEFT JOIN best USING (r, c))"""


#: SQL of the second pass over codes: pits one by one, row by row, in place, until a sweep changes nothing.
_PASS_TWO = f"""dense AS (SELECT list(v ORDER BY i) AS zs, list(coalesce(code, -1) ORDER BY i) AS cs, any_value(h) AS h FROM (SELECT h, unnest(range(CAST(h * {PW} AS BIGINT))) AS i FROM size) LEFT JOIN (SELECT r * {PW} + c AS i, v, code FROM codes) USING (i)),
pits AS (SELECT coalesce(list(r * {PW} + c ORDER BY r, c), []) AS ps FROM codes WHERE code = 9),
ways AS (SELECT [0, 1, 1, 1, 0, -1, -1, -1] AS dr, [1, 1, 0, -1, -1, -1, 0, 1] AS dc),
sweep(i, cs, changed, over) AS (SELECT 0, cs, false, len(ps) = 0 FROM dense, pits UNION ALL
  SELECT (i + 1) % len(ps), CASE WHEN hit IS NULL THEN cs ELSE list_concat(list_concat(cs[:k], [CAST(hit AS INT)]), cs[k + 2:]) END, CASE WHEN i + 1 = len(ps) THEN false ELSE changed OR hit IS NOT NULL END, i + 1 = len(ps) AND NOT changed AND hit IS NULL
  FROM (SELECT i, w.cs, changed, ps, k, CASE WHEN w.cs[k + 1] = 9 THEN list_filter([0, 1, 2, 3, 4, 5, 6, 7], lambda d: k // {PW} + dr[d + 1] BETWEEN 0 AND h - 1 AND k % {PW} + dc[d + 1] BETWEEN 0 AND {PW - 1} AND w.cs[k + 1 + dr[d + 1] * {PW} + dc[d + 1]] BETWEEN 0 AND 8 AND zs[k + 1 + dr[d + 1] * {PW} + dc[d + 1]] <= zs[k + 1])[1] END AS hit
    FROM (SELECT s.*, ps, ps[s.i + 1] AS k FROM sweep s, pits WHERE NOT over) w, dense, ways)),
solved AS (SELECT CAST(i // {PW} AS INT) AS r, CAST(i % {PW} AS INT) AS c, cs[i + 1] AS code FROM (SELECT cs, unnest(range(len(cs))) AS i FROM sweep WHERE over) WHERE cs[i + 1] >= 0)"""
_CODES = f"{PART}, {_pass_one('cells')}"


@query("d8_flow_direction", f"WITH {_CODES} SELECT r AS row, c AS col, code FROM codes")
def d8_flow_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydrology.d8_flow_direction(*small_dem(spark, sf_dir)).select("row", "col", F.col("value").cast("int").alias("code"))


_TERRACES = PART.replace("p_retailprice AS v", "floor(p_retailprice / 60) AS v")


@query("d8_pass_two", f"WITH RECURSIVE {_TERRACES}, {_pass_one('cells')}, {_PASS_TWO} SELECT r AS row, c AS col, code FROM solved")
def d8_pass_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions over terraces, most of whose cells have no lower neighbour."""
    cells, grid = small_dem(spark, sf_dir)
    steps = cells.withColumn("value", F.floor(F.col("value") / 60).cast("double"))
    return hydrology.d8_flow_direction(steps, grid).select("row", "col", F.col("value").cast("int").alias("code"))


_FILLED = f"""{PART.replace("FROM part)", "FROM part WHERE p_partkey % 13 <> 0)").replace("max(r) + 1 AS h FROM cells", f"CAST(max(floor(p_partkey / {PW})) AS INT) + 1 AS h FROM part")},
n AS (SELECT a.r, a.c, b.r AS r2, b.c AS c2, b.v AS v2 FROM cells a JOIN cells b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND (a.r <> b.r OR a.c <> b.c)),
w(i, r, c, v) AS (SELECT 0, r, c, v FROM cells, size WHERE r = 0 OR c = 0 OR r = h - 1 OR c = {PW - 1} UNION ALL SELECT i + 1, r, c, min(v) FROM (SELECT w.i, n.r2 AS r, n.c2 AS c, greatest(w.v, n.v2) AS v FROM w JOIN n ON n.r = w.r AND n.c = w.c WHERE w.i < 60 UNION ALL SELECT i, r, c, v FROM w WHERE i < 60) GROUP BY i, r, c),
flood AS (SELECT r, c, coalesce(f.v, k.v) AS v FROM cells k LEFT JOIN (SELECT r, c, min(v) AS v FROM w GROUP BY r, c) f USING (r, c)),
flat AS (SELECT f.r, f.c, f.v FROM flood f, size WHERE f.r BETWEEN 1 AND h - 2 AND f.c BETWEEN 1 AND {PW - 2} AND NOT EXISTS (SELECT 1 FROM n JOIN flood g ON g.r = n.r2 AND g.c = n.c2 WHERE n.r = f.r AND n.c = f.c AND g.v < f.v)),
far(r, c, steps) AS (SELECT f.r, f.c, 0 FROM flat f WHERE EXISTS (SELECT 1 FROM n WHERE n.r = f.r AND n.c = f.c AND NOT EXISTS (SELECT 1 FROM flat g WHERE g.r = n.r2 AND g.c = n.c2))
  UNION SELECT f.r, f.c, steps + 1 FROM far JOIN n ON n.r = far.r AND n.c = far.c JOIN flat f ON f.r = n.r2 AND f.c = n.c2 WHERE steps < 30),
raised AS (SELECT k.r, k.c, k.v + coalesce(steps, 0) * 1e-5 AS v FROM flood k LEFT JOIN (SELECT r, c, min(steps) AS steps FROM far GROUP BY r, c) USING (r, c))"""


@query("fill_depressions_graded", f"WITH RECURSIVE {_FILLED} SELECT r AS row, c AS col, round(v, 6) AS value FROM raised")
def fill_depressions_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flats of the filled raster rise away from where they end."""
    cells, grid = small_dem(spark, sf_dir, -9999.0)
    return _value(hydrology.fill_depressions(cells, grid)).where("value <> -9999")


@query(
    "flow_accumulation",
    f"""WITH RECURSIVE {_FILLED}, {_pass_one("raised")}, {_PASS_TWO},
trace(r, c) AS (SELECT r, c FROM solved UNION ALL SELECT t.r + dr, t.c + dc FROM trace t JOIN solved USING (r, c) JOIN o ON o.d = code JOIN solved there ON there.r = t.r + dr AND there.c = t.c + dc)
SELECT r AS row, c AS col, CAST(coalesce(n, -1) AS DOUBLE) AS value FROM (SELECT CAST(floor(p_partkey / {PW}) AS INT) AS r, CAST(p_partkey % {PW} AS INT) AS c FROM part) LEFT JOIN (SELECT r, c, count(*) AS n FROM trace GROUP BY r, c) USING (r, c)""",
)
def flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled, with rising flats, directions by both passes, accumulated."""
    cells, grid = small_dem(spark, sf_dir, -9999.0)
    return hydrology.hydrology_flow(cells, grid)[2].select("row", "col", "value")


@query(
    "flow_accumulation_unfilled",
    f"""WITH RECURSIVE {_CODES}, trace(r, c) AS (SELECT r, c FROM codes UNION ALL SELECT t.r + dr, t.c + dc FROM trace t JOIN codes USING (r, c) WHERE code < 8)
SELECT r AS row, c AS col, CAST(count(*) AS DOUBLE) AS value FROM trace GROUP BY r, c""",
)
def flow_accumulation_unfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = small_dem(spark, sf_dir)
    return hydrology.flow_accumulation(hydrology.d8_flow_direction(cells, grid), grid).select("row", "col", "value")


@query("flow_conservation", "SELECT count(*) AS cells, CAST(count(*) AS DOUBLE) AS drained FROM part WHERE p_partkey % 13 <> 0")
def flow_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reaches outlets and pits is the weight of all valid cells."""
    cells, grid = small_dem(spark, sf_dir, -9999.0)
    _, codes, acc = hydrology.hydrology_flow(cells, grid)
    both = codes.select("row", "col", F.col("value").alias("code")).join(acc.select("row", "col", "value"), ["row", "col"])
    return both.agg(F.count(F.when(F.col("code") >= 0, 1)).alias("cells"), F.sum(F.when(F.col("code") >= 8, F.col("value"))).alias("drained"))


@query("build_cog_average", f"WITH {DEM} SELECT CAST(floor(r / 2) AS INT) AS row, CAST(floor(c / 2) AS INT) AS col, round(avg(v), 6) AS value FROM cells GROUP BY 1, 2")
def build_cog_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = dem(spark, sf_dir)
    return _value(mosaic.overview(cells, 2, "average"))


@query("build_cog_nearest", f"WITH {DEM} SELECT CAST(r // 2 AS INT) AS row, CAST(c // 2 AS INT) AS col, v AS value FROM cells WHERE r % 2 = 0 AND c % 2 = 0")
def build_cog_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overview level 2 out of the tiles of a whole pyramid."""
    cells, grid = dem(spark, sf_dir)
    pyramid = mosaic.build_cog(cells, Grid(grid.width, grid.height), blocksize=16)
    return mosaic.untile(pyramid.where("level = 2"), 16).select("row", "col", "value")


def _smoothed(kernel: str, reach: int) -> str:
    """SQL of overviews at a third of the raster, by a kernel of x; over pi, so that none lies between two roundings."""
    at = lambda one, many: kernel.replace("x", f"abs(({one} + 0.5) / 3 - ({many} + 0.5))")
    return f"""WITH {DEM}, spread AS (SELECT r, c, v, CAST(r // 3 + i AS INT) AS row, CAST(c // 3 + j AS INT) AS col FROM cells, range(-{reach}, {reach + 1}) AS di(i), range(-{reach}, {reach + 1}) AS dj(j)),
weighed AS (SELECT *, {at('r', 'row')} * {at('c', 'col')} AS w FROM spread)
SELECT row, col, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END) / pi(), 4) AS value FROM weighed WHERE w <> 0 GROUP BY row, col HAVING bool_or(row = r // 3 AND col = c // 3)"""


@query("build_cog_bilinear", _smoothed("greatest(0, 1 - x)", 1))
def build_cog_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = dem(spark, sf_dir)
    return _value(mosaic.overview(cells, 3, "bilinear").withColumn("value", F.col("value") / math.pi), 4)


_CUBIC = "(CASE WHEN x <= 1 THEN 1.5e0 * x ** 3 - 2.5e0 * x ** 2 + 1 WHEN x < 2 THEN -0.5e0 * x ** 3 + 2.5e0 * x ** 2 - 4 * x + 2 ELSE 0 END)"


@query("build_cog_cubic", _smoothed(_CUBIC, 2))
def build_cog_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = dem(spark, sf_dir)
    return _value(mosaic.overview(cells, 3, "cubic").withColumn("value", F.col("value") / math.pi), 4)


@query(
    "build_cog_mode",
    f"""WITH {DEM}, m AS (SELECT CAST(floor(r / 4) AS INT) AS row, CAST(floor(c / 4) AS INT) AS col, floor(v / 100000) AS v, count(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY 1, 2, 3)
SELECT row, col, CAST(v AS DOUBLE) AS value FROM m QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, v) = 1""",
)
def build_cog_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = dem(spark, sf_dir)
    return mosaic.overview(cells.withColumn("value", F.floor(F.col("value") / 100000).cast("double")), 4, "mode").select("row", "col", "value")


@query(
    "reproject_vector",
    """SELECT c_custkey, round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS y
FROM (SELECT c_custkey, c_custkey * 7919 % 360 - 180 + 0.25 AS lon, c_custkey * 104729 % 160 - 80 + 0.25 AS lat FROM customer)""",
)
def reproject_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    points = read(spark, sf_dir, "customer").select("c_custkey", G.point(k * 7919 % 360 - 180 + 0.25, k * 104729 % 160 - 80 + 0.25).alias("geom"))
    v = F.get(G.vertices(F.col("geom")), F.lit(0))
    return warp.reproject_features(points, "EPSG:4326", "EPSG:3857").select("c_custkey", F.round(v["x"], 3).alias("x"), F.round(v["y"], 3).alias("y"))


@query("reproject_round_trip", "SELECT c_custkey, CAST(c_custkey * 7919 % 6 - 126 + 0.25 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 80 + 0.25 AS DOUBLE) AS y FROM customer")
def reproject_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To UTM zone 10 and back."""
    k = F.col("c_custkey")
    points = read(spark, sf_dir, "customer").select("c_custkey", (k * 7919 % 6 - 126 + 0.25).alias("lon"), (k * 104729 % 80 + 0.25).alias("lat"))
    x, y = C.transform(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:32610")
    a, b = C.transform(F.col("e"), F.col("n"), "EPSG:32610", "EPSG:4326")
    return points.select("c_custkey", x.alias("e"), y.alias("n")).select("c_custkey", F.round(a, 6).alias("x"), F.round(b, 6).alias("y"))


def _bilinear(places: str) -> str:
    """SQL of values at places (row, col, sr, sc) of the raster in cells: the four cells around, by nearness, where the place's own cell is there."""
    return f"""near AS (SELECT row, col, sr, sc, CAST(floor(sr - 0.5) AS INT) + i AS r, CAST(floor(sc - 0.5) AS INT) + j AS c FROM {places}, (VALUES (0), (1)) AS di(i), (VALUES (0), (1)) AS dj(j)),
weighed AS (SELECT row, col, v, (1 - abs(r + 0.5 - sr)) * (1 - abs(c + 0.5 - sc)) AS w, r = floor(sr) AND c = floor(sc) AS own FROM near JOIN cells USING (r, c) WHERE v IS NOT NULL),
found AS (SELECT row, col, sum(v * w) / sum(w) AS value FROM weighed GROUP BY row, col HAVING bool_or(own))"""


_WARPED = f"""{PART}, ends AS (SELECT radians(-122.0) * 6378137.0 AS x0, radians(-121.0) * 6378137.0 AS x1, ln(tan(pi() / 4 + radians(37.0) / 2)) * 6378137.0 AS y0, ln(tan(pi() / 4 + radians(38.0) / 2)) * 6378137.0 AS y1),
sized AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / sqrt({PW}.0 ** 2 + h ** 2) AS res FROM ends, size),
grid AS (SELECT CAST(i AS INT) AS row, CAST(j AS INT) AS col, x0 + (j + 0.5) * res AS x, y1 - (i + 0.5) * res AS y, h FROM (SELECT *, unnest(range(CAST(ceil((y1 - y0) / res - 1e-9) AS BIGINT))) AS i FROM (SELECT *, unnest(range(CAST(ceil((x1 - x0) / res - 1e-9) AS BIGINT))) AS j FROM sized))),
places AS (SELECT row, col, (38 - degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2)) * h AS sr, (degrees(x / 6378137.0) + 122) * {PW} AS sc FROM grid)"""


@query("reproject_raster", f"WITH {_WARPED}, {_bilinear('places')} SELECT row, col, round(value, 4) AS value FROM grid LEFT JOIN found USING (row, col)")
def reproject_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part raster, over a degree square, in web Mercator."""
    cells, grid = small_dem(spark, sf_dir)
    at = Grid.from_bounds(-122, 37, -121, 38, grid.width, grid.height, crs="EPSG:4326")
    return _value(warp.reproject_raster(cells, at, "EPSG:3857", "bilinear")[0], 4)


@query("reproject_raster_nearest", f"WITH {_WARPED} SELECT row, col, v AS value FROM places LEFT JOIN cells ON r = floor(sr) AND c = floor(sc)")
def reproject_raster_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = small_dem(spark, sf_dir)
    at = Grid.from_bounds(-122, 37, -121, 38, grid.width, grid.height, crs="EPSG:4326")
    return warp.reproject_raster(cells, at, "EPSG:3857", "nearest")[0].select("row", "col", "value")


@query(
    "reproject_raster_cubic",
    f"""WITH {_WARPED}, near AS (SELECT row, col, sr, sc, CAST(floor(sr - 0.5) AS INT) + i AS r, CAST(floor(sc - 0.5) AS INT) + j AS c FROM places, (VALUES (-1), (0), (1), (2)) AS di(i), (VALUES (-1), (0), (1), (2)) AS dj(j)),
weighed AS (SELECT row, col, v, {_CUBIC.replace('x', 'abs(r + 0.5 - sr)')} * {_CUBIC.replace('x', 'abs(c + 0.5 - sc)')} AS w, r = floor(sr) AND c = floor(sc) AS own FROM near JOIN cells USING (r, c)),
found AS (SELECT row, col, sum(v * w) / sum(w) AS value FROM weighed GROUP BY row, col HAVING bool_or(own) AND abs(sum(w)) > 1e-12)
SELECT row, col, round(value, 4) AS value FROM grid LEFT JOIN found USING (row, col)""",
)
def reproject_raster_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = small_dem(spark, sf_dir)
    at = Grid.from_bounds(-122, 37, -121, 38, grid.width, grid.height, crs="EPSG:4326")
    return _value(warp.reproject_raster(cells, at, "EPSG:3857", "cubic")[0], 4)


_MOVED = f"""{PART}, places AS (SELECT v, radians(-122 + (c + 0.5) / {PW}) * 6378137.0 AS x, ln(tan(pi() / 4 + radians(38 - (r + 0.5) / h) / 2)) * 6378137.0 AS y FROM cells, size),
moved AS (SELECT v, CAST(floor((ln(tan(pi() / 4 + radians(38.0) / 2)) * 6378137.0 - y) / 5000) AS INT) AS row, CAST(floor((x - radians(-122.0) * 6378137.0) / 5000) AS INT) AS col FROM places)"""


@query("reproject_raster_mode", f"WITH {_MOVED}, n AS (SELECT row, col, floor(v / 100) AS value, count(*) AS n FROM moved GROUP BY ALL) SELECT row, col, value FROM n QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) = 1")
def reproject_raster_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest hundred in cells of 5 km, the least of equals."""
    cells, grid = small_dem(spark, sf_dir)
    at = Grid.from_bounds(-122, 37, -121, 38, grid.width, grid.height, crs="EPSG:4326")
    hundreds = cells.withColumn("value", F.floor(F.col("value") / 100).cast("double"))
    return warp.reproject_raster(hundreds, at, "EPSG:3857", "mode", 5000.0)[0].where("value IS NOT NULL").select("row", "col", "value")


@query("reproject_raster_average", f"WITH {_MOVED} SELECT row, col, round(avg(v), 6) AS value FROM moved GROUP BY 1, 2")
def reproject_raster_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the part raster, over a degree square, in cells of 5 km in web Mercator."""
    cells, grid = small_dem(spark, sf_dir)
    at = Grid.from_bounds(-122, 37, -121, 38, grid.width, grid.height, crs="EPSG:4326")
    return _value(warp.reproject_raster(cells, at, "EPSG:3857", "average", 5000.0)[0].where("value IS NOT NULL"))


def _slc(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, Grid]:
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    k = F.col("l_orderkey")
    at = [F.floor(k / W).cast("int").alias("row"), (k % W).cast("int").alias("col")]
    one = lines.groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    h = _height(lines, "l_orderkey", W)
    return one.select(*at, F.col("q").alias("re"), (F.col("d") * 100).alias("im")), one.select(*at, (F.col("t") * 100 - 1).alias("value")), one.select(*at, F.col("d").alias("value")), Grid(W, h)


_SLC = f"""one AS (SELECT l_orderkey AS k, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
s AS (SELECT CAST(floor(k / {W}) AS INT) AS r, CAST(k % {W} AS INT) AS c, (q * q + (d * 100) * (d * 100) - d) / nullif(t * 100 - 1, 0) AS v FROM one), size AS (SELECT max(r) + 1 AS h FROM s)"""


@query("slc_calibrate", f"WITH {_SLC} SELECT CAST(floor(r / 4) AS INT) AS row, CAST(floor(c / 4) AS INT) AS col, round(avg(v) + 0.0000001234, 6) AS value FROM s, size WHERE r < floor(h / 4) * 4 AND c < 48 GROUP BY 1, 2")
def slc_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    slc, x, noise, grid = _slc(spark, sf_dir)
    return mosaic.slc_calibrate(slc, x, noise, grid)[0].select("row", "col", F.round(F.col("value") + 0.0000001234, 6).alias("value"))


@query(
    "multilook_complex",
    f"""WITH one AS (SELECT l_orderkey AS k, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), size AS (SELECT max(CAST(floor(k / {W}) AS INT)) + 1 AS h FROM one)
SELECT CAST(floor(floor(k / {W}) / 2) AS INT) AS row, CAST(floor(k % {W} / 5) AS INT) AS col, round(avg(q), 6) AS re, round(avg(d * 100), 6) AS im FROM one, size WHERE floor(k / {W}) < floor(h / 2) * 2 GROUP BY 1, 2""",
)
def multilook_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    slc, _, _, grid = _slc(spark, sf_dir)
    return _rounded(mosaic.multilook_complex(slc, 2, 5, grid.height, grid.width), 6, "re", "im")


@query(
    "normalize_interferogram",
    f"""WITH one AS (SELECT l_orderkey AS k, max(l_quantity) AS q, max(l_discount) * 100 AS d FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), size AS (SELECT max(CAST(floor(k / {W}) AS INT)) + 1 AS h FROM one),
b AS (SELECT CAST(floor(floor(k / {W}) / 2) AS INT) AS row, CAST(floor(k % {W} / 5) AS INT) AS col, avg(q) AS re, avg(d) AS im, avg(q * q + d * d) AS p, avg(q * q * 4) AS m FROM one, size WHERE floor(k / {W}) < floor(h / 2) * 2 GROUP BY 1, 2),
n AS (SELECT row, col, re / sqrt(p * m) AS re, im / sqrt(p * m) AS im FROM b)
SELECT row, col, round(re / greatest(1.0, sqrt(re * re + im * im)), 8) AS re, round(im / greatest(1.0, sqrt(re * re + im * im)), 8) AS im FROM n""",
)
def normalize_interferogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    slc, _, _, grid = _slc(spark, sf_dir)
    minus = slc.select("row", "col", (F.col("re") * 2).alias("re"), F.lit(0.0).alias("im"))
    return _rounded(mosaic.normalize_interferogram(slc, slc, minus, 2, 5, grid.height, grid.width), 8, "re", "im")


def _passes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Grid]:
    """How often each cell is water, from all orders, and a pass for each type of event, from all events."""
    orders, events = read(spark, sf_dir, "orders"), read(spark, sf_dir, "events")
    h, k = _height(orders, "o_orderkey", W), F.col("o_orderkey")
    at = F.col("event_id") * 7919 % (h * W)
    cells = events.select(F.col("event_type").alias("raster_id"), F.lit(2).alias("band"), F.floor(at / W).cast("int").alias("row"), (at % W).cast("int").alias("col"), F.col("value"))
    one = cells.groupBy("raster_id", "band", "row", "col").agg(F.max("value").alias("value"))
    freq = orders.select(F.lit(1).alias("band"), F.floor(k / W).cast("int").alias("row"), (k % W).cast("int").alias("col"), (k * 37 % 100 / 100).alias("value"))
    return freq, one, Grid(W, h)


_PASSES = f"""size AS (SELECT CAST(max(floor(o_orderkey / {W})) AS BIGINT) + 1 AS h FROM orders),
f AS (SELECT CAST(floor(o_orderkey / {W}) AS INT) AS r, CAST(o_orderkey % {W} AS INT) AS c, o_orderkey * 37 % 100 / 100 >= 0.3 AS m FROM orders),
p AS (SELECT event_type, CAST(floor(event_id * 7919 % (h * {W}) / {W}) AS INT) AS r, CAST(event_id * 7919 % (h * {W}) % {W} AS INT) AS c, max(value) AS v FROM events, size GROUP BY 1, 2, 3),
a AS (SELECT r, c, median(v) AS v, count(v) AS n FROM p GROUP BY r, c)"""


@query(
    "water_elevation_mosaic",
    f"WITH {_PASSES} SELECT r AS row, c AS col, round(CASE WHEN m THEN v END, 6) AS wse, CAST(CASE WHEN m THEN coalesce(n, 0) ELSE 0 END AS INT) AS confidence, CAST(m AS INT) AS mask FROM f LEFT JOIN a USING (r, c)",
)
def water_elevation_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq, passes, grid = _passes(spark, sf_dir)
    return _rounded(mosaic.water_elevation_mosaic(freq, passes, grid, max_rounds=0)[0], 6, "wse")


@query(
    "water_elevation_filled",
    f"""WITH RECURSIVE {_PASSES},
w(i, r, c, m, v) AS (SELECT 0, f.r, f.c, m, CASE WHEN m THEN v END FROM f LEFT JOIN a ON f.r = a.r AND f.c = a.c
  UNION ALL SELECT i + 1, r, c, m, CASE WHEN m THEN coalesce(v, near) END FROM (SELECT x.i, x.r, x.c, x.m, x.v, avg(y.v) AS near FROM w x
    LEFT JOIN (SELECT r + dr AS r, c + dc AS c, v FROM w, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS step(dr, dc)) y ON x.r = y.r AND x.c = y.c WHERE x.i < 40 GROUP BY ALL))
SELECT r AS row, c AS col, round(w.v, 6) AS wse, CAST(CASE WHEN m THEN coalesce(n, 0) ELSE 0 END AS INT) AS confidence, CAST(m AS INT) AS mask FROM w LEFT JOIN (SELECT r, c, n FROM a) USING (r, c) WHERE i = 40""",
)
def water_elevation_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq, passes, grid = _passes(spark, sf_dir)
    return _rounded(mosaic.water_elevation_mosaic(freq, passes, grid)[0], 6, "wse")


@query("scatter_last", "SELECT CAST(least(19, floor(event_id * 31 % 500 / 25)) AS INT) AS row, CAST(event_id * 17 % 25 AS INT) AS col, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def scatter_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point clouds to cells, the last point winning."""
    k = F.col("event_id")
    points = read(spark, sf_dir, "events").select("event_id", (k * 17 % 25 + 0.5).alias("x"), (F.lit(20.0) - F.least(F.lit(19), F.floor(k * 31 % 500 / 25)) - 0.5).alias("y"), "value")
    return mosaic.scatter(points, Grid.from_bounds(0, 0, 25, 20, 25, 20), "x", "y", ("value",), "event_id").select("row", "col", "value")


@query(
    "geocode_slc",
    f"""WITH {PART}, ends AS (SELECT h, 15.0 / 111320 AS res, -122 - 30.0 / 111320 AS west, -122 + 0.0002 * {PW - 1} + 0.00003 * (h - 1) + 30.0 / 111320 AS east, 37 - 0.0002 * (h - 1) - 30.0 / 111320 AS south, 37 + 0.00002 * {PW - 1} + 30.0 / 111320 AS north FROM size),
sized AS (SELECT *, CAST(ceil((east - west) / res) AS BIGINT) AS tw, CAST(ceil((north - south) / res) AS BIGINT) AS th FROM ends),
grid AS (SELECT CAST(i AS INT) AS row, CAST(j AS INT) AS col, h, west + (j + 0.5) * (east - west) / tw + 122 AS x, north - (i + 0.5) * (north - south) / th - 37 AS y FROM (SELECT *, unnest(range(th)) AS i FROM (SELECT *, unnest(range(tw)) AS j FROM sized))),
places AS (SELECT * FROM (SELECT row, col, h, (0.00002 * x - 0.0002 * y) / (0.0002 * 0.0002 + 0.00003 * 0.00002) + 0.5 AS sr, (0.0002 * x + 0.00003 * y) / (0.0002 * 0.0002 + 0.00003 * 0.00002) + 0.5 AS sc FROM grid) WHERE sr >= 0 AND sr < h AND sc >= 0 AND sc < {PW}),
{_bilinear("places")}
SELECT row, col, round(value, 3) AS value FROM grid LEFT JOIN found USING (row, col)""",
)
def geocode_slc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part raster as a radar raster, geocoded by a slanted net of control points. Polynomials through a net without bends are straight."""
    cells, grid = small_dem(spark, sf_dir)
    points = [(r * (grid.height - 1) / 4, c * (grid.width - 1) / 4, -122 + 0.0002 * c * (grid.width - 1) / 4 + 0.00003 * r * (grid.height - 1) / 4, 37 - 0.0002 * r * (grid.height - 1) / 4 + 0.00002 * c * (grid.width - 1) / 4) for r in range(5) for c in range(5)]
    return _value(warp.geocode(cells, grid, points, 15.0)[0], 3)


def queries() -> dict[str, Query]:
    from terraloom import source_queries
    from terraloom.plans import registry_queries

    return _QUERIES | registry_queries.QUERIES | source_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from terraloom import source_queries
    from terraloom.plans import registry_queries

    return _ORACLES | registry_queries.ORACLES | source_queries.ORACLES
