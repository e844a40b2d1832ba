"""Queries that write test tables in a format and read them back through its connector, by way of the router.

What comes back must be what SQL finds in the table, so each row is a check of a connector, of its
route and of the CRS that it reports. Files of formats that are written as one are made of the small
tables (nation, region, part); those that Spark writes hold all suppliers.
"""

from __future__ import annotations

import sqlite3
import struct
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom import checks
from terraloom.catalogue import PW, dem, read, small_dem
from terraloom.functions import geometry as G
from terraloom.functions.raster import Grid
from terraloom.operators import hydrology, spatial
from terraloom.plans.executor import Executor, get_operator, materialize, raster_dataset
from terraloom.plans.route import SourceRef, default_router
from terraloom.plans.session import shared_dir
from terraloom.sources import codecs, raster, remote, samples, swot, vector

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _at(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/source-{uuid.uuid4().hex}/{name}"


def _put(spark: SparkSession, name: str, data: bytes) -> str:
    return samples.put(spark, _at(spark, name), data)


# Where nations, suppliers and parts are said to be.
def _nations(spark: SparkSession, sf_dir: str) -> list[samples.Feature]:
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    return [({"name": r["n_name"]}, float(r["n_nationkey"] * 3 - 20), float(r["n_nationkey"] * 2 - 10)) for r in rows]


NATIONS = "SELECT n_name AS name, CAST(n_nationkey * 3 - 20 AS DOUBLE) AS x, CAST(n_nationkey * 2 - 10 AS DOUBLE) AS y, 'EPSG:4326' AS crs FROM nation"
SUPPLIERS = "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(s_suppkey % 360 - 179.5 AS DOUBLE) AS x, CAST(s_suppkey % 170 - 84.5 AS DOUBLE) AS y, 'EPSG:4326' AS crs FROM supplier"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.cast("string").alias("id"), F.col("s_name").alias("name"), G.point(k % 360 - 179.5, k % 170 - 84.5).alias("geom"))


def _places(spark: SparkSession, ref: str, *names: str) -> DataFrame:
    """The named properties of a source's features, the first vertex of each, and the CRS that is reported."""
    got = materialize(spark, ref)
    first = F.element_at(G.vertices(F.col("geom")), 1)
    value = (lambda n: F.try_element_at("properties", F.lit(n))) if "properties" in got.df.columns else F.col
    return got.df.select(*[value(n).alias(n) for n in names], first["x"].alias("x"), first["y"].alias("y"), F.lit(got.crs).alias("crs"))


@query(SUPPLIERS)
def source_geojsonseq(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark, "s.geojsonl")
    vector.write_geojsonseq(_suppliers(spark, sf_dir), at)
    return _places(spark, at, "id", "name")


@query("SELECT s_name AS name, CAST(s_suppkey % 360 - 179.5 AS DOUBLE) AS x, CAST(s_suppkey % 170 - 84.5 AS DOUBLE) AS y, 'EPSG:4326' AS crs FROM supplier")
def source_csv_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark, "s.csv")
    _suppliers(spark, sf_dir).select("name", F.col("geom.parts")[0][0][0]["x"].alias("lon"), F.col("geom.parts")[0][0][0]["y"].alias("lat")).write.csv(at, header=True)
    return _places(spark, at, "name")


@query(NATIONS)
def source_excel_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p["name"], x, y) for p, x, y in _nations(spark, sf_dir)]
    return _places(spark, _put(spark, "n.xlsx", samples.xlsx(("name", "lon", "lat"), rows)), "name")


@query(NATIONS)
def source_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, _put(spark, "n.geojson", samples.geojson(_nations(spark, sf_dir))), "name")


@query(NATIONS)
def source_topojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, _put(spark, "n.topojson", samples.topojson(_nations(spark, sf_dir))), "name")


@query(NATIONS)
def source_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, f"{_put(spark, 'n.gpx', samples.gpx(_nations(spark, sf_dir)))}::waypoints", "name")


@query(NATIONS)
def source_kmz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, _put(spark, "n.kmz", samples.kmz(_nations(spark, sf_dir))), "name")


@query(NATIONS.replace("4326", "32611"))
def source_shapefile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a .prj, whose CRS is reported."""
    base = _at(spark, "n")
    for end, data in samples.shapefile(_nations(spark, sf_dir), 'PROJCS["WGS_1984_UTM_Zone_11N",GEOGCS["GCS_WGS_1984"]]').items():
        samples.put(spark, f"{base}.{end}", data)
    return _places(spark, f"{base}.shp", "name")


def _database(spark: SparkSession, name: str, statements: list[tuple[str, list[tuple]]]) -> str:
    """A SQLite file by its bytes."""
    db = sqlite3.connect(":memory:")
    for sql, rows in statements:
        if rows:
            db.executemany(sql, rows)
        else:
            db.execute(sql)
    db.commit()
    return _put(spark, name, db.serialize())


@query(NATIONS.replace("4326", "32610"))
def source_geopackage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p["name"], codecs.to_geopackage(("Point", [[[(x, y)]]]), 32610)) for p, x, y in _nations(spark, sf_dir)]
    at = _database(
        spark,
        "n.gpkg",
        [
            ("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER)", []),
            ("INSERT INTO gpkg_spatial_ref_sys VALUES ('u', 32610, 'EPSG', 32610)", []),
            ("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)", []),
            ("INSERT INTO gpkg_geometry_columns VALUES ('other', 'g', 'POINT', 32610, 0, 0), ('n', 'geom', 'POINT', 32610, 0, 0)", []),
            ("CREATE TABLE n (name TEXT, geom BLOB)", []),
            ("INSERT INTO n VALUES (?, ?)", rows),
        ],
    )
    return _places(spark, f"{at}::n", "name")


@query(NATIONS)
def source_spatialite(spark: SparkSession, sf_dir: str) -> DataFrame:
    blob = lambda x, y: b"\x00\x01" + struct.pack("<i4d", 4326, x, y, x, y) + b"\x7c" + struct.pack("<i2d", 1, x, y) + b"\xfe"
    rows = [(p["name"], blob(x, y)) for p, x, y in _nations(spark, sf_dir)]
    return _places(spark, _database(spark, "n.sqlite", [("CREATE TABLE geometry_columns (f_table_name TEXT, f_geometry_column TEXT, srid INTEGER)", []), ("INSERT INTO geometry_columns VALUES ('n', 'geom', 4326)", []), ("CREATE TABLE n (name TEXT, geom BLOB)", []), ("INSERT INTO n VALUES (?, ?)", rows)]), "name")


@query(NATIONS.replace("4326", "32610"))
def source_geoparquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import io
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = _nations(spark, sf_dir)
    meta = {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "crs": {"id": {"authority": "EPSG", "code": 32610}}}}}
    table = pa.table({"name": [p["name"] for p, _, _ in rows], "geometry": pa.array([codecs.to_wkb(("Point", [[[(x, y)]]])) for _, x, y in rows], pa.binary())})
    out = io.BytesIO()
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(meta)}), out)
    return _places(spark, _put(spark, "n.parquet", out.getvalue()), "name")


@query("SELECT CAST(n_nationkey * 3 - 20 AS DOUBLE) AS x, CAST(n_nationkey * 2 - 10 AS DOUBLE) AS y, CAST(n_nationkey / 4.0 AS DOUBLE) AS z, CAST(n_regionkey AS BIGINT) AS intensity FROM nation")
def source_las(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()
    at = _put(spark, "n.las", samples.las([(k * 3.0 - 20, k * 2.0 - 10, k / 4, r) for k, r in rows]))
    return vector.read_las(spark, at).select("x", "y", "z", F.col("intensity").cast("bigint").alias("intensity"))


@query("SELECT 'png' AS format, CAST(3 AS INT) AS z, CAST(n_nationkey % 8 AS INT) AS x, CAST(n_nationkey // 8 AS INT) AS y FROM nation")
def source_mbtiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tiles as the file has them, counted from the south."""
    tiles = [(3, k % 8, k // 8, b"\x89PNG" + bytes([k])) for (k,) in read(spark, sf_dir, "nation").select("n_nationkey").collect()]
    at = _database(spark, "n.mbtiles", [("CREATE TABLE metadata (name TEXT, value TEXT)", []), ("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)", []), ("INSERT INTO tiles VALUES (?, ?, ?, ?)", tiles)])
    return raster.read_mbtiles(spark, at).select("format", "z", "x", "y")


# Rasters of part prices; every 13th has no value.
PARTS = f"SELECT CAST(floor(p_partkey / {PW}) AS INT) AS row, CAST(p_partkey % {PW} AS INT) AS col, p_retailprice AS value FROM part WHERE p_partkey % 13 <> 0"


def _prices(spark: SparkSession, sf_dir: str) -> tuple[Grid, np.ndarray]:
    cells, grid = small_dem(spark, sf_dir, nodata=-9999.0)
    return grid, raster.collect_bands(cells, grid)


def _known(spark: SparkSession, ref: str) -> DataFrame:
    return materialize(spark, ref).df.where("value IS NOT NULL").select("row", "col", "value")


@query(PARTS)
def source_cog(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, bands = _prices(spark, sf_dir)
    return _known(spark, _put(spark, "p.tif", raster.write_tiff(grid, bands, 16)))


@query(PARTS)
def source_netcdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, bands = _prices(spark, sf_dir)
    return _known(spark, f"{_put(spark, 'p.nc', samples.netcdf('price', np.arange(grid.width) + 0.5, grid.height - np.arange(grid.height) - 0.5, bands[0], -9999.0))}::price")


@query(PARTS)
def source_zarr(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bands = _prices(spark, sf_dir)
    base = _at(spark, "p.zarr")
    for name, data in samples.zarr(bands[0], (16, 16), -9999.0).items():
        samples.put(spark, f"{base}/price/{name}", data)
    return _known(spark, base)


def _stack(spark: SparkSession, sf_dir: str, chunk: int) -> bytes:
    grid, bands = _prices(spark, sf_dir)
    a = np.where(bands[0] == -9999.0, np.nan, bands[0])
    return samples.hdf5_file({"g/price": a, "g/x": np.arange(grid.width) + 0.5, "g/y": grid.height - np.arange(grid.height) - 0.5, "g/mask": np.isnan(a[:4]).astype("i4")}, chunk, {"g/price": {"coordinates": "x y"}, "": {"crs": "EPSG:32610"}})


@query(PARTS)
def source_hdf5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest array of a chunked, compressed file."""
    return _known(spark, _put(spark, "p.h5", _stack(spark, sf_dir, 8)))


@query(PARTS)
def source_netcdf4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, f"{_put(spark, 'p.nc', _stack(spark, sf_dir, 0))}::g/price")


@query(PARTS.replace("SELECT", "SELECT b AS band,").replace("FROM part", "FROM part, (VALUES (1), (2)) AS t(b)"))
def source_fof_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bands = _prices(spark, sf_dir)
    a = np.where(bands[0] == -9999.0, np.nan, bands[0])
    cells, _ = swot.read_stack(spark, _put(spark, "f.nc", samples.hdf5_file({"a": a, "b": np.stack([a, a * 0]), "x": np.arange(PW) + 0.0})))
    return cells.where("value IS NOT NULL").select("band", "row", "col", "value")


@query("SELECT CAST(n_nationkey AS BIGINT) AS ordinal, CAST(n_nationkey * 3 - 20 AS DOUBLE) AS longitude, CAST(n_nationkey * 2 - 10 AS DOUBLE) AS latitude, CAST(n_regionkey * 1.5 AS DOUBLE) AS height FROM nation")
def source_pixc(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = np.array(sorted(tuple(r) for r in read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()), dtype=float)
    k, r = keys.T
    cloud = {"longitude": k * 3 - 20, "latitude": k * 2 - 10, "sig0": k, "height": r * 1.5, "water_frac": k * 0, "classification": k * 0 + 4}
    return swot.read_cloud(spark, _put(spark, "c.nc", samples.hdf5_file({f"pixel_cloud/{n}": v for n, v in cloud.items()}, 4))).select("ordinal", "longitude", "latitude", "height")


@query("SELECT CAST(i // 61 AS INT) AS row, CAST(i % 61 AS INT) AS col, CAST(i * 7 % 1000 AS DOUBLE) AS value FROM range(61 * 61) t(i) WHERE i % 100 <> 3")
def source_hgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = np.arange(61 * 61)
    return _known(spark, _put(spark, "N37W122.hgt", np.where(i % 100 == 3, -32768, i * 7 % 1000).astype(">i2").tobytes()))


@query("SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region")
def source_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file must lie where DuckDB can open it: a folder that is mounted everywhere."""
    import duckdb

    folder = _at(spark, "").replace("file:", "", 1).rstrip("/")
    samples.put(spark, f"{folder}/mark", b"")
    rows = [tuple(r) for r in read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()]
    with duckdb.connect(f"{folder}/d.duckdb") as db:
        db.execute("CREATE TABLE r (k BIGINT, name VARCHAR)")
        db.executemany("INSERT INTO r VALUES (?, ?)", rows)
    return materialize(spark, f"{folder}/d.duckdb::SELECT k, name FROM r").df


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_suppkey % 360 BETWEEN 20 AND 200 AND s_suppkey % 170 BETWEEN 10 AND 100")
def source_overture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a bounding box that reaches the Parquet scan."""
    base, k = _at(spark, "overture"), F.col("s_suppkey")
    x, y = (k % 360).cast("double"), (k % 170).cast("double")
    rows = read(spark, sf_dir, "supplier").select(k.cast("string").alias("id"), F.struct(x.alias("xmin"), x.alias("xmax"), y.alias("ymin"), y.alias("ymax")).alias("bbox"))
    rows.write.parquet(f"{base}/2024-01-17.0/theme=places/type=place")
    return remote.read_overture(spark, "overture://places/place", base, "2024-01-17.0", (20.0, 10.0, 200.0, 100.0), None).select("id")


@query("SELECT r_name AS id, 'c' || r_regionkey AS collection, CAST(r_regionkey AS DOUBLE) AS xmin, 'http://h/' || r_regionkey || '.tif' AS href FROM region")
def source_stac(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    rows = read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()
    items = [{"id": n, "collection": f"c{k}", "bbox": [k, 0, k + 1, 1], "properties": {"datetime": "2024-01-01T00:00:00Z"}, "assets": {"meta": {"href": "m"}, "data": {"href": f"http://h/{k}.tif"}}} for k, n in rows]
    found = remote.stac_items(spark, [json.dumps({"features": items[:2]}), json.dumps({"features": items[2:]})])
    return found.select("id", "collection", "xmin", F.col("assets")[remote.stac_asset(items[0])].alias("href"))


# References, their kinds and their readers, best first.
ROUTED = (
    ("https://h/a.tif", "remote_uri", "cog,object_store"), ("s3://b/a.csv", "remote_uri", "object_store"), ("ftp://h/a.zip", "remote_uri", ""), ("SELECT 1", "database_ref", "postgis"), ("a.duckdb::t", "duckdb", "duckdb"),
    ("/a/b.tif", "local_raster", "cog,local_file"), ("./b.gpkg::l", "local_vector", "geopackage,local_file"), ("x/b.csv", "local_table", "csv_xy,local_file"), ("c/item::red", "catalog_item", "stac"), ("public.roads", "database_ref", "postgis"),
    ("data.h5", "local_raster", "hdf5,local_file"), ("wms::https://h/ows::a.b", "catalog_item", "ogc,stac"), ("overture://places/place", "catalog_item", "overture,stac"), ("x.zarr::t", "local_raster", "zarr,local_file"), ("word", "unknown", ""),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in ROUTED) + ") AS t(ref, kind, readers)")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    router = default_router()
    return spark.createDataFrame([(ref, str(SourceRef.infer(ref).kind), ",".join(router.select(ref))) for ref, _, _ in ROUTED], "ref string, kind string, readers string")


@query(
    f"""WITH cells AS (SELECT p_retailprice AS v FROM part), n AS (SELECT count(*) AS n FROM cells)
SELECT * FROM (SELECT 'valid_range' AS name, CASE WHEN count(CASE WHEN v NOT BETWEEN 0 AND 1500 THEN 1 END) = 0 THEN 'VALID' ELSE 'INVALID' END AS state FROM cells
UNION ALL SELECT 'row_count_matches', 'VALID' UNION ALL SELECT 'crs_valid', 'VALID' UNION ALL SELECT 'extent_sane', 'VALID' UNION ALL SELECT 'dimensions_sane', CASE WHEN max(p_partkey) // {PW} + 1 <= 10 THEN 'VALID' ELSE 'INVALID' END FROM part)"""
)
def check_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = small_dem(spark, sf_dir)
    d = raster_dataset("prices", cells, grid)
    found = [checks.valid_range(cells, 0, 1500), checks.row_count_matches(cells, cells.count()), checks.crs_valid(d), checks.extent_sane(d), checks.dimensions_sane(Grid(1, grid.height), most=10)]
    return spark.createDataFrame([(v.check, v.state.name) for v in found], "name string, state string")


@query(
    f"SELECT CAST(max(p_partkey) // {PW} + 1 AS DOUBLE) AS height, 'completed' AS status, 'slope' AS operation, 3 AS checks, count(*) AS cells FROM part",
)
def executor_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator by its name, with parameters from texts, run and described."""
    cells, grid = small_dem(spark, sf_dir)
    run = Executor().submit("slope", [raster_dataset("prices", cells, grid)], {"units": "percent"})
    out = run.output
    assert get_operator("slope").output == out.kind
    return out.df.agg(F.lit(out.extent[3]).alias("height"), F.lit(run.status).alias("status"), F.lit(out.operation).alias("operation"), F.lit(len(out.verdicts)).alias("checks"), F.count(F.lit(1)).alias("cells"))


@query("SELECT n_regionkey AS region, CAST(min(n_nationkey) AS DOUBLE) AS xmin, CAST(max(n_nationkey) + 1 AS DOUBLE) AS xmax, CAST(min(n_regionkey) AS DOUBLE) AS ymin, CAST(max(n_regionkey) + 2 AS DOUBLE) AS ymax, count(*) AS n FROM nation GROUP BY 1")
def vector_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents and counts of features, by group."""
    k, r = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    boxes = read(spark, sf_dir, "nation").select("n_regionkey", G.bbox(G.box(k, r, k + 1, r + 2)).alias("b"))
    return boxes.groupBy(F.col("n_regionkey").alias("region")).agg(F.min("b.xmin").alias("xmin"), F.max("b.xmax").alias("xmax"), F.min("b.ymin").alias("ymin"), F.max("b.ymax").alias("ymax"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS k, 'POINT (' || CAST(n_nationkey AS DOUBLE) || ' ' || CAST(n_regionkey * 0.5 AS DOUBLE) || ')' AS wkt, CAST(n_nationkey AS DOUBLE) AS x, CAST(n_regionkey * 0.5 AS DOUBLE) AS y FROM nation")
def geometry_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as WKT, through GeoJSON and WKB and back."""
    p = G.point(F.col("n_nationkey").cast("double"), F.col("n_regionkey") * 0.5)
    there = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), G.to_wkt(p).alias("wkt"), vector.decode_wkb(vector.encode_wkb(G.from_geojson(G.to_geojson(p)))).alias("back"))
    first = F.element_at(G.vertices(F.col("back")), 1)
    return there.select("k", "wkt", first["x"].alias("x"), first["y"].alias("y"))


@query(f"SELECT CAST(count(*) AS DOUBLE) AS total FROM orders WHERE o_orderkey % 17 <> 0")  # noqa: F541
def accumulated_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reaches outlets and pits, of directions without filling, is the number of valid cells."""
    cells, grid = dem(spark, sf_dir)
    codes = hydrology.d8_flow_direction(cells, grid)
    codes = codes[0] if isinstance(codes, tuple) else codes
    acc = hydrology.flow_accumulation(codes, grid)
    acc = acc[0] if isinstance(acc, tuple) else acc
    keys = ["raster_id", "band", "row", "col"]
    ends = codes.where("value >= 8").select(*keys)
    return acc.join(ends, keys).agg(F.sum("value").alias("total"))


@query(f"SELECT n_name AS zone, count(p_partkey) AS n FROM nation LEFT JOIN part ON p_partkey % {PW} >= n_nationkey AND p_partkey % {PW} < n_nationkey + 2 GROUP BY 1")
def zonal_counts_by_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that overlap, each a strip two columns wide over the whole raster."""
    cells, grid = small_dem(spark, sf_dir)
    k = F.col("n_nationkey").cast("double")
    strips = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("fid"), "n_name", G.box(k, F.lit(0.0), k + 2, F.lit(float(grid.height))).alias("geom"))
    return spatial.zonal_stats(cells, strips, grid, zone_id_field="n_name").select(F.col("zone_id").alias("zone"), F.col("count").cast("bigint").alias("n"))
