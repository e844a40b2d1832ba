import json

import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions.raster import Grid
from terraloom.sources import codecs, raster, remote, vector

SQUARE = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
HOLE = [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]
SHAPES = [("Point", [[[(1.0, 2.0)]]]), ("LineString", [[[(0.0, 0.0), (1.0, 1.0)]]]), ("Polygon", [[SQUARE, HOLE]]), ("MultiPoint", [[[(1.0, 1.0)]], [[(2.0, 2.0)]]]), ("MultiLineString", [[[(0.0, 0.0), (1.0, 0.0)]], [[(5.0, 5.0), (6.0, 6.0)]]]), ("MultiPolygon", [[SQUARE], [[(9.0, 9.0), (9.0, 10.0), (10.0, 10.0), (9.0, 9.0)]]])]


def shape_of(row):
    return None if row is None else (row["type"], [[[(v["x"], v["y"]) for v in r] for r in p] for p in row["parts"]])


@pytest.mark.parametrize("shape", SHAPES, ids=lambda s: s[0])
def test_wkb(shape):
    assert codecs.from_wkb(codecs.to_wkb(shape)) == shape
    assert codecs.from_geopackage(codecs.to_geopackage(shape, 4326)) == shape


def test_wkb_forms():
    assert codecs.from_wkb(b"\x00" + struct.pack(">I2d", 1, 3, 4)) == ("Point", [[[(3, 4)]]])
    assert codecs.from_wkb(b"\x01" + struct.pack("<I3d", 1001, 3, 4, 5)) == ("Point", [[[(3, 4)]]])
    assert codecs.from_wkb(b"\x01" + struct.pack("<II3d", 0xA0000001, 4326, 3, 4, 5)) == ("Point", [[[(3, 4)]]])
    assert codecs.from_wkb(None) is None and codecs.from_wkb(codecs.to_wkb(("Point", []))) == ("Point", [])


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": 1, "b": "x"}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}}, {"type": "Feature", "properties": {"a": None}, "geometry": None}]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    rows = vector.spread(vector.read_geojson(spark, str(tmp_path / "f.geojson")), types={"a": "int"}).orderBy("fid").collect()
    assert (rows[0]["a"], rows[0]["b"], shape_of(rows[0]["geom"])) == (1, "x", ("Polygon", [[SQUARE]])) and rows[1]["a"] is None and rows[1]["geom"] is None


def test_geojsonseq_skips_bad_lines_and_round_trips(spark, tmp_path):
    good = '{"type":"Feature","properties":{"n":"a"},"geometry":{"type":"Point","coordinates":[1,2,9]}}'
    (tmp_path / "f.geojsonl").write_text(f"{good}\nnot json\n\x1e{good}\n[1]\n")
    df = vector.read_geojsonseq(spark, str(tmp_path / "f.geojsonl"))
    rows = df.collect()
    assert len(rows) == 2 and shape_of(rows[0]["geom"]) == ("Point", [[[(1, 2)]]]) and rows[0]["properties"] == {"n": "a"}
    vector.write_geojsonseq(vector.spread(df).select("n", "geom"), str(tmp_path / "out"))
    back = vector.read_geojsonseq(spark, str(tmp_path / "out")).collect()
    assert sorted(r["properties"]["n"] for r in back) == ["a", "a"]


def test_topojson(spark, tmp_path):
    doc = {
        "type": "Topology", "transform": {"scale": [0.5, 0.5], "translate": [10, 20]}, "arcs": [[[0, 0], [4, 0], [0, 4]], [[4, 4], [-4, 0], [0, -4]], [[0, 0], [2, 2]]],
        "objects": {"a": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "arcs": [[0, 1]], "properties": {"n": "p"}, "id": 7}, {"type": "LineString", "arcs": [-3]}]}, "b": {"type": "Point", "coordinates": [3, 4]}},
    }
    (tmp_path / "t.topojson").write_text(json.dumps(doc))
    rows = vector.read_topojson(spark, str(tmp_path / "t.topojson")).orderBy("fid").collect()
    assert shape_of(rows[0]["geom"]) == ("Polygon", [[[(10, 20), (12, 20), (12, 22), (10, 22), (10, 20)]]]) and rows[0]["properties"] == {"n": "p", "id": "7"}
    assert shape_of(rows[1]["geom"]) == ("LineString", [[[(11, 21), (10, 20)]]]) and shape_of(rows[2]["geom"]) == ("Point", [[[(3, 4)]]])
    assert vector.read_topojson(spark, f"{tmp_path / 't.topojson'}::b").count() == 1


def test_gpx(spark, tmp_path):
    (tmp_path / "g.gpx").write_text('<gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1" lon="2"><name>w</name></wpt><trk><name>t</name><trkseg><trkpt lat="0" lon="0"/><trkpt lat="1" lon="1"/></trkseg></trk></gpx>')
    one = vector.read_gpx(spark, str(tmp_path / "g.gpx")).collect()
    assert one[0]["layer"] == "tracks" and shape_of(one[0]["geom"]) == ("MultiLineString", [[[(0, 0), (1, 1)]]])
    assert vector.read_gpx(spark, f"{tmp_path / 'g.gpx'}::waypoints").collect()[0]["properties"] == {"name": "w"}
    assert vector.read_gpx(spark, f"{tmp_path / 'g.gpx'}::track_points").count() == 2


def test_kmz(spark, tmp_path):
    kml = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>a</name><Point><coordinates>1,2,0</coordinates></Point></Placemark><Folder><Placemark><ExtendedData><Data name="k"><value>v</value></Data></ExtendedData><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 0,1 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Folder></Document></kml>'
    with zipfile.ZipFile(tmp_path / "k.kmz", "w") as z:
        z.writestr("other.kml", kml)
    rows = vector.read_kmz(spark, str(tmp_path / "k.kmz")).orderBy("fid").collect()
    assert shape_of(rows[0]["geom"]) == ("Point", [[[(1, 2)]]]) and rows[1]["properties"] == {"k": "v"} and rows[1]["geom"]["type"] == "Polygon"


def test_geopackage(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", codecs.row(SHAPES[2])), (2, None, codecs.row(SHAPES[0])), (3, "c", None)], vector.T.StructType([vector.T.StructField("id", vector.T.LongType()), vector.T.StructField("name", vector.T.StringType()), vector.T.StructField("geom", vector.GEOMETRY_TYPE)]))
    path = str(tmp_path / "g.gpkg")
    vector.write_geopackage(df, path, "things")
    rows = {r["properties"]["id"]: r for r in vector.read_geopackage(spark, path).collect()}
    assert shape_of(rows["1"]["geom"]) == SHAPES[2] and shape_of(rows["2"]["geom"]) == SHAPES[0] and rows["3"]["geom"] is None and rows["2"]["properties"]["name"] is None
    with pytest.raises(Exception, match="no layer"):
        vector.read_geopackage(spark, f"{path}::none").collect()


def test_spatialite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "s.sqlite")
    db.execute("CREATE TABLE geometry_columns (f_table_name TEXT, f_geometry_column TEXT)")
    db.execute("INSERT INTO geometry_columns VALUES ('t', 'geom')")
    db.execute("CREATE TABLE t (id INTEGER, geom BLOB)")
    blob = b"\x00\x01" + struct.pack("<i4d", 4326, 1, 2, 1, 2) + b"\x7c" + struct.pack("<i2d", 1, 1, 2) + b"\xfe"
    db.execute("INSERT INTO t VALUES (1, ?)", (blob,))
    db.commit()
    db.close()
    r = vector.read_spatialite(spark, str(tmp_path / "s.sqlite")).collect()[0]
    assert shape_of(r["geom"]) == SHAPES[0] and r["properties"] == {"id": "1"}


def write_shapefile(base):
    def record(k, body):
        return struct.pack(">2i", k, len(body) // 2) + body

    ring = lambda r: struct.pack(f"<{2 * len(r)}d", *(c for p in r for c in p))
    parts = [SQUARE, HOLE]
    polygon = struct.pack("<i4d2i2i", 5, 0, 0, 2, 2, 2, sum(map(len, parts)), 0, len(SQUARE)) + b"".join(map(ring, parts))
    body = record(1, polygon) + record(2, struct.pack("<i", 0))
    head = struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    (base.parent / f"{base.name}.shp").write_bytes(head + body)
    (base.parent / f"{base.name}.shx").write_bytes(head)
    field = lambda n, t, w: n.ljust(11, "\0").encode() + t.encode() + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14
    rows = b" " + "é".encode("latin-1").ljust(5) + b"   42" + b" " + b"two  " + b"*****"
    dbf = struct.pack("<4BIHH20x", 3, 24, 1, 1, 2, 32 + 64 + 1, 11) + field("name", "C", 5) + field("n", "N", 5) + b"\r" + rows + b"\x1a"
    (base.parent / f"{base.name}.dbf").write_bytes(dbf)
    (base.parent / f"{base.name}.cpg").write_text("latin-1")


def test_shapefile(spark, tmp_path):
    write_shapefile(tmp_path / "x")
    rows = vector.read_shapefile(spark, str(tmp_path / "x.shp")).orderBy("fid").collect()
    assert shape_of(rows[0]["geom"]) == ("Polygon", [[SQUARE, HOLE]]) and rows[0]["properties"] == {"name": "é", "n": "42"}
    assert rows[1]["geom"] is None and rows[1]["properties"] == {"name": "two", "n": None}
    (tmp_path / "x.dbf").unlink()
    with pytest.raises(Exception):  # noqa: B017
        vector.read_shapefile(spark, str(tmp_path / "x.shp")).collect()


def test_las(spark, tmp_path):
    points = np.array([[100, 200, 300], [-100, 50, 0]], dtype="<i4")
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<IIBHI", head, 96, 227, 0, 0, 20, 2)
    struct.pack_into("<3d3d6d", head, 131, 0.01, 0.01, 0.1, 10, 20, 30, 11, 9, 22, 20.5, 60, 30)
    body = b"".join(p.tobytes() + struct.pack("<HBBbBH", 7, 0, 2, 0, 0, 1) for p in points)
    (tmp_path / "p.las").write_bytes(bytes(head) + body)
    rows = vector.read_las(spark, str(tmp_path / "p.las")).orderBy("fid").collect()
    assert (rows[0]["x"], rows[0]["y"], rows[0]["z"], rows[0]["intensity"], rows[0]["classification"]) == (11, 22, 60, 7, 2) and rows[1]["x"] == 9


@pytest.mark.parametrize(
    ("name", "text", "rows", "crs"),
    [
        ("a.csv", "name,lat,lon,value\na,2,1,x\nb,4,3,y\nc,6,5,z\n", 3, "EPSG:4326"), ("b.csv", "id,x,y,description\n1,5,6,q\n", 1, "EPSG:4326"), ("c.tsv", "name\tlatitude\tlongitude\tcategory\na\t1\t2\tz\n", 1, "EPSG:4326"),
        ("d.csv", "name,age,city\na,1,b\n", 1, None), ("e.csv", "lat,lon\n1,2\n,3\nx,4\n5,\n6,7\n", 2, "EPSG:4326"), ("f.csv", "name;lat;lon;value\na;1,5;2,5;3\nb;1.5;2.5;3\n", 1, "EPSG:4326"),
    ],
)
def test_csv(spark, tmp_path, name, text, rows, crs):
    (tmp_path / name).write_text(text)
    df, got = vector.read_csv_xy(spark, str(tmp_path / name))
    assert (df.count(), got) == (rows, crs) and ("geom" in df.columns) == (crs is not None)


def test_csv_named_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    df, crs = vector.read_csv_xy(spark, f"{tmp_path / 'a.csv'}::a,b")
    assert shape_of(df.collect()[0]["geom"]) == SHAPES[0] and crs == "EPSG:4326"
    assert vector.coordinate_columns(["X", "y_", "Long-itude"]) == ("Long-itude", "y_", "EPSG:4326")


def test_excel(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>lon</t></si><si><t>lat</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="AA1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2"><v>1</v></c><c r="B2"><v>2</v></c></row><row><c r="B3"><v>2</v></c></row></sheetData></worksheet>')
    df, crs = vector.read_excel_xy(spark, f"{tmp_path / 'x.xlsx'}::S")
    assert df.count() == 1 and crs == "EPSG:4326" and shape_of(df.collect()[0]["geom"]) == SHAPES[0]


def test_geoparquet(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    meta = {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "crs": {"id": {"authority": "EPSG", "code": 32610}}}}}
    t = pa.table({"name": ["a", "b"], "geometry": pa.array([codecs.to_wkb(SHAPES[0]), codecs.to_wkb(SHAPES[2])], pa.binary())})
    pq.write_table(t.replace_schema_metadata({"geo": json.dumps(meta)}), tmp_path / "g.parquet")
    pq.write_table(t.drop_columns("geometry"), tmp_path / "p.parquet")
    rows = vector.read_geoparquet(spark, str(tmp_path / "g.parquet")).orderBy("name").collect()
    assert [shape_of(r["geom"]) for r in rows] == [SHAPES[0], SHAPES[2]]
    assert vector.geoparquet_crs(vector.geo_metadata(spark, str(tmp_path / "g.parquet"))) == "EPSG:32610"
    assert vector.read_geoparquet(spark, str(tmp_path / "p.parquet")).columns == ["name"]
    back = vector.read_geoparquet(spark, str(tmp_path / "g.parquet")).select(vector.encode_wkb("geom").alias("w"))
    assert {bytes(r["w"]) for r in back.collect()} == {codecs.to_wkb(SHAPES[0]), codecs.to_wkb(SHAPES[2])}


@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32", "float64"])
@pytest.mark.parametrize("block", [0, 16])
def test_geotiff(spark, tmp_path, dtype, block):
    a = (np.arange(2 * 20 * 37).reshape(2, 20, 37) % 120).astype(dtype)
    g = Grid.from_bounds(500000, 4000000, 500370, 4000200, 37, 20, crs="EPSG:32610", nodata=5.0, bands=2)
    (tmp_path / "t.tif").write_bytes(raster.write_tiff(g, a, block))
    cells, got = raster.read_geotiff(spark, str(tmp_path / "t.tif"))
    assert got == g
    back = raster.collect_bands(cells, g)
    assert np.array_equal(back, a.astype(float)) and cells.where("value IS NULL").count() == (a == 5).sum()
    with pytest.raises(ValueError):
        raster.read_geotiff(spark, str(tmp_path / "t.tif"), strict_cog=True)


@pytest.mark.parametrize("block", [0, 16])
def test_large_geotiffs_are_read_by_ranges(spark, tmp_path, block, monkeypatch):
    """Blocks read one by one give what whole files do; files that can't be opened for ranges are read as a whole."""
    g = Grid.from_bounds(0, 0, 70, 45, 70, 45, crs="EPSG:32610", nodata=5.0, bands=2)
    for k in range(3):
        a = (np.arange(2 * 45 * 70).reshape(2, 45, 70) * (k + 1) % 211).astype("float32")
        (tmp_path / f"{k}.tif").write_bytes(raster.write_tiff(g, a, block if k < 2 else 16))
    sizes = sorted((tmp_path / f"{k}.tif").stat().st_size for k in range(3))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole, grid = raster.read_geotiff(spark, str(tmp_path))
    want = rows(whole)
    assert len(want) == 3 * 2 * 45 * 70
    for most in (0, sizes[1], sizes[1] - 1):
        cells, got = raster.read_geotiff(spark, str(tmp_path), whole_bytes=most)
        assert got == grid == g and rows(cells) == want
    monkeypatch.setattr(raster, "ranged", lambda path: None)
    assert rows(raster.read_geotiff(spark, str(tmp_path), whole_bytes=0)[0]) == want


def test_ranges(tmp_path):
    data = bytes(range(256)) * 1000
    (tmp_path / "f").write_bytes(data)
    got = raster.ranged(f"file:{tmp_path / 'f'}")
    assert len(got) == len(data) and all(got[a:b] == data[a:b] for a, b in ((0, 2), (65530, 65540), (5, 70000), (200000, 256000), (255990, 300000), (7, 7)))
    assert raster.ranged(str(tmp_path / "none")) is None and raster.ranged("nowhere://x/y") is None


def test_tiff_compressions():
    def lzw(data):
        bits, table, width, now = "", {bytes([i]): i for i in range(256)}, 9, b""
        size = 258
        put = lambda c: format(c, f"0{width}b")
        bits += put(256)
        for b in data:
            if now + bytes([b]) in table:
                now += bytes([b])
                continue
            bits += put(table[now])
            table[now + bytes([b])] = size
            size += 1
            width = 12 if size >= 2048 - 1 else 11 if size >= 1024 - 1 else 10 if size >= 512 - 1 else 9
            now = bytes([b])
        bits += put(table[now]) + put(257)
        return int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big")

    data = bytes(i * i % 7 for i in range(900))
    assert raster._packbits(b"\xfe\x07\x02abc\x80") == b"\x07\x07\x07abc"
    assert raster._lzw(lzw(data[:400])) == data[:400]


def test_netcdf(spark, tmp_path):
    def name(s):
        return struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)

    lat, lon, v = np.array([2.0, 1.0], ">f8"), np.array([10.0, 11.0, 12.0], ">f8"), np.array([[1, 2, -9], [4, 5, 6]], ">f4")
    fill = struct.pack(">2i", 12, 1) + name("_FillValue") + struct.pack(">2if", 5, 1, -9.0)
    none = struct.pack(">2i", 0, 0)

    def build(offsets):
        head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">2i", 10, 2) + name("lat") + struct.pack(">i", 2) + name("lon") + struct.pack(">i", 3) + none + struct.pack(">2i", 11, 3)
        for n, dims, attrs, kind, size, at in (("lat", [0], none, 6, 16, offsets[0]), ("lon", [1], none, 6, 24, offsets[1]), ("temp", [0, 1], fill, 5, 24, offsets[2])):
            head += name(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + attrs + struct.pack(">3i", kind, size, at)
        return head

    n = len(build([0, 0, 0]))
    (tmp_path / "a.nc").write_bytes(build([n, n + 16, n + 40]) + lat.tobytes() + lon.tobytes() + v.tobytes())
    cells, g = raster.read_netcdf(spark, str(tmp_path / "a.nc"))
    assert (g.width, g.height, g.a, g.e, g.c, g.f) == (3, 2, 1, -1, 9.5, 2.5)
    got = {(r["row"], r["col"]): r["value"] for r in cells.collect()}
    assert got[0, 0] == 1 and got[0, 2] is None and got[1, 2] == 6
    with pytest.raises(ValueError):
        raster.pick_variable({"a": {"dims": []}}, "b")


def test_zarr(spark, tmp_path):
    import zlib

    folder = tmp_path / "z.zarr" / "temp"
    folder.mkdir(parents=True)
    a = np.arange(30.0).reshape(5, 6)
    (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [5, 6], "chunks": [3, 4], "dtype": "<f8", "compressor": {"id": "zlib"}, "fill_value": 7.0, "order": "C", "filters": None}))
    for i in range(2):
        for j in range(2):
            block = np.full((3, 4), 7.0)
            part = a[3 * i : 3 * i + 3, 4 * j : 4 * j + 4]
            block[: part.shape[0], : part.shape[1]] = part
            (folder / f"{i}.{j}").write_bytes(zlib.compress(block.tobytes()))
    cells, g = raster.read_zarr(spark, str(tmp_path / "z.zarr"))
    got = {(r["row"], r["col"]): r["value"] for r in cells.collect()}
    assert (g.width, g.height) == (6, 5) and len(got) == 30 and got[1, 1] is None and all(got[i, j] == a[i, j] for (i, j) in got if a[i, j] != 7)


def test_hgt(spark, tmp_path):
    (tmp_path / "N37W122.hgt").write_bytes(np.array([[1, 2, 3], [4, -32768, 6], [7, 8, 9]], dtype=">i2").tobytes())
    cells, g = raster.read_hgt(spark, str(tmp_path / "N37W122.hgt"))
    assert g.extent == (-122.25, 36.75, -120.75, 38.25) and cells.where("value IS NULL").count() == 1


def test_mbtiles(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "m.mbtiles")
    db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
    db.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
    db.execute("INSERT INTO tiles VALUES (1, 0, 1, ?)", (b"\x89PNG....",))
    db.commit()
    db.close()
    r = raster.read_mbtiles(spark, str(tmp_path / "m.mbtiles")).collect()[0]
    assert (r["format"], r["z"], r["x"], r["y"]) == ("png", 1, 0, 1)


def test_duckdb(spark, tmp_path):
    import duckdb

    with duckdb.connect(str(tmp_path / "d.duckdb")) as db:
        db.execute("CREATE TABLE readings AS SELECT i AS station_id, i * 1.5::DOUBLE AS value, 'x' || i AS label FROM range(10) t(i)")
    ref = f"{tmp_path / 'd.duckdb'}::readings"
    assert remote.read_duckdb(spark, ref).count() == 10 and sorted(r["station_id"] for r in remote.read_duckdb(spark, ref, 3).collect()) == list(range(10))
    assert remote.read_duckdb(spark, f"{tmp_path / 'd.duckdb'}::SELECT label FROM readings WHERE value > 12").count() == 1


def test_overture(spark, tmp_path):
    base = f"{tmp_path}/o"
    df = spark.range(10).select(F.col("id"), F.struct(F.col("id").cast("double").alias("xmin"), (F.col("id") + 0.5).alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(1.0).alias("ymax")).alias("bbox"))
    df.write.parquet(f"{base}/2024-01-17.0/theme=places/type=place")
    got = remote.read_overture(spark, "overture://places/place", base, "2024-01-17.0", (2.0, -1.0, 5.0, 2.0))
    assert sorted(r["id"] for r in got.collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        remote.overture_path("overture://a", base, "2024-01-17.0")
    with pytest.raises(ValueError):
        remote.overture_path("overture://a/b", base, "latest")


def test_requests():
    assert remote.stac_ref("c/i::red") == ("c", "i", "red") and remote.stac_search((1, 2, 3, 4), query={"x": 1}) == {"bbox": [1, 2, 3, 4], "query": {"x": 1}, "limit": 20}
    assert remote.stac_asset({"assets": {"a": {}, "visual": {}}}) == "visual" and remote.stac_asset({"assets": {"a": {"href": "x.tif"}, "b": {}}}) == "a"
    with pytest.raises(ValueError):
        remote.stac_asset({"assets": {"a": {}, "b": {}}})
    url = remote.wms_url("wms::https://h/ows::l", (1, 2, 3, 4), 8192, 4096)
    assert "WIDTH=4096" in url and "HEIGHT=2048" in url and "BBOX=2%2C1%2C4%2C3" in url
    with pytest.raises(ValueError):
        remote.wms_url("wms::https://h::l", None)
    with pytest.raises(ValueError):
        remote.ogc_ref("wms::file:///x::l")
    assert "OUTPUTFORMAT=application%2Fgeo%2Bjson" in remote.wfs_url("wfs::http://h?a=1::l", formats=("text/gml", "application/geo+json"))
    topo = remote.opentopography_url("opentopo://SRTMGL1?-122&37&-121&38")
    assert "demtype=SRTMGL1" in topo and "API_Key" not in topo and "API_Key=k" in remote.opentopography_url("opentopo://COP30?0&0&1&1", "k")
    assert remote.store_path("s3://b/k") == "s3a://b/k" and remote.jdbc_options("u", "select 1;") == {"url": "u", "query": "select 1"}
    assert remote.jdbc_options("u", 's.t"x')["dbtable"] == '"s"."t""x"' and 'ST_AsBinary("g") AS geom' in remote.jdbc_options("u", "t", "g", ("a", "g"))["query"]
    assert raster.pick_dataset({"/a": (2, 3), "/b": (3, 2), "/lat": (9, 9)}, frozenset({"/lat"})) == "/a"


def test_stac_items(spark):
    page = json.dumps({"features": [{"id": "i", "collection": "c", "bbox": [0, 1, 2, 3], "properties": {"datetime": "2024-01-02T03:04:05Z"}, "assets": {"red": {"href": "h"}}}]})
    r = remote.stac_items(spark, [page]).collect()[0]
    assert (r["id"], r["xmax"], r["assets"]) == ("i", 2, {"red": "h"}) and r["datetime"].year == 2024
    assert remote.sentinel2_bands(spark).count() == 14 and remote.sentinel2_asset("b8a") == "nir08" and remote.sentinel2_asset("red") == "red"




class Flat:
    """A small writer of flat buffers: tables of (kind, value) by field number."""

    def __init__(self):
        self.out = bytearray()

    def put(self, raw, align):
        self.out += b"\0" * (-len(self.out) % align)
        self.out += raw
        return len(self.out) - len(raw)

    def table(self, fields):
        """The place of a table; what it refers to comes behind it."""
        size = 4 + 2 * len(fields)
        body, at = b"", {}
        for k, (kind, value) in enumerate(fields):
            if kind is None:
                continue
            raw = struct.pack("<I", 0) if kind in ("vector", "table", "tables") else struct.pack(f"<{kind}", value)
            body += b"\0" * (-(4 + len(body)) % len(raw))
            at[k] = 4 + len(body)
            body += raw
        vtable = struct.pack("<2H", size, 4 + len(body)) + b"".join(struct.pack("<H", at.get(k, 0)) for k in range(len(fields)))
        self.out += b"\0" * (-(len(self.out) + len(vtable)) % 8)
        v = self.put(vtable, 1)
        here = self.put(struct.pack("<i", len(vtable)) + body, 1)
        assert here - v == len(vtable)
        for k, (kind, value) in enumerate(fields):
            if kind == "vector":
                letter, items = value
                self.out += b"\0" * (-(len(self.out) + 4) % 8)
                raw = items if isinstance(items, bytes) else struct.pack(f"<{len(items)}{letter}", *items)
                there = self.put(struct.pack("<I", len(items)) + raw, 1)
            elif kind == "table":
                there = self.table(value)
            elif kind == "tables":
                there = self.put(struct.pack("<I", len(value)) + b"\0" * 4 * len(value), 4)
                for i, t in enumerate(value):
                    slot = there + 4 + 4 * i
                    struct.pack_into("<I", self.out, slot, self.table(t) - slot)
            else:
                continue
            struct.pack_into("<I", self.out, here + at[k], there - here - at[k])
        return here


def sized(fields):
    f = Flat()
    f.put(b"\0" * 4, 1)
    struct.pack_into("<I", f.out, 0, f.table(fields))
    return struct.pack("<I", len(f.out)) + bytes(f.out)


def flatgeobuf(index):
    text = lambda s: ("vector", ("B", s.encode()))
    none = (None, None)
    points = [(float(i), float(i % 7)) for i in range(40)]
    features = []
    for i, p in enumerate(points):
        props = struct.pack("<Hi", 0, i) + struct.pack("<HI", 1, 2) + f"n{i % 10}".encode()
        features.append(sized([("table", [none, ("vector", ("d", p))]), ("vector", ("B", props))]))
    offsets = [sum(map(len, features[:i])) for i in range(len(features))]
    tree = b""
    if index:
        level = [(x, y, x, y, o) for (x, y), o in zip(points, offsets, strict=True)]
        levels = [level]
        while len(level) > 1:
            level = [(min(n[0] for n in g), min(n[1] for n in g), max(n[2] for n in g), max(n[3] for n in g), 0) for g in (level[i : i + 4] for i in range(0, len(level), 4))]
            levels.append(level)
        tree = b"".join(struct.pack("<4dQ", *n) for lv in reversed(levels) for n in lv)
    columns = [[text("id"), ("B", 5)], [text("name"), ("B", 11)]]
    head = sized([text("layer"), none, ("B", 1), none, none, none, none, ("tables", columns), ("Q", len(points)), ("H", 4 if index else 0), ("table", [text("EPSG"), ("i", 4326)])])
    return b"fgb\x03fgb\x00" + head + tree + b"".join(features)


@pytest.mark.parametrize("index", [True, False])
def test_flatgeobuf(spark, tmp_path, index):
    from terraloom.sources.flatgeobuf import crs_of, read_flatgeobuf

    data = flatgeobuf(index)
    (tmp_path / "a.fgb").write_bytes(data)
    rows = read_flatgeobuf(spark, str(tmp_path / "a.fgb")).orderBy("fid").collect()
    assert len(rows) == 40 and rows[12]["properties"] == {"id": "12", "name": "n2"} and shape_of(rows[12]["geom"]) == ("Point", [[[(12, 5)]]])
    inside = read_flatgeobuf(spark, str(tmp_path / "a.fgb"), (10.0, 0.0, 20.0, 3.0)).collect()
    assert sorted(int(r["properties"]["id"]) for r in inside) == [i for i in range(10, 21) if i % 7 <= 3]
    assert crs_of(data) == "EPSG:4326"


def test_swot(spark):
    from terraloom.sources import swot

    m = swot.metadata({"tile_name": b"t", "cycle_number": np.array([7]), "near_range": np.array([5.0]), "swath_side": np.bytes_(b"L")}, radar=True)
    assert (m["tile_name"], m["cycle"], m["near_range_m"], m["swath_side"], m["pass_number"]) == ("t", 7, 5.0, "L", 0)
    assert swot.slc_catalogue(spark).count() == 6 and swot.slc_catalogue(spark, ["slc/slc_plus_y"]).collect()[0]["role"] == "data"
    with pytest.raises(ValueError):
        swot.slc_catalogue(spark, [])
    rows = [(0, 10.0, 40.0, 1.0, 2.0, 0.5, 4.0), (1, 10.05, 40.05, 5.0, 6.0, 0.6, 4.0), (2, 10.9, 40.9, 7.0, 8.0, 0.7, 3.0), (3, None, 40.0, 9.0, 9.0, 9.0, 9.0)]
    cells, g = swot.cloud_cells(spark.createDataFrame(rows, "ordinal long, longitude double, latitude double, sig0 double, height double, water_frac double, classification double"), 0.1)
    got = {(r["band"], r["row"], r["col"]): r["value"] for r in cells.collect()}
    assert (g.width, g.height, g.bands) == (9, 9, 4) and got[1, 8, 0] == 5 and got[2, 0, 8] == 8 and len(got) == 8
    names, bands = swot.stack_bands({"x": np.arange(3.0), "a": np.ones((2, 3)), "b": np.ones((4, 2, 3)), "y": np.arange(2.0)})
    assert names == ["a", "b"] and bands.shape == (2, 2, 3)
    assert swot.stack_grid({"lon": np.array([1.0, 3]), "lat": np.array([5.0, 6])}, bands).extent == (1, 5, 3, 6)
    with pytest.raises(ValueError):
        swot.stack_bands({"a": np.ones((2, 2))}, ["c"])


ARRAYS = {"x": np.arange(4.0) + 0.5, "y": 3 - np.arange(3.0) - 0.5, "g/data": np.arange(12, dtype="f4").reshape(3, 4), "g/deep/n": np.arange(24, dtype="i4").reshape(4, 6) - 7, "g/pairs": np.arange(24.0).reshape(3, 4, 2), "name": np.array([b"ab", b"c"])}


@pytest.mark.parametrize("chunk", [0, 2])
def test_hdf5(spark, tmp_path, chunk):
    from terraloom.sources import hdf5, samples

    data = samples.hdf5_file(ARRAYS, chunk, {"g/data": {"units": "m", "crs": "EPSG:32610"}, "": {"title": "all"}, "g": {"k": "v"}})
    found, groups = hdf5.opened(data)
    assert {k: v.read().tolist() for k, v in found.items()} == {k: v.tolist() for k, v in ARRAYS.items()}
    assert found["g/data"].attributes == {"units": "m", "crs": "EPSG:32610"} and groups == {"": {"title": "all"}, "g": {"k": "v"}, "g/deep": {}}
    (tmp_path / "a.h5").write_bytes(data)
    cells, grid = raster.read_hdf5(spark, f"{tmp_path / 'a.h5'}::/g/data")
    got = {(r["row"], r["col"]): r["value"] for r in cells.collect()}
    assert (grid.width, grid.height, grid.crs, grid.extent) == (4, 3, "EPSG:32610", (0, 0, 4, 3)) and got[2, 3] == 11
    # The largest array that isn't a coordinate; pairs are two bands.
    cells, grid = raster.read_hdf5(spark, str(tmp_path / "a.h5"))
    assert (grid.width, grid.height, grid.bands) == (6, 4, 1)
    cells, grid = raster.read_hdf5(spark, f"{tmp_path / 'a.h5'}::g/pairs")
    assert grid.bands == 2 and cells.where("band = 2 AND row = 0 AND col = 1").collect()[0]["value"] == 3
    with pytest.raises(Exception, match="no array"):
        raster.read_hdf5(spark, f"{tmp_path / 'a.h5'}::none")
    with pytest.raises(ValueError):
        hdf5.opened(b"not such a file")


def test_netcdf_of_version_4_and_packed_values(spark, tmp_path):
    from terraloom.sources import samples

    v = np.array([[1, 2, -9], [4, 5, 6]], dtype="i2")
    data = samples.hdf5_file({"t": v, "lon": np.array([10.0, 11, 12]), "lat": np.array([2.0, 1])}, 1)
    (tmp_path / "a.nc").write_bytes(data)
    cells, g = raster.read_netcdf(spark, f"{tmp_path / 'a.nc'}::t")
    assert (g.width, g.height, g.a, g.e, g.c, g.f, g.crs) == (3, 2, 1, -1, 9.5, 2.5, "EPSG:4326") and cells.count() == 6


@pytest.mark.parametrize(
    ("wkt", "crs"),
    [
        ('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32633"]]', "EPSG:32633"), ('GEOGCS["GCS_WGS_1984",DATUM["D"]]', "EPSG:4326"), ('PROJCS["WGS_1984_UTM_Zone_5S",GEOGCS["z"]]', "EPSG:32705"),
        ('PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",GEOGCS["z"]]', "EPSG:3857"), ('PROJCRS["x",ID["EPSG",2056]]', "EPSG:2056"), ('PROJCS["Somewhere",GEOGCS["z"]]', None), ("", None),
    ],
)
def test_crs_of_prj(wkt, crs):
    assert vector.wkt_crs(wkt) == crs


@pytest.fixture(scope="module")
def service():
    """A local server with a catalogue, features, maps, elevations and a file; it wants a key for the last."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlsplit

    a = np.arange(12.0).reshape(1, 3, 4)
    tiff = raster.write_tiff(Grid.from_bounds(0, 0, 4, 3, 4, 3, crs="EPSG:4326"), a)
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def send(self, data, kind="application/json", code=200):
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(data if isinstance(data, bytes) else json.dumps(data).encode())

        def item(self, k):
            return {"id": f"i{k}", "collection": "c", "bbox": [k, 0, k + 1, 1], "properties": {"datetime": "2024-01-02T03:04:05Z"}, "assets": {"red": {"href": f"{base}/a.tif", "type": "image/tiff"}, "other": {"href": "x"}}}

        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            k = body.get("page", 0)
            asked.append(body)
            self.send({"features": [self.item(2 * k), self.item(2 * k + 1)], "links": [{"rel": "next", "method": "POST", "href": f"{base}/search", "body": {"page": k + 1}}]})

        def do_GET(self):  # noqa: N802
            parts = urlsplit(self.path)
            q = {k.upper(): v[0] for k, v in parse_qs(parts.query).items()}
            if parts.path == "/a.tif":
                return self.send(tiff, "image/tiff")
            if parts.path.startswith("/collections/"):
                return self.send(self.item(7)) if parts.path.endswith("/i7") else self.send({}, code=404)
            if q.get("REQUEST") == "GetCapabilities":
                xml = "<W xmlns='http://x'><Capability><Request><GetMap><Format>image/png</Format><Format>image/tiff</Format></GetMap></Request><Layer><Title>all</Title><Layer><Name>l</Name><Title>L</Title></Layer></Layer></Capability></W>" if q["SERVICE"] == "WMS" else "<F xmlns='http://x' xmlns:o='http://o'><o:Operation name='GetFeature'><o:Parameter name='outputFormat'><o:AllowedValues><o:Value>GML</o:Value><o:Value>application/json</o:Value></o:AllowedValues></o:Parameter></o:Operation><FeatureType><Name>l</Name><Title>L</Title></FeatureType></F>"
                return self.send(xml.encode(), "text/xml")
            if q.get("REQUEST") == "GetMap":
                asked.append(q)
                return self.send(tiff, "image/tiff")
            if q.get("REQUEST") == "GetFeature":
                asked.append(q)
                return self.send({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "a"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]})
            if parts.path == "/dem":
                asked.append(q)
                return self.send(tiff, "application/octet-stream") if q.get("API_KEY") == "secret" else self.send({}, code=401)
            return self.send({}, code=404)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    base = f"http://127.0.0.1:{server.server_port}"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield base, asked
    server.shutdown()


def test_services(spark, service):
    from terraloom.plans.executor import materialize
    from terraloom.sources import services

    base, asked = service
    access = services.Access()
    total = lambda d: d.df.agg({"value": "sum"}).collect()[0][0]
    got = materialize(spark, f"{base}/a.tif")
    assert got.is_materialized and got.name == f"{base}/a.tif" and total(got) == 66
    found = services.stac_find(spark, access, base, (0.0, 0.0, 1.0, 1.0), collections=["c"], max_items=5)
    assert sorted(r["id"] for r in found.collect()) == ["i0", "i1", "i2", "i3", "i4"] and asked[0]["limit"] == 5
    item = materialize(spark, "c/i7::B04", endpoint=base)
    assert total(item) == 66 and json.loads(item.metadata)["item"] == "i7" and item.crs == "EPSG:4326"
    with pytest.raises(services.ServiceError, match="404"):
        materialize(spark, "c/none", endpoint=base)
    shown = materialize(spark, f"wms::{base}/ows::l", bbox=(0, 0, 4, 3), width=8192, height=4096)
    assert total(shown) == 66 and asked[-1]["FORMAT"] == "image/tiff" and (asked[-1]["WIDTH"], asked[-1]["HEIGHT"]) == ("4096", "2048")
    with pytest.raises(services.ServiceError, match="no layer"):
        materialize(spark, f"wms::{base}/ows::none", bbox=(0, 0, 4, 3))
    features = materialize(spark, f"wfs::{base}/ows::l", bbox=(0.0, 0.0, 5.0, 5.0), max_features=7)
    assert features.df.count() == 1 and asked[-1]["OUTPUTFORMAT"] == "application/json" and asked[-1]["COUNT"] == "7"
    assert [tuple(r) for r in services.discover_layers(spark, access, f"wfs::{base}/ows").collect()] == [("l", "L")]
    with pytest.raises(services.ServiceError, match="401"):
        materialize(spark, "opentopo://COP30?0&0&4&3", base=f"{base}/dem")
    access.authenticate("opentopography", "secret")
    tile = materialize(spark, "opentopo://COP30?0&0&4&3", access=access, base=f"{base}/dem")
    assert total(tile) == 66 and "secret" not in repr(tile.row()) and "secret" not in repr(access)


def test_services_on_the_command_line(spark, service, tmp_path, capsys):
    from terraloom import cli

    base, asked = service
    common = ["--registry", str(tmp_path / "r"), "--json"]
    assert cli.main([*common, "discover", f"wms::{base}/ows"], spark) == 0 and json.loads(capsys.readouterr().out) == [{"name": "l", "title": "L"}]
    assert cli.main([*common, "run", "slope", f"wms::{base}/ows::l", "-s", "bbox=0,0,4,3", "-s", "width=4", "-s", "height=3", "-o", str(tmp_path / "out")], spark) == 0
    assert asked[-1]["WIDTH"] == "4" and spark.read.parquet(str(tmp_path / "out")).count() == 12
    assert cli.main([*common, "run", "slope", "c/none", "-s", f"endpoint={base}"], spark) == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.tif").write_bytes(b"x")
    capsys.readouterr()
    assert cli.main([*common, "discover", str(tmp_path / "d")], spark) == 0 and json.loads(capsys.readouterr().out)[0]["reader"] == "cog"


def test_discovery(spark, tmp_path):
    import duckdb

    from terraloom.sources import services

    (tmp_path / "d").mkdir()
    for name in ("a.tif", "b.csv", "d/c.gpkg", "n.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[-1]: (r["kind"], r["reader"], r["size"]) for r in services.discover_files(spark, str(tmp_path)).collect()}
    assert got == {"a.tif": ("local_raster", "cog", 1), "b.csv": ("local_table", "csv_xy", 1), "c.gpkg": ("local_vector", "geopackage", 1)}
    with duckdb.connect(str(tmp_path / "d.duckdb")) as db:
        db.execute("CREATE TABLE t AS SELECT 1 AS x")
    assert [tuple(r) for r in services.discover_duckdb(spark, str(tmp_path / "d.duckdb")).collect()] == [("main", "t", 1)]
