"""Readers of vector files and tables: one row per feature, read by Spark from any file system.

A file's bytes come through Spark's binaryFile source and are parsed where they are; many files
are parsed side by side. All readers give (path, layer, fid, properties, geom): properties is a
map of texts, fid the order in the file. spread() makes columns of properties.
"""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from terraloom.functions.geometry import GEOMETRY, from_geojson, point
from terraloom.sources import codecs

_VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY_TYPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(_VERTEX))))])
FEATURES = f"path string, layer string, fid long, properties map<string,string>, geom {GEOMETRY}"
#: What a parser yields: (layer, properties, shape).
Feature = tuple[str, dict, codecs.Shape | None]
Parser = Callable[[bytes, str | None], Iterator[Feature]]


def split(ref: str) -> tuple[str, str | None]:
    """A path and what stands behind its ::, if anything."""
    path, _, rest = ref.strip().partition("::")
    return path, rest or None


def _text(v: object) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def parsed(spark: SparkSession, path: str, parse: Parser, layer: str | None = None) -> DataFrame:
    """Features of every file at a path (or glob), by a parser of whole files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path_, content in zip(f["path"], f["content"], strict=True):
                rows = [(path_, name, i, {str(k): _text(v) for k, v in props.items()}, codecs.row(shape)) for i, (name, props, shape) in enumerate(parse(bytes(content), layer))]
                for i in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[i : i + 5000], columns=["path", "layer", "fid", "properties", "geom"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, FEATURES)


def spread(features: DataFrame, names: list[str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """(fid, each property as a column, geom); without names, those that occur, in order of name."""
    if names is None:
        names = sorted(r[0] for r in features.select(F.explode(F.map_keys("properties"))).distinct().collect())
    kinds = types or {}
    column = lambda n: F.try_element_at("properties", F.lit(n))
    return features.select("fid", *[(column(n).try_cast(kinds[n]) if n in kinds else column(n)).alias(n) for n in names], "geom")


# GeoJSON, newline-delimited GeoJSON, TopoJSON.


def parse_geojson(data: bytes, layer: str | None = None) -> Iterator[Feature]:
    doc = json.loads(data.decode("utf-8-sig"))
    for f in doc.get("features", [doc] if doc.get("type") == "Feature" else []):
        yield "", f.get("properties") or {}, codecs.from_geojson(f.get("geometry"))


def read_geojson(spark: SparkSession, ref: str) -> DataFrame:
    return parsed(spark, split(ref)[0], parse_geojson)


def read_geojsonseq(spark: SparkSession, ref: str) -> DataFrame:
    """Lines of GeoJSON features, parsed in the JVM; lines that can't be read are left out."""
    lines = spark.read.text(split(ref)[0]).select(F.regexp_replace("value", "^\x1e", "").alias("v"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("fid"))
    kind = F.get_json_object("v", "$.type")
    props = F.from_json(F.get_json_object("v", "$.properties"), "map<string,string>")
    return lines.where(kind == "Feature").select("path", F.lit("").alias("layer"), "fid", F.coalesce(props, F.create_map().cast("map<string,string>")).alias("properties"), from_geojson(F.get_json_object("v", "$.geometry")).alias("geom"))


def parse_topojson(data: bytes, layer: str | None = None) -> Iterator[Feature]:
    """Objects of a topology: arcs are running sums, scaled and moved, ~i is arc i backwards."""
    doc = json.loads(data.decode("utf-8-sig"))
    t = doc.get("transform")
    arcs = []
    for a in doc.get("arcs", ()):
        p = np.array([q[:2] for q in a], dtype=float).reshape(-1, 2).cumsum(0) if t else np.array([q[:2] for q in a], dtype=float).reshape(-1, 2)
        arcs.append(p * t["scale"] + t["translate"] if t else p)

    def run(ids: list[int]) -> codecs.Ring:
        out: codecs.Ring = []
        for i in ids:
            a = arcs[i] if i >= 0 else arcs[~i][::-1]
            places = [tuple(map(float, p)) for p in a]
            out += places[1:] if out and places and out[-1] == places[0] else places
        return out

    def ring(ids: list[int]) -> codecs.Ring | None:
        r = run(ids)
        if r and r[0] != r[-1]:
            r.append(r[0])
        return r if len(r) >= 4 else None

    def polygon(p: list) -> list[codecs.Ring]:
        rings = [ring(x) for x in p]
        return [r for r in rings if r] if rings and rings[0] else []

    def shape(g: dict) -> codecs.Shape | None:
        kind, ids = g.get("type"), g.get("arcs")
        if kind in ("Point", "MultiPoint"):
            return codecs.from_geojson(g) if g.get("coordinates") else None
        if kind == "LineString":
            r = run(ids or [])
            return ("LineString", [[r]]) if len(r) >= 2 else None
        if kind == "MultiLineString":
            parts = [[r] for r in map(run, ids or []) if len(r) >= 2]
            return ("MultiLineString", parts) if parts else None
        if kind == "Polygon":
            p = polygon(ids or [])
            return ("Polygon", [p]) if p else None
        if kind == "MultiPolygon":
            parts = [p for p in map(polygon, ids or []) if p]
            return ("MultiPolygon", parts) if parts else None
        return None

    objects = doc.get("objects", {})
    if layer is not None and layer not in objects:
        raise ValueError(f"no object {layer!r}; there are {sorted(objects)}")
    for name, o in objects.items():
        if layer in (None, name):
            for g in o.get("geometries", [o]) if o.get("type") == "GeometryCollection" else [o]:
                props = dict(g.get("properties") or {})
                if "id" in g:
                    props.setdefault("id", g["id"])
                yield name, props, shape(g)


def read_topojson(spark: SparkSession, ref: str) -> DataFrame:
    path, name = split(ref)
    return parsed(spark, path, parse_topojson, name)


# XML: GPX and KML.

_LOCAL = re.compile(r"^\{[^}]*\}")


def _name(e: ElementTree.Element) -> str:
    return _LOCAL.sub("", e.tag)


def _kids(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [k for k in e if _name(k) == name]


def parse_gpx(data: bytes, layer: str | None = None) -> Iterator[Feature]:
    """waypoints, routes, tracks, route_points or track_points; by default the layer with most features."""
    root = ElementTree.fromstring(data)
    at = lambda e: (float(e.get("lon")), float(e.get("lat")))
    props = lambda e: {_name(k): k.text for k in e if not len(k) and k.text}
    layers: dict[str, list[Feature]] = {n: [] for n in ("tracks", "waypoints", "routes", "route_points", "track_points")}
    for w in _kids(root, "wpt"):
        layers["waypoints"].append(("waypoints", props(w), ("Point", [[[at(w)]]])))
    for i, r in enumerate(_kids(root, "rte")):
        p = _kids(r, "rtept")
        layers["routes"].append(("routes", props(r), ("LineString", [[[at(x) for x in p]]] if p else [])))
        layers["route_points"] += [("route_points", props(x) | {"route_fid": i}, ("Point", [[[at(x)]]])) for x in p]
    for i, t in enumerate(_kids(root, "trk")):
        segments = [[at(x) for x in _kids(s, "trkpt")] for s in _kids(t, "trkseg")]
        layers["tracks"].append(("tracks", props(t), ("MultiLineString", [[s] for s in segments if s])))
        layers["track_points"] += [("track_points", props(x) | {"track_fid": i, "track_seg_id": j}, ("Point", [[[at(x)]]])) for j, s in enumerate(_kids(t, "trkseg")) for x in _kids(s, "trkpt")]
    if layer is not None and layer not in layers:
        raise ValueError(f"layer must be one of {sorted(layers)}")
    main = ("tracks", "waypoints", "routes")
    yield from layers[layer or max(main, key=lambda n: (len(layers[n]), -main.index(n)))]


def read_gpx(spark: SparkSession, ref: str) -> DataFrame:
    path, name = split(ref)
    return parsed(spark, path, parse_gpx, name)


def parse_kml(data: bytes, layer: str | None = None) -> Iterator[Feature]:
    root = ElementTree.fromstring(data)
    run = lambda e: [tuple(map(float, c.split(",")[:2])) for x in e.iter() if _name(x) == "coordinates" for c in (x.text or "").split()]

    def shape(e: ElementTree.Element) -> codecs.Shape | None:
        kind = _name(e)
        if kind == "Point":
            return "Point", [[run(e)]]
        if kind in ("LineString", "LinearRing"):
            return "LineString", [[run(e)]]
        if kind == "Polygon":
            return "Polygon", [[run(b) for n in ("outerBoundaryIs", "innerBoundaryIs") for b in _kids(e, n)]]
        if kind == "MultiGeometry":
            each = [s for s in map(shape, e) if s]
            names = {s[0] for s in each}
            return (f"Multi{names.pop()}" if len(names) == 1 else "GeometryCollection"), [p for s in each for p in s[1]]
        return None

    for folder in root.iter():
        if _name(folder) in ("Document", "Folder", "kml"):
            label = next((k.text or "" for k in _kids(folder, "name")), "")
            for p in _kids(folder, "Placemark"):
                props = {_name(k): k.text for k in p if _name(k) in ("name", "description") and k.text}
                props |= {d.get("name"): next((v.text for v in d.iter() if _name(v) == "value"), None) for d in p.iter() if _name(d) == "Data"}
                props |= {d.get("name"): d.text for d in p.iter() if _name(d) == "SimpleData"}
                if layer in (None, label):
                    yield label, props, next((s for s in map(shape, p) if s), None)


def parse_kmz(data: bytes, layer: str | None = None) -> Iterator[Feature]:
    """doc.kml, or else the first .kml of the archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".kml")]
        if not names:
            raise ValueError("no .kml in the archive")
        yield from parse_kml(z.read("doc.kml" if "doc.kml" in names else names[0]), layer)


def read_kmz(spark: SparkSession, ref: str) -> DataFrame:
    path, name = split(ref)
    return parsed(spark, path, parse_kmz, name)


# SQLite: GeoPackage, SpatiaLite, MBTiles.


def opened(data: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    return db


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _sqlite(data: bytes, layer: str | None, catalogue: str, decode: Callable[[bytes | None], codecs.Shape | None]) -> Iterator[Feature]:
    db = opened(data)
    layers = dict(db.execute(catalogue).fetchall())
    if not layers:
        raise ValueError("no layer with a geometry")
    if layer is not None and layer not in layers:
        raise ValueError(f"no layer {layer!r}; there are {sorted(layers)}")
    name = layer or next(iter(layers))
    rows = db.execute(f"SELECT * FROM {quoted(name)}")
    names = [c[0] for c in rows.description]
    for r in rows:
        found = dict(zip(names, r, strict=True))
        blob = found.pop(layers[name], None)
        yield name, {k: v for k, v in found.items() if not isinstance(v, bytes)}, decode(blob)


def parse_geopackage(data: bytes, layer: str | None = None) -> Iterator[Feature]:
    return _sqlite(data, layer, "SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY rowid", codecs.from_geopackage)


def parse_spatialite(data: bytes, layer: str | None = None) -> Iterator[Feature]:
    return _sqlite(data, layer, "SELECT f_table_name, f_geometry_column FROM geometry_columns ORDER BY rowid", codecs.from_spatialite)


def read_geopackage(spark: SparkSession, ref: str) -> DataFrame:
    path, name = split(ref)
    return parsed(spark, path, parse_geopackage, name)


def read_spatialite(spark: SparkSession, ref: str) -> DataFrame:
    path, name = split(ref)
    return parsed(spark, path, parse_spatialite, name)


# Shapefiles.


def parse_shapes(data: bytes) -> Iterator[codecs.Shape | None]:
    """Shapes of a .shp file; heights and measures are left out."""
    at = 100
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body = at + 8
        at = body + 2 * words
        (kind,) = struct.unpack_from("<i", data, body)
        base = kind % 10
        if base == 1:
            yield "Point", [[[struct.unpack_from("<2d", data, body + 4)]]]
        elif base in (3, 5):
            parts, n = struct.unpack_from("<2i", data, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), n]
            v = struct.unpack_from(f"<{2 * n}d", data, body + 44 + 4 * parts)
            places = list(zip(v[::2], v[1::2], strict=True))
            rings = [places[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            if base == 3:
                yield ("LineString" if parts == 1 else "MultiLineString"), [[r] for r in rings]
            else:
                found = list(codecs.grouped(rings))
                yield ("Polygon" if len(found) == 1 else "MultiPolygon"), found
        elif base == 8:
            (n,) = struct.unpack_from("<i", data, body + 36)
            v = struct.unpack_from(f"<{2 * n}d", data, body + 40)
            yield "MultiPoint", [[[p]] for p in zip(v[::2], v[1::2], strict=True)]
        else:
            yield None


def parse_dbf(data: bytes, encoding: str = "utf-8") -> Iterator[dict]:
    """Records of a .dbf file; deleted ones are left out."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), chr(data[at + 11]), data[at + 16]))
        at += 32
    for i in range(n):
        at = head + i * size
        if data[at : at + 1] == b"*":
            continue
        at += 1
        out: dict = {}
        for name, kind, width in fields:
            raw = data[at : at + width].decode(encoding, "replace").strip("\0 ")
            at += width
            out[name] = None if not raw or set(raw) == {"*"} else {"T": True, "t": True, "Y": True, "y": True, "F": False, "f": False, "N": False, "n": False}.get(raw) if kind == "L" else raw
        yield out


def read_shapefile(spark: SparkSession, ref: str) -> DataFrame:
    """Features of .shp files with the .dbf beside each (required) and the encoding in a .cpg."""
    path = split(ref)[0]
    stem = F.regexp_replace("path", r"\.[A-Za-z]+$", "")
    base = path[:-4] if path.lower().endswith(".shp") else path
    files = spark.read.format("binaryFile").load([f"{base}.shp", f"{base}.dbf", *([f"{base}.cpg"] if _exists(spark, f"{base}.cpg") else [])])
    if not _exists(spark, f"{base}.dbf") or not _exists(spark, f"{base}.shx"):
        raise FileNotFoundError(f"{base}: .shx and .dbf must be beside the .shp")
    part = lambda e: F.max(F.when(F.lower("path").endswith(e), F.col("content"))).alias(e[1:])
    sets = files.groupBy(stem.alias("path")).agg(part(".shp"), part(".dbf"), part(".cpg"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                code = bytes(r.cpg).decode("ascii", "ignore").strip() if r.cpg is not None else "utf-8"
                rows = [(f"{r.path}.shp", "", i, {k: _text(v) for k, v in p.items()}, codecs.row(s)) for i, (s, p) in enumerate(zip(parse_shapes(bytes(r.shp)), parse_dbf(bytes(r.dbf), code or "utf-8"), strict=False))]
                yield pd.DataFrame(rows, columns=["path", "layer", "fid", "properties", "geom"])

    return sets.mapInPandas(run, FEATURES)


def wkt_crs(wkt: str) -> str | None:
    """EPSG text of a .prj: its own code, or one of the names for WGS84, its UTM zones and web Mercator; None for others."""
    codes = re.findall(r'(?:AUTHORITY\["EPSG",\s*"?|ID\["EPSG",\s*)(\d+)"?\]\s*\]\s*$', wkt.strip())
    if codes:
        return f"EPSG:{codes[-1]}"
    name = re.match(r'\s*\w+\["([^"]*)"', wkt)
    name = re.sub(r"[^a-z0-9]+", " ", name[1].lower()).strip() if name else ""
    if zone := re.search(r"wgs (?:19)?84 utm zone (\d+) ?([ns])", name):
        return f"EPSG:{(32600 if zone[2] == 'n' else 32700) + int(zone[1])}"
    return "EPSG:3857" if "web mercator" in name or "pseudo mercator" in name else "EPSG:4326" if re.fullmatch(r"(?:gcs )?wgs (?:19)?84", name) else None


def _first(spark: SparkSession, path: str, read: Callable[[bytes], str | None]) -> str | None:
    """What read() says of the first file at a path; the file is read by a task, and only the answer is sent."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "said": [read(bytes(x)) for x in f["content"]]})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, said string").orderBy("path").take(1)
    return rows[0]["said"] if rows else None


def _sqlite_crs(layer: str | None, query: str) -> Callable[[bytes], str | None]:
    def read(data: bytes) -> str | None:
        found = {name: (authority, code) for name, authority, code in opened(data).execute(query)}
        authority, code = found.get(layer) or next(iter(found.values()), (None, None))
        return f"{str(authority).upper()}:{code}" if authority and code and int(code) > 0 else None

    return read


def source_crs(spark: SparkSession, reader: str, ref: str) -> str | None:
    """The CRS of a vector source as its file says; None where the file doesn't say. Formats that are always in degrees need no look."""
    path, layer = split(ref)
    if reader == "shapefile":
        prj = f"{path[:-4] if path.lower().endswith('.shp') else path}.prj"
        return _first(spark, prj, lambda data: wkt_crs(data.decode("utf-8", "replace"))) if _exists(spark, prj) else None
    if reader == "geopackage":
        return _first(spark, path, _sqlite_crs(layer, "SELECT g.table_name, s.organization, s.organization_coordsys_id FROM gpkg_geometry_columns g JOIN gpkg_spatial_ref_sys s USING (srs_id) ORDER BY g.rowid"))
    if reader == "spatialite":
        return _first(spark, path, _sqlite_crs(layer, "SELECT f_table_name, 'EPSG', srid FROM geometry_columns ORDER BY rowid"))
    if reader == "flatgeobuf":
        from terraloom.sources.flatgeobuf import crs_of

        return _first(spark, path, crs_of)
    if reader == "geoparquet":
        meta = geo_metadata(spark, path)
        return geoparquet_crs(meta) if meta else "EPSG:4326"
    return None if reader == "las" else "EPSG:4326"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


# Point clouds.

# The length of a LAS point record's fixed part, by format.
LAS_LENGTHS = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}


def las_header(data: bytes) -> dict:
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    version = (data[24], data[25])
    offset, records, kind, length, count = struct.unpack_from("<IIBHI", data, 96)
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    xmax, xmin, ymax, ymin, zmax, zmin = struct.unpack_from("<6d", data, 179)
    if version >= (1, 4) and not count:
        (count,) = struct.unpack_from("<Q", data, 247)
    return {"version": version, "offset": offset, "format": kind & 0x3F, "compressed": bool(kind & 0x80), "length": length, "count": count, "scale": scale, "shift": shift, "extent": (xmin, ymin, xmax, ymax), "z": (zmin, zmax)}


def read_las(spark: SparkSession, ref: str) -> DataFrame:
    """(path, fid, x, y, z, intensity, classification) of .las files; .laz isn't read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                data = bytes(content)
                h = las_header(data)
                if h["compressed"]:
                    raise ValueError(f"{path} is compressed")
                raw = np.frombuffer(data, dtype=np.uint8, count=h["count"] * h["length"], offset=h["offset"]).reshape(h["count"], h["length"])
                for i in range(0, len(raw), 100_000):
                    b = raw[i : i + 100_000]
                    xyz = np.ascontiguousarray(b[:, :12]).view("<i4") * np.array(h["scale"]) + np.array(h["shift"])
                    kind = b[:, 16] if h["format"] >= 6 else b[:, 15] & 31
                    yield pd.DataFrame({"path": path, "fid": np.arange(i, i + len(b)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "intensity": np.ascontiguousarray(b[:, 12:14]).view("<u2")[:, 0].astype(np.int32), "classification": kind.astype(np.int32)})

    return spark.read.format("binaryFile").load(split(ref)[0]).select("path", "content").mapInPandas(run, "path string, fid long, x double, y double, z double, intensity int, classification int")


# GeoParquet: columns stay as they are, geometry is decoded where it is asked for.


def geo_metadata(spark: SparkSession, path: str) -> dict | None:
    """The `geo` entry of a Parquet footer, or None for a plain table. Reads the footer of one file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = p.getFileSystem(conf)
    if fs.getFileStatus(p).isDirectory():
        files = sorted(f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().endswith(".parquet"))
        if not files:
            return None
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    jvm = spark.sparkContext._jvm
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(p, conf))
    try:
        found = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    return json.loads(found) if found else None


def geoparquet_crs(meta: dict, column: str | None = None) -> str:
    """EPSG text of a geometry column; WGS84 where none is given."""
    crs = meta["columns"][column or meta["primary_column"]].get("crs", "EPSG:4326")
    if isinstance(crs, dict):
        i = crs.get("id") or {}
        return f"{i['authority']}:{i['code']}" if i else crs.get("name", "EPSG:4326")
    return crs or "EPSG:4326"


@F.arrow_udf(GEOMETRY_TYPE)
def decode_wkb(s: pa.Array) -> pa.Array:
    """Geometry structs from WKB, batch by batch."""
    return pa.array([codecs.row(codecs.from_wkb(x)) for x in s.to_pylist()], to_arrow_type(GEOMETRY_TYPE))


@F.arrow_udf(T.BinaryType())
def encode_wkb(g: pa.Array) -> pa.Array:
    """WKB from geometry structs, batch by batch."""
    shape = lambda x: (x["type"], [[[(v["x"], v["y"]) for v in r] for r in p] for p in x["parts"]])
    return pa.array([None if x is None or x["type"] is None else codecs.to_wkb(shape(x)) for x in g.to_pylist()], pa.binary())


def read_geoparquet(spark: SparkSession, ref: str) -> DataFrame:
    """A GeoParquet table with its primary geometry decoded as geom; a plain table as it is."""
    path = split(ref)[0]
    meta = geo_metadata(spark, path)
    df = spark.read.parquet(path)
    if meta is None:
        return df
    name = meta["primary_column"]
    return df.withColumn("geom", decode_wkb(F.col(name))).drop(*([name] if name != "geom" else []))


# Tables with coordinates.

# Header names for coordinates, without case, underscores and hyphens.
LON = frozenset("lon longitude lng long x easting".split())
LAT = frozenset("lat latitude y northing".split())
DEGREES = frozenset("lon longitude lng long lat latitude".split())


def coordinate_columns(headers: list[str]) -> tuple[str | None, str | None, str | None]:
    """(x column, y column, EPSG:4326 if a name says degrees); of several that fit, the last."""
    x = y = crs = None
    for h in headers:
        n = h.lower().strip().replace("_", "").replace("-", "")
        if n in LON:
            x = h
        elif n in LAT:
            y = h
        if n in DEGREES:
            crs = "EPSG:4326"
    return x, y, crs


def sniff(sample: str) -> str:
    """The delimiter of a text: of comma, tab and semicolon the one that is most regular over lines, else most frequent."""
    lines = [x for x in sample.splitlines() if x.strip()][:50]
    counts = {d: [x.count(d) for x in lines] for d in ",\t;"}
    steady = [d for d, n in counts.items() if n and n[0] and len(set(n)) == 1]
    return max(steady or counts, key=lambda d: (sum(counts[d]), ",;\t".find(d) == 0)) if lines else ","


def with_points(table: DataFrame, x: str | None = None, y: str | None = None) -> tuple[DataFrame, str | None]:
    """(rows with valid coordinates and their points, CRS), or the table as it is and None if it has no coordinates."""
    fx, fy, crs = coordinate_columns(table.columns)
    x, y = x or fx, y or fy
    if x is None or y is None:
        return table, None
    for c in (x, y):
        if c not in table.columns:
            raise ValueError(f"no column {c!r}")
    a, b = F.trim(F.col(f"`{x}`")).try_cast("double"), F.trim(F.col(f"`{y}`")).try_cast("double")
    ok = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return table.where(ok).withColumn("geom", point(a, b)), crs or "EPSG:4326"


def read_csv_xy(spark: SparkSession, ref: str) -> tuple[DataFrame, str | None]:
    """A CSV or TSV table, all text; points where it has coordinates (path::lon,lat names them)."""
    path, names = split(ref)
    head = spark.read.text(path).limit(50).collect()
    table = spark.read.csv(path, sep=sniff("\n".join(r[0] for r in head)), header=True, encoding="utf-8", multiLine=True)
    x, y = names.split(",") if names else (None, None)
    return with_points(table, x and x.strip(), y and y.strip())


def parse_xlsx(data: bytes, sheet: str | None = None) -> tuple[list[str], list[list[str | None]]]:
    """(headers, rows) of a sheet, by name or the first; all values as text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        names = [s.get("name") for s in book.find("m:sheets", ns)]
        rel = [s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id") for s in book.find("m:sheets", ns)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        if sheet is not None and sheet not in names:
            raise ValueError(f"no sheet {sheet!r}; there are {names}")
        target = targets[rel[names.index(sheet) if sheet else 0]].lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows: list[list[str | None]] = []
    for r in root.iter(f"{{{ns['m']}}}row"):
        out: dict[int, str | None] = {}
        for i, c in enumerate(r.findall("m:c", ns)):
            letters = re.match(r"[A-Z]+", c.get("r") or "")
            at = i if not letters else int(np.polyval([ord(x) - 64 for x in letters[0]], 26)) - 1
            v = c.find("m:v", ns)
            text = None if v is None else v.text
            if c.get("t") == "s" and text is not None:
                text = shared[int(text)]
            elif c.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
            out[at] = text
        rows.append([out.get(k) for k in range(max(out, default=-1) + 1)])
    head = [h or f"_c{i}" for i, h in enumerate(rows[0])] if rows else []
    return head, [(r + [None] * len(head))[: len(head)] for r in rows[1:]]


def read_excel_xy(spark: SparkSession, ref: str) -> tuple[DataFrame, str | None]:
    """A sheet of an .xlsx file (path::sheet::lon,lat), as read_csv_xy()."""
    path, *rest = ref.strip().split("::")
    content = spark.read.format("binaryFile").load(path).select("content").collect()[0][0]
    head, rows = parse_xlsx(bytes(content), rest[0] if rest and rest[0] else None)
    table = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in head))
    x, y = rest[1].split(",") if len(rest) > 1 else (None, None)
    return with_points(table, x and x.strip(), y and y.strip())


# Sinks.


def write_geojsonseq(features: DataFrame, path: str, geom: str = "geom") -> None:
    """One GeoJSON feature a line, in as many files as there are partitions."""
    from terraloom.functions.geometry import to_geojson

    props = F.to_json(F.struct(*[F.col(f"`{c}`") for c in features.columns if c != geom]), {"ignoreNullFields": "false"})
    line = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(to_geojson(F.col(geom)), F.lit("null")), F.lit("}"))
    features.select(line.alias("value")).write.mode("overwrite").text(path)


def write_geopackage(features: DataFrame, path: str, layer: str = "features", srid: int = 4326, geom: str = "geom") -> None:
    """One GeoPackage file on the driver's disk, rows passed through one at a time: for results of modest size."""
    names = [c for c in features.columns if c != geom]
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT)")
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srid}", srid, srid))
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
    db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (layer, layer, srid))
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, srid))
    kind = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL"}
    types = dict(features.dtypes)
    db.execute(f"CREATE TABLE {quoted(layer)} (geom BLOB, {', '.join(f'{quoted(n)} {kind.get(types[n], 'TEXT')}' for n in names)})")
    out = features.select(encode_wkb(F.col(geom)).alias("_g"), *[F.col(f"`{n}`") if types[n] in kind else F.col(f"`{n}`").cast("string") for n in names])
    head = b"GP" + struct.pack("<BBi", 0, 1, srid)
    marks = ", ".join("?" * (len(names) + 1))
    for r in out.toLocalIterator():
        db.execute(f"INSERT INTO {quoted(layer)} VALUES ({marks})", (None if r[0] is None else head + bytes(r[0]), *r[1:]))
    db.commit()
    db.close()
