"""Databases, catalogues and services: JDBC and DuckDB relations, Overture tables, and requests that are built here.

Requests are plain functions from parameters to URLs, so that they can be tested without a network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from terraloom.sources.vector import quoted, split

# PostGIS and DuckDB.


def jdbc_options(url: str, ref: str, geometry: str | None = None, columns: tuple[str, ...] = ()) -> dict[str, str]:
    """Options of spark.read.format("jdbc") for schema.table, a table or a SELECT; names are quoted."""
    if re.match(r"\s*select\b", ref, re.I):
        return {"url": url, "query": ref.strip().rstrip(";")}
    table = ".".join(quoted(p) for p in ref.strip().split("."))
    if geometry is None:
        return {"url": url, "dbtable": table}
    names = ", ".join(quoted(c) for c in columns if c != geometry)
    return {"url": url, "query": f"SELECT {names}{', ' if names else ''}ST_AsBinary({quoted(geometry)}) AS geom FROM {table}"}


def read_postgis(spark: SparkSession, url: str, ref: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, ref), **options).load()


def read_duckdb(spark: SparkSession, ref: str, partitions: int = 1) -> DataFrame:
    """path.duckdb::table or path.duckdb::SELECT ..., opened read-only where each task runs.

    With several partitions a table is read by ranges of its row ids. The file must be in a
    folder that all executors share.
    """
    import duckdb

    path, what = split(ref)
    if not what:
        raise ValueError("give path::table or path::SELECT ...")
    is_query = bool(re.match(r"\s*select\b", what, re.I))
    source = f"({what.strip().rstrip(';')})" if is_query else ".".join(quoted(p) for p in what.split("."))
    with duckdb.connect(path, read_only=True) as db:
        schema = db.execute(f"SELECT * FROM {source} LIMIT 0").to_arrow_table().schema
        n = 0 if is_query or partitions < 2 else db.execute(f"SELECT count(*) FROM {source}").fetchall()[0][0]
    step = max(1, -(-n // partitions)) if n else 0
    parts = [f"WHERE rowid >= {i * step} AND rowid < {(i + 1) * step}" for i in range(partitions)] if n else [""]

    def run(batches: Iterator) -> Iterator:
        import duckdb as engine

        for b in batches:
            for where in b.column(0).to_pylist():
                with engine.connect(path, read_only=True) as db:
                    yield from db.execute(f"SELECT * FROM {source} {where}").to_arrow_reader(10_000)

    return spark.createDataFrame([(p,) for p in parts], "w string").repartition(len(parts)).mapInArrow(run, from_arrow_schema(schema))


# Overture.

RELEASE = re.compile(r"^\d{4}-\d{2}-\d{2}(\.\d+)?$")


def overture_path(ref: str, base: str, release: str) -> str:
    """The folder of overture://theme/type in a release."""
    m = re.fullmatch(r"overture://([a-z_]+)/([a-z_]+)/?", ref.strip())
    if not m:
        raise ValueError("give overture://theme/type")
    if not RELEASE.match(release):
        raise ValueError(f"{release!r} isn't a release")
    return f"{base.rstrip('/')}/{release}/theme={m[1]}/type={m[2]}"


def in_box(bbox: tuple[float, float, float, float], column: str = "bbox") -> Column:
    """Boxes inside of one; plain comparisons of struct fields, which reach the Parquet scan."""
    west, south, east, north = bbox
    return (F.col(f"{column}.xmin") >= west) & (F.col(f"{column}.xmax") <= east) & (F.col(f"{column}.ymin") >= south) & (F.col(f"{column}.ymax") <= north)


def read_overture(spark: SparkSession, ref: str, base: str, release: str, bbox: tuple[float, float, float, float] | None = None, max_rows: int | None = 10_000) -> DataFrame:
    """Rows of a theme's type, by bounding box, at most max_rows of them (the limit is the feature)."""
    df = spark.read.option("basePath", base).parquet(overture_path(ref, base, release))
    df = df.where(in_box(bbox)) if bbox else df
    return df.limit(max_rows) if max_rows is not None else df


# STAC and Sentinel-2.

# Asset names in order of preference, and Sentinel-2 bands as (asset, id, name, nanometres, metres).
PREFERRED = ("data", "visual", "image", "default")
SENTINEL2 = (
    ("coastal", "B01", "coastal", 443, 60), ("blue", "B02", "blue", 490, 10), ("green", "B03", "green", 560, 10), ("red", "B04", "red", 665, 10), ("rededge1", "B05", "rededge", 705, 20), ("rededge2", "B06", "rededge", 740, 20), ("rededge3", "B07", "rededge", 783, 20),
    ("nir", "B08", "nir", 842, 10), ("nir08", "B8A", "nir08", 865, 20), ("nir09", "B09", "nir09", 945, 60), ("cirrus", "B10", "cirrus", 1375, 60), ("swir16", "B11", "swir16", 1610, 20), ("swir22", "B12", "swir22", 2190, 20), ("scl", "SCL", "scl", 0, 20),
)


def sentinel2_asset(band: str) -> str:
    """The asset of a band given by asset or by id (red, B04)."""
    for asset, code, *_ in SENTINEL2:
        if band.lower() == asset or band.upper() == code:
            return asset
    raise ValueError(f"no band {band!r}")


def stac_search(bbox: tuple[float, float, float, float] | None = None, datetime: str | None = None, collections: list[str] | None = None, query: dict | None = None, max_items: int = 20) -> dict:
    """The body of a search request."""
    given = {"bbox": list(bbox) if bbox else None, "datetime": datetime, "collections": collections, "query": query, "limit": max_items}
    return {k: v for k, v in given.items() if v is not None}


def stac_ref(ref: str) -> tuple[str, str, str | None]:
    """(collection, item, asset) of collection/item[::asset]."""
    path, asset = split(ref)
    collection, sep, item = path.partition("/")
    if not sep or not item:
        raise ValueError("give collection/item[::asset]")
    return collection, item, asset


def stac_asset(item: dict, name: str | None = None) -> str:
    """The asset to read: the named, the only, a preferred, or the first GeoTIFF one."""
    assets = item.get("assets", {})
    if name is not None:
        if name not in assets:
            raise ValueError(f"no asset {name!r}; there are {sorted(assets)}")
        return name
    if len(assets) == 1:
        return next(iter(assets))
    found = next((p for p in PREFERRED if p in assets), None) or next((k for k, v in assets.items() if "tiff" in (v.get("type") or "") or str(v.get("href", "")).lower().endswith((".tif", ".tiff"))), None)
    if found is None:
        raise ValueError(f"which of {sorted(assets)}?")
    return found


def stac_items(spark: SparkSession, pages: list[str]) -> DataFrame:
    """(id, collection, datetime, xmin, ymin, xmax, ymax, assets) of items in search results given as JSON texts."""
    rows = []
    for page in pages:
        for f in json.loads(page).get("features", ()):
            box = f.get("bbox") or [None] * 4
            rows.append((f["id"], f.get("collection"), (f.get("properties") or {}).get("datetime"), *(None if x is None else float(x) for x in (box if len(box) == 4 else [box[0], box[1], box[3], box[4]])), {k: v.get("href") for k, v in (f.get("assets") or {}).items()}))
    return spark.createDataFrame(rows, "id string, collection string, datetime string, xmin double, ymin double, xmax double, ymax double, assets map<string,string>").withColumn("datetime", F.to_timestamp("datetime"))


def sentinel2_bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SENTINEL2), "asset string, id string, name string, nanometres int, metres int")


# OGC services and OpenTopography.

MAX_SIDE = 4096


def ogc_ref(ref: str) -> tuple[str, str, str]:
    """(service, url, layer) of wms::url::layer or wfs::url::layer."""
    service, _, rest = ref.strip().partition("::")
    url, _, layer = rest.rpartition("::")
    if service.lower() not in ("wms", "wfs") or not re.match(r"https?://", url) or not layer:
        raise ValueError("give wms::http(s)://...::layer or wfs::http(s)://...::layer")
    return service.lower(), url, layer


def choose_format(offered: list[str], wanted: tuple[str, ...]) -> str:
    """Of the offered formats the first wanted by name, then by part of the name, else the first."""
    for same in (lambda o, w: o.lower() == w, lambda o, w: w in o.lower()):
        for w in wanted:
            for o in offered:
                if same(o, w):
                    return o
    return offered[0]


def wms_url(ref: str, bbox: tuple[float, float, float, float] | None, width: int = 1024, height: int = 1024, crs: str = "EPSG:4326", formats: tuple[str, ...] = ("image/tiff",)) -> str:
    """A GetMap request; a side above 4096 shrinks both in proportion. A box is required."""
    if bbox is None:
        raise ValueError("a map needs a bounding box")
    _, url, layer = ogc_ref(ref)
    scale = min(1.0, MAX_SIDE / max(width, height))
    w, h = max(1, int(width * scale)), max(1, int(height * scale))
    box = (bbox[1], bbox[0], bbox[3], bbox[2]) if crs == "EPSG:4326" else bbox
    fmt = choose_format(list(formats), ("image/tiff", "tiff", "image/png", "png", "image/jpeg", "jpeg"))
    return f"{url}{'&' if '?' in url else '?'}{urlencode({'SERVICE': 'WMS', 'VERSION': '1.3.0', 'REQUEST': 'GetMap', 'LAYERS': layer, 'STYLES': '', 'CRS': crs, 'BBOX': ','.join(map(str, box)), 'WIDTH': w, 'HEIGHT': h, 'FORMAT': fmt})}"


def wfs_url(ref: str, bbox: tuple[float, float, float, float] | None = None, max_features: int | None = None, formats: tuple[str, ...] = ("application/json",)) -> str:
    """A GetFeature request, as JSON where it is offered, else GML."""
    _, url, layer = ogc_ref(ref)
    q = {"SERVICE": "WFS", "VERSION": "2.0.0", "REQUEST": "GetFeature", "TYPENAMES": layer, "OUTPUTFORMAT": choose_format(list(formats), ("application/json", "json", "gml"))}
    if bbox:
        q["BBOX"] = ",".join(map(str, bbox))
    if max_features is not None:
        q["COUNT"] = str(max_features)
    return f"{url}{'&' if '?' in url else '?'}{urlencode(q)}"


# Names of OpenTopography's global datasets.
TOPOGRAPHY = frozenset("SRTMGL3 SRTMGL1 SRTMGL1_E AW3D30 AW3D30_E SRTM15Plus NASADEM COP30 COP90 EU_DTM GEDI_L3".split())


def opentopography_url(ref: str, key: str | None = None, output: str = "GTiff") -> str:
    """A request for opentopo://DATASET?west&south&east&north. A key is added for the call alone; keep URLs without it."""
    m = re.fullmatch(r"opentopo://([A-Za-z0-9_]+)\?(.+)", ref.strip())
    if not m or m[1] not in TOPOGRAPHY:
        raise ValueError(f"give opentopo://DATASET?west&south&east&north, DATASET of {sorted(TOPOGRAPHY)}")
    west, south, east, north = (float(x.partition("=")[2] or x) for x in m[2].split("&"))
    if west >= east or south >= north:
        raise ValueError("bounds must rise")
    q = {"demtype": m[1], "south": south, "north": north, "west": west, "east": east, "outputFormat": output} | ({"API_Key": key} if key else {})
    return f"https://portal.opentopography.org/API/globaldem?{urlencode(q)}"


# Object stores.

# Schemes as Hadoop's file systems name them.
SCHEMES = {"s3": "s3a", "gs": "gs", "az": "abfss", "http": "http", "https": "https"}


def store_path(uri: str) -> str:
    """An object's URI as Spark's file systems take it."""
    scheme, _, rest = uri.partition("://")
    if scheme.lower() not in SCHEMES:
        raise ValueError(f"{scheme!r} isn't one of {sorted(SCHEMES)}")
    return f"{SCHEMES[scheme.lower()]}://{rest}"


def cloud_grid_points(df: DataFrame, columns: tuple[str, ...] = ("sig0", "height", "water_frac", "classification")) -> DataFrame:
    """Pixel-cloud rows with a place, in their order, ready for scatter()."""
    return df.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull()).select("ordinal", "longitude", "latitude", *columns)


