"""What is fetched over HTTP: files, STAC items, WMS maps, WFS features, OpenTopography tiles; and what services offer.

Answers are streamed to the session's shared folder, where Spark's readers find them; the driver
holds a chunk at a time. Keys are in memory alone: they go into requests, never into records.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from urllib.error import HTTPError
from urllib.parse import quote, urlsplit
from urllib.request import Request, urlopen
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from terraloom.plans.session import shared_dir
from terraloom.sources import remote
from terraloom.sources.vector import quoted, split

CHUNK = 1 << 20
#: An answer kept in memory (lists of items, capabilities) may be so long.
LONGEST = 64 << 20
TIMEOUT_S = 60
#: Endings by what a service says that it sends.
ENDINGS = {"image/tiff": "tif", "image/geotiff": "tif", "application/octet-stream": "tif", "application/json": "geojson", "application/geo+json": "geojson"}


class ServiceError(RuntimeError):
    """A service that refused, or sent what can't be read."""


@dataclass
class Access:
    """How a service is asked: headers by host, and keys by service. Neither shows when printed."""

    headers: dict[str, dict[str, str]] = field(default_factory=dict, repr=False)
    keys: dict[str, str] = field(default_factory=dict, repr=False)

    def authenticate(self, service: str, key: str | None = None, headers: Mapping[str, str] | None = None) -> None:
        """A key for a service (opentopography), or headers for a host (its name)."""
        if key is not None:
            self.keys[service] = key
        if headers is not None:
            self.headers[service] = dict(headers)

    def open(self, url: str, body: object = None):
        """The answer to a request; POST with a JSON body."""
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https"):
            raise ServiceError(f"{parts.scheme!r} isn't http or https")
        headers = dict(self.headers.get(parts.hostname or "", {}))
        if body is not None:
            headers["Content-Type"] = "application/json"
        try:
            return urlopen(Request(url, None if body is None else json.dumps(body).encode(), headers), timeout=TIMEOUT_S)  # noqa: S310
        except HTTPError as e:
            raise ServiceError(f"{parts.scheme}://{parts.netloc}{parts.path}: {e.code} {e.reason}") from None

    def read(self, url: str, body: object = None) -> bytes:
        with self.open(url, body) as answer:
            data = answer.read(LONGEST + 1)
        if len(data) > LONGEST:
            raise ServiceError("the answer is too long")
        return data

    def fetch(self, spark: SparkSession, url: str, name: str | None = None) -> str:
        """The path that an answer was written to, in a folder of its own; its name ends as what it is."""
        with self.open(url) as answer:
            kind = (answer.headers.get_content_type() or "").lower()
            leaf = name or urlsplit(url).path.rsplit("/", 1)[-1] or "answer"
            if "." not in leaf and kind in ENDINGS:
                leaf = f"{leaf}.{ENDINGS[kind]}"
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/fetched-{uuid.uuid4().hex}/{leaf}")
            out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
            try:
                while part := answer.read(CHUNK):
                    out.write(bytearray(part))
            finally:
                out.close()
        return path.toString()


# STAC.


def stac_pages(access: Access, endpoint: str, search: Mapping[str, object]) -> Iterator[str]:
    """Pages of a search as JSON, until it has as many items as it asked for or there is no next one."""
    url, body, left = f"{endpoint.rstrip('/')}/search", dict(search), int(search.get("limit", 20))
    while url and left > 0:
        page = json.loads(access.read(url, body))
        found = page.get("features", [])[:left]
        yield json.dumps({"features": found})
        left -= len(found)
        after = next((x for x in page.get("links", []) if x.get("rel") == "next"), None) if found else None
        url = after.get("href") if after else None
        body = (dict(search) | after.get("body", {})) if after and after.get("method", "GET").upper() == "POST" else None


def stac_find(spark: SparkSession, access: Access, endpoint: str, bbox: tuple[float, float, float, float] | None = None, datetime: str | None = None, collections: list[str] | None = None, max_items: int = 20) -> DataFrame:
    """Items of a catalogue, as remote.stac_items() has them; at most max_items, which is the search's own limit."""
    return remote.stac_items(spark, list(stac_pages(access, endpoint, remote.stac_search(bbox, datetime, collections, None, max_items))))


def stac_fetch(spark: SparkSession, access: Access, endpoint: str, ref: str) -> tuple[str, dict]:
    """(path, item) of collection/item[::asset]; an asset may be a Sentinel-2 band, by asset or id."""
    collection, item_id, asset = remote.stac_ref(ref)
    item = json.loads(access.read(f"{endpoint.rstrip('/')}/collections/{quote(collection)}/items/{quote(item_id)}"))
    if asset is not None and asset not in item.get("assets", {}):
        try:
            asset = remote.sentinel2_asset(asset)
        except ValueError:
            pass
    return access.fetch(spark, item["assets"][remote.stac_asset(item, asset)]["href"]), item


# OGC services.


def _leaf(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _below(e: ElementTree.Element, *names: str) -> list[ElementTree.Element]:
    found = [e]
    for name in names:
        found = [k for x in found for k in x if _leaf(k) == name]
    return found


def capabilities(access: Access, ref: str) -> tuple[list[str], list[tuple[str, str | None]]]:
    """(formats, layers as (name, title)) that a service offers for maps or features."""
    service = ref.partition("::")[0].upper()
    url = ref.partition("::")[2].partition("::")[0]
    version = "1.3.0" if service == "WMS" else "2.0.0"
    root = ElementTree.fromstring(access.read(f"{url}{'&' if '?' in url else '?'}SERVICE={service}&VERSION={version}&REQUEST=GetCapabilities"))
    layers, formats = [], []
    for e in root.iter():
        if _leaf(e) in ("Layer", "FeatureType"):
            name = _below(e, "Name")
            if name and name[0].text:
                title = _below(e, "Title")
                layers.append((name[0].text, title[0].text if title else None))
        elif _leaf(e) == "GetMap":
            formats += [f.text for f in _below(e, "Format") if f.text]
        elif _leaf(e) == "Operation" and e.get("name") == "GetFeature":
            formats += [v.text for p in _below(e, "Parameter") if (p.get("name") or "").lower() == "outputformat" for v in p.iter() if _leaf(v) == "Value" and v.text]
    return formats, layers


def ogc_fetch(spark: SparkSession, access: Access, ref: str, bbox: tuple[float, float, float, float] | None = None, width: int = 1024, height: int = 1024, crs: str = "EPSG:4326", max_features: int | None = None) -> str:
    """The path of a map (a GeoTIFF) or of features (GeoJSON)."""
    service, _, layer = remote.ogc_ref(ref)
    formats, layers = capabilities(access, ref)
    if layers and layer not in [n for n, _ in layers]:
        raise ServiceError(f"no layer {layer!r}; there are {[n for n, _ in layers]}")
    if service == "wfs":
        return access.fetch(spark, remote.wfs_url(ref, bbox, max_features, tuple(formats) or ("application/json",)), "features.geojson")
    path = access.fetch(spark, remote.wms_url(ref, bbox, width, height, crs, tuple(formats) or ("image/tiff",)), "map")
    if not path.endswith(".tif"):
        raise ServiceError("the service doesn't send GeoTIFF, and other images have no place")
    return path


def opentopography_fetch(spark: SparkSession, access: Access, ref: str, base: str | None = None) -> str:
    """The path of a tile; base stands in for the public service's address."""
    url = remote.opentopography_url(ref, access.keys.get("opentopography"))
    return access.fetch(spark, url if base is None else f"{base}?{url.partition('?')[2]}", "dem.tif")


# What there is.


def discover_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, kind, reader) of the files below a folder that some reader takes."""
    from terraloom.plans.route import RefKind, SourceRef, default_router

    router, rows = default_router(), []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    while files.hasNext():
        f = files.next()
        ref = SourceRef.infer(f.getPath().toUri().getPath())
        if ref.kind in (RefKind.LOCAL_RASTER, RefKind.LOCAL_VECTOR, RefKind.LOCAL_TABLE):
            rows.append((f.getPath().toString(), f.getLen(), str(ref.kind), router.select_one(ref)))
    return spark.createDataFrame(rows, "path string, size long, kind string, reader string")


def discover_duckdb(spark: SparkSession, path: str) -> DataFrame:
    """(schema, name, rows) of the tables in a DuckDB file."""
    import duckdb

    with duckdb.connect(split(path)[0], read_only=True) as db:
        names = db.execute("SELECT table_schema, table_name FROM information_schema.tables ORDER BY 1, 2").fetchall()
        rows = [(s, t, db.execute(f"SELECT count(*) FROM {quoted(s)}.{quoted(t)}").fetchone()[0]) for s, t in names]
    return spark.createDataFrame(rows, "schema string, name string, rows long")


def discover_layers(spark: SparkSession, access: Access, ref: str) -> DataFrame:
    """(name, title) of what wms::url or wfs::url offers."""
    return spark.createDataFrame(capabilities(access, ref)[1], "name string, title string")
