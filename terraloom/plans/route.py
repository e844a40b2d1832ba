"""What a source reference is, and which reader takes it: two tables, of shapes and of readers.

SHAPES says which texts are which kind of reference, first match first. READERS says what each
reader takes. Both are data, so another shape or reader is another line.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from enum import StrEnum
from typing import NamedTuple


class RefKind(StrEnum):
    REMOTE_URI = "remote_uri"
    DATABASE = "database_ref"
    DUCKDB = "duckdb"
    LOCAL_PATH = "local_path"
    LOCAL_RASTER = "local_raster"
    LOCAL_VECTOR = "local_vector"
    LOCAL_TABLE = "local_table"
    CATALOG_ITEM = "catalog_item"
    UNKNOWN = "unknown"


# File extensions by what they hold, and schemes of remote references.
EXTENSIONS = {
    RefKind.LOCAL_RASTER: "tif tiff geotiff jp2 nc nc4 vrt hgt h5 hdf5 hdf he5 zarr mbtiles",
    RefKind.LOCAL_VECTOR: "shp geojson gpkg kml kmz gml fgb gpx parquet geoparquet topojson geojsonl geojsonseq ndjson las laz sqlite spatialite",
    RefKind.LOCAL_TABLE: "csv tsv xls xlsx",
    RefKind.LOCAL_PATH: "json xml txt pdf png jpg",
}
REMOTE = "http https s3 gs az ftp"

#: The kind of a file by its extension.
_HOLDS = {e: kind for kind, names in EXTENSIONS.items() for e in names.split()}
_KNOWN = "|".join(e for e, kind in _HOLDS.items() if kind != RefKind.LOCAL_PATH)
_OTHER = EXTENSIONS[RefKind.LOCAL_PATH].replace(" ", "|")

#: (kind, pattern of the whole text); named groups are the reference's parts. A local path gets its kind by its extension.
SHAPES: tuple[tuple[RefKind, re.Pattern[str]], ...] = tuple(
    (kind, re.compile(pattern, re.S | re.I))
    for kind, pattern in (
        (RefKind.REMOTE_URI, rf"(?P<url>(?P<scheme>{REMOTE.replace(' ', '|')})://.*)"),
        (RefKind.DATABASE, r"(?P<query>select\s.*)"),
        (RefKind.DUCKDB, r"(?P<db_path>.*?\.(?:duckdb|db))::(?P<query>\s*select\s.*)"),
        (RefKind.DUCKDB, r"(?P<db_path>.*?\.(?:duckdb|db))::(?P<table>.*)"),
        (RefKind.LOCAL_PATH, r"(?P<path>(?:/|\.\.?/).*)"),
        # A folder and a file with a dot in its name, and what is wanted of it; not what a scheme or a service stands before.
        (RefKind.LOCAL_PATH, r"(?P<path>(?!(?:wms|wfs)::)(?!.*://)(?:file:)?[^:]*/[^/:]*\.[^/:]*(?:::.*)?)"),
        (RefKind.CATALOG_ITEM, r"(?P<collection>(?!.*://)[^/]*)/(?P<item>.*)::(?P<asset>.*)"),
        (RefKind.CATALOG_ITEM, r"(?P<collection>[^/]*)/(?P<item>.*)"),
        (RefKind.LOCAL_PATH, rf"(?P<path>.*\.(?:{_KNOWN})(?:::.*|\?.*)?)"),
        (RefKind.DATABASE, rf"(?!.*\.(?:{_OTHER})(?:::.*|\?.*)?$)(?P<schema>[^.]*)\.(?P<table>.*)"),
    )
)


def extension(ref: str) -> str:
    """The extension of a path or URL in lower case, without what stands behind :: or ?."""
    tail = re.sub(r"^\w[\w+.-]*://", "", ref.strip())
    m = re.search(r"\.([^./]*)/*$", re.split(r"::|\?", tail)[0])
    return m[1].lower() if m else ""


class SourceRef:
    """A reference as it was given, its kind and its parts by name; equal if all three are."""

    __slots__ = ("raw", "kind", "params")

    def __init__(self, raw: str, kind: RefKind = RefKind.UNKNOWN, params: Iterable[tuple[str, str]] | dict[str, str] = ()) -> None:
        for slot, value in (("raw", raw), ("kind", kind), ("params", tuple(sorted(dict(params).items())))):
            object.__setattr__(self, slot, value)

    def __setattr__(self, name: str, value: object) -> None:
        raise AttributeError(f"{name} can't be changed")

    def _all(self) -> tuple:
        return self.raw, self.kind, self.params

    def __eq__(self, other: object) -> bool:
        return isinstance(other, SourceRef) and self._all() == other._all()

    def __hash__(self) -> int:
        return hash((self.raw, self.kind))

    def __fspath__(self) -> str:
        return self.raw

    def __repr__(self) -> str:
        return f"SourceRef{self._all()}"

    def part(self, name: str) -> str | None:
        return dict(self.params).get(name)

    @classmethod
    def file(cls, path: str) -> SourceRef:
        """A file on any file system, whatever its path looks like; its extension says what it holds."""
        return cls(path, _HOLDS.get(extension(path), RefKind.LOCAL_PATH), {"path": path})

    @classmethod
    def infer(cls, raw: str) -> SourceRef:
        """The first of SHAPES that fits; unknown if none does."""
        for kind, shape in SHAPES:
            if m := shape.fullmatch(raw.strip()):
                parts = {k: v.lower() if k == "scheme" else v for k, v in m.groupdict().items() if v is not None}
                return cls(raw, _HOLDS.get(extension(raw), kind) if kind == RefKind.LOCAL_PATH else kind, parts)
        return cls(raw)


class Reader(NamedTuple):
    """A reader by name, the kinds that it takes, and what it asks of their texts (empty: nothing)."""

    name: str
    kinds: frozenset[RefKind]
    extensions: frozenset[str] = frozenset()
    schemes: frozenset[str] = frozenset()
    prefix: str = ""
    #: The least comes first; those that are only there for want of others come behind all.
    order: int = 0
    last_resort: bool = False

    def takes(self, ref: SourceRef) -> bool:
        text = ref.raw.strip().lower()
        asked = ((self.extensions, extension(text)), (self.schemes, text.partition("://")[0]))
        return ref.kind in self.kinds and text.startswith(self.prefix) and all(not allowed or value in allowed for allowed, value in asked)


_FILES = frozenset(k for k in RefKind if k.startswith("local_"))
_SCHEMED = frozenset(RefKind) - {RefKind.DUCKDB}


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_OBJECTS = _words(REMOTE) - {"ftp"}
#: Files by extension first, then services by prefix, then object stores and catalogues, then any file.
READERS: tuple[Reader, ...] = (
    *(
        Reader(name, _FILES, _words(extensions))
        for name, extensions in {
            "cog": "tif tiff geotiff", "flatgeobuf": "fgb", "shapefile": "shp", "geopackage": "gpkg", "geoparquet": "parquet geoparquet", "gpx": "gpx", "kmz": "kmz", "las": "las laz", "spatialite": "sqlite spatialite",
            "topojson": "topojson", "csv_xy": "csv tsv", "excel_xy": "xls xlsx", "geojsonseq": "geojsonl geojsonseq ndjson", "hdf5": "h5 hdf5 hdf he5", "netcdf": "nc nc4", "mbtiles": "mbtiles", "zarr": "zarr",
        }.items()
    ),
    Reader("cog", frozenset({RefKind.REMOTE_URI}), _words("tif tiff geotiff"), _OBJECTS),
    Reader("flatgeobuf", frozenset({RefKind.REMOTE_URI}), _words("fgb"), _words("http https")),
    *(Reader(name, _SCHEMED, prefix=prefix) for prefix, name in {"wms::": "ogc", "wfs::": "ogc", "overture://": "overture", "opentopo://": "opentopography"}.items()),
    Reader("object_store", frozenset({RefKind.REMOTE_URI}), schemes=_OBJECTS, order=50),
    Reader("stac", frozenset({RefKind.CATALOG_ITEM}), order=50),
    Reader("postgis", frozenset({RefKind.DATABASE})),
    Reader("duckdb", frozenset({RefKind.DUCKDB})),
    Reader("local_file", _FILES, order=100),
)


class NoRouteError(LookupError):
    pass


class Router:
    def __init__(self, readers: Iterable[Reader] = ()) -> None:
        self.readers = list(readers)

    def register(self, reader: Reader) -> None:
        self.readers.append(reader)

    def select(self, ref: SourceRef | str) -> list[str]:
        """Names of the readers that take a reference, best first; of equals the one registered first."""
        known = SourceRef.infer(ref) if isinstance(ref, str) else ref
        names: dict[str, None] = {}
        for reader in sorted(self.readers, key=lambda r: (r.last_resort, r.order)):
            if reader.takes(known):
                names.setdefault(reader.name)
        return list(names)

    def select_one(self, ref: SourceRef | str) -> str:
        for name in self.select(ref):
            return name
        raise NoRouteError(f"no reader for {ref!r}")


def default_router() -> Router:
    return Router(READERS)
