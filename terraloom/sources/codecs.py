"""Binary geometry codecs, used where files are parsed: WKB, GeoPackage and SpatiaLite blobs."""

from __future__ import annotations

import struct
from collections.abc import Iterator

Ring = list[tuple[float, float]]
#: (type, parts): parts of rings of (x, y), as in terraloom.functions.geometry.
Shape = tuple[str, list[list[Ring]]]

# Geometry type numbers of well-known binary.
TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


class _Reader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.order = data, at, "<"

    def take(self, kind: str, n: int = 1) -> tuple:
        f = f"{self.order}{n}{kind}"
        out = struct.unpack_from(f, self.data, self.at)
        self.at += struct.calcsize(f)
        return out


def _places(r: _Reader, n: int, dims: int) -> Ring:
    v = r.take("d", n * dims)
    return list(zip(v[::dims], v[1::dims], strict=True))


def _shape(r: _Reader) -> Shape:
    r.order = "<" if r.data[r.at] else ">"
    r.at += 1
    (code,) = r.take("I")
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    if code & 0x20000000:
        r.take("I")
    code &= 0x1FFFFFFF
    extra, kind = divmod(code, 1000)
    dims = max(dims, {0: 2, 1: 3, 2: 3, 3: 4}.get(extra, 2))
    name = TYPES[kind]
    if kind == 1:
        p = _places(r, 1, dims)
        return name, [] if p[0][0] != p[0][0] else [[p]]
    (n,) = r.take("I")
    if kind == 2:
        return name, [[_places(r, n, dims)]] if n else []
    if kind == 3:
        return name, [[_places(r, r.take("I")[0], dims) for _ in range(n)]] if n else []
    parts = []
    for _ in range(n):
        parts += _shape(r)[1]
    return name, parts


def from_wkb(data: bytes | None) -> Shape | None:
    """A shape from WKB or EWKB; heights and measures are left out. None for None."""
    return None if data is None else _shape(_Reader(bytes(data)))


def to_wkb(shape: Shape) -> bytes:
    name, parts = shape
    kind = next(k for k, v in TYPES.items() if v == name)
    head = lambda k: struct.pack("<BI", 1, k)
    run = lambda r: struct.pack(f"<I{2 * len(r)}d", len(r), *(c for p in r for c in p))
    single = {1: lambda p: head(1) + struct.pack("<2d", *p[0][0]), 2: lambda p: head(2) + run(p[0]), 3: lambda p: head(3) + struct.pack("<I", len(p)) + b"".join(map(run, p))}
    if kind <= 3:
        if not parts:
            return head(1) + struct.pack("<2d", float("nan"), float("nan")) if kind == 1 else head(kind) + struct.pack("<I", 0)
        return single[kind](parts[0])
    of = {4: 1, 5: 2, 6: 3}.get(kind)
    each = [single[of or (3 if len(p[0]) > 2 and p[0][0] == p[0][-1] else 2 if len(p[0]) > 1 else 1)](p) for p in parts]
    return head(kind) + struct.pack("<I", len(each)) + b"".join(each)


def from_geopackage(blob: bytes | None) -> Shape | None:
    """A shape from a GeoPackage blob: a header with an optional envelope, then WKB."""
    if blob is None or blob[:2] != b"GP":
        return None
    envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
    return from_wkb(blob[8 + envelope :])


def to_geopackage(shape: Shape, srid: int) -> bytes:
    return b"GP" + struct.pack("<BBi", 0, 1, srid) + to_wkb(shape)


def from_spatialite(blob: bytes | None) -> Shape | None:
    """A shape from a SpatiaLite blob: SRID, box, a mark, then its own form of WKB."""
    if blob is None or len(blob) < 44 or blob[0] != 0 or blob[38] != 0x7C:
        return None
    r = _Reader(blob, 39)
    r.order = "<" if blob[1] else ">"

    def body() -> Shape:
        (code,) = r.take("i")
        extra, kind = divmod(code, 1000)
        dims = {0: 2, 1: 3, 2: 3, 3: 4}[extra]
        if kind == 1:
            return "Point", [[_places(r, 1, dims)]]
        (n,) = r.take("i")
        if kind == 2:
            return "LineString", [[_places(r, n, dims)]]
        if kind == 3:
            return "Polygon", [[_places(r, r.take("i")[0], dims) for _ in range(n)]]
        parts = []
        for _ in range(n):
            r.at += 1
            parts += body()[1]
        return TYPES[kind], parts

    return body()


def from_geojson(g: dict | None) -> Shape | None:
    """A shape from a GeoJSON geometry; third coordinates are left out."""
    if not g or g.get("type") not in TYPES.values():
        return None
    name, c = g["type"], g.get("coordinates") or []
    run = lambda r: [(float(p[0]), float(p[1])) for p in r]
    if name == "GeometryCollection":
        return name, [p for x in g.get("geometries", ()) for p in (from_geojson(x) or ("", []))[1]]
    if not c:
        return name, []
    return name, {"Point": lambda: [[run([c])]], "LineString": lambda: [[run(c)]], "Polygon": lambda: [[run(r) for r in c]], "MultiPoint": lambda: [[run([p])] for p in c], "MultiLineString": lambda: [[run(r)] for r in c], "MultiPolygon": lambda: [[run(r) for r in p] for p in c]}[name]()


def row(shape: Shape | None) -> dict | None:
    """A shape as a row of Spark's geometry struct."""
    return None if shape is None else {"type": shape[0], "parts": [[[{"x": x, "y": y} for x, y in r] for r in p] for p in shape[1]]}


def area(r: Ring) -> float:
    """Twice the signed area of a ring; positive if it runs counter-clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))


def grouped(rings: list[Ring]) -> Iterator[list[Ring]]:
    """Shapefile rings as polygons: each clockwise ring is a shell, the others are holes of the one before."""
    now: list[Ring] = []
    for r in rings:
        if now and area(r) <= 0:
            yield now
            now = []
        now.append(r)
    if now:
        yield now
