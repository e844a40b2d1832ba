"""Small files of many formats, made from rows: what the connector queries and tests read back.

Each function gives the bytes of a file, or of several by name. Only what readers need is written.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Sequence
from html import escape

import numpy as np
from pyspark.sql import SparkSession

from terraloom.sources import hdf5

#: A feature: its texts by name, and a place.
Feature = tuple[dict[str, str], float, float]


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes a file on any file system that Spark reaches, and gives its path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()
    return path


def geojson(features: Sequence[Feature]) -> bytes:
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": {"type": "Point", "coordinates": [x, y]}} for p, x, y in features]}).encode()


def topojson(features: Sequence[Feature]) -> bytes:
    """Each feature as a line from its place one step east, so that arcs and the transform are used."""
    arcs = [[[round(x * 2), round(y * 2)], [2, 0]] for _, x, y in features]
    shapes = [{"type": "LineString", "arcs": [i], "properties": p} for i, (p, _, _) in enumerate(features)]
    return json.dumps({"type": "Topology", "transform": {"scale": [0.5, 0.5], "translate": [0, 0]}, "arcs": arcs, "objects": {"all": {"type": "GeometryCollection", "geometries": shapes}}}).encode()


def gpx(features: Sequence[Feature]) -> bytes:
    points = "".join(f'<wpt lat="{y}" lon="{x}"><name>{escape(p["name"])}</name></wpt>' for p, x, y in features)
    return f'<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1">{points}</gpx>'.encode()


def kmz(features: Sequence[Feature]) -> bytes:
    marks = "".join(f"<Placemark><name>{escape(p['name'])}</name><Point><coordinates>{x},{y},0</coordinates></Point></Placemark>" for p, x, y in features)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("doc.kml", f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{marks}</Document></kml>')
    return out.getvalue()


def xlsx(header: Sequence[str], rows: Sequence[Sequence[object]]) -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    texts = sorted({str(v) for row in (header, *rows) for v in row if not isinstance(v, (int, float))})
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{chr(65 + c)}{r}" t="s"><v>{texts.index(str(v))}</v></c>'
    body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate((header, *rows), 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{escape(t)}</t></si>' for t in texts)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def shapefile(features: Sequence[Feature], prj: str | None = None) -> dict[str, bytes]:
    """Points with one text column, by extension."""
    width = max([1, *(len(p["name"].encode()) for p, _, _ in features)])
    body = b"".join(struct.pack(">2i", k, 10) + struct.pack("<i2d", 1, x, y) for k, (_, x, y) in enumerate(features, 1))
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 1, *[0.0] * 8)
    index = b"".join(struct.pack(">2i", 50 + 14 * k, 10) for k in range(len(features)))
    column = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14
    table = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(features), 32 + 32 + 1, 1 + width) + column + b"\r"
    table += b"".join(b" " + p["name"].encode().ljust(width) for p, _, _ in features) + b"\x1a"
    files = {"shp": head + body, "shx": head + index, "dbf": table, "cpg": b"utf-8"}
    return files | ({"prj": prj.encode()} if prj else {})


def las(points: Sequence[tuple[float, float, float, int]]) -> bytes:
    """Points (x, y, z, intensity) of format 0, to a hundredth."""
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<IIBHI", head, 96, 227, 0, 0, 20, len(points))
    ends = [f(v) for k in range(3) for f in (max, min) for v in ([p[k] for p in points] or [0.0],)]
    struct.pack_into("<3d3d6d", head, 131, 0.01, 0.01, 0.01, 0, 0, 0, *ends)
    return bytes(head) + b"".join(struct.pack("<3iHBBbBH", *(round(v * 100) for v in p[:3]), p[3], 0, 2, 0, 0, 1) for p in points)


def netcdf(name: str, x: np.ndarray, y: np.ndarray, values: np.ndarray, fill: float) -> bytes:
    """A classic file of one variable over lat and lon."""

    def text(s: str) -> bytes:
        return struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)

    none, parts = struct.pack(">2i", 0, 0), [y.astype(">f8"), x.astype(">f8"), values.astype(">f8")]
    given = struct.pack(">2i", 12, 1) + text("_FillValue") + struct.pack(">2id", 6, 1, fill)

    def head(at: list[int]) -> bytes:
        out = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">2i", 10, 2) + text("lat") + struct.pack(">i", len(y)) + text("lon") + struct.pack(">i", len(x)) + none + struct.pack(">2i", 11, 3)
        for n, dims, attributes, part, place in zip(("lat", "lon", name), ([0], [1], [0, 1]), (none, none, given), parts, at, strict=True):
            out += text(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + attributes + struct.pack(">3i", 6, part.nbytes, place)
        return out

    start = len(head([0, 0, 0]))
    return head([start, start + parts[0].nbytes, start + parts[0].nbytes + parts[1].nbytes]) + b"".join(p.tobytes() for p in parts)


def zarr(values: np.ndarray, chunk: tuple[int, int], fill: float) -> dict[str, bytes]:
    """The files of an array of version 2, by name."""
    files = {".zarray": json.dumps({"zarr_format": 2, "shape": values.shape, "chunks": chunk, "dtype": "<f8", "compressor": {"id": "zlib"}, "fill_value": fill, "order": "C", "filters": None}).encode()}
    for i in range(0, values.shape[0], chunk[0]):
        for j in range(0, values.shape[1], chunk[1]):
            block = np.full(chunk, fill)
            part = values[i : i + chunk[0], j : j + chunk[1]]
            block[: part.shape[0], : part.shape[1]] = part
            files[f"{i // chunk[0]}.{j // chunk[1]}"] = zlib.compress(block.astype("<f8").tobytes())
    return files


def hdf5_file(arrays: dict[str, np.ndarray], chunk: int = 0, attributes: dict[str, dict[str, str]] | None = None) -> bytes:
    """Arrays by path, with groups as the paths have them; chunk: so many rows a chunk, shuffled and deflated (0: in one piece)."""
    out = bytearray(96)

    def add(raw: bytes) -> int:
        out.extend(b"\0" * (-len(out) % 8))
        out.extend(raw)
        return len(out) - len(raw)

    def header(messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, -(-len(raw) // 8) * 8, 0) + raw + b"\0" * (-len(raw) % 8) for kind, raw in messages)
        return add(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def space(shape: tuple[int, ...]) -> bytes:
        return struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)

    def kind_of(dtype: np.dtype) -> bytes:
        n = dtype.itemsize
        if dtype.kind == "S":
            return struct.pack("<BBBBI", 0x13, 0, 0, 0, n)
        if dtype.kind == "f":
            sign, exponent, mantissa, bias = (63, 52, 52, 1023) if n == 8 else (31, 23, 23, 127)
            return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, sign, 0, n, 0, 8 * n, exponent, sign - exponent, 0, mantissa, bias)
        return struct.pack("<BBBBIHH", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, n, 0, 8 * n)

    def attribute(name: str, value: str) -> tuple[int, bytes]:
        raw = value.encode() + b"\0"
        pad = lambda b: b + b"\0" * (-len(b) % 8)
        kind, one = kind_of(np.dtype(f"S{len(raw)}")), space((1,))
        return hdf5.ATTRIBUTE, struct.pack("<BxHHH", 1, len(name) + 1, len(kind), len(one)) + pad(name.encode() + b"\0") + pad(kind) + pad(one) + raw

    def array(path: str, a: np.ndarray) -> int:
        messages = [(hdf5.SPACE, space(a.shape)), (hdf5.TYPE, kind_of(a.dtype)), *(attribute(k, v) for k, v in (attributes or {}).get(path, {}).items())]
        if not chunk:
            return header([*messages, (hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, add(a.tobytes()), a.nbytes))])
        size = (chunk, *a.shape[1:])
        keys = b""
        for i in range(0, a.shape[0], chunk):
            block = np.zeros(size, a.dtype)
            block[: len(a[i : i + chunk])] = a[i : i + chunk]
            raw = zlib.compress(np.frombuffer(block.tobytes(), np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
            keys += struct.pack(f"<II{a.ndim + 1}Q", len(raw), 0, i, *[0] * a.ndim) + struct.pack("<Q", add(raw))
        tree = add(b"TREE" + struct.pack("<BBHQQ", 1, 0, -(-a.shape[0] // chunk), hdf5.NOWHERE, hdf5.NOWHERE) + keys + b"\0" * (8 + 8 * (a.ndim + 1)))
        filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHII", hdf5.SHUFFLE, 0, 0, 1, a.dtype.itemsize, 0) + struct.pack("<HHHHII", hdf5.DEFLATE, 0, 0, 1, 6, 0)
        return header([*messages, (hdf5.FILTERS, filters), (hdf5.LAYOUT, struct.pack(f"<BBBQ{a.ndim + 1}I", 3, 2, a.ndim + 1, tree, *size, a.dtype.itemsize))])

    def group(path: str, members: dict) -> int:
        names, entries = bytearray(8), b""
        for name in sorted(members):
            below = f"{path}/{name}" if path else name
            at = group(below, members[name]) if isinstance(members[name], dict) else array(below, members[name])
            entries += struct.pack("<QQII16x", len(names), at, 0, 0)
            names += name.encode() + b"\0" * (8 - len(name) % 8)
        node = add(b"SNOD" + struct.pack("<BxH", 1, len(members)) + entries)
        tree = add(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, hdf5.NOWHERE, hdf5.NOWHERE) + struct.pack("<QQQ", 0, node, len(names)))
        heap = add(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), hdf5.NOWHERE, add(bytes(names))))
        return header([(hdf5.SYMBOLS, struct.pack("<QQ", tree, heap)), *(attribute(k, v) for k, v in (attributes or {}).get(path, {}).items())])

    tree_of: dict = {}
    for path, a in arrays.items():
        *above, name = path.split("/")
        at = tree_of
        for part in above:
            at = at.setdefault(part, {})
        at[name] = np.ascontiguousarray(a)
    root = group("", tree_of)
    out[:24] = hdf5.SIGNATURE + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0)[:16]
    out[24:96] = struct.pack("<4Q", 0, hdf5.NOWHERE, len(out), hdf5.NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
    return bytes(out)
