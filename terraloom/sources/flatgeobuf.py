"""FlatGeobuf: a header, an optional packed R-tree, and features, all as flat buffers.

A bounding box uses the tree where there is one: only features whose leaf meets the box are
decoded. Without a tree every feature's own box is tested.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from terraloom.sources import codecs
from terraloom.sources.vector import FEATURES, _text, split

Box = tuple[float, float, float, float]
# The format's mark, and its column types as struct letters (text and binary have a length before them).
MAGIC = b"fgb\x03fgb"
COLUMNS = {0: "b", 1: "B", 2: "?", 3: "h", 4: "H", 5: "i", 6: "I", 7: "q", 8: "Q", 9: "f", 10: "d", 11: "text", 12: "text", 13: "text", 14: "binary"}
NODE = struct.Struct("<4dQ")


class Table:
    """A flat buffer's table: fields by number, through its vtable."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at
        self.vtable = at - struct.unpack_from("<i", data, at)[0]
        self.size = struct.unpack_from("<H", data, self.vtable)[0]

    @classmethod
    def root(cls, data: bytes, at: int) -> Table:
        return cls(data, at + struct.unpack_from("<I", data, at)[0])

    def where(self, k: int) -> int:
        slot = 4 + 2 * k
        offset = struct.unpack_from("<H", self.data, self.vtable + slot)[0] if slot < self.size else 0
        return self.at + offset if offset else 0

    def scalar(self, k: int, kind: str, default: float = 0) -> float:
        at = self.where(k)
        return struct.unpack_from(f"<{kind}", self.data, at)[0] if at else default

    def _vector(self, k: int) -> tuple[int, int]:
        at = self.where(k)
        if not at:
            return 0, 0
        at += struct.unpack_from("<I", self.data, at)[0]
        return at + 4, struct.unpack_from("<I", self.data, at)[0]

    def numbers(self, k: int, kind: str) -> tuple:
        at, n = self._vector(k)
        return struct.unpack_from(f"<{n}{kind}", self.data, at) if n else ()

    def raw(self, k: int) -> bytes:
        at, n = self._vector(k)
        return self.data[at : at + n]

    def text(self, k: int) -> str:
        return self.raw(k).decode()

    def tables(self, k: int) -> list[Table]:
        at, n = self._vector(k)
        return [Table(self.data, at + 4 * i + struct.unpack_from("<I", self.data, at + 4 * i)[0]) for i in range(n)]

    def table(self, k: int) -> Table | None:
        at = self.where(k)
        return Table(self.data, at + struct.unpack_from("<I", self.data, at)[0]) if at else None


def shape(g: Table, kind: int = 0) -> codecs.Shape:
    kind = int(g.scalar(6, "B")) or kind
    name = codecs.TYPES.get(kind, "GeometryCollection")
    if children := g.tables(7):
        return name, [p for c in children for p in shape(c, {6: 3}.get(kind, 0))[1]]
    xy = g.numbers(1, "d")
    places = list(zip(xy[::2], xy[1::2], strict=True))
    ends = g.numbers(0, "I") or (len(places),)
    rings = [places[a:b] for a, b in zip((0, *ends[:-1]), ends, strict=True)]
    if not places:
        return name, []
    if name == "MultiPoint":
        return name, [[[p]] for p in places]
    if name == "MultiLineString":
        return name, [[r] for r in rings]
    return name, [rings]


def _levels(items: int, width: int) -> list[int]:
    """Nodes of the tree by level, leaves first."""
    out = [items]
    while out[-1] > 1:
        out.append(-(-out[-1] // width))
    return out if items else []


def found_in_tree(data: bytes, at: int, items: int, width: int, box: Box) -> list[int]:
    """Offsets of the features whose boxes meet a box, by going down from the root."""
    counts = _levels(items, width)
    first, total = [], sum(counts)
    for n in counts:
        total -= n
        first.append(total)
    hits: list[int] = []
    stack = [(len(counts) - 1, 0)]
    while stack:
        level, k = stack.pop()
        x0, y0, x1, y1, link = NODE.unpack_from(data, at + NODE.size * (first[level] + k))
        if x0 > box[2] or x1 < box[0] or y0 > box[3] or y1 < box[1]:
            continue
        if level == 0:
            hits.append(link)
        else:
            start = k * width
            stack += [(level - 1, i) for i in range(start, min(start + width, counts[level - 1]))]
    return sorted(hits)


def parse(data: bytes, box: Box | None = None) -> Iterator[tuple[int, dict, codecs.Shape | None]]:
    """(number, properties, shape) of features, of those that meet the box if one is given."""
    if data[:7] != MAGIC:
        raise ValueError("not a FlatGeobuf file")
    head = Table.root(data, 12)
    at = 12 + struct.unpack_from("<I", data, 8)[0]
    items, width, kind = int(head.scalar(8, "Q")), int(head.scalar(9, "H", 16)), int(head.scalar(2, "B"))
    columns = [(c.text(0), COLUMNS[int(c.scalar(1, "B"))]) for c in head.tables(7)]
    tree = at
    if items and width:
        at += NODE.size * sum(_levels(items, width)) if items > 1 else NODE.size
    only = None if box is None or not items or not width else [at + o for o in found_in_tree(data, tree, items, width, box)]
    number = 0
    places = iter(only) if only is not None else None
    while True:
        if places is not None:
            at = next(places, len(data))
        if at >= len(data):
            return
        size = struct.unpack_from("<I", data, at)[0]
        f = Table.root(data, at + 4)
        at += 4 + size
        g = f.table(0)
        s = None if g is None else shape(g, kind)
        if box is None or places is not None or s is not None and _meets(s, box):
            yield number, dict(_properties(f.raw(1), columns)), s
        number += 1


def _meets(s: codecs.Shape, box: Box) -> bool:
    v = [p for part in s[1] for r in part for p in r]
    return bool(v) and min(p[0] for p in v) <= box[2] and max(p[0] for p in v) >= box[0] and min(p[1] for p in v) <= box[3] and max(p[1] for p in v) >= box[1]


def _properties(raw: bytes, columns: list[tuple[str, str]]) -> Iterator[tuple[str, object]]:
    at = 0
    while at + 2 <= len(raw):
        (k,) = struct.unpack_from("<H", raw, at)
        at += 2
        name, kind = columns[k]
        if kind in ("text", "binary"):
            (n,) = struct.unpack_from("<I", raw, at)
            value = raw[at + 4 : at + 4 + n]
            at += 4 + n
            yield name, value.decode() if kind == "text" else value.hex()
        else:
            yield name, struct.unpack_from(f"<{kind}", raw, at)[0]
            at += struct.calcsize(f"<{kind}")


def crs_of(data: bytes) -> str | None:
    crs = Table.root(data, 12).table(10)
    return f"{crs.text(0) or 'EPSG'}:{int(crs.scalar(1, 'i'))}" if crs is not None and crs.scalar(1, "i") else None


def read_flatgeobuf(spark: SparkSession, ref: str, bbox: Box | None = None) -> DataFrame:
    """Features of .fgb files, of those that meet a box if one is given."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                rows = [(path, "", i, {k: _text(v) for k, v in props.items()}, codecs.row(s)) for i, props, s in parse(bytes(content), bbox)]
                for i in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[i : i + 5000], columns=["path", "layer", "fid", "properties", "geom"])

    return spark.read.format("binaryFile").load(split(ref)[0]).select("path", "content").mapInPandas(run, FEATURES)
