"""Geometries as structs, and what can be asked of them as column expressions.

A geometry is struct<type, parts: array of parts, a part: array of rings, a ring: array of
struct<x, y>>. A point is one part of one ring of one vertex; a line string one ring; a
polygon's first ring is its shell, the others are holes. Everything stays in the JVM.

A place on a polygon's left or top edge is inside for rasters, one on its right or bottom edge
is not, so that polygons side by side share no cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double>"
GEOMETRY = f"struct<type:string,parts:array<array<array<{VERTEX}>>>>"


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def vertex(x: Column | str | float, y: Column | str | float) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def point(x: Column | str | float, y: Column | str | float) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.array(F.array(vertex(x, y)))).alias("parts"))


def ring(places: Sequence[tuple]) -> Column:
    return F.array(*[vertex(x, y) for x, y in places])


def polygon(places: Sequence[tuple], holes: Sequence[Sequence[tuple]] = ()) -> Column:
    """A polygon from open or closed rings of (x, y), each a column, a name or a number."""
    closed = [[*r, r[0]] if r[0] is not r[-1] and r[0] != r[-1] else list(r) for r in ([tuple(map(_key, p)) for p in x] for x in (places, *holes))]
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[ring([(x.c, y.c) for x, y in r]) for r in closed])).alias("parts"))


class _key:
    """A coordinate that can be compared: a column is the same as itself alone."""

    def __init__(self, c: Column | str | float) -> None:
        self.c = c

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, _key):
            return False
        return self.c is other.c if isinstance(self.c, Column) or isinstance(other.c, Column) else self.c == other.c

    __hash__ = None


def box(x0: Column | str | float, y0: Column | str | float, x1: Column | str | float, y1: Column | str | float) -> Column:
    """A rectangle as a polygon."""
    return polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])


def line(places: Sequence[tuple]) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.array(F.array(ring(places))).alias("parts"))


def rings(g: Column) -> Column:
    return F.flatten(g["parts"])


def vertices(g: Column) -> Column:
    return F.flatten(rings(g))


def is_empty(g: Column) -> Column:
    """True for null geometries and those without a vertex."""
    return g.isNull() | (F.coalesce(F.size(vertices(g)), F.lit(0)) <= 0)


def is_area(g: Column) -> Column:
    return g["type"].isin("Polygon", "MultiPolygon")


def bbox(g: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax>; nulls where there is no vertex."""
    x, y = F.transform(vertices(g), lambda v: v["x"]), F.transform(vertices(g), lambda v: v["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])


def segments(g: Column) -> Column:
    """Array of struct<a, b> of consecutive vertices, over all rings."""

    def of(r: Column) -> Column:
        return F.when(F.size(r) > 1, F.transform(F.slice(r, 1, F.size(r) - 1), lambda v, i: F.struct(v.alias("a"), F.get(r, i + 1).alias("b")))).otherwise(F.array().cast(f"array<struct<a:{VERTEX},b:{VERTEX}>>"))

    return F.flatten(F.transform(rings(g), of))


def covers_place(g: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings; left and top edges are inside, right and bottom ones not."""

    def crossings(s: Column) -> Column:
        above = (s["a"]["y"] >= y) != (s["b"]["y"] >= y)
        rise = s["b"]["y"] - s["a"]["y"]
        at = s["a"]["x"] + (y - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / F.when(rise != 0, rise).otherwise(1.0)
        return above & (x < at)

    return F.size(F.filter(segments(g), crossings)) % 2 == 1


def _side(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def _within_box(a: Column, b: Column, p: Column) -> Column:
    return p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def on_segment(s: Column, p: Column) -> Column:
    return (_side(s["a"], s["b"], p) == 0) & _within_box(s["a"], s["b"], p)


def segments_meet(s: Column, t: Column) -> Column:
    """Whether two closed segments have a place in common."""
    a, b = _side(s["a"], s["b"], t["a"]), _side(s["a"], s["b"], t["b"])
    c, d = _side(t["a"], t["b"], s["a"]), _side(t["a"], t["b"], s["b"])
    return (a * b < 0) & (c * d < 0) | on_segment(s, t["a"]) | on_segment(s, t["b"]) | on_segment(t, s["a"]) | on_segment(t, s["b"])


def segments_cross(s: Column, t: Column) -> Column:
    """Whether two segments pass through each other at an inner place of both."""
    a, b = _side(s["a"], s["b"], t["a"]), _side(s["a"], s["b"], t["b"])
    c, d = _side(t["a"], t["b"], s["a"]), _side(t["a"], t["b"], s["b"])
    return (a * b < 0) & (c * d < 0)


def on_boundary(g: Column, p: Column) -> Column:
    return F.exists(segments(g), lambda s: on_segment(s, p))


def strictly_inside(g: Column, p: Column) -> Column:
    return is_area(g) & covers_place(g, p["x"], p["y"]) & ~on_boundary(g, p)


def _inside_or_on(g: Column, p: Column) -> Column:
    return is_area(g) & covers_place(g, p["x"], p["y"]) | on_boundary(g, p) | F.exists(vertices(g), lambda v: (v["x"] == p["x"]) & (v["y"] == p["y"]))


def _probes(g: Column) -> Column:
    """Vertices and the middles of segments."""
    return F.concat(vertices(g), F.transform(segments(g), lambda s: F.struct(((s["a"]["x"] + s["b"]["x"]) / 2).alias("x"), ((s["a"]["y"] + s["b"]["y"]) / 2).alias("y"))))


def _centre(g: Column) -> Column:
    """The mean of the first three vertices of an area: inside every convex one."""
    v = F.slice(vertices(g), 1, 3)
    total = lambda k: F.aggregate(F.transform(v, lambda p: p[k]), F.lit(0.0), lambda s, x: s + x) / 3
    return F.struct(total("x").alias("x"), total("y").alias("y"))


def intersects(a: Column, b: Column) -> Column:
    """Any place in common, boundaries included."""
    meet = F.exists(segments(a), lambda s: F.exists(segments(b), lambda t: segments_meet(s, t)))
    return meet | F.exists(vertices(b), lambda p: _inside_or_on(a, p)) | F.exists(vertices(a), lambda p: _inside_or_on(b, p))


def _interiors_meet(a: Column, b: Column) -> Column:
    cross = F.exists(segments(a), lambda s: F.exists(segments(b), lambda t: segments_cross(s, t)))
    inner = lambda g, h: F.exists(F.concat(_probes(h), F.when(is_area(h), F.array(_centre(h))).otherwise(F.array().cast(f"array<{VERTEX}>"))), lambda p: strictly_inside(g, p) & (~is_area(h) | ~on_boundary(h, p) | _near(g, h)))
    both_lines = ~is_area(a) & ~is_area(b)
    return F.when(both_lines, cross | F.exists(_probes(b), lambda p: _inside_or_on(a, p) & ~_is_end(a, p) & ~_is_end(b, p))).otherwise((cross & is_area(a) & is_area(b)) | (cross & ~both_lines) | inner(a, b) | inner(b, a))


def _near(g: Column, h: Column) -> Column:
    # A boundary place of h strictly inside g has places of h's interior beside it, also inside g.
    return is_area(g) & is_area(h)


def _is_end(g: Column, p: Column) -> Column:
    """Whether p is an end of a line string; points have no ends."""
    ends = F.flatten(F.transform(F.filter(rings(g), lambda r: F.size(r) > 1), lambda r: F.array(F.get(r, F.lit(0)), F.get(r, F.size(r) - 1))))
    return F.exists(ends, lambda v: (v["x"] == p["x"]) & (v["y"] == p["y"]))


def contains(a: Column, b: Column) -> Column:
    """No place of b outside of a, and some inner place in common; contact at the boundary alone isn't enough."""
    cross = F.exists(segments(a), lambda s: F.exists(segments(b), lambda t: segments_cross(s, t)))
    held = F.forall(_probes(b), lambda p: _inside_or_on(a, p))
    some = F.exists(_probes(b), lambda p: strictly_inside(a, p)) | is_area(b) & strictly_inside(a, _centre(b)) | ~is_area(a) & F.exists(_probes(b), lambda p: ~_is_end(a, p))
    return held & ~(is_area(a) & cross) & some & ~(is_area(b) & ~is_area(a))


def within(a: Column, b: Column) -> Column:
    return contains(b, a)


def touches(a: Column, b: Column) -> Column:
    """Places in common, but of the boundaries alone."""
    return intersects(a, b) & ~_interiors_meet(a, b)


PREDICATES = {"intersects": intersects, "contains": contains, "within": within, "touches": touches}


def to_wkt(g: Column) -> Column:
    """Well-known text of points, line strings, polygons and their multiples."""
    pair = lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string"))
    run = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, pair), ", "), F.lit(")"))
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, run), ", "), F.lit(")"))
    body = F.when(is_empty(g), F.lit("EMPTY")).when(g["type"].isin("Point", "LineString"), run(F.get(F.get(g["parts"], F.lit(0)), F.lit(0)))).when(g["type"] == "Polygon", part(F.get(g["parts"], F.lit(0)))).when(g["type"] == "MultiPolygon", F.concat(F.lit("("), F.array_join(F.transform(g["parts"], part), ", "), F.lit(")"))).otherwise(F.concat(F.lit("("), F.array_join(F.transform(rings(g), run), ", "), F.lit(")")))
    return F.concat_ws(" ", F.upper(g["type"]), body)


def to_geojson(g: Column) -> Column:
    """GeoJSON text of points, line strings, polygons and their multiples."""
    pair = lambda v: F.array(v["x"], v["y"])
    run = lambda r: F.transform(r, pair)
    first = F.get(g["parts"], F.lit(0))
    text = lambda t, c: F.to_json(F.struct(F.lit(t).alias("type"), c.alias("coordinates")))
    return (
        F.when(g["type"] == "Point", text("Point", F.get(run(F.get(first, F.lit(0))), F.lit(0))))
        .when(g["type"] == "LineString", text("LineString", run(F.get(first, F.lit(0)))))
        .when(g["type"] == "Polygon", text("Polygon", F.transform(first, run)))
        .when(g["type"] == "MultiPoint", text("MultiPoint", F.transform(vertices(g), pair)))
        .when(g["type"] == "MultiLineString", text("MultiLineString", F.transform(rings(g), run)))
        .when(g["type"] == "MultiPolygon", text("MultiPolygon", F.transform(g["parts"], lambda p: F.transform(p, run))))
    )


def from_geojson(text: Column) -> Column:
    """A geometry from GeoJSON text; null where it can't be read. Third coordinates are dropped."""
    kind = F.get_json_object(text, "$.type")
    raw = F.get_json_object(text, "$.coordinates")
    v = lambda a: F.struct(F.get(a, F.lit(0)).alias("x"), F.get(a, F.lit(1)).alias("y"))
    run = lambda r: F.transform(r, v)
    depth = {k: F.from_json(raw, f"{'array<' * k}double{'>' * k}") for k in (1, 2, 3, 4)}
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(v(depth[1])))))
        .when(kind == "LineString", F.array(F.array(run(depth[2]))))
        .when(kind == "MultiPoint", F.transform(depth[2], lambda p: F.array(F.array(v(p)))))
        .when(kind == "Polygon", F.array(F.transform(depth[3], run)))
        .when(kind == "MultiLineString", F.transform(depth[3], lambda r: F.array(run(r))))
        .when(kind == "MultiPolygon", F.transform(depth[4], lambda p: F.transform(p, run)))
    )
    return F.when(parts.isNotNull(), F.struct(kind.alias("type"), parts.alias("parts")))
