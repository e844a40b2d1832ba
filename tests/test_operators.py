import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import crs as C
from terraloom.functions import geometry as G
from terraloom.functions import projections as P
from terraloom.functions.raster import Grid
from terraloom.operators import hydrology, mosaic, spatial, terrain, warp


def cells(spark, a, nodata=None, band=1, name="0"):
    a = np.atleast_2d(np.asarray(a, dtype=float))
    rows = [(name, band, i, j, None if math.isnan(v) or v == nodata else float(v)) for (i, j), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "raster_id string, band int, row int, col int, value double").repartition(3)


def grid(a, **kw):
    h, w = np.shape(a)
    return Grid.from_bounds(0, 0, w, h, w, h, **kw)


def array(df, shape, value="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[value] is not None:
            out[r["row"], r["col"]] = r[value]
    return out


# Terrain.


@pytest.mark.parametrize(("units", "want"), [("degrees", 45.0), ("percent", 100.0), ("radians", math.pi / 4), ("m_m", 1.0)])
def test_slope_of_a_plane(spark, units, want):
    a = np.tile(np.arange(10.0), (10, 1))
    assert np.allclose(array(terrain.slope(cells(spark, a), grid(a), units), a.shape), want)


def test_slope_is_numpys_gradient_across_tiles(spark, monkeypatch):
    r = np.random.default_rng(1)
    a = r.normal(size=(23, 31))
    from terraloom.functions import raster

    monkeypatch.setattr(raster.with_neighbours, "__defaults__", ("value", ("n", "s", "w", "e"), 7, False))
    gy, gx = np.gradient(a, 2.0, 0.5)
    g = Grid.from_bounds(0, 0, 31 * 0.5, 23 * 2.0, 31, 23)
    assert np.allclose(array(terrain.slope(cells(spark, a), g, "m_m"), a.shape), np.hypot(gx, gy))


def test_slope_masks_no_data_only(spark):
    a = np.full((10, 10), 100.0)
    a[4:6, 4:6] = -9999
    got = array(terrain.slope(cells(spark, a, -9999), grid(a, nodata=-9999.0)), a.shape)
    assert (got == -9999).sum() == 4 and got[4, 3] > 80 and got[0, 0] == 0


@pytest.mark.parametrize("shape", [(1, 5), (5, 1)])
def test_slope_of_one_line(spark, shape):
    a = np.arange(5.0).reshape(shape)
    assert np.allclose(array(terrain.slope(cells(spark, a), grid(a), "m_m"), shape), 1)


def test_one_cell_has_no_gradient(spark):
    with pytest.raises(ValueError, match="two cells"):
        terrain.slope(cells(spark, [[1.0]]), grid([[1.0]]))


@pytest.mark.parametrize(("f", "want"), [(lambda r, c: r, 0), (lambda r, c: -r, 180), (lambda r, c: -c, 90), (lambda r, c: c, 270), (lambda r, c: r - c, 45)])
def test_aspect(spark, f, want):
    a = np.fromfunction(f, (10, 10))
    got = array(terrain.aspect(cells(spark, a), grid(a)), a.shape)[1:-1, 1:-1]
    assert np.allclose(got, want)


def test_flat_aspect_and_math_convention(spark):
    a = np.full((5, 5), 3.0)
    assert (array(terrain.aspect(cells(spark, a), grid(a)), a.shape) == -1).all()
    a = np.fromfunction(lambda r, c: r, (5, 5))
    assert np.allclose(array(terrain.aspect(cells(spark, a), grid(a), convention="math"), a.shape), 90)


def test_hillshade(spark):
    flat = np.full((6, 6), 5.0)
    assert (array(terrain.hillshade(cells(spark, flat), grid(flat)), flat.shape) == math.floor(math.cos(math.radians(45)) * 255)).all()
    toward, away = np.fromfunction(lambda r, c: r + c, (8, 8)), np.fromfunction(lambda r, c: -r - c, (8, 8))
    a, b = (array(terrain.hillshade(cells(spark, x), grid(x), scaled=True), x.shape) for x in (toward, away))
    assert (a > b).all() and a.max() <= 1 and b.min() >= 0
    with pytest.raises(ValueError):
        terrain.hillshade(cells(spark, flat), grid(flat), altitude=91)
    hole = flat.copy()
    hole[2, 2] = np.nan
    got = array(terrain.hillshade(cells(spark, hole), grid(hole)), flat.shape)
    assert got[2, 2] == got[2, 1] == got[1, 2] == 0 and got[0, 0] > 0


# Hydrology.


def brute_fill(a):
    h, w = a.shape
    out = np.where(np.isnan(a), np.nan, np.inf)
    edge = np.zeros_like(a, dtype=bool)
    edge[[0, -1]], edge[:, [0, -1]] = True, True
    out[edge & ~np.isnan(a)] = a[edge & ~np.isnan(a)]
    while True:
        p = np.pad(np.where(np.isnan(out), np.inf, out), 1, constant_values=np.inf)
        least = np.min([p[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        new = np.where(np.isnan(a), np.nan, np.minimum(out, np.maximum(a, least)))
        if np.array_equal(new, out, equal_nan=True):
            return np.where(np.isinf(new), a, new)
        out = new


def test_single_pit(spark):
    a = np.array([[5.0] * 5, [5, 7, 7, 7, 5], [5, 7, 3, 7, 5], [5, 7, 7, 7, 5], [5.0] * 5])
    assert array(hydrology.fill_depressions(cells(spark, a), grid(a), apply_gradient=False), a.shape)[2, 2] == 7


@pytest.mark.parametrize("tile", [256, 8])
def test_fill_against_brute_force(spark, tile):
    r = np.random.default_rng(2)
    a = np.round(r.normal(size=(20, 25)), 2)
    a[r.random(a.shape) < 0.08] = np.nan
    got = array(hydrology.fill_depressions(cells(spark, a), grid(a), apply_gradient=False, tile=tile), a.shape)
    assert np.array_equal(got, brute_fill(a), equal_nan=True)


def test_island_keeps_its_pit(spark):
    a = np.full((7, 7), 10.0)
    a[1:6, 1:6] = np.nan
    a[2:5, 2:5] = 8
    a[3, 3] = 1
    assert array(hydrology.fill_depressions(cells(spark, a), grid(a)), a.shape)[3, 3] == 1


@pytest.mark.parametrize("tile", [256, 9])
def test_flow_conserves(spark, tile):
    r = np.random.default_rng(3)
    a = np.round(r.normal(size=(22, 19)), 1)
    a[r.random(a.shape) < 0.05] = np.nan
    g = grid(a)
    filled = hydrology.fill_depressions(cells(spark, a), g, tile=tile)
    codes = hydrology.d8_flow_direction(filled, g)
    acc = array(hydrology.flow_accumulation(codes, g, tile=tile), a.shape)
    c = array(codes, a.shape)
    n = (~np.isnan(a)).sum()
    assert (c[np.isnan(a)] == -1).all() and (acc[np.isnan(a)] == -1).all()
    assert abs(acc[c >= 8].sum() - n) < 1e-6 and acc[c >= 0].min() >= 1


def test_d8_ties_and_codes(spark):
    a = np.full((3, 3), 5.0)
    a[1, 2] = a[2, 1] = 4
    got = array(hydrology.d8_flow_direction(cells(spark, a), grid(a)), a.shape)
    assert got[1, 1] == 0 and got[1, 2] == 8


def test_pits_take_the_first_neighbour_that_has_a_direction(spark):
    a = np.full((4, 5), 5.0)
    a[:, 4] = 4
    got = array(hydrology.d8_flow_direction(cells(spark, a), grid(a)), a.shape)
    assert got[1, 3] == 0 and got[1, 2] == 0 and got[1, 1] == 3 and (got != 9).all()


@pytest.mark.parametrize(("codes", "want"), [([[0, 0, 0, 0, 8]], [[1, 2, 3, 4, 5]]), ([[2, 2, 2], [0, 0, 8], [6, 6, 6]], None), ([[0, 0, 8], [9, 0, 8], [0, 0, 8]], None)])
def test_accumulation(spark, codes, want):
    c = np.array(codes, dtype=float)
    got = array(hydrology.flow_accumulation(cells(spark, c), grid(c)), c.shape)
    if want:
        assert got.tolist() == want
    assert got[c >= 8].sum() == c.size


def test_circles_are_an_error(spark):
    c = np.array([[0.0, 4.0]])
    with pytest.raises(Exception, match="circle"):
        hydrology.flow_accumulation(cells(spark, c), grid(c)).collect()


@pytest.mark.parametrize("shape", [(2, 2), (3, 3), (2, 3), (1, 5), (5, 1)])
def test_degenerate_grids(spark, shape):
    a = np.arange(np.prod(shape), dtype=float).reshape(shape)
    _, codes, acc = hydrology.hydrology_flow(cells(spark, a), grid(a))
    c = array(codes, shape)
    assert array(acc, shape)[c >= 8].sum() == a.size


# Zones, points, masks.

RAMP = np.arange(1.0, 17).reshape(4, 4)


def zones(spark, boxes):
    return spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "fid long, x0 double, y0 double, x1 double, y1 double").select("fid", F.concat(F.lit("z"), F.col("fid")).alias("name"), G.box("x0", "y0", "x1", "y1").alias("geom"))


def test_zonal(spark):
    z = zones(spark, [(0, 0, 2, 4), (2, 0, 4, 4), (-2, 0, 2, 4), (100, 100, 200, 200), (0.1, 3.1, 0.9, 3.9)])
    got = {r["zone_id"]: r for r in spatial.zonal_stats(cells(spark, RAMP), z, grid(RAMP), zone_id_field="name").collect()}
    assert (got["z0"]["count"], got["z0"]["mean"], got["z0"]["sum"]) == (8, 7.5, 60)
    assert got["z1"]["sum"] == 76 and got["z2"]["count"] == 8 and got["z4"]["count"] == 1
    assert got["z0"]["std"] == pytest.approx(np.std([1, 2, 5, 6, 9, 10, 13, 14]))
    assert all(math.isnan(got["z3"][s]) for s in spatial.STATISTICS)


def test_boxes_are_tested_before_geometries(spark):
    """A zone whose box doesn't hold a cell's centre costs one comparison, not a walk round its edge."""
    z = zones(spark, [(0, 0, 2, 3), (1, 0, 4, 2)])
    found = spatial.cells_in(cells(spark, RAMP), z.select("fid", "geom"), grid(RAMP))
    assert "_box" in found._jdf.queryExecution().analyzed().toString() and "_box" not in found.columns


def test_zonal_without_valid_cells(spark):
    a = np.array([[1.0] * 4, [-9999.0] * 4])
    got = spatial.zonal_stats(cells(spark, a), zones(spark, [(0, 0, 4, 1)]), grid(a, nodata=-9999.0)).collect()[0]
    assert all(math.isnan(got[s]) for s in spatial.STATISTICS)


def test_holes_are_outside(spark):
    one = spark.range(1).select(F.lit(0).alias("fid"), G.polygon([(0, 0), (4, 0), (4, 4), (0, 4)], [[(1, 1), (3, 1), (3, 3), (1, 3)]]).alias("geom"))
    assert spatial.zonal_stats(cells(spark, RAMP), one, grid(RAMP)).collect()[0]["count"] == 12


def test_sample(spark):
    p = spark.createDataFrame([(0, 0.5, 3.5), (1, 3.5, 0.5), (2, 100.0, 100.0), (3, -5.0, -5.0), (4, 4.0, 2.0), (5, None, None)], "point_id long, x double, y double")
    got = {r["point_id"]: r["band_1"] for r in spatial.sample_raster(cells(spark, RAMP), p, grid(RAMP)).collect()}
    assert got[0] == 1 and got[1] == 16 and all(math.isnan(got[i]) for i in (2, 3, 4, 5))


def test_clip(spark):
    got, g = spatial.clip_bounds(cells(spark, RAMP), grid(RAMP), 1, 1, 3, 3)
    assert array(got, (2, 2)).tolist() == [[6, 7], [10, 11]] and g.extent == (1, 1, 3, 3)
    got, g = spatial.clip_mask(cells(spark, RAMP), grid(RAMP), zones(spark, [(1, 1, 3, 4)]), crop=False)
    assert np.isfinite(array(got, (4, 4))).sum() == 6 and g.width == 4
    with pytest.raises(ValueError):
        spatial.clip_bounds(cells(spark, RAMP), grid(RAMP), 10, 10, 11, 11)


def test_rasterize(spark):
    got, g = spatial.rasterize(zones(spark, [(1, 1, 3, 3)]), (1, 1), (0, 0, 4, 4))
    a = array(got, (4, 4))
    assert a.sum() == 4 and a[1:3, 1:3].sum() == 4
    two = zones(spark, [(0, 0, 2, 4), (1, 0, 4, 4)]).withColumn("val", F.when(F.col("fid") == 1, 7))
    assert array(spatial.rasterize(two, (1, 1), burn_attribute="val")[0], (4, 4)).tolist() == [[0, 7, 7, 7]] * 4
    touched = array(spatial.rasterize(zones(spark, [(1.2, 1.2, 1.4, 1.4)]), (1, 1), (0, 0, 4, 4), all_touched=True)[0], (4, 4))
    assert touched.sum() == 1
    stretched = spatial.rasterize(zones(spark, [(0, 0, 1, 1)]), (0.3, 0.3), (0, 0, 1, 1))[1]
    assert (stretched.width, stretched.a) == (4, 0.25)


def test_join(spark):
    left, right = zones(spark, [(0, 0, 2, 2), (50, 50, 51, 51)]), zones(spark, [(1, 1, 3, 3), (0.5, 0.5, 1, 1), (2, 0, 3, 1)])
    empty = left.limit(1).select(F.lit(9).cast("long").alias("fid"), F.lit("e").alias("name"), F.lit(None).cast(G.GEOMETRY).alias("geom"))
    left = left.unionByName(empty)
    got = lambda p: sorted((r["fid"], r["fid_right"]) for r in spatial.spatial_join(left, right, p).collect() if r["fid_right"] is not None)
    assert got("intersects") == [(0, 0), (0, 1), (0, 2)] and got("contains") == [(0, 1)] and got("touches") == [(0, 2)] and got("within") == []
    rows = spatial.spatial_join(left, right).collect()
    assert {r["fid"] for r in rows} == {0, 1, 9} and "name_right" in rows[0].asDict()


def shapes():
    return {
        "square": G.box(0, 0, 4, 4), "inner": G.box(1, 1, 2, 2), "beside": G.box(4, 0, 6, 4), "corner": G.box(4, 4, 5, 5), "far": G.box(9, 9, 10, 10), "notch": G.polygon([(0, 0), (6, 0), (6, 6), (3, 1), (0, 6)]),
        "across": G.line([(-1, 2), (5, 2)]), "edge": G.line([(0, 0), (4, 0)]), "in": G.point(1, 1), "on": G.point(4, 2), "out": G.point(7, 7), "inside_line": G.line([(1, 1), (3, 3)]),
    }


@pytest.mark.parametrize(
    ("a", "b", "true"),
    [
        ("square", "inner", "intersects contains"), ("inner", "square", "intersects within"), ("square", "beside", "intersects touches"), ("square", "corner", "intersects touches"), ("square", "far", ""), ("square", "across", "intersects"),
        ("square", "edge", "intersects touches"), ("square", "in", "intersects contains"), ("in", "square", "intersects within"), ("square", "on", "intersects touches"), ("square", "out", ""), ("square", "inside_line", "intersects contains"),
        ("square", "square", "intersects contains within"), ("notch", "inner", "intersects contains"), ("across", "inside_line", "intersects"), ("in", "in", "intersects contains within"),
    ],
)
def test_predicates(spark, a, b, true):
    got = spark.range(1).select(*[f(shapes()[a], shapes()[b]).alias(n) for n, f in G.PREDICATES.items()]).collect()[0].asDict()
    assert {n for n, v in got.items() if v} == set(true.split())


def test_texts_of_geometries(spark):
    r = spark.range(1).select(G.to_wkt(shapes()["inner"]).alias("w"), G.to_geojson(shapes()["inner"]).alias("j")).collect()[0]
    assert r["w"] == "POLYGON ((1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 2.0, 1.0 1.0))"
    back = spark.createDataFrame([(r["j"],)], "j string").select(G.from_geojson(F.col("j")).alias("g"), shapes()["inner"].alias("h")).collect()[0]
    assert back["g"] == back["h"]


# CRS, warping, radar, mosaics.


@pytest.mark.parametrize(("target", "x", "y"), [("EPSG:3857", -13580977.88, 4721671.57), ("EPSG:32610", 589141.4, 4304867.5)])
def test_known_places(spark, target, x, y):
    got = spark.range(1).select(*C.transform(F.lit(-122.0), F.lit(38.9), "EPSG:4326", target)).collect()[0]
    want = {"EPSG:3857": (math.radians(-122) * 6378137, math.log(math.tan(math.pi / 4 + math.radians(38.9) / 2)) * 6378137)}.get(target)
    if want:
        assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])
    a, b = C.transform(F.lit(got[0]), F.lit(got[1]), target, "EPSG:4326")
    back = spark.range(1).select(a, b).collect()[0]
    assert back[0] == pytest.approx(-122, abs=1e-8) and back[1] == pytest.approx(38.9, abs=1e-8)


def test_utm_along_the_central_meridian(spark):
    # The scaled meridian arc to 45 degrees on WGS84.
    x, y = spark.range(1).select(*C.transform(F.lit(-123.0), F.lit(45.0), "EPSG:4326", "EPSG:32610")).collect()[0]
    assert x == pytest.approx(500000, abs=1e-6) and y == pytest.approx(4982950.400, abs=0.01)


def test_other_crs_is_an_error():
    with pytest.raises(ValueError):
        C.transform(F.lit(1.0), F.lit(1.0), "EPSG:4326", "EPSG:2056")
    assert C.epsg("urn:ogc:def:crs:EPSG::32610") == 32610 and C.supported("EPSG:3857") and not C.supported("EPSG:32661")


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic", "cubic_spline", "lanczos", "average", "mode"])
def test_reprojected_plane(spark, method):
    a = np.fromfunction(lambda r, c: 3.0 * c, (30, 30))
    g = Grid.from_bounds(10, 40, 11, 41, 30, 30, crs="EPSG:4326")
    out, t = warp.reproject_raster(cells(spark, a), g, "EPSG:3857", method)
    b = array(out, (t.height, t.width))
    assert b.shape[0] > b.shape[1] and np.isfinite(b).mean() > 0.8
    inner = b[5:-5, 5:-5]
    assert np.nanmin(np.diff(np.nanmedian(inner, axis=0))) >= 0 and abs(np.nanmean(b) - a.mean()) < 3


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
def test_resampling_by_blocks(spark, method):
    """Against sums cell by cell, with holes, over many blocks; no target cell is shuffled."""
    rng = np.random.default_rng(7)
    a = np.where(rng.random((19, 13)) < 0.2, np.nan, rng.random((19, 13)))
    to = Grid(31, 23)
    place = lambda df: df.withColumns({"_sr": F.col("row") * 0.83 + F.col("col") * 0.11 - 1.03, "_sc": F.col("col") * 0.47 - F.col("row") * 0.07 + 0.21})
    out = warp.warped(cells(spark, a), grid(a), to, place, method, block=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any("Join" in x and "row#" in x for x in plan.splitlines())
    got = {(r["row"], r["col"]): r["value"] for r in out.collect()}
    assert len(got) == 31 * 23
    x3 = lambda x: 1.5 * x**3 - 2.5 * x**2 + 1 if x <= 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0
    weight, k = {"nearest": (lambda x: 1.0, 0), "bilinear": (lambda x: max(0.0, 1 - x), 1), "cubic": (x3, 2)}[method]
    for (r, c), v in got.items():
        sr, sc = r * 0.83 + c * 0.11 - 1.03, c * 0.47 - r * 0.07 + 0.21
        i, j = math.floor(sr), math.floor(sc)
        near = [(weight(abs(y + 0.5 - sr)) * weight(abs(x + 0.5 - sc)), a[y, x]) for y in range(i - k, i + k + 1) for x in range(j - k, j + k + 1) if 0 <= y < 19 and 0 <= x < 13 and not math.isnan(a[y, x])]
        own = 0 <= i < 19 and 0 <= j < 13 and not math.isnan(a[i, j])
        want = sum(w * z for w, z in near) / sum(w for w, _ in near) if own and abs(sum(w for w, _ in near)) > 1e-12 else None
        assert v == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-9))


def test_average_of_blocks(spark):
    a = np.fromfunction(lambda r, c: r * 10 + c, (4, 6))
    got = array(mosaic.overview(cells(spark, a), 2, "average"), (2, 3))
    assert np.allclose(got, a.reshape(2, 2, 3, 2).mean(axis=(1, 3)))
    assert mosaic.overview_factors(1024, 2048, 256) == [2, 4] and mosaic.overview_factors(300, 300, 256) == [2] and mosaic.overview_factors(4, 4, 256) == []
    assert array(mosaic.overview(cells(spark, np.full((4, 4), 7.0)), 2, "bilinear"), (2, 2)).tolist() == [[7, 7], [7, 7]]


def test_pyramid_round_trip(spark, tmp_path):
    a = np.arange(40.0 * 50).reshape(40, 50)
    tiled = mosaic.build_cog(cells(spark, a), grid(a), 16)
    mosaic.write_cog(tiled, str(tmp_path / "cog"), "zstd")
    back = spark.read.parquet(str(tmp_path / "cog"))
    assert {r[0] for r in back.select("level").distinct().collect()} == {0, 2}
    assert np.array_equal(array(mosaic.untile(back.where("level = 0"), 16), a.shape), a)


def complex_cells(spark, z):
    return spark.createDataFrame([(i, j, float(v.real), float(v.imag)) for (i, j), v in np.ndenumerate(np.asarray(z))], "row int, col int, re double, im double")


def test_sigma0(spark):
    z = np.array([[2 + 0j, 0 + 3j], [4 + 0j, 1e20 + 1j], [0j, 0j]])
    plain = lambda v: cells(spark, v).select("row", "col", "value")
    got = array(mosaic.sigma0(complex_cells(spark, z), plain([[2.0, 2], [2, 2], [2, 2]]), plain([[1.0, 2], [3, 4], [0, 0]])), (3, 2))
    assert got[0].tolist() == [1.5, 3.5] and got[1, 0] == 6.5 and np.isnan(got[1, 1]) and np.isnan(got[2]).all()
    line = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "row int, value double")
    assert array(mosaic.sigma0(complex_cells(spark, z), plain(np.ones((3, 2))), line), (3, 2))[0].tolist() == [3, 8]


def test_multilook(spark):
    a = np.array([[1, np.nan, 9], [3, np.nan, 9]])
    got, g = mosaic.block_mean(cells(spark, a), grid(a), 2, 2)
    assert array(got, (1, 1)).tolist() == [[2.0]] and g.extent == (0, 0, 3, 2)
    z = np.array([[1 + 1j, 3 + 3j], [5 - 1j, 7 + 1j]])
    r = mosaic.multilook_complex(complex_cells(spark, z), 2, 2, 2, 2).collect()[0]
    assert (r["re"], r["im"]) == (4, 1)
    n = mosaic.normalize_interferogram(complex_cells(spark, z * np.conj(z)), complex_cells(spark, z), complex_cells(spark, z), 2, 2, 2, 2).collect()[0]
    assert math.hypot(n["re"], n["im"]) == pytest.approx(1)


def test_mosaic(spark):
    freq = np.full((6, 6), 0.8)
    freq[0] = 0.1
    passes = None
    for k, h in enumerate((100.0, 102.0, 104.0, 110.0)):
        a = np.full((6, 6), np.nan)
        a[2:4, 2:4] = h
        one = cells(spark, a, band=2, name=str(k))
        passes = one if passes is None else passes.unionByName(one)
    out, g = mosaic.water_elevation_mosaic(cells(spark, freq), passes, grid(freq))
    wse = array(out, freq.shape, "wse")
    assert np.isnan(wse[0]).all() and (wse[1:] == 103).all() and g.crs == "EPSG:4326"
    assert array(out, freq.shape, "confidence")[2, 2] == 4 and array(out, freq.shape, "confidence")[5, 5] == 0
    for how, want in (("mean", 104), ("max", 110)):
        got = mosaic.water_elevation_mosaic(cells(spark, freq), passes, grid(freq), aggregation=how, max_rounds=0)[0]
        assert array(got, freq.shape, "wse")[2, 2] == want
    coarse = mosaic.water_elevation_mosaic(cells(spark, freq), cells(spark, [[1.0, 2], [3, 4]], band=2), grid(freq), pass_size=(2, 2), max_rounds=0)[0]
    assert array(coarse, freq.shape, "wse")[[2, 2, 5, 5], [0, 5, 0, 5]].tolist() == [1, 2, 3, 4]


def test_scatter(spark):
    p = spark.createDataFrame([(0, 0.5, 0.5, 1.0), (1, 0.6, 0.4, 2.0), (2, 99.0, -99.0, 3.0)], "n long, x double, y double, v double")
    got = array(mosaic.scatter(p, Grid.from_bounds(0, 0, 3, 3, 3, 3), "x", "y", ("v",), "n"), (3, 3))
    assert got[2, 0] == 2 and got[2, 2] == 3 and np.isfinite(got).sum() == 2


def test_geocode(spark):
    a = np.fromfunction(lambda r, c: 10.0 * r + c, (20, 16))
    place = lambda r, c: (r, c, -122 + 1e-4 * c + 1e-5 * r, 37 - 1e-4 * r)
    points = [place(float(r), float(c)) for r in range(0, 20, 4) for c in range(0, 16, 3)]
    out, g = warp.geocode(cells(spark, a), Grid(16, 20), points, 11.132)
    b = array(out, (g.height, g.width))
    row, col = 8, 6
    _, _, x, y = place(row, col)
    got = b[int(float(spark.range(1).select(g.row(F.lit(y))).collect()[0][0])), int(float(spark.range(1).select(g.column(F.lit(x))).collect()[0][0]))]
    assert abs(got - a[row, col]) < 11 and np.isfinite(b).sum() > 100
    with pytest.raises(ValueError):
        warp.geocode(cells(spark, a), Grid(16, 20), points[:3])


def test_control_points_from_an_orbit():
    n, radius = 50, 6378137.0 + 890000
    t = np.linspace(-0.01, 0.01, n)
    pos = np.stack([radius * np.cos(t), np.zeros(n), radius * np.sin(t)], axis=1)
    vel = np.stack([-np.sin(t), np.zeros(n), np.cos(t)], axis=1) * 7000
    orbit = warp.Orbit(pos, vel, 891000.0, 100.0)
    points = warp.control_points_from_orbit(orbit, Grid(20, 40), 1, 4, 8, 6)
    assert len(points) == 48 and all(abs(p[3]) < 1 and 0 < abs(p[2]) < 5 for p in points)
    lon, lat = warp.ground_points(orbit, np.array([25.0]), np.array([0.0]), -1)
    on = warp._ecef(np.radians(lon), np.radians(lat), np.zeros(1))[0]
    at = np.array([np.interp(25, np.arange(n), pos[:, k]) for k in range(3)])
    assert np.linalg.norm(on - at) == pytest.approx(891000, rel=1e-6)
    with pytest.raises(ValueError):
        warp.control_points_from_orbit(warp.Orbit(pos, vel, 10.0, 1.0), Grid(4, 4), 1, 1)


def test_bucketed_join_is_the_nested_loop(spark):
    r = random.Random(4)
    box = lambda: (x := r.uniform(0, 50), y := r.uniform(0, 50), x + r.uniform(0.1, 8), y + r.uniform(0.1, 8))
    a, b = [box() for _ in range(40)], [box() for _ in range(60)]
    got = {(x["fid"], x["fid_right"]) for x in spatial.spatial_join(zones(spark, a), zones(spark, b), cell=3.0).collect() if x["fid_right"] is not None}
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] <= q[2] and p[2] >= q[0] and p[1] <= q[3] and p[3] >= q[1]}
    assert got == want


def test_rasters_on_one_grid_are_told_apart(spark):
    a = np.arange(12.0).reshape(3, 4)
    both = cells(spark, a).unionByName(cells(spark, a * 10).withColumn("raster_id", F.lit("other")))
    z = zones(spark, [(0, 0, 2, 3), (2, 0, 4, 3)])
    got = {(r["raster_id"], r["zone_id"]): r["sum"] for r in spatial.zonal_stats(both, z, grid(a), by_raster=True).collect()}
    names = sorted({k for k, _ in got})
    assert len(got) == 4 and len(names) == 2
    one = {r["zone_id"]: r["sum"] for r in spatial.zonal_stats(cells(spark, a), z, grid(a)).collect()}
    assert all(got["other", k] == 10 * v for k, v in one.items())
    points = spark.createDataFrame([("p", 0.5, 0.5, "x"), ("q", 3.5, 2.5, "y"), ("r", None, 1.0, "z")], "point_id string, x double, y double, at_row string")
    rows = spatial.sample_raster(both, points, grid(a), by_raster=True).collect()
    assert len(rows) == 6 and {(r["point_id"], r["raster_id"] == "other"): r["band_1"] for r in rows if r["point_id"] != "r"} == {("p", False): 8.0, ("p", True): 80.0, ("q", False): 3.0, ("q", True): 30.0}


def test_large_geometries_are_not_broadcast(spark):
    rows = zones(spark, [(0, 0, 1, 1)] * 5)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(spatial.small(rows)).lower()
    assert "broadcast" not in plan(spatial.small(rows, most=10)).lower() and "broadcast" not in plan(spatial.small(rows, limit=2)).lower()


def test_pits_by_region_are_pits_together(spark):
    a = np.floor(np.random.default_rng(3).random((24, 30)) * 4)
    one, two = ({(r["row"], r["col"]): r["value"] for r in hydrology.d8_flow_direction(cells(spark, a), grid(a), pits_together=n).collect()} for n in (10**6, 0))
    assert one == two and any(v < 8 for v in one.values())


def test_pits_that_nothing_can_take_are_left_alone(spark, monkeypatch):
    """Without neighbours of one height no pit is dealt out, however many there are."""
    z = np.random.default_rng(5).permutation(15 * 18).reshape(15, 18).astype(float)
    for name in ("_regions", "_resolve_pits", "_settle"):
        monkeypatch.setattr(hydrology, name, None)
    got = array(hydrology.d8_flow_direction(cells(spark, z), grid(z), pits_together=0), z.shape)
    assert (got == 9).sum() > 10 and got.min() >= 0


def swept(z):
    """Directions as d8_flow_direction says, cell by cell."""
    h, w = z.shape
    near = lambda i, j: [(d, (i + a, j + b)) for d, (a, b) in enumerate(hydrology.STEPS) if 0 <= i + a < h and 0 <= j + b < w]
    code = {}
    for i, j in np.ndindex(h, w):
        drops = [((z[i, j] - z[n]) / (math.sqrt(2) if d % 2 else 1), -d) for d, n in near(i, j)]
        most = max(drops)
        code[i, j] = -most[1] if most[0] > 0 else 8 if i in (0, h - 1) or j in (0, w - 1) else 9
    changed = True
    while changed:
        changed = False
        for k in np.ndindex(h, w):
            if code[k] == 9 and (ways := [d for d, n in near(*k) if code[n] <= 8 and z[n] <= z[k]]):
                code[k], changed = ways[0], True
    return code


@pytest.mark.parametrize(("heights", "together"), [(2, 0), (3, 0), (3, 10**6), (50, 0)])
def test_pits_by_tiles_are_swept_in_order(spark, heights, together, monkeypatch):
    """Flats that reach through many tiles; none is dealt out by region, of which a large raster has too many."""
    z = np.floor(np.random.default_rng(heights).random((21, 17)) * heights)
    z[4:15, 3:13] = heights
    z[8, 12] = 0
    monkeypatch.setattr(hydrology, "_regions", None)
    got = {(r["row"], r["col"]): r["value"] for r in hydrology.d8_flow_direction(cells(spark, z), grid(z), pits_together=together, tile=5).collect()}
    assert got == swept(z)


def test_regions(spark):
    at = [(0, 0), (1, 1), (2, 2), (5, 5), (5, 6), (9, 0), (3, 1), (8, 9)]
    pits = spark.createDataFrame([("r", 1, i, j) for i, j in at], "raster_id string, band int, row int, col int")
    got = {(r["row"], r["col"]): (r["region"]["row"], r["region"]["col"]) for r in hydrology._regions(pits).collect()}
    assert got == {(0, 0): (0, 0), (1, 1): (0, 0), (2, 2): (0, 0), (3, 1): (0, 0), (5, 5): (5, 5), (5, 6): (5, 5), (9, 0): (9, 0), (8, 9): (8, 9)}


def test_flows_through_many_tiles(spark):
    """A river that winds through all tiles, and one tile that is left alone."""
    h, w = 9, 12
    codes = np.full((h, w), 0.0)
    for r in range(h):
        codes[r, :] = 0 if r % 2 == 0 else 4
        codes[r, -1 if r % 2 == 0 else 0] = 2
    codes[-1, -1] = 8
    got = {(r["row"], r["col"]): r["value"] for r in hydrology.flow_accumulation(cells(spark, codes), grid(codes), tile=4).collect()}
    assert got[h - 1, w - 1] == h * w and got[0, 0] == 1 and got[0, 11] == 12 and got[1, 11] == 13
    ring = np.array([[0.0, 0, 0, 2], [6, 8, 8, 2], [6, 8, 8, 2], [6, 4, 4, 4]])
    with pytest.raises(ValueError, match="circle"):
        hydrology.flow_accumulation(cells(spark, ring), grid(ring), tile=2).collect()


CLARKE = P.Ellipsoid(6378206.4, 1 / 294.97870)
FOOT = 1200 / 3937
# Worked examples of the projections' published definitions: (projection, longitude, latitude, x, y, tolerance).
EXAMPLES = [
    (P.lambert_conic(28 + 23 / 60, 30 + 17 / 60, 27 + 50 / 60, -99, 2000000 * FOOT, 0, CLARKE), -96, 28.5, 2963503.91 * FOOT, 254759.80 * FOOT, 0.02),
    (P.KNOWN[3035], 5, 50, 3962799.45, 2999718.85, 0.02),
    (P.polar_stereographic(-71, 70, 6000000, 6000000), 120, -75, 7255380.79, 7053389.56, 0.02),
    (P.albers(42.122774, 49.01518, 45.568977, -84.455955, 1000000, 1000000), -78.75, 42.75, 1466493.492, 702903.006, 0.02),
]


@pytest.mark.parametrize("k", range(len(EXAMPLES)))
def test_projections_against_worked_examples(spark, k):
    projection, lon, lat, x, y, tolerance = EXAMPLES[k]
    got = spark.range(1).select(*projection.forward(F.lit(float(lon)), F.lit(float(lat)))).collect()[0]
    assert got[0] == pytest.approx(x, abs=tolerance) and got[1] == pytest.approx(y, abs=tolerance)
    back = spark.range(1).select(*projection.back(F.lit(float(x)), F.lit(float(y)))).collect()[0]
    assert back[0] == pytest.approx(lon, abs=1e-6) and back[1] == pytest.approx(lat, abs=1e-6)


@pytest.mark.parametrize("code", [*sorted(P.KNOWN), 25832, 26910])
def test_projections_there_and_back(spark, code):
    places = {2154: (3, 46), 3034: (10, 52), 3347: (-92, 60), 3035: (10, 52), 5070: (-96, 40), 3577: (134, -25), 3031: (0, -80), 3413: (-45, 75), 3976: (10, -75), 3995: (20, 78), 25832: (9, 50), 26910: (-123, 45)}
    lon0, lat0 = places[code]
    rows = [(lon0 + i * 3.7, lat0 + j * 2.9) for i in (-1, 0, 0.4, 1) for j in (-1, 0, 0.3, 1)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "lon double, lat double")
    x, y = C.transform(F.col("lon"), F.col("lat"), "EPSG:4326", f"EPSG:{code}")
    a, b = C.transform(F.col("x"), F.col("y"), f"EPSG:{code}", "EPSG:4326")
    for r in df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", a.alias("a"), b.alias("b")).collect():
        assert r["a"] == pytest.approx(r["lon"], abs=1e-7) and r["b"] == pytest.approx(r["lat"], abs=1e-7)
