import json
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest

from terraloom import checks, cli
from terraloom.functions.raster import Grid
from terraloom.model import FILE, Dataset, Kind, State, Verdict, overall
from terraloom.plans.executor import OPERATORS, Executor, build_params, coerce, exit_code, get_operator, hydrology_run, materialize, raster_dataset
from terraloom.plans.registry import Registry, Run, ancestry
from terraloom.plans.route import NoRouteError, Reader, RefKind, Router, SourceRef, default_router
from terraloom.plans.session import TIDY, cut, ensure_checkpoint_dir, shared_dir, tidy
from terraloom.sources.raster import write_tiff
from tests.test_operators import cells, grid, zones


def dataset(name="d", **kw):
    return Dataset(Kind.TABLE, name, FILE, "/x", **kw)


def test_model():
    d = dataset(metadata={"crs": "x", "extent": 1, "bounds": 2, "temporal_start": 3, "mine": {"a": [1, 2]}})
    assert json.loads(d.metadata) == {"mine": {"a": [1, 2]}} and d.state == State.UNCHECKED and d.is_materialized
    t = {"temporal_start": datetime(2024, 1, 1, tzinfo=UTC), "temporal_end": datetime(2024, 1, 2, tzinfo=UTC), "temporal_resolution": timedelta(days=1), "temporal_observation_count": 2}
    checked = dataset(**t).with_verdict(Verdict("a", State.VALID)).with_verdict(Verdict("b", State.WARN))
    assert checked.temporal_end == t["temporal_end"] and checked.state == State.WARN and overall([Verdict("x", State.INVALID), Verdict("y", State.WARN)]) == State.INVALID
    assert checked.id == checked.but(name="e").id and checked.but(name="e").name == "e" and checked.name == "d"
    with pytest.raises(AttributeError):
        d.name = "x"
    with pytest.raises(AttributeError):
        d.nothing  # noqa: B018
    for bad in ({"temporal_start": datetime(2024, 1, 1)}, {"temporal_start": datetime(2024, 1, 1), "temporal_end": datetime(2024, 1, 2)}, {"temporal_resolution": timedelta(0)}, {"temporal_observation_count": 0}, {"temporal_start": datetime(2024, 1, 2, tzinfo=UTC), "temporal_end": datetime(2024, 1, 1, tzinfo=UTC)}, {"extent": (1, 2)}):
        with pytest.raises(ValueError):
            dataset(**bad)
    with pytest.raises(TypeError):
        dataset(colour="red")


@pytest.mark.parametrize(
    ("raw", "kind", "reader"),
    [
        ("https://h/a.tif", RefKind.REMOTE_URI, "cog"), ("s3://b/a.csv", RefKind.REMOTE_URI, "object_store"), ("http://h/a.fgb", RefKind.REMOTE_URI, "flatgeobuf"), ("SELECT 1", RefKind.DATABASE, "postgis"), ("a.duckdb::t", RefKind.DUCKDB, "duckdb"),
        ("/a/b.tif", RefKind.LOCAL_RASTER, "cog"), ("./b.gpkg::l", RefKind.LOCAL_VECTOR, "geopackage"), ("x/b.csv", RefKind.LOCAL_TABLE, "csv_xy"), ("c/item::red", RefKind.CATALOG_ITEM, "stac"), ("public.roads", RefKind.DATABASE, "postgis"),
        ("data.h5", RefKind.LOCAL_RASTER, "hdf5"), ("wms::https://h/ows::a.b", RefKind.CATALOG_ITEM, "ogc"), ("overture://places/place", RefKind.CATALOG_ITEM, "overture"), ("opentopo://COP30?0&0&1&1", RefKind.CATALOG_ITEM, "opentopography"),
        ("/a/b.geojson", RefKind.LOCAL_VECTOR, "local_file"), ("/a/f.hgt", RefKind.LOCAL_RASTER, "local_file"), ("x.zarr::t", RefKind.LOCAL_RASTER, "zarr"), ("/d", RefKind.LOCAL_PATH, "local_file"),
    ],
)
def test_routes(raw, kind, reader):
    ref = SourceRef.infer(raw)
    assert ref.kind == kind and default_router().select_one(raw) == reader


def test_router_order():
    r = Router((Reader("late", frozenset({RefKind.UNKNOWN}), last_resort=True), Reader("b", frozenset({RefKind.UNKNOWN}), order=5), Reader("a", frozenset({RefKind.UNKNOWN}), order=5)))
    assert r.select("word") == ["b", "a", "late"]
    with pytest.raises(NoRouteError):
        default_router().select_one("word")
    assert SourceRef("a", RefKind.UNKNOWN, {"x": 1}) != SourceRef("a", RefKind.UNKNOWN) and hash(SourceRef("a", RefKind.UNKNOWN, {"x": 1})) == hash(SourceRef("a"))


def test_parameters():
    assert coerce("1.5", float | None) == 1.5 and coerce("none", float | None) is None and coerce("yes", bool) is True
    assert coerce("(1, 2)", tuple[float, float]) == (1.0, 2.0) and coerce("a,b", tuple[str, ...]) == ("a", "b") and coerce("[1,2]", list[int]) == [1, 2]
    p = build_params(get_operator("slope"), {"units": "percent", "nodata": "-1"})
    assert (p.units, p.nodata, p.output_nodata) == ("percent", -1.0, -9999.0)
    for bad in ({"nope": "1"}, {"nodata": "x"}):
        with pytest.raises(ValueError):
            build_params(get_operator("slope"), bad)
    with pytest.raises(KeyError):
        get_operator("nope")
    assert len(OPERATORS) == 16


@pytest.fixture
def registry(spark, tmp_path):
    return Registry(spark, str(tmp_path / "registry"))


def test_registry(registry):
    assert registry.datasets().count() == 0 and registry.stats()["datasets"] == 0
    a = dataset("a", crs="EPSG:4326", extent=(0.0, 1.0, 2.0, 3.0), resolution=(1.0, 1.0), feature_count=5, metadata={"k": [1]}, temporal_start=datetime(2024, 1, 1, tzinfo=UTC), temporal_end=datetime(2024, 1, 1, tzinfo=UTC), temporal_resolution=timedelta(hours=1))
    b = dataset("b", operation="slope", inputs=[a.id], params={"u": 1}).with_verdict(Verdict("c", State.WARN, "m"))
    registry.save_dataset(a)
    registry.save_run(Run("slope", (a.id,), {"u": 1}, "completed", b, b.verdicts))
    got = registry.get_dataset(a.id)
    assert got.row() == a.row() and got.kind == Kind.TABLE and registry.get_dataset("none") is None
    assert registry.get_dataset(b.id).verdicts[0].state == State.WARN and registry.get_dataset(b.id).inputs == (a.id,)
    assert [r["id"] for r in registry.parents(b.id).collect()] == [a.id] and [r["id"] for r in registry.children(a.id).collect()] == [b.id]
    registry.save_dataset(dataset("a2", id=a.id))
    assert registry.datasets().count() == 2 and registry.get_dataset(a.id).name == "a2"
    registry.save_lineage(a.id, b.id, "slope")
    assert registry.lineage().count() == 1
    s = registry.stats()
    assert (s["datasets"], s["runs"], s["by_status"], s["edges"]) == (2, 1, {"completed": 1}, 1)
    registry.save_check(a.id, Verdict("x", State.VALID))
    assert registry.checks(a.id).count() == 1 and registry.runs("failed").count() == 0 and registry.runs().count() == 1


def test_a_save_that_fails_leaves_nothing(registry, monkeypatch):
    registry.save_dataset(dataset("a"))
    monkeypatch.setattr(Registry, "_edges", staticmethod(lambda d: [("only one",)]))
    with pytest.raises(Exception):  # noqa: B017
        registry.save_dataset(dataset("b"))
    assert registry.datasets().count() == 1


def test_ancestry_does_not_sort_all_edges(spark, tmp_path, monkeypatch):
    """Edges saved twice count once, and the table of all edges is neither ranked nor shuffled."""
    held = Registry(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("q", "z", "x")], "parent string, child string, operation string")
    held.save_frames(lineage=rows)
    held.save_frames(lineage=rows)
    monkeypatch.setattr(Registry, "lineage", None)
    got = sorted(tuple(r) for r in held.full_lineage("c").collect())
    assert got == [("a", "b", "x", 2), ("b", "c", "x", 1)]


def test_ancestry_of_circles(spark):
    e = spark.createDataFrame([("a", "b", "o"), ("b", "c", "o"), ("c", "a", "o"), ("x", "c", "o"), ("q", "r", "o")], "parent string, child string, operation string")
    got = {(r["parent"], r["child"]): r["depth"] for r in ancestry(e, "c").collect()}
    assert got == {("b", "c"): 1, ("x", "c"): 1, ("a", "b"): 2, ("c", "a"): 3}
    assert ancestry(e, "nobody").count() == 0


def test_executor_and_checks(spark, registry):
    a = np.array([[9.0, 9, 9, 9], [9, 1, 2, 9], [9, 3, 4, 8], [9, 9, 9, 9]])
    dem = raster_dataset("dem", cells(spark, a), grid(a, crs="EPSG:32610"))
    ex = Executor(registry)
    runs = hydrology_run(ex, dem)
    assert [r.status for r in runs] == ["completed"] * 3 and [exit_code(r) for r in runs] == [0, 0, 0]
    names = {c.check: c.state for r in runs for c in r.checks}
    assert names["no_interior_pits"] == names["elevation_only_raised"] == names["conservation"] == names["valid_code_set"] == names["all_valid_assigned"] == State.VALID
    assert ex.status(runs[0].id) == "completed" and ex.wait(runs[0].id) is runs[0]
    assert registry.full_lineage(runs[2].output.id).count() == 3
    bad = ex.submit("slope", [dem], {"units": "nope"})
    assert bad.status == "failed" and "units" in bad.error and exit_code(bad) == 1
    assert ex.submit("slope", []).status == "failed" and ex.submit("zonal_stats", [dem, dem]).status == "failed"
    z = Dataset(Kind.VECTOR, "z", df=zones(spark, [(0, 0, 2, 2), (2, 2, 4, 4)]), crs="EPSG:32610")
    got = ex.submit("zonal_stats", [dem, z])
    assert got.status == "completed" and got.output.df.count() == 2 and all(c.state == State.VALID for c in got.checks)
    clip = ex.submit("clip_raster", [dem], {"bounds": (0, 0, 2, 2)})
    assert clip.status == "completed" and clip.output.grid.width == 2 and ex.submit("clip_raster", [dem, z]).status == "completed"
    other = Dataset(Kind.VECTOR, "o", df=z.df, crs="EPSG:4326")
    assert "CRS" in ex.submit("spatial_join", [z, other]).error
    for name, params in (("aspect", {}), ("hillshade", {}), ("build_cog", {"blocksize": 16})):
        assert ex.submit(name, [dem], params).status == "completed"
    assert exit_code(ex.submit("build_cog", [dem], {"blocksize": 16})) == 2  # no overview


def test_descriptor_checks(spark, tmp_path):
    d = lambda crs, e: dataset(crs=crs, extent=e)
    assert checks.crs_valid(d(None, None)).state == State.INVALID and checks.crs_valid(d("EPSG:4326", None)).state == State.VALID
    assert checks.extent_sane(d("EPSG:4326", (0, 0, 500, 1))).state == State.WARN and checks.extent_sane(d("EPSG:3857", (0, 0, 500, 1))).state == State.VALID
    assert checks.extent_sane(d(None, (1, 0, 1, 1))).state == State.INVALID and checks.extent_sane(d(None, None)).state == State.INVALID
    path = str(tmp_path / "t")
    df = spark.range(3)
    df.write.parquet(path)
    at = lambda p: Dataset(Kind.TABLE, "t", FILE, p, df=df)
    assert checks.backing_accessible(at(path)).state == State.VALID and checks.backing_accessible(at(path + "x")).state == State.INVALID
    assert checks.backing_accessible(Dataset(Kind.TABLE, "t", df=df)).state == State.WARN
    one = cells(spark, [[1.0, 2.0]])
    assert [c.state for c in checks.sigma0_checks(one)] == [State.VALID, State.VALID]
    assert checks.internal_outlets(cells(spark, [[0.0, -1.0]])) == 1
    assert checks.dimensions_sane(Grid(200_000, 1)).state == State.INVALID


def test_materialize_and_command_line(spark, tmp_path, capsys):
    a = np.fromfunction(lambda r, c: r + c, (8, 9))
    g = Grid.from_bounds(0, 0, 9, 8, 9, 8, crs="EPSG:32610")
    (tmp_path / "dem.tif").write_bytes(write_tiff(g, a[None]))
    d = materialize(spark, str(tmp_path / "dem.tif"))
    assert d.kind == Kind.RASTER and d.grid == g and d.df.count() == 72
    (tmp_path / "p.csv").write_text("n,lon,lat\na,1,2\n")
    assert materialize(spark, str(tmp_path / "p.csv")).kind == Kind.VECTOR
    base = ["--registry", str(tmp_path / "r"), "--json"]
    assert cli.main([*base, "route", "a.tif"]) == 0 and cli.main([*base, "route", "word"]) == 2
    capsys.readouterr()
    assert cli.main([*base, "run", "slope", str(tmp_path / "dem.tif"), "-p", "units=m_m", "-o", str(tmp_path / "out")], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out[0]["status"] == "completed" and out[0]["checks"]["valid"] == 3
    assert spark.read.parquet(str(tmp_path / "out")).agg({"value": "max"}).collect()[0][0] == pytest.approx(2**0.5)
    assert cli.main([*base, "run", "hydrology", str(tmp_path / "dem.tif")], spark) == 0
    assert cli.main([*base, "run", "slope", str(tmp_path / "dem.tif"), "-p", "bad=1"], spark) == 1
    capsys.readouterr()
    assert cli.main([*base, "runs", "list"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)) == 4
    assert cli.main([*base, "datasets", "list", "--kind", "raster"], spark) == 0
    assert cli.main([*base, "lineage", out[0]["output"]], spark) == 0 and cli.main([*base, "checks", out[0]["output"]], spark) == 0
    assert cli.main([*base, "stats"], spark) == 0 and cli.main([*base, "runs", "show", out[0]["id"]], spark) == 0 and cli.main([*base, "datasets", "show", "none"], spark) == 1


class _Somewhere:
    """As much of a session as is asked for the shared folder."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.master, self.folder = self, master, folder

    def getConf(self):  # noqa: N802
        return {"spark.checkpoint.dir": self.folder} if self.folder else {}

    def getCheckpointDir(self):  # noqa: N802
        return None

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "k8s://https://h", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Somewhere(master))
    assert ensure_checkpoint_dir(_Somewhere(master, "hdfs://h/c"))
    assert shared_dir(_Somewhere(master, "hdfs://h/c")) == "hdfs://h/c"


def test_own_queries_are_tidy(spark):
    before = {k: spark.conf.get(k, None) for k in TIDY}
    with tidy(spark):
        assert {k: spark.conf.get(k) for k in TIDY} == TIDY
    assert {k: spark.conf.get(k, None) for k in TIDY} == before
    assert cut(spark.range(100).repartition(7)).count() == 100 and {k: spark.conf.get(k, None) for k in TIDY} == before
