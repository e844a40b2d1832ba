"""Operators by name with typed parameters, readers by name, and running them with records."""

from __future__ import annotations

import json
import types
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, is_dataclass, make_dataclass, replace
from inspect import signature
from typing import Any, Literal, Union, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom import checks
from terraloom.functions.raster import Grid, valid
from terraloom.model import DUCKDB, FILE, HANDLE, POSTGIS, Dataset, Kind, State, Verdict, now
from terraloom.operators import hydrology, mosaic, spatial, terrain, warp
from terraloom.plans.registry import Registry, Run
from terraloom.plans.route import RefKind, Router, SourceRef, default_router, extension
from terraloom.sources import raster, vector
from terraloom.sources.remote import read_duckdb, read_overture, read_postgis, store_path
from terraloom.sources.services import Access, ogc_fetch, opentopography_fetch, stac_fetch


class OperatorError(RuntimeError):
    pass


@dataclass(frozen=True)
class Spec:
    """What an operator takes: kinds of inputs in order, what it gives, and its scale."""

    name: str
    inputs: tuple[Kind, ...]
    output: Kind
    function: Callable[..., Any]
    scale: str = "medium"
    least: int | None = None  # fewer inputs than named are fine from here on

    @property
    def params(self) -> type:
        """A frozen dataclass of the parameters, with the function's defaults."""
        hints = get_type_hints(self.function)
        # DataFrames and grids come from the inputs.
        given = [(p.name, hints[p.name], p.default) for p in signature(self.function).parameters.values() if hints.get(p.name) not in (DataFrame, Grid, DataFrame | None)]
        required = [(n, t) for n, t, d in given if d is p_empty]
        optional = [(n, t, d) for n, t, d in given if d is not p_empty]
        return make_dataclass(f"{self.name.title().replace('_', '')}Params", [*required, *optional], frozen=True)


p_empty = signature(lambda x: x).parameters["x"].default
R, V, T = Kind.RASTER, Kind.VECTOR, Kind.TABLE


def _clip(cells: DataFrame, grid: Grid, mask: DataFrame | None = None, bounds: tuple[float, float, float, float] | None = None, crop: bool = True) -> tuple[DataFrame, Grid]:
    if (mask is None) == (bounds is None):
        raise ValueError("give bounds or a mask")
    return spatial.clip_bounds(cells, grid, *bounds) if bounds else spatial.clip_mask(cells, grid, mask, crop)


def _slc(slc: DataFrame, xfactor: DataFrame, noise: DataFrame, grid: Grid, az_looks: int = 4, rg_looks: int = 4) -> tuple[DataFrame, Grid]:
    """Radar rasters as cells: of the first, band 1 is the real and band 2 the imaginary part."""
    part = lambda b: F.max(F.when(F.col("band") == b, F.col("value")))
    both = slc.groupBy("row", "col").agg(part(1).alias("re"), part(2).alias("im"))
    one = lambda d: d.where("band = 1").select("row", "col", "value")
    return mosaic.slc_calibrate(both, one(xfactor), one(noise), grid, az_looks, rg_looks)


OPERATORS: dict[str, Spec] = {
    s.name: s
    for s in (
        Spec("clip_raster", (R, V), R, _clip, "light", 1),
        Spec("reproject", (R,), R, warp.reproject_raster),
        Spec("fill_depressions", (R,), R, hydrology.fill_depressions),
        Spec("slope", (R,), R, terrain.slope),
        Spec("aspect", (R,), R, terrain.aspect),
        Spec("hillshade", (R,), R, terrain.hillshade),
        Spec("d8_flow_direction", (R,), R, hydrology.d8_flow_direction),
        Spec("flow_accumulation", (R,), R, hydrology.flow_accumulation),
        Spec("zonal_stats", (R, V), T, spatial.zonal_stats),
        Spec("spatial_join", (V, V), V, spatial.spatial_join),
        Spec("sample_raster", (R, V), V, spatial.sample_raster, "light"),
        Spec("rasterize_vector", (V,), R, spatial.rasterize),
        Spec("build_cog", (R,), T, mosaic.build_cog),
        Spec("slc_calibrate", (R, R, R), R, _slc, "heavy"),
        Spec("water_elevation_mosaic", (R, R), R, mosaic.water_elevation_mosaic, "heavy"),
        Spec("geocode_slc", (R,), R, warp.geocode, "heavy"),
    )
}


def get_operator(name: str) -> Spec:
    if name not in OPERATORS:
        raise KeyError(f"no operator {name!r}; there are {sorted(OPERATORS)}")
    return OPERATORS[name]


def coerce(text: str, kind: Any) -> Any:
    """A value of a type from text: optional, literal, list, tuple (of any length too), bool, int, float, str."""
    origin, args = get_origin(kind), get_args(kind)
    if origin in (Union, types.UnionType):
        if type(None) in args and text.strip().lower() in ("", "none", "null"):
            return None
        for a in args:
            if a is not type(None):
                try:
                    return coerce(text, a)
                except (ValueError, TypeError):
                    continue
        raise ValueError(f"{text!r} isn't {kind}")
    if origin is Literal:
        for a in args:
            if text == str(a):
                return a
        raise ValueError(f"{text!r} isn't one of {args}")
    if origin in (list, tuple):
        items = [x.strip() for x in text.strip("[]() ").split(",") if x.strip()]
        if origin is list:
            return [coerce(x, args[0] if args else str) for x in items]
        if len(args) == 2 and args[1] is Ellipsis:
            return tuple(coerce(x, args[0]) for x in items)
        if len(items) != len(args):
            raise ValueError(f"{text!r} doesn't have {len(args)} parts")
        return tuple(coerce(x, a) for x, a in zip(items, args, strict=True))
    if kind is bool:
        if text.lower() not in ("1", "0", "true", "false", "yes", "no"):
            raise ValueError(f"{text!r} is neither true nor false")
        return text.lower() in ("1", "true", "yes")
    return text if kind in (str, Any) else kind(text)


def build_params(spec: Spec, texts: Mapping[str, str]) -> Any:
    kinds = {f.name: f.type for f in fields(spec.params)}
    unknown = sorted(set(texts) - set(kinds))
    if unknown:
        raise ValueError(f"{spec.name} has no parameter {unknown}")
    return spec.params(**{k: coerce(v, kinds[k]) for k, v in texts.items()})


def raster_dataset(name: str, df: DataFrame, grid: Grid, **kw: Any) -> Dataset:
    return Dataset(R, name, df=df, grid=grid, crs=grid.crs, extent=tuple(map(float, grid.extent)), resolution=tuple(map(float, grid.resolution)), band_count=grid.bands, **kw)


def _fetched(spark: SparkSession, reader: str, raw: str, access: Access, options: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """(path, metadata) of what a service sent for a reference."""
    if reader == "stac":
        path, item = stac_fetch(spark, access, options["endpoint"], raw)
        return path, {"item": item["id"], "collection": item.get("collection")}
    if reader == "ogc":
        return ogc_fetch(spark, access, raw, **options), {}
    return opentopography_fetch(spark, access, raw, **options), {}


def materialize(spark: SparkSession, ref: SourceRef | str, router: Router | None = None, access: Access | None = None, **options: Any) -> Dataset:
    """A dataset from a reference, by the reader that the router selects. Rows stay lazy.

    What comes over HTTP is fetched to the shared folder first, with the headers and keys of access.
    options are those of the service: endpoint (STAC), bbox, width, height, crs, max_features (OGC),
    base and release (Overture), url (PostGIS).
    """
    known = SourceRef.infer(ref) if isinstance(ref, str) else ref
    raw, remote = known.raw, known.kind == RefKind.REMOTE_URI
    reader = (router or default_router()).select_one(known)
    access = access or Access()
    if reader in ("stac", "ogc", "opentopography"):
        path, more = _fetched(spark, reader, raw, access, options)
        got = materialize(spark, SourceRef.file(path), router)
        return got.but(name=raw, params={"reader": reader, "ref": raw}, metadata=json.loads(got.metadata) | more)
    if remote and raw.lower().startswith("http"):
        path = access.fetch(spark, raw)
        return materialize(spark, SourceRef.file(path), router).but(name=raw, params={"reader": reader, "ref": raw})
    if reader == "overture":
        return Dataset(V, raw, df=read_overture(spark, raw, **options), crs="EPSG:4326", operation="materialize", params={"reader": reader, "ref": raw})
    if reader == "postgis":
        return Dataset(T, raw, POSTGIS, raw, df=read_postgis(spark, options.pop("url"), raw, **options), operation="materialize", params={"reader": reader, "ref": raw})
    at = store_path(raw) if remote else raw
    if reader == "object_store":
        # An object is read by what its extension says that it is; only where it lies is another matter.
        reader = (router or default_router()).select_one(SourceRef.file(raw))
    origin = {"operation": "materialize", "params": {"reader": reader, "ref": raw}}
    where = {"store": HANDLE if remote else FILE, "uri": vector.split(raw)[0]}
    rasters = {"cog": raster.read_geotiff, "netcdf": raster.read_netcdf, "zarr": raster.read_zarr, "hdf5": raster.read_hdf5}
    if reader == "local_file" and extension(raw) == "hgt":
        return raster_dataset(raw, *raster.read_hgt(spark, at), **where, **origin)
    if reader in rasters:
        return raster_dataset(raw, *rasters[reader](spark, at), **where, **origin)
    tables = {"csv_xy": vector.read_csv_xy, "excel_xy": vector.read_excel_xy}
    if reader in tables:
        df, crs = tables[reader](spark, at)
        return Dataset(V if crs else T, raw, df=df, crs=crs, **where, **origin)
    if reader == "duckdb":
        return Dataset(T, raw, DUCKDB, raw, df=read_duckdb(spark, raw), **origin)
    from terraloom.sources.flatgeobuf import read_flatgeobuf

    vectors = {"flatgeobuf": read_flatgeobuf, "geojsonseq": vector.read_geojsonseq, "topojson": vector.read_topojson, "gpx": vector.read_gpx, "kmz": vector.read_kmz, "geopackage": vector.read_geopackage, "spatialite": vector.read_spatialite, "shapefile": vector.read_shapefile, "local_file": vector.read_geojson, "geoparquet": vector.read_geoparquet, "las": vector.read_las, "mbtiles": raster.read_mbtiles}
    if reader not in vectors:
        raise OperatorError(f"{reader} needs parameters of its own; see terraloom.sources.remote")
    df = vectors[reader](spark, at)
    if "geom" not in df.columns:
        return Dataset(T, raw, df=df, **where, **origin)
    return Dataset(V, raw, df=df, crs=vector.source_crs(spark, reader, at), **where, **origin)


class Executor:
    """Runs operators in this process; Spark does the work when the rows are asked for."""

    def __init__(self, registry: Registry | None = None) -> None:
        self.registry = registry
        self.runs: dict[str, Run] = {}

    def submit(self, name: str, inputs: list[Dataset], params: Any = None) -> Run:
        """The record of a run, completed or failed; errors of validation and execution are in it."""
        spec = get_operator(name)
        params = params if params is not None else {}
        values = {f.name: getattr(params, f.name) for f in fields(params)} if is_dataclass(params) else dict(params)
        run = Run(name, tuple(d.id for d in inputs), {k: repr(v) for k, v in values.items()}, started_at=now())
        try:
            out = self._execute(spec, inputs, values)
            run = replace(run, status="completed", output=out, checks=out.verdicts, finished_at=now())
        except Exception as e:
            run = replace(run, status="failed", error=f"{type(e).__name__}: {e}", finished_at=now())
        self.runs[run.id] = run
        if self.registry is not None:
            self.registry.save_run(run)
        return run

    def status(self, run_id: str) -> str:
        return self.runs[run_id].status

    def wait(self, run_id: str) -> Run:
        return self.runs[run_id]

    def _execute(self, spec: Spec, inputs: list[Dataset], values: dict[str, Any]) -> Dataset:
        if not (spec.least if spec.least is not None else len(spec.inputs)) <= len(inputs) <= len(spec.inputs):
            raise OperatorError(f"{spec.name} takes {len(spec.inputs)} inputs, not {len(inputs)}")
        for d, kind in zip(inputs, spec.inputs, strict=False):
            if d.kind != kind and kind != T:
                raise OperatorError(f"{spec.name} takes a {kind} where {d.name} is a {d.kind}")
        named = [d.crs for d in inputs if d.crs]
        if spec.name == "spatial_join" and len(set(named)) > 1:
            raise OperatorError(f"CRSs differ: {named}")
        hints = get_type_hints(spec.function)
        args: dict[str, Any] = {}
        rows, grids = iter([d.df for d in inputs]), iter([d.grid for d in inputs if d.grid is not None])
        for p in signature(spec.function).parameters:
            if hints.get(p) in (DataFrame, DataFrame | None):
                args[p] = next(rows, None)
            elif hints.get(p) is Grid:
                args[p] = next(grids)
        got = spec.function(**args, **values)
        df, grid = got if isinstance(got, tuple) else (got, inputs[0].grid if spec.output == R else None)
        if isinstance(got, tuple) and spec.output != R:
            df = got[0]
        origin = {"operation": spec.name, "inputs": [d.id for d in inputs], "params": {k: repr(v) for k, v in values.items()}}
        out = raster_dataset(spec.name, df, grid, **origin) if spec.output == R else Dataset(spec.output, spec.name, df=df, crs=inputs[0].crs, **origin)
        return out.with_verdict(*self._checks(spec, inputs, out, values))

    @staticmethod
    def _checks(spec: Spec, inputs: list[Dataset], out: Dataset, values: dict[str, Any]) -> list[Verdict]:
        """The operator's checks; those of rows run jobs."""
        first, n = inputs[0], spec.name
        nodata = values.get("nodata", first.grid.nodata if first.grid else None)
        found: list[Verdict] = []
        if n in ("clip_raster", "reproject", "zonal_stats", "sample_raster", "spatial_join", "rasterize_vector", "water_elevation_mosaic", "geocode_slc"):
            found.append(checks.crs_valid(out))
        if n in ("reproject", "water_elevation_mosaic", "geocode_slc"):
            found.append(checks.extent_sane(out))
        if n == "clip_raster":
            found.append(checks.extent_within_input(out.grid, first.grid))
        if n == "reproject":
            found.append(checks.crs_matches_target(out, values["target_crs"]))
        if n == "fill_depressions":
            found += [checks.no_interior_pits(out.df, out.grid, nodata), checks.elevation_only_raised(first.df, out.df)]
        if n in ("slope", "aspect", "hillshade"):
            gone = values.get("output_nodata", 0.0 if n == "hillshade" else -9999.0)
            top = {"slope": 90.0 if values.get("units", "degrees") == "degrees" else float("inf"), "aspect": 360.0, "hillshade": 255.0}[n]
            found += [checks.valid_range(out.df, min(0.0, values.get("flat_value", -1.0)), top, gone), checks.nodata_preserved(first.df, out.df, nodata, gone), checks.resolution_consistent(first.grid, out.grid)]
        if n == "d8_flow_direction":
            found += checks.d8_checks(out.df, out.grid, first.df.where(valid(F.col("value"), nodata)).count())
        if n == "flow_accumulation":
            found += checks.accumulation_checks(first.df, out.df, values.get("weight", 1.0))
        if n == "zonal_stats":
            found += [checks.row_count_matches(out.df, inputs[1].df.count()), checks.schema_complete(out.df, spatial.STATISTICS)]
        if n == "sample_raster":
            found.append(checks.row_count_matches(out.df, inputs[1].df.count()))
        if n == "spatial_join":
            found += [checks.left_features_preserved(first.df, out.df), checks.schema_no_collision(first.df, inputs[1].df)]
        if n == "rasterize_vector":
            found += [checks.dimensions_sane(out.grid), checks.nodata_background(out.df, values.get("nodata", 0.0))]
        if n == "build_cog":
            found.append(checks.is_cog(out.df))
        if n == "slc_calibrate":
            found += checks.sigma0_checks(out.df)
        if n == "water_elevation_mosaic":
            found.append(checks.min_observations(out.df))
        if n == "geocode_slc":
            found.append(checks.gcp_count_sufficient(len(values["points"])))
        return found


def hydrology_run(executor: Executor, dem: Dataset, nodata: float | None = None, apply_gradient: bool = True, epsilon: float = 1e-5, weight: float = 1.0) -> list[Run]:
    """Fill, directions and accumulation, each recorded; stops at the first that fails."""
    if executor.registry is not None:
        executor.registry.save_dataset(dem)
    runs, now_ = [], dem
    for name, params in (("fill_depressions", {"nodata": nodata, "apply_gradient": apply_gradient, "epsilon": epsilon}), ("d8_flow_direction", {"nodata": nodata}), ("flow_accumulation", {"weight": weight})):
        run = executor.submit(name, [now_], params)
        runs.append(run)
        if run.status != "completed":
            break
        now_ = run.output
    return runs


def exit_code(run: Run) -> int:
    """0 for a good run, 1 for a failed one, 2 where a check is invalid."""
    return 1 if run.status != "completed" else 2 if any(c.state == State.INVALID for c in run.checks) else 0
