"""Products of the SWOT mission: radar images, pixel clouds and stacks of water frequency.

Files are HDF5; all but the opening of them works on mappings from names to arrays, and on
DataFrames of points.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions.raster import Grid
from terraloom.operators.mosaic import scatter
from terraloom.sources import hdf5
from terraloom.sources.raster import CELLS, cell_frames, first_said
from terraloom.sources.vector import split

# Datasets of a radar image as name, path and role; values of a pixel cloud; attributes of products.
SLC_DATASETS = (
    ("slc_plus_y", "/slc/slc_plus_y", "data"), ("slc_minus_y", "/slc/slc_minus_y", "data"), ("xfactor_plus_y", "/xfactor/xfactor_plus_y", "calibration"),
    ("xfactor_minus_y", "/xfactor/xfactor_minus_y", "calibration"), ("noise_plus_y", "/noise/noise_plus_y", "noise"), ("noise_minus_y", "/noise/noise_minus_y", "noise"),
)
CLOUD_VALUES = ("sig0", "height", "water_frac", "classification")
COMMON = (("tile_name", "tile_name", str), ("cycle", "cycle_number", int), ("pass_number", "pass_number", int), ("swath_side", "swath_side", str), ("time_start", "time_coverage_start", str), ("time_end", "time_coverage_end", str), ("lat_min", "geospatial_lat_min", float), ("lat_max", "geospatial_lat_max", float), ("lon_min", "geospatial_lon_min", float), ("lon_max", "geospatial_lon_max", float))
RADAR = (("transmit_antenna", "transmit_antenna", str), ("wavelength_m", "wavelength", float), ("near_range_m", "near_range", float), ("range_spacing_m", "nominal_slant_range_spacing", float), ("azimuth_resolution_m", "slc_along_track_resolution", float))


def attribute(value: Any) -> Any:
    """A plain value of an attribute: arrays of one are their item, bytes are text."""
    if isinstance(value, np.ndarray):
        value = value.item() if value.size == 1 else value.tolist()
    if isinstance(value, np.generic):
        value = value.item()
    return value.decode() if isinstance(value, bytes) else value


def metadata(attributes: Mapping[str, Any], radar: bool = False) -> dict[str, Any]:
    """Named attributes of a product; those that are missing are empty or zero."""
    out = {}
    for name, key, kind in COMMON + RADAR * radar:
        v = attribute(attributes.get(key, "" if kind is str else 0))
        out[name] = kind(v[0] if isinstance(v, list) and v else v)
    return out


def slc_catalogue(spark: SparkSession, present: list[str] | None = None) -> DataFrame:
    """(name, path, role) of a radar image's datasets, of those present if they are given."""
    rows = [r for r in SLC_DATASETS if present is None or r[1] in present or r[1].lstrip("/") in present]
    if not rows:
        raise ValueError("none of the datasets of a radar image")
    return spark.createDataFrame(rows, "name string, path string, role string")


def cloud_grid(bounds: tuple[float, float, float, float], resolution: float) -> Grid:
    """The grid of a pixel cloud: square cells from the south-west corner."""
    west, south, east, north = bounds
    w, h = max(1, int(np.ceil((east - west) / resolution - 1e-9))), max(1, int(np.ceil((north - south) / resolution - 1e-9)))
    return Grid(w, h, a=resolution, c=west, e=-resolution, f=south + h * resolution, crs="EPSG:4326", bands=len(CLOUD_VALUES))


def cloud_cells(points: DataFrame, resolution: float, grid: Grid | None = None) -> tuple[DataFrame, Grid]:
    """Cells of a pixel cloud (ordinal, longitude, latitude and values), a band per value; the last point of a cell wins."""
    known = points.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull() & ~F.isnan("longitude") & ~F.isnan("latitude"))
    if grid is None:
        b = known.agg(F.min("longitude"), F.min("latitude"), F.max("longitude"), F.max("latitude")).collect()[0]
        if b[0] is None:
            raise ValueError("no point has a place")
        grid = cloud_grid(tuple(b), resolution)
    return scatter(known, grid, "longitude", "latitude", CLOUD_VALUES, "ordinal"), grid


def stack_bands(arrays: Mapping[str, np.ndarray], wanted: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """(names, bands x rows x columns) of a stack: arrays of two dimensions or more, of three the first slice."""
    flat = [k for k, v in arrays.items() if v.ndim >= 2]
    names = [n for n in (wanted or flat) if n in flat]
    if not names:
        raise ValueError(f"no such bands; there are {flat}")
    return names, np.stack([(arrays[n][0] if arrays[n].ndim == 3 else arrays[n]).astype(float) for n in names])


def stack_grid(arrays: Mapping[str, np.ndarray], bands: np.ndarray) -> Grid:
    """Where a stack lies, by its coordinate arrays x and y or lon and lat; else in cells."""
    h, w = bands.shape[1:]
    for x, y in (("x", "y"), ("lon", "lat"), ("longitude", "latitude")):
        if x in arrays and y in arrays:
            return Grid.from_bounds(float(arrays[x].min()), float(arrays[y].min()), float(arrays[x].max()), float(arrays[y].max()), w, h, crs="EPSG:4326", bands=len(bands))
    return Grid.from_bounds(0, 0, w, h, w, h, crs="EPSG:4326", bands=len(bands))


def _arrays(data: bytes) -> dict[str, np.ndarray]:
    return {k: v.read() for k, v in hdf5.opened(data)[0].items()}


def read_stack(spark: SparkSession, ref: str, wanted: list[str] | None = None) -> tuple[DataFrame, Grid]:
    """(cells, grid) of stack files of one grid."""
    files = spark.read.format("binaryFile").load(split(ref)[0]).select("path", "content")

    def grid_of(data: bytes) -> Grid:
        arrays = _arrays(data)
        return stack_grid(arrays, stack_bands(arrays, wanted)[1])

    grid = first_said(files, grid_of)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                yield from cell_frames(path, stack_bands(_arrays(bytes(content)), wanted)[1], None)

    return files.mapInPandas(run, CELLS).withColumn("value", F.when(~F.isnan("value"), F.col("value"))), grid


def read_cloud(spark: SparkSession, ref: str) -> DataFrame:
    """(ordinal, longitude, latitude, sig0, height, water_frac, classification) of pixel-cloud files."""
    names = ("longitude", "latitude", *CLOUD_VALUES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                arrays = _arrays(bytes(content))
                missing = [n for n in names if f"pixel_cloud/{n}" not in arrays]
                if missing:
                    raise ValueError(f"missing: {missing}")
                part = pd.DataFrame({n: arrays[f"pixel_cloud/{n}"].astype(float) for n in names})
                part.insert(0, "ordinal", np.arange(len(part)))
                yield part

    return spark.read.format("binaryFile").load(split(ref)[0]).select("content").mapInPandas(run, "ordinal long, " + ", ".join(f"{n} double" for n in names))
