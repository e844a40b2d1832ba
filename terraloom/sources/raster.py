"""Readers of raster files as cells, and a GeoTIFF writer; files come through Spark's binaryFile source."""

from __future__ import annotations

import json
import pickle
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions.raster import Grid
from terraloom.plans.session import cut
from terraloom.sources import hdf5
from terraloom.sources.vector import opened, quoted, split

CELLS = "raster_id string, band int, row int, col int, value double"
# TIFF field types as (struct letter, size), and tag numbers.
TIFF_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SUBFILE, SAMPLE_FORMAT = 322, 323, 324, 325, 254, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113


#: Files over this are read tile by tile, by ranges, where the store can be opened; smaller ones as a whole.
WHOLE_BYTES = 64 << 20
#: So many neighbouring blocks go to a task, more where there would be too many tasks.
BLOCKS_TOGETHER, MOST_TASKS = 16, 20_000


class Ranges:
    """A file of which only the parts that are asked for are read; data[a:b] as of bytes."""

    BLOCK = 1 << 16

    def __init__(self, file: object, size: int) -> None:
        self.file, self.size, self.held = file, size, {}

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop - start > self.BLOCK:
            return self.file.read_at(stop - start, start)
        out = b""
        for k in range(start // self.BLOCK, -(-stop // self.BLOCK)):
            if k not in self.held:
                if len(self.held) > 64:
                    self.held.clear()
                self.held[k] = self.file.read_at(min(self.BLOCK, self.size - k * self.BLOCK), k * self.BLOCK)
            out += self.held[k]
        first = start - start // self.BLOCK * self.BLOCK
        return out[first : first + stop - start]


def ranged(path: str) -> Ranges | None:
    """A file for reading by ranges, on a mounted folder or a store that Arrow knows; None where it can't be opened."""
    from pyarrow import ArrowException, fs

    try:
        scheme, sep, rest = path.partition(":")
        if not sep or scheme == "file":
            store, at = fs.LocalFileSystem(), re.sub(r"^/+", "/", rest) if sep else path
        else:
            store, at = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
        file = store.open_input_file(at)
        return Ranges(file, file.size())
    except (ArrowException, OSError, ValueError, ImportError):
        return None


def _unpacked(form: str, data: bytes | Ranges, at: int) -> tuple:
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


def _values(data: bytes | Ranges, order: str, kind: int, count: int, at: int) -> tuple | str:
    letter, size = TIFF_TYPES[kind]
    if letter == "s":
        return data[at : at + count].split(b"\0")[0].decode("latin-1")
    return _unpacked(f"{order}{count * len(letter)}{letter[0]}", data, at)


def tiff_directories(data: bytes | Ranges) -> tuple[str, list[dict]]:
    """(byte order, tags of each image); classic and big files."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    (magic,) = _unpacked(f"{order}H", data, 2)
    big = magic == 43
    (at,) = _unpacked(f"{order}{'Q' if big else 'I'}", data, 8 if big else 4)
    found = []
    while at:
        (n,) = _unpacked(f"{order}{'Q' if big else 'H'}", data, at)
        at += 8 if big else 2
        tags = {}
        for _ in range(n):
            tag, kind = _unpacked(f"{order}2H", data, at)
            (count,) = _unpacked(f"{order}{'Q' if big else 'I'}", data, at + 4)
            inline, width = at + (12 if big else 8), 8 if big else 4
            if kind in TIFF_TYPES:
                size = count * TIFF_TYPES[kind][1]
                where = inline if size <= width else _unpacked(f"{order}{'Q' if big else 'I'}", data, inline)[0]
                tags[tag] = _values(data, order, kind, count, where)
            at += 20 if big else 12
        found.append(tags)
        (at,) = _unpacked(f"{order}{'Q' if big else 'I'}", data, at)
    return order, found


def tiff_grid(tags: dict) -> Grid:
    w, h, bands = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    a, b, c, d, e, f = 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    if TRANSFORM in tags:
        t = tags[TRANSFORM]
        a, b, c, d, e, f = t[0], t[1], t[3], t[4], t[5], t[7]
    elif PIXEL_SCALE in tags and TIEPOINT in tags:
        sx, sy, t = *tags[PIXEL_SCALE][:2], tags[TIEPOINT]
        a, e, c, f = sx, -sy, t[3] - t[0] * sx, t[4] + t[1] * sy
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4)}
    code = codes.get(3072) or codes.get(2048)
    nodata = tags.get(NODATA)
    return Grid(w, h, a, b, c, d, e, f, f"EPSG:{code}" if code and code != 32767 else None, float(nodata) if nodata else None, bands)


def _lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the high bits, widening one code early."""
    out = bytearray()
    table: list[bytes] = []
    width, acc, held, last = 9, 0, 0, None
    for byte in data:
        acc, held = acc << 8 | byte, held + 8
        while held >= width:
            held -= width
            code = acc >> held & (1 << width) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table = [bytes([i]) for i in range(256)] + [b"", b""]
                width, last = 9, None
                continue
            if last is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out += entry
            last = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n if n > 128 else 0)
            i += 2 if n != 128 else 1
    return bytes(out)


@dataclass(frozen=True)
class Blocks:
    """How an image is cut into strips or tiles, and how each is packed."""

    grid: Grid
    dtype: np.dtype
    tiled: bool
    height: int
    width: int
    compression: int
    predictor: int
    planar: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]

    @classmethod
    def of(cls, order: str, t: dict) -> Blocks:
        grid, tiled = tiff_grid(t), TILE_OFFSETS in t
        bits, form = t.get(BITS, (1,))[0], t.get(SAMPLE_FORMAT, (1,))[0]
        compression, predictor = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0]
        if compression not in UNPACK:
            raise ValueError(f"compression {compression} isn't read")
        if predictor not in (1, 2):
            raise ValueError(f"predictor {predictor} isn't read")
        offsets, sizes = (t[TILE_OFFSETS], t[TILE_BYTES]) if tiled else (t[STRIP_OFFSETS], t[STRIP_BYTES])
        height, width = (t[TILE_HEIGHT][0], t[TILE_WIDTH][0]) if tiled else (min(t.get(ROWS_PER_STRIP, (grid.height,))[0], grid.height), grid.width)
        return cls(grid, np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}"), tiled, height, width, compression, predictor, t.get(PLANAR, (1,))[0], offsets, sizes)

    def block(self, data: bytes | Ranges, i: int) -> tuple[int, int, int, np.ndarray] | None:
        """(first band, first row, first column, bands x rows x columns) of block i; None if it holds nothing."""
        across, down = -(-self.grid.width // self.width), -(-self.grid.height // self.height)
        plane, k = divmod(i, across * down)
        r, c = k // across * self.height, k % across * self.width
        rows = self.height if self.tiled else min(self.height, self.grid.height - r)
        each = self.grid.bands if self.planar == 1 else 1
        if not self.sizes[i]:
            return None
        raw = UNPACK[self.compression](data[self.offsets[i] : self.offsets[i] + self.sizes[i]])
        a = np.frombuffer(raw, dtype=self.dtype, count=rows * self.width * each).reshape(rows, self.width, each)
        if self.predictor == 2:
            a = a.cumsum(axis=1, dtype=self.dtype.newbyteorder("="))
        return plane if self.planar == 2 else 0, r, c, a[: self.grid.height - r, : self.grid.width - c].transpose(2, 0, 1)


#: How packed blocks are unpacked, by the number of the compression.
UNPACK: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def tiff_bands(data: bytes | Ranges, level: int = 0) -> tuple[Grid, np.ndarray]:
    """(grid, bands x rows x columns): uncompressed, deflate, LZW or PackBits, in strips or tiles."""
    order, found = tiff_directories(data)
    blocks = Blocks.of(order, found[level])
    grid = blocks.grid
    out = np.zeros((grid.bands, grid.height, grid.width), dtype=blocks.dtype.newbyteorder("="))
    for i in range(len(blocks.offsets)):
        if (got := blocks.block(data, i)) is not None:
            first, r, c, part = got
            out[first : first + part.shape[0], r : r + part.shape[1], c : c + part.shape[2]] = part
    return grid, out


def is_cog(data: bytes) -> bool:
    """Tiled, with at least one overview."""
    _, found = tiff_directories(data)
    return TILE_OFFSETS in found[0] and any(t.get(SUBFILE, (0,))[0] & 1 for t in found[1:])


def write_tiff(grid: Grid, bands: np.ndarray, blocksize: int = 0) -> bytes:
    """A deflated GeoTIFF of bands x rows x columns; tiled if blocksize is given."""
    bands = np.ascontiguousarray(bands)
    n, h, w = bands.shape
    blocks = []
    if blocksize:
        for b in bands:
            for r in range(0, h, blocksize):
                for c in range(0, w, blocksize):
                    x = np.zeros((blocksize, blocksize), dtype=bands.dtype)
                    part = b[r : r + blocksize, c : c + blocksize]
                    x[: part.shape[0], : part.shape[1]] = part
                    blocks.append(zlib.compress(x.tobytes()))
    else:
        blocks = [zlib.compress(b[r : r + 64].tobytes()) for b in bands for r in range(0, h, 64)]
    at, body = 8, b""
    offsets = []
    for x in blocks:
        offsets.append(at + len(body))
        body += x + b"\0" * (len(x) % 2)
    code = int(grid.crs.rsplit(":", 1)[-1]) if grid.crs else 0
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if code == 4326 else 1, 1025, 0, 1, 1, 2048 if code == 4326 else 3072, 0, 1, code]
    form = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    tags: list[tuple[int, str, list]] = [(WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [bands.dtype.itemsize * 8] * n), (COMPRESSION, "H", [8]), (262, "H", [1]), (SAMPLES, "H", [n]), (PLANAR, "H", [2]), (SAMPLE_FORMAT, "H", [form] * n)]
    tags += [(PIXEL_SCALE, "d", [grid.a, -grid.e, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, grid.c, grid.f, 0.0])]
    tags += [(TILE_WIDTH, "H", [blocksize]), (TILE_HEIGHT, "H", [blocksize]), (TILE_OFFSETS, "I", offsets), (TILE_BYTES, "I", [len(x) for x in blocks])] if blocksize else [(STRIP_OFFSETS, "I", offsets), (ROWS_PER_STRIP, "I", [64]), (STRIP_BYTES, "I", [len(x) for x in blocks])]
    if code:
        tags.append((GEO_KEYS, "H", keys))
    if grid.nodata is not None:
        tags.append((NODATA, "s", [repr(grid.nodata).encode() + b"\0"]))
    start = at + len(body)
    entries, extra = b"", b""
    room = start + 2 + 12 * len(tags) + 4
    for tag, letter, values in sorted(tags):
        raw = values[0] if letter == "s" else struct.pack(f"<{len(values)}{letter}", *values)
        count = len(raw) if letter == "s" else len(values)
        kind = {"I": 4, "H": 3, "d": 12, "s": 2}[letter]
        if len(raw) <= 4:
            entries += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind, count, room + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return b"II" + struct.pack("<HI", 42, start) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def cell_frames(name: str, bands: np.ndarray, nodata: float | None, rows: int = 64, at: tuple[int, int, int] = (0, 0, 0)) -> Iterator[pd.DataFrame]:
    """Cells of an array, some rows at a time; no data and not-a-number become null. at: the first band, row and column."""
    n, h, w = bands.shape
    for k in range(n):
        for r in range(0, h, rows):
            part = bands[k, r : r + rows].astype(float)
            gone = np.isnan(part) | (part == nodata if nodata is not None else False)
            i, j = np.indices(part.shape)
            yield pd.DataFrame({"raster_id": name, "band": np.int32(k + 1 + at[0]), "row": (i.ravel() + r + at[1]).astype(np.int32), "col": (j.ravel() + at[2]).astype(np.int32), "value": np.where(gone, np.nan, part).ravel()})


def _null(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def first_said(files: DataFrame, of: Callable[[bytes], object]) -> object:
    """What a function says of one of the files. A task reads the file; only the answer goes to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"said": [pickle.dumps(of(bytes(x))) for x in f["content"]]})

    found = files.select("content").mapInPandas(run, "said binary").take(1)
    if not found:
        raise FileNotFoundError("no file")
    return pickle.loads(bytes(found[0][0]))


def _cells_of(spark: SparkSession, path: str, bands_of: Callable[[bytes], tuple[Grid, np.ndarray]], grid_of: Callable[[bytes], Grid | None] | None = None, which: Column | None = None) -> tuple[DataFrame, Grid | None]:
    """(cells, grid) of files of one grid, each read where it is; raster_id is the path. which: only such files; then there is no grid."""
    files = spark.read.format("binaryFile").load(path)
    files = (files if which is None else files.where(which)).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                g, bands = bands_of(bytes(content))
                yield from cell_frames(name, bands, g.nodata)

    return _null(files.mapInPandas(run, CELLS)), first_said(files, grid_of or (lambda data: bands_of(data)[0])) if which is None else None


def read_geotiff(spark: SparkSession, ref: str, strict_cog: bool = False, whole_bytes: int = WHOLE_BYTES) -> tuple[DataFrame, Grid]:
    """(cells, grid) of one or many GeoTIFF files of one grid; raster_id is the path.

    Files over whole_bytes are dealt out strip by strip or tile by tile, and each task reads the ranges that it
    needs, if the driver can open the store for that; others are read by Spark, each by one task.
    """
    path = split(ref)[0]
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > whole_bytes).select("path")
    one = large.take(1)
    head = ranged(one[0]["path"]) if one else None
    if head is None:
        if strict_cog and not first_said(files, is_cog):
            raise ValueError("not a cloud-optimised GeoTIFF")
        return _cells_of(spark, path, tiff_bands, lambda data: tiff_grid(tiff_directories(data)[1][0]))
    if strict_cog and not is_cog(head):
        raise ValueError("not a cloud-optimised GeoTIFF")
    small, _ = _cells_of(spark, path, tiff_bands, which=F.col("length") <= whole_bytes)
    return small.unionByName(_null(_by_blocks(large))), tiff_grid(tiff_directories(head)[1][0])


def _by_blocks(large: DataFrame) -> DataFrame:
    """The cells of files (path), each block read by the task that it was dealt to."""

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name in f["path"]:
                order, found = tiff_directories(ranged(name))
                yield pd.DataFrame({"path": name, "block": np.arange(len(Blocks.of(order, found[0]).offsets))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple[str, Ranges, Blocks] | None = None
        for f in frames:
            for name, i in zip(f["path"], f["block"], strict=True):
                if known is None or known[0] != name:
                    data = ranged(name)
                    order, found = tiff_directories(data)
                    known = name, data, Blocks.of(order, found[0])
                _, data, blocks = known
                if (got := blocks.block(data, int(i))) is not None:
                    first, r, c, part = got
                    yield from cell_frames(name, part, blocks.grid.nodata, at=(first, r, c))

    blocks = cut(large.mapInPandas(listed, "path string, block long"))
    # Neighbouring blocks stay together: they are read side by side. The number is given, since rows are small and tasks aren't.
    together = max(1, -(-blocks.count() // MOST_TASKS), BLOCKS_TOGETHER)
    dealt = blocks.repartition(max(1, -(-blocks.count() // together)), F.col("path"), F.floor(F.col("block") / together)).sortWithinPartitions("path", "block")
    return dealt.mapInPandas(run, CELLS)


def collect_bands(cells: DataFrame, grid: Grid, dtype: str = "float64") -> np.ndarray:
    """Bands x rows x columns on the driver, for results of modest size; nulls are no data or not-a-number."""
    out = np.full((grid.bands, grid.height, grid.width), np.nan if grid.nodata is None else grid.nodata, dtype=dtype)
    for r in cells.where(F.col("value").isNotNull()).select("band", "row", "col", "value").toLocalIterator():
        out[r[0] - 1, r[1], r[2]] = r[3]
    return out


# NetCDF, classic format.

# External types of classic NetCDF.
CDF_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def netcdf(data: bytes) -> tuple[dict[str, int], dict[str, object], dict[str, dict]]:
    """(dimensions, attributes, variables) of a classic file; a variable has dims, attributes and data."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a classic NetCDF file")
    wide = data[3] == 2
    at = 4

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">i", data, at - 4)[0]

    def name() -> str:
        nonlocal at
        n = number()
        out = data[at : at + n].decode()
        at += n + -n % 4
        return out

    def attributes() -> dict[str, object]:
        nonlocal at
        number()
        out = {}
        for _ in range(number()):
            key, kind, n = name(), number(), number()
            t = np.dtype(CDF_TYPES[kind])
            raw = data[at : at + n * t.itemsize]
            at += len(raw) + -len(raw) % 4
            v = np.frombuffer(raw, dtype=t)
            out[key] = raw.rstrip(b"\0").decode() if kind == 2 else v[0].item() if n == 1 else v.tolist()
        return out

    records = number()
    number()
    dims = []
    for _ in range(number()):
        n = name()
        dims.append((n, number()))
    attrs = attributes()
    number()
    found = []
    for _ in range(number()):
        key = name()
        ids = [number() for _ in range(number())]
        a, kind, size = attributes(), number(), number()
        (begin,) = struct.unpack_from(">q" if wide else ">i", data, at)
        at += 8 if wide else 4
        found.append((key, ids, a, kind, size, begin))
    step = sum(f[4] for f in found if f[1] and dims[f[1][0]][1] == 0)
    out = {}
    for key, ids, a, kind, size, begin in found:
        t = np.dtype(CDF_TYPES[kind])
        shape = [dims[i][1] or records for i in ids]
        if ids and dims[ids[0]][1] == 0:
            each = int(np.prod(shape[1:], dtype=int))
            value = np.stack([np.frombuffer(data, dtype=t, count=each, offset=begin + k * step) for k in range(records)]).reshape(shape) if records else np.zeros(shape, dtype=t)
        else:
            value = np.frombuffer(data, dtype=t, count=int(np.prod(shape, dtype=int)), offset=begin).reshape(shape)
        out[key] = {"dims": [dims[i][0] for i in ids], "attributes": a, "data": value}
    return {n: s or records for n, s in dims}, attrs, out


def pick_variable(variables: dict[str, dict], name: str | None = None) -> str:
    """The named variable, or the first of two dimensions or more on x and y, else the first of two, else the first."""
    if name is not None:
        if name not in variables:
            raise ValueError(f"no variable {name!r}; there are {sorted(variables)}")
        return name
    flat = [k for k, v in variables.items() if len(v["dims"]) >= 2]
    words = ("lat", "lon", "x", "y", "row", "col", "north", "east")
    spatial = [k for k in flat if sum(any(w in d.lower() for w in words) for d in variables[k]["dims"][-2:]) == 2]
    return (spatial or flat or list(variables))[0]


def axis_grid(x: np.ndarray, y: np.ndarray, bands: int, crs: str | None = "EPSG:4326", nodata: float | None = None) -> Grid:
    """A grid from the centres of columns and rows; rows may run either way."""
    dx = (x[-1] - x[0]) / (len(x) - 1) if len(x) > 1 else 1.0
    dy = (y[-1] - y[0]) / (len(y) - 1) if len(y) > 1 else -1.0
    return Grid(len(x), len(y), a=float(dx), c=float(x[0] - dx / 2), e=float(dy), f=float(y[0] - dy / 2), crs=crs, nodata=nodata, bands=bands)


def read_netcdf(spark: SparkSession, ref: str) -> tuple[DataFrame, Grid]:
    """(cells, grid) of a variable (path::variable) of NetCDF files, classic ones or of version 4; the first extra axis is the band."""
    path, variable = split(ref)

    def bands_of(data: bytes) -> tuple[Grid, np.ndarray]:
        if not data.startswith(b"CDF"):  # NetCDF4 is HDF5
            return hdf5_bands(data, variable)
        _, _, found = netcdf(data)
        v = found[pick_variable(found, variable)]
        a = v["data"].astype(float)
        a = a * v["attributes"].get("scale_factor", 1) + v["attributes"].get("add_offset", 0) if "scale_factor" in v["attributes"] or "add_offset" in v["attributes"] else a
        a = a.reshape(-1, *a.shape[-2:]) if a.ndim >= 2 else a.reshape(1, 1, -1)
        nodata = v["attributes"].get("_FillValue", v["attributes"].get("missing_value"))
        if nodata is not None:
            a = np.where(v["data"].reshape(a.shape) == nodata, np.nan, a)
        axes = [found[d]["data"].astype(float) if d in found and found[d]["data"].ndim == 1 else np.arange(n) + 0.5 for d, n in zip(v["dims"][-2:], a.shape[-2:], strict=True)]
        return axis_grid(axes[1], axes[0], len(a)), a

    return _cells_of(spark, path, bands_of)


# Zarr, version 2: one task per chunk.


def read_zarr(spark: SparkSession, ref: str) -> tuple[DataFrame, Grid]:
    """(cells, grid) of an array (path::name, or the first) in a Zarr group; raw or zlib chunks."""
    path, name = split(ref)
    path = path.rstrip("/")
    metas = _small_files(spark, f"{path}/{name}/.zarray" if name else f"{path}{{,/*}}/.zarray")
    if not metas:
        raise ValueError("no array")
    at = sorted(metas)[0]
    meta, folder = json.loads(metas[at]), at[: -len("/.zarray")]
    comp = meta.get("compressor")
    if comp is not None and comp.get("id") not in ("zlib", "gzip") or meta.get("filters"):
        raise ValueError(f"{comp} isn't read")
    shape, chunks, fill = meta["shape"], meta["chunks"], meta.get("fill_value")
    if len(shape) < 2:
        raise ValueError("the array has fewer than two dimensions")
    bands = int(np.prod(shape[:-2], dtype=int))
    sep, dtype, order = meta.get("dimension_separator", "."), meta["dtype"], meta.get("order", "C")
    attrs = json.loads(next(iter(_small_files(spark, f"{folder}/.zattrs").values()), "{}"))
    crs = attrs.get("crs") or attrs.get("spatial_ref") or attrs.get("crs_wkt")
    grid = Grid(shape[-1], shape[-2], e=1.0, crs=crs, nodata=fill if isinstance(fill, (int, float)) else None, bands=bands)
    if "transform" in attrs:
        a, b, c, d, e, f = attrs["transform"][:6]
        grid = Grid(shape[-1], shape[-2], a, b, c, d, e, f, crs, grid.nodata, bands)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content").where(~F.col("path").rlike(r"/\.z\w+$"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                tail = p[p.index(folder.split("://")[-1].split(":", 1)[-1].lstrip("/")) + len(folder.split("://")[-1].split(":", 1)[-1].lstrip("/")) + 1 :]
                index = [int(i) for i in tail.split(sep)]
                raw = bytes(content) if comp is None else zlib.decompress(bytes(content), 47)
                a = np.frombuffer(raw, dtype=dtype).reshape(chunks, order=order).astype(float)
                first = [i * c for i, c in zip(index, chunks, strict=True)]
                a = a[tuple(slice(0, s - o) for s, o in zip(shape, first, strict=True))]
                where = np.indices(a.shape).reshape(len(shape), -1) + np.array(first)[:, None]
                band = np.ravel_multi_index(where[:-2], shape[:-2]) if len(shape) > 2 else np.zeros(a.size, dtype=int)
                v = a.ravel()
                yield pd.DataFrame({"raster_id": folder, "band": (band + 1).astype(np.int32), "row": where[-2].astype(np.int32), "col": where[-1].astype(np.int32), "value": np.where(v == fill, np.nan, v) if isinstance(fill, (int, float)) else v})

    return _null(files.mapInPandas(run, CELLS)), grid


def _small_files(spark: SparkSession, pattern: str) -> dict[str, str]:
    """{path: text} of metadata files; hidden ones too, which Spark's readers pass over."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for f in fs.globStatus(p) or ():
        stream = fs.open(f.getPath())
        try:
            out[f.getPath().toString()] = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    return out


# SRTM heights, map tiles, HDF5.


def read_hgt(spark: SparkSession, ref: str) -> tuple[DataFrame, Grid]:
    """(cells, grid) of an SRTM tile; its name says where it is."""
    path = split(ref)[0]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    size = int(round((files.select(F.octet_length("content")).take(1)[0][0] / 2) ** 0.5))
    stem = path.rstrip("/").rsplit("/", 1)[-1][:7].upper()
    lat, lon = int(stem[1:3]) * (1 if stem[0] == "N" else -1), int(stem[4:7]) * (1 if stem[3] == "E" else -1)
    step = 1 / (size - 1)
    grid = Grid(size, size, a=step, c=lon - step / 2, e=-step, f=lat + 1 + step / 2, crs="EPSG:4326", nodata=-32768.0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                yield from cell_frames(p, np.frombuffer(bytes(content), dtype=">i2").reshape(1, size, size), -32768)

    return _null(files.mapInPandas(run, CELLS)), grid


def read_mbtiles(spark: SparkSession, ref: str) -> DataFrame:
    """(path, format, z, x, y, data) of every tile; format is what metadata or the first bytes say. Rows count from the south."""

    def kind(meta: dict, tile: bytes) -> str:
        marks = ((b"\x89PNG", "png"), (b"\xff\xd8", "jpg"), (b"\x1f\x8b", "pbf"), (b"RIFF", "webp"))
        return meta.get("format") or next((n for m, n in marks if tile.startswith(m)), "unknown")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                db = opened(bytes(content))
                names = {r[0] for r in db.execute("SELECT name FROM sqlite_master")}
                if not {"metadata", "tiles"} <= names:
                    raise ValueError(f"{p}: metadata and tiles are required")
                meta = dict(db.execute("SELECT name, value FROM metadata").fetchall())
                rows = db.execute(f"SELECT zoom_level, tile_column, tile_row, tile_data FROM {quoted('tiles')}")
                while part := rows.fetchmany(500):
                    yield pd.DataFrame([(p, kind(meta, r[3]), *r) for r in part], columns=["path", "format", "z", "x", "y", "data"])

    return spark.read.format("binaryFile").load(split(ref)[0]).select("path", "content").mapInPandas(run, "path string, format string, z int, x int, y int, data binary")


def pick_dataset(shapes: dict[str, tuple[int, ...]], coordinates: frozenset[str] = frozenset()) -> str:
    """Of arrays by path, the largest of two dimensions or more that isn't a coordinate; ties by path."""
    flat = {k: int(np.prod(v, dtype=int)) for k, v in shapes.items() if len(v) >= 2 and k not in coordinates}
    if not flat:
        raise ValueError("no array of two dimensions")
    return min(flat, key=lambda k: (-flat[k], k))


# Names of coordinate arrays.
X_NAMES, Y_NAMES = frozenset("lon longitude x".split()), frozenset("lat latitude y".split())


def _role(path: str, units: str) -> str | None:
    """Whether an array is the coordinate of columns (x) or rows (y), by its name or its units."""
    leaf = path.rsplit("/", 1)[-1].lower()
    return "x" if leaf in X_NAMES or re.match(r"degrees?_?e", units) else "y" if leaf in Y_NAMES or re.match(r"degrees?_?n", units) else None


def _axes(arrays: dict[str, hdf5.Array], name: str, height: int, width: int) -> tuple[str | None, str | None]:
    """The arrays of column and row coordinates of an array: those that it names, else its siblings, else those of the root, if their sizes fit."""
    group = name.rpartition("/")[0]
    named = [f"{group}/{n}" if group else n for n in str(arrays[name].attributes.get("coordinates", "")).split()]
    beside = [k for k in arrays if k.rpartition("/")[0] == group]
    found: dict[str, str] = {}
    for candidates in (named, beside, [k for k in arrays if "/" not in k]):
        for k in candidates:
            role = _role(k, str(arrays[k].attributes.get("units", "")).lower()) if k in arrays and k != name else None
            if role and arrays[k].shape in ((width,) if role == "x" else (height,), (height, width)):
                found.setdefault(role, k)
    return found.get("x"), found.get("y")


def hdf5_bands(data: bytes, name: str | None = None) -> tuple[Grid, np.ndarray]:
    """(grid, bands) of an array by path, or of the largest that isn't a coordinate.

    An (H, W, 2) array of floats is two bands, real and imaginary; of others the first axes are bands.
    Values at _FillValue are no data, scale_factor and add_offset are applied. Without coordinates
    the grid is in cells.
    """
    arrays, groups = hdf5.opened(data)
    coordinates = frozenset(k for k, v in arrays.items() if _role(k, str(v.attributes.get("units", "")).lower()))
    path = (name or "").strip("/") or pick_dataset({k: v.shape for k, v in arrays.items() if v.dtype.kind in "iuf"}, coordinates)
    if path not in arrays:
        raise ValueError(f"no array {path!r}; there are {sorted(arrays)}")
    given = arrays[path].attributes
    raw = arrays[path].read()
    a = raw.astype(float)
    for gone in (given.get("_FillValue"), given.get("missing_value")):
        if gone is not None:
            a[raw == gone] = np.nan
    a = a * given.get("scale_factor", 1) + given.get("add_offset", 0)
    a = a.transpose(2, 0, 1) if a.ndim == 3 and a.shape[-1] == 2 and raw.dtype.kind == "f" else a.reshape(-1, *a.shape[-2:]) if a.ndim >= 2 else a.reshape(1, 1, -1)
    x, y = _axes(arrays, path, *a.shape[1:])
    if x is None or y is None:
        return Grid(a.shape[2], a.shape[1], bands=len(a)), a
    xs, ys = arrays[x].read().astype(float), arrays[y].read().astype(float)
    said = next((str(v) for k in ("crs", "crs_wkt", "spatial_ref") for v in (given.get(k), groups.get("", {}).get(k)) if v), None)
    degrees = any(str(arrays[k].attributes.get("units", "")).lower().startswith("degree") or k.rsplit("/", 1)[-1].lower() not in ("x", "y") for k in (x, y))
    code = re.search(r"EPSG\D{0,4}(\d{4,6})", said) if said else None
    crs = f"EPSG:{code[1]}" if code else "EPSG:4326" if degrees else None
    return axis_grid(xs[0] if xs.ndim == 2 else xs, ys[:, 0] if ys.ndim == 2 else ys, len(a), crs), a


def read_hdf5(spark: SparkSession, ref: str) -> tuple[DataFrame, Grid]:
    """(cells, grid) of an array (path::/name, or the largest) of HDF5 files, as hdf5_bands() has them."""
    path, name = split(ref)
    return _cells_of(spark, path, lambda data: hdf5_bands(data, name))
