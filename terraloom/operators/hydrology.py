"""Depression filling, D8 directions and flow accumulation, tile by tile.

A tile and its margin are solved in memory with numpy; what crosses tiles is passed on in
rounds until nothing changes, so a raster of any size is worked on by all executors and no task
holds more than a tile. A raster of one tile takes one round.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.raster import Grid, valid, with_neighbours
from terraloom.operators.spatial import small
from terraloom.plans.session import cut

TILE = 256
# D8 codes 0 to 7 as (row step, column step), from east clockwise.
STEPS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
OUTLET, PIT, NODATA = 8, 9, -1
_NAMES = ("e", "se", "s", "sw", "w", "nw", "n", "ne")


KEYS = ("raster_id", "band", "row", "col")
TILES = ("raster_id", "band", "_tr", "_tc")
#: So many pits of a raster that have a neighbour of their height are swept in one task; more are solved tile by tile.
PITS_TOGETHER = 20_000


def _tile_of(c: Column | str, tile: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / tile).cast("int")


def _near_tiles(c: str, tile: int) -> Column:
    """The tiles that a row or column belongs to, itself or as margin."""
    return F.array_distinct(F.array(_tile_of(c, tile), _tile_of(F.col(c) - 1, tile), _tile_of(F.col(c) + 1, tile)))


def _by_tile(cells: DataFrame, solve: Callable[[dict[str, np.ndarray]], np.ndarray], names: tuple[str, ...], out: str, tile: int, active: DataFrame | None = None) -> DataFrame:
    """cells with column `out` as solved in each tile with a margin of one cell, and what it was before as `was`.

    solve gets dense arrays of the columns named, not-a-number where no cell is, and returns
    the new values of `out`. active: only the cells of these tiles.
    """
    dealt = cells.select(*KEYS, *names).withColumn("_tr", F.explode(_near_tiles("row", tile))).withColumn("_tc", F.explode(_near_tiles("col", tile)))
    if active is not None:
        dealt = dealt.join(small(active), list(TILES), "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        i, j = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        arrays = {}
        for n in names:
            arrays[n] = np.full((i.max() + 1, j.max() + 1), np.nan)
            arrays[n][i, j] = pdf[n].to_numpy(dtype=float)
        pdf["was"] = pdf[out]
        pdf[out] = solve(arrays)[i, j]
        own = (pdf["row"] // tile == pdf["_tr"]) & (pdf["col"] // tile == pdf["_tc"])
        return pdf.loc[own, [*KEYS, *names, "was"]]

    schema = "raster_id string, band int, row int, col int, " + ", ".join(f"{n} double" for n in names) + ", was double"
    return dealt.groupBy(*TILES).applyInPandas(run, schema)


def _spread(cost: Callable[[float, float], float], base: str, value: str) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    """Dijkstra from every finite value: a neighbour gets cost(value here, base there) if that is less."""

    def solve(a: dict[str, np.ndarray]) -> np.ndarray:
        z, w = a[base], a[value].copy()
        h, n = z.shape
        heap = [(w[i, j], i, j) for i, j in zip(*np.nonzero(np.isfinite(w)), strict=True)]
        heapq.heapify(heap)
        while heap:
            v, i, j = heapq.heappop(heap)
            if v > w[i, j]:
                continue
            for di, dj in STEPS:
                x, y = i + di, j + dj
                if 0 <= x < h and 0 <= y < n and not math.isnan(z[x, y]):
                    new = cost(v, z[x, y])
                    if new < w[x, y]:
                        w[x, y] = new
                        heapq.heappush(heap, (new, x, y))
        return w

    return solve


def _settle(cells: DataFrame, solve: Callable, names: tuple[str, ...], out: str, tile: int, one: bool) -> DataFrame:
    """cells with `out` solved in every tile until no margin changes; after the first round only tiles whose margin changed are solved again."""
    rows, active = cells.select(*KEYS, *names), None
    while True:
        solved = cut(_by_tile(rows, solve, names, out, tile, active))
        if active is None:
            rows = solved.drop("was")
        else:
            own = rows.withColumn("_tr", _tile_of("row", tile)).withColumn("_tc", _tile_of("col", tile))
            rows = cut(own.join(small(active), list(TILES), "left_anti").select(*KEYS, *names).unionByName(solved.drop("was")))
        if one:
            return rows
        moved = solved.where(F.col(out) < F.col("was")).withColumn("_tr", F.explode(_near_tiles("row", tile))).withColumn("_tc", F.explode(_near_tiles("col", tile)))
        beside = (F.col("_tr") != _tile_of("row", tile)) | (F.col("_tc") != _tile_of("col", tile))
        active = cut(moved.where(beside).select(*TILES).distinct())
        if not active.take(1):
            return rows


def fill_depressions(cells: DataFrame, grid: Grid, nodata: float | None = None, apply_gradient: bool = True, epsilon: float = 1e-5, tile: int = TILE) -> DataFrame:
    """Elevations raised until every valid cell that is joined to the edge of the grid drains to it.

    Regions cut off from the edge by no-data cells stay as they are. With apply_gradient, cells
    of a flat get epsilon for each step from the nearest side where it ends, so that it drains.
    """
    nodata = grid.nodata if nodata is None else nodata
    one = grid.width <= tile and grid.height <= tile
    z = F.when(valid(F.col("value"), nodata), F.col("value"))
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == grid.height - 1) | (F.col("col") == grid.width - 1)
    start = cells.select("raster_id", "band", "row", "col", z.alias("z"), F.when(edge & z.isNotNull(), z).otherwise(F.lit(math.inf)).alias("w"))
    done = _settle(start, _spread(max, "z", "w"), ("z", "w"), "w", tile, one)
    filled = done.select("raster_id", "band", "row", "col", F.when(_number("z"), F.when(F.col("w") < math.inf, F.col("w")).otherwise(F.col("z"))).alias("value"))
    if apply_gradient:
        filled = _graded(filled, grid, epsilon, tile, one)
    return filled if nodata is None else filled.withColumn("value", F.coalesce("value", F.lit(float(nodata))))


def _number(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def _graded(cells: DataFrame, grid: Grid, epsilon: float, tile: int, one: bool) -> DataFrame:
    inner = F.col("row").between(1, grid.height - 2) & F.col("col").between(1, grid.width - 2)
    near = with_neighbours(cells, diagonals=True)
    lower = F.greatest(*[F.coalesce(F.col(n) < F.col("value"), F.lit(False)) for n in _NAMES])
    flat = near.select("raster_id", "band", "row", "col", "value", F.when(F.col("value").isNotNull(), F.when(inner & ~lower, 1.0).otherwise(0.0)).alias("flat"))
    beside = with_neighbours(flat, "flat", diagonals=True)
    seed = F.greatest(*[F.coalesce(F.col(n) == 0.0, F.lit(False)) for n in _NAMES])
    start = beside.select("raster_id", "band", "row", "col", "value", F.when(F.col("flat") == 1.0, 1.0).alias("open"), F.when(F.col("flat") == 1.0, F.when(seed, 0.0).otherwise(math.inf)).otherwise(math.inf).alias("dist"))
    done = _settle(start, _spread(lambda v, _: v + 1, "open", "dist"), ("value", "open", "dist"), "dist", tile, one)
    return done.select("raster_id", "band", "row", "col", F.when(_number("value"), F.when(F.col("dist") < math.inf, F.col("value") + F.col("dist") * epsilon).otherwise(F.col("value"))).alias("value"))


def d8_flow_direction(cells: DataFrame, grid: Grid, nodata: float | None = None, pits_together: int = PITS_TOGETHER, tile: int = TILE) -> DataFrame:
    """Codes: 0 east, then clockwise to 7 north-east; 8 outlet, 9 pit, -1 no data.

    The steepest drop wins, the lower code of equals, with diagonals over the root of two and
    the cell size left out. Cells without a lower neighbour are outlets on the grid's edge,
    else pits; then pits take, row by row until nothing changes, the first neighbour that is
    not higher and has a direction. Where pits with a neighbour of their height are few, those of a
    raster are swept in one task; else the sweep that takes each is found tile by tile.
    """
    nodata = grid.nodata if nodata is None else nodata
    z = F.when(valid(F.col("value"), nodata), F.col("value"))
    near = with_neighbours(cells.withColumn("z", z), "z", diagonals=True)
    drops = [(F.col("z") - F.col(n)) / (math.sqrt(2) if i % 2 else 1.0) for i, n in enumerate(_NAMES)]
    most = F.greatest(*[F.coalesce(d, F.lit(-math.inf)) for d in drops])
    code = F.lit(None).cast("int")
    for i, d in reversed(list(enumerate(drops))):
        code = F.when(F.coalesce(d == most, F.lit(False)), F.lit(i)).otherwise(code)
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == grid.height - 1) | (F.col("col") == grid.width - 1)
    first = F.when(F.col("z").isNull(), NODATA).when(most > 0, code).when(edge, OUTLET).otherwise(PIT)
    # A pit has no lower neighbour, so only one of its own height can take it.
    level = F.greatest(*[F.coalesce(F.col(n) == F.col("z"), F.lit(False)) for n in _NAMES])
    coded = cut(near.select(*KEYS, "z", first.cast("int").alias("code"), level.alias("level")))
    pits = coded.where((F.col("code") == PIT) & F.col("level")).select(*KEYS)
    keys = list(KEYS)
    most_pits = pits.groupBy("raster_id", "band").count().agg(F.max("count")).collect()[0][0]
    if most_pits is None:
        return coded.select(*keys, F.col("code").cast("double").alias("value"))
    if most_pits <= pits_together:
        ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        wanted = pits.select("raster_id", "band", "row", "col", F.inline(ring)).select("raster_id", "band", (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col")).distinct()
        solved = coded.drop("level").join(wanted, keys).groupBy("raster_id", "band").applyInPandas(_resolve_pits, "raster_id string, band int, row int, col int, new int")
    else:
        solved = _swept(coded.where("level").drop("level"), tile, grid.width <= tile and grid.height <= tile)
    return coded.join(solved, keys, "left").select(*keys, F.coalesce("new", "code").cast("double").alias("value"))


def _swept(level: DataFrame, tile: int, one: bool) -> DataFrame:
    """The pits that get a direction, as column new; level: the cells (z, code) that have a neighbour of their height.

    A pit is taken in the sweep of its first neighbour that has a direction by then: the same sweep if that one lies
    before it, the next if it lies behind. So the number of the sweep is a shortest way, which tiles can find in any order,
    and the direction follows from the numbers of the neighbours.
    """
    has = F.col("code").between(0, OUTLET)
    start = level.where(has | (F.col("code") == PIT)).select(*KEYS, "z", F.when(F.col("code") == PIT, 1.0).otherwise(0.0).alias("open"), F.when(has, 0.0).otherwise(math.inf).alias("sweep"))
    done = _settle(start, _sweeps, ("z", "open", "sweep"), "sweep", tile, one)
    taken = _by_tile(done.withColumn("new", F.lit(-1.0)), _taken, ("z", "open", "sweep", "new"), "new", tile)
    return taken.where("new >= 0").select(*KEYS, F.col("new").cast("int").alias("new"))


def _taken(a: dict[str, np.ndarray]) -> np.ndarray:
    """For pits, the first neighbour of their height that has a direction when they are swept, or -1."""
    h, w = a["z"].shape
    z, s = (np.pad(a[n], 1, constant_values=np.nan) for n in ("z", "sweep"))
    pit = (a["open"] == 1) & np.isfinite(a["sweep"])
    out = np.full((h, w), -1.0)
    for d, (i, j) in reversed(list(enumerate(STEPS))):
        of = (slice(1 + i, h + 1 + i), slice(1 + j, w + 1 + j))
        there = s[of] <= a["sweep"] if (i, j) < (0, 0) else s[of] < a["sweep"]
        out[pit & (z[of] == a["z"]) & there] = d
    return out


def _sweeps(a: dict[str, np.ndarray]) -> np.ndarray:
    """Dijkstra over cells of one height: from a cell before a pit in the order of rows at no cost, from one behind it at one; no pit is taken before sweep 1."""
    h, w = a["z"].shape
    frame = lambda x: np.pad(x, 1, constant_values=np.nan)
    zs, pit, sweeps = frame(a["z"]), np.nan_to_num(frame(a["open"])) == 1, np.nan_to_num(frame(a["sweep"]), nan=math.inf, posinf=math.inf)
    beside = np.zeros_like(pit)
    for i, j in STEPS:
        beside[1:-1, 1:-1] |= pit[1 + i : h + 1 + i, 1 + j : w + 1 + j]
    seeds = np.flatnonzero((beside & np.isfinite(sweeps)).ravel())
    z, open_, s = zs.ravel().tolist(), pit.ravel().tolist(), sweeps.ravel().tolist()
    heap = [(s[k], int(k)) for k in seeds]
    heapq.heapify(heap)
    steps = [i * (w + 2) + j for i, j in STEPS]
    while heap:
        v, k = heapq.heappop(heap)
        if v > s[k]:
            continue
        for d in steps:
            to = k + d
            new = max(1.0, v if d > 0 else v + 1)
            if open_[to] and new < s[to] and z[to] == z[k]:
                s[to] = new
                heapq.heappush(heap, (new, to))
    return np.array(s).reshape(h + 2, w + 2)[1:-1, 1:-1]


def _regions(pits: DataFrame) -> DataFrame:
    """pits with region: the least place of all pits that are joined to one side by side or corner to corner.

    Least places go from neighbour to neighbour, and from a place to the place that it names, until nothing changes.
    """
    place = F.struct("raster_id", "band", "row", "col")
    now = cut(pits.select(*KEYS, place.alias("at"), place.alias("region")))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in STEPS])
    there = now.select(F.col("at").alias("a"), "raster_id", "band", "row", "col", F.inline(steps)).select("a", F.struct("raster_id", "band", (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col")).alias("b"))
    edges = cut(there.join(now.select(F.col("at").alias("b")), "b"))
    while True:
        near = edges.join(now.select(F.col("at").alias("b"), F.col("region").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        least = now.join(near, F.col("at") == F.col("a"), "left").select(*KEYS, "at", F.col("region").alias("was"), F.least("region", F.coalesce("theirs", "region")).alias("region"))
        least = cut(least)
        jump = least.select(F.col("at").alias("of"), F.col("region").alias("further"))
        new = cut(least.join(jump, F.col("region") == F.col("of"), "left").select(*KEYS, "at", "was", F.least("region", F.coalesce("further", "region")).alias("region")))
        if not new.where("region != was").take(1):
            return new.drop("was", "at")
        now = new.drop("was")


def _resolve_pits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Directions for pits, swept row by row in place until a sweep changes nothing."""
    pdf = pdf.sort_values(["row", "col"])
    z = dict(zip(zip(pdf["row"], pdf["col"], strict=True), pdf["z"], strict=True))
    code = dict(zip(z, pdf["code"], strict=True))
    open_ = [k for k, v in code.items() if v == PIT]
    before = open_
    changed = True
    while changed and open_:
        changed, rest = False, []
        for k in open_:
            for d, (i, j) in enumerate(STEPS):
                to = (k[0] + i, k[1] + j)
                if to in code and 0 <= code[to] <= OUTLET and z[to] <= z[k]:
                    code[k] = d
                    changed = True
                    break
            else:
                rest.append(k)
        open_ = rest
    out = [(k[0], k[1], code[k]) for k in before]
    made = pd.DataFrame(out, columns=["row", "col", "new"])
    made.insert(0, "band", pdf["band"].iloc[0])
    made.insert(0, "raster_id", pdf["raster_id"].iloc[0])
    return made


def _drain(a: dict[str, np.ndarray]) -> np.ndarray:
    """Accumulation inside a tile; its margin passes nothing on."""
    code, own = a["code"], np.nan_to_num(a["own"])
    h, w = code.shape
    live = (code >= 0) & (code <= PIT)
    target = np.full(h * w, -1)
    rows, cols = np.nonzero(live & (code < OUTLET) & ~np.isnan(a["inner"]))
    for d, (i, j) in enumerate(STEPS):
        m = code[rows, cols] == d
        x, y = rows[m] + i, cols[m] + j
        ok = (x >= 0) & (x < h) & (y >= 0) & (y < w)
        x, y, f = x[ok], y[ok], rows[m][ok] * w + cols[m][ok]
        ok = live[x, y] & ~np.isnan(a["inner"][x, y])
        target[f[ok]] = x[ok] * w + y[ok]
    acc = own.ravel().copy()
    wait = np.bincount(target[target >= 0], minlength=h * w)
    stack = list(np.flatnonzero(wait == 0))
    left = h * w
    while stack:
        k = stack.pop()
        left -= 1
        t = target[k]
        if t >= 0:
            acc[t] += acc[k]
            wait[t] -= 1
            if not wait[t]:
                stack.append(t)
    if left:
        raise ValueError("flow directions run in a circle")
    return acc.reshape(h, w)


def flow_accumulation(directions: DataFrame, grid: Grid, weight: float = 1.0, tile: int = TILE) -> DataFrame:
    """The weight of each cell and all that drain through it; -1 where there is no direction.

    Directions that run in a circle are an error. Every tile is solved once; what leaves it enters
    the next one as a flow of its own, which goes down its way there and out again, round by round,
    through the tiles that it reaches alone. Flows add up.
    """
    keys, code = list(KEYS), F.col("code")
    cells = directions.select(*keys, F.when(F.col("value").between(0, PIT), F.col("value")).otherwise(-1.0).alias("code"))
    valid_cells = cut(cells.withColumn("own", F.when(code >= 0, F.lit(float(weight)))))
    total = abs(float(weight)) * (valid_cells.where(code >= 0).count() + 1)
    step = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in STEPS]), code.cast("int") + 1)

    def leaving(solved: DataFrame) -> DataFrame:
        """What flows into cells of other tiles."""
        there = solved.where((code >= 0) & (code < OUTLET) & (F.col("own") != 0)).select("raster_id", "band", (F.col("row") + step(0)).cast("int").alias("row"), (F.col("col") + step(1)).cast("int").alias("col"), "own", _tile_of("row", tile).alias("fr"), _tile_of("col", tile).alias("fc"))
        out = there.where((F.col("fr") != _tile_of("row", tile)) | (F.col("fc") != _tile_of("col", tile)))
        return cut(out.groupBy(*keys).agg(F.sum("own").alias("inflow")))

    done = _solve_tiles(valid_cells, tile)
    result = lambda rows: rows.select(*keys, F.when(code >= 0, F.col("own")).otherwise(-1.0).alias("value"))
    if grid.width <= tile and grid.height <= tile:
        return result(done)
    flows, entered = [], None
    inflow = leaving(done)
    while inflow.take(1):
        entered = inflow if entered is None else cut(entered.unionByName(inflow).groupBy(*keys).agg(F.sum("inflow").alias("inflow")))
        if entered.agg(F.max(F.abs("inflow"))).collect()[0][0] > total * (1 + 1e-9):
            raise ValueError("flow directions run in a circle")
        tiles = small(cut(inflow.select("raster_id", "band", _tile_of("row", tile).alias("_tr"), _tile_of("col", tile).alias("_tc")).distinct()))
        reached = valid_cells.withColumn("_tr", _tile_of("row", tile)).withColumn("_tc", _tile_of("col", tile)).join(tiles, list(TILES), "left_semi")
        entering = reached.join(inflow, keys, "left").select(*keys, "code", F.coalesce("inflow", F.lit(0.0)).alias("own"))
        moved = _solve_tiles(entering, tile).where("own != 0")
        flows.append(moved.select(*keys, F.col("own").alias("more")))
        inflow = leaving(moved)
    if not flows:
        return result(done)
    more = flows[0]
    for x in flows[1:]:
        more = more.unionByName(x)
    more = more.groupBy(*keys).agg(F.sum("more").alias("more"))
    return result(done.join(more, keys, "left").select(*keys, "code", (F.col("own") + F.coalesce("more", F.lit(0.0))).alias("own")))


def _solve_tiles(cells: DataFrame, tile: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        i, j = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        shape = (i.max() + 1, j.max() + 1)
        code, own, inner = np.full(shape, -1.0), np.zeros(shape), np.full(shape, np.nan)
        code[i, j], own[i, j], inner[i, j] = pdf["code"].to_numpy(), pdf["own"].to_numpy(dtype=float), 0.0
        pdf["own"] = _drain({"code": code, "own": own, "inner": inner})[i, j]
        return pdf[["raster_id", "band", "row", "col", "code", "own"]]

    dealt = cells.withColumn("_tr", F.floor(F.col("row") / tile)).withColumn("_tc", F.floor(F.col("col") / tile))
    return cut(dealt.groupBy("raster_id", "band", "_tr", "_tc").applyInPandas(run, "raster_id string, band int, row int, col int, code double, own double"))


def hydrology_flow(cells: DataFrame, grid: Grid, nodata: float | None = None, apply_gradient: bool = True, epsilon: float = 1e-5, weight: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filled elevations, directions, accumulation) of a DEM."""
    filled = fill_depressions(cells, grid, nodata, apply_gradient, epsilon)
    directions = d8_flow_direction(filled, grid, nodata)
    return filled, directions, flow_accumulation(directions, grid, weight)
