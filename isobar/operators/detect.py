"""Storm detection on gridded fields, and stitching of the detected nodes.

Candidates are local pressure minima inside a closed contour with a warm core;
nodes of following times are linked to the nearest one in reach.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import great_circle
from ..session import checkpointed
from . import regrid
from .validate import InvalidData

#: Cells of the grids that are searched at once, at most (a larger grid goes alone).
CELLS = 1 << 20


def _degrees(lat1, lon1, lat2, lon2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.minimum(a, 1))))


def _neighbours(reached: np.ndarray, cyclic: bool) -> np.ndarray:
    """Cells of each grid that are reached, or stand beside one that is."""
    grown = reached.copy()
    grown[..., 1:] |= reached[..., :-1]
    grown[..., :-1] |= reached[..., 1:]
    grown[..., 1:, :] |= reached[..., :-1, :]
    grown[..., :-1, :] |= reached[..., 1:, :]
    if cyclic:
        grown[..., 0] |= reached[..., -1]
        grown[..., -1] |= reached[..., 0]
    return grown


class _Windows:
    """Windows around places of one grid's axes, of which many are asked for again."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, cyclic: bool):
        self.lat, self.lon, self.cyclic = lat, lon, cyclic
        self.known: dict[tuple[int, int, float], tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = {}
        self.held = 0

    def around(self, i: int, j: int, distance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Rows and columns of a window that has the cells up to a distance from (i, j) and
        those beside them, the distances in it, and whether its columns go round."""
        key = (i, j, distance)
        if key not in self.known:
            if self.held > CELLS:
                self.known, self.held = {}, 0
            self.known[key] = self._around(*key)
            self.held += self.known[key][2].size
        return self.known[key]

    def _around(self, i: int, j: int, distance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        lat, lon, n = self.lat, self.lon, len(self.lon)
        rows = np.nonzero(np.abs(lat - lat[i]) <= distance + 1e-6)[0]
        rows = np.arange(max(rows[0] - 1, 0), min(rows[-1] + 2, len(lat)))
        columns = (np.arange(n) + j - n // 2) % n if self.cyclic else np.arange(n)
        d = _degrees(lat[i], lon[j], lat[rows, None], lon[None, columns])
        near = np.nonzero((d <= distance).any(0))[0]
        a, b = max(near[0] - 1, 0), min(near[-1] + 2, n)
        if self.cyclic and (near[0] == 0 or near[-1] == n - 1):
            a, b = 0, n
        return rows, columns[a:b], d[:, a:b], self.cyclic and b - a == n

    def within(self, i: int, j: int, distance: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the cells up to a distance from (i, j)."""
        rows, columns, d, _ = self.around(i, j, distance)
        a, b = np.nonzero(d <= distance)
        return rows[a], columns[b]


def closed(fields: np.ndarray, of: np.ndarray, windows: _Windows, i: int, j: int, delta: float, distance: float) -> np.ndarray:
    """Of the grids numbered ``of`` (fields: grids x lat x lon): does the field rise by delta
    (fall, if negative) from (i, j) on every way out to the distance?  The cells that are
    reached below that level grow by whole rows of neighbours, until they end or lie
    beyond the distance."""
    rows, columns, d, cyclic = windows.around(i, j, distance)
    far = d > distance
    here = (slice(None), int(np.nonzero(rows == i)[0][0]), int(np.nonzero(columns == j)[0][0]))
    field = (1.0 if delta > 0 else -1.0) * fields[of[:, None, None], rows[:, None], columns]
    below = field < (field[here] + abs(delta))[:, None, None]
    reached = np.zeros(field.shape, bool)
    reached[here] = True
    escaped = np.zeros(len(of), bool)
    while True:
        grown = _neighbours(reached, cyclic) & below
        grown[here] = True
        escaped |= (grown & far).any((1, 2))
        if (escaped | (grown == reached).all((1, 2))).all():
            return ~escaped
        reached = grown


@dataclass(frozen=True)
class Tiles:
    """A sphere cut into bands of ``size`` degrees of latitude, and each band into tiles
    about as wide where it is widest, fewer towards the poles; ``halo`` degrees around a
    tile belong to what it sees."""

    size: float
    halo: float

    @property
    def bands(self) -> int:
        return max(1, math.ceil(180 / self.size - 1e-9))

    def _half(self, band: int) -> float:
        """Half the longitudes that a band's halo has beyond a tile's ends."""
        top = max(abs(-90 + band * self.size - self.halo), abs(-90 + (band + 1) * self.size + self.halo))
        if top + self.halo >= 90:
            return 180.0
        return math.degrees(math.asin(min(1.0, math.sin(math.radians(self.halo)) / math.cos(math.radians(top)))))

    def count(self, band: int) -> int:
        """Tiles of a band: one where its halo goes round the pole."""
        if self._half(band) >= 90:
            return 1
        a, b = -90 + band * self.size, min(90.0, -90 + (band + 1) * self.size)
        widest = 1.0 if a <= 0 <= b else max(math.cos(math.radians(a)), math.cos(math.radians(b)))
        return max(1, round(360 * widest / self.size))

    def _seen(self, band: int) -> Column:
        """The tiles of one band that see a place."""
        lat, lon = F.col("lat"), F.pmod(F.col("lon"), F.lit(360.0))
        low, high, n = -90 + band * self.size, -90 + (band + 1) * self.size, self.count(band)
        own = (lat >= low) & (F.lit(True) if band == self.bands - 1 else lat < high)
        width, half = 360 / n, self._half(band)
        home = F.least(F.floor(lon / width), F.lit(n - 1)).cast("int")
        if n == 1 or 2 * half + width >= 360:
            tiles = F.sequence(F.lit(0), F.lit(n - 1))
        else:
            ends = [F.floor((lon + off) / width).cast("int") for off in (-half, half)]
            tiles = F.array_distinct(F.transform(F.sequence(*ends), lambda x: F.pmod(x, F.lit(n))))
        entries = F.transform(tiles, lambda t: F.struct(F.lit(band).alias("band"), t.alias("tile"), (own & (t == home)).alias("own")))
        return F.when(lat.between(low - self.halo, high + self.halo), entries).otherwise(F.slice(entries, 1, 0))

    def seen(self) -> Column:
        """Array of (band, tile, own) of the tiles that see a place (lat, lon)."""
        return F.concat(*[self._seen(band) for band in range(self.bands)])


def _numbers(group: pa.Table, name: str) -> np.ndarray:
    """A column as floats; null is not a number."""
    return group.column(name).to_numpy().astype(float)


def _window(group: pa.Table, columns: list[str], middle: float | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, bool]:
    """Fields as latitude x longitude, the axes, and whether the longitudes go round.
    Longitudes are as they came, in order from the far side of the middle on."""
    lon = _numbers(group, "lon")
    turned = lon if middle is None else (lon - middle + 180) % 360
    lats, i = np.unique(_numbers(group, "lat"), return_inverse=True)
    order, first, j = np.unique(np.round(turned, 9), return_index=True, return_inverse=True)
    grid = {}
    for c in columns:
        grid[c] = np.full((len(lats), len(order)), np.nan)
        grid[c][i, j] = _numbers(group, c)
    return grid, lats, lon[first], _goes_round(order)


def _goes_round(lon: np.ndarray) -> bool:
    """Do longitudes, in order, close the circle?"""
    step = np.median(np.diff(lon)) if len(lon) > 1 else 360.0
    return bool(lon[0] + 360 - lon[-1] <= 1.5 * step)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of lists: begin and length of each (-1: null) in the values, as floats."""
    offsets = column.offsets.to_numpy()
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1)
    return offsets[:-1], length, column.values.to_numpy(zero_copy_only=False).astype(float, copy=False)


def _alike(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of a batch of grids that have the same axes, CELLS of cells at most at a
    time, and these axes.  Rows without places are left out."""
    (i, n, lat), (j, m, lon) = _lists(batch["lat"]), _lists(batch["lon"])
    rows: dict[tuple[bytes, bytes], list[int]] = {}
    for k in np.nonzero((n > 0) & (m > 0))[0]:
        rows.setdefault((lat[i[k] : i[k] + n[k]].tobytes(), lon[j[k] : j[k] + m[k]].tobytes()), []).append(int(k))
    for (a, b), own in rows.items():
        y, x = np.frombuffer(a), np.frombuffer(b)
        most = max(1, CELLS // (len(y) * len(x)))
        for k in range(0, len(own), most):
            yield np.array(own[k : k + most]), y, x


def _stack(column: pa.Array, rows: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Rows of a column of grids as grids x lat x lon; null is not a number."""
    begin, length, values = _lists(column)
    cells, known = shape[0] * shape[1], length[rows] >= 0
    if (length[rows][known] != cells).any():
        raise ValueError(f"a grid of {shape[0]} x {shape[1]} places has other than {cells} values")
    out = np.full((len(rows), cells), np.nan)
    out[known] = values[begin[rows][known][:, None] + np.arange(cells)]
    return out.reshape(len(rows), *shape)


@dataclass(frozen=True)
class Reading:
    """Grids that are read, or made, in the tasks that search them, so that they go through
    nothing else.  rows: a row a grid.  read, as for mapInArrow(): of the rows' batches,
    batches that have also lat and lon (the axes) and variables as arrays (see
    places()), a few grids at a time."""

    rows: DataFrame
    read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

    def over(self, change: Callable[[DataFrame], DataFrame]) -> Reading:
        """The grids of the changed rows."""
        return replace(self, rows=change(self.rows))

    def grids(self, variables: list[str]) -> DataFrame:
        """The grids as rows."""
        columns, read = [*self.rows.columns, "lat", "lon", *variables], self.read
        kinds = [f"`{c}` {k}" for c, k in self.rows.dtypes] + [f"`{c}` array<double>" for c in ("lat", "lon", *variables)]
        return self.rows.mapInArrow(lambda batches: (b.select(columns) for b in read(batches)), ", ".join(kinds))


def places(grids: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, lat, lon, values: a row a place.  grids: a row a grid, with lat and lon its axes
    and values arrays with a number for each place, row by row of latitude.  A null array
    is null at all places."""
    none = F.array_repeat(F.lit(None).cast("double"), F.size("lat") * F.size("lon"))
    zipped = F.arrays_zip(*[F.coalesce(F.col(v), none).alias(v) for v in values])
    cells = grids.select(*keys, "lat", "lon", F.posexplode(zipped).alias("_k", "_v"))
    at = F.size("lon")
    return cells.select(
        *keys, F.get("lat", F.floor(F.col("_k") / at).cast("int")).alias("lat"), F.get("lon", F.col("_k") % at).alias("lon"), *[F.col("_v")[v].alias(v) for v in values]
    )


def detect_nodes(
    fields: DataFrame | Reading, keys: list[str], psl_delta: float = 200.0, psl_dist: float = 5.5, z_delta: float = -6.0, z_dist: float = 6.5,
    z_offset: float = 1.0, merge_dist: float = 6.0, wind_dist: float = 2.0, tile: float | None = None, step: float = 2.5,
) -> DataFrame:
    """keys, lat, lon, psl, wind of nodes.  fields: keys (member, time), lat, lon, psl,
    thickness (z300 - z500), wind, on a regular grid; more columns don't matter.

    Where lat and lon are arrays, a row is a time's whole grid: they are its axes, and the
    fields are arrays of all places, row by row of latitude (see places()).  A task then
    searches its own rows, many grids at once; nothing is shuffled.  Keys are of one row
    each.  A Reading's grids are read there, too.

    Without tile, a group is one time's grid.  With it (in degrees) a group is a tile of
    a time's grid and the cells around it that its candidates' criteria can ask for, so
    grids of any size fit in tasks: every criterion ends at a distance, and ``step`` is the
    greatest step of the grid (a greater one is an error).  Nodes are the same for all
    tiles.  Candidates of a time, which can't be close to each other, are then merged by
    distance, the deepest first (of equal ones the southernmost, then the least longitude).

    A missing pressure is no minimum and stops a way out; a grid that doesn't go round
    has ends in longitude.  Empty fields have no nodes."""
    reach = max(psl_dist, z_dist + z_offset, wind_dist) + 2 * step
    tiles = Tiles(tile, reach) if tile else None
    own = ["lat", "lon", "psl", "wind"]
    of = ["psl", "thickness", "wind"]
    read = None
    if isinstance(fields, Reading):
        fields, read = (fields.grids(of), None) if tiles else (fields.rows, fields.read)
    kinds = dict(fields.dtypes)
    named = ", ".join(f"`{c}` {kinds[c]}" for c in keys)

    def nodes(psl: np.ndarray, thick: np.ndarray, wind: np.ndarray, inside: np.ndarray | bool, windows: _Windows) -> tuple[np.ndarray, np.ndarray]:
        """Number of the grid, and lat, lon, psl, wind, of the nodes of grids x lat x lon."""
        lat, lon = windows.lat, windows.lon
        edge = np.pad(psl, ((0, 0), (0, 0), (1, 1)), **({"mode": "wrap"} if windows.cyclic else {"constant_values": np.inf}))
        padded = np.pad(edge, ((0, 0), (1, 1), (0, 0)), constant_values=np.inf)
        lows = np.broadcast_to(inside, psl.shape).copy()
        for di in (0, 1, 2):
            for dj in (0, 1, 2):
                if (di, dj) != (1, 1):
                    lows &= psl < padded[:, di : di + len(lat), dj : dj + len(lon)]
        grids, at = np.nonzero(lows.reshape(len(psl), -1))
        order = np.argsort(at, kind="stable")
        cells, first = np.unique(at[order], return_index=True)
        found = []
        for cell, g in zip(cells, np.split(grids[order], first[1:]), strict=True) if len(cells) else ():
            i, j = divmod(int(cell), len(lon))
            g = g[closed(psl, g, windows, i, j, psl_delta, psl_dist)]
            # The warmest place near it; of equal ones the southernmost, then the least longitude.
            a, b = windows.within(i, j, z_offset)
            turn = np.lexsort((lon[b] % 360, lat[a]))
            a, b = a[turn], b[turn]
            near = thick[g[:, None], a, b]
            known = ~np.isnan(near).all(1)
            g, core = g[known], np.where(np.isnan(near), -np.inf, near)[known].argmax(1)
            warm = np.zeros(len(g), bool)
            for k in np.unique(core):
                warm[core == k] = closed(thick, g[core == k], windows, int(a[k]), int(b[k]), z_delta, z_dist)
            g = g[warm]
            a, b = windows.within(i, j, wind_dist)
            found.append((g, np.stack([np.full(len(g), lat[i]), np.full(len(g), lon[j]), psl[g, i, j], np.fmax.reduce(wind[g[:, None], a, b], axis=1)])))
        if not found:
            return np.zeros(0, int), np.zeros((len(own), 0))
        return np.concatenate([g for g, _ in found]), np.concatenate([x for _, x in found], axis=1)

    def kept(lat: np.ndarray, lon: np.ndarray, psl: np.ndarray) -> list[int]:
        """Of a time's nodes the deepest, and those that are far from all deeper ones."""
        out: list[int] = []
        for k in np.lexsort((lon % 360, lat, psl)):
            if not out or (_degrees(lat[k], lon[k], lat[out], lon[out]) > merge_dist).all():
                out.append(int(k))
        return out

    def numbers(values: np.ndarray) -> list[pa.Array]:
        return [pa.array(x, pa.float64(), from_pandas=True) for x in values]

    def found(group: pa.Table) -> pa.Table:
        middle = None
        if tiles:
            middle = (group["_tile"][0].as_py() + 0.5) * 360 / tiles.count(group["_band"][0].as_py())
        else:
            group = group.append_column("_own", pa.array(np.ones(len(group), bool)))
        grid, lat, lon, round_ = _window(group, [*of, "_own"], middle)
        if tiles and max(np.diff(lat).max(initial=0), np.median(np.diff(lon) % 360) if len(lon) > 1 else 0) > step + 1e-9:
            raise ValueError(f"the grid's steps are over {step} degrees")
        at, values = nodes(*[grid[c][None] for c in of], grid["_own"][None] == 1, _Windows(lat, lon, round_))
        return pa.table([*[pa.repeat(group[c][0], len(at)) for c in keys], *numbers(values)], names=[*keys, *own])

    def merged(group: pa.Table) -> pa.Table:
        stay = kept(*[_numbers(group, c) for c in ("lat", "lon", "psl")])
        return group.select([*keys, *own]).take(pa.array(stay, pa.int64()))

    def found_in_grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, windows = None, None
        for batch in batches:
            for rows, lat, lon in _alike(batch):
                (y, a), (_, b) = np.unique(lat, return_index=True), np.unique(np.round(lon, 9), return_index=True)
                psl, thick, wind = (_stack(batch[c], rows, (len(lat), len(lon)))[:, a][:, :, b] for c in of)
                if last != (axes := (lat.tobytes(), lon.tobytes())):
                    last, windows = axes, _Windows(y, lon[b], _goes_round(lon[b]))
                at, values = nodes(psl, thick, wind, True, windows)
                order = np.argsort(at, kind="stable")
                at, values = at[order], values[:, order]
                grids, first, count = np.unique(at, return_index=True, return_counts=True)
                stay = np.ones(len(at), bool)
                for k, n in zip(first[count > 1], count[count > 1], strict=True):
                    stay[k : k + n] = False
                    stay[k + np.array(kept(*values[:3, k : k + n]))] = True
                which = pa.array(rows[at[stay]], pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch[c].take(which) for c in keys], *numbers(values[:, stay])], names=[*keys, *own])

    schema = ", ".join(x for x in (named, "lat double, lon double, psl double, wind double") if x)
    if read:
        return fields.mapInArrow(lambda batches: found_in_grids(read(batches)), schema)
    gridded = kinds["lat"].startswith("array")
    if gridded and not tiles:
        return fields.select(*keys, "lat", "lon", *of).mapInArrow(found_in_grids, schema)
    cells = (places(fields, keys, of) if gridded else fields).select(*keys, "lat", "lon", *of)
    if not tiles:
        # A time's candidates are all in one group already.
        return cells.groupBy(*keys).applyInArrow(lambda group: merged(found(group)), schema)
    at = F.col("_at")
    dealt = cells.withColumn("_at", F.explode(tiles.seen())).withColumns({"_band": at["band"], "_tile": at["tile"], "_own": at["own"]}).drop("_at")
    return dealt.groupBy(*keys, "_band", "_tile").applyInArrow(found, schema).groupBy(*keys).applyInArrow(merged, schema)


def stitch_nodes(
    nodes: DataFrame, reach: float = 8.0, gap: int = 3, min_points: int = 10, min_wind: float = 10.0, max_lat: float = 50.0, min_strong: int = 10,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """track, pt and the node's columns.  nodes: node (unique), keys (only nodes of
    equal ones are linked), step, lat, lon, wind.

    A node is linked to the nearest one in reach at the next step that has one (up to
    ``gap`` steps on); where several choose the same node, the nearest keeps it.
    Chains are named by their first node by doubling jumps, a written join a round, of
    which there are as many as the longest chain has binary digits.  Nodes are written
    first: they are read several times, and what finds them is to run once.
    """
    nodes = checkpointed(nodes)
    a = nodes.select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(gap))).alias("d"), "step", *keys, F.col("lat").alias("la"), F.col("lon").alias("lo"))
    b = nodes.select(F.col("node").alias("b"), F.col("step").alias("to"), *keys, F.col("lat").alias("lb"), F.col("lon").alias("lo2"))
    dist = F.degrees(great_circle(F.col("la"), F.col("lo"), F.col("lb"), F.col("lo2"), 1.0))
    pairs = a.withColumn("to", F.col("step") + F.col("d")).join(b, ["to", *keys]).withColumn("dist", dist).where(F.col("dist") <= reach)
    chosen = pairs.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "dist", "b"))).where("r = 1")
    kept = chosen.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("d", "dist", "a"))).where("r = 1")
    jump = nodes.select(F.col("node").alias("b")).join(kept.select("b", "a"), "b", "left").select(F.col("b").alias("node"), F.coalesce("a", "b").alias("head"))
    moved = True
    while moved:  # twice as far a round, until all chains are at their heads
        further = jump.join(jump.select(F.col("node").alias("head"), F.col("head").alias("far")), "head")
        further = checkpointed(further.select("node", F.col("far").alias("head"), (F.col("far") != F.col("head")).alias("moved")))
        moved = bool(further.where("moved").limit(1).collect())
        jump = further.drop("moved")
    w = Window.partitionBy("head")
    strong = F.count_if((F.col("wind") >= min_wind) & (F.abs("lat") <= max_lat)).over(w)
    named = nodes.join(jump, "node").withColumns({"n": F.count(F.lit(1)).over(w), "strong": strong})
    kept = named.where((F.col("n") >= min_points) & (F.col("strong") >= min_strong))
    pt = F.row_number().over(w.orderBy("step")) - 1
    return kept.withColumn("pt", pt).withColumnRenamed("head", "track").drop("n", "strong")


#: The variables that tracking asks for, under the names they get.
TRACKED = {"psl": "psl", "uas": "ubot", "vas": "vbot", "zg300": "z300", "zg500": "z500"}


def _tracked(read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What detection reads, of a reading of the variables that tracking asks for."""

    def tracked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read(batches):
            missing = [v for v in TRACKED if v not in batch.schema.names]
            if missing:
                raise InvalidData(f"no variable {', '.join(missing)}")
            whole = np.logical_and.reduce([batch[v].is_valid().to_numpy(zero_copy_only=False) for v in TRACKED])
            batch = batch if whole.all() else batch.filter(pa.array(whole))
            for name, a, b, of in (("thickness", "zg300", "zg500", np.subtract), ("wind", "uas", "vas", np.hypot)):
                length = batch[a].value_lengths()
                if not length.equals(batch[b].value_lengths()):
                    raise ValueError(f"{a} and {b} have not the same places")
                ends = np.concatenate([[0], np.cumsum(length.to_numpy())])
                values = of(*[batch[v].flatten().to_numpy(zero_copy_only=False) for v in (a, b)])
                batch = batch.append_column(name, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
            yield batch

    return tracked


def _tracker_grids(grids: DataFrame, keys: list[str], topography: DataFrame | None) -> DataFrame:
    """tracker_input() of grids; times without all five variables are left out."""
    missing = [v for v in TRACKED if v not in grids.columns]
    if missing:
        raise InvalidData(f"no variable {', '.join(missing)}")
    axes = ["lat", "lon"]
    own = grids.where(" AND ".join(f"{v} IS NOT NULL" for v in TRACKED))
    if "phis" not in grids.columns and topography is not None:
        shapes = own.select(*axes).distinct().withColumn("_n", F.array_repeat(F.lit(0.0), F.size("lat") * F.size("lon")))
        cells = places(shapes.select(F.struct(*axes).alias("_of"), *axes, "_n"), ["_of"], ["_n"]).drop("_n")
        ground = regrid.bilinear(topography.select("lat", "lon", "value"), cells.select(*axes).distinct(), []).select(*axes, (F.col("value") * 9.80665).alias("phis"))
        at = [F.array_position(F.col(f"_of.{c}"), F.col(c)) for c in axes]
        ordered = F.array_sort(F.collect_list(F.struct(*[p.alias(f"p{k}") for k, p in enumerate(at)], "phis")))
        known = cells.join(ground, axes, "left").groupBy("_of").agg(F.transform(ordered, lambda x: x["phis"]).alias("phis"))
        own = own.join(known.select("_of.*", "phis"), axes)
    elif "phis" not in grids.columns:
        own = own.withColumn("phis", F.lit(None).cast("array<double>"))
    own = own.select(*keys, *axes, *[F.col(v).alias(n) for v, n in TRACKED.items()], "phis")
    return own.withColumns({"thickness": F.zip_with("z300", "z500", lambda a, b: a - b), "wind": F.zip_with("ubot", "vbot", F.hypot)})


def tracker_input(cube: DataFrame | Reading, keys: list[str], topography: DataFrame | None = None) -> DataFrame | Reading:
    """keys, lat, lon, psl, ubot, vbot, z300, z500, phis, and what detection reads: thickness
    (z300 - z500) and wind.  cube: variable, keys, lat, lon, value; or a row a grid: keys,
    lat, lon and the variables as arrays (see places()), which are arrays again; or a
    Reading of these, whose reading has then what detection reads (which the ground isn't).

    A variable that isn't there is an error.  Places and times are those that all five
    variables have rows for; a null value stays null.  The surface geopotential is the
    cube's own phis, or the topography (lat, lon, value in metres; brought onto the grid)
    times gravity, or null where neither is given."""
    if isinstance(cube, Reading):
        return replace(cube, read=_tracked(cube.read))
    if "variable" not in cube.columns:
        return _tracker_grids(cube, keys, topography)
    wanted = [*TRACKED, "phis"]
    own = cube.where(F.col("variable").isin(wanted))
    there = {r["variable"] for r in own.select("variable").distinct().collect()}  # six names at most
    missing = [v for v in TRACKED if v not in there]
    if missing:
        raise InvalidData(f"no variable {', '.join(missing)}")
    is_ = lambda v: F.col("variable") == v
    place = [*keys, "lat", "lon"]
    wide = own.groupBy(*place).agg(
        *[F.max(F.when(is_(v), F.col("value"))).alias(n) for v, n in TRACKED.items()], F.max(F.when(is_("phis"), F.col("value"))).alias("phis"),
        *[F.bool_or(is_(v)).alias(f"_{v}") for v in TRACKED],
    )
    wide = wide.where(" AND ".join(f"_{v}" for v in TRACKED)).drop(*[f"_{v}" for v in TRACKED])
    if "phis" not in there and topography is not None:
        grid = own.where(is_("psl")).select("lat", "lon").distinct()
        ground = regrid.bilinear(topography.select("lat", "lon", "value"), grid, []).select("lat", "lon", (F.col("value") * 9.80665).alias("phis"))
        wide = wide.drop("phis").join(ground, ["lat", "lon"])
    return wide.select(*place, *TRACKED.values(), "phis", (F.col("z300") - F.col("z500")).alias("thickness"), F.hypot("ubot", "vbot").alias("wind"))


def nearest_index(points: DataFrame, axis: DataFrame, name: str) -> DataFrame:
    """Points with the index and value of the nearest coordinate of a regular axis
    (i, value); ties go to the lower index.  The axis is a few thousand rows."""
    ends = axis.agg(F.min_by("value", "i").alias("v0"), F.max_by("value", "i").alias("v1"), F.max("i").alias("n"), F.min("i").alias("i0")).first()
    step = (ends["v1"] - ends["v0"]) / max(ends["n"] - ends["i0"], 1) or 1.0
    exact = (F.col(name) - ends["v0"]) / step
    index = F.greatest(F.lit(ends["i0"]), F.least(F.ceil(exact - 0.5) + ends["i0"], F.lit(ends["n"]))).cast("int")
    return points.withColumn(f"{name}_index", index)


#: Levels that a step of the search goes down, cells of a leaf at most where places
#: differ, and the deepest level (a cube's number has 21 bits an axis).
DOWN, LEAF, DEEPEST = 2, 32, 20


def _on_sphere(lat: str, lon: str) -> list[Column]:
    """x, y, z on the unit sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    return [(F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z")]


def _cube(level: int) -> Column:
    """Number of the cube that holds x, y, z, of 2^level an axis."""
    n = 1 << level
    axis = lambda c: F.greatest(F.lit(0), F.least(F.floor((F.col(c) + 1) / 2 * n), F.lit(n - 1))).cast("long")
    return F.shiftleft(axis("x"), 42).bitwiseOR(F.shiftleft(axis("y"), 21)).bitwiseOR(axis("z"))


def _parent(cube: Column) -> Column:
    """The cube DOWN levels up that holds this one."""
    part = lambda by: F.shiftright(F.shiftright(cube, by).bitwiseAND((1 << 21) - 1), DOWN)
    return F.shiftleft(part(42), 42).bitwiseOR(F.shiftleft(part(21), 21)).bitwiseOR(part(0))


def _nearer(level: int) -> Column:
    """Squared distance of a point (px, py, pz) from a cube's nearest place."""
    side = 2.0 / (1 << level)
    out = F.lit(0.0)
    for c, by in (("px", 42), ("py", 21), ("pz", 0)):
        middle = (F.shiftright("cube", by).bitwiseAND((1 << 21) - 1) + 0.5) * side - 1
        off = F.greatest(F.abs(F.col(c) - middle) - side / 2, F.lit(0.0))
        out = out + off * off
    return out


def nearest_cell(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Points (id, lat, lon) with the cell (cell, distance in degrees of arc) of a grid of
    any shape (cell, lat, lon) that is nearest on the sphere; ties go to the smaller cell.
    Points or cells without a place are left out.

    Cells are placed in cubes around the unit sphere, halved level by level until a
    cube has few of them, so that poles and the date line are places like others.  A
    point goes down by equi-joins from cubes to the cubes in them; it keeps those that
    may be nearer than the nearest cell known, a few at every level, whatever the size
    of the grid."""
    cells = checkpointed(grid.where("lat IS NOT NULL AND lon IS NOT NULL").select("cell", F.col("lat").alias("lat"), F.col("lon").alias("lon"), *_on_sphere("lat", "lon")))
    depth = DOWN
    while depth < DEEPEST:
        most = cells.groupBy(_cube(depth).alias("cube")).agg(F.count_distinct("lat", "lon").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= LEAF:
            break
        depth += DOWN
    leaves = cells.withColumn("cube", _cube(depth))
    tiles = {depth: leaves.groupBy("cube").agg(F.min_by(F.struct("x", "y", "z"), "cell").alias("rep"))}
    for level in range(depth - DOWN, 0, -DOWN):
        tiles[level + DOWN] = checkpointed(tiles[level + DOWN])
        tiles[level] = tiles[level + DOWN].groupBy(_parent(F.col("cube")).alias("cube")).agg(F.first("rep").alias("rep"))

    known = [F.col(c) for c in ("id", "la", "lo", "px", "py", "pz")]
    x, y, z = _on_sphere("la", "lo")
    open_ = points.where("lat IS NOT NULL AND lon IS NOT NULL").select("id", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    open_ = open_.select("id", "la", "lo", x.alias("px"), y.alias("py"), z.alias("pz"))
    top = [(r["cube"], *r["rep"]) for r in tiles[DOWN].collect()]  # 64 cubes at most
    schema = "array<struct<cube: long, rep: struct<x: double, y: double, z: double>>>"
    first = F.from_json(F.lit(json.dumps([{"cube": c, "rep": {"x": a, "y": b, "z": d}} for c, a, b, d in top])), schema)
    met = open_.select(*known, F.inline(first))
    squared = sum(((F.col(f"p{c}") - F.col(f"rep.{c}")) * (F.col(f"p{c}") - F.col(f"rep.{c}")) for c in "xyz"), F.lit(0.0))
    for level in range(DOWN, depth + 1, DOWN):
        if level > DOWN:
            below = tiles[level].withColumn("parent", _parent(F.col("cube")))
            met = kept.withColumnRenamed("cube", "parent").join(below, "parent").select(*known, "cube", "rep")  # noqa: F821
        nearest = F.min(squared).over(Window.partitionBy("id", "la", "lo"))
        met = met.withColumns({"_at_most": nearest * (1 + 1e-9) + 1e-15, "_at_least": _nearer(level)})
        kept = checkpointed(met.where("_at_least <= _at_most").select(*known, "cube"))
    distance = F.degrees(great_circle(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"), 1.0))
    found = kept.join(leaves.select("cube", "cell", "lat", "lon"), "cube").groupBy("id", "la", "lo").agg(F.min(F.struct(distance.alias("distance"), "cell")).alias("b"))
    return found.select("id", "b.cell", "b.distance")
