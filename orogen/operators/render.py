"""Primitives rasterised on a grid and composited by an ordered smooth maximum.

A primitive meets a grid by tile keys: boxes are dealt to the tiles they touch. The composite is not associative and
has no neutral element, so order counts and heights of zero inside a box stay. Cells and primitives of a
tile are therefore sorted into one stream, cells first, then primitives by inst_id; a task holds one tile's array and
folds the primitives into it as they come, however many they are. There is no list and no row of a cell and a primitive.

``covered`` gives such rows where they are the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import clamp, lattice_noise, lattice_noise_array
from . import curves

TILE = 64


def boxes(instances: DataFrame, width: int, height: int) -> DataFrame:
    """Adds x_min, x_max, z_min, z_max: low ends inside, high ends outside, cut to the grid.

    A box that lies wholly off the grid is empty.
    """
    radius = F.greatest(F.col("length"), 4.0 * F.col("sigma")).cast("int")
    low = lambda c: F.greatest(F.lit(0), (F.col(c) - radius).cast("int"))
    high = lambda c, most: F.least(F.lit(most), (F.col(c) + radius).cast("int"))
    return instances.withColumns({"x_min": low("cx"), "x_max": high("cx", width), "z_min": low("cz"), "z_max": high("cz", height)})


def covered(grid: DataFrame, boxed: DataFrame, tile: int = TILE) -> DataFrame:
    """Each cell with each instance whose box holds it, by equality of tiles."""
    boxed = boxed.filter("x_min < x_max and z_min < z_max")
    span = lambda a: F.sequence(F.floor(F.col(f"{a}_min") / tile), F.floor((F.col(f"{a}_max") - 1) / tile))
    boxed = boxed.withColumn("tile_x", F.explode(span("x"))).withColumn("tile_z", F.explode(span("z")))
    cells = grid.withColumns({"tile_x": F.floor(F.col("x") / tile), "tile_z": F.floor(F.col("z") / tile)})
    return cells.join(boxed, ["tile_z", "tile_x"]).filter("x >= x_min and x < x_max and z >= z_min and z < z_max").drop("tile_z", "tile_x")


def ridge_height(noise: float = 0.0, seed: int = 42, scale: float = 16.0) -> Column:
    """A ridge's height at (x, z): quadratic along its length, exponential across it.

    ``noise`` is the amplitude of lattice noise in the ridge's own frame.
    """
    u, v = curves.tangent_frame(F.col("angle"), F.col("x") - F.col("cx"), F.col("z") - F.col("cz"))
    half = F.col("length") / 2.0
    out = F.col("height") * clamp(1.0 - (u / half) * (u / half), 0.0, 1.0) * F.exp(-F.abs(v) / F.col("sigma"))
    return out * (1.0 + noise * lattice_noise(seed, u, v, scale)) if noise else out


def peak_height() -> Column:
    """A pyramidal peak at (x, z): h_peak (1 - r/R)^gamma (1 + alpha cos(k theta)), 0 beyond R."""
    dx, dz = F.col("x") - F.col("cx"), F.col("z") - F.col("cz")
    fall = F.pow(F.greatest(F.lit(0.0), 1.0 - F.hypot(dx, dz) / F.col("radius")), F.col("gamma"))
    return F.col("h_peak") * fall * (1.0 + F.col("alpha") * F.cos(F.col("k") * F.atan2(dz, dx)))


def caldera_depth() -> Column:
    """A caldera's subsidence at (x, z): a bowl of ``depth`` that ends at ``radius``. Our own form."""
    r = F.hypot(F.col("x") - F.col("cx"), F.col("z") - F.col("cz")) / F.col("radius")
    return F.col("depth") * F.pow(F.greatest(F.lit(0.0), 1.0 - r * r), F.lit(2.0))


Layer = Callable[[dict[str, float], np.ndarray, np.ndarray], np.ndarray]


def ridge_layer(noise: float = 0.0, seed: int = 42, scale: float = 16.0) -> Layer:
    """``ridge_height`` over arrays of x and z."""

    def layer(p: dict[str, float], x: np.ndarray, z: np.ndarray) -> np.ndarray:
        dx, dz, c, s = x - p["cx"], z - p["cz"], math.cos(p["angle"]), math.sin(p["angle"])
        u, v = dx * c + dz * s, dz * c - dx * s
        half = p["length"] / 2.0
        out = p["height"] * np.clip(1.0 - (u / half) * (u / half), 0.0, 1.0) * np.exp(-np.abs(v) / p["sigma"])
        return out * (1.0 + noise * lattice_noise_array(seed, u, v, scale)) if noise else out

    return layer


def peak_layer(p: dict[str, float], x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``peak_height`` over arrays of x and z."""
    dx, dz = x - p["cx"], z - p["cz"]
    fall = np.maximum(0.0, 1.0 - np.hypot(dx, dz) / p["radius"]) ** p["gamma"]
    return p["h_peak"] * fall * (1.0 + p["alpha"] * np.cos(p["k"] * np.arctan2(dz, dx)))


_BOX = ["x_min", "x_max", "z_min", "z_max"]


class _Tile:
    """One tile's heights while primitives are folded in."""

    def __init__(self, tz: int, tx: int, tile: int):
        self.z0, self.x0, self.tile = tz * tile, tx * tile, tile
        self.h, self.there = np.zeros((tile, tile), np.float32), np.zeros((tile, tile), bool)
        self.known = np.zeros((tile, tile), bool)

    def cells(self, z: np.ndarray, x: np.ndarray, h: pa.Array) -> None:
        at = z - self.z0, x - self.x0
        self.there[at], self.known[at] = True, h.is_valid().to_numpy(zero_copy_only=False)
        self.h[at] = h.fill_null(0.0).to_numpy(zero_copy_only=False)

    def fold(self, p: dict[str, float], layer: Layer, k: float) -> None:
        z, x = (np.arange(max(lo, p[f"{a}_min"]), min(lo + self.tile, p[f"{a}_max"])) for a, lo in (("z", self.z0), ("x", self.x0)))
        if len(z) and len(x):
            part = self.h[z[0] - self.z0 : z[-1] + 1 - self.z0, x[0] - self.x0 : x[-1] + 1 - self.x0]
            below, over = part.astype(float), layer(p, x[None].astype(float), z[:, None].astype(float))
            part[:] = 0.5 * (below + over + np.sqrt((below - over) * (below - over) + k))

    def rows(self) -> pa.RecordBatch:
        z, x = np.nonzero(self.there)
        columns = [pa.array(z + self.z0, pa.int32()), pa.array(x + self.x0, pa.int32()), pa.array(self.h[z, x], mask=~self.known[z, x])]
        return pa.RecordBatch.from_arrays(columns, names=["z", "x", "h"])


def cell_layer(p: dict[str, float], x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A layer's own height in the one cell of its box."""
    return np.full((len(z), x.shape[1]), p["layer"])


def composite(grid: DataFrame, boxed: DataFrame, layer: Layer = cell_layer, params: Sequence[str] = ("layer",), k: float = 12.0, tile: int = TILE) -> DataFrame:
    """(z, x, h): folds boxed primitives (inst_id, the box, params) into the grid in order, rounding to float at each.

    Without boxes, ``boxed`` holds heights of single cells: (z, x, inst_id, layer).
    Cells that no box holds keep their height, null heights stay null. Primitives of one inst_id follow each other by
    their parameters. A cell must occur once.
    """
    if "x_min" not in boxed.columns:
        boxed = boxed.withColumns({f"{a}_{end}": F.col(a) + (end == "max") * 1 for a in "xz" for end in ("min", "max")})
    keys, numbers = ["tile_z", "tile_x"], [*_BOX, *params]
    at = {"tile_z": F.floor(F.col("z") / tile).cast("int"), "tile_x": F.floor(F.col("x") / tile).cast("int")}
    cells = grid.select("z", "x", F.col("h").cast("float").alias("h")).withColumns(at)
    cells = cells.select(*keys, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("inst_id"), "z", "x", "h", *(F.lit(None).cast("double").alias(c) for c in numbers))
    span = lambda a: F.explode(F.sequence(*(F.floor(v / tile).cast("int") for v in (F.col(f"{a}_min"), F.col(f"{a}_max") - 1))))
    held = boxed.filter("x_min < x_max and z_min < z_max").withColumn("tile_x", span("x")).withColumn("tile_z", span("z"))
    none = [F.lit(None).cast("int").alias("z"), F.lit(None).cast("int").alias("x"), F.lit(None).cast("float").alias("h")]
    held = held.select(*keys, F.lit(1).alias("kind"), F.col("inst_id").cast("long").alias("inst_id"), *none, *(F.col(c).cast("double").alias(c) for c in numbers))
    stream = cells.unionByName(held).repartition(*keys).sortWithinPartitions(*keys, "kind", "inst_id", *params, "z", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile_now, key_now = None, None
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            tz, tx, kind = (column[c].to_numpy() for c in (*keys, "kind"))
            cut = np.flatnonzero((np.diff(tz) != 0) | (np.diff(tx) != 0) | (np.diff(kind) != 0)) + 1
            edges = [0, *cut.tolist(), len(kind)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if (tz[lo], tx[lo]) != key_now:
                    if tile_now is not None:
                        yield tile_now.rows()
                    key_now = (tz[lo], tx[lo])
                    tile_now = _Tile(int(tz[lo]), int(tx[lo]), tile)
                if kind[lo] == 0:
                    z, x = (column[c].slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(int) for c in ("z", "x"))
                    tile_now.cells(z, x, column["h"].slice(lo, hi - lo))
                else:
                    values = {c: column[c].slice(lo, hi - lo).to_pylist() for c in numbers}
                    for i in range(hi - lo):
                        tile_now.fold({c: v[i] if c not in _BOX else int(v[i]) for c, v in values.items()}, layer, k)
        if tile_now is not None:
            yield tile_now.rows()

    return stream.mapInArrow(run, "z int, x int, h float")


def subside(grid: DataFrame, calderas: DataFrame, width: int, height: int) -> DataFrame:
    """Lowers the grid by the sum of calderas (inst_id, cx, cz, radius, depth)."""
    boxed = boxes(calderas.withColumns({"length": F.col("radius"), "sigma": F.lit(0.0)}), width, height)
    fall = covered(grid.select("z", "x"), boxed).withColumn("fall", caldera_depth()).groupBy("z", "x").agg(F.sum("fall").alias("fall"))
    return grid.join(fall, ["z", "x"], "left").withColumn("h", F.col("h") - F.coalesce("fall", F.lit(0.0))).drop("fall")


RIDGE = ["cx", "cz", "angle", "height", "length", "sigma"]
PEAK = ["cx", "cz", "h_peak", "radius", "gamma", "alpha", "k"]


def render_ridges(grid: DataFrame, instances: DataFrame, width: int, height: int, k: float = 12.0, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """Composites ridges (inst_id, cx, cz, angle, height, length, sigma) into a grid."""
    return composite(grid, boxes(instances, width, height), ridge_layer(noise, seed), RIDGE, k)


def render_peaks(grid: DataFrame, peaks: DataFrame, width: int, height: int, k: float = 12.0) -> DataFrame:
    """Composites pyramidal peaks (inst_id, cx, cz, h_peak, radius, gamma, alpha, k)."""
    boxed = boxes(peaks.withColumns({"length": F.col("radius"), "sigma": F.lit(0.0)}), width, height)
    return composite(grid, boxed, peak_layer, PEAK, k)


def scatter_along_spline(
    grid: DataFrame,
    waypoints: DataFrame,
    width: int,
    height: int,
    peak_count: int = 40,
    base_altitude: float = 240.0,
    ridge_sigma: float = 18.0,
    seed: int = 42,
    shape: str = "ridge",
    spacing: float | None = None,
    **jitter: object,
) -> DataFrame:
    """Primitives at stations along the splines through tables of way points (spline_id, seq, x, z), composited into the grid.

    Stations are ``peak_count`` even ones a spline or, with ``spacing``, at least that far apart along it. ``shape`` is
    ``ridge`` or ``peak`` (a peak's radius is half its length); ``jitter`` goes to ``curves.jittered`` (mode, sd, turn, sigma_spread).
    Splines follow each other by spline_id, a spline's stations by their number.
    """
    table = curves.fit(waypoints)
    at = curves.parameters(table, peak_count) if spacing is None else curves.spaced_stations(table, spacing, seed=seed)
    made = curves.jittered(curves.evaluate(at, table), seed, base_altitude, ridge_sigma, **jitter)
    made = made.withColumn("inst_id", F.col("spline_id").cast("long") * (1 << 32) + F.col("inst_id"))
    if shape == "peak":
        made = made.select("inst_id", "cx", "cz", F.col("height").alias("h_peak"), (F.col("length") / 2).alias("radius"), F.lit(1.8).alias("gamma"), F.lit(0.2).alias("alpha"), F.lit(4.0).alias("k"))
        return render_peaks(grid, made, width, height)
    return render_ridges(grid, made, width, height)
