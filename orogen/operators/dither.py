"""Continuous to discrete: threshold matrices, periodic tiling, masks.

A matrix is a dimension table of side x side rows, bounded by its parameter, and meets the
grid by equality of coordinates modulo its sides: nothing is tiled out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rounds import Rounds
from .tiles import tiled


def gaussian_blur(a: np.ndarray, sigma: float = 1.5, truncate: float = 4.0, wrap: bool = False) -> np.ndarray:
    """Separable Gaussian with mirrored (or periodic) edges."""
    radius = int(truncate * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()
    for axis in (0, 1):
        wide = np.pad(a, [(radius, radius) if k == axis else (0, 0) for k in (0, 1)], mode="wrap" if wrap else "symmetric")
        n = a.shape[axis]
        a = sum(w * np.take(wide, range(i, i + n), axis=axis) for i, w in enumerate(taps))
    return a


def blurred(grid: DataFrame, value: str = "h", sigma: float = 1.5, truncate: float = 4.0, tile: int = 256) -> DataFrame:
    """(z, x, value, blur): a separable Gaussian of a dense grid's column, mirrored at the world's border.

    Tiles overlap by the kernel's radius, so one exchange serves both passes. A null or NaN value makes the cells in reach NaN.
    """
    radius = int(truncate * sigma + 0.5)

    def kernel(a: np.ndarray, own: np.ndarray, z0: int, x0: int) -> dict[str, np.ndarray]:
        return {value: a, "blur": gaussian_blur(a, sigma, truncate)}

    cells = grid.select("z", "x", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias(value))
    return tiled(cells, kernel, [value], f"z int, x int, {value} double, blur double", tile, radius)


def highpass(grid: DataFrame, value: str = "h", sigma: float = 1.5, tile: int = 256) -> DataFrame:
    """(z, x, thr): a grid's column less its blur, scaled to [0, 1] by the least and greatest of all; 0 where all are equal."""
    keep = Rounds(grid, "highpass")
    rough = keep.save(blurred(grid, value, sigma, tile=tile).select("z", "x", (F.col(value) - F.col("blur")).alias("rough")), "rough")
    ends = rough.agg(F.min("rough").alias("low"), F.max("rough").alias("high"))  # one row
    scaled = F.when(F.col("high") > F.col("low"), (F.col("rough") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return rough.crossJoin(F.broadcast(ends)).select("z", "x", scaled.alias("thr"))


def highpass_matrix(size: int = 64, seed: int = 42, sigma: float = 1.5, wrap: bool = False) -> np.ndarray:
    """Seeded uniform noise less its blur, scaled to [0, 1]. The generator is private."""
    noise = np.random.RandomState(seed).uniform(0.0, 1.0, (size, size))
    rough = noise - gaussian_blur(noise, sigma, wrap=wrap)
    low, high = rough.min(), rough.max()
    return (rough - low) / (high - low) if high > low else np.zeros_like(rough)


def void_and_cluster_matrix(size: int = 32, seed: int = 42, sigma: float = 1.5, share: float = 0.1) -> np.ndarray:
    """Ulichney's void-and-cluster ranks over a torus, scaled to [0, 1)."""
    n = size * size
    at = np.minimum(np.arange(size), size - np.arange(size))
    pull = np.exp(-(at[:, None] ** 2 + at[None, :] ** 2) / (2 * sigma * sigma))

    def field(pattern: np.ndarray) -> np.ndarray:
        return np.real(np.fft.ifft2(np.fft.fft2(pattern) * np.fft.fft2(pull)))

    pick = lambda f, among, best: np.unravel_index(best(np.where(among, f, -np.inf if best is np.argmax else np.inf)), f.shape)
    start = np.zeros(n, bool)
    start[np.random.RandomState(seed).permutation(n)[: max(1, int(n * share))]] = True
    start = start.reshape(size, size)
    while True:  # move the tightest cluster to the largest void until that is the same place
        tight = pick(field(start), start, np.argmax)
        start[tight] = False
        void = pick(field(start), ~start, np.argmin)
        start[void] = True
        if void == tight:
            break
    rank = np.zeros((size, size))
    ones = int(start.sum())
    pattern = start.copy()
    for r in range(ones - 1, -1, -1):
        where = pick(field(pattern), pattern, np.argmax)
        pattern[where] = False
        rank[where] = r
    pattern = start.copy()
    for r in range(ones, n):
        where = pick(field(pattern), ~pattern, np.argmin)
        pattern[where] = True
        rank[where] = r
    return rank / n


def as_table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """(tz, tx, thr) of a matrix."""
    rows = [(int(z), int(x), float(matrix[z, x])) for z in range(matrix.shape[0]) for x in range(matrix.shape[1])]
    return spark.createDataFrame(rows, "tz int, tx int, thr double")


def mask(field: DataFrame, thresholds: DataFrame, side_z: int = 64, side_x: int = 64, p: str = "p", strict_zero: bool = False) -> DataFrame:
    """Adds v: 255 where p >= the threshold at (z mod side, x mod side), else 0.

    A missing or undefined p gives 0. ``strict_zero`` also gives 0 where p = 0. The threshold table has
    side_z * side_x rows and is broadcast.
    """
    keyed = field.withColumns({"tz": F.pmod("z", F.lit(side_z)), "tx": F.pmod("x", F.lit(side_x))})
    met = keyed.join(F.broadcast(thresholds), ["tz", "tx"], "left")
    fires = F.col(p).isNotNull() & ~F.isnan(p) & (F.col(p) >= F.col("thr"))
    if strict_zero:
        fires = fires & (F.col(p) > 0)
    return met.withColumn("v", F.when(fires, 255).otherwise(0).cast("smallint")).drop("tz", "tx", "thr")
