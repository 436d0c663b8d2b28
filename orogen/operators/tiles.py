"""Tiles with halos: array kernels over square pieces of a grid.

A cell is dealt to its own tile and to each tile whose halo reaches it: one
exchange by tile, and an array of bounded size in each task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(grid: DataFrame, tile: int, halo: int) -> DataFrame:
    """Adds tile_z and tile_x; cells in halos appear once for each tile they serve."""

    def reach(axis: str) -> Column:
        low = F.floor((F.col(axis) - halo) / tile).cast("int")
        high = F.floor((F.col(axis) + halo) / tile).cast("int")
        return F.explode(F.sequence(low, high))

    if not halo:
        return grid.withColumns({"tile_z": F.floor(F.col("z") / tile).cast("int"), "tile_x": F.floor(F.col("x") / tile).cast("int")})
    return grid.withColumn("tile_z", reach("z")).withColumn("tile_x", reach("x"))


def tiled(grid: DataFrame, kernel: Callable[..., dict[str, np.ndarray]], columns: list[str], schema: str, tile: int = 256, halo: int = 1, outside: float = np.nan) -> DataFrame:
    """Runs ``kernel`` on every tile with its halo and returns its own cells.

    The kernel gets one array a column (``outside`` where the world has no cell), which
    cells are the tile's own, and the world's row and column of its first cell. It
    returns arrays of the same shape by name. Arrays end where the world ends.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tz, tx = key[0].as_py(), key[1].as_py()
        z0, x0, side = tz * tile - halo, tx * tile - halo, tile + 2 * halo
        z, x = table.column("z").to_numpy() - z0, table.column("x").to_numpy() - x0
        arrays = []
        for c in columns:
            a = np.full((side, side), outside)
            a[z, x] = table.column(c).to_numpy()
            arrays.append(a)
        there, ours = np.zeros((side, side), bool), np.zeros((side, side), bool)
        there[z, x] = True
        ours[halo : halo + tile, halo : halo + tile] = True
        zs, xs = np.flatnonzero(there.any(1)), np.flatnonzero(there.any(0))
        box = np.s_[zs[0] : zs[-1] + 1, xs[0] : xs[-1] + 1]  # the world ends here, if within the halo
        out = kernel(*(a[box] for a in arrays), ours[box], z0 + int(zs[0]), x0 + int(xs[0]))
        own = (z >= halo) & (z < halo + tile) & (x >= halo) & (x < halo + tile)
        z, x = z[own], x[own]
        values = {"z": z + z0, "x": x + x0} | {k: v[z - zs[0], x - xs[0]] for k, v in out.items()}
        types = {"int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}
        return pa.table({n: pa.array(values[n], types[f.split()[1]]) for n, f in zip(names, schema.split(", "), strict=True)})

    return dealt(grid, tile, halo).groupBy("tile_z", "tile_x").applyInArrow(run, schema)
