"""What jobs in several steps share: written tables of a loop, and directions on the grid."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import dealt

DIRECTIONS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))  # (dz, dx), by eighths of a turn
SMALL = 200_000  # rows of a graph between tiles that one task solves at once; larger ones are solved in rounds


class Rounds:
    """Written tables of a loop, under the session's checkpoint folder."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        top = self.spark.conf.get("spark.checkpoint.dir", None)
        if not top and not self.spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = top or f"file://{tempfile.gettempdir()}/checkpoints"
        self.root = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, turn: int | str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{turn}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{turn}")


def directions(eight: bool) -> tuple[tuple[int, int], ...]:
    return DIRECTIONS if eight else DIRECTIONS[::2]


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def rows_by_tile(grid: DataFrame, kernel: Callable[..., list[dict[str, np.ndarray]]], columns: list[str], schema: str, tile: int, halo: int = 0) -> DataFrame:
    """Rows of any number from each tile and its halo.

    The kernel gets one array a column (NaN where there is no cell), which cells are the tile's own, and the
    world's row and column of the first; it returns runs of rows, as columns by name of which missing ones are null.
    """
    fields = [f.split() for f in schema.split(", ")]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        z0, x0 = (k.as_py() * tile - halo for k in key)
        z, x = table.column("z").to_numpy() - z0, table.column("x").to_numpy() - x0
        low_z, low_x = int(z.min()), int(x.min())
        shape = int(z.max()) - low_z + 1, int(x.max()) - low_x + 1
        arrays = []
        for c in columns:
            a = np.full(shape, np.nan)
            a[z - low_z, x - low_x] = table.column(c).to_numpy()
            arrays.append(a)
        at_z, at_x = np.arange(low_z, low_z + shape[0])[:, None], np.arange(low_x, low_x + shape[1])[None]
        own = (at_z >= halo) & (at_z < halo + tile) & (at_x >= halo) & (at_x < halo + tile)
        parts = []
        for got in kernel(*arrays, own, z0 + low_z, x0 + low_x):
            n = len(next(iter(got.values())))
            parts.append(pa.table({name: pa.array(got[name], _TYPES[kind]) if name in got else pa.nulls(n, _TYPES[kind]) for name, kind in fields}))
        return pa.concat_tables(parts)

    return dealt(grid, tile, halo).groupBy("tile_z", "tile_x").applyInArrow(run, schema)


def cell_id(z, x):  # noqa: ANN001, ANN201
    """One number for a cell; rows and columns have 31 bits. Takes numbers, arrays and columns."""
    return z * (1 << 32) + x


def extent(grid: DataFrame) -> tuple[int, int, int, int] | None:
    """First and last row, first and last column."""
    ends = grid.agg(F.min("z"), F.max("z"), F.min("x"), F.max("x")).first()
    return None if ends[0] is None else tuple(map(int, ends))
