"""A data source of PNG tiles: ``spark.read.format("png_tiles")`` and ``df.write.format("png_tiles")``.

A folder holds one file a tile, ``tile_<tile_z>_<tile_x>.png``. Options: ``path``; ``tile``, the side of a tile in cells;
``bands``, the names of the values (``v`` for height maps and masks, ``r,g,b`` for colours); ``bits``, 16 or 8.

Reading gives (tile_z, tile_x, z, x, bands) with a partition a file. The options ``tile_z`` and ``tile_x`` (``low:high``, both
ends included, either may be left out) decide which files are opened at all. They are options, not pushed filters: Spark
4.1 keeps the filters pushed into a Python source with the table, so that a second query on the same DataFrame would lack rows.

Writing takes the same columns but the tile keys, dealt so that no tile is in two tasks and sorted by tile (``write``
does both). Files go to a folder of the job's own beside the others and are moved on commit, after a check that every tile was
written once; a job that fails leaves nothing that readers see. Missing cells are 0; values beyond the bits are an
error. The folder must be one that all executors share.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .png import decode, encode

NAME = re.compile(r"tile_(-?\d+)_(-?\d+)\.png$")
ROWS = 64  # of a tile, handed on at a time


def _system(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class _File(InputPartition):
    path: str
    tile_z: int
    tile_x: int


@dataclass
class _Moved(WriterCommitMessage):
    tiles: list[tuple[int, int]]


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "png_tiles"

    @property
    def bands(self) -> list[str]:
        return [b.strip() for b in self.options.get("bands", "v").split(",")]

    def schema(self) -> str:
        return ", ".join(["tile_z int", "tile_x int", "z int", "x int", *(f"{b} int" for b in self.bands)])

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], int(self.options["tile"]), self.bands, [self.options.get(k, ":") for k in ("tile_z", "tile_x")])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return _Writer(self.options["path"], int(self.options["tile"]), self.bands, int(self.options.get("bits", "16")), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, tile: int, bands: list[str], ranges: list[str]):
        self.path, self.tile, self.bands, self.ranges = path, tile, bands, [r.partition(":") for r in ranges]

    def _wanted(self, key: tuple[int, int]) -> bool:
        return all((not lo or int(lo) <= k) and (not hi or k <= int(hi)) for k, (lo, _, hi) in zip(key, self.ranges, strict=True))

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        system, root = _system(self.path)
        names = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file]
        found = [(p, tuple(map(int, m.groups()))) for p in names if (m := NAME.search(p))]
        return [_File(p, *key) for p, key in sorted(found, key=lambda f: f[1]) if self._wanted(key)]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without tiles
            return
        system, _ = _system(self.path)
        with system.open_input_stream(partition.path) as file:
            a = decode(file.read())
        if a.shape[2] != len(self.bands):
            raise ValueError(f"{partition.path} has {a.shape[2]} bands, not {len(self.bands)}")
        for lo in range(0, a.shape[0], ROWS):
            part = a[lo : lo + ROWS]
            z, x = np.mgrid[lo : lo + part.shape[0], 0 : part.shape[1]]
            keys = [np.full(z.size, partition.tile_z), np.full(z.size, partition.tile_x), z.ravel() + partition.tile_z * self.tile, x.ravel() + partition.tile_x * self.tile]
            columns = [pa.array(c, pa.int32()) for c in (*keys, *(part[:, :, k].ravel() for k in range(len(self.bands))))]
            yield pa.RecordBatch.from_arrays(columns, names=["tile_z", "tile_x", "z", "x", *self.bands])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, tile: int, bands: list[str], bits: int, overwrite: bool):
        self.path, self.tile, self.bands, self.bits, self.overwrite = path, tile, bands, bits, overwrite
        self.stage = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Moved:
        system, root = _system(self.path)
        system.create_dir(f"{root}/{self.stage}", recursive=True)
        done: list[tuple[int, int]] = []
        held: list[tuple[np.ndarray, ...]] = []
        now: tuple[int, int] | None = None

        def put() -> None:
            z, x, *values = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            a = np.zeros((int(z.max()) + 1, int(x.max()) + 1, len(values)), np.uint16 if self.bits == 16 else np.uint8)
            for k, v in enumerate(values):
                if v.min() < 0 or v.max() >= 1 << self.bits:
                    raise ValueError(f"{self.bands[k]} does not fit {self.bits} bits")
                a[z, x, k] = v
            with system.open_output_stream(f"{root}/{self.stage}/tile_{now[0]}_{now[1]}.png") as file:
                file.write(encode(a[:, :, 0] if len(values) == 1 else a))
            done.append(now)

        for batch in iterator:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            z, x, *values = (column[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("z", "x", *self.bands))
            tz, tx = z // self.tile, x // self.tile
            edges = [0, *(np.flatnonzero((np.diff(tz) != 0) | (np.diff(tx) != 0)) + 1).tolist(), len(z)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                key = int(tz[lo]), int(tx[lo])
                if key != now:
                    if held:
                        put()
                    if key in done:
                        raise ValueError(f"rows of tile {key} are not together")
                    now = key
                held.append((z[lo:hi] - key[0] * self.tile, x[lo:hi] - key[1] * self.tile, *(v[lo:hi] for v in values)))
        if held:
            put()
        return _Moved(done)

    def commit(self, messages: list[_Moved | None]) -> None:
        """Moves the tiles of the tasks that counted; what failed attempts left goes with the staging folder."""
        from pyarrow import fs

        system, root = _system(self.path)
        tiles = [t for m in messages if m is not None for t in m.tiles]
        if len(tiles) != len(set(tiles)):
            self.abort(messages)
            raise ValueError("a tile was written by two tasks")
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.is_file and NAME.search(f.path):
                    system.delete_file(f.path)
        for z, x in tiles:
            system.move(f"{root}/{self.stage}/tile_{z}_{x}.png", f"{root}/tile_{z}_{x}.png")
        self.abort(messages)

    def abort(self, messages: list[_Moved | None]) -> None:
        from pyarrow import fs

        system, root = _system(self.path)
        if system.get_file_info(f"{root}/{self.stage}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.stage}")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(TileSource)


def write(cells: DataFrame, path: str, tile: int = 512, bands: str = "v", bits: int = 16) -> None:
    """Writes cells (z, x, bands) as tiles, a tile in one task, in place of the tiles that are there."""
    names = [b.strip() for b in bands.split(",")]
    keys = [F.floor(F.col(c) / tile).cast("int") for c in ("z", "x")]
    rows = cells.select(F.col("z").cast("int").alias("z"), F.col("x").cast("int").alias("x"), *(F.col(b).cast("int").alias(b) for b in names))
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, "z", "x")
    whole = sorted_rows.select(keys[0].alias("tile_z"), keys[1].alias("tile_x"), "z", "x", *names)
    register(cells.sparkSession)
    whole.write.format("png_tiles").option("tile", tile).option("bands", bands).option("bits", bits).mode("overwrite").save(path)


def read(spark: SparkSession, path: str, tile: int = 512, bands: str = "v", tile_z: str = ":", tile_x: str = ":") -> DataFrame:
    """(tile_z, tile_x, z, x, bands) of a folder of tiles, or of a range of them."""
    register(spark)
    return spark.read.format("png_tiles").options(tile=tile, bands=bands, tile_z=tile_z, tile_x=tile_x).load(path)
