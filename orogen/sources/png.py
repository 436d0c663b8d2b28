"""PNG height maps, masks and colour images, decoded and encoded with the standard library.

Reading goes through Spark's binary files, so any file system it knows will do. A file is
decoded in one task; large maps are best kept as one file a tile, which is also how
they are written: rows of (tile_z, tile_x, content).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiles import dealt

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode(a: np.ndarray) -> bytes:
    """An 8- or 16-bit grey (rows, columns) or RGB (rows, columns, 3) image."""
    bits = 16 if a.dtype == np.uint16 else 8
    kind = 0 if a.ndim == 2 else 2
    body = a.astype(">u2" if bits == 16 else np.uint8).reshape(a.shape[0], -1)
    raw = b"".join(b"\0" + row.tobytes() for row in body)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], bits, kind, 0, 0, 0)
    return _MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode(content: bytes) -> np.ndarray:
    """(rows, columns, channels) of a non-interlaced 8- or 16-bit PNG without a palette."""
    if content[:8] != _MAGIC:
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at < len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        part = content[at + 8 : at + 8 + size]
        if zlib.crc32(name + part) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"damaged chunk {name!r}")
        head = struct.unpack(">IIBBBBB", part) if name == b"IHDR" else head
        data += part if name == b"IDAT" else b""
        at += 12 + size
    columns, rows, bits, kind, _, _, interlaced = head
    if kind not in _CHANNELS or bits not in (8, 16) or interlaced:
        raise ValueError(f"unsupported PNG: colour type {kind}, {bits} bits, interlace {interlaced}")
    step = _CHANNELS[kind] * bits // 8
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, 1 + columns * step)
    out = np.zeros((rows, columns * step), np.uint8)
    before = np.zeros(columns * step, np.uint8)
    for y in range(rows):
        before = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], before, step)
    if bits == 16:
        return out.reshape(-1).view(">u2").astype(np.uint16).reshape(rows, columns, -1)
    return out.reshape(rows, columns, -1)


def _unfiltered(method: int, row: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    if method == 0:
        return row
    if method == 2:
        return row + up
    if method == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(row) + step, np.int64)
    above = np.concatenate([np.zeros(step, np.int64), up.astype(np.int64)])
    for i, v in enumerate(row.tolist(), step):
        a, b, c = out[i - step], above[i], above[i - step]
        if method == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
        out[i] = (v + guess) & 255
    return out[step:].astype(np.uint8)


def _cells(files: DataFrame, names: list[str], tile: int | None) -> DataFrame:
    """Pixels of rows (tile_z, tile_x, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tz, tx, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a = decode(content)
                z0, x0 = (tz * tile, tx * tile) if tile else (0, 0)
                for lo in range(0, a.shape[0], 64):
                    part = a[lo : lo + 64]
                    z, x = np.mgrid[lo : lo + part.shape[0], 0 : part.shape[1]]
                    columns = [pa.array((z + z0).ravel(), pa.int32()), pa.array((x + x0).ravel(), pa.int32())]
                    columns += [pa.array(part[:, :, k].ravel().astype(np.int32)) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays(columns, names=["z", "x", *names])

    return files.mapInArrow(run, ", ".join(["z int", "x int", *(f"{n} int" for n in names)]))


def decoded_tiles(tiles: DataFrame, tile: int, names: list[str] | None = None) -> DataFrame:
    """The cells of encoded tiles."""
    return _cells(tiles.select("tile_z", "tile_x", "content"), names or ["v"], tile)


def _decoded(spark: SparkSession, path: str, names: list[str], tile: int | None) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    place = lambda k: F.regexp_extract("path", r"_(-?\d+)_(-?\d+)\.png$", k).cast("int") if tile else F.lit(0)
    return _cells(files.select(place(1).alias("tile_z"), place(2).alias("tile_x"), "content"), names, tile)


def read_grey(spark: SparkSession, path: str, tile: int | None = None) -> DataFrame:
    """(z, x, v) of an 8- or 16-bit height map or mask, or of a folder of tiles."""
    return _decoded(spark, path, ["v"], tile)


def read_colour(spark: SparkSession, path: str, tile: int | None = None) -> DataFrame:
    """(z, x, r, g, b) of an RGB image."""
    return _decoded(spark, path, ["r", "g", "b"], tile)


def encoded(cells: DataFrame, value: str = "v", bits: int = 16, tile: int = 512) -> DataFrame:
    """(tile_z, tile_x, content): one PNG a tile, cut where the world ends; missing cells are 0."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tz, tx = key[0].as_py(), key[1].as_py()
        z, x = table.column("z").to_numpy() - tz * tile, table.column("x").to_numpy() - tx * tile
        a = np.zeros((int(z.max()) + 1, int(x.max()) + 1), np.uint16 if bits == 16 else np.uint8)
        a[z, x] = table.column("v").to_numpy()
        return pa.table({"tile_z": pa.array([tz], pa.int32()), "tile_x": pa.array([tx], pa.int32()), "content": pa.array([encode(a)], pa.binary())})

    rows = dealt(cells.select("z", "x", F.col(value).alias("v")), tile, 0)
    return rows.groupBy("tile_z", "tile_x").applyInArrow(run, "tile_z int, tile_x int, content binary")


def write_tiles(tiles: DataFrame, folder: str, name: str = "tile") -> None:
    """Writes (tile_z, tile_x, content) as files <name>_<tile_z>_<tile_x>.png in a shared folder."""

    def put(rows: Iterator) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{root}/{name}_{r['tile_z']}_{r['tile_x']}.png") as out:
                out.write(bytes(r["content"]))

    tiles.foreachPartition(put)


def write_partitioned(cells: DataFrame, path: str, tile: int = 512) -> None:
    """The grid as Parquet by tile, so that readers prune to the tiles they need."""
    dealt(cells, tile, 0).repartition("tile_z", "tile_x").write.mode("overwrite").partitionBy("tile_z", "tile_x").parquet(path)
