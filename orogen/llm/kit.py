"""Shared helpers: a workspace of written tables, and numpy views of Arrow text.

Workspace
    Operators cut lineage by writing a table and reading it back. The tables
    live under ``spark.checkpoint.dir`` (read from the session), so a lost
    executor never takes an intermediate result with it. Without that setting a
    workspace opens in local mode only, in a temporary folder; a cluster has no folder
    that all executors share, and it refuses.

Manifest
    A small written table that names the parts of a store. Each version is written whole
    before it counts, so a reader sees the last complete one after a broken-off write. The
    last KEPT_VERSIONS are kept.

Text views
    ``TextView`` exposes the UTF-8 bytes of a slice of an Arrow string column
    as one numpy array plus offsets. A null text is an empty one. Words are
    maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; they never span two
    documents.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64
KEPT_VERSIONS = 3
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BROADCAST, SMALL_TABLE = "spark.sql.autoBroadcastJoinThreshold", "256k"
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class Workspace:
    """A folder of intermediate tables shared by the driver and all executors.

    ``root`` reopens the folder of an earlier workspace.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not (root or top):
            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = f"file://{tempfile.gettempdir()}/checkpoints"
        self.root = root or f"{top.rstrip('/')}/ws-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return the written table; the schema is not inferred again."""
        writer = df.write.mode("overwrite")
        batch = self.spark.conf.get(BATCH_ROWS)
        self.spark.conf.set(BATCH_ROWS, str(min(int(batch), 1000)))  # texts reach Python by the thousand, for this write only
        try:
            (writer.partitionBy(*by) if by else writer).parquet(self.path(name))
        finally:
            self.spark.conf.set(BATCH_ROWS, batch)
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let go of finished steps: Spark removes a shuffle's files when the driver's JVM collects it."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Remove a table that no returned plan reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within, Spark broadcasts of its own accord only what it takes for SMALL_TABLE at most.

    It judges a written table by its compressed files and leaves out what an explode multiplies, so
    under the default of 10 MB the driver may have to hold a hundred times that.
    """
    was = spark.conf.get(BROADCAST)
    if not was.startswith("-"):  # else nothing is broadcast anyway
        spark.conf.set(BROADCAST, SMALL_TABLE)
    try:
        yield
    finally:
        spark.conf.set(BROADCAST, was)


class Manifest:
    """The latest complete list of (kind, name) of a store, kept in versions under ``name``."""

    SCHEMA = "kind string, name string, version long"

    def __init__(self, store: Workspace, name: str):
        self.store, self.name, self.version = store, f"{name}-manifest", -1
        self.rows: list[tuple[str, str]] = []
        try:
            found = store.spark.read.schema(self.SCHEMA).parquet(store.path(self.name))
            self.version = found.agg(F.max("version")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return  # no store yet
        if self.version is None:  # only a first write that broke off
            self.version = -1
        self.rows = [(r["kind"], r["name"]) for r in found.filter(F.col("version") == self.version).collect() if r["name"]]

    def names(self, kind: str) -> list[str]:
        return [n for k, n in self.rows if k == kind]

    def save(self, rows: list[tuple[str, str]]) -> None:
        """Replace the list; a few rows, so one task writes one file."""
        self.version, self.rows = self.version + 1, list(rows)
        frame = self.store.spark.createDataFrame([*rows, ("", "")], "kind string, name string").coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.store.path(self.name)}/version={self.version}")
        if self.version >= KEPT_VERSIONS:
            self.store.drop(f"{self.name}/version={self.version - KEPT_VERSIONS}")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over a uint64 array."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, U64(base))
            step[0] = 1
            _POWERS[k] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """prefix[i] such that any byte range's hash follows from two entries."""
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end), equal for equal bytes."""
    _, inverse = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * U64(0x2545F4914F6CDD1D))


class TextView:
    """UTF-8 bytes, document offsets and words of some rows of a string column."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, body = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.data = LOWER[data] if lower else data

    def words(self) -> None:
        """Sets ``starts``, ``ends`` of words, and ``first``: each document's first word."""
        inside = ~SPACE[self.data]
        n, cuts = len(inside), self.off[1:-1]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[cuts[cuts < n]] = False
            after[cuts[cuts > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.off)

    def word_hashes(self) -> np.ndarray:
        self.words()
        return range_hashes(prefix_hashes(self.data), self.starts, self.ends)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts a batch into runs of rows with about ``most`` bytes of text (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(lo, hi - lo), column.slice(lo, hi - lo)
        lo = hi


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one document; fewer words make one shingle."""
    if not len(words):
        return words
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, U64(width * 0x5851F42D4C957F2D & _MASK))
    for j in range(width):
        out = mix(out * U64(0xDA942042E4DD58B5)) + words[j : len(words) - width + 1 + j]
    return mix(out)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
