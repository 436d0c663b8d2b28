"""Embedding whitening: streaming rank-one covariance, parallel merges, symmetric QR.

1. Vectors become whole numbers x = floor(256 c); equal vectors count once in the fit.
2. Each task runs over its vectors once and keeps n, the sums, the mean and the matrix of
   squared deviations, updated by one rank-one term a vector.
3. Tasks' states meet by the parallel update formula in rounds of FANIN, so that no task and not the
   driver gets more than FANIN states of one matrix each, whatever the number of tasks.
4. The covariance is brought to tridiagonal form by reflections and then to diagonal form by implicit QR
   steps with shifts. It has one size for any number of rows, and so do the components that are sent to
   the tasks.
5. The fit list is whitened and its covariance taken in the same way, which gives the identity error;
   then every row is whitened.

Sums and deviations are exact: 64-bit arithmetic where a bound on its terms allows, unbounded whole numbers
otherwise. A deviation of more than 38 digits is null.

Cases: rows with a null vector, or with null or non-finite entries, are dropped. Vectors of another length than
the most common one (the longer of two) have no place in a matrix and are dropped as well. Entries beyond 64 bits
after scaling are held at the ends of that range. Null and repeated ids are rows like others. Components with no
variance (below the rounding of the largest) are left out, so one distinct vector, or an empty table, gives
no rows. Of equal eigenvalues, the order is the solver's. Extra columns are ignored. A repeated vector is
summed up before the shuffle, so one that a third of all rows hold costs a row a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import Workspace

SCALE, FANIN = 256, 32
_STATE = "part long, n long, sums array<decimal(38,0)>, mean array<double>, squares array<double>"
_WIDE = pa.decimal128(38, 0)


class Moments:
    """Count, exact sums, mean and squared deviations (a matrix) of vectors seen one by one."""

    def __init__(self, d: int):
        self.n, self.sums = 0, np.zeros(d, object)
        self.mean, self.squares = np.zeros(d), np.zeros((d, d))

    def add(self, x: np.ndarray, exact: bool = True) -> None:
        """Rows of ``x``, each by a rank-one update."""
        if exact:
            wide = len(x) and float(np.abs(x.astype(float)).max()) * len(x) >= 2.0**62
            self.sums = self.sums + (x.astype(object) if wide else x).sum(0).astype(object)
        for row in x.astype(float):
            self.n += 1
            before = row - self.mean
            self.mean += before / self.n
            self.squares += before[:, None] * (row - self.mean)

    def merge(self, n: int, sums: np.ndarray, mean: np.ndarray, squares: np.ndarray) -> None:
        """Another part's moments, by the parallel update formula."""
        if n:
            apart, total = mean - self.mean, self.n + n
            self.squares += squares + np.outer(apart, apart) * (self.n / total * n)
            self.mean += apart * (n / total)
            self.sums, self.n = self.sums + sums, total

    def covariance(self) -> np.ndarray:
        return (self.squares + self.squares.T) / (2 * self.n)

    def row(self, part: int) -> pa.RecordBatch:
        sums = pa.array([[Decimal(int(s)) for s in self.sums]], pa.list_(_WIDE))
        lists = [pa.array([v.ravel()], pa.list_(pa.float64())) for v in (self.mean, self.squares)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), sums, *lists], names=[f.split()[0] for f in _STATE.split(", ")])


def vectors(column: pa.Array) -> np.ndarray:
    """The rows of a column of 8-byte whole numbers held as bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def quantised(rows: DataFrame, vector: str = "embedding", ids: str = "vec_id") -> DataFrame:
    """(vec_id, size, x): the usable rows, their vectors as 8-byte whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out, sizes = [], [], []
            lists = batch.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.float64())
            value = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(SCALE * value)
                x = np.where(scaled >= 2.0**63, 2**63 - 1, np.where(scaled < -(2.0**63), -(2**63), 0))
                inside = np.abs(scaled) < 2.0**63
                x[inside] = scaled[inside].astype(np.int64)
            bad = np.append(0, np.cumsum(~np.isfinite(value)))
            end = np.cumsum(size)
            for k, (lo, hi) in enumerate(zip(end - size, end, strict=True)):
                if hi > lo and bad[hi] == bad[lo]:
                    keep.append(k)
                    sizes.append(int(hi - lo))
                    out.append(x[lo:hi].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "size", "x"])

    return rows.select(F.col(ids).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, size long, x binary")


def _merged(states: Iterator[tuple], d: int) -> Moments:
    total = Moments(d)
    for n, sums, mean, squares in states:
        total.merge(n, np.array([int(s) for s in sums], object), np.array(mean), np.array(squares).reshape(d, d))
    return total


def moments(parts: DataFrame, d: int, store: Workspace, name: str) -> Moments:
    """The whole of a table of states: by rounds of FANIN in tasks, then the last few."""

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(c).to_pylist() for c in ("n", "sums", "mean", "squares")), strict=True)
        return pa.Table.from_batches([_merged(rows, d).row(key[0].as_py())])

    turn, states = 0, store.save(parts, f"{name}-0")
    while (many := states.count()) > FANIN:
        turn += 1
        near = states.withColumn("part", F.pmod("part", F.lit(-(-many // FANIN))))
        states = store.save(near.groupBy("part").applyInArrow(meet, _STATE), f"{name}-{turn}")
    rows = states.orderBy("part").collect()  # at most FANIN
    out = _merged(((r["n"], r["sums"], r["mean"], r["squares"]) for r in rows), d)
    for k in range(turn + 1):
        store.drop(f"{name}-{k}")
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, next diagonal and basis of a symmetric matrix, by reflections."""
    a, d = a.copy(), len(a)
    basis = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = v @ v
        if size == 0:
            continue
        v *= np.sqrt(2 / size)
        rest = a[k + 1 :, k:]
        rest -= np.outer(v, v @ rest)
        rest = a[k:, k + 1 :]
        rest -= np.outer(rest @ v, v)
        rest = basis[:, k + 1 :]
        rest -= np.outer(rest @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), basis


def symmetric_eigen(a: np.ndarray, most_steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit vectors (columns) by implicit QR steps with Wilkinson's shift."""
    diagonal, beside, basis = tridiagonal(np.asarray(a, float))
    basis = np.ascontiguousarray(basis.T)  # rows are vectors, so that a rotation is contiguous
    end, left = len(diagonal) - 1, most_steps * max(1, len(diagonal))
    tiny = np.finfo(float).eps
    while end > 0:
        small = np.abs(beside[:end]) <= tiny * (np.abs(diagonal[:end]) + np.abs(diagonal[1 : end + 1]))
        beside[:end][small] = 0
        if small[end - 1]:
            end -= 1
            continue
        zeros = np.flatnonzero(small)
        start = int(zeros[-1]) + 1 if len(zeros) else 0
        left -= 1
        if left < 0:
            raise RuntimeError("the eigenvalues did not settle")
        half = (diagonal[end - 1] - diagonal[end]) / 2
        last = beside[end - 1]
        shift = diagonal[end] - last * last / (half + np.copysign(np.hypot(half, last), half))
        x, z = diagonal[start] - shift, beside[start]
        for k in range(start, end):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                beside[k - 1] = r
            p, q, e = diagonal[k], diagonal[k + 1], beside[k]
            diagonal[k] = c * c * p + 2 * c * s * e + s * s * q
            diagonal[k + 1] = s * s * p - 2 * c * s * e + c * c * q
            beside[k] = (c * c - s * s) * e + c * s * (q - p)
            x = beside[k]
            if k < end - 1:
                z = s * beside[k + 1]
                beside[k + 1] *= c
            upper, lower = basis[k].copy(), basis[k + 1].copy()
            basis[k], basis[k + 1] = c * upper + s * lower, c * lower - s * upper
    order = np.argsort(-diagonal, kind="stable")
    return diagonal[order], basis[order].T


class Fit:
    """What tasks need to whiten: sizes follow the dimension alone."""

    def __init__(self, whole: Moments, most: int):
        self.n, self.sums = whole.n, [int(s) for s in whole.sums]
        values, basis = symmetric_eigen(whole.covariance())
        trace = float(values.sum())
        real = values[:most] > max(values[0], 0.0) * len(values) * np.finfo(float).eps
        self.values, self.basis = values[:most][real], basis[:, :most][:, real]
        self.explained = self.values / trace if trace > 0 else self.values
        self.centre = np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(float) - self.centre) @ self.basis / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums over dimensions of (n x - S)^2, exact."""
        sums = np.array(self.sums, object)
        largest = self.n * max(1.0, float(np.abs(x.astype(float)).max(initial=0))) + float(max(map(abs, self.sums)))
        if largest * largest * x.shape[1] < 2.0**62:
            apart = x * np.int64(self.n) - sums.astype(np.int64)
            return pa.array((apart * apart).sum(1)).cast(_WIDE)
        apart = x.astype(object) * self.n - sums
        return pa.array([Decimal(int(v)) if v < 10**38 else None for v in (apart * apart).sum(1)], _WIDE)


def whiten(rows: DataFrame, components: int = 4, vector: str = "embedding", ids: str = "vec_id", store: Workspace | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; see the module."""
    spark = rows.sparkSession
    store = store or Workspace(spark)
    out = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    used = quantised(rows, vector, ids)
    fit_list = store.save(used.select("size", "x").distinct(), "fit-list")
    sizes = used.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    d = int(sizes[0]["size"])
    fit_list = fit_list.filter(F.col("size") == d).select("x")

    def of(batches: Iterator[pa.RecordBatch], change, width: int, exact: bool) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        total = Moments(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                total.add(change(vectors(batch.column(0).slice(lo, 4096))), exact)
        if total.n:
            yield total.row(TaskContext.get().partitionId())

    fit = Fit(moments(fit_list.mapInArrow(lambda b: of(b, lambda x: x, d, True), _STATE), d, store, "moments"), components)
    k = len(fit.values)
    if not k:
        return spark.createDataFrame([], out)
    white = moments(fit_list.mapInArrow(lambda b: of(b, fit.whiten, k, False), _STATE), k, store, "white")
    error = float(np.abs(white.covariance() - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in out.split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = vectors(part.column(1))
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                constant = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, fit.n), fit.whiten(x).ravel(), np.tile(fit.explained, m), np.full(m * k, error)]
                component, n, whitened, explained, errors = map(pa.array, constant)
                yield pa.RecordBatch.from_arrays([part.column(0).take(each), component, n, fit.deviations(x).take(each), whitened, explained, errors], names=names)

    return used.filter(F.col("size") == d).select("vec_id", "x").mapInArrow(run, out)
