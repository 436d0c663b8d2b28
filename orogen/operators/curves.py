"""Guide curves: cubic interpolation of way points, stations and their jitter.

Tables of way points are fitted by spline in tasks, with a tridiagonal solve, so one spline's points
must fit in a task; lists of way points that are parameters are fitted where they are given. Either way the fit is a segment
table, and evaluation is a join on the segment number and Horner's rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import normal, uniform, uniform_of

SEGMENT = "spline_id int, seg int, t0 double, t1 double, ax double, bx double, cx double, dx double, az double, bz double, cz double, dz double"


def knots(waypoints: DataFrame) -> DataFrame:
    """Adds t: evenly spaced in [0, 1] by seq within a spline; 0 for a single point."""
    own = Window.partitionBy("spline_id")
    n = F.count("*").over(own)
    place = F.row_number().over(own.orderBy("seq", "x", "z")) - 1
    return waypoints.withColumn("t", F.when(n > 1, place / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0)))


def cubic(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (a, b, c, d) of each segment of the interpolating cubic spline.

    The third derivative is continuous at the second and last but one knots; two
    points give a line and three a parabola. A segment is a + b s + c s^2 + d s^3, s = t - t0.
    """
    n = len(t)
    if n == 1:
        return np.array([[y[0], 0.0, 0.0, 0.0]])
    h, rise = np.diff(t), np.diff(y) / np.diff(t)
    if n == 2:
        return np.array([[y[0], rise[0], 0.0, 0.0]])
    if n == 3:
        bend = (rise[1] - rise[0]) / (t[2] - t[0])
        slopes = np.array([rise[0] - bend * h[0], rise[0] + bend * h[0], rise[1] + bend * h[1]])
    else:
        below, middle, above, right = (np.zeros(n) for _ in range(4))
        below[1:-1], middle[1:-1], above[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]  # second derivatives agree
        right[1:-1] = 3 * (rise[:-1] * h[1:] + rise[1:] * h[:-1])
        for row, first, second in ((0, 0, 1), (-1, -1, -2)):  # third derivatives agree
            reach = h[first] + h[second]
            middle[row] = h[second]
            (above if row == 0 else below)[row] = reach
            right[row] = ((h[first] + 2 * reach) * h[second] * rise[first] + h[first] ** 2 * rise[second]) / reach
        slopes = tridiagonal(below, middle, above, right)
    c = (3 * rise - 2 * slopes[:-1] - slopes[1:]) / h
    d = (slopes[:-1] + slopes[1:] - 2 * rise) / h**2
    return np.stack([y[:-1], slopes[:-1], c, d], 1)


def tridiagonal(below: np.ndarray, middle: np.ndarray, above: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves below[i] y[i-1] + middle[i] y[i] + above[i] y[i+1] = right[i], by elimination and back."""
    b, a, r, m = below.tolist(), above.tolist(), right.tolist(), middle.tolist()
    for i in range(1, len(m)):
        w = b[i] / m[i - 1]
        m[i] -= w * a[i - 1]
        r[i] -= w * r[i - 1]
    out = [r[-1] / m[-1]]
    for i in range(len(m) - 2, -1, -1):
        out.append((r[i] - a[i] * out[-1]) / m[i])
    return np.array(out[::-1])


def fit(waypoints: DataFrame) -> DataFrame:
    """The segment table of a table of way points (spline_id, seq, x, z); a spline of one point is one constant segment."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        t, n = table.column("t").to_numpy(), table.num_rows
        x, z = (cubic(t, table.column(c).to_numpy()) for c in ("x", "z"))
        k = len(x)
        columns = [pa.array([key[0].as_py()] * k, pa.int32()), pa.array(range(k), pa.int32()), t[:k], t[min(1, n - 1) :][:k], *x.T, *z.T]
        return pa.table([pa.array(c) for c in columns], names=[f.split()[0] for f in SEGMENT.split(", ")])

    points = waypoints.select(F.col("spline_id").cast("int").alias("spline_id"), "seq", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))
    return knots(points).groupBy("spline_id").applyInArrow(run, SEGMENT)


def segments(spark: SparkSession, waypoints: dict[int, list[tuple[float, float]]]) -> DataFrame:
    """The segment table of each spline's way points (x, z)."""
    rows = []
    for spline, points in waypoints.items():
        xz = np.array(points, float)
        t = np.linspace(0, 1, len(points))
        fits = [cubic(t, xz[:, k]) for k in range(2)]
        for k in range(len(fits[0])):
            rows.append((spline, k, float(t[k]), float(t[min(k + 1, len(t) - 1)]), *map(float, fits[0][k]), *map(float, fits[1][k])))
    return spark.createDataFrame(rows, SEGMENT)


def _one_segment(curves: DataFrame, form: Callable[[str], tuple[Column, Column, Column, Column]]) -> DataFrame:
    fields = [f.split()[0] for f in SEGMENT.split(", ")]
    cells = dict(zip(fields[4:], [*form("x"), *form("z")], strict=True))
    ends = {"spline_id": F.col("spline_id").cast("int"), "seg": F.lit(0), "t0": F.lit(0.0), "t1": F.lit(1.0)}
    return curves.select(*(c.cast("double").alias(n) if n in cells else c.alias(n) for n, c in (ends | cells).items()))


def bezier(curves: DataFrame) -> DataFrame:
    """The segment table of Bezier curves (spline_id, and px, pz to sx, sz: four control points), one segment each."""

    def form(k: str) -> tuple[Column, Column, Column, Column]:
        p, q, r, s = (F.col(f"{n}{k}") for n in "pqrs")
        return p, 3.0 * (q - p), 3.0 * (p - 2.0 * q + r), s - 3.0 * r + 3.0 * q - p

    return _one_segment(curves, form)


def hermite(curves: DataFrame) -> DataFrame:
    """The segment table of Hermite curves (spline_id, start px, pz and its tangent mx, mz, end qx, qz and its tangent nx, nz)."""

    def form(k: str) -> tuple[Column, Column, Column, Column]:
        p, m, q, n = (F.col(f"{c}{k}") for c in "pmqn")
        return p, m, 3.0 * (q - p) - 2.0 * m - n, 2.0 * (p - q) + m + n

    return _one_segment(curves, form)


def parameters(splines: DataFrame, count: int) -> DataFrame:
    """(spline_id, inst_id, t): ``count`` values evenly spaced in [0, 1]."""
    ids = splines.select("spline_id").distinct()
    out = ids.select("spline_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("inst_id"))
    return out.withColumn("t", F.col("inst_id") / F.lit(float(max(1, count - 1))))


def evaluate(points: DataFrame, segment_table: DataFrame) -> DataFrame:
    """Adds cx, cz, the derivative (vx, vz), the tangent's angle and unit tangent and normal."""
    own = Window.partitionBy("spline_id")
    table = segment_table.withColumn("n_seg", F.count("*").over(own)).withColumnsRenamed({"cx": "c_x", "cz": "c_z"})
    seg = F.least(F.floor(F.col("t") * F.col("n_seg")).cast("int"), F.col("n_seg").cast("int") - 1)
    sized = points.join(table.select("spline_id", "n_seg").distinct(), "spline_id").withColumn("seg", seg).drop("n_seg")
    out = sized.join(table, ["spline_id", "seg"])
    s = F.col("t") - F.col("t0")
    value = lambda k: F.col(f"a{k}") + s * (F.col(f"b{k}") + s * (F.col(f"c_{k}") + s * F.col(f"d{k}")))
    speed = lambda k: F.col(f"b{k}") + s * (2.0 * F.col(f"c_{k}") + s * (3.0 * F.col(f"d{k}")))
    out = out.select(*points.columns, value("x").alias("cx"), value("z").alias("cz"), speed("x").alias("vx"), speed("z").alias("vz"))
    norm = F.hypot("vx", "vz")
    out = out.withColumns({"angle": F.atan2("vz", "vx"), "tx": F.when(norm > 0, F.col("vx") / norm), "tz": F.when(norm > 0, F.col("vz") / norm)})
    return out.withColumns({"nx": -F.col("tz"), "nz": F.col("tx")})


def jittered(stations: DataFrame, seed: int = 42, base_altitude: float = 240.0, sigma: float = 18.0, mode: str = "uniform", sd: float = 30.0, turn: float = 0.0, sigma_spread: float = 0.0) -> DataFrame:
    """Adds height, length and sigma, and turns the angle, by counter-based draws.

    ``uniform`` draws heights within a quarter of the base; ``normal`` draws them around it.
    Lengths are uniform in [120, 260). ``turn`` bounds the angle's change, in radians, and
    ``sigma_spread`` the share by which sigma varies.
    """
    keys = [F.col("spline_id"), F.col("inst_id")]
    if mode == "uniform":
        height = base_altitude * uniform(seed, "height", *keys, low=0.75, high=1.25)
    else:
        height = normal(seed, "height", *keys, mean=base_altitude, sd=sd)
    return stations.withColumns(
        {
            "height": height,
            "length": uniform(seed, "length", *keys, low=120.0, high=260.0),
            "sigma": sigma * uniform(seed, "sigma", *keys, low=1.0 - sigma_spread, high=1.0 + sigma_spread) if sigma_spread else F.lit(float(sigma)),
            "angle": F.col("angle") + uniform(seed, "turn", *keys, low=-turn, high=turn) if turn else F.col("angle"),
        }
    )


NODES, WEIGHTS = np.polynomial.legendre.leggauss(12)


class Arcs:
    """Arc length along many splines at once, from their segments (t0, t1 and the coefficients of x and z), spline by spline."""

    def __init__(self, first: np.ndarray, t0: np.ndarray, t1: np.ndarray, x: np.ndarray, z: np.ndarray):
        self.t0, self.x, self.z = t0, x, z
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t0))))
        last = np.append(first[1:], len(t0)) - 1
        k, low, high = np.arange(len(t0)), t0, np.append(t0[1:], t1[-1])
        high[last] = t1[last]
        whole, done = self.between(k, low, high), []
        near = 1e-11 * np.maximum(1.0, np.add.reduceat(whole, first))
        for _ in range(40):  # steps whose halves disagree with them are halved
            middle = (low + high) / 2
            before, after = self.between(k, low, middle), self.between(k, middle, high)
            holds = np.abs(before + after - whole) <= near[own[k]]
            done += [(k[holds], low[holds], before[holds]), (k[holds], middle[holds], after[holds])]
            k, low, high = np.append(k[~holds], k[~holds]), np.append(low[~holds], middle[~holds]), np.append(middle[~holds], high[~holds])
            whole = np.append(before[~holds], after[~holds])
            if holds.all():
                break
        self.k, self.starts, lengths = (np.concatenate(v) for v in zip(*done, (k, low, whole), strict=True))
        order = np.lexsort((self.starts, self.k))
        self.k, self.starts, lengths = self.k[order], self.starts[order], lengths[order]
        self.first = np.flatnonzero(np.append(True, np.diff(own[self.k]) > 0))
        self.ends = np.append(self.starts[1:], 0.0)
        self.ends[np.append(self.first[1:], len(lengths)) - 1] = t1[last]
        self.walked = [np.append(0.0, np.cumsum(part)) for part in np.split(lengths, self.first[1:])]
        self.length = np.array([w[-1] for w in self.walked])

    def between(self, k: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of pieces [a, b] of segments k, by quadrature."""
        s = (a + b)[:, None] / 2 + (b - a)[:, None] / 2 * NODES - self.t0[k][:, None]
        speed = [c[k, 1][:, None] + s * (2 * c[k, 2][:, None] + s * (3 * c[k, 3][:, None])) for c in (self.x, self.z)]
        return (np.hypot(*speed) * WEIGHTS).sum(1) * (b - a) / 2

    def parameters(self, arcs: list[np.ndarray]) -> np.ndarray:
        """Where each spline has run through each of its arc lengths, by root finding within the steps that hold them."""
        own = np.repeat(np.arange(len(arcs)), [len(v) for v in arcs])
        found = [np.clip(np.searchsorted(w, v, side="left") - 1, 0, len(w) - 2) for w, v in zip(self.walked, arcs, strict=True)]
        left = np.concatenate([v - w[i] for w, v, i in zip(self.walked, arcs, found, strict=True)])
        whole = np.concatenate([w[i + 1] - w[i] for w, i in zip(self.walked, found, strict=True)])
        step = np.concatenate(found) + self.first[own]
        k, start, low, high = self.k[step], self.starts[step], self.starts[step], self.ends[step]
        t = start + (high - start) * np.where(whole > 0, left / np.where(whole > 0, whole, 1.0), 0.0)
        near, live = 1e-13 * np.maximum(1.0, self.length[own]), np.arange(len(t))
        for _ in range(60):  # Newton's steps; those that would leave the bracket become halvings
            over = self.between(k[live], start[live], t[live]) - left[live]
            low[live], high[live] = np.where(over > 0, low[live], t[live]), np.where(over > 0, t[live], high[live])
            far = np.bincount(own[live], np.abs(over) > near[live], len(arcs))[own[live]] > 0  # a spline's stations end together
            live, over = live[far], over[far]
            if not len(live):
                break
            speed = self.speed(k[live], t[live])
            new = t[live] - over / np.where(speed > 0, speed, 1.0)
            t[live] = np.where((speed > 0) & (new > low[live]) & (new < high[live]), new, (low[live] + high[live]) / 2)
        return np.where(left <= 0, start, t)

    def speed(self, k: np.ndarray, t: np.ndarray) -> np.ndarray:
        s = t - self.t0[k]
        return np.hypot(*(c[k, 1] + s * (2 * c[k, 2] + s * (3 * c[k, 3])) for c in (self.x, self.z)))


AT_ONCE = 4096  # segments whose splines are worked on together; one longer spline is taken whole


def spaced_stations(segment_table: DataFrame, spacing: float, jitter: float = 0.25, seed: int = 42) -> DataFrame:
    """(spline_id, inst_id, t): stations along each spline, from its start.

    A station lies the spacing, stretched by its draw of up to ``jitter``, beyond the one before it along the curve. Arc
    lengths come from quadrature and are inverted by root finding, so no station is lost however long the curve is.
    Splines come sorted and are worked on by the thousand.
    """

    def along(spline: int | None, length: float) -> np.ndarray:
        at, end = [0.0], length * (1 + 1e-9)
        gap = (lambda i: 1.0 + jitter * uniform_of(seed, "gap", spline, i)) if jitter else lambda _: 1.0
        while (ahead := at[-1] + spacing * gap(len(at) - 1)) <= end:
            at.append(min(ahead, length))
        return np.array(at)

    def stations(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        of = lambda *names: np.stack([table.column(n).to_numpy() for n in names], 1)
        arcs = Arcs(first, table.column("t0").to_numpy(), table.column("t1").to_numpy(), of("ax", "bx", "cx", "dx"), of("az", "bz", "cz", "dz"))
        splines = table.column("spline_id").take(pa.array(first))
        at = [along(*v) for v in zip(splines.to_pylist(), arcs.length.tolist(), strict=True)]
        count = [len(v) for v in at]
        ids = splines.combine_chunks().take(pa.array(np.repeat(np.arange(len(first)), count)))
        number = pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in count]))
        return pa.RecordBatch.from_arrays([ids.cast(pa.int32()), number, pa.array(arcs.parameters(at))], names=["spline_id", "inst_id", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def whole(table: pa.Table, end: bool) -> Iterator[pa.RecordBatch]:
            """Stations of the splines that have ended; the last one waits for more unless it is the end."""
            null = table.column("spline_id").is_null().to_numpy()
            key = table.column("spline_id").fill_null(0).to_numpy()
            first = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(null.astype(int)) != 0)))
            bounds = np.append(first, len(key)) if end else first
            lo = 0
            while lo < len(bounds) - 1:
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + AT_ONCE, side="right")) - 1)
                yield stations(table.slice(bounds[lo], bounds[hi] - bounds[lo]), bounds[lo:hi] - bounds[lo])
                lo = hi
            waiting[:] = [] if end else table.slice(bounds[-1]).to_batches()

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                if sum(b.num_rows for b in waiting) > AT_ONCE:
                    yield from whole(pa.Table.from_batches(waiting), False)
        if waiting:
            yield from whole(pa.Table.from_batches(waiting), True)

    # a number of tasks of its own: by bytes, many splines' small rows would be one task's
    tasks = int(segment_table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segment_table.repartition(tasks, "spline_id").sortWithinPartitions("spline_id", "seg").mapInArrow(run, "spline_id int, inst_id int, t double")


def tangent_frame(angle: Column, dx: Column, dz: Column) -> tuple[Column, Column]:
    """Coordinates along and across a direction."""
    c, s = F.cos(angle), F.sin(angle)
    return dx * c + dz * s, dz * c - dx * s


FULL_TURN = 2 * math.pi
