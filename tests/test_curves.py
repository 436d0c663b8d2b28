"""Splines from tables, stations by arc length, and the ordered fold, against dense or brute-force versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.functions.maths import lattice_noise, lattice_noise_array, uniform, uniform_of
from orogen.operators import curves, grid, render


def not_a_knot(t, y):
    """Coefficients of every segment from one dense system: values, two derivatives at inner knots, a third one at the ends."""
    n = len(t) - 1
    a, b, row = np.zeros((4 * n, 4 * n)), np.zeros(4 * n), 0

    def put(pairs, value):
        nonlocal row
        for k, v in pairs:
            a[row, k] += v
        b[row] = value
        row += 1

    h = np.diff(t)
    for k in range(n):
        put([(4 * k, 1)], y[k])
        put([(4 * k + j, h[k] ** j) for j in range(4)], y[k + 1])
    for k in range(n - 1):
        put([(4 * k + 1, 1), (4 * k + 2, 2 * h[k]), (4 * k + 3, 3 * h[k] ** 2), (4 * k + 5, -1)], 0)
        put([(4 * k + 2, 1), (4 * k + 3, 3 * h[k]), (4 * k + 6, -1)], 0)
    put([(3, 1), (7, -1)], 0)
    put([(4 * n - 5, 1), (4 * n - 1, -1)], 0)
    return np.linalg.solve(a, b).reshape(n, 4)


def test_splines_from_a_table(spark):
    rng = np.random.default_rng(1)
    splines = {s: rng.uniform(0, 90, (n, 2)) for s, n in ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 40))}
    rows = [(s, 10 * i, float(x), float(z)) for s, points in splines.items() for i, (x, z) in enumerate(points)]
    df = spark.createDataFrame(rows, "spline_id int, seq int, x double, z double").repartition(5)
    got = {s: sorted((r for r in curves.fit(df).collect() if r["spline_id"] == s), key=lambda r: r["seg"]) for s in splines}
    for s, points in splines.items():
        t = np.linspace(0, 1, len(points))
        for axis, name in enumerate("xz"):
            mine = np.array([[r[f"{c}{name}"] for c in "abcd"] for r in got[s]])
            if len(points) >= 4:
                assert mine == pytest.approx(not_a_knot(t, points[:, axis]), rel=1e-7, abs=1e-6)
            ends = [sum(r[f"{c}{name}"] * (r["t1"] - r["t0"]) ** j for j, c in enumerate("abcd")) for r in got[s]]
            assert mine[:, 0] == pytest.approx(points[: len(mine), axis]) and (len(points) == 1 or ends == pytest.approx(points[1:, axis]))
    assert curves.fit(df.limit(0)).collect() == []


def test_stations_keep_their_distance(spark):
    """Along the curve, neighbours are a spacing and its draw apart, and no further one fits."""
    rows = [(0, 2.0, 3.0, 10.0, 50.0, 40.0, -5.0, 60.0, 30.0), (1, 0.0, 0.0, 90.0, 0.0, -30.0, 1.0, 60.0, 0.0), (2, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0)]
    names = [f"{n}{a} double" for n in "pqrs" for a in "xz"]
    table = curves.bezier(spark.createDataFrame(rows, f"spline_id int, {', '.join(names)}"))
    for spacing in (3.0, 0.05):  # the closer one gives more stations than any fixed number of samples
        at = {}
        for r in curves.spaced_stations(table, spacing).collect():
            at.setdefault(r["spline_id"], []).append((r["inst_id"], r["t"]))
        assert sorted(at) == [0, 1, 2] and at[2] == [(0, 0.0)] and (spacing > 1 or len(at[0]) > 1200)
        for row in rows[:2]:
            p = np.array(row[1:]).reshape(4, 2)
            t = np.linspace(0, 1, 400_001)
            speed = np.hypot(*(3 * (1 - t)[:, None] ** 2 * (p[1] - p[0]) + 6 * ((1 - t) * t)[:, None] * (p[2] - p[1]) + 3 * t[:, None] ** 2 * (p[3] - p[2])).T)
            walked = np.append(0, np.cumsum((speed[1:] + speed[:-1]) / 2 * (t[1] - t[0])))
            taken = [v for _, v in sorted(at[row[0]])]
            arcs = np.interp(taken, t, walked)
            want = np.array([spacing * (1 + 0.25 * uniform_of(42, "gap", row[0], k)) for k in range(len(taken))])
            assert np.diff(arcs) == pytest.approx(want[:-1], abs=1e-5)
            assert (np.diff(arcs) >= spacing - 1e-5).all() and arcs[-1] + want[-1] > walked[-1] - 1e-6


def test_draws_over_arrays(spark):
    rows = [(float(u), float(v)) for u, v in np.random.default_rng(2).uniform(-90, 90, (40, 2))]
    df = spark.createDataFrame(rows, "u double, v double").select("u", "v", lattice_noise(7, F.col("u"), F.col("v"), 16.0).alias("n"), uniform(3, "a", F.floor("u"), F.lit("k")).alias("r"))
    for r in df.collect():
        assert lattice_noise_array(7, np.array([[r["u"]]]), np.array([[r["v"]]]), 16.0)[0, 0] == pytest.approx(r["n"], abs=1e-12)
        assert uniform_of(3, "a", math.floor(r["u"]), "k") == pytest.approx(r["r"], abs=1e-15)


@pytest.mark.parametrize("kind", ["ridge", "noise", "peak"])
def test_ordered_fold_is_the_fold_cell_by_cell(spark, kind):
    """The stream of a tile gives what each cell's own list of layers gives, in the order of inst_id."""
    rng = np.random.default_rng(3)
    rows = [(int(i), float(rng.uniform(-9, 60)), float(rng.uniform(-9, 60)), float(rng.uniform(0, 3)), float(rng.uniform(9, 90)), float(rng.integers(3, 25)), 2.0) for i in rng.permutation(40)]
    inst = spark.createDataFrame(rows, "inst_id int, cx double, cz double, angle double, height double, length double, sigma double").repartition(3)
    cells = grid.blank(spark, 50, 45).withColumn("h", F.when(F.expr("z = 7 and x = 9"), None).otherwise(F.col("z") * 0.25))
    if kind == "peak":
        inst = inst.select("inst_id", "cx", "cz", F.col("height").alias("h_peak"), F.col("length").alias("radius"), F.lit(1.8).alias("gamma"), F.lit(0.2).alias("alpha"), F.lit(3).alias("k"))
        boxed = render.boxes(inst.withColumns({"length": F.col("radius"), "sigma": F.lit(0.0)}), 45, 50)
        layer, out = render.peak_height(), render.composite(cells, boxed, render.peak_layer, render.PEAK, tile=16)
    else:
        noise = 0.3 if kind == "noise" else 0.0
        boxed = render.boxes(inst, 45, 50)
        layer, out = render.ridge_height(noise), render.composite(cells, boxed, render.ridge_layer(noise), render.RIDGE, tile=16)
    stacks = {}
    for r in render.covered(cells.select("z", "x"), boxed).select("z", "x", "inst_id", layer.alias("v")).collect():
        stacks.setdefault((r["z"], r["x"]), []).append((r["inst_id"], r["v"]))
    got = {(r["z"], r["x"]): r["h"] for r in out.collect()}
    assert len(got) == 50 * 45 and got[7, 9] is None
    for (z, x), h in got.items():
        if (z, x) != (7, 9):
            want = np.float32(z * 0.25)
            for _, v in sorted(stacks.get((z, x), [])):
                want = np.float32(0.5 * (float(want) + v + math.sqrt((float(want) - v) ** 2 + 12.0)))
            assert h == pytest.approx(float(want), rel=1e-6)
            assert (z, x) in stacks or h == np.float32(z * 0.25)


def test_scatter_options(spark):
    way = spark.createDataFrame([(s, i, float(8 + 12 * i), float(10 + 20 * s + 3 * (i % 2))) for s in range(2) for i in range(4)], "spline_id int, seq int, x double, z double")
    flat = grid.blank(spark, 64)
    height = lambda **more: np.array([r["h"] for r in render.scatter_along_spline(flat, way, 64, 64, base_altitude=50.0, ridge_sigma=2.0, **more).orderBy("z", "x").collect()])
    even, again = height(peak_count=5), height(peak_count=5)
    assert (even == again).all() and even.max() > 40
    others = [height(peak_count=5, shape="peak"), height(spacing=9.0), height(peak_count=5, mode="normal", sd=9.0), height(peak_count=5, turn=0.5, sigma_spread=0.3)]
    assert all((o != even).any() and o.max() > 20 for o in others)
