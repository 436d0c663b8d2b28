import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.functions import responses as R
from orogen.functions.maths import normal, smooth_max, uniform
from orogen.operators import accumulate, curves, dither, flood, grid, hydro, points, render, tiles, weather, world
from orogen.sources import config, png


def value(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def plane(spark, a):
    return spark.createDataFrame([(z, x, float(a[z][x])) for z in range(len(a)) for x in range(len(a[0]))], "z int, x int, h double")


def array_of(df, column, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["z"], r["x"]] = r[column]
    return out


def test_smooth_max_is_ordered_and_without_identity(spark):
    assert value(spark, smooth_max(F.lit(0.0), F.lit(0.0)))[0] == pytest.approx(1.7320508)
    cells = spark.createDataFrame([(0, 0, 0.0)], "z int, x int, h float")
    for order, want in (((10, 20, 15), 20.815606), ((20, 15, 10), 20.951252)):
        layers = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(order)], "z int, x int, inst_id int, layer double")
        assert render.composite(cells, layers).first()["h"] == pytest.approx(want, abs=1e-4)


def test_response_curves(spark):
    h = [R.treeline(F.lit(v)) for v in (180.0, 202.5, 225.0, 226.0)]
    assert value(spark, *h) == (1.0, 0.5, 0.0, 0.0)
    got = value(spark, *(R.foliage_slope(F.lit(v)) for v in (25.0, 32.0, 35.0)), *(R.rock(F.lit(v)) for v in (38.0, 40.0)))
    assert got == pytest.approx((0.942676, 0.5, 0.231475, 0.5, 0.731059), abs=1e-6)
    assert value(spark, R.snow(F.lit(240.0), F.lit(0.0)), R.snow(F.lit(240.0), F.lit(90.0))) == pytest.approx((1.0, 0.4))
    assert value(spark, R.above_water(F.lit(63.0)), R.above_water(F.lit(63.1))) == (0.0, 1.0)


def test_channel_classes(spark):
    df = spark.createDataFrame([(499.0,), (500.0,), (4999.0,), (5000.0,)], "area double")
    assert [r[0] for r in df.select(hydro.channel_class()).collect()] == ["torrent", "river", "river", "floodplain"]


def test_levels_layers_and_strata(spark):
    assert value(spark, world.remap(F.lit(0)), world.remap(F.lit(65535))) == (-64.0, 320.0)
    assert value(spark, world.quantise(F.lit(-64.0)), world.quantise(F.lit(320.0)), world.quantise(F.lit(999.0))) == (0, 65535, 65535)
    mask = spark.createDataFrame([(0, 0, 127), (0, 1, 128), (0, 2, 255)], "z int, x int, v int")
    got = world.apply_mask(mask.select("z", "x"), mask, "Frost").orderBy("x").collect()
    assert [r["Frost"] for r in got] == [0, 1, 1]
    terrain = [world.stratum(F.lit(v), config.EXAMPLE_STRATA) for v in (61.5, 62.0, 320.0, 321.0)]
    assert value(spark, *terrain) == ("Gravel / Sand", "Grass / Bare Dirt", "Deep Snow", None)
    assert value(spark, world.stratum(F.lit(100.0), config.EXAMPLE_STRATA, F.lit(50.0)))[0] is None
    with pytest.raises(ValueError):
        world.require_layers(["Lava"], ["Frost"])
    with pytest.raises(Exception, match="no such layer"):
        world.find_layer(spark.createDataFrame([("Lava",)], "layer string"), spark.createDataFrame([("Frost",)], "layer string")).collect()


def test_dither_edges(spark):
    t = spark.createDataFrame([(0, 0, 0.0)], "tz int, tx int, thr double")
    p = spark.createDataFrame([(0, 0, 0.0), (0, 1, float("nan")), (0, 2, None), (-1, -1, 0.5)], "z int, x int, p double")
    loose = {r["x"]: r["v"] for r in dither.mask(p, t, 1, 1).collect()}
    assert loose == {0: 255, 1: 0, 2: 0, -1: 255}
    strict = {r["x"]: r["v"] for r in dither.mask(p, t, 1, 1, strict_zero=True).collect()}
    assert strict == {0: 0, 1: 0, 2: 0, -1: 255}


def test_threshold_matrices():
    m = dither.highpass_matrix()
    assert m.shape == (64, 64) and m.min() == 0 and m.max() == 1 and (m == dither.highpass_matrix()).all()
    v = dither.void_and_cluster_matrix(16)
    assert sorted(np.rint(v * 256).astype(int).ravel()) == list(range(256))
    flat = dither.gaussian_blur(np.ones((9, 9)))
    assert flat == pytest.approx(np.ones((9, 9)))


def test_listing_weathering_by_hand():
    h = weather.listing_step(np.array([[0.0, 10.0]]), weather.critical_slope(38.0), 0.35)
    assert h[0] == pytest.approx([-3.2266, 13.2266], abs=1e-4)


@pytest.mark.parametrize("mode", ["listing", "physical"])
def test_weathering_conserves_mass_and_ignores_tiles(spark, mode):
    a = np.random.default_rng(1).uniform(0, 30, (21, 17))
    g = plane(spark, a)
    one, many = (array_of(weather.weather(g, mode, iterations=3, tile=t), "h", a.shape) for t in (64, 4))
    assert one == pytest.approx(many) and one.sum() == pytest.approx(a.sum())
    if mode == "physical":
        steep = lambda x: max(np.abs(np.diff(x, axis=0)).max(), np.abs(np.diff(x, axis=1)).max())
        assert steep(one) <= steep(a) + 1e-9


def test_long_weathering_in_blocks(spark):
    """200 iterations over tiles of 32 are those of one array, cell by cell."""
    a = np.random.default_rng(4).uniform(0, 60, (70, 50))
    want = a.copy()
    for _ in range(200):
        want = weather.physical_step(want, weather.critical_slope(38.0), 1.0)
    got = array_of(weather.weather(plane(spark, a), iterations=200, tile=32), "h", a.shape)
    assert (got == want).all() and not (want == a).all()


def water_levels(a):
    """Reference levels: relax until nothing changes."""
    w = np.full(a.shape, np.inf)
    w[0], w[-1], w[:, 0], w[:, -1] = a[0], a[-1], a[:, 0], a[:, -1]
    while True:
        n = w.copy()
        n[1:-1, 1:-1] = np.maximum(a[1:-1, 1:-1], np.minimum.reduce([w[:-2, 1:-1], w[2:, 1:-1], w[1:-1, :-2], w[1:-1, 2:], w[1:-1, 1:-1]]))
        if (n == w).all():
            return w
        w = n


def test_hydrology_across_tiles(spark):
    a = np.random.default_rng(2).uniform(0, 9, (20, 23))
    filled = flood.fill(plane(spark, a), tile=6)
    assert array_of(filled, "w", a.shape) == pytest.approx(water_levels(a))
    directed = hydro.flow(filled)
    assert hydro.climbs(directed).first()["climbs"] == 0
    area = array_of(accumulate.drainage(directed, tile=6), "area", a.shape)
    want = np.ones(a.shape)
    cells = sorted(directed.collect(), key=lambda r: (-r["w"], -r["z"], -r["x"]))
    for r in cells:
        for k, p in ((r["k1"], r["p1"]), (r["k2"], r["p2"])):
            if k >= 0:
                want[r["z"] + hydro.DIRECTIONS[k][0], r["x"] + hydro.DIRECTIONS[k][1]] += p * want[r["z"], r["x"]]
    assert area == pytest.approx(want)
    carved = array_of(hydro.breach(directed), "h", a.shape)
    assert (carved <= a + 1e-12).all()
    for r in cells:
        k = r["k1"] if r["p1"] >= r["p2"] else r["k2"]
        if k >= 0:
            assert carved[r["z"] + hydro.DIRECTIONS[k][0], r["x"] + hydro.DIRECTIONS[k][1]] <= carved[r["z"], r["x"]]


def test_spline_interpolates(spark):
    way = [(0.0, 1.0), (2.0, -1.0), (3.0, 4.0), (7.0, 2.0), (8.0, 0.0)]
    t = np.linspace(0, 1, 5)
    cubic = curves.cubic(t, np.array([3 * s**3 - s + 2 for s in t]))
    assert cubic[:, 3] == pytest.approx([3] * 4)  # a cubic is reproduced
    table = curves.segments(spark, {0: way})
    got = curves.evaluate(curves.parameters(table, 5), table).orderBy("inst_id").collect()
    assert [(r["cx"], r["cz"]) for r in got] == [pytest.approx(w) for w in way]
    assert all(r["tx"] * r["nx"] + r["tz"] * r["nz"] == pytest.approx(0) for r in got)
    for n in (1, 2, 3):
        assert len(curves.cubic(np.linspace(0, 1, n), np.arange(n) * 2.0)) == max(1, n - 1)


def test_off_grid_boxes_are_empty(spark):
    inst = spark.createDataFrame([(0, -500.0, 5.0, 0.0, 9.0, 4.0, 1.0), (1, 5.0, 900.0, 0.0, 9.0, 4.0, 1.0)], "inst_id int, cx double, cz double, angle double, height double, length double, sigma double")
    assert render.covered(grid.blank(spark, 8), render.boxes(inst, 8, 8)).count() == 0


def test_points_are_apart_and_maximal(spark):
    cells = spark.createDataFrame([(z, x, 0.3 if x < 6 else 1.0) for z in range(14) for x in range(14)], "z int, x int, p double")
    cand = points.candidates(cells, 1.2)
    taken = {r["id"]: r for r in points.poisson_disk(cand).collect()}
    far = lambda a, b: math.hypot(a["px"] - b["px"], a["pz"] - b["pz"]) >= max(a["r"], b["r"])
    assert all(far(a, b) for a in taken.values() for b in taken.values() if a["id"] != b["id"])
    assert all(c["id"] in taken or any(not far(c, t) for t in taken.values()) for c in cand.collect())


def test_png(spark, tmp_path):
    rng = np.random.default_rng(3)
    for a in (rng.integers(0, 65536, (9, 7)).astype(np.uint16), rng.integers(0, 256, (5, 6)).astype(np.uint8), rng.integers(0, 256, (4, 3, 3)).astype(np.uint8)):
        assert (png.decode(png.encode(a)).squeeze() == a).all()
    raw = rng.integers(0, 256, (2, 12)).astype(np.uint8)
    for method in range(5):  # each filter inverts what the standard's definition applies
        line, up, out = raw[1].astype(int), raw[0].astype(int), []
        for i, v in enumerate(line):
            left, above, corner = (line[i - 3] if i > 2 else 0), up[i], (up[i - 3] if i > 2 else 0)
            paeth = min(((abs(above - corner), 0, left), (abs(left - corner), 1, above), (abs(left + above - 2 * corner), 2, corner)))[2]
            out.append((v - [0, left, above, (left + above) // 2, paeth][method]) % 256)
        assert (png._unfiltered(method, np.array(out, np.uint8), raw[0], 3) == raw[1]).all()
    cells = spark.createDataFrame([(z, x, (z * 31 + x) % 65536) for z in range(10) for x in range(13)], "z int, x int, v int")
    png.write_tiles(png.encoded(cells, tile=4), str(tmp_path / "t"))
    back = png.read_grey(spark, str(tmp_path / "t" / "*.png"), tile=4)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    (tmp_path / "c.png").write_bytes(png.encode(np.arange(24, dtype=np.uint8).reshape(2, 4, 3)))
    assert tuple(png.read_colour(spark, str(tmp_path / "c.png")).filter("z = 1 and x = 0").first()) == (1, 0, 12, 13, 14)
    with pytest.raises(ValueError):
        png.decode(b"nothing")


def test_declarations(spark, tmp_path):
    import yaml

    from orogen.plans.queries import CONFIG

    for name, text in (("c.yaml", yaml.safe_dump(CONFIG)), ("c.json", json.dumps(CONFIG))):
        (tmp_path / name).write_text(text)
        assert config.load(spark, str(tmp_path / name)) == CONFIG
    assert config.violations(spark, CONFIG).count() == 0
    assert config.strata_rows(spark, CONFIG).count() == 5 and config.world_row(spark, CONFIG).first()["sea_level"] == 62
    assert config.input_rows(spark, CONFIG).count() == 3
    bad = {"world": CONFIG["world"] | {"sea_level": 999}, "inputs": {}, "strata": [{"range": [9, 1], "terrain": "a"}]}
    assert {r["rule"] for r in config.violations(spark, bad).collect()} == {"sea_level", "missing", "reversed"}
    lines = config.compile_script(CONFIG)
    assert lines == config.compile_script(json.loads(json.dumps(CONFIG))) and "toLevels(-64, 320)" in lines[3]
    config.write_script(config.script_lines(spark, CONFIG), str(tmp_path / "s"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "s")).collect()] == lines


def test_counter_based_draws(spark):
    df = spark.range(4000).select(uniform(1, "a", F.col("id")).alias("u"), normal(1, "b", F.col("id")).alias("n"))
    u, n, s = df.agg(F.avg("u"), F.avg("n"), F.stddev("n")).first()
    assert abs(u - 0.5) < 0.02 and abs(n) < 0.05 and abs(s - 1) < 0.05


def test_scale_and_tiles(spark):
    v = spark.createDataFrame([(z, x, z * 4 + x) for z in range(4) for x in range(4)], "z int, x int, v int")
    assert world.rescale(v, 100) is v and world.rescale(v, 200).count() == 64 and world.rescale(v, 50).count() == 4
    with pytest.raises(ValueError):
        world.rescale(v, 30)
    assert tiles.dealt(v, 2, 1).count() > 16


def test_stream_of_cells(spark, tmp_path):
    from orogen.streaming import cells

    field = spark.createDataFrame([(z, x, 100.0, 20.0) for z in range(6) for x in range(6)], "z int, x int, h double, slope_deg double")
    field.write.parquet(str(tmp_path / "in"))
    t = dither.as_table(spark, np.full((2, 2), 0.5))
    cells.run(spark, str(tmp_path / "in"), "z int, x int, h double, slope_deg double", t, str(tmp_path / "out"), str(tmp_path / "ck"), 2).awaitTermination(60)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("z", "x", "feature", "v").collect()))
    assert got == sorted(map(tuple, cells.masks(field, t, 2).select("z", "x", "feature", "v").collect()))


def test_command_line(spark, tmp_path):
    from orogen.__main__ import main
    from orogen.plans.queries import CONFIG

    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    heights = (np.arange(48).reshape(6, 8) * 1300).astype(np.uint16)
    (tmp_path / "h.png").write_bytes(png.encode(heights))
    (tmp_path / "m.png").write_bytes(png.encode((heights % 256).astype(np.uint8)))
    main([str(tmp_path / "c.json"), str(tmp_path / "h.png"), str(tmp_path / "out"), "--mask", f"Frost={tmp_path / 'm.png'}"])
    columns = spark.read.parquet(str(tmp_path / "out/columns"))
    assert columns.count() == 48 and columns.filter("array_contains(layers, 'Frost')").count() == int(((heights % 256) >= 128).sum())
    assert spark.read.text(str(tmp_path / "out/script")).count() > 5
