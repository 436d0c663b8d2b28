"""Filling, accumulation, breaching and channel distances over several tiles, against brute force."""

import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orogen.operators import accumulate, breaching, channels, flood, hydro, rounds, routing


def plane(spark, a, name="h"):
    rows = [(z, x, None if np.isnan(v) else float(v)) for (z, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"z int, x int, {name} double").repartition(3)


def array_of(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("z", "x", name).collect():
        out[r["z"], r["x"]] = r[name]
    return out


def heights(kind, shape, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "steps":  # many ties and flats
        return rng.integers(0, 6, shape).astype(float)
    return rng.random(shape) if kind == "rough" else np.cumsum(np.cumsum(rng.normal(size=shape), 0), 1)


def on_border(z, x, shape):
    return z in (0, shape[0] - 1) or x in (0, shape[1] - 1)


def water_levels(h, eight):
    level = np.full(h.shape, np.inf)
    queue = [(h[c], *c) for c in np.ndindex(h.shape) if on_border(*c, h.shape) and not np.isnan(h[c])]
    for v, *c in queue:
        level[tuple(c)] = v
    heapq.heapify(queue)
    while queue:
        top, z, x = heapq.heappop(queue)
        for dz, dx in rounds.directions(eight):
            c = z + dz, x + dx
            if 0 <= c[0] < h.shape[0] and 0 <= c[1] < h.shape[1] and not np.isnan(h[c]) and max(top, h[c]) < level[c]:
                level[c] = max(top, h[c])
                heapq.heappush(queue, (level[c], *c))
    return level


CASES = [("rough", (40, 37), 7, False, 10**6), ("rough", (40, 37), 7, True, 5), ("steps", (30, 30), 5, False, 3), ("smooth", (33, 41), 8, False, 40)]


@pytest.mark.parametrize(("kind", "shape", "tile", "eight", "small"), CASES)
def test_filling_and_drainage_over_tiles(spark, kind, shape, tile, eight, small):
    """Graphs between tiles are solved at once or, with a small bound, in rounds."""
    h = heights(kind, shape)
    filled = flood.fill(plane(spark, h), tile, eight, small).cache()
    assert (array_of(filled, "w", shape) == water_levels(h, eight)).all() and (array_of(filled, "h", shape) == h).all()
    directed = hydro.flow(filled, 1.0, tile).cache()
    want = np.ones(shape)
    for r in sorted(directed.collect(), key=lambda r: (-r["w"], -r["z"], -r["x"])):
        for k, p in ((r["k1"], r["p1"]), (r["k2"], r["p2"])):
            if k >= 0:
                want[r["z"] + rounds.DIRECTIONS[k][0], r["x"] + rounds.DIRECTIONS[k][1]] += p * want[r["z"], r["x"]]
    assert array_of(accumulate.drainage(directed, tile, small), "area", shape) == pytest.approx(want, rel=1e-12)


def test_filling_with_walls(spark):
    """Null heights are walls; what they enclose has no way out."""
    h = heights("rough", (14, 15))
    h[4:9, 4] = h[4:9, 8] = h[4, 4:9] = h[8, 4:9] = np.nan  # a ring around (5..7, 5..7)
    h[11, 3] = np.nan
    got = array_of(flood.fill(plane(spark, h), 4), "w", h.shape)
    want = water_levels(h, False)
    assert np.isinf(want[6, 6]) and (got == want).all()


def test_far_cells(spark):
    """Rows and columns may be negative and far apart."""
    h = heights("rough", (12, 13))
    df = plane(spark, h).selectExpr("z - 70007 AS z", "x + 900001 AS x", "h")
    got = flood.fill(df, 5).selectExpr("z + 70007 AS z", "x - 900001 AS x", "h", "w")
    assert (array_of(got, "w", h.shape) == water_levels(h, False)).all()
    area = accumulate.drainage(hydro.flow(got.selectExpr("z - 70007 AS z", "x + 900001 AS x", "h", "w"), 1.0, 5), 5)
    here = accumulate.drainage(hydro.flow(got, 1.0, 4), 4)
    assert array_of(area.selectExpr("z + 70007 AS z", "x - 900001 AS x", "area"), "area", h.shape) == pytest.approx(array_of(here, "area", h.shape))


def test_empty_grids(spark):
    none = spark.createDataFrame([], "z int, x int, h double")
    assert flood.fill(none).collect() == []
    assert [df.collect() for df in breaching.breach(none)] == [[], []]
    assert channels.nearest_channel(none.withColumnRenamed("h", "area"), 1).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 9), st.integers(2, 9), st.integers(0, 10**6), st.booleans())
def test_basins_of_a_tile(rows, columns, seed, eight):
    """Levels from the tile's own edge, and passes by which the basins' way to any one cell can be found."""
    h = np.random.default_rng(seed).integers(0, 9, (rows, columns)).astype(float)
    level, basin, passes = flood.basins(h, eight)
    assert (level == water_levels(h, eight)).all() and (basin >= 0).all()
    flat = h.ravel()
    exit_at = int(basin.ravel()[0])
    ways = flood.lowest_ways([(flood.OCEAN, exit_at, flat[0]), *((a, b, v) for (a, b), v in passes.items())])
    best = {(0, 0): flat[0]}  # by brute force: the lowest way to the first cell
    queue = [(flat[0], 0, 0)]
    while queue:
        top, z, x = heapq.heappop(queue)
        for dz, dx in rounds.directions(eight):
            c = z + dz, x + dx
            if 0 <= c[0] < rows and 0 <= c[1] < columns and max(top, h[c]) < best.get(c, np.inf):
                best[c] = max(top, h[c])
                heapq.heappush(queue, (best[c], *c))
    for c in np.ndindex(h.shape):
        assert max(level[c], ways[int(basin[c])]) == best[c]


def cheapest_way(h, pit, eight):
    mark, queue, done = (h[pit], *pit), [(0.0, *pit)], set()
    while queue:
        cost, z, x = heapq.heappop(queue)
        if (z, x) in done:
            continue
        done.add((z, x))
        if (h[z, x], z, x) < mark or (on_border(z, x, h.shape) and (z, x) != pit):
            return cost
        for dz, dx in rounds.directions(eight):
            a, b = z + dz, x + dx
            if 0 <= a < h.shape[0] and 0 <= b < h.shape[1] and (a, b) not in done:
                heapq.heappush(queue, (cost + max(0.0, h[a, b] - h[pit]), a, b))
    return None


@pytest.mark.parametrize(("kind", "shape", "tile", "eight"), [("rough", (24, 23), 6, False), ("steps", (20, 26), 4, True), ("smooth", (30, 30), 9, False)])
def test_least_cost_breaching(spark, kind, shape, tile, eight):
    h = heights(kind, shape)
    surface, ways = breaching.breach(plane(spark, h), tile, eight)
    surface, ways = surface.cache(), {(r["z"], r["x"]): r["cost"] for r in ways.collect()}
    order = {c: (h[c], *c) for c in np.ndindex(shape)}
    near = lambda c: [n for dz, dx in rounds.directions(eight) if (n := (c[0] + dz, c[1] + dx)) in order]
    assert set(ways) == {c for c in order if not on_border(*c, shape) and not any(order[n] < order[c] for n in near(c))}
    for pit, cost in ways.items():
        assert cost == pytest.approx(cheapest_way(h, pit, eight))
    new = array_of(surface, "h", shape)
    assert (new <= h).all() and array_of(surface, "cut", shape) == pytest.approx(h - new)
    assert (h - new).sum() <= sum(ways.values()) + 1e-9  # ways that meet are cut once
    assert (water_levels(new, eight) == new).all()  # nothing is left to fill


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 900)), min_size=1, max_size=12, unique_by=lambda t: t[0]))
def test_lower_envelope(parabolas):
    z, lift = np.array(sorted(parabolas)).T
    at = np.arange(-3, 65)
    got = channels.envelope(z, lift, at)
    want = [min(range(len(z)), key=lambda k: ((a - z[k]) ** 2 + lift[k], z[k])) for a in at]
    assert got.tolist() == want


@pytest.mark.parametrize("block", [50, 1 << 18])
def test_nearest_channels(spark, monkeypatch, block):
    monkeypatch.setattr(channels, "BLOCK_CELLS", block)
    rng = np.random.default_rng(1)
    area = np.where(rng.random((37, 41)) < 0.03, rng.integers(100, 9000, (37, 41)), 3).astype(float)
    rows = channels.carve(channels.nearest_channel(plane(spark, area, "area"), 100)).collect()
    cells = list(zip(*np.nonzero(area >= 100), strict=True))
    assert len(rows) == area.size
    for r in rows:
        d, z, x = min(((r["z"] - z) ** 2 + (r["x"] - x) ** 2, z, x) for z, x in cells)
        assert (r["channel_z"], r["channel_x"], r["channel_area"]) == (z, x, area[z, x]) and r["distance"] == pytest.approx(d**0.5)
        inside = r["distance"] <= r["half_width"]
        assert (r["cut"] < 0) == inside or r["channel_class"] == "floodplain" or r["distance"] == r["half_width"]
    none = channels.carve(channels.nearest_channel(plane(spark, area, "area"), 1e9)).collect()
    assert len(none) == area.size and all(r["distance"] is None and r["cut"] == 0 for r in none)


def test_rivers_are_cut_into_the_surface(spark):
    h = heights("smooth", (32, 32), 3)
    rows = routing.routed(plane(spark, h), tile=8, least_area=30).collect()
    assert len(rows) == h.size
    channel = [r for r in rows if r["area"] >= 30]
    assert channel and all(r["distance"] == 0 and r["bed"] < r["w"] + r["dh"] for r in channel)
    assert all(r["bed"] == pytest.approx(r["w"] + r["dh"] + r["cut"]) for r in rows)
