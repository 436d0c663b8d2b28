"""The registered terrain queries, each with its DuckDB oracle where SQL can express it.

Transcendental results are rounded to nine digits on both sides, as the engines differ
in the last bits; heights that fold in single precision are compared as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import responses
from ..functions.maths import lattice_noise, normal, smooth_max, uniform
from ..operators import accumulate, breaching, channels, curves, dither, flood, hydro, points, render, rounds, routing, weather, world
from ..operators import grid as grids
from ..sources import config, png, tile_source
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CRIT = math.tan(math.radians(38.0))
CONFIG = {
    "world": {"name": "Example", "width": 10000, "height": 10000, "min_y": -64, "max_y": 320, "sea_level": 62},
    "inputs": {"heightmap": "in/height.png", "populate_mask": "in/populate.png", "frost_mask": "in/frost.png"},
    "strata": [{"range": [s["lo"], s["hi"]], "terrain": s["terrain"]} | ({"slope_limit": [0, 35]} if s["seq"] == 1 else {}) for s in config.EXAMPLE_STRATA],
}
PALETTE = [{"block": b, "r": r, "g": g, "b": v} for b, r, g, v in (("stone", 125, 125, 125), ("grass", 127, 178, 56), ("sand", 247, 233, 163), ("water", 64, 64, 255), ("snow", 255, 255, 255), ("wood", 143, 119, 72), ("clay", 164, 168, 184), ("dirt", 151, 109, 77))]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.derived(fx.grid(spark, sf_dir), fx.SPACING)


def _steep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field with spacing 8, so that slopes pass the critical angle."""
    return grids.derived(fx.grid(spark, sf_dir), 8.0)


STEEP = fx.GRADIENT.replace(f"{fx.SPACING}.0", "8.0").replace(f"{2 * fx.SPACING}.0", "16.0")

# Grids and derived fields ---------------------------------------------------------------------------


@query(
    f"""WITH {fx.GRID}, {fx.GRADIENT},
r AS (SELECT CASE WHEN floor(h) <= 61 THEN 'Gravel / Sand' WHEN floor(h) <= 130 THEN 'Grass / Bare Dirt' WHEN floor(h) <= 190 THEN 'Podzol / Coarse'
                  WHEN floor(h) <= 250 THEN 'Stone / Cobblestone' ELSE 'Deep Snow' END AS terrain,
             h, round(slope_deg, 9) AS slope, round(1 / (1 + exp(-0.5 * (slope_deg - 38))), 9) AS p_rock FROM f)
SELECT terrain, count(*) AS cells, max(h) AS h_max, min(slope) AS slope_min, max(slope) AS slope_max, round(avg(p_rock), 6) AS rock_mean FROM r GROUP BY terrain"""
)
def terrain_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, heights, slopes and rock share by stratum."""
    strata = [s | {"slope_lo": None, "slope_hi": None} for s in config.EXAMPLE_STRATA]
    rows = _field(spark, sf_dir).select(world.stratum(F.col("h"), strata).alias("terrain"), "h", F.round("slope_deg", 9).alias("slope"), F.round(responses.rock(F.col("slope_deg")), 9).alias("p"))
    return rows.groupBy("terrain").agg(F.count("*").alias("cells"), F.max("h").alias("h_max"), F.min("slope").alias("slope_min"), F.max("slope").alias("slope_max"), F.round(F.avg("p"), 6).alias("rock_mean"))


@query(f"WITH {fx.GRID} SELECT z, x, h FROM g")
def grid_from_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.grid(spark, sf_dir)


@query(f"WITH {fx.GRID} SELECT CAST(count(*) AS BIGINT) AS cells, count(DISTINCT (z, x)) AS keys, CAST(max(x) - min(x) + 1 AS BIGINT) AS width, CAST(max(z) - min(z) + 1 AS BIGINT) AS height, true AS dense FROM g")
def grid_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.density(fx.grid(spark, sf_dir))


@query(f"WITH {fx.GRID} SELECT CAST(i // n AS INT) AS z, CAST(i % n AS INT) AS x, CAST(0 AS FLOAT) AS h FROM (SELECT n, unnest(range(n * n)) AS i FROM p)")
def grid_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank grid of the side that the facts ask for."""
    return grids.blank(spark, fx.side(spark, sf_dir))


@query(f"WITH {fx.GRID} SELECT z, x, h, lead(h) OVER (PARTITION BY z ORDER BY x) - h AS dx_pos, lead(h) OVER (PARTITION BY x ORDER BY z) - h AS dz_pos FROM g")
def forward_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.forward_difference(fx.grid(spark, sf_dir))


@query(
    f"""WITH {fx.GRID}, {fx.GRADIENT} SELECT z, x, gx, gz, round(slope_deg, 9) AS slope_deg, round(atan2(-gx, gz), 9) AS aspect_rad,
round(CASE WHEN gx <> 0 OR gz <> 0 THEN -gx / sqrt(gx * gx + gz * gz) END, 9) AS down_x, round(CASE WHEN gx <> 0 OR gz <> 0 THEN -gz / sqrt(gx * gx + gz * gz) END, 9) AS down_z,
greatest(-1.0, least(1.0, (coalesce(w, h) + coalesce(e, h) + coalesce(nn, h) + coalesce(ss, h) - 4.0 * h) / {fx.SPACING}.0)) AS curvature FROM f"""
)
def derived_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient, slope, aspect, downhill direction and curvature."""
    nine = [F.round(c, 9).alias(c) for c in ("slope_deg", "aspect_rad", "down_x", "down_z")]
    return _field(spark, sf_dir).select("z", "x", "gx", "gz", *nine, "curvature")


@query(
    f"""WITH {fx.GRID}, {STEEP},
c AS (SELECT z, x, h, CASE WHEN slope_deg > 75.0 THEN x END AS cx FROM f),
r AS (SELECT z, x, h, least(x - max(cx) OVER (PARTITION BY z ORDER BY x), min(cx) OVER (PARTITION BY z ORDER BY x DESC) - x) AS rd FROM c),
q AS (SELECT z, x, h, least(z + min(rd - z) OVER (PARTITION BY x ORDER BY z), min(rd + z) OVER (PARTITION BY x ORDER BY z DESC) - z) AS d FROM r)
SELECT z, x, d, round(h + d * {math.tan(math.radians(75.0))} - 0.01 * d * d, 9) AS talus FROM q"""
)
def talus_apron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City-block distance to the nearest cliff and the scree profile over it."""
    out = grids.cliff_distance(_steep(spark, sf_dir), 75.0)
    return out.select("z", "x", "d", F.round(grids.talus_apron(F.col("h"), F.col("d"), 75.0), 9).alias("talus"))


@query(f"WITH {fx.GRID}, a AS (SELECT z, x, h + 66 AS area FROM g) SELECT z, x, round(least(1.0, greatest(0.0, ln(greatest(area, 1.0)) / ln((SELECT max(area) FROM a)))), 9) AS moisture FROM a")
def moisture_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grids.moisture(fx.grid(spark, sf_dir).withColumn("area", F.col("h") + 66))
    return out.select("z", "x", F.round("moisture", 9).alias("moisture"))


# Curves and stations --------------------------------------------------------------------------------


@query("SELECT 0 AS spline_id, CAST(r_regionkey AS INT) AS seq, CAST(r_regionkey * 15 + 2 AS DOUBLE) AS x, CAST((r_regionkey * 37) % 64 AS DOUBLE) AS z, (row_number() OVER (ORDER BY r_regionkey) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE) AS t FROM region")
def spline_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.knots(fx.waypoints(spark, sf_dir))


@query()
def spline_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty stations on each nation's spline through its customers, with tangent and normal."""
    table = curves.fit(fx.routes(spark, sf_dir))
    return curves.evaluate(curves.parameters(table, 40), table)


@query()
def spline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of the splines through the regions and through each nation's customers."""
    regions = fx.waypoints(spark, sf_dir).withColumn("spline_id", F.lit(-1))
    return curves.fit(regions.unionByName(fx.routes(spark, sf_dir)))


_CURVE = """, round(atan2(vz, vx), 9) AS angle, round(vx / sqrt(vx * vx + vz * vz), 9) AS tx, round(vz / sqrt(vx * vx + vz * vz), 9) AS tz FROM c"""


def _rounded(stations: DataFrame) -> DataFrame:
    return stations.select("spline_id", "inst_id", *(F.round(c, 9).alias(c) for c in ("cx", "cz", "vx", "vz", "angle", "tx", "tz")))


def _curve_sql(n: int, value: str, speed: str) -> str:
    fill = lambda form: ", ".join(f"{form.replace('#', a)} AS {v}{a}" for v, a in (("c", "x"), ("c", "z")))
    at, by = fill(value), fill(speed).replace(" AS c", " AS v")
    return f"""WITH {fx.CONTROLS}, s AS (SELECT CAST(i AS INT) AS inst_id, i / {n - 1}.0 AS t FROM range({n}) r(i)), c AS (SELECT spline_id, inst_id, {at}, {by} FROM b, s)
SELECT spline_id, inst_id, round(cx, 6) + 0.0 AS cx, round(cz, 6) + 0.0 AS cz, round(vx, 6) + 0.0 AS vx, round(vz, 6) + 0.0 AS vz FROM c"""


def _rounded(stations: DataFrame) -> DataFrame:
    return stations.select("spline_id", "inst_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("cx", "cz", "vx", "vz")))


@query(_curve_sql(5, "pow(1-t,3)*p# + 3*pow(1-t,2)*t*q# + 3*(1-t)*t*t*r# + pow(t,3)*s#", "3*(1-t)*(1-t)*(q#-p#) + 6*(1-t)*t*(r#-q#) + 3*t*t*(s#-r#)"))
def bezier_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stations on a Bezier curve a customer."""
    table = curves.bezier(fx.controls(spark, sf_dir))
    return _rounded(curves.evaluate(curves.parameters(table, 5), table))


@query(_curve_sql(5, "(2*t*t*t-3*t*t+1)*p# + (t*t*t-2*t*t+t)*q# + (3*t*t-2*t*t*t)*r# + (t*t*t-t*t)*s#", "(6*t*t-6*t)*p# + (3*t*t-4*t+1)*q# + (6*t-6*t*t)*r# + (3*t*t-2*t)*s#"))
def hermite_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stations on a Hermite curve a customer: start, its tangent, end, its tangent."""
    names = {f"{old}{a}": f"{new}{a}" for old, new in zip("qrs", "mqn", strict=True) for a in "xz"}
    renamed = fx.controls(spark, sf_dir).select("spline_id", "px", "pz", *(F.col(o).alias(n) for o, n in names.items()))
    table = curves.hermite(renamed)
    return _rounded(curves.evaluate(curves.parameters(table, 5), table))


@query(
    f"""WITH {fx.CONTROLS}, c AS (SELECT *, sqrt((sx - px) * (sx - px) + (sz - pz) * (sz - pz)) AS arc FROM b)
SELECT DISTINCT spline_id, inst_id, round(px + (sx - px) * CASE WHEN arc > 0 THEN inst_id * 4.0 / arc ELSE 0.0 END, 6) + 0.0 AS cx, round(pz + (sz - pz) * CASE WHEN arc > 0 THEN inst_id * 4.0 / arc ELSE 0.0 END, 6) + 0.0 AS cz
FROM (SELECT *, unnest(range(0, CAST(floor(arc / 4.0) AS INT) + 1))::INT AS inst_id FROM c)"""
)
def straight_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations four blocks apart on a straight Hermite curve of uneven speed a customer."""
    b = fx.controls(spark, sf_dir)
    line = b.select("spline_id", "px", "pz", *(F.lit(0.0).alias(f"m{a}") for a in "xz"), F.col("sx").alias("qx"), F.col("sz").alias("qz"), *(F.lit(0.0).alias(f"n{a}") for a in "xz"))
    table = curves.hermite(line)
    at = curves.evaluate(curves.spaced_stations(table, 4.0, jitter=0.0), table)
    return at.select("spline_id", "inst_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("cx", "cz")))


@query()
def spaced_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations at least four blocks of arc apart, with jittered gaps, on a Bezier curve a customer."""
    return curves.spaced_stations(curves.bezier(fx.controls(spark, sf_dir)), 4.0)


def _md5(attribute: str, keys: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', '42', '{attribute}', {keys})), 1, 8)) AS BIGINT)"


@query(
    f"""SELECT s_suppkey AS spline_id, round(180.0 + 120.0 * ({_md5('height', 's_suppkey, 1')} / 4294967296.0), 9) AS height,
round(120.0 + 140.0 * ({_md5('length', 's_suppkey, 1')} / 4294967296.0), 9) AS length, round(18.0 * (0.5 + ({_md5('sigma', 's_suppkey, 1')} / 4294967296.0)), 9) AS sigma,
round(-0.2 + 0.4 * ({_md5('turn', 's_suppkey, 1')} / 4294967296.0), 9) AS angle,
round(240.0 + 30.0 * sqrt(-2.0 * ln(({_md5('height/1', 's_suppkey, 1')} + 1) / 4294967297.0)) * cos({2 * math.pi} * ({_md5('height/2', 's_suppkey, 1')} / 4294967296.0)), 6) AS normal_height FROM supplier"""
)
def station_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter-based draws of height, length, width and turn; normal heights besides."""
    base = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spline_id"), F.lit(1).alias("inst_id"), F.lit(0.0).alias("angle"))
    out = curves.jittered(base, turn=0.2, sigma_spread=0.5).withColumn("normal_height", F.round(normal(42, "height", F.col("spline_id"), F.col("inst_id"), mean=240.0, sd=30.0), 6))
    return out.select("spline_id", *(F.round(c, 9).alias(c) for c in ("height", "length", "sigma", "angle")), "normal_height")


# Primitives and compositing -------------------------------------------------------------------------

_BOX = """b AS (SELECT *, trunc(greatest({r}, 4.0 * {s})) AS rad FROM {t}),
k AS (SELECT *, greatest(0, trunc(cx - rad)) AS x0, least(64, trunc(cx + rad)) AS x1, greatest(0, trunc(cz - rad)) AS z0, least(64, trunc(cz + rad)) AS z1 FROM b),
c AS (SELECT CAST(i // 64 AS INT) AS z, CAST(i % 64 AS INT) AS x FROM range(4096) r(i)),
m AS (SELECT c.z, c.x, k.* EXCLUDE (x0, x1, z0, z1), c.x - cx AS dx, c.z - cz AS dz FROM c JOIN k ON c.x >= x0 AND c.x < x1 AND c.z >= z0 AND c.z < z1)"""
_FOLD = """SELECT c.z, c.x, CAST(coalesce(list_reduce(list_prepend(CAST(0 AS DOUBLE), f.hs), lambda a, h: CAST(CAST(0.5 * (a + h + sqrt((a - h) * (a - h) + 12.0)) AS FLOAT) AS DOUBLE)), 0.0) AS FLOAT) AS h
FROM c LEFT JOIN f USING (z, x)"""


@query(
    f"""WITH {fx.INSTANCES}, {_BOX.format(r='length', s='sigma', t='i')},
l AS (SELECT z, x, inst_id, height * greatest(0.0, least(1.0, 1.0 - ((dx * cos(angle) + dz * sin(angle)) / (length / 2.0)) * ((dx * cos(angle) + dz * sin(angle)) / (length / 2.0)))) * exp(-abs(dz * cos(angle) - dx * sin(angle)) / sigma) AS layer FROM m)
SELECT z, x, inst_id, round(layer, 9) AS layer FROM l"""
)
def ridge_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ridge's height in each cell of its box."""
    boxed = render.boxes(fx.instances(spark, sf_dir), 64, 64)
    return render.covered(grids.blank(spark, 64).select("z", "x"), boxed).select("z", "x", "inst_id", F.round(render.ridge_height(), 9).alias("layer"))


@query(
    f"""WITH {fx.INSTANCES}, {_BOX.format(r='length', s='sigma', t='i')},
l AS (SELECT z, x, inst_id, height * greatest(0.0, least(1.0, 1.0 - ((dx * cos(angle) + dz * sin(angle)) / (length / 2.0)) * ((dx * cos(angle) + dz * sin(angle)) / (length / 2.0)))) * exp(-abs(dz * cos(angle) - dx * sin(angle)) / sigma) AS layer FROM m),
f AS (SELECT z, x, list(layer ORDER BY inst_id) AS hs FROM (SELECT z, x, inst_id, layer FROM l) GROUP BY z, x) {_FOLD}"""
)
def ridge_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridges folded into a blank grid by the ordered smooth maximum."""
    return render.render_ridges(grids.blank(spark, 64), fx.instances(spark, sf_dir), 64, 64)


@query(
    f"""WITH {fx.INSTANCES}, pk AS (SELECT inst_id, cx, cz, height AS h_peak, length AS radius, 1.8 AS gamma, 0.2 AS alpha, 3 + inst_id % 2 AS k FROM i),
{_BOX.format(r='radius', s='0.0', t='pk')},
l AS (SELECT z, x, inst_id, h_peak * pow(greatest(0.0, 1.0 - sqrt(dx * dx + dz * dz) / radius), gamma) * (1.0 + alpha * cos(k * atan2(dz, dx))) AS layer FROM m),
f AS (SELECT z, x, list(layer ORDER BY inst_id) AS hs FROM l GROUP BY z, x) SELECT z, x, h FROM ({_FOLD})"""
)
def peak_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pyramidal peaks folded into a blank grid."""
    return render.render_peaks(grids.blank(spark, 64), fx.peaks(spark, sf_dir), 64, 64)


@query(
    f"""WITH {fx.GRID}, c AS (SELECT * FROM (VALUES (1, 8.0, 9.0, 6.0, 40.0), (2, 11.0, 10.0, 5.0, 25.0)) v(inst_id, cx, cz, radius, depth)),
s AS (SELECT z, x, sum(depth * pow(greatest(0.0, 1.0 - ((x - cx) * (x - cx) + (z - cz) * (z - cz)) / (radius * radius)), 2)) AS fall FROM g, c
      WHERE x >= cx - radius AND x < cx + radius AND z >= cz - radius AND z < cz + radius GROUP BY z, x)
SELECT z, x, round(h - coalesce(fall, 0), 6) AS h FROM g LEFT JOIN s USING (z, x)"""
)
def caldera_subsidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    calderas = spark.createDataFrame([(1, 8.0, 9.0, 6.0, 40.0), (2, 11.0, 10.0, 5.0, 25.0)], "inst_id int, cx double, cz double, radius double, depth double")
    out = render.subside(fx.grid(spark, sf_dir), calderas, 10_000, 10_000)
    return out.select("z", "x", F.round("h", 6).alias("h"))


@query("SELECT s_suppkey, round(0.5 * (s_acctbal + 100.0 + sqrt((s_acctbal - 100.0) * (s_acctbal - 100.0) + 12.0)), 9) AS smax FROM supplier")
def smooth_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "supplier").select("s_suppkey", F.round(smooth_max(F.col("s_acctbal"), F.lit(100.0)), 9).alias("smax"))


def _corner(a: int, b: int) -> str:
    return f"(-1.0 + 2.0 * ({_md5('noise', f'CAST(i + {a} AS BIGINT), CAST(j + {b} AS BIGINT)')} / 4294967296.0))"


@query(
    f"""WITH {fx.GRID}, q AS (SELECT z, x, floor(x / 5.0) AS i, floor(z / 5.0) AS j, x / 5.0 - floor(x / 5.0) AS s, z / 5.0 - floor(z / 5.0) AS t FROM g)
SELECT z, x, round(({_corner(0, 0)} * (1.0 - s) + {_corner(1, 0)} * s) * (1.0 - t) + ({_corner(0, 1)} * (1.0 - s) + {_corner(1, 1)} * s) * t, 9) AS noise FROM q"""
)
def value_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.grid(spark, sf_dir).select("z", "x", F.round(lattice_noise(42, F.col("x"), F.col("z"), 5.0), 9).alias("noise"))


@query()
def ridge_noise_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridges with noise in their own frame."""
    return render.render_ridges(grids.blank(spark, 64), fx.instances(spark, sf_dir), 64, 64, noise=0.3)


@query()
def scatter_along_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight ridges along each nation's spline through its customers, drawn into a 512-cell grid."""
    return render.scatter_along_spline(grids.blank(spark, 512), fx.routes(spark, sf_dir), 512, 512, peak_count=8)


@query()
def scatter_spaced_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of normal heights and turned angles, spaced along the spline through the regions, on the grid of facts."""
    n = fx.side(spark, sf_dir)
    return render.scatter_along_spline(fx.grid(spark, sf_dir), fx.waypoints(spark, sf_dir), n, n, base_altitude=90.0, shape="peak", spacing=6.0, mode="normal", sd=20.0, turn=0.3, sigma_spread=0.2)


# Weathering -----------------------------------------------------------------------------------------


def _listing_sql(steps: int) -> str:
    out = [f"WITH {fx.GRID}, s0 AS (SELECT z, x, h / 8.0 AS h FROM g)"]
    for k in range(steps):
        out.append(
            f"""t{k} AS (SELECT z, x, h, coalesce(greatest(0.0, lead(h) OVER (PARTITION BY z ORDER BY x) - h - {CRIT!r}) * 0.35, 0.0) AS a, coalesce(greatest(0.0, lead(h) OVER (PARTITION BY x ORDER BY z) - h - {CRIT!r}) * 0.35, 0.0) AS b FROM s{k}),
s{k + 1} AS (SELECT z, x, h - (((0.0 + a) - coalesce(lag(a) OVER (PARTITION BY z ORDER BY x), 0.0)) + b - coalesce(lag(b) OVER (PARTITION BY x ORDER BY z), 0.0)) AS h FROM t{k})"""
        )
    return ",\n".join(out) + f" SELECT z, x, round(h, 6) AS h FROM s{steps}"


def _low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.grid(spark, sf_dir).withColumn("h", F.col("h") / 8.0)


@query(_listing_sql(1))
def weather_listing_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.weather(_low(spark, sf_dir), "listing", iterations=1, tile=32).select("z", "x", F.round("h", 6).alias("h"))


@query(_listing_sql(5))
def weather_listing_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.weather(_low(spark, sf_dir), "listing", iterations=5, tile=32).select("z", "x", F.round("h", 6).alias("h"))


def _physical_sql(steps: int) -> str:
    out = [f"WITH {fx.GRID}, s0 AS (SELECT z, x, h / 8.0 AS h FROM g)"]
    for k in range(steps):
        out.append(
            f"""a{k} AS (SELECT z, x, h, coalesce(lag(h) OVER (PARTITION BY z ORDER BY x), 1e300) AS w, coalesce(lead(h) OVER (PARTITION BY z ORDER BY x), 1e300) AS e, coalesce(lag(h) OVER (PARTITION BY x ORDER BY z), 1e300) AS n, coalesce(lead(h) OVER (PARTITION BY x ORDER BY z), 1e300) AS s FROM s{k}),
b{k} AS (SELECT *, least(w, e, n, s) AS m FROM a{k}),
c{k} AS (SELECT z, x, h, 0.5 * greatest(0.0, (h - m) / 1.0 - {CRIT!r}) * 1.0 AS give, CASE WHEN m = w THEN 'w' WHEN m = e THEN 'e' WHEN m = n THEN 'n' ELSE 's' END AS k FROM b{k}),
s{k + 1} AS (SELECT z, x, h - give + ((((0.0 + coalesce(lead(CASE WHEN k = 'w' THEN give ELSE 0.0 END) OVER (PARTITION BY z ORDER BY x), 0.0)) + coalesce(lag(CASE WHEN k = 'e' THEN give ELSE 0.0 END) OVER (PARTITION BY z ORDER BY x), 0.0))
 + coalesce(lead(CASE WHEN k = 'n' THEN give ELSE 0.0 END) OVER (PARTITION BY x ORDER BY z), 0.0)) + coalesce(lag(CASE WHEN k = 's' THEN give ELSE 0.0 END) OVER (PARTITION BY x ORDER BY z), 0.0)) AS h FROM c{k})"""
        )
    return ",\n".join(out) + f" SELECT z, x, round(h, 6) AS h FROM s{steps}"


@query(_physical_sql(4))
def weather_physical_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.weather(_low(spark, sf_dir), "physical", iterations=4, tile=32).select("z", "x", F.round("h", 6).alias("h"))


@query(_physical_sql(20))
def weather_physical_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More iterations than a tile's halo holds: blocks of them, an exchange each."""
    return weather.weather(_low(spark, sf_dir), "physical", iterations=20, tile=fx.tile(spark, sf_dir)).select("z", "x", F.round("h", 6).alias("h"))


@query(f"WITH {fx.GRID} SELECT 'physical' AS mode, round(sum(h / 8.0), 4) AS before, round(sum(h / 8.0), 4) AS after FROM g")
def mass_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total height before and after fifteen iterations."""
    low = _low(spark, sf_dir)
    after = weather.weather(low, "physical", tile=64).select(F.lit(0.0).alias("b"), F.col("h").alias("a"))
    both = low.select(F.col("h").alias("b"), F.lit(0.0).alias("a")).unionByName(after)
    return both.agg(F.lit("physical").alias("mode"), F.round(F.sum("b"), 4).alias("before"), F.round(F.sum("a"), 4).alias("after"))


@query(f"WITH {fx.GRID}, {STEEP} SELECT z, x, round(greatest(0.0, sqrt(gx * gx + gz * gz) - {CRIT!r}), 9) AS excess, slope_deg > 38.0 AS steep FROM f")
def excess_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient's excess over the critical slope, and the cells steeper than its angle."""
    norm = F.sqrt(F.col("gx") * F.col("gx") + F.col("gz") * F.col("gz"))
    return _steep(spark, sf_dir).select("z", "x", F.round(F.greatest(F.lit(0.0), norm - CRIT), 9).alias("excess"), (F.col("slope_deg") > 38.0).alias("steep"))


# Hydrology ------------------------------------------------------------------------------------------

_FILL = """e AS (SELECT min(z) AS z0, max(z) AS z1, min(x) AS x0, max(x) AS x1 FROM g),
fill AS (SELECT 0 AS step, z, x, h, CASE WHEN z IN (z0, z1) OR x IN (x0, x1) THEN h ELSE 1e300 END AS w FROM g, e
 UNION ALL
 SELECT step + 1, z, x, h, CASE WHEN z IN ((SELECT z0 FROM e), (SELECT z1 FROM e)) OR x IN ((SELECT x0 FROM e), (SELECT x1 FROM e)) THEN h ELSE greatest(h, least(w,
   coalesce(lag(w) OVER (PARTITION BY z ORDER BY x), 1e300), coalesce(lead(w) OVER (PARTITION BY z ORDER BY x), 1e300),
   coalesce(lag(w) OVER (PARTITION BY x ORDER BY z), 1e300), coalesce(lead(w) OVER (PARTITION BY x ORDER BY z), 1e300))) END
 FROM fill WHERE step < 250)"""


@query(f"WITH RECURSIVE {fx.GRID}, {_FILL} SELECT z, x, h, w FROM fill WHERE step = 250")
def pit_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every depression raised to its spill level."""
    return flood.fill(fx.grid(spark, sf_dir), fx.tile(spark, sf_dir))


@query(f"WITH RECURSIVE {fx.GRID}, {_FILL} SELECT CAST(floor((w - h) / 16) AS BIGINT) AS depth_band, count(*) AS cells, max(w - h) AS deepest FROM fill WHERE step = 250 GROUP BY 1")
def fill_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flood.fill(fx.grid(spark, sf_dir), fx.tile(spark, sf_dir)).withColumn("depth", F.col("w") - F.col("h"))
    return out.groupBy(F.floor(F.col("depth") / 16).alias("depth_band")).agg(F.count("*").alias("cells"), F.max("depth").alias("deepest"))


@query()
def breach_carving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface lowered along receivers until no step goes up."""
    return hydro.breach(hydro.flow(flood.fill(fx.grid(spark, sf_dir), fx.tile(spark, sf_dir)), fx.SPACING, fx.tile(spark, sf_dir)))


_AWAY = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def _neighbour_sql(t: str = "g") -> str:
    parts = [f"q{k}.h AS h{k}" for k in range(8)]
    joins = " ".join(f"LEFT JOIN {t} q{k} ON q{k}.z = {t}.z + ({dz}) AND q{k}.x = {t}.x + ({dx})" for k, (dz, dx) in enumerate(_AWAY))
    below = ", ".join(f"(h{k} IS NOT NULL AND (h{k} < h OR (h{k} = h AND {str((dz, dx) < (0, 0)).lower()}))) AS b{k}" for k, (dz, dx) in enumerate(_AWAY))
    pick = lambda e, p: f"CASE {e} " + " ".join(f"WHEN {k} THEN {p}{k}" for k in range(8)) + " END"
    s = fx.SPACING
    return f"""nb AS (SELECT {t}.z, {t}.x, {t}.h, {', '.join(parts)} FROM {t} {joins}),
gr AS (SELECT *, (coalesce(h0, h) - coalesce(h4, h)) / (CASE WHEN h0 IS NULL OR h4 IS NULL THEN {s}.0 ELSE {2 * s}.0 END) AS gx, (coalesce(h2, h) - coalesce(h6, h)) / (CASE WHEN h2 IS NULL OR h6 IS NULL THEN {s}.0 ELSE {2 * s}.0 END) AS gz, {below} FROM nb),
an AS (SELECT *, atan2(-gz, -gx) / {math.pi / 4!r} AS a0 FROM gr), tu AS (SELECT *, a0 - 8 * floor(a0 / 8) AS turn FROM an),
ki AS (SELECT *, CAST(floor(turn) AS INT) % 8 AS f1, (CAST(floor(turn) AS INT) + 1) % 8 AS f2, turn - floor(turn) AS sh, NOT (gx = 0 AND gz = 0) AS moves FROM tu),
pr AS (SELECT *, CASE WHEN ({pick('f1', 'b')}) AND moves THEN 1 - sh ELSE 0.0 END AS r1, CASE WHEN ({pick('f2', 'b')}) AND moves THEN sh ELSE 0.0 END AS r2,
  least({', '.join(f'CASE WHEN b{k} THEN h{k} ELSE 1e300 END' for k in (0, 2, 4, 6))}) AS lo FROM ki),
fl AS (SELECT z, x, h, CASE WHEN r1 + r2 = 0 AND lo < 1e300 THEN {"CASE " + " ".join(f"WHEN b{k} AND h{k} = lo THEN {k}" for k in (0, 2, 4, 6)) + " END"} WHEN r1 > 0 THEN f1 ELSE -1 END AS k1,
  CASE WHEN r1 + r2 = 0 AND lo < 1e300 THEN 1.0 WHEN r1 + r2 > 0 THEN r1 / (r1 + r2) ELSE 0.0 END AS p1, CASE WHEN r1 + r2 > 0 AND r2 > 0 THEN f2 ELSE -1 END AS k2, CASE WHEN r1 + r2 > 0 THEN r2 / (r1 + r2) ELSE 0.0 END AS p2 FROM pr)"""


@query(f"WITH {fx.GRID}, {_neighbour_sql()} SELECT z, x, CAST(k1 AS INT) AS k1, round(p1, 9) AS p1, CAST(k2 AS INT) AS k2, round(p2, 9) AS p2 FROM fl")
def flow_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receivers and shares on the unfilled grid."""
    directed = hydro.flow(fx.grid(spark, sf_dir).withColumn("w", F.col("h")), fx.SPACING, fx.tile(spark, sf_dir))
    return directed.select("z", "x", "k1", F.round("p1", 9).alias("p1"), "k2", F.round("p2", 9).alias("p2"))


_STEP_Z = "CASE k " + " ".join(f"WHEN {k} THEN {d[0]}" for k, d in enumerate(_AWAY)) + " END"
_STEP_X = "CASE k " + " ".join(f"WHEN {k} THEN {d[1]}" for k, d in enumerate(_AWAY)) + " END"
_EDGES = f"ed AS (SELECT z, x, z + {_STEP_Z} AS tz, x + {_STEP_X} AS tx, p FROM (SELECT z, x, k1 AS k, p1 AS p FROM fl UNION ALL SELECT z, x, k2, p2 FROM fl) WHERE k >= 0)"


def _area_sql(steps: int) -> str:
    return f"""{_EDGES},
ar AS (SELECT 0 AS step, z, x, CAST(1 AS DOUBLE) AS area FROM fl
 UNION ALL
 SELECT step, z, x, CAST(1 AS DOUBLE) + coalesce(inflow, 0) FROM (SELECT DISTINCT step + 1 AS step FROM ar WHERE step < {steps}) s, fl LEFT JOIN (SELECT tz, tx, sum(p * ar.area) AS inflow FROM ed JOIN ar USING (z, x) GROUP BY tz, tx) i ON i.tz = fl.z AND i.tx = fl.x)"""


_FILLED = f"{_FILL}, fw AS (SELECT z, x, w AS h FROM fill WHERE step = 250), {_neighbour_sql('fw')}"


@query(f"WITH RECURSIVE {fx.GRID}, {_FILLED}, {_EDGES} SELECT count(*) FILTER (WHERE b.h > a.h) AS climbs, count(*) AS steps FROM ed JOIN fw a ON a.z = ed.z AND a.x = ed.x JOIN fw b ON b.z = tz AND b.x = tx")
def flow_climbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps to a receiver on the filled surface, and those that go up: none."""
    directed = hydro.flow(flood.fill(fx.grid(spark, sf_dir), fx.tile(spark, sf_dir)), fx.SPACING, fx.tile(spark, sf_dir))
    return hydro.climbs(directed).select("climbs", "steps")


@query(f"WITH RECURSIVE {fx.GRID}, {_neighbour_sql()}, {_area_sql(120)} SELECT z, x, round(area, 6) AS area FROM ar WHERE step = 120")
def drainage_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drainage area on the unfilled grid."""
    directed = hydro.flow(fx.grid(spark, sf_dir).withColumn("w", F.col("h")), fx.SPACING, fx.tile(spark, sf_dir))
    return accumulate.drainage(directed, fx.tile(spark, sf_dir)).select("z", "x", F.round("area", 6).alias("area"))


CHANNEL_AREA = 20.5  # cells; no sum of whole areas, so that rounding decides nothing


def _nearest_sql(area: str) -> str:
    """ne: every cell's nearest channel of a table (z, x, area), cu: the cut of its cross section."""
    return f"""ch AS (SELECT z AS cz, x AS cx, area AS ca FROM {area} WHERE area >= {CHANNEL_AREA}),
ne AS (SELECT c.z, c.x, any_value(c.area) AS area, arg_min((cz, cx, ca, sqrt(d2)), (d2, cz, cx)) AS q
       FROM (SELECT o.z, o.x, o.area, cz, cx, ca, (o.z - cz) * (o.z - cz) + (o.x - cx) * (o.x - cx) AS d2 FROM {area} o LEFT JOIN ch ON true) c GROUP BY 1, 2),
nf AS (SELECT z, x, area, q[1] AS channel_z, q[2] AS channel_x, q[3] AS ca, q[4] AS distance, q[4] / (1.0 + 0.1 * sqrt(q[3])) AS r, 0.5 * pow(q[3], 0.4) AS depth FROM ne),
cu AS (SELECT z, x, area, channel_z, channel_x, distance, coalesce(CASE WHEN ca < 500 THEN CASE WHEN r <= 1 THEN -depth * (1.0 - r) ELSE 0.0 END
         WHEN ca < 5000 THEN CASE WHEN r <= 1 THEN -depth * (1.0 - r * r * r * r) ELSE 0.0 END
         ELSE CASE WHEN r <= 0.5 THEN -depth WHEN r <= 1 THEN -0.9 * depth WHEN r <= 1.25 THEN 0.1 * depth ELSE 0.0 END END, 0.0) AS cut FROM nf)"""


@query(
    f"""WITH RECURSIVE {fx.GRID}, {_FILLED}, {_area_sql(600)}, o AS (SELECT z, x, area, sqrt(gx * gx + gz * gz) AS s FROM ar JOIN pr USING (z, x) WHERE step = 600), {_nearest_sql('o')}
SELECT z, x, g.h, fw.h AS w, round(o.area, 6) AS area, round(s, 9) AS gradient, round(-0.01 * sqrt(o.area) * s, 9) + 0.0 AS dh,
  CASE WHEN o.area < 500 THEN 'torrent' WHEN o.area < 5000 THEN 'river' ELSE 'floodplain' END AS channel,
  channel_z, channel_x, round(distance, 9) AS distance, round(cut, 6) + 0.0 AS cut, round(fw.h - 0.01 * sqrt(o.area) * s + cut, 6) + 0.0 AS bed FROM o JOIN g USING (z, x) JOIN fw USING (z, x) JOIN cu USING (z, x)"""
)
def river_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filling, drainage, incision, channel class, nearest channel and river bed in a row."""
    out = routing.routed(fx.grid(spark, sf_dir), fx.SPACING, tile=fx.tile(spark, sf_dir), least_area=CHANNEL_AREA)
    rounded = {"area": 6, "gradient": 9, "dh": 9, "distance": 9, "cut": 6, "bed": 6}
    return out.select("z", "x", "h", "w", "channel", "channel_z", "channel_x", *((F.round(c, n) + 0.0).alias(c) for c, n in rounded.items()))


@query(f"WITH RECURSIVE {fx.GRID}, {_neighbour_sql()}, {_area_sql(120)}, o AS (SELECT z, x, area FROM ar WHERE step = 120), {_nearest_sql('o')} SELECT z, x, channel_z, channel_x, round(distance, 9) AS distance, round(cut, 6) + 0.0 AS cut FROM cu")
def channel_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest channel of every cell by exact distance, and the cut of its cross section, on the unfilled grid."""
    directed = hydro.flow(fx.grid(spark, sf_dir).withColumn("w", F.col("h")), fx.SPACING, fx.tile(spark, sf_dir))
    near = channels.carve(channels.nearest_channel(accumulate.drainage(directed, fx.tile(spark, sf_dir)), CHANNEL_AREA))
    return near.select("z", "x", "channel_z", "channel_x", F.round("distance", 9).alias("distance"), (F.round("cut", 6) + 0.0).alias("cut"))


@query()
def least_cost_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface with every pit's cheapest way to lower ground cut to the pit's height."""
    return breaching.breach(fx.grid(spark, sf_dir), fx.tile(spark, sf_dir))[0]


@query()
def breach_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pit, and what its cheapest way costs."""
    return breaching.breach(fx.grid(spark, sf_dir), fx.tile(spark, sf_dir))[1]


@query(f"WITH {fx.GRID}, {fx.GRADIENT} SELECT z, x, round(-0.01 * pow(h + 65, 0.5) * pow(sqrt(gx * gx + gz * gz), 1.0), 9) AS dh FROM f")
def stream_incision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _field(spark, sf_dir).withColumns({"area": F.col("h") + 65, "gradient": F.sqrt(F.col("gx") * F.col("gx") + F.col("gz") * F.col("gz"))})
    return out.select("z", "x", F.round(hydro.incision(), 9).alias("dh"))


@query(
    f"""WITH {fx.GRID}, a AS (SELECT z, x, (h + 64) * 20 AS area, (x % 9) / 6.0 AS r FROM g),
k AS (SELECT *, CASE WHEN area < 500 THEN 'torrent' WHEN area < 5000 THEN 'river' ELSE 'floodplain' END AS channel FROM a)
SELECT z, x, channel, round(CASE channel WHEN 'torrent' THEN CASE WHEN r <= 1 THEN -4.0 * (1.0 - r) ELSE 0.0 END WHEN 'river' THEN CASE WHEN r <= 1 THEN -4.0 * (1.0 - r * r * r * r) ELSE 0.0 END
 ELSE CASE WHEN r <= 0.5 THEN -4.0 WHEN r <= 1 THEN -3.6 WHEN r <= 1.25 THEN 0.4 ELSE 0.0 END END, 9) + 0.0 AS carve FROM k"""
)
def channel_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel classes by drainage area and their cross sections."""
    out = fx.grid(spark, sf_dir).withColumn("area", (F.col("h") + 64) * 20).withColumn("channel", hydro.channel_class())
    carve = hydro.cross_section(F.col("x") % 9 / 1.0, F.col("channel"), F.lit(4.0), F.lit(6.0))
    return out.select("z", "x", "channel", (F.round(carve, 9) + 0.0).alias("carve"))


# Suitability and masks ------------------------------------------------------------------------------

_SUIT = f"""{fx.GRID}, {STEEP},
u AS (SELECT z, x, 'foliage' AS feature, round((CASE WHEN h <= 180 THEN 1.0 WHEN h <= 225 THEN (225.0 - h) / 45.0 ELSE 0.0 END) * (1 / (1 + exp(0.4 * (slope_deg - 32)))) * (CASE WHEN h <= 63 THEN 0.0 ELSE 1.0 END), 9) AS p FROM f
 UNION ALL SELECT z, x, 'rock', round(1 / (1 + exp(-0.5 * (slope_deg - 38))), 9) FROM f
 UNION ALL SELECT z, x, 'snow', round(greatest(0.0, least(1.0, (h - 200) / 40.0)) * (1 - 0.6 * sin(radians(slope_deg))), 9) FROM f)"""


@query(f"WITH {_SUIT} SELECT z, x, feature, p FROM u")
def suitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foliage, rock and snow suitability in long form."""
    return responses.suitability(_steep(spark, sf_dir))


_HABITAT = f"""{fx.GRID}, {_neighbour_sql()}, {_area_sql(120)}, da AS (SELECT z, x, area FROM ar WHERE step = 120),
{STEEP.replace('n AS (', 'ns AS (', 1).replace('FROM n)', 'FROM ns)')},
hb AS (SELECT f.z, f.x, f.h, slope_deg, area, least(1.0, greatest(0.0, ln(greatest(area, 1.0)) / (SELECT CASE WHEN max(area) > 1 THEN ln(max(area)) ELSE 1.0 END FROM da))) AS m,
  greatest(-1.0, least(1.0, (coalesce(w, f.h) + coalesce(e, f.h) + coalesce(nn, f.h) + coalesce(ss, f.h) - 4.0 * f.h) / 8.0)) AS c, atan2(-gx, gz) AS a FROM f JOIN da ON da.z = f.z AND da.x = f.x),
hu AS (SELECT z, x, 'foliage' AS feature, round((CASE WHEN h <= 180 THEN 1.0 WHEN h <= 225 THEN (225.0 - h) / 45.0 ELSE 0.0 END) * (1 / (1 + exp(0.4 * (slope_deg - 32)))) * (CASE WHEN h <= 63 THEN 0.0 ELSE 1.0 END)
    * least(1.0, 2.0 * m) * (0.5 * (1.0 + c)) * (0.75 + 0.25 * cos(a)), 9) AS p FROM hb
 UNION ALL SELECT z, x, 'rock', round(1 / (1 + exp(-0.5 * (slope_deg - 38))), 9) FROM hb
 UNION ALL SELECT z, x, 'snow', round(greatest(0.0, least(1.0, (h - 200) / 40.0)) * (1 - 0.6 * sin(radians(slope_deg))), 9) FROM hb
 UNION ALL SELECT z, x, 'boulder', round(1 / (1 + exp(0.5 * (slope_deg - 30))) * (1.0 - abs(c)), 9) FROM hb
 UNION ALL SELECT z, x, 'scree', round(greatest(0.0, least(1.0, (area - 10.0) / 10.0)), 9) FROM hb)"""


@query(f"WITH RECURSIVE {_HABITAT} SELECT z, x, feature, p FROM hu")
def habitat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suitability with all factors: moisture of the drained area, curvature, aspect, boulders and riverbed scree."""
    directed = hydro.flow(fx.grid(spark, sf_dir).withColumn("w", F.col("h")), fx.SPACING, fx.tile(spark, sf_dir))
    area = rounds.Rounds(directed, "habitat").save(accumulate.drainage(directed, fx.tile(spark, sf_dir)), "area")
    field = grids.moisture(_steep(spark, sf_dir).join(area, ["z", "x"]))
    columns = {c: F.col(c) for c in ("moisture", "curvature", "area")}
    return responses.suitability(field, responses.catalogue(F.col("slope_deg"), F.col("h"), aspect=F.col("aspect_rad"), **columns))


@query(f"WITH {fx.GRID}, {STEEP} SELECT CASE WHEN slope_deg < 35 THEN 'soil' WHEN slope_deg > 45 THEN 'rock' ELSE 'mixed' END AS ground, count(*) AS cells FROM f GROUP BY 1")
def ground_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steep(spark, sf_dir).groupBy(responses.ground(F.col("slope_deg")).alias("ground")).agg(F.count("*").alias("cells"))


@query(f"WITH {fx.GRID}, a AS (SELECT z, x, (h + 64) * 20 AS area FROM g) SELECT z, x, round(greatest(0.0, least(1.0, (area - 500.0) / 500.0)), 9) AS p FROM a")
def riverbed_suitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.grid(spark, sf_dir).select("z", "x", F.round(responses.riverbed((F.col("h") + 64) * 20), 9).alias("p"))


@query(f"WITH {_SUIT}, {fx.THRESHOLDS} SELECT z, x, feature, CAST(CASE WHEN NOT isnan(p) AND p >= thr THEN 255 ELSE 0 END AS SMALLINT) AS v FROM u JOIN t ON tz = z % 64 AND tx = x % 64")
def dither_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of every feature by the threshold lattice."""
    return dither.mask(responses.suitability(_steep(spark, sf_dir)), fx.thresholds(spark, sf_dir)).select("z", "x", "feature", "v")


_BLUE = dither.highpass_matrix()


def _matrix_sql(matrix: np.ndarray) -> str:
    """A threshold matrix as a list by row, read by position."""
    values = ", ".join(f"{float(v):.17e}" for v in matrix.ravel())
    return f"t AS (SELECT CAST(i // {matrix.shape[1]} AS INT) AS tz, CAST(i % {matrix.shape[1]} AS INT) AS tx, list_extract(v, i + 1) AS thr FROM range({matrix.size}) r(i), (SELECT [{values}] AS v))"


_TAPS = ", ".join(f"({k}, {math.exp(-0.5 * (k / 1.5) ** 2) / sum(math.exp(-0.5 * (j / 1.5) ** 2) for j in range(-6, 7))!r})" for k in range(-6, 7))


def _blur_sql(axis: str, table: str, name: str) -> str:
    other = "x" if axis == "z" else "z"
    return f"""{name} AS (SELECT o.z, o.x, any_value(o.h) AS h, sum(wt * t.v) AS v FROM {table} o JOIN (VALUES {_TAPS}) k(d, wt) ON true JOIN {table} t
  ON t.{other} = o.{other} AND t.{axis} = CASE WHEN o.{axis} + d < 0 THEN -o.{axis} - d - 1 WHEN o.{axis} + d >= (SELECT n FROM p) THEN 2 * (SELECT n FROM p) - 1 - o.{axis} - d ELSE o.{axis} + d END GROUP BY o.z, o.x)"""


@query(
    f"""WITH {fx.GRID}, b0 AS (SELECT z, x, h, h AS v FROM g), {_blur_sql('z', 'b0', 'b1')}, {_blur_sql('x', 'b1', 'b2')}, ro AS (SELECT z, x, h - v AS r FROM b2)
SELECT z, x, round((r - (SELECT min(r) FROM ro)) / (SELECT max(r) - min(r) FROM ro), 9) AS thr FROM ro"""
)
def grid_highpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid less its Gaussian blur, scaled to [0, 1]: thresholds that follow the ground."""
    return dither.highpass(fx.grid(spark, sf_dir), tile=fx.tile(spark, sf_dir)).select("z", "x", F.round("thr", 9).alias("thr"))


@query(f"WITH {_SUIT}, {_matrix_sql(_BLUE)} SELECT z, x, feature, CAST(CASE WHEN NOT isnan(p) AND p >= thr THEN 255 ELSE 0 END AS SMALLINT) AS v FROM u JOIN t ON tz = z % 64 AND tx = x % 64")
def blue_noise_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of every feature by the high-passed noise matrix, tiled over the grid."""
    return dither.mask(responses.suitability(_steep(spark, sf_dir)), dither.as_table(spark, _BLUE)).select("z", "x", "feature", "v")


@query(
    f"""WITH {_SUIT}, {fx.THRESHOLDS}, m AS (SELECT feature, p, CASE WHEN p >= thr THEN 1 ELSE 0 END AS v, CASE WHEN p >= thr AND p > 0 THEN 1 ELSE 0 END AS sv FROM u JOIN t ON tz = z % 64 AND tx = x % 64)
SELECT feature, CAST(sum(v) AS BIGINT) AS fired, CAST(sum(sv) AS BIGINT) AS fired_strict, count(*) AS cells FROM m GROUP BY feature"""
)
def mask_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells fired by feature, with and without the strict rule for p = 0."""
    p, t = responses.suitability(_steep(spark, sf_dir)), fx.thresholds(spark, sf_dir)
    strict = dither.mask(dither.mask(p, t).withColumnRenamed("v", "loose"), t, strict_zero=True)
    fired = lambda c, n: F.sum(F.when(F.col(c) == 255, 1).otherwise(0)).cast("long").alias(n)
    return strict.groupBy("feature").agg(fired("loose", "fired"), fired("v", "fired_strict"), F.count("*").alias("cells"))


@query()
def threshold_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both matrices: size, range and mean."""
    tables = [dither.as_table(spark, m).withColumn("kind", F.lit(k)) for k, m in (("highpass", dither.highpass_matrix()), ("void-and-cluster", dither.void_and_cluster_matrix(32)))]
    both = tables[0].unionByName(tables[1])
    return both.groupBy("kind").agg(F.count("*").alias("cells"), F.min("thr").alias("low"), F.max("thr").alias("high"), F.round(F.avg("thr"), 9).alias("mean"))


def _whole_sql() -> str:
    """Every stage's SQL in a row, each on the surface of the one before."""
    box = _BOX.format(r="length", s="sigma", t="i").replace("c AS (SELECT CAST(i // 64 AS INT) AS z, CAST(i % 64 AS INT) AS x FROM range(4096) r(i))", "c AS (SELECT z, x, h FROM g0)").replace("least(64, ", "least((SELECT n FROM p), ")
    ridges = f"""{fx.GRID.replace("g AS (SELECT", "g0 AS (SELECT")}, {fx.INSTANCES}, {box},
l AS (SELECT z, x, inst_id, height * greatest(0.0, least(1.0, 1.0 - ((dx * cos(angle) + dz * sin(angle)) / (length / 2.0)) * ((dx * cos(angle) + dz * sin(angle)) / (length / 2.0)))) * exp(-abs(dz * cos(angle) - dx * sin(angle)) / sigma) AS layer FROM m),
fo AS (SELECT z, x, list(layer ORDER BY inst_id) AS hs FROM l GROUP BY z, x),
r0 AS (SELECT c.z, c.x, CAST(coalesce(list_reduce(list_prepend(CAST(CAST(c.h AS FLOAT) AS DOUBLE), fo.hs), lambda a, h: CAST(CAST(0.5 * (a + h + sqrt((a - h) * (a - h) + 12.0)) AS FLOAT) AS DOUBLE)), c.h) AS FLOAT) AS h FROM c LEFT JOIN fo USING (z, x))"""
    steps = _physical_sql(4)
    weathered = "s0 AS (SELECT z, x, CAST(h AS DOUBLE) AS h FROM r0),\n" + steps[steps.index("a0 AS (") : steps.rindex(" SELECT z, x, round(h, 6)")]
    slope = STEEP.replace("FROM g)", "FROM bd)")
    for name in ("n", "d", "f"):
        slope = slope.replace(f"{name} AS (", f"{name}_2 AS (", 1).replace(f"FROM {name})", f"FROM {name}_2)")
    return f"""WITH RECURSIVE {ridges}, {weathered}, g AS (SELECT z, x, h FROM s4), {_FILLED}, {_area_sql(600)},
o AS (SELECT z, x, area, sqrt(gx * gx + gz * gz) AS s FROM ar JOIN pr USING (z, x) WHERE step = 600), {_nearest_sql('o')},
bd AS (SELECT z, x, fw.h - 0.01 * sqrt(o.area) * s + cut AS h FROM o JOIN fw USING (z, x) JOIN cu USING (z, x)), {slope},
{fx.STRATA}, sj AS (SELECT z, x, arg_min(terrain, st.seq) AS terrain FROM f_2 JOIN st ON floor(h) BETWEEN lo AND hi AND (slope_lo IS NULL OR slope_deg BETWEEN slope_lo AND slope_hi) GROUP BY z, x),
hs AS (SELECT z, x, 'rock' AS feature, round(1 / (1 + exp(-0.5 * (slope_deg - 38))), 9) AS p FROM f_2
 UNION ALL SELECT z, x, 'snow', round(greatest(0.0, least(1.0, (h - 200) / 40.0)) * (1 - 0.6 * sin(radians(slope_deg))), 9) FROM f_2
 UNION ALL SELECT z, x, 'scree', round(greatest(0.0, least(1.0, (area - 10.0) / 10.0)), 9) FROM o), {fx.THRESHOLDS},
mk AS (SELECT z, x, string_agg(feature, ',' ORDER BY feature) AS layers FROM hs JOIN t ON tz = z % 64 AND tx = x % 64 WHERE p >= thr GROUP BY z, x)
SELECT f_2.z, f_2.x, CAST(floor(f_2.h) AS BIGINT) AS y_top, sj.terrain, coalesce(mk.layers, '') AS layers FROM f_2 LEFT JOIN sj ON sj.z = f_2.z AND sj.x = f_2.x LEFT JOIN mk ON mk.z = f_2.z AND mk.x = f_2.x"""


@query(_whole_sql())
def whole_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row: ridges, weathering, rivers and their beds, suitability, masks, strata and columns."""
    n, tile = fx.side(spark, sf_dir), fx.tile(spark, sf_dir)
    ridged = render.render_ridges(fx.grid(spark, sf_dir), fx.instances(spark, sf_dir), n, n)
    keep = rounds.Rounds(ridged, "whole")
    low = weather.weather(ridged.withColumn("h", F.col("h").cast("double")), iterations=4, tile=tile)
    rivers = keep.save(routing.routed(keep.save(low, "low"), fx.SPACING, tile=tile, least_area=CHANNEL_AREA).select("z", "x", F.col("bed").alias("h"), "area"), "rivers")
    field = keep.save(grids.derived(rivers.select("z", "x", "h"), 8.0).join(rivers.select("z", "x", "area"), ["z", "x"]), "field")
    features = responses.catalogue(F.col("slope_deg"), F.col("h"), area=F.col("area"))
    masks = dither.mask(responses.suitability(field, {k: features[k] for k in ("rock", "snow", "scree")}), fx.thresholds(spark, sf_dir))
    layers = masks.filter("v = 255").groupBy("z", "x").agg(F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("layers"))
    columns = world.strata_join(field.select("z", "x", "h", "slope_deg"), fx.strata(spark, sf_dir), slope="slope_deg").join(layers, ["z", "x"], "left")
    return columns.select("z", "x", F.floor("h").alias("y_top"), "terrain", F.coalesce("layers", F.lit("")).alias("layers"))


@query(
    f"""WITH {_SUIT} SELECT z, x, feature, 0.5 * p AS density, round(CASE WHEN 0.5 * p > 0 THEN 1.5 / sqrt(0.5 * p) END, 9) AS r, CAST(round({0.5 * math.hypot(9, 9)!r}, 9) AS DOUBLE) AS box FROM u"""
)
def point_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target density, the radius it asks for, and the radius of a 9 x 9 footprint."""
    rho = points.target_density(F.col("p"), 0.5)
    return responses.suitability(_steep(spark, sf_dir)).select("z", "x", "feature", rho.alias("density"), F.round(points.spacing(rho, 1.5), 9).alias("r"), F.round(F.lit(points.box_radius(9, 9)), 9).alias("box"))


def _foliage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.candidates(responses.suitability(_steep(spark, sf_dir)).filter("feature = 'foliage'"), r_min=1.5)


def _uniform_sql(attribute: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '42', '{attribute}', z, x)), 1, 8))::UBIGINT / 4294967296.0"


_CANDIDATES = f"""{_SUIT},
cand AS (SELECT z || ':' || x AS id, x + {_uniform_sql('px')} AS px, z + {_uniform_sql('pz')} AS pz, 1.5 / sqrt(p) AS r, {_uniform_sql('priority')} AS priority FROM u WHERE feature = 'foliage' AND p > 0),
turn AS (SELECT *, row_number() OVER (ORDER BY greatest(0, ceil(log2(r))), priority, id) AS i FROM cand),
step AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(px DOUBLE, pz DOUBLE, r DOUBLE, i BIGINT)[]) AS taken
 UNION ALL
 SELECT t.i, CASE WHEN len(list_filter(taken, lambda o: sqrt((o.px - t.px) * (o.px - t.px) + (o.pz - t.pz) * (o.pz - t.pz)) < greatest(o.r, t.r))) = 0
        THEN list_append(taken, {{'px': t.px, 'pz': t.pz, 'r': t.r, 'i': t.i}}) ELSE taken END FROM step JOIN turn t ON t.i = step.i + 1),
got AS (SELECT unnest(list_transform(taken, lambda o: o.i)) AS i FROM (SELECT arg_max(taken, i) AS taken FROM step))"""


@query(f"WITH RECURSIVE {_CANDIDATES} SELECT id, round(px, 9) AS px, round(pz, 9) AS pz, round(r, 9) AS r, round(priority, 9) AS priority FROM got JOIN turn USING (i)")
def poisson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foliage points by variable-radius Poisson-disk sampling."""
    return points.poisson_disk(_foliage(spark, sf_dir)).select("id", *(F.round(c, 9).alias(c) for c in ("px", "pz", "r", "priority")))


@query(f"WITH RECURSIVE {_CANDIDATES} SELECT (SELECT count(*) FROM cand) AS candidates, count(*) AS taken, CAST(0 AS BIGINT) AS too_close, CAST(0 AS BIGINT) AS uncovered FROM got")
def poisson_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and points of the sample, pairs of points too close, and candidates that could be added."""
    every = _foliage(spark, sf_dir)
    return points.gaps(every, points.poisson_disk(every))


@query("""WITH c AS (SELECT DISTINCT CAST(floor((s_suppkey * 53) % 64 + 0.5) AS INT) AS z, CAST(floor((s_suppkey * 37) % 64 + 0.25) AS INT) AS x FROM supplier)
SELECT CAST(i // 64 AS INT) AS z, CAST(i % 64 AS INT) AS x, CAST(CASE WHEN c.z IS NULL THEN 0 ELSE 255 END AS SMALLINT) AS v FROM range(4096) r(i) LEFT JOIN c ON c.z = i // 64 AND c.x = i % 64""")
def point_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as a mask of the cells that hold one."""
    k = F.col("s_suppkey")
    at = fx.table(spark, sf_dir, "supplier").select(((k * 37) % 64 + 0.25).alias("px"), ((k * 53) % 64 + 0.5).alias("pz"))
    return points.as_mask(grids.blank(spark, 64), at)


# Levels, strata, layers, palette --------------------------------------------------------------------

_LEVELS = f"{fx.GRID}, v AS (SELECT z, x, h, CAST(round(greatest(0.0, least(1.0, (h + 64.0) / 384.0)) * 65535) AS INT) AS v FROM g)"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.grid(spark, sf_dir).withColumn("v", world.quantise(F.col("h")))


@query(f"WITH {_LEVELS} SELECT z, x, v, round(-64 + v * (384.0 / 65535.0), 9) AS y FROM v")
def level_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights as 16-bit levels, and levels as heights."""
    return _levels(spark, sf_dir).select("z", "x", "v", F.round(world.remap(F.col("v")), 9).alias("y"))


@query(
    f"""WITH {_LEVELS}, a AS (SELECT z, x, v FROM v)
SELECT 'half' AS scale, CAST(z // 2 AS INT) AS z, CAST(x // 2 AS INT) AS x, CAST(round(avg(v)) AS INT) AS v FROM a GROUP BY ALL
UNION ALL SELECT 'double', CAST(z * 2 + b.i // 2 AS INT), CAST(x * 2 + b.i % 2 AS INT), v FROM a, range(4) b(i)"""
)
def horizontal_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _levels(spark, sf_dir).select("z", "x", "v")
    parts = [world.rescale(v, percent).select(F.lit(name).alias("scale"), "z", "x", "v") for name, percent in (("half", 50), ("double", 200))]
    return parts[0].unionByName(parts[1])


@query(f"WITH {_LEVELS} SELECT z, x, round(greatest(-64.0, least(320.0, -64 + v * (384.0 / 65535.0))), 9) AS h, greatest(-64.0, least(320.0, -64 + v * (384.0 / 65535.0))) < 62 AS submerged FROM v")
def create_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = world.create_world(_levels(spark, sf_dir).select("z", "x", "v"))
    return out.select("z", "x", F.round("h", 9).alias("h"), "submerged")


@query(f"WITH {fx.GRID}, m AS (SELECT z, x, (z * 7 + x * 13) % 256 AS v FROM g WHERE (z + x) % 5 <> 0) SELECT z, x, CASE WHEN v BETWEEN 128 AND 255 THEN 1 ELSE 0 END AS Populate FROM g LEFT JOIN m USING (z, x)")
def apply_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask applied to a layer; cells without a mask value count as 0."""
    g = fx.grid(spark, sf_dir)
    mask = g.filter("(z + x) % 5 <> 0").select("z", "x", ((F.col("z") * 7 + F.col("x") * 13) % 256).alias("v"))
    world.require_layers(["Populate"], list(config.EXAMPLE_LAYERS))
    return world.apply_mask(g, mask, "Populate").select("z", "x", "Populate")


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Populate' ELSE 'Frost' END AS layer, count(*) AS n FROM supplier GROUP BY 1")
def layer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = spark.createDataFrame([(k,) for k in config.EXAMPLE_LAYERS], "layer string")
    names = fx.table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "Populate").otherwise("Frost").alias("layer"))
    return world.find_layer(names, layers).groupBy("layer").agg(F.count("*").alias("n"))


_TERRAIN = "CASE WHEN y BETWEEN -64 AND 61 THEN 'Gravel / Sand' WHEN y BETWEEN 62 AND 130 AND slope_deg BETWEEN 0 AND 35 THEN 'Grass / Bare Dirt' WHEN y BETWEEN 131 AND 190 THEN 'Podzol / Coarse' WHEN y BETWEEN 191 AND 250 THEN 'Stone / Cobblestone' WHEN y BETWEEN 251 AND 320 THEN 'Deep Snow' END"


@query(
    f"""WITH {fx.GRID}, {STEEP}, {fx.STRATA}, m AS (SELECT z, x, arg_min(st.seq, st.seq) AS seq, arg_min(terrain, st.seq) AS terrain FROM f JOIN st ON floor(h) BETWEEN lo AND hi AND (slope_lo IS NULL OR slope_deg BETWEEN slope_lo AND slope_hi) GROUP BY z, x)
SELECT f.z, f.x, CAST(floor(h) AS BIGINT) AS y_top, seq, terrain FROM f LEFT JOIN m ON m.z = f.z AND m.x = f.x"""
)
def strata_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell's first stratum of a table of strata, one a part, some with slope limits."""
    out = world.strata_join(_steep(spark, sf_dir), fx.strata(spark, sf_dir), slope="slope_deg")
    return out.select("z", "x", F.floor("h").alias("y_top"), "seq", "terrain")


@query(f"WITH {fx.GRID}, {STEEP}, y AS (SELECT floor(h) AS y, slope_deg FROM f) SELECT {_TERRAIN} AS terrain, count(*) AS cells FROM y GROUP BY 1")
def strata_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by stratum with its slope limit; cells that match none stay, as null."""
    terrain = world.stratum(F.col("h"), config.EXAMPLE_STRATA, F.col("slope_deg"))
    return _steep(spark, sf_dir).groupBy(terrain.alias("terrain")).agg(F.count("*").alias("cells"))


@query(f"WITH {fx.GRID}, {STEEP}, y AS (SELECT z, x, floor(h) AS y, slope_deg, (z + x) % 3 = 0 AS a, (z * x) % 4 = 0 AS b FROM f) SELECT z, x, CAST(y AS INT) AS y_top, {_TERRAIN} AS terrain, concat_ws(',', CASE WHEN a THEN 'Populate' END, CASE WHEN b THEN 'Frost' END) AS layers FROM y")
def column_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The world's columns: top, terrain and layers."""
    w = _steep(spark, sf_dir).withColumns({"Populate": F.when((F.col("z") + F.col("x")) % 3 == 0, 1).otherwise(0), "Frost": F.when((F.col("z") * F.col("x")) % 4 == 0, 1).otherwise(0)})
    return world.column_table(w, config.EXAMPLE_STRATA, ["Populate", "Frost"]).withColumn("layers", F.array_join("layers", ","))


_PALETTE = "(VALUES " + ", ".join(f"({k}, '{p['block']}', {p['r']}, {p['g']}, {p['b']})" for k, p in enumerate(PALETTE)) + ") q(seq, block, pr, pg, pb)"


@query(f"""WITH x AS (SELECT p_partkey AS id, CAST((p_partkey * 37) % 256 AS INT) AS r, CAST((p_partkey * 91) % 256 AS INT) AS g, CAST((p_partkey * 151) % 256 AS INT) AS b FROM part),
d AS (SELECT id, block, row_number() OVER (PARTITION BY id ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), seq) AS k FROM x, {_PALETTE}) SELECT id, block FROM d WHERE k = 1""")
def palette_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rgb = fx.table(spark, sf_dir, "part").select(k.alias("id"), ((k * 37) % 256).cast("int").alias("r"), ((k * 91) % 256).cast("int").alias("g"), ((k * 151) % 256).cast("int").alias("b"))
    return rgb.select("id", world.nearest_block(F.col("r"), F.col("g"), F.col("b"), PALETTE).alias("block"))


@query(
    f"""WITH {fx.GRID}, {STEEP}, {fx.THRESHOLDS}, u AS (SELECT z, x, 'foliage' AS feature, round(1 / (1 + exp(0.4 * (slope_deg - 32))), 9) AS p FROM f UNION ALL SELECT z, x, 'rock', round(1 / (1 + exp(-0.5 * (slope_deg - 38))), 9) FROM f)
SELECT z, x, feature, CAST(CASE WHEN p >= thr THEN 255 ELSE 0 END AS SMALLINT) AS v FROM u JOIN t ON tz = z % 64 AND tx = x % 64"""
)
def slope_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.slope_masks(_steep(spark, sf_dir), fx.thresholds(spark, sf_dir))


# Declarations, scripts, images ----------------------------------------------------------------------


@query("""WITH s AS (SELECT CAST(r_regionkey AS INT) AS seq, CAST(r_regionkey * 50 - 70 AS INT) AS lo, CAST(r_regionkey * 50 - 70 + 40 + r_regionkey * 6 AS INT) AS hi FROM region),
a AS (SELECT *, lead(lo) OVER (ORDER BY lo, seq) AS after FROM s)
SELECT 'gap' AS rule, seq, lo || ' ' || hi AS detail FROM a WHERE after > hi + 1 UNION ALL SELECT 'overlap', seq, lo || ' ' || hi FROM a WHERE after <= hi UNION ALL SELECT 'outside', seq, lo || ' ' || hi FROM a WHERE lo < -64 OR hi > 150""")
def config_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, overlaps and ranges beyond the limits in a faulty list of strata."""
    k = F.col("r_regionkey")
    rows = fx.table(spark, sf_dir, "region").select(k.cast("int").alias("seq"), (k * 50 - 70).cast("int").alias("lo"), (k * 50 - 30 + k * 6).cast("int").alias("hi"), F.lit("x").alias("terrain"), F.lit(None).cast("double").alias("slope_lo"), F.lit(None).cast("double").alias("slope_hi"))
    return config.strata_violations(rows, -64, 150)


@query()
def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build script of the example declaration."""
    return config.script_lines(spark, CONFIG)


@query(f"WITH {_LEVELS} SELECT z, x, v FROM v")
def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels written as 16-bit PNG tiles and read back."""
    keep = rounds.Rounds(fx.grid(spark, sf_dir), "png")
    tiles = keep.save(png.encoded(_levels(spark, sf_dir), "v", 16, 48), "tiles")
    return png.decoded_tiles(tiles, 48)


def _through_tiles(spark: SparkSession, cells: DataFrame, bands: str, bits: int) -> DataFrame:
    folder = f"{rounds.Rounds(cells, 'tiles').root}/tiles"
    tile_source.write(cells, folder, 24, bands, bits)
    return tile_source.read(spark, folder, 24, bands).select("z", "x", *bands.split(","))


@query(f"WITH {_LEVELS} SELECT z, x, v FROM v")
def height_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels through the data source of 16-bit tiles."""
    return _through_tiles(spark, _levels(spark, sf_dir).select("z", "x", "v"), "v", 16)


@query(f"WITH {_LEVELS} SELECT z, x, CASE WHEN v >= 20000 THEN 255 ELSE 0 END AS v FROM v")
def mask_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask of the higher ground through the data source of 8-bit tiles."""
    mask = _levels(spark, sf_dir).select("z", "x", F.when(F.col("v") >= 20000, 255).otherwise(0).alias("v"))
    return _through_tiles(spark, mask, "v", 8)


@query(f"WITH {_LEVELS} SELECT z, x, CAST(v // 256 AS INT) AS r, CAST(v % 256 AS INT) AS g, CAST((z * 7 + x * 3) % 256 AS INT) AS b FROM v")
def colour_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of the levels through the data source of 8-bit RGB tiles."""
    v = F.col("v")
    colour = _levels(spark, sf_dir).select("z", "x", F.floor(v / 256).cast("int").alias("r"), (v % 256).alias("g"), ((F.col("z") * 7 + F.col("x") * 3) % 256).alias("b"))
    return _through_tiles(spark, colour, "r,g,b", 8)


@query(f"WITH {_LEVELS} SELECT z, x, v FROM v, (SELECT greatest(4, least(256, n // 4)) AS t FROM p) WHERE z // t = 1 AND x // t >= 1")
def tiles_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of some tiles: only their files are read."""
    cells = _levels(spark, sf_dir).select("z", "x", "v")
    folder, side = f"{rounds.Rounds(cells, 'tiles').root}/tiles", fx.tile(spark, sf_dir)
    tile_source.write(cells, folder, side)
    return tile_source.read(spark, folder, side, tile_z="1:1", tile_x="1:").select("z", "x", "v")


@query()
def uniform_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and extremes of counter-based uniform draws over all orders."""
    u = fx.table(spark, sf_dir, "orders").select(uniform(42, "u", F.col("o_orderkey")).alias("u"))
    return u.agg(F.round(F.avg("u"), 6).alias("mean"), F.min("u").alias("low"), F.max("u").alias("high"))
