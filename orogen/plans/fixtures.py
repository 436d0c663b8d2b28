"""Adapters: terrain inputs from the star-schema tables, in Spark and in DuckDB SQL.

Grids are square. Their side is the power of two that leaves a cell 14 to 55 fact rows (16, 64 and
128 at the three test sizes) and grows with the table without bound; neighbouring
cells lie SPACING blocks apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACING = 64
ROOT = 3.7  # the least root of rows a cell


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(spark: SparkSession, sf_dir: str) -> int:
    rows = table(spark, sf_dir, "lineitem").count()
    return max(2, 1 << max(0, math.floor(math.log2(max(1.0, math.sqrt(rows) / ROOT)))))


def tile(spark: SparkSession, sf_dir: str) -> int:
    """A quarter of the side, 256 at most, so that every grid has several tiles each way."""
    return max(4, min(256, side(spark, sf_dir) // 4))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, x, h): a blend of each cell's lowest and highest price."""
    n = side(spark, sf_dir)
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % n).cast("int").alias("z"), (F.col("l_orderkey") % n).cast("int").alias("x"))
    cells = cells.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    blend = (F.col("lo") * (2 * n - 2 - F.col("x") - F.col("z")) + F.col("hi") * (F.col("x") + F.col("z"))) / (2 * n - 2)
    return cells.select("z", "x", (-64 + 384 * (blend - 900) / 104100).alias("h"))


GRID = f"""p AS (SELECT greatest(2, CAST(pow(2, floor(log2(greatest(1.0, sqrt(count(*)) / {ROOT})))) AS BIGINT)) AS n FROM lineitem),
g AS (SELECT z, x, -64 + 384 * ((lo * (2 * n - 2 - x - z) + hi * (x + z)) / (2 * n - 2) - 900) / 104100 AS h
      FROM (SELECT CAST(l_partkey % n AS INT) AS z, CAST(l_orderkey % n AS INT) AS x, n,
                   min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem, p GROUP BY ALL))"""

AROUND = """n AS (SELECT z, x, h, lag(h) OVER (PARTITION BY z ORDER BY x) AS w, lead(h) OVER (PARTITION BY z ORDER BY x) AS e,
             lag(h) OVER (PARTITION BY x ORDER BY z) AS nn, lead(h) OVER (PARTITION BY x ORDER BY z) AS ss FROM g)"""

GRADIENT = f"""{AROUND},
d AS (SELECT *, (coalesce(e, h) - coalesce(w, h)) / (CASE WHEN e IS NULL OR w IS NULL THEN {SPACING}.0 ELSE {2 * SPACING}.0 END) AS gx,
             (coalesce(ss, h) - coalesce(nn, h)) / (CASE WHEN ss IS NULL OR nn IS NULL THEN {SPACING}.0 ELSE {2 * SPACING}.0 END) AS gz FROM n),
f AS (SELECT *, degrees(atan(sqrt(gx * gx + gz * gz))) AS slope_deg FROM d)"""


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tz, tx, thr): a 64 x 64 lattice of fractions that both engines compute alike."""
    at = spark.range(64 * 64)
    tz, tx = (F.col("id") / 64).cast("int"), (F.col("id") % 64).cast("int")
    return at.select(tz.alias("tz"), tx.alias("tx"), (((tx * 1103 + tz * 2741) % 4093).cast("double") / 4093).alias("thr"))


THRESHOLDS = """t AS (SELECT a.i AS tz, b.i AS tx, CAST((b.i * 1103 + a.i * 2741) % 4093 AS DOUBLE) / 4093 AS thr
      FROM range(64) a(i), range(64) b(i))"""


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridges (inst_id, cx, cz, angle, height, length, sigma) from the suppliers."""
    k = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .select(
            k.cast("int").alias("inst_id"),
            ((k * 37) % 64).cast("double").alias("cx"),
            ((k * 53) % 64).cast("double").alias("cz"),
            ((k % 12).cast("double") / 4).alias("angle"),
            (180 + (k * 29) % 121).cast("double").alias("height"),
            (12 + (k * 7) % 15).cast("double").alias("length"),
            F.lit(2.0).alias("sigma"),
        )
    )


INSTANCES = """i AS (SELECT CAST(s_suppkey AS INT) AS inst_id, CAST((s_suppkey * 37) % 64 AS DOUBLE) AS cx, CAST((s_suppkey * 53) % 64 AS DOUBLE) AS cz,
       CAST(s_suppkey % 12 AS DOUBLE) / 4 AS angle, CAST(180 + (s_suppkey * 29) % 121 AS DOUBLE) AS height,
       CAST(12 + (s_suppkey * 7) % 15 AS DOUBLE) AS length, CAST(2 AS DOUBLE) AS sigma FROM supplier)"""


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks (inst_id, cx, cz, h_peak, radius, gamma, alpha, k) from the suppliers."""
    base = instances(spark, sf_dir)
    return base.select("inst_id", "cx", "cz", F.col("height").alias("h_peak"), F.col("length").alias("radius"), F.lit(1.8).alias("gamma"), F.lit(0.2).alias("alpha"), (3 + F.col("inst_id") % 2).alias("k"))


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spline_id, seq, x, z): one spline through the regions."""
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(F.lit(0).alias("spline_id"), k.cast("int").alias("seq"), (k * 15 + 2).cast("double").alias("x"), ((k * 37) % 64).cast("double").alias("z"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spline_id, seq, x, z): a spline a nation through its customers."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("spline_id"), k.alias("seq"), ((k * 37) % 512).cast("double").alias("x"), ((k * 53) % 512).cast("double").alias("z"))


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spline_id, px, pz to sx, sz): four points a customer."""
    k = F.col("c_custkey")
    at = {f"{n}{a}": ((k * (11 + 6 * i) + 13 * j) % (40 + 8 * i)).cast("double") for i, n in enumerate("pqrs") for j, a in enumerate("xz")}
    return table(spark, sf_dir, "customer").select(k.cast("int").alias("spline_id"), *(v.alias(n) for n, v in at.items()))


CONTROLS = "b AS (SELECT CAST(c_custkey AS INT) AS spline_id, " + ", ".join(f"CAST((c_custkey * {11 + 6 * i} + {13 * j}) % {40 + 8 * i} AS DOUBLE) AS {n}{a}" for i, n in enumerate("pqrs") for j, a in enumerate("xz")) + " FROM customer)"


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, lo, hi, terrain, slope_lo, slope_hi): a stratum a part; every third has a slope limit."""
    k = F.col("p_partkey")
    lo = (k * 37) % 384 - 64
    limit = lambda v: F.when(k % 3 == 0, F.lit(v))
    return table(spark, sf_dir, "part").select(k.alias("seq"), lo.alias("lo"), (lo + F.col("p_size") % 8).alias("hi"), F.col("p_brand").alias("terrain"), limit(0.0).alias("slope_lo"), limit(30.0).alias("slope_hi"))


STRATA = """st AS (SELECT p_partkey AS seq, (p_partkey * 37) % 384 - 64 AS lo, (p_partkey * 37) % 384 - 64 + p_size % 8 AS hi, p_brand AS terrain,
       CASE WHEN p_partkey % 3 = 0 THEN 0.0 END AS slope_lo, CASE WHEN p_partkey % 3 = 0 THEN 30.0 END AS slope_hi FROM part)"""
