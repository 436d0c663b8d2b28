"""Hydrology: flow directions, channels along receivers, incision and cross sections.

Depressions are filled in ``flood``, areas summed in ``accumulate``; both take two passes over the grid by tiles
and solve what lies between on the tiles' edges. Least-cost breaching is in ``breaching``, distances to channels
and carving in ``channels``, all steps in a row in ``routing``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import DIRECTIONS, Rounds
from .tiles import tiled


def flow(filled: DataFrame, spacing: float = 1.0, tile: int = 256) -> DataFrame:
    """Adds receivers k1, k2 (eighths of a turn, -1 for none) and their shares p1, p2.

    Flow leaves along -grad w, divided between the two neighbouring directions by angle.
    Only receivers below the cell in the order (w, z, x) count, which makes the graph
    acyclic over flats; without one, the lowest such direct neighbour takes all.
    """

    def kernel(w: np.ndarray, own: np.ndarray, z0: int, x0: int) -> dict[str, np.ndarray]:
        rows, columns = w.shape
        wide = np.pad(w, 1, constant_values=np.nan)
        near = np.stack([wide[1 + a : 1 + a + rows, 1 + b : 1 + b + columns] for a, b in DIRECTIONS])
        there = ~np.isnan(near)
        later = np.array([(a, b) < (0, 0) for a, b in DIRECTIONS])[:, None, None]  # a neighbour before in (z, x)
        below = there & ((near < w) | ((near == w) & later))

        def slope(forward: int, back: int) -> np.ndarray:
            f, g = np.where(there[forward], near[forward], w), np.where(there[back], near[back], w)
            return (f - g) / np.where(there[forward] & there[back], 2 * spacing, spacing)

        gx, gz = slope(0, 4), slope(2, 6)
        turn = np.mod(np.arctan2(-gz, -gx) / (np.pi / 4), 8)
        first = np.floor(turn).astype(int) % 8
        share = turn - np.floor(turn)
        second = (first + 1) % 8
        take = lambda k: np.take_along_axis(below, k[None], 0)[0]
        level = (gx == 0) & (gz == 0)
        p1, p2 = np.where(take(first) & ~level, 1 - share, 0.0), np.where(take(second) & ~level, share, 0.0)
        total = p1 + p2
        lowest = np.where(below[::2], near[::2], np.inf)
        spare = lowest.argmin(0) * 2
        alone = (total == 0) & np.isfinite(lowest.min(0))
        k1, k2 = np.where(p1 > 0, first, -1), np.where(p2 > 0, second, -1)
        scale = np.where(total > 0, total, 1.0)
        return {"k1": np.where(alone, spare, k1), "p1": np.where(alone, 1.0, p1 / scale), "k2": np.where(alone, -1, k2), "p2": np.where(alone, 0.0, p2 / scale)}

    out = tiled(filled.select("z", "x", "w"), kernel, ["w"], "z int, x int, k1 int, p1 double, k2 int, p2 double", tile, 1)
    return filled.join(out, ["z", "x"])


def breach(directed: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(z, x, h): lowers cells along the main receiver's path so that no step goes up.

    A cell becomes as low as the lowest cell that drains through it: minima move
    down the receiver tree, and pointers double each round.
    """
    keep = Rounds(directed, "breach")
    step = lambda axis: F.element_at(F.array(*[F.lit(d[axis]) for d in DIRECTIONS]), F.greatest(F.col("main"), F.lit(0)) + 1)
    main = F.when(F.col("p1") >= F.col("p2"), F.col("k1")).otherwise(F.col("k2"))
    tree = directed.withColumn("main", main).select("z", "x", "h", "main")
    state = tree.select("z", "x", F.col("h").alias("low"), F.when(F.col("main") >= 0, F.col("z") + step(0)).alias("to_z"), F.when(F.col("main") >= 0, F.col("x") + step(1)).alias("to_x"))
    state = keep.save(state, "start")
    for turn in range(most_rounds):
        arrived = state.filter("to_z is not null").groupBy(F.col("to_z").alias("z"), F.col("to_x").alias("x")).agg(F.min("low").alias("from_above"))
        ahead = state.select(F.col("z").alias("to_z"), F.col("x").alias("to_x"), F.col("to_z").alias("next_z"), F.col("to_x").alias("next_x"))
        new = state.join(arrived, ["z", "x"], "left").withColumn("new", F.least("low", F.coalesce("from_above", "low")))
        new = new.join(ahead, ["to_z", "to_x"], "left").select("z", "x", "new", (F.col("new") < F.col("low")).alias("changed"), F.col("next_z").alias("to_z"), F.col("next_x").alias("to_x"))
        state = keep.save(new.withColumnRenamed("new", "low"), turn)
        if not state.filter("to_z is not null").limit(1).count():
            return state.select("z", "x", F.col("low").alias("h"))
    raise RuntimeError("breaching did not settle")


def climbs(directed: DataFrame, height: str = "w") -> DataFrame:
    """One row: steps to a receiver, and how many of them go up."""
    step = lambda axis, k: F.element_at(F.array(*[F.lit(d[axis]) for d in DIRECTIONS]), F.greatest(F.col(k), F.lit(0)) + 1)
    edges = directed.select("z", "x", F.col(height).alias("here"), F.explode(F.array("k1", "k2")).alias("k")).filter("k >= 0")
    edges = edges.select("here", (F.col("z") + step(0, "k")).alias("z"), (F.col("x") + step(1, "k")).alias("x"))
    met = edges.join(directed.select("z", "x", F.col(height).alias("there")), ["z", "x"])
    return met.agg(F.count("*").alias("steps"), F.count(F.when(F.col("there") > F.col("here"), 1)).alias("climbs"))


def incision(k_erosion: float = 0.01, m: float = 0.5, n: float = 1.0, area: str = "area", slope: str = "gradient") -> Column:
    """Stream-power change of height: -K area^m slope^n."""
    return -k_erosion * F.pow(F.col(area), F.lit(m)) * F.pow(F.col(slope), F.lit(n))


def channel_class(area: str = "area") -> Column:
    """torrent below 500, river below 5000, floodplain from there."""
    a = F.col(area)
    return F.when(a < 500, "torrent").when(a < 5000, "river").otherwise("floodplain")


def cross_section(distance: Column, kind: Column, depth: Column, half_width: Column) -> Column:
    """Height change at a distance from a channel's centre; our own profiles.

    torrent: a V; river: a U of the fourth power; floodplain: a flat bed with a
    levee of a tenth of the depth beyond its edge, and bars along half of it.
    """
    r = distance / half_width
    inside = r <= 1
    vee = F.when(inside, -depth * (1.0 - r)).otherwise(0.0)
    bowl = F.when(inside, -depth * (1.0 - r * r * r * r)).otherwise(0.0)
    bar = F.when(r <= 0.5, -depth).otherwise(-0.9 * depth)
    flat = F.when(inside, bar).when(r <= 1.25, 0.1 * depth).otherwise(0.0)
    return F.when(kind == "torrent", vee).when(kind == "river", bowl).otherwise(flat)
