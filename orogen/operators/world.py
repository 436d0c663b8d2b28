"""Levels, strata, layers and the assembled world, as columns on a height map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import clamp
from .rounds import Rounds


def quantise(h: Column, low: float = -64.0, high: float = 320.0, most: int = 65535) -> Column:
    """Height to an unsigned level, half away from zero, clamped to the range."""
    return F.round(clamp((h - low) / (high - low), 0.0, 1.0) * most).cast("int")


def remap(v: Column, from_low: float = 0, from_high: float = 65535, to_low: float = -64, to_high: float = 320) -> Column:
    """The linear map of one range of levels to another."""
    return to_low + (v - from_low) * (float(to_high - to_low) / float(from_high - from_low))


def rescale(height_map: DataFrame, percent: int) -> DataFrame:
    """Horizontal scale: 100 is the identity; 100 n repeats cells n times; 100 / n averages n x n cells."""
    if percent == 100:
        return height_map
    if percent > 100 and percent % 100 == 0:
        n = percent // 100
        steps = F.sequence(F.lit(0), F.lit(n - 1))
        out = height_map.withColumn("dz", F.explode(steps)).withColumn("dx", F.explode(steps))
        return out.select((F.col("z") * n + F.col("dz")).alias("z"), (F.col("x") * n + F.col("dx")).alias("x"), "v")
    if percent > 0 and 100 % percent == 0:
        n = 100 // percent
        return height_map.groupBy(F.expr(f"z div {n}").cast("int").alias("z"), F.expr(f"x div {n}").cast("int").alias("x")).agg(F.round(F.avg("v")).cast("int").alias("v"))
    raise ValueError(f"scale {percent} is neither a multiple nor a divisor of 100")


def create_world(height_map: DataFrame, scale: int = 100, levels: tuple[float, float, float, float] = (0, 65535, -64, 320), water_level: int = 62, lower: int = -64, upper: int = 320) -> DataFrame:
    """(z, x, h, submerged): remapped and held within the build limits; below water is submerged."""
    h = clamp(remap(F.col("v"), *levels), float(lower), float(upper))
    return rescale(height_map, scale).select("z", "x", h.alias("h")).withColumn("submerged", F.col("h") < water_level)


def require_layers(requested: list[str], layers: list[str]) -> None:
    missing = sorted(set(requested) - set(layers))
    if missing:
        raise ValueError(f"no such layer: {', '.join(missing)}")


def find_layer(names: DataFrame, layers: DataFrame) -> DataFrame:
    """Looks names (layer) up among layers; an unknown name raises when the row is read."""
    met = names.join(layers.withColumn("known", F.lit(True)), "layer", "left")
    return met.withColumn("layer", F.when(F.col("known"), F.col("layer")).otherwise(F.raise_error(F.concat(F.lit("no such layer: "), F.coalesce("layer", F.lit("null")))))).drop("known")


def apply_mask(world: DataFrame, mask: DataFrame, layer: str, low: int = 128, high: int = 255, level: int = 1) -> DataFrame:
    """Adds a column named for the layer: ``level`` where the mask lies in [low, high], else 0."""
    met = world.join(mask.select("z", "x", F.col("v").alias("mask_v")), ["z", "x"], "left")
    return met.withColumn(layer, F.when(F.col("mask_v").between(low, high), level).otherwise(0)).drop("mask_v")


def stratum(h: Column, strata: list[dict], slope: Column | None = None, value: str = "terrain") -> Column:
    """The first stratum whose inclusive range holds floor(h), and whose slope limit holds the slope.

    Strata are parameters, so they become one CASE; without a match the value is null.
    """
    if not strata:
        return F.lit(None).cast("string")
    level, out = F.floor(h), None
    for s in strata:
        holds = level.between(s["lo"], s["hi"])
        if slope is not None and s.get("slope_lo") is not None:
            holds = holds & slope.between(s["slope_lo"], s["slope_hi"])
        out = F.when(holds, F.lit(s[value])) if out is None else out.when(holds, F.lit(s[value]))
    return out


def strata_by_level(strata: DataFrame, levels: DataFrame, width: int = 16, limits: tuple[str, ...] = ()) -> DataFrame:
    """(level, limits, s): the strata that can be first somewhere on one of ``levels`` (level, distinct); s holds seq and terrain.

    Ranges are dealt to the bins of ``width`` levels that they touch and meet the levels there. Of a level's strata with the
    same limits only the first can be a cell's, and none after the first without limits.
    """
    bins = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))
    held = strata.filter("lo <= hi").select("seq", "lo", "hi", "terrain", *(F.when(F.col(limits[0]).isNotNull(), F.col(c)).alias(c) for c in limits), bins.alias("bin"))
    held = held.join(levels.withColumn("bin", F.floor(F.col("level") / width)), "bin").filter("level BETWEEN lo AND hi")
    held = held.groupBy("level", *limits).agg(F.min(F.struct("seq", "terrain")).alias("s"))
    if not limits:
        return held
    last = F.min(F.when(F.col(limits[0]).isNull(), F.col("s"))).over(Window.partitionBy("level"))
    return held.withColumn("last", last).filter("last IS NULL OR s <= last").drop("last")


def strata_join(cells: DataFrame, strata: DataFrame, width: int = 16, slope: str | None = None) -> DataFrame:
    """Adds seq and terrain: the first stratum by seq that holds floor(h), and the slope within its limits if it has any.

    ``strata`` is a table of any size (seq, lo, hi, terrain, and with ``slope`` also slope_lo, slope_hi). It is reduced to
    each level's first strata before cells meet it by equality of levels: a cell meets a row for each pair of limits at
    most, however many strata hold its level. A level that a third of the cells share is split by the skew join. Cells that
    none holds keep nulls, as do null and NaN heights; empty ranges hold nothing. A cell must occur once.
    """
    cells = Rounds(cells, "strata").save(cells, "cells")
    level = F.when(~F.isnan("h"), F.floor("h")).alias("level")
    asked = cells.select("z", "x", level, *([F.col(slope).alias("steepness")] if slope else []))
    held = strata_by_level(strata, asked.filter("level IS NOT NULL").select("level").distinct(), width, ("slope_lo", "slope_hi") if slope else ())
    met = asked.join(held, "level")
    if slope:
        met = met.filter("slope_lo IS NULL OR steepness BETWEEN slope_lo AND slope_hi")
    first = met.groupBy("z", "x").agg(F.min("s").alias("s")).select("z", "x", "s.seq", "s.terrain")
    return cells.join(first, ["z", "x"], "left")


def column_table(world: DataFrame, strata: list[dict], layers: list[str]) -> DataFrame:
    """(z, x, y_top, terrain, layers): what an exporter of voxel columns reads."""
    on = F.filter(F.array(*[F.when(F.col(n) > 0, F.lit(n)) for n in layers]), lambda n: n.isNotNull()) if layers else F.array().cast("array<string>")
    slope = F.col("slope_deg") if "slope_deg" in world.columns else None
    return world.select("z", "x", F.floor("h").cast("int").alias("y_top"), stratum(F.col("h"), strata, slope).alias("terrain"), on.alias("layers"))


def nearest_block(r: Column, g: Column, b: Column, palette: list[dict]) -> Column:
    """The palette entry nearest in RGB, the earlier one on ties.

    The palette is a parameter; each pixel takes a minimum over it within its row.
    """
    square = lambda d: d * d
    entries = [F.struct((square(r - p["r"]) + square(g - p["g"]) + square(b - p["b"])).alias("d2"), F.lit(k).alias("seq"), F.lit(p["block"]).alias("block")) for k, p in enumerate(palette)]
    return F.array_min(F.array(*entries))["block"]


def slope_masks(field: DataFrame, thresholds: DataFrame, side: int = 64) -> DataFrame:
    """(z, x, feature, v): dithered masks of foliage and rock by slope."""
    from ..functions.responses import foliage_slope, rock, suitability
    from .dither import mask

    theta = F.col("slope_deg")
    return mask(suitability(field, {"foliage": foliage_slope(theta), "rock": rock(theta)}), thresholds, side, side).select("z", "x", "feature", "v")
