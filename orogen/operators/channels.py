"""The nearest channel of every cell, and river beds cut into the surface.

The exact Euclidean distance takes one pass along rows and one along columns. In a row, the nearest channel
cell before and behind comes from two running windows. In a column, each row's nearest one is a parabola in z,
and the lower envelope of these, in whole numbers, gives the nearest of all rows. Blocks of whole columns
are dealt to tasks, so no row or column is longer than the grid's side. The nearest channel's
drainage area comes along, and with it its class, depth and width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import along_x
from .hydro import channel_class, cross_section
from .rounds import extent

BLOCK_CELLS = 1 << 18  # of a block of columns


def envelope(z: np.ndarray, lift: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every ``at``, which z has the least (at - z)^2 + lift; the first z of a tie. All are whole numbers, z rising."""
    held, bounds = [], []  # parabolas, and the last whole number where each is the least
    for k, (own, up) in enumerate(zip(z.tolist(), lift.tolist(), strict=True)):
        while held:
            last = held[-1]
            meet = (own * own + up - int(z[last]) ** 2 - int(lift[last])) // (2 * (own - int(z[last])))
            if len(bounds) and meet <= bounds[-1]:
                held.pop()
                bounds.pop()
                continue
            bounds.append(meet)
            break
        held.append(k)
    return np.array(held)[np.searchsorted(np.array(bounds), at, side="left")]


def nearest_channel(field: DataFrame, least_area: float, area: str = "area") -> DataFrame:
    """Adds channel_z, channel_x, channel_area and distance (in cells) of the nearest cell with that area or more.

    Of several at one distance, the first in the order (z, x). Without any channel they are null. A cell
    must occur once; an empty grid gives an empty one.
    """
    ends = extent(field)
    side = 1 if ends is None else ends[1] - ends[0] + 1
    width = max(1, BLOCK_CELLS // side)
    here = F.when(F.col(area) >= least_area, F.struct(F.col("x").alias("at"), F.col(area).cast("double").alias("area")))
    before, behind = along_x().rowsBetween(Window.unboundedPreceding, 0), along_x().rowsBetween(0, Window.unboundedFollowing)
    rows = field.select("z", "x", F.last(here, ignorenulls=True).over(before).alias("west"), F.first(here, ignorenulls=True).over(behind).alias("east"))
    nearer = F.when(F.col("east").isNull() | (F.col("x") - F.col("west.at") <= F.col("east.at") - F.col("x")), F.col("west")).otherwise(F.col("east"))
    rows = rows.withColumn("near", nearer).select("z", "x", F.col("near.at").cast("long").alias("at"), F.col("near.area").alias("area"))

    def columns(table: pa.Table) -> pa.Table:
        t = table.sort_by([("x", "ascending"), ("z", "ascending")]).combine_chunks()
        z, x, at, area = (t.column(c).to_numpy() for c in ("z", "x", "at", "area"))
        there = ~np.isnan(at.astype(float))
        whole = np.where(there, at, 0).astype(np.int64)
        out_z, out_x, out_area = np.zeros(len(z), np.int64), np.zeros(len(z), np.int64), np.zeros(len(z))
        found = np.zeros(len(z), bool)
        edges = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(z)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            known = np.flatnonzero(there[lo:hi]) + lo
            if len(known):
                best = known[envelope(z[known].astype(np.int64), (whole[known] - x[known]) ** 2, z[lo:hi])]
                out_z[lo:hi], out_x[lo:hi], out_area[lo:hi], found[lo:hi] = z[best], whole[best], area[best], True
        gap = np.sqrt(((z - out_z) ** 2 + (x - out_x) ** 2).astype(float))
        values = {"channel_z": (out_z, pa.int32()), "channel_x": (out_x, pa.int32()), "channel_area": (out_area, pa.float64()), "distance": (gap, pa.float64())}
        return pa.table({"z": t.column("z"), "x": t.column("x")} | {n: pa.array(v, k, mask=~found) for n, (v, k) in values.items()})

    blocks = rows.withColumn("columns", F.floor(F.col("x") / width)).groupBy("columns")
    near = blocks.applyInArrow(lambda t: columns(t.drop_columns(["columns"])), "z int, x int, channel_z int, channel_x int, channel_area double, distance double")
    return field.join(near, ["z", "x"])


def bed_depth(area: Column) -> Column:
    """Depth of a channel's bed by drainage area; our own form of a regime equation."""
    return 0.5 * F.pow(area, F.lit(0.4))


def bed_half_width(area: Column) -> Column:
    """Half of a channel's width in cells, by drainage area."""
    return 1.0 + 0.1 * F.sqrt(area)


def carve(near: DataFrame) -> DataFrame:
    """Adds the nearest channel's class, depth and half width, and ``cut``: the change of height it makes here.

    Cells without a channel are not cut. The profile has its class's form up to 1.25 half widths.
    """
    area = F.col("channel_area")
    out = near.withColumns({"channel_class": F.when(area.isNotNull(), channel_class("channel_area")), "depth": bed_depth(area), "half_width": bed_half_width(area)})
    cut = cross_section(F.col("distance"), F.col("channel_class"), F.col("depth"), F.col("half_width"))
    return out.withColumn("cut", F.coalesce(cut, F.lit(0.0)))
