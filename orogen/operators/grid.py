"""Height fields: one row a cell, with keys z and x; stencils and derived fields.

A row or column of the grid is one window partition, so a stencil costs one
exchange by z and one by x, and no partition is longer than the grid's side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def along_x() -> WindowSpec:
    return Window.partitionBy("z").orderBy("x")


def along_z() -> WindowSpec:
    return Window.partitionBy("x").orderBy("z")


def blank(spark: SparkSession, rows: int = 4096, columns: int | None = None) -> DataFrame:
    """A grid of zeros."""
    columns = columns or rows
    at = spark.range(rows * columns)
    return at.select(F.expr(f"cast(id div {columns} as int)").alias("z"), F.expr(f"cast(id % {columns} as int)").alias("x"), F.lit(0.0).cast("float").alias("h"))


def density(grid: DataFrame) -> DataFrame:
    """One row: cells, distinct keys, width and height; dense when all agree."""
    keys = grid.groupBy("z", "x").agg(F.count("*").alias("n"))
    out = keys.agg(F.sum("n").alias("cells"), F.count("*").alias("keys"), (F.max("x") - F.min("x") + 1).cast("long").alias("width"), (F.max("z") - F.min("z") + 1).cast("long").alias("height"))
    return out.withColumn("dense", (F.col("cells") == F.col("keys")) & (F.col("keys") == F.col("width") * F.col("height")))


def forward_difference(grid: DataFrame) -> DataFrame:
    """Adds dx_pos and dz_pos: the next cell's height less this one's; null at the far border."""
    return grid.withColumn("dx_pos", F.lead("h").over(along_x()) - F.col("h")).withColumn("dz_pos", F.lead("h").over(along_z()) - F.col("h"))


def neighbours(grid: DataFrame) -> DataFrame:
    """Adds the four direct neighbours' heights: west, east, north and south, null outside."""
    return grid.withColumns({"west": F.lag("h").over(along_x()), "east": F.lead("h").over(along_x())}).withColumns({"north": F.lag("h").over(along_z()), "south": F.lead("h").over(along_z())})


def _central(before: str, after: str, spacing: float) -> Column:
    h = F.col("h")
    step = F.when(F.col(before).isNull() | F.col(after).isNull(), F.lit(float(spacing))).otherwise(F.lit(2.0 * spacing))
    return (F.coalesce(after, h) - F.coalesce(before, h)) / step


def gradient(grid: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Adds gx and gz: central differences inside, one-sided ones at the border."""
    around = neighbours(grid)
    out = around.withColumns({"gx": _central("west", "east", spacing), "gz": _central("north", "south", spacing)})
    return out.drop("west", "east", "north", "south")


def slope_deg() -> Column:
    return F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gz") * F.col("gz"))))


def aspect_rad() -> Column:
    return F.atan2(-F.col("gx"), F.col("gz"))


def derived(grid: DataFrame, spacing: float = 1.0, curvature_scale: float = 1.0) -> DataFrame:
    """Adds gx, gz, slope_deg, aspect_rad, the downhill unit vector and curvature in [-1, 1].

    Flat cells have no downhill direction (null). Curvature is the five-point
    Laplacian over ``curvature_scale``, clamped; missing neighbours count as level.
    """
    around = neighbours(grid)
    out = around.withColumns({"gx": _central("west", "east", spacing), "gz": _central("north", "south", spacing)})
    h = F.col("h")
    laplacian = F.coalesce("west", h) + F.coalesce("east", h) + F.coalesce("north", h) + F.coalesce("south", h) - 4.0 * h
    norm = F.sqrt(F.col("gx") * F.col("gx") + F.col("gz") * F.col("gz"))
    out = out.withColumns(
        {
            "slope_deg": slope_deg(),
            "aspect_rad": aspect_rad(),
            "down_x": F.when(norm > 0, -F.col("gx") / norm),
            "down_z": F.when(norm > 0, -F.col("gz") / norm),
            "curvature": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), laplacian / (curvature_scale * spacing))),
        }
    )
    return out.drop("west", "east", "north", "south")


def moisture(field: DataFrame, area: str = "area") -> DataFrame:
    """Adds moisture in [0, 1]: the logarithm of drainage area over that of the largest."""
    most = field.agg(F.max(area)).first()[0] or 1.0
    top = math.log(most) if most > 1 else 1.0
    return field.withColumn("moisture", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log(F.greatest(F.col(area), F.lit(1.0))) / top)))


def cliff_distance(field: DataFrame, critical_deg: float = 38.0) -> DataFrame:
    """Adds d: steps along rows and columns to the nearest cell steeper than the angle.

    Two passes of running minima give the exact city-block distance; null without any cliff.
    """
    ahead_x, behind_x = along_x().rowsBetween(Window.unboundedPreceding, 0), along_x().rowsBetween(0, Window.unboundedFollowing)
    ahead_z, behind_z = along_z().rowsBetween(Window.unboundedPreceding, 0), along_z().rowsBetween(0, Window.unboundedFollowing)
    cliff = F.when(F.col("slope_deg") > critical_deg, F.col("x"))
    out = field.withColumn("row_d", F.least(F.col("x") - F.max(cliff).over(ahead_x), F.min(cliff).over(behind_x) - F.col("x")))
    near = F.least(F.col("z") + F.min(F.col("row_d") - F.col("z")).over(ahead_z), F.min(F.col("row_d") + F.col("z")).over(behind_z) - F.col("z"))
    return out.withColumn("d", near).drop("row_d")


def talus_apron(base: Column, distance: Column, critical_deg: float = 38.0, beta: float = 0.01) -> Column:
    """The parabolic scree profile at a distance from the cliff's foot."""
    return base + distance * math.tan(math.radians(critical_deg)) - beta * distance * distance
