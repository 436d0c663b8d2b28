"""The whole hydrology of a height field: filling, drainage, incision, channels and their beds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import channels
from .accumulate import drainage
from .flood import fill
from .grid import gradient
from .hydro import channel_class, flow, incision
from .rounds import Rounds


def routed(grid: DataFrame, spacing: float = 1.0, k_erosion: float = 0.01, tile: int = 256, least_area: float = 100.0) -> DataFrame:
    """(z, x, h, w, area, gradient, dh, channel) of every cell, its nearest channel, and the river bed.

    Cells that drain ``least_area`` cells or more are channels. The bed is the filled surface after
    incision, cut by the cross section of the nearest channel's class, depth and width (``cut``).
    """
    keep = Rounds(grid, "routed")
    directed = keep.save(flow(fill(grid, tile), spacing, tile), "directed")
    field = directed.select("z", "x", "h", "w").join(drainage(directed, tile), ["z", "x"])
    slope = gradient(field.select("z", "x", F.col("w").alias("h")), spacing).select("z", "x", F.sqrt(F.col("gx") * F.col("gx") + F.col("gz") * F.col("gz")).alias("gradient"))
    out = keep.save(field.join(slope, ["z", "x"]).withColumns({"dh": incision(k_erosion), "channel": channel_class()}), "field")
    cut = channels.carve(channels.nearest_channel(out, least_area))
    return cut.withColumn("bed", F.col("w") + F.col("dh") + F.col("cut"))
