"""Least-cost breaching: every pit gets a channel at its own height to lower ground.

Heights have one order: (h, z, x). A pit is a cell inside the world without a neighbour before it in that order. Its
outlet is a cell before it, or one of the world's border; its way there costs what must be cut to the pit's height,
the sum of max(0, h - h of the pit) over the cells between. After cutting all ways, water runs from every
pit to lower ground and, pit by pit, to the border.

All pits search at once, in rounds over tiles. A round takes the tiles that have open labels (pit, cell,
cost), runs a priority queue for each pit within the tile, and gives outlets found and labels of
cells next to the tile. A label stays open only if it is the cheapest of its pit and cell so far and cheaper than the
pit's best outlet, so searches end as soon as they can. Labels know the label they came from. The
ways are then traced back from the outlets over the tiles, and each tile cuts its cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Rounds, cell_id, directions, extent

_LABEL = "pit long, height double, z int, x int, cost double, from_z int, from_x int"
_FOUND = f"kind string, {_LABEL}"


class Ground:
    """Heights of a tile and of the cells around it."""

    def __init__(self, cells: pa.Table, tz: int, tx: int, tile: int, ends: tuple[int, int, int, int], eight: bool):
        z, x, h = (cells.column(c).to_pylist() for c in ("z", "x", "h"))
        self.height = {(a, b): v for a, b, v in zip(z, x, h, strict=True)}
        self.ends, self.steps = ends, directions(eight)
        self.low, self.high = (tz * tile, tx * tile), (tz * tile + tile, tx * tile + tile)

    def own(self, z: int, x: int) -> bool:
        return self.low[0] <= z < self.high[0] and self.low[1] <= x < self.high[1]

    def search(self, pit: tuple[float, int, int], sources: list[tuple[float, int, int, int, int]], most: float, want: tuple[int, int] | None = None):  # noqa: ANN201
        """Cells settled in the tile with (cost, cell before), the cheapest outlet, and labels beyond; stops at ``want``.

        All sources are searched from at once: a cell is settled once, whatever their number. An outlet is
        (cost, z, x, number of its source), a label beyond (cost, number of its source).
        """
        floor, done, beyond, outlet = pit[0], {}, {}, None
        queue = [(cost, z, x, number, None, None) for number, (cost, z, x, *_) in enumerate(sources)]
        heapq.heapify(queue)
        reached: dict[tuple[int, int], float] = {}
        top, bottom, left, right = self.ends
        while queue:
            cost, z, x, source, before_z, before_x = heapq.heappop(queue)
            if cost > most or outlet is not None and cost > outlet[0]:
                break
            if (z, x) in done:
                continue
            if not self.own(z, x):
                if (z, x) not in beyond:
                    beyond[z, x] = cost, source
                continue
            done[z, x] = cost, before_z, before_x
            if (z, x) == want:
                break
            here = self.height[z, x]
            if (here, z, x) < pit or ((z in (top, bottom) or x in (left, right)) and (z, x) != pit[1:]):
                outlet = outlet or (cost, z, x, source)
                continue
            for dz, dx in self.steps:
                a, b = z + dz, x + dx
                there = self.height.get((a, b))
                if there is not None and (a, b) not in done:
                    # an outlet is not cut, save one of the border that is higher than the pit
                    there = cost + max(0.0, there - floor)
                    if there <= reached.get((a, b), most):
                        reached[a, b] = there
                        heapq.heappush(queue, (there, a, b, source, z, x))
        return done, outlet, beyond

    def widen(self, pit: tuple[float, int, int], sources: list[tuple[float, int, int, int, int]], most: float) -> list[tuple]:
        """(kind, cost, z, x, source's z, source's x): the tile's outlet, and labels beyond it that are cheaper."""
        sources = sorted(sources, key=lambda s: s[:3])
        _, outlet, beyond = self.search(pit, sources, most)
        best = min(most, outlet[0]) if outlet else most
        rows = [("outlet", *outlet[:3], *sources[outlet[3]][1:3])] if outlet else []
        return rows + [("open", cost, z, x, *sources[number][1:3]) for (z, x), (cost, number) in beyond.items() if cost < best]


def _by_tile(cells: DataFrame, labels: DataFrame, tile: int, kernel: Callable[[pa.Table, pa.Table, int, int], pa.Table], schema: str) -> DataFrame:
    """Runs a kernel on the tiles that have labels."""
    at = {"tile_z": F.floor(F.col("z") / tile).cast("int"), "tile_x": F.floor(F.col("x") / tile).cast("int")}
    labels = labels.withColumns(at)
    asked = cells.join(labels.select("tile_z", "tile_x").distinct(), ["tile_z", "tile_x"], "left_semi")

    def run(key: tuple, ground: pa.Table, asks: pa.Table) -> pa.Table:
        return kernel(ground, asks, key[0].as_py(), key[1].as_py())

    return asked.groupBy("tile_z", "tile_x").cogroup(labels.groupBy("tile_z", "tile_x")).applyInArrow(run, schema)


def _pit(number: int, height: float) -> tuple[float, int, int]:
    z = (number + (1 << 31)) >> 32
    return height, z, number - (z << 32)


def _grouped(asks: pa.Table) -> dict[tuple[int, float], list[tuple]]:
    out: dict[tuple[int, float], list[tuple]] = {}
    for row in zip(*(asks.column(c).to_pylist() for c in ("pit", "height", "cost", "z", "x", "from_z", "from_x", "most")), strict=True):
        out.setdefault(row[:2], []).append(row[2:])
    return out


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def breach(grid: DataFrame, tile: int = 256, eight: bool = False) -> tuple[DataFrame, DataFrame]:
    """The cut grid (z, x, h, cut) and the pits (pit, z, x, height, cost) with the cost of their ways.

    Null and NaN heights are walls, which stay as they are. A pit that walls enclose has no way and a null cost.
    An empty grid gives empty tables.
    """
    keep = Rounds(grid, "breach")
    whole = grid.select("z", "x", F.col("h").cast("double").alias("h"))
    wall = F.col("h").isNull() | F.isnan("h")
    ends = extent(whole) or (0, 0, 0, 0)
    reach = lambda axis: F.explode(F.sequence(F.floor((F.col(axis) - 1) / tile).cast("int"), F.floor((F.col(axis) + 1) / tile).cast("int")))
    cells = keep.save(whole.filter(~wall).withColumn("tile_z", reach("z")).withColumn("tile_x", reach("x")), "cells")
    top, bottom, left, right = ends

    def pits_of(key: tuple, table: pa.Table) -> pa.Table:
        ground = Ground(table, key[0].as_py(), key[1].as_py(), tile, ends, eight)
        rows = []
        for (z, x), h in ground.height.items():
            if ground.own(z, x) and z not in (top, bottom) and x not in (left, right):
                near = ((z + dz, x + dx) for dz, dx in ground.steps)
                if not any((ground.height[c], *c) < (h, z, x) for c in near if c in ground.height):
                    rows.append((cell_id(z, x), h, z, x, 0.0, None, None))
        return _table(rows, _LABEL)

    def widen(table: pa.Table, asks: pa.Table, tz: int, tx: int) -> pa.Table:
        ground, rows = Ground(table, tz, tx, tile, ends, eight), []
        for (number, height), sources in _grouped(asks).items():
            for kind, cost, z, x, from_z, from_x in ground.widen(_pit(number, height), [s[:5] for s in sources], min(s[5] for s in sources)):
                rows.append((kind, number, height, z, x, cost, from_z, from_x))
        return _table(rows, _FOUND)

    pits = keep.save(cells.groupBy("tile_z", "tile_x").applyInArrow(pits_of, _LABEL), "pits")
    open_labels, turn = pits, 0
    labels, outlets = pits, keep.spark.createDataFrame([], _LABEL)
    cheapest = lambda df, *by: df.groupBy(*by).agg(F.min(F.struct("cost", "z", "x", "from_z", "from_x", "height")).alias("m")).select(*by, *(f"m.{c}" for c in ("cost", "z", "x", "from_z", "from_x", "height") if c not in by))
    while True:
        best = outlets.select("pit", F.col("cost").alias("most"))
        asked = open_labels.join(best, "pit", "left").fillna(float("inf"), ["most"]).filter("cost < most")
        found = keep.save(_by_tile(cells, asked, tile, widen, _FOUND), f"found-{turn}")
        names = [f.split()[0] for f in _LABEL.split(", ")]
        outlets = keep.save(cheapest(outlets.unionByName(found.filter("kind = 'outlet'").select(*names)), "pit").select(*names), f"outlets-{turn}")
        best = outlets.select("pit", F.col("cost").alias("most"))
        fresh = cheapest(found.filter("kind = 'open'").select(*names), "pit", "z", "x").select(*names)
        known = labels.groupBy("pit", "z", "x").agg(F.min("cost").alias("known"))
        fresh = fresh.join(known, ["pit", "z", "x"], "left").filter("known is null or cost < known")
        open_labels = keep.save(fresh.join(best, "pit", "left").filter("most is null or cost < most").select(*names), f"open-{turn}")
        turn += 1
        if not open_labels.limit(1).count():
            break
        # of a pit and cell, the cheapest label stays
        labels = keep.save(cheapest(labels.unionByName(open_labels), "pit", "z", "x").select(*names), f"labels-{turn}")

    # ways, from the outlets back: in each tile from its label to the cell where the way left
    path = "pit long, height double, z int, x int, from_z int, from_x int, cost double, most double"
    legs = outlets.select("pit", "height", "z", "x", "from_z", "from_x")
    cuts, turn = [], 0
    while True:
        start = labels.select("pit", F.col("z").alias("from_z"), F.col("x").alias("from_x"), F.col("from_z").alias("next_z"), F.col("from_x").alias("next_x"))
        legs = keep.save(legs.join(start, ["pit", "from_z", "from_x"]), f"legs-{turn}")
        cuts.append(legs.select("pit", "height", "z", "x", "from_z", "from_x"))
        legs = legs.filter("next_z is not null").select("pit", "height", F.col("from_z").alias("z"), F.col("from_x").alias("x"), F.col("next_z").alias("from_z"), F.col("next_x").alias("from_x"))
        turn += 1
        if not legs.limit(1).count():
            break
    ways = cuts[0]
    for more in cuts[1:]:
        ways = ways.unionByName(more)

    def cut(table: pa.Table, asks: pa.Table, tz: int, tx: int) -> pa.Table:
        ground, low = Ground(table, tz, tx, tile, ends, eight), {}
        for number, height, to_z, to_x, z, x in zip(*(asks.column(c).to_pylist() for c in ("pit", "height", "to_z", "to_x", "z", "x")), strict=True):
            # the cell where the way leaves may lie beyond the tile; it is then settled from within
            wider = Ground.__new__(Ground)
            wider.height, wider.ends, wider.steps = ground.height, ground.ends, ground.steps
            wider.own = lambda a, b, to=(to_z, to_x): ground.own(a, b) or (a, b) == to
            done, _, _ = wider.search(_pit(number, height), [(0.0, z, x, None, None)], np.inf, (to_z, to_x))
            at = (to_z, to_x)
            while at[0] is not None:
                if ground.height[at] > height:
                    low[at] = min(low.get(at, np.inf), height)
                at = done[at][1:]
        return _table([(z, x, v) for (z, x), v in low.items()], "z int, x int, low double")

    asks = ways.select("pit", "height", F.col("z").alias("to_z"), F.col("x").alias("to_x"), F.col("from_z").alias("z"), F.col("from_x").alias("x"))
    lowered = keep.save(_by_tile(cells, asks, tile, cut, "z int, x int, low double"), "lowered")
    lowered = lowered.groupBy("z", "x").agg(F.min("low").alias("low"))
    surface = whole.join(lowered, ["z", "x"], "left").select("z", "x", F.coalesce("low", "h").alias("h"), F.when(F.col("low").isNotNull(), F.col("h") - F.col("low")).otherwise(F.lit(0.0)).alias("cut"))
    costs = pits.select("pit", "z", "x", "height").join(outlets.select("pit", "cost"), "pit", "left")
    return surface, costs
