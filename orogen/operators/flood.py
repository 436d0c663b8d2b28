"""Depression filling in two passes over the grid, whatever the length of its paths.

1. Every tile is flooded once from its own edge. Each cell gets its level within the tile and the
   number of the edge cell that its water would leave by, its basin. Basins that touch within the tile have a pass
   between them, and those on the world's border one to the ocean.
2. Passes between tiles come from a join of the tiles' edge cells. Basins and passes are a graph of the
   size of the tiles' edges. A basin's spill level is the least possible highest pass on a way to the ocean.
3. A cell's water stands at the higher of its level and its basin's spill level.

The graph. Each basin's lowest pass leads to a parent; these trees end in the ocean or in two basins
that share their lowest pass, of which the smaller stands for the tree. A basin's spill level is then the higher of its
lowest pass and its tree's level, and trees are the basins of the next, at most half as large
graph. Roots are found by doubling. A graph of SMALL passes at most is solved by one task at once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rounds
from .rounds import Rounds, cell_id, directions, extent, rows_by_tile

OCEAN = -(1 << 62)
_PASS = "a long, b long, height double"


def basins(h: np.ndarray, eight: bool = False) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Levels of a tile flooded from its edge, each cell's basin (a flat index of an edge cell), and passes.

    Cells without a height (NaN) are walls; their level is infinite and their basin -1.
    """
    rows, columns = h.shape
    wide = columns + 2
    ground = np.full((rows + 2, wide), np.inf)
    ground[1:-1, 1:-1] = np.where(np.isnan(h), np.inf, h)
    edge = np.zeros(ground.shape, bool)
    edge[1:-1, 1:-1] = True
    edge[2:-2, 2:-2] = False
    height, waiting = ground.ravel().tolist(), (edge & np.isfinite(ground)).ravel()
    queue = [(height[i], i) for i in np.flatnonzero(waiting).tolist()]
    heapq.heapify(queue)
    waiting, basin, level = waiting.tolist(), [-1] * len(height), list(height)
    steps = [dz * wide + dx for dz, dx in directions(eight)]
    passes: dict[tuple[int, int], float] = {}
    wall = float("inf")
    while queue:
        top, i = heapq.heappop(queue)
        own = basin[i]
        if own < 0:
            own = basin[i] = i
        for s in steps:
            j = i + s
            if height[j] == wall:
                continue
            other = basin[j]
            if other < 0:
                basin[j] = own
                if top > height[j]:
                    level[j] = top
                if not waiting[j]:
                    heapq.heappush(queue, (level[j], j))
            elif other != own:
                between = (own, other) if own < other else (other, own)
                lowest = top if top > level[j] else level[j]
                if lowest < passes.get(between, wall):
                    passes[between] = lowest
    inner = lambda v: np.array(v).reshape(ground.shape)[1:-1, 1:-1]
    number = inner(basin)
    z, x = np.divmod(np.arange(ground.size), wide)
    flat = (z - 1) * columns + x - 1  # of the tile's own array
    return inner(level), np.where(number < 0, -1, flat[number]), {(int(flat[a]), int(flat[b])): v for (a, b), v in passes.items()}


def lowest_ways(passes: list[tuple[int, int, float]]) -> dict[int, float]:
    """Spill levels of a graph's basins by one priority queue from the ocean."""
    beside: dict[int, list[tuple[int, float]]] = {}
    for a, b, height in passes:
        beside.setdefault(a, []).append((b, height))
        beside.setdefault(b, []).append((a, height))
    found, queue = {}, [(-np.inf, OCEAN)]
    while queue:
        top, a = heapq.heappop(queue)
        if a in found:
            continue
        found[a] = top
        for b, height in beside.get(a, ()):
            if b not in found:
                heapq.heappush(queue, (max(top, height), b))
    return found


def spill_levels(passes: DataFrame, keep: Rounds, small: int) -> DataFrame:
    """(basin, spill): of every basin with a way to the ocean."""

    def at_once(table: pa.Table) -> pa.Table:
        found = lowest_ways(list(zip(*(table.column(c).to_pylist() for c in ("a", "b", "height")), strict=True)))
        found.pop(OCEAN)
        return pa.table({"basin": pa.array(found, pa.int64()), "spill": pa.array(found.values(), pa.float64())})

    merges: list[DataFrame] = []
    passes = keep.save(passes.groupBy("a", "b").agg(F.min("height").alias("height")), "passes")
    while passes.limit(small + 1).count() > small:
        turn = len(merges)
        both = passes.unionByName(passes.select(F.col("b").alias("a"), F.col("a").alias("b"), "height"))
        order = F.struct("height", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("b").alias("parent"))
        lowest = both.filter(F.col("a") != OCEAN).groupBy("a").agg(F.min(order).alias("p")).select(F.col("a").alias("basin"), "p.parent", "p.height")
        lowest = keep.save(lowest, f"lowest-{turn}")
        mutual = lowest.select(F.col("basin").alias("parent"), F.col("parent").alias("back"))
        tree = lowest.join(mutual, "parent", "left")
        root = (F.col("back") == F.col("basin")) & (F.col("basin") < F.col("parent"))
        tree = keep.save(tree.select("basin", "height", F.when(root, F.col("basin")).otherwise(F.col("parent")).alias("root")), f"tree-{turn}-0")
        step = 0
        while True:
            step += 1
            above = tree.select(F.col("basin").alias("root"), F.col("root").alias("beyond"))
            new = tree.join(above, "root", "left").withColumn("next", F.coalesce("beyond", "root"))
            tree = keep.save(new.select("basin", "height", (F.col("next") != F.col("root")).alias("moved"), F.col("next").alias("root")), f"tree-{turn}-{step}")
            if not tree.filter("moved").limit(1).count():
                break
        merges.append(tree.select("basin", "height", "root"))
        name = tree.select("basin", "root")
        for side in ("a", "b"):
            passes = passes.join(name.withColumnRenamed("basin", side), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        passes = passes.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("height").alias("height"))
        passes = keep.save(passes, f"passes-{turn}")
    spill = keep.save(passes.groupBy().applyInArrow(at_once, "basin long, spill double"), "spill")
    for turn, tree in reversed(list(enumerate(merges))):
        down = tree.join(spill.withColumnRenamed("basin", "root"), "root", "left")
        ends = F.when(F.col("root") == OCEAN, F.col("height")).when(F.col("root") == F.col("basin"), F.col("spill")).otherwise(F.greatest("height", "spill"))
        known = (F.col("root") == OCEAN) | F.col("spill").isNotNull()
        spill = keep.save(down.filter(known).select("basin", ends.alias("spill")), f"spill-{turn}")
    return spill


def fill(grid: DataFrame, tile: int = 256, eight: bool = False, small: int | None = None) -> DataFrame:
    """(z, x, h, w): every cell's level w, the lowest maximum of heights on a way to the border.

    Cells on the world's border keep their height; cells without any way to it are infinitely deep.
    Null and NaN heights are walls, whose level is infinite as well. An empty grid gives an empty one.
    """
    keep = Rounds(grid, "fill")
    heights = grid.select("z", "x", F.col("h").cast("double").alias("h"))
    ends = extent(grid)
    if ends is None:
        return heights.withColumn("w", F.col("h"))
    top, bottom, left, right = ends

    def kernel(h: np.ndarray, own: np.ndarray, z0: int, x0: int) -> list[dict[str, np.ndarray]]:
        level, basin, passes = basins(h, eight)
        z, x = (v.ravel() for v in np.mgrid[z0 : z0 + h.shape[0], x0 : x0 + h.shape[1]])
        ids, basin, flat = cell_id(z, x), basin.ravel(), h.ravel()
        cells = basin >= 0
        shore = cells & ((z == top) | (z == bottom) | (x == left) | (x == right))
        ends = np.array(list(passes), np.int64).reshape(-1, 2)
        a, b = ids[ends[:, 0]], ids[ends[:, 1]]
        return [
            {"z": z[cells], "x": x[cells], "h": flat[cells], "level": level.ravel()[cells], "basin": ids[basin[cells]]},
            {"a": np.minimum(a, b), "b": np.maximum(a, b), "height": np.array(list(passes.values()), float)},
            {"a": np.full(int(shore.sum()), OCEAN), "b": ids[basin[shore]], "height": flat[shore]},
        ]

    wall = F.col("h").isNull() | F.isnan("h")
    flooded = keep.save(rows_by_tile(heights.filter(~wall), kernel, ["h"], f"z int, x int, h double, level double, basin long, {_PASS}", tile), "flooded")
    cells = flooded.filter("z is not null").select("z", "x", "h", "level", "basin")
    # each step over a tile's edge once; there a cell's level is its height
    edge = cells.filter(F.pmod("z", F.lit(tile)).isin(0, tile - 1) | F.pmod("x", F.lit(tile)).isin(0, tile - 1))
    forward = F.explode(F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dx).alias("dx")) for dz, dx in directions(eight) if (dz, dx) > (0, 0)]))
    away = edge.select((F.col("basin")).alias("one"), F.col("level").alias("here"), "z", "x", forward.alias("d"))
    away = away.select("one", "here", F.col("z").alias("z1"), F.col("x").alias("x1"), (F.col("z") + F.col("d.dz")).alias("z"), (F.col("x") + F.col("d.dx")).alias("x"))
    other_tile = (F.floor(F.col("z1") / tile) != F.floor(F.col("z") / tile)) | (F.floor(F.col("x1") / tile) != F.floor(F.col("x") / tile))
    across = away.filter(other_tile).join(edge.select("z", "x", "level", "basin"), ["z", "x"])
    across = across.select(F.least("one", "basin").alias("a"), F.greatest("one", "basin").alias("b"), F.greatest("here", "level").alias("height"))
    inside = flooded.filter("z is null").select("a", "b", "height")
    spill = spill_levels(inside.unionByName(across), keep, rounds.SMALL if small is None else small)
    deep = F.lit(float("inf"))
    water = cells.join(spill, "basin", "left").select("z", "x", "h", F.greatest("level", F.coalesce("spill", deep)).alias("w"))
    return water.unionByName(heights.filter(wall).withColumn("w", deep))
