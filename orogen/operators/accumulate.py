"""Flow accumulation in two passes over the grid, linked by the tiles' edges.

1. In each tile, what leaves it is a linear map of what enters it. The tile's cells are taken in waves from the
   highest: a cell passes its area on when all that flows into it has come. The same waves carry unit
   inflows of the entry cells, a block of them at a time, which gives the share of each that reaches
   each exit. Rows (from, to, share) and (to, amount) go out, of the size of the tile's edge.
2. Inflows are solved on those links alone. Each round passes on only what the last one brought, so no link is
   asked again without new inflow, and no tile is solved again. SMALL links at most are solved by one task at once.
3. Every tile takes its inflows in and writes its areas once.

Receivers are acyclic (``flow``), so both the waves and the rounds end.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rounds
from .rounds import DIRECTIONS, Rounds, cell_id, rows_by_tile
from .tiles import tiled

ENTRIES = 32  # unit inflows carried at a time: 17 MB of a tile of 256
_RECEIVERS = ["k1", "p1", "k2", "p2"]


class Waves:
    """A tile's cells in waves, so that a cell comes after all that flow into it."""

    def __init__(self, k1: np.ndarray, p1: np.ndarray, k2: np.ndarray, p2: np.ndarray, own: np.ndarray):
        rows, columns = own.shape
        self.shape, flat = own.shape, own.ravel()
        z, x = (v.ravel() for v in np.mgrid[:rows, :columns])
        self.steps, self.shares, self.inside, self.ends = [], [], [], []
        for k, p in ((k1, p1), (k2, p2)):
            k = np.where(np.isnan(k), -1, k).astype(int).ravel()
            dz, dx = (np.array([d[axis] for d in DIRECTIONS])[k] for axis in (0, 1))
            to_z, to_x = z + dz, x + dx
            held = (k >= 0) & (to_z >= 0) & (to_z < rows) & (to_x >= 0) & (to_x < columns)
            to = np.where(held, to_z * columns + to_x, 0)
            self.steps.append(to)
            self.shares.append(np.where(k >= 0, np.nan_to_num(p.ravel()), 0.0))
            self.inside.append(flat & held & flat[to])
            self.ends.append((flat & (k >= 0) & ~self.inside[-1], to_z, to_x, held & ~flat & flat[to]))
        left = sum(np.bincount(t[i], minlength=flat.size) for t, i in zip(self.steps, self.inside, strict=True))
        self.order, front = [], np.flatnonzero(flat & (left == 0))
        while len(front):
            self.order.append(front)
            reached = []
            for t, i in zip(self.steps, self.inside, strict=True):
                to = t[front[i[front]]]
                np.subtract.at(left, to, 1)
                reached.append(to)
            reached = np.unique(np.concatenate(reached))
            front = reached[left[reached] == 0]

    def carry(self, amount: np.ndarray) -> np.ndarray:
        """Adds to each cell (row) what flows in, from the amounts that arise in the cells."""
        for front in self.order:
            for t, p, i in zip(self.steps, self.shares, self.inside, strict=True):
                at = front[i[front]]
                share = p[at] if amount.ndim == 1 else p[at, None]
                np.add.at(amount, t[at], share * amount[at])
        return amount

    def entries(self) -> np.ndarray:
        """Own cells that receive from outside."""
        return np.unique(np.concatenate([t[e[3]] for t, e in zip(self.steps, self.ends, strict=True)]))

    def exits(self, amount: np.ndarray, z0: int, x0: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells outside (as numbers) and what flows there."""
        ids, out = [], []
        for p, (leaves, to_z, to_x, _) in zip(self.shares, self.ends, strict=True):
            at = np.flatnonzero(leaves)
            ids.append(cell_id(to_z[at] + z0, to_x[at] + x0))
            out.append((p[at] if amount.ndim == 1 else p[at, None]) * amount[at])
        ids, where = np.unique(np.concatenate(ids), return_inverse=True)
        total = np.zeros((len(ids), *amount.shape[1:]))
        np.add.at(total, where, np.concatenate(out))
        return ids, total


def _links(k1, p1, k2, p2, own, z0, x0):  # noqa: ANN001, ANN202
    waves = Waves(k1, p1, k2, p2, own)
    to, amount = waves.exits(waves.carry(np.where(own, 1.0, 0.0).ravel()), z0, x0)
    parts = [{"to": to, "amount": amount}]
    z, x = np.divmod(np.arange(own.size), own.shape[1])
    ids, entries = cell_id(z + z0, x + x0), waves.entries()
    for lo in range(0, len(entries), ENTRIES):
        some = entries[lo : lo + ENTRIES]
        unit = np.zeros((own.size, len(some)))
        unit[some, np.arange(len(some))] = 1.0
        to, share = waves.exits(waves.carry(unit), z0, x0)
        i, j = np.nonzero(share)
        parts.append({"from": ids[some[j]], "to": to[i], "amount": share[i, j]})
    return parts


def inflows(links: DataFrame, keep: Rounds, small: int) -> DataFrame:
    """(cell, inflow) of every cell that receives from another tile."""

    def at_once(table: pa.Table) -> pa.Table:
        total, ahead, left = defaultdict(float), defaultdict(list), defaultdict(int)
        for a, b, v in zip(*(table.column(c).to_pylist() for c in ("from", "to", "amount")), strict=True):
            if a is None:
                total[b] += v
            else:
                ahead[a].append((b, v))
                left[b] += 1
        ready = [c for c in {*total, *ahead} if not left[c]]
        while ready:
            a = ready.pop()
            for b, v in ahead.get(a, ()):
                total[b] += v * total[a]
                left[b] -= 1
                if not left[b]:
                    ready.append(b)
        return pa.table({"cell": pa.array(total, pa.int64()), "inflow": pa.array(total.values(), pa.float64())})

    if links.limit(small + 1).count() <= small:
        return keep.save(links.groupBy().applyInArrow(at_once, "cell long, inflow double"), "inflow")
    shares = links.filter("`from` is not null")
    brought = links.filter("`from` is null").groupBy(F.col("to").alias("cell")).agg(F.sum("amount").alias("inflow"))
    total = brought = keep.save(brought, "brought-0")
    turn = 0
    while True:
        turn += 1
        moved = shares.join(brought.withColumnRenamed("cell", "from"), "from")
        brought = keep.save(moved.groupBy(F.col("to").alias("cell")).agg(F.sum(F.col("amount") * F.col("inflow")).alias("inflow")), f"brought-{turn}")
        if not brought.limit(1).count():
            return total.groupBy("cell").agg(F.sum("inflow").alias("inflow"))
        total = keep.save(total.unionByName(brought).groupBy("cell").agg(F.sum("inflow").alias("inflow")), f"total-{turn}")


def drainage(directed: DataFrame, tile: int = 256, small: int | None = None) -> DataFrame:
    """(z, x, area): one plus the shares of the areas that flow in. An empty grid gives an empty one."""
    keep = Rounds(directed, "drain")
    receivers = keep.save(directed.select("z", "x", *_RECEIVERS), "receivers")
    links = keep.save(rows_by_tile(receivers, _links, _RECEIVERS, "from long, to long, amount double", tile, 1), "links")
    inflow = inflows(links, keep, rounds.SMALL if small is None else small)
    cell = cell_id(F.col("z").cast("long"), F.col("x"))

    def kernel(k1, p1, k2, p2, inflow, own, z0, x0):  # noqa: ANN001, ANN202
        waves = Waves(k1, p1, k2, p2, own & ~np.isnan(inflow))
        return {"area": waves.carry(1.0 + np.nan_to_num(inflow).ravel()).reshape(own.shape)}

    entered = receivers.withColumn("cell", cell).join(inflow, "cell", "left").fillna(0.0, ["inflow"])
    return tiled(entered.select("z", "x", *_RECEIVERS, "inflow"), kernel, [*_RECEIVERS, "inflow"], "z int, x int, area double", tile, 0)
