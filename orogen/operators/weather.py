"""Thermal weathering, in two modes, as a tile kernel with one exchange for a block of iterations.

A block's halo holds all that its iterations can reach, a quarter of the tile's side at most, so the
cells that an exchange copies stay a fixed share of the grid however many iterations are asked. Blocks are
written tables.

``listing`` follows the published listing: forward differences along each axis, positive
excess only, and every transfer read from the iteration's starting heights. It
steepens slopes. ``physical`` follows the prose: a cell steeper than the critical angle gives
half its excess to its lowest direct neighbour. Both conserve mass.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import FloatType

from .rounds import Rounds
from .tiles import tiled

WEST, EAST, NORTH, SOUTH = (0, -1), (0, 1), (-1, 0), (1, 0)  # steps in z, x


def critical_slope(angle_deg: float = 38.0) -> float:
    return math.tan(math.radians(angle_deg))


def neighbour(a: np.ndarray, step: tuple[int, int], beyond: float) -> np.ndarray:
    """Each cell's value one step away, ``beyond`` outside the array."""
    wide = np.pad(a, 1, constant_values=beyond)
    z, x = 1 + step[0], 1 + step[1]
    return wide[z : z + a.shape[0], x : x + a.shape[1]]


def excess(difference: np.ndarray, crit: float) -> np.ndarray:
    return np.maximum(difference.dtype.type(0), difference - difference.dtype.type(crit))


def received(gift: np.ndarray, step: tuple[int, int]) -> np.ndarray:
    """What every cell gets of gifts made along a step: its predecessor's."""
    return neighbour(gift, (-step[0], -step[1]), 0.0)


def listing_step(h: np.ndarray, crit: float, rate: float) -> np.ndarray:
    """One iteration: a cell gives ``rate`` of the rise ahead beyond the critical one, east and south."""
    lost = np.zeros_like(h)
    for step in (EAST, SOUTH):
        gift = excess(neighbour(h, step, -np.inf) - h, crit) * h.dtype.type(rate)
        lost = lost + gift - received(gift, step)
    return h - lost


def physical_step(h: np.ndarray, crit: float, spacing: float) -> np.ndarray:
    """One iteration: half the excess goes to the lowest neighbour, ties in the order west, east, north, south."""
    steps = (WEST, EAST, NORTH, SOUTH)
    near = np.stack([neighbour(h, step, np.inf) for step in steps])
    give = h.dtype.type(0.5) * excess((h - near.min(0)) / h.dtype.type(spacing), crit) * h.dtype.type(spacing)
    to = near.argmin(0)
    return h - give + sum(received(np.where(to == k, give, h.dtype.type(0)), step) for k, step in enumerate(steps))


def weather(grid: DataFrame, mode: str = "physical", critical_angle_deg: float = 38.0, iterations: int = 15, talus_transfer_rate: float = 0.35, spacing: float = 1.0, tile: int = 256) -> DataFrame:
    """(z, x, h) after ``iterations``, whatever the tile. Single precision stays single."""
    if mode not in ("listing", "physical"):
        raise ValueError(f"unknown mode {mode}")
    crit = critical_slope(critical_angle_deg)
    single = isinstance(grid.schema["h"].dataType, FloatType)
    schema = f"z int, x int, h {'float' if single else 'double'}"
    reach = 1 if mode == "listing" else 2  # cells an iteration sees
    block = max(1, tile // (4 * reach))

    def kernel(n: int):  # noqa: ANN202
        def run(h: np.ndarray, own: np.ndarray, z0: int, x0: int) -> dict[str, np.ndarray]:
            h = h.astype(np.float32 if single else np.float64)
            for _ in range(n):
                h = listing_step(h, crit, talus_transfer_rate) if mode == "listing" else physical_step(h, crit, spacing)
            return {"h": h}

        return run

    keep, out, done = Rounds(grid, "weather"), grid.select("z", "x", "h"), 0
    while done < iterations:
        n = min(block, iterations - done)
        done += n
        out = tiled(out, kernel(n), ["h"], schema, tile, n * reach)
        if done < iterations:
            out = keep.save(out, done)
    return out
