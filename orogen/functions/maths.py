"""Scalar expressions shared by the operators, which stay inside generated code, and the same draws over arrays."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def logistic(value: Column) -> Column:
    """1 / (1 + exp(value)): falls from 1 to 0."""
    return 1.0 / (1.0 + F.exp(value))


def smooth_max(a: Column, b: Column, k: float = 12.0) -> Column:
    """Half of a + b + sqrt((a - b)^2 + k): never below the greater of the two."""
    return 0.5 * (a + b + F.sqrt((a - b) * (a - b) + k))


def _word(seed: int, attribute: str, keys: list[Column]) -> Column:
    """A 32-bit number from a seed, an attribute and the row's keys."""
    parts = [F.lit(str(seed)), F.lit(attribute), *(k.cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("double")


def uniform(seed: int, attribute: str, *keys: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Uniform in [low, high) by counter: equal for equal keys under any partitioning."""
    return low + (high - low) * (_word(seed, attribute, list(keys)) / F.lit(4294967296.0))


def normal(seed: int, attribute: str, *keys: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Normal by Box and Muller from two counter-based uniforms."""
    u = (_word(seed, f"{attribute}/1", list(keys)) + 1.0) / F.lit(4294967297.0)
    v = _word(seed, f"{attribute}/2", list(keys)) / F.lit(4294967296.0)
    return mean + sd * F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def lattice_noise(seed: int, u: Column, v: Column, scale: float) -> Column:
    """Value noise in [-1, 1]: hashed lattice values, mixed bilinearly."""
    i, j = F.floor(u / scale), F.floor(v / scale)
    s, t = u / scale - i, v / scale - j
    corner = lambda a, b: uniform(seed, "noise", i + a, j + b, low=-1.0, high=1.0)
    near = corner(0, 0) * (1.0 - s) + corner(1, 0) * s
    far = corner(0, 1) * (1.0 - s) + corner(1, 1) * s
    return near * (1.0 - t) + far * t


def uniform_of(seed: int, attribute: str, *keys: object) -> float:
    """``uniform`` in [0, 1) for one row of keys."""
    return int(hashlib.md5(":".join(map(str, (seed, attribute, *keys))).encode()).hexdigest()[:8], 16) / 4294967296.0


def lattice_noise_array(seed: int, u: np.ndarray, v: np.ndarray, scale: float) -> np.ndarray:
    """``lattice_noise`` over arrays; each lattice point that they touch is drawn once."""
    i, j = np.floor(u / scale).astype(int), np.floor(v / scale).astype(int)
    s, t = u / scale - i, v / scale - j
    low_i, low_j = int(i.min()), int(j.min())
    drawn = np.full((int(i.max()) - low_i + 2, int(j.max()) - low_j + 2), np.nan)
    corners = [(i - low_i + a, j - low_j + b) for b in (0, 1) for a in (0, 1)]
    for at in corners:
        for a, b in zip(*np.nonzero(np.isnan(drawn) & _marked(drawn.shape, at)), strict=True):
            drawn[a, b] = 2.0 * uniform_of(seed, "noise", low_i + int(a), low_j + int(b)) - 1.0
    near, near_2, far, far_2 = (drawn[at] for at in corners)
    return (near * (1.0 - s) + near_2 * s) * (1.0 - t) + (far * (1.0 - s) + far_2 * s) * t


def _marked(shape: tuple[int, int], at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(shape, bool)
    out[at] = True
    return out
