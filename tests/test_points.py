"""Poisson-disk sampling: rounds over classes of radii give the sample that one task gives, and no other is possible."""

import math

import numpy as np
import pytest

from orogen.operators import points


def field(spark, side=18, seed=0):
    """Dense, sparse and very sparse ground side by side, and cells without any."""
    rng = np.random.default_rng(seed)
    p = lambda z, x: 0.0 if rng.random() < 0.05 else (1.0, 0.2, 0.02, 0.001)[(x * 4) // side] * rng.uniform(0.5, 1)
    return spark.createDataFrame([(z, x, float(p(z, x))) for z in range(side) for x in range(side)], "z int, x int, p double").repartition(3)


def apart(a, b):
    return math.hypot(a["px"] - b["px"], a["pz"] - b["pz"]) >= max(a["r"], b["r"])


def by_turn(rows):
    taken = []
    for c in sorted(rows, key=lambda c: (max(0, math.ceil(math.log2(c["r"]))), c["priority"], c["id"])):
        if all(apart(c, t) for t in taken):
            taken.append(c)
    return {c["id"] for c in taken}


@pytest.mark.parametrize("small", [10**6, 12])
def test_rounds_give_the_sample_taken_by_turn(spark, small):
    cand = points.candidates(field(spark), 1.2).cache()
    rows = cand.collect()
    assert len({max(0, math.ceil(math.log2(c["r"]))) for c in rows}) >= 4
    taken = points.poisson_disk(cand, small)
    assert {r["id"] for r in taken.collect()} == by_turn(rows)


@pytest.mark.parametrize("small", [10**6, 0])
def test_gaps_are_counted(spark, small):
    cand = points.candidates(field(spark, 8, 1), 1.2).cache()
    taken = points.poisson_disk(cand).cache()
    got = points.gaps(cand, taken, small).first()
    assert (got["candidates"], got["taken"], got["too_close"], got["uncovered"]) == (cand.count(), taken.count(), 0, 0)
    rows, have = cand.collect(), [r for r in taken.collect()]
    fewer = taken.filter(taken.id != have[0]["id"])
    assert points.gaps(cand, fewer, small).first()["uncovered"] == sum(all(apart(c, t) for t in have[1:]) for c in rows)
    every = points.gaps(cand, cand, small).first()
    assert every["too_close"] == sum(not apart(a, b) for i, a in enumerate(rows) for b in rows[:i])


def test_no_candidates(spark):
    none = points.candidates(spark.createDataFrame([(0, 0, 0.0), (0, 1, float("nan")), (1, 1, None)], "z int, x int, p double"), 1.5)
    assert points.poisson_disk(none).collect() == [] and points.poisson_disk(none, 0).collect() == []
    assert tuple(points.gaps(none, none).first()) == (0, 0, 0, 0)
