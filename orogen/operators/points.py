"""Variable-radius Poisson-disk points on a grid of buckets for each class of radii.

Candidates conflict when closer than the greater of their radii. They are taken in the order (class, priority, id),
where class k holds radii up to 2^k: finer ones first, so sparse ground never clears dense ground. A candidate is taken
if none before it that conflicts was. The sample is maximal with the asked spacing, and the same under any partitioning.

Classes follow each other. A class first loses those that points of finer classes strike. The question is only
whether any point lies within the radius, so it goes down from buckets of half the class's size: one that lies within
the disk settles it if it holds a point, one outside is dropped, and only those that the circle crosses are asked at half
their size. Work follows the candidates near a circle's edge, not the points within. Then come rounds: a
candidate before all live ones of its bucket and the eight around it is taken, and strikes those it
conflicts with. Each round is a written table of live candidates. A class of SMALL candidates at most, or a whole
sample of that size, is settled by one task at once, with the same result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import uniform
from . import rounds
from .rounds import Rounds


def target_density(p: Column, most: float = 1.0) -> Column:
    return most * p


def spacing(density: Column, r_min: float) -> Column:
    """r_min over the root of the density; null where there is none."""
    return F.when(density > 0, r_min / F.sqrt(F.when(density > 0, density)))


def box_radius(dx: int, dz: int) -> float:
    """Half the diagonal of an object's footprint, the least distance that keeps boxes apart."""
    return 0.5 * math.hypot(dx, dz)


def candidates(field: DataFrame, r_min: float, most_density: float = 1.0, p: str = "p", seed: int = 42) -> DataFrame:
    """One jittered point for each cell with p > 0: (id, px, pz, r, priority)."""
    keys = [F.col("z"), F.col("x")]
    out = field.filter((F.col(p) > 0) & ~F.isnan(p))
    return out.select(
        F.concat_ws(":", "z", "x").alias("id"),
        (F.col("x") + uniform(seed, "px", *keys)).alias("px"),
        (F.col("z") + uniform(seed, "pz", *keys)).alias("pz"),
        spacing(target_density(F.col(p), most_density), r_min).alias("r"),
        uniform(seed, "priority", *keys).alias("priority"),
    )


def radius_class() -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2("r"))).cast("int")


def _bucket(size: float) -> list[Column]:
    return [F.floor(F.col("px") / size).alias("bx"), F.floor(F.col("pz") / size).alias("bz")]


def _around(reach: int) -> Column:
    """The buckets up to ``reach`` away, as rows."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return F.explode(F.flatten(F.transform(steps, lambda a: F.transform(steps, lambda b: F.struct((F.col("bx") + a).alias("bx"), (F.col("bz") + b).alias("bz"))))))


def _struck(live: DataFrame, taken: DataFrame, k: int, keep: Rounds, name: str) -> DataFrame:
    """Ids of candidates of class k with a taken point of a finer class within their radius."""
    size = 2.0 ** (k - 1)
    own = ["id", "px", "pz", "r"]
    asked = live.select(*own, *_bucket(size)).select(*own, _around(2 + int(k == 0)).alias("at")).select(*own, "at.*")
    found = []
    for level in range(k - 1, -1, -1):
        size = 2.0**level
        held = taken.select(*_bucket(size)).distinct()
        dx, dz = (F.greatest(F.abs(F.col(p) - (F.col(b) + 0.5) * size) - size / 2, F.lit(0.0)) for p, b in (("px", "bx"), ("pz", "bz")))
        fx, fz = (F.abs(F.col(p) - (F.col(b) + 0.5) * size) + size / 2 for p, b in (("px", "bx"), ("pz", "bz")))
        met = asked.filter(dx * dx + dz * dz < F.col("r") * F.col("r")).join(held, ["bx", "bz"])
        met = keep.save(met.withColumn("inside", fx * fx + fz * fz < 0.999999 * F.col("r") * F.col("r")), f"{name}-{level}")
        hit = met.filter("inside").select("id").distinct()
        found.append(hit)
        open_ = met.join(hit, "id", "left_anti")
        if not level:
            break
        half = F.explode(F.array(*[F.struct((F.col("bx") * 2 + a).alias("bx"), (F.col("bz") * 2 + b).alias("bz")) for a in (0, 1) for b in (0, 1)]))
        asked = open_.select(*own, half.alias("at")).select(*own, "at.*")
    # buckets of one cell that the circle crosses: their points themselves
    points = taken.select(*_bucket(1.0), F.col("px").alias("tx"), F.col("pz").alias("tz"), F.col("r").alias("tr"))
    gap = F.hypot(F.col("px") - F.col("tx"), F.col("pz") - F.col("tz"))
    found.append(open_.join(points, ["bx", "bz"]).filter(gap < F.greatest("r", "tr")).select("id").distinct())
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


class _Buckets:
    """Points by class of radius, for a task that holds them all: (class, bucket) to (x, z, r, own class, number)."""

    def __init__(self, classes: list[int]):
        self.classes = sorted(set(classes))
        self.upto: dict[tuple[int, int, int], list[tuple]] = {}  # of a class and finer ones
        self.only: dict[tuple[int, int, int], list[tuple]] = {}

    def add(self, k: int, x: float, z: float, r: float, number: int) -> None:
        point = x, z, r, k, number
        for m in self.classes[bisect.bisect_left(self.classes, k) :]:
            self.upto.setdefault((m, int(x // 2.0**m), int(z // 2.0**m)), []).append(point)
        self.only.setdefault((k, int(x // 2.0**k), int(z // 2.0**k)), []).append(point)

    def near(self, k: int, x: float, z: float, r: float, coarser: bool = False) -> Iterator[tuple]:
        """Points closer than the greater of both radii: of the class and finer ones, or of coarser ones."""
        for m in self.classes[bisect.bisect_right(self.classes, k) :] if coarser else [k]:
            held, bx, bz = self.only if coarser else self.upto, int(x // 2.0**m), int(z // 2.0**m)
            for a in (0, -1, 1):
                for b in (0, -1, 1):
                    for point in held.get((m, bx + a, bz + b), ()):
                        dx, dz = point[0] - x, point[1] - z
                        far = r if r > point[2] else point[2]
                        # the sum of squares settles all but a hair's breadth, which is asked as elsewhere
                        square = dx * dx + dz * dz
                        if square < far * far * 1.000001 and (square < far * far * 0.999999 or np.hypot(dx, dz) < far):
                            yield point


def _in_order(table: pa.Table) -> pa.Table:
    """The sample of candidates that one task holds."""
    names = ("class", "priority", "id", "px", "pz", "r")
    rows = sorted(zip(*(table.column(c).to_pylist() for c in names), strict=True))
    held, taken = _Buckets([row[0] for row in rows]), []
    for row in rows:
        k, at = row[0], row[3:]
        if next(held.near(k, *at), None) is None:
            held.add(k, *at, len(taken))
            taken.append(row)
    columns = dict(zip(names, zip(*taken, strict=True), strict=True)) if taken else {}
    return table.schema.empty_table() if not taken else pa.table({f.name: pa.array(columns[f.name], f.type) for f in table.schema})


def poisson_disk(points: DataFrame, small: int | None = None) -> DataFrame:
    """The points taken: (id, px, pz, r, priority). Ids must differ; none for an empty table."""
    small = rounds.SMALL if small is None else small
    keep, columns = Rounds(points, "points"), ["id", "px", "pz", "r", "priority"]
    every = keep.save(points.select(*columns).withColumn("class", radius_class()), "all")
    at_once = lambda df: df.groupBy().applyInArrow(_in_order, df.schema)
    if every.limit(small + 1).count() <= small:
        return at_once(every).select(*columns)
    taken: list[DataFrame] = []
    for k in sorted(r["class"] for r in every.select("class").distinct().collect()):
        live = every.filter(F.col("class") == k)
        if taken:
            before = taken[0]
            for more in taken[1:]:
                before = before.unionByName(more)
            live = keep.save(live.join(_struck(live, before, k, keep, f"struck-{k}") if k else live.select("id").limit(0), "id", "left_anti"), f"live-{k}")
        turn = 0
        while True:
            if live.limit(small + 1).count() <= small:
                taken.append(keep.save(at_once(live), f"taken-{k}-{turn}"))
                break
            order = F.struct("priority", "id")
            placed = live.select("*", *_bucket(2.0**k))
            first = placed.groupBy("bx", "bz").agg(F.min(order).alias("m"))
            near = first.select("m", _around(1).alias("at")).groupBy("at.bx", "at.bz").agg(F.min("m").alias("first_near"))
            ahead = first.join(near, ["bx", "bz"]).filter(F.col("m") == F.col("first_near")).select(F.col("m.id").alias("id"))
            won = keep.save(live.join(ahead, "id", "left_semi"), f"taken-{k}-{turn}")
            taken.append(won)
            reach = won.select(F.col("px").alias("tx"), F.col("pz").alias("tz"), F.col("r").alias("tr"), *_bucket(2.0**k)).select("tx", "tz", "tr", _around(1).alias("at")).select("tx", "tz", "tr", "at.*")
            gap = F.hypot(F.col("px") - F.col("tx"), F.col("pz") - F.col("tz"))
            gone = placed.join(reach, ["bx", "bz"]).filter(gap < F.greatest("r", "tr")).select("id").distinct()
            live = keep.save(live.join(gone, "id", "left_anti"), f"live-{k}-{turn}")
            turn += 1
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.select(*columns)


def _counted(table: pa.Table) -> pa.Table:
    """``gaps`` of the candidates that one task holds; ``mark`` tells the taken ones."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("class", "px", "pz", "r", "mark")), strict=True))
    held, close, free = _Buckets([row[0] for row in rows]), 0, 0
    for number, row in enumerate(rows):
        if row[4]:
            held.add(*row[:4], number)
    for number, row in enumerate(rows):
        at = row[:4]
        if row[4]:  # a pair counts at its coarser point
            close += sum(k < row[0] or other < number for _, _, _, k, other in held.near(*at))
        else:
            free += next(held.near(*at), None) is None and next(held.near(*at, coarser=True), None) is None
    return pa.table({"candidates": [len(rows)], "taken": [sum(row[4] for row in rows)], "too_close": [close], "uncovered": [free]})


def gaps(points: DataFrame, taken: DataFrame, small: int | None = None) -> DataFrame:
    """One row: candidates, points taken, pairs of them too close, candidates that could be added (uncovered).

    A point meets others of its own and finer classes in its class's buckets, so a check costs what the sample's spacing
    allows; candidates that were not taken go through the same question as in sampling. SMALL candidates at most
    are checked by one task. All points taken are candidates.
    """
    keep = Rounds(points, "gaps")
    marked = keep.save(points.select("id", "px", "pz", "r", radius_class().alias("class")).join(taken.select("id", F.lit(True).alias("mark")), "id", "left").fillna(False, ["mark"]), "marked")
    if 0 < marked.limit((small := rounds.SMALL if small is None else small) + 1).count() <= small:
        return marked.groupBy().applyInArrow(_counted, "candidates long, taken long, too_close long, uncovered long")
    points, taken = points.withColumn("class", radius_class()), keep.save(taken.withColumn("class", radius_class()), "taken")
    classes = sorted(r["class"] for r in points.select("class").distinct().collect())
    close, open_ = [], []
    for k in classes:
        own = taken.filter(F.col("class") == k)
        reach = own.select(F.col("id").alias("o_id"), F.col("px").alias("tx"), F.col("pz").alias("tz"), F.col("r").alias("tr"), *_bucket(2.0**k))
        reach = reach.select("o_id", "tx", "tz", "tr", _around(1).alias("at")).select("o_id", "tx", "tz", "tr", "at.*")
        gap = F.hypot(F.col("px") - F.col("tx"), F.col("pz") - F.col("tz"))
        other = taken.filter(F.col("class") <= k).select("id", "class", "px", "pz", "r", *_bucket(2.0**k))
        near = other.join(reach, ["bx", "bz"]).filter(gap < F.greatest("r", "tr"))
        close.append(near.filter((F.col("class") < k) | (F.col("id") < F.col("o_id"))).select("id"))
        rest = points.filter(F.col("class") == k).join(own.select("id"), "id", "left_anti")
        by_own = rest.select("id", "px", "pz", "r", *_bucket(2.0**k)).join(reach, ["bx", "bz"]).filter(gap < F.greatest("r", "tr")).select("id").distinct()
        rest = keep.save(rest.join(by_own, "id", "left_anti"), f"rest-{k}")
        finer = taken.filter(F.col("class") < k)
        open_.append(rest.join(_struck(rest, finer, k, keep, f"gap-{k}"), "id", "left_anti").select("id") if k and rest.limit(1).count() else rest.select("id"))
    out = points.agg(F.count("*").alias("candidates")).crossJoin(taken.agg(F.count("*").alias("taken")))
    for name, parts in (("too_close", close), ("uncovered", open_)):
        whole = parts[0] if parts else points.select("id").limit(0)
        for more in parts[1:]:
            whole = whole.unionByName(more)
        out = out.crossJoin(whole.agg(F.count("*").alias(name)))
    return out


def as_mask(grid: DataFrame, points: DataFrame) -> DataFrame:
    """(z, x, v): 255 in cells that hold a point."""
    cells = points.select(F.floor("pz").cast("int").alias("z"), F.floor("px").cast("int").alias("x")).distinct().withColumn("v", F.lit(255).cast("smallint"))
    return grid.select("z", "x").join(cells, ["z", "x"], "left").fillna(0, ["v"]).select("z", "x", F.col("v").cast("smallint").alias("v"))
