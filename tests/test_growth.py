"""What must not grow with the square of a table."""

from __future__ import annotations

import itertools
import math
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from orogen.llm import kit, minhash_dedup, ngram_join
from orogen.operators import accumulate, breaching, curves, points, world


def test_cells_meet_few_of_many_strata(spark):
    k = F.col("id")
    strata = spark.range(6000).select(k.alias("seq"), (k % 5).alias("lo"), (k % 5 + 2).alias("hi"), F.concat(F.lit("t"), k).alias("terrain"), F.when(k % 3 == 0, 0.0).alias("slope_lo"), F.when(k % 3 == 0, 30.0).alias("slope_hi"))
    levels = spark.range(-1, 9).select(F.col("id").alias("level"))
    held = world.strata_by_level(strata, levels, limits=("slope_lo", "slope_hi")).groupBy("level").count().collect()
    assert sorted(r["level"] for r in held) == list(range(7))
    assert max(r["count"] for r in held) <= 2
    cells = spark.createDataFrame([(0, 0, 2.5, 40.0), (0, 1, 2.5, 10.0), (0, 2, 0.0, 10.0), (0, 3, 0.0, 31.0), (0, 4, None, 1.0), (0, 5, float("nan"), 1.0), (0, 6, 3.0, None)], "z int, x int, h double, s double")
    got = {r["x"]: (r["seq"], r["terrain"]) for r in world.strata_join(cells, strata, slope="s").collect()}
    # level 2 is held by remainders 0, 1, 2; level 0 by 0 only; level 3 by 1, 2, 3
    assert got == {0: (1, "t1"), 1: (0, "t0"), 2: (0, "t0"), 3: (5, "t5"), 4: (None, None), 5: (None, None), 6: (1, "t1")}


def test_splines_are_worked_on_together(spark):
    """Stations of thousands of short splines cost no Python group each, and a long spline is not cut."""
    rows = [(s, g, float(g), g + 1.0, 3.0 * g, 3.0, 0.0, 0.0, 0.0, 0.5 * (s % 4), 0.0, 0.0) for s in range(900) for g in range(1 + (s % 450 == 7) * 6000)]
    table = spark.createDataFrame([(None, *r[1:]) if r[0] == 3 else r for r in rows], curves.SEGMENT).repartition(5)
    out = curves.spaced_stations(table, 1.0, jitter=0.0)
    assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    at = {}
    for r in out.collect():
        at.setdefault(r["spline_id"], []).append((r["inst_id"], r["t"]))
    assert len(at) == 900
    for s, got in at.items():
        of = 3 if s is None else s
        speed = math.hypot(3.0, 0.5 * (of % 4))
        n = int((1 + (of % 450 == 7) * 6000) * speed * (1 + 1e-9)) + 1
        assert [i for i, _ in sorted(got)] == list(range(n))
        assert max(abs(t - i / speed) for i, t in got) < 1e-8


def test_a_task_of_many_candidates_does_not_compare_all(spark):
    """A hundred thousand candidates in one task, of which half are taken: seconds, not minutes."""
    n = 100_000
    rng = np.random.default_rng(4)
    at, r = rng.uniform(0, 400, (n, 2)), np.where(rng.random(n) < 0.02, rng.uniform(1, 9, n), rng.uniform(0.2, 1.0, n))
    table = pa.table({"id": [f"{i:06d}" for i in range(n)], "px": at[:, 0], "pz": at[:, 1], "r": r, "priority": rng.random(n), "class": pa.array(np.maximum(0, np.ceil(np.log2(r))).astype(np.int32))})
    began = time.perf_counter()
    taken = points._in_order(table)
    ids = set(taken.column("id").to_pylist())
    mark = [i in ids for i in table.column("id").to_pylist()]
    got = points._counted(table.append_column("mark", pa.array(mark))).to_pylist()[0]
    assert time.perf_counter() - began < 30 and len(taken) > 30_000
    assert got == {"candidates": n, "taken": len(taken), "too_close": 0, "uncovered": 0}
    # all against all on a part, in the same order
    part = table.filter(pc.less(table.column("px"), 60.0)).slice(0, 3000)
    rows, want = sorted(part.to_pylist(), key=lambda v: (v["class"], v["priority"], v["id"])), []
    for v in rows:
        if all(np.hypot(v["px"] - w["px"], v["pz"] - w["pz"]) >= max(v["r"], w["r"]) for w in want):
            want.append(v)
    assert points._in_order(part).to_pylist() == want
    every = points._counted(part.append_column("mark", pa.array([True] * len(part)))).to_pylist()[0]
    x, z, s = (part.column(c).to_numpy() for c in ("px", "pz", "r"))
    pairs = (np.hypot(x[:, None] - x, z[:, None] - z) < np.maximum(s[:, None], s)).sum() - len(part)
    assert every["too_close"] == pairs // 2 and every["uncovered"] == 0


def test_unit_inflows_of_a_tile_stay_small():
    """The largest tile's links hold some tens of MB at once, whatever flows in along its edge."""
    n = 258
    k1 = np.full((n, n), 1.0)  # all flow along the diagonal, so two edges receive
    own = np.zeros((n, n), bool)
    own[1:-1, 1:-1] = True
    tracemalloc.start()
    parts = accumulate._links(k1, np.ones((n, n)), np.full((n, n), -1.0), np.zeros((n, n)), own, 0, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert sum(len(p["to"]) for p in parts if "from" in p) == 2 * 256 - 1


def test_labels_of_a_pit_search_a_tile_at_once():
    """A pit's labels enter a tile along its whole edge: each cell is settled once, not once a label, with the same costs."""
    side, asked = 40, []

    class Counted(breaching.Ground):
        def own(self, z, x):
            asked.append((z, x))
            return super().own(z, x)

    rng = np.random.default_rng(8)
    z, x = (v.ravel() for v in np.mgrid[39 : 39 + side + 2, 39 : 39 + side + 2])
    cells = pa.table({"z": z, "x": x, "h": rng.integers(3, 30, len(z)).astype(float)})
    ground = Counted(cells, 1, 1, side, (0, 999, 0, 999), False)
    sources = [(float(rng.integers(0, 60)), 40, 40 + k, 39, 40 + k) for k in range(side)]
    got = ground.widen((0.0, 7, 7), sources, np.inf)
    assert len(asked) <= 5 * len(z)
    want = {}
    for s in sources:
        for at, (cost, _) in ground.search((0.0, 7, 7), [s], np.inf)[2].items():
            want[at] = min(want.get(at, np.inf), cost)
    assert {r[2:4]: r[1] for r in got} == want and len(want) >= 4 * side - 4
    # each label names a source that it can be reached from at its cost
    for _, cost, a, b, from_z, from_x in got[::7]:
        source = next(s for s in sources if s[1:3] == (from_z, from_x))
        assert ground.search((0.0, 7, 7), [source], np.inf)[2][a, b][0] == cost
    lower = ground.widen((20.0, 7, 7), sources, np.inf)
    assert [r[0] for r in lower].count("outlet") == 1 and lower[0][1] == min(s[0] for s in sources if ground.height[s[1:3]] < 20.0)


def test_texts_are_not_moved_to_find_those_of_pairs(spark):
    docs = spark.createDataFrame([(i if i != 7 else None, f"text {i}") for i in range(300)], "doc_id int, text string")
    ids = spark.createDataFrame([(i,) for i in (3, 3, 64, 65, 250, 10**9)], "doc_id long")
    out = ngram_join._about(docs, ids)
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert {(i, f"text {i}") for i in (3, 64, 65, 250)} <= got and len(got) < 10
    moved = [line for line in out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if line.startswith("Arguments: hashpartitioning")]
    assert moved and not any("doc_id" in line for line in moved)


def test_sides_of_pairs_move_once(spark, monkeypatch):
    """Both sides' columns beside each pair, also where a document is joined by parts; each wide side has one exchange of its own."""
    monkeypatch.setattr(ngram_join, "SPLIT", 3)
    rows = [(1, b) for b in range(2, 12)] + [(b, 20) for b in range(2, 12)] + [(30, 31)]
    pairs = spark.createDataFrame(rows, "a long, b long")
    table = spark.createDataFrame([(i, f"x{i}") for i in range(40)], "doc_id long, wide string")
    with kit.small_broadcasts(spark):
        out = ngram_join._beside(pairs, table)
        assert sorted(tuple(r) for r in out.select("a", "b", "a_wide", "b_wide").collect()) == sorted((a, b, f"x{a}", f"x{b}") for a, b in rows)


def test_the_driver_is_not_sent_what_files_hide(spark):
    """A small file of many rows, times 16 by an explode, is not broadcast while components are found."""
    was, seen = spark.conf.get(kit.BROADCAST), []

    class Seen(kit.Workspace):
        def save(self, df, name, by=None):
            seen.append(self.spark.conf.get(kit.BROADCAST))
            return super().save(df, name, by)

    docs = spark.createDataFrame([(i, f"one two three {i // 2} four five six") for i in range(40)], "doc_id long, text string")
    out = ngram_join.similarity_components(docs, 3, 9, 10, Seen(spark))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {i: i // 2 * 2 for i in range(40)}
    assert set(seen) == {kit.SMALL_TABLE} and spark.conf.get(kit.BROADCAST) == was


def test_rows_and_links_of_a_family_of_edits_grow_with_its_members(spark):
    """A family of texts that are alike but mostly do not link: blocks and what they give grow no faster than the family."""

    def sizes(m):
        rng, rows = np.random.default_rng(3), {}

        class Seen(kit.Workspace):
            def save(self, df, name, by=None):
                out = super().save(df, name, by)
                rows[name] = out.count()
                return out

        base = [f"w{i}" for i in range(120)]
        texts = []
        for i in range(m):
            words = list(base)
            for at in rng.choice(120, 2 + i % 9, replace=False):
                words[at] = f"x{rng.integers(10**9)}"
            texts.append((i, " ".join(words)))
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        got = minhash_dedup.near_duplicates(docs, store=Seen(spark))
        sets = [{(a, b) for a, b in itertools.pairwise(t.split())} for _, t in texts]
        root = list(range(m))
        for x in range(m):
            for y in range(x):
                if 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y]) and root[x] != root[y]:
                    lo, hi = sorted((root[x], root[y]))
                    root = [lo if r == hi else r for r in root]
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(root))
        return max(n for name, n in rows.items() if name not in ("sketch", "shared", "tiles"))

    small, large = sizes(30), sizes(180)
    assert large <= 12 * small and large < 8 * 180


def test_buckets_of_others_bound_what_a_set_shares():
    """A tile's masks hold every other content's bucket, and rows of a set that is met often enough all stay."""
    rng = np.random.default_rng(6)
    some = np.concatenate([rng.integers(0, 1 << 63, 40, np.uint64) * np.uint64(2), np.arange(5, dtype=np.uint64)])  # the last share a bucket
    tile, content = np.repeat(np.arange(300), 6), some[rng.integers(0, 45, 1800)]
    order = np.lexsort((content, tile))
    tile, content = tile[order], content[order]
    first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    mask = ngram_join.others(content, first, np.diff(np.append(first, 1800)))
    for i in range(0, 1800, 7):
        of = {int(c) >> 58 for c in content[tile == tile[i]] if c != content[i]}
        assert int(mask[i]) == sum(1 << b for b in of)
    order = np.argsort(content, kind="stable")
    keep = ngram_join.frequent((content[order],), mask[order], np.full(1800, 9))
    for c in some:
        rows = content[order] == c
        often = {b for b in range(64) if ((mask[order][rows] >> np.uint64(b)) & np.uint64(1)).sum() >= 9}
        assert [bool(k) for k in keep[rows]] == [any(int(m) >> b & 1 for b in often) for m in mask[order][rows]]


def test_chance_meetings_do_not_reach_the_blocks(spark):
    """Texts of a small vocabulary share values with many others, a few with each: they are not compared, and links stay."""
    rows, rng = {}, np.random.default_rng(9)

    class Seen(kit.Workspace):
        def save(self, df, name, by=None):
            out = super().save(df, name, by)
            rows[name] = out.count()
            return out

    texts = [[f"w{j}" for j in rng.integers(0, 60, 120)] for _ in range(160)]
    texts += [[*texts[i][:-3], "x", "y", "z"] for i in range(4)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(48)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, store=Seen(spark)).collect()}
    assert got == {i: i % 160 for i in range(164)}
    assert rows["rest"] < 2 * len(texts)  # 20 a document if chance meetings count
