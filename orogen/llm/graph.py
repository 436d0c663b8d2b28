"""Connected components over an edge table, without collecting nodes or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import Workspace

PARTS = 16


def components(edges: DataFrame, store: Workspace, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b).

    Every round takes the least label of the neighbours and then follows the
    label's own label, so a path of n nodes needs about log n rounds. Each round is
    a written table. Only nodes that have an edge are returned; nulls and loops
    in the edge table are ignored.
    """
    both = edges.filter("a <> b").select("a", "b")
    both = store.save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other"))
    label = store.save(label.select("node", F.least("node", "other").alias("component")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        # of the labels in use, those with a smaller label of their own; a giant component's label is looked up by parts
        named = label.filter("component < node").join(label.select(F.col("component").alias("node")).distinct(), "node", "left_semi")
        jump = named.select(F.col("node").alias("now"), F.col("component").alias("beyond"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        step = step.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
        step = step.join(jump, ["now", "part"], "left").select("node", "was", F.least("now", F.coalesce("beyond", "now")).alias("component"))
        step = store.save(step, f"{name}-{turn}")
        label, last = step.select("node", "component"), f"{name}-{turn - 1}"
        still = step.filter("was <> component").limit(1).count()
        store.drop(last)
        if not still:
            store.drop(f"{name}-edges")
            return label
