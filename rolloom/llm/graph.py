"""Connected components of a distributed graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``, longs); ``root`` is the
    smallest node of its component.

    In each round every node with a smaller neighbour hooks onto its smallest one,
    chains of hooks are shortened by pointer doubling, and the edges are carried over
    to the roots; those inside a component vanish. Rounds grow with the logarithm of
    the number of nodes, and each leaves a written table."""
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    live = materialize(ordered, "graph-edges")
    labels = materialize(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("root", F.col("node")), "graph-labels")
    while not live.isEmpty():
        hooks = materialize(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "graph-hooks")
        while True:
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            jumped = materialize(hooks.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "graph-hooks")
            release(hooks)
            moved = not jumped.where("moved").isEmpty()
            hooks = jumped.select("node", "parent")
            hooks._rolloom_path = jumped._rolloom_path
            if not moved:
                break
        to = hooks.select(F.col("node").alias("root"), "parent")
        fresh = materialize(labels.join(to, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "graph-labels")
        a, b = hooks.select(F.col("node").alias("a"), F.col("parent").alias("pa")), hooks.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        carried = live.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
        nxt = materialize(carried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "graph-edges")
        for done in (hooks, labels, live):
            release(done)
        labels, live = fresh, nxt
    return labels
