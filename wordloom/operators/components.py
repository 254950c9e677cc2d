"""Connected components of an undirected edge table, without driver-side graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.plans.staging import Workspace


def connected_components(edges: DataFrame, work: Workspace, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (node, root): the smallest node reachable from each node that has an edge.

    Every round hooks each root that has a smaller neighbour to its smallest
    one, shortens the hooks by two jumps, and contracts the edges to the new
    roots; only edges between different roots stay.  A round costs shuffles of
    the edges that are left, which fall geometrically.  Null ends, self-loops
    and repeated edges are ignored.  An empty table gives an empty result.
    """
    kind = edges.schema[left].dataType
    a, b = F.col(left).cast(kind), F.col(right).cast(kind)
    live = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    live = work.write(live.where("a <> b").distinct(), "edges")
    root, first = None, True
    while not live.isEmpty():
        hook = live.groupBy("a").agg(F.min("b").alias("p"))
        for _ in range(2):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        hook = work.write(hook, "hooks")
        if root is None:
            nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            root = nodes.withColumn("root", F.col("node"))
        moved = root.join(hook.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        done = [live, hook, *([] if first else [root])]
        root, first = work.write(moved, "roots"), False
        for end in ("a", "b"):
            to = hook.select(F.col("a").alias(end), F.col("p").alias("to"))
            live = live.join(to, end, "left").select(*[(F.coalesce("to", end) if c == end else F.col(c)).alias(c) for c in ("a", "b")])
        live = live.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        live = work.write(live, "edges")
        work.drop(*done)
    if root is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root
