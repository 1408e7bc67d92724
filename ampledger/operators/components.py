"""Connected components of an edge list by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ampledger.operators import grouped
from ampledger.operators.grouped import attach
from ampledger.session import bounded, checkpointed, row_bound, stored

#: Rows in a part of a short edge list.
PART_ROWS = 20_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the smallest node.

    Every node starts with its smallest neighbour. Each round every tree looks up the
    smallest label among its neighbours and hooks its root there, then all labels jump
    two levels. The number of rounds grows with the
    logarithm of the longest path. A round is written to the checkpoint folder, so plans
    do not grow and a lost executor costs one round at most. Labels shared by many nodes
    are mapped through one row per label, never joined node by node. A short edge list has
    few parts, and its labels are broadcast.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a != b").distinct())
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    labels = first.withColumn("root", F.least("node", "root"))
    small = row_bound(both) <= grouped.BROADCAST_ROWS
    parts = 1 + row_bound(both) // PART_ROWS
    both = bounded(both.coalesce(parts), row_bound(both)) if small else both
    while True:
        labels = checkpointed(labels)
        labels = bounded(labels.coalesce(parts), row_bound(both)) if small else labels
        known = F.broadcast(labels) if small else labels
        reach = (
            both.join(known.select(F.col("node").alias("b"), F.col("root").alias("other")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("other").alias("other"))
        )
        seen = Observation()
        up = reach.join(known, "node").groupBy("root").agg(F.min(F.least("root", "other")).alias("up"))
        hooks = checkpointed(up.observe(seen, F.count("*").alias("n"), F.count_if(F.col("up") < F.col("root")).alias("moved")))
        if seen.get["moved"] == 0:
            return labels
        upper = hooks.select(F.col("root").alias("up"), F.col("up").alias("top"))
        jump = bounded(hooks.join(upper, "up", "left").select("root", F.coalesce("top", "up").alias("top")), seen.get["n"])
        labels = attach(labels, jump, ["root"]).select("node", F.col("top").alias("root"))
