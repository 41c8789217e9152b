"""Connected components over an edge list, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Map each node of `edges` (src, dst long, not null) to the smallest node reachable: (node, component).

    Every round lowers each node's label to the smallest label next to it (a partial aggregation, so a node with
    very many edges is combined before the shuffle), then follows labels once (pointer jumping).  Edges whose ends
    share a label are dropped and the others are rewritten to labels, so both tables shrink.  Rounds grow with the
    logarithm of the longest path.  No rows: an empty result.
    """
    both = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst").distinct()
    both = scratch.save(both, "edges")
    label = both.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("component", F.col("node"))
    label = scratch.save(label, "labels")
    live = both
    while not live.isEmpty():
        # live edges join roots; each root takes the smallest root next to it
        down = live.select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("to")).groupBy("node").agg(F.min("to").alias("to"))
        down = scratch.save(down, "down")
        jumps = down
        while True:
            a, b = jumps.alias("a"), jumps.alias("b")
            step = a.join(b, F.col("a.to") == F.col("b.node"), "left").select(
                F.col("a.node").alias("node"), F.coalesce("b.to", "a.to").alias("to"), F.col("b.to").isNotNull().alias("moved")
            )
            step = scratch.save(step, "jump")
            scratch.drop(jumps)
            moved = not step.filter("moved").isEmpty()  # else every label is a root
            jumps = step.drop("moved")
            jumps.scratch_path = step.scratch_path
            if not moved:
                break
        new_label = label.join(jumps.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        new_label = scratch.save(new_label, "labels")
        s, d = (jumps.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in ("src", "dst"))
        new_live = (
            live.join(s, "src", "left")
            .join(d, "dst", "left")
            .select(F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst"))
            .filter("src <> dst")
            .distinct()
        )
        new_live = scratch.save(new_live, "edges")
        scratch.drop(label, live, jumps)
        label, live = new_label, new_live
    return label
