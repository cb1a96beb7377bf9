"""Connected components of a link table, without gathering links anywhere.

Every node keeps a parent that only ever gets smaller. A round hooks parents to the smallest parent
that a link offers and then shortcuts each parent to its parent's parent, so the number of rounds
grows with the logarithm of the longest chain. The side of a join that has a row a node is broadcast
where it is counted to be small; otherwise both are shuffled, and as both are checkpointed tables AQE
splits a hot node's rows. Minima are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side


def components(links: DataFrame) -> DataFrame:
    """links(a, b) bigint, both directions implied -> (node, label): label is the smallest node reachable. Only linked nodes have rows; self links count, repeated links are one, and nulls, which no node has, must not come. No links give no rows."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parents = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    state = None
    while True:
        now = parents.agg(F.bit_xor(F.xxhash64("node", "label")).alias("x")).first()["x"]
        if now == state:
            return parents
        state = now
        offered = (both.join(small_side(parents.select(F.col("node").alias("b"), "label")), "b")
                   .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer")))
        seen = cut(offered.join(small_side(parents), "node"))
        hooked = (seen.select("node", F.least("label", "offer").alias("label"))
                  .unionByName(seen.filter("offer < label").select(F.col("label").alias("node"), F.col("offer").alias("label")))
                  .groupBy("node").agg(F.min("label").alias("label")))
        hooked = cut(hooked)
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        parents = cut(hooked.join(small_side(up), "label").select("node", F.col("upper").alias("label")))
