"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored


def connected(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Columns v and c for every node of the edges: c is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then the label's own label, so long chains halve. The
    minimum is taken before the shuffle too, so a node with very many edges costs one row a task. Every round is written
    to the shared folder. Loops stop when no label changes; only two numbers come to the driver.
    """
    both = stored(edges.select(F.col(a).alias("v"), F.col(b).alias("u")).filter("v <> u").union(edges.select(F.col(b).alias("v"), F.col(a).alias("u")).filter("v <> u")).distinct())
    nodes = stored(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("c")))
    for _ in range(most_rounds):
        near = both.join(nodes.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("m"))
        down = nodes.join(near, "v", "left").select("v", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = down.join(nodes.select(F.col("v").alias("c"), F.col("c").alias("cc")), "c", "left").select("v", "old", F.least("c", F.coalesce("cc", "c")).alias("c"))
        nodes = stored(jump)
        if nodes.filter("c <> old").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("the components did not settle")
    return nodes.select("v", "c")
