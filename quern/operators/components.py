"""Connected components by smallest member, without collecting the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.tables import materialise


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node is connected with.

    `nodes` has a column node, `edges` the columns a and b (undirected; loops,
    repeats and nulls are ignored). Rounds of the small-star and large-star
    operations shrink the graph to stars; each is written to the checkpoint
    folder. A node of high degree only ever is the target of partial minima, so
    it isn't gathered in one task. Nodes without edges are their own component. The
    rounds grow with the logarithm of the longest path; an error tells if they don't do.
    """
    e = materialise(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: greater neighbours of a go to its least.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        # Small star: a and its smaller neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = materialise(small)
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components aren't complete after {most_rounds} rounds")
    return nodes.select("node").distinct().join(e.groupBy("a").agg(F.min("b").alias("m")), F.col("node") == F.col("a"), "left").select("node", F.coalesce("m", "node").alias("component"))
