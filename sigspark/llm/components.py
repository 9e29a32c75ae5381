"""Connected components of an undirected graph of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps: each round is two aggregations and two
    joins on the node, the lineage is cut after each round, and a component of diameter d
    needs about log d rounds. A node with very many neighbours is a hot join key only on the
    side that adaptive execution can split; the minimum is combined before the shuffle.
    Empty input gives no rows; loops and repeated edges do no harm.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs = written(pairs)
    for _ in range(most_rounds):
        # Large star: neighbours above a node move to the least of its neighbourhood.
        both = pairs.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        large = pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")).join(least, "n").select(F.col("m").alias("hi"), F.col("least").alias("lo"))
        large = large.filter("hi <> lo").distinct()
        # Small star: a node's lower neighbours and the node itself move to its least neighbour.
        low = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).filter("hi <> lo")
        after = written(small.union(low.select("hi", F.col("least").alias("lo"))).distinct())
        same = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first() == after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        pairs = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
