"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import cut, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest reachable node.

    Each round first hangs the larger neighbours of every node on its smallest
    neighbour, then the smaller ones; the edges end as stars, after a number of
    rounds that grows with the logarithm of the longest chain. Neighbours are
    never gathered: a node's minimum is an aggregate that combines before the
    shuffle, and it returns to the edges by a join that Spark may split.
    Edges with a null end and loops are dropped.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
    e, seen = cut(e.distinct(), "edges"), None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state.n:
            break
        seen = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(last)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
