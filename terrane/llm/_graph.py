"""Connected components of an edge table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm._spark import forget, keep


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the least node reachable, for ``edges`` of longs (a, b).

    Alternates large-star and small-star (Kiveris et al. 2014): each round ties the neighbours
    of a node to the least of them, so the number of edges does not grow and the number of
    rounds is logarithmic.  Nodes without an edge to another node are not returned.
    """

    def nearest(e: DataFrame) -> DataFrame:
        return e.join(e.groupBy("a").agg(F.min("b").alias("m")), "a")

    def stars(e: DataFrame) -> bool:
        """Whether each node has one neighbour below it, and none of those has one itself."""
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()

    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not stars(e):
        both = e.union(e.select("b", "a"))
        large = nearest(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        near = nearest(large)
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b"))).distinct()
        last, e = e, keep(small, "edges")
        forget(last)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
