"""Connected components of a graph given as rows of edges, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cashweave.llm.common import discard, restage


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable. Nodes without an edge to another node are not listed.

    Every round is two grouped minima and two joins on the node; a node with many
    neighbours costs one row per neighbour, and the number of rounds grows with the
    logarithm of the longest path. Rounds are written to the shared folder. Edges with
    a null end are left out.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    pairs, path = restage(pairs.distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        # each node's larger neighbours go to its smallest one
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # each node and its smaller neighbours go to the smallest of them
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new, new_path = restage(small, "edges")
        now = new.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        discard(spark, path)
        pairs, path = new, new_path
        if now == state or now[0] == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
