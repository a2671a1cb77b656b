"""Connected components of links between documents, as the near-duplicate operators need them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node of each connected component of links (a, b); large-star and small-star until nothing changes."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "components")
    while True:
        # Large star: every neighbour above u goes to the least of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its neighbours below it go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        after = written(small, "components")
        stats = [x.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first() for x in (edges, after)]
        dropped(edges)
        edges = after
        if tuple(stats[0]) == tuple(stats[1]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least"))
