"""Connected components of a graph of links, by repeated hooking and contraction. Native.

In each round every node takes its smallest neighbour for its parent, or itself if that is smaller, and then its
parent's parent; the links become links between what their ends took. Of two linked nodes the larger always goes, so
only nodes without a smaller neighbour are left for the next round, and the rounds grow with the logarithm of the
longest chain or so. A node with very many links is only ever a key of sums that combine before the shuffle, or of a
join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.workspace import Workspace


def connected_components(links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, comp) for each node of links (a, b): comp is the smallest node that can be reached. Nulls are left out."""
    links = ws.save(links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b").distinct())
    comps: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("node"), "p")
        up = parents.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parents = ws.save(parents.join(up, "p").select("node", F.col("pp").alias("p")))
        end_a, end_b = parents.select(F.col("node").alias("a"), F.col("p").alias("pa")), parents.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        fewer = links.join(end_a, "a").join(end_b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        done, links = links, ws.save(fewer)
        ws.drop(done)
        if comps is None:
            comps = parents
            continue
        step = parents.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        older, comps = comps, ws.save(comps.join(step, "p", "left").select("node", F.coalesce("pp", "p").alias("p")))
        ws.drop(older, parents)
    if comps is None:
        return ws.spark.createDataFrame([], "node long, comp long")
    return comps.select("node", F.col("p").alias("comp"))
