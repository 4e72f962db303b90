"""Connected components of a graph given as edges, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versotext.lineage import settled


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of ``edges`` (a long, b long).

    Rounds of two steps, as in the large-star/small-star scheme: every node hands its
    smallest neighbour to its larger neighbours, then to its smaller ones. A node's
    neighbours are only ever reduced to their minimum and joined back, so a hub
    with very many edges is pre-aggregated and its join can be split. Nodes alone
    (a = b) are left out.
    """
    links = settled(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    signature = None
    for _ in range(most_rounds):
        # large star: larger neighbours of a node link to its smallest neighbour (or itself)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: smaller neighbours of a node, and the node, link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = settled(small.where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
