"""Connected components of a table of links, by large-star and small-star steps.

Both steps give every node's neighbours to the least of them; a large star
hangs the greater neighbours, a small star the lesser ones and the node itself.
The number of links never grows, and they end as stars around the least node of
each component. A node with very many neighbours is a sum in parts and a join
that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.tables import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    hung = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def _canonical(links: DataFrame) -> DataFrame:
    return links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def contract(links: DataFrame) -> DataFrame:
    """One pair of steps: links (a > b) that connect the same nodes, nearer to stars."""
    return written(_small_star(_large_star(_canonical(links))), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, least) for every node in a link of (a, b); nodes that are least themselves are left out."""
    edges = written(_canonical(links), "links")
    state = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == state or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("least"))
        state = seen
        edges = contract(edges)
