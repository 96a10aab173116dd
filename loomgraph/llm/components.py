"""Connected components of links between 64-bit ids, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest id reachable from every id in links ``(a, b)``.

    Large and small star steps (Kiveris et al., 2014) take turns: an id's larger
    neighbours, and then its smaller ones, are linked to the smallest of all
    instead. Rounds grow with the logarithm of the longest path. Smallest
    neighbours are partial aggregates, so an id with very many links is spread.
    Each round is written, and the loop ends when a round changes nothing. All
    sides grow with the input and are merged, not broadcast.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest.hint("merge"), "u")
        edges = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(lowest.select("u", F.col("m").alias("v"))).distinct(),
            "small",
        )
        found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if found == mark:
            break
        mark = found
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
