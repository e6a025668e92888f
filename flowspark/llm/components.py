"""Connected components of links, by alternating large and small stars; every round is two groupings with joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stashed


def _least_neighbour(sides: DataFrame) -> DataFrame:
    """``sides`` (u, v) with ``m``: the least of u and all its v."""
    least = sides.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))  # combined before the shuffle, so hubs don't hurt
    return sides.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: the least node reachable, for every node of the links (a, b). Nulls and loops are no links."""
    edges = stashed(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                    "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least_neighbour(large)
        linked = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stashed(linked.unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (now["n"], now["x"]) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = (now["n"], now["x"])
