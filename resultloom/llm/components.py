"""Connected components of a graph given as links, as rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns u, v of one orderable type); the component is its smallest node.

    Alternating star rounds: first every larger neighbour of a node is tied to the node's smallest neighbour, then every smaller
    one. Each round is written to the shared folder; rounds grow with the logarithm of the largest component. Grouped minima are
    combined before the shuffle, so a node that is part of a third of all links is no single task's work.
    """
    links = stored(_ordered(links), "links")
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # a node below all its neighbours leaves its links as they are; only the others need their smallest neighbour
        moved = least.filter(F.col("m") < F.col("u"))
        large = both.filter(F.col("v") > F.col("u")).join(moved, "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct()
        large = stored(large, "links")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(smallest, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(_ordered(rest.unionByName(smallest.select("u", F.col("m").alias("v")))), "links")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _ordered(links: DataFrame) -> DataFrame:
    return links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
