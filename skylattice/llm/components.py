"""Connected components of links, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``links`` (a, b): each node's smallest reachable node.

    A round ties every node's larger neighbours to its smallest one, then all its
    smaller neighbours to the smallest of them.  Links only ever move towards the
    smallest node; when a round changes nothing, every node hangs on its root.
    The number of rounds grows with the logarithm of the longest path.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "links-low")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct(), "links-large")
        lowest = stored(large.groupBy("a").agg(F.min("b").alias("low")), "links-lowest")
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(lowest.select("a", "low"))
        old, edges = edges, stored(small.distinct(), "links")
        discard(old, least, large, lowest)
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
