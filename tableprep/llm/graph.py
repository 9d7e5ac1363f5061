"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large: neighbours above a node go to the least of its neighbourhood.
    Small: neighbours below a node, and the node, go to the least of these."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        moved = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node but the least ones.

    ``edges`` has columns u and v of one ordered type. Links are stored after each
    round in the shared folder; only a count and a checksum reach the driver. The
    number of rounds grows with the logarithm of the longest chain.
    """
    edges, before = stored(edges.filter("u <> v").distinct(), "links"), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now
        edges = stored(_stars(_stars(edges, True), False), "links")
