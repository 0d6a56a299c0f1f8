"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.scratch import materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternating large-star and small-star steps: every node hands its neighbours
    to the smallest one it knows, until each component is a star around its
    minimum. Minima are aggregated before the shuffle, so a hub is no hot group;
    its links are join rows, which adaptive execution splits. Each round is
    written to the shared folder: nothing is collected but a count and a checksum,
    and a lost executor costs a re-read. Edges with a NULL end and loops are left
    out; no edges give an empty table.
    """
    u, v = F.col("u"), F.col("v")
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (u != v))
    links = materialize(links.distinct(), "links")
    seen = None
    while (state := _state(links)) != seen:
        seen = state
        both = links.unionByName(links.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = both.filter(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        # second step on the nodes' smaller neighbours only; large holds (node, smaller)
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct(v.alias("u"), F.col("m").alias("v")), F.struct(u.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        links = materialize(small.filter(u != v).distinct(), "links")
    return links.select(u.alias("node"), v.alias("component")).unionByName(links.select(v.alias("node"), v.alias("component")).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
