"""Connected components of a graph of ids, fully distributed.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014): each step only needs a minimum per node, which is pre-aggregated, and a join
that adaptive execution may split, so a hub with many links never gathers in one task. Lineage is
cut with tables in the shared folder; each step's replaces the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import discarded, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids -> (node, component): the smallest id reachable, for linked nodes.

    Self-links, repeated links and nulls are ignored; an empty table gives an empty result.
    """
    e = _stars(edges)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v): every linked node but the smallest of its component, with that one."""
    e = (
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = stored(e, "links")
    while not _is_stars(e):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u is linked to u's least neighbour
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).filter("u <> v")
        # small star: u and its smaller neighbours are linked to the least of them
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select("u", F.col("m").alias("v"))
        )
        shorter = stored(small.filter("u <> v").distinct(), "links")
        discarded(e)
        e = shorter
    return e


def _is_stars(e: DataFrame) -> bool:
    """Whether every u has one link, to a v that is no u; u > v, so v is then its component's smallest."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        e.select("v", F.lit(0), F.lit(1))
    )
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return each.filter("up > 1 or (up > 0 and down > 0)").agg(F.count("*").alias("n")).first()["n"] == 0
