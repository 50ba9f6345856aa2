"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.sources.workspace import discard, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every vertex that has an edge to another one; the
    component is its smallest member's id, direction is ignored. Ids may be of any
    type that has an order, structs included.

    Self-loops, repeated edges and edges with a null end change nothing. Each
    round is a large-star and a small-star: every vertex hangs its larger
    neighbours, then its smaller ones and itself, on the least vertex it sees. No
    round adds an edge, the rounds grow with the logarithm of a component's size
    whatever the order of ids, and they end when all that is left is stars. The
    tables of a round are removed when the next one stands.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    arcs, at = stored(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "arcs")
    while not _only_stars(arcs):
        # The least neighbours are tables of their own, so that the joins can split a hub.
        least, l1 = stored(_least(arcs), "least")
        hung = arcs.join(least.withColumnRenamed("hi", "lo"), "lo", "left").select("hi", F.coalesce("least", "lo").alias("lo"))
        arcs, a1 = stored(hung.distinct(), "arcs")
        least, l2 = stored(_least(arcs), "least")
        rest = arcs.join(least, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        arcs, a2 = stored(rest.union(least.select("hi", F.col("least").alias("lo"))).distinct(), "arcs")
        discard(spark, at, l1, a1, l2)
        at = a2
    return arcs.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(arcs.select("lo", "lo").distinct())


def _least(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("hi").agg(F.min("lo").alias("least"))


def _only_stars(arcs: DataFrame) -> bool:
    """Whether every vertex is the larger end of one arc or only a smaller end."""
    ends = arcs.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(arcs.select("lo", F.lit(0), F.lit(1)))
    seen = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or up > 0 and down > 0").limit(1).count() == 0
