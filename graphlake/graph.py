"""The property graph as two DataFrames.

``vertices`` has ``id``, ``label`` and one column per property; ``edges`` has
``id``, ``src``, ``dst``, ``edge_type``, ``label`` and its property columns. Ids
of both kinds share one space. An edge type is never null and names the
adjacency group; a label is an annotation and may be null. A null property is
an absent one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERTEX_COLUMNS = ("id", "label")
EDGE_COLUMNS = ("id", "src", "dst", "edge_type", "label")


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    name: str = "graph"
    closed: bool = False  # both ends of every edge are known to be vertices

    def elements(self) -> DataFrame:
        """Vertices and edges in one table, told apart by ``kind``."""
        v = self.vertices.withColumn("kind", F.lit("vertex"))
        return v.unionByName(self.edges.withColumn("kind", F.lit("edge")), allowMissingColumns=True)

    def with_vertices(self, vertices: DataFrame) -> Graph:
        return replace(self, vertices=vertices, closed=False)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges, closed=False)

    def filter_edges(self, *conditions: Column) -> Graph:
        edges = self.edges
        for c in conditions:
            edges = edges.where(c)
        return replace(self, edges=edges)

    def of_types(self, *types: str) -> Graph:
        return self.filter_edges(F.col("edge_type").isin(*types)) if types else self

    def induced(self, scope: DataFrame, by: str = "id") -> Graph:
        """The subgraph on the vertices whose id is in ``scope``: edges stay if both
        ends do."""
        ids = scope.select(F.col(by).alias("__id")).distinct()
        vertices = self.vertices.join(ids, F.col("id") == F.col("__id"), "left_semi")
        return replace(self, vertices=vertices, edges=_between(self.edges, ids), closed=True)

    def without_loose_ends(self) -> Graph:
        """The graph without edges that lack an end. Scopes that are the vertices
        themselves, whole or filtered, need no join of vertices, and a closed graph
        no join at all: each one would read all tables of a union once more."""
        return self if self.closed else replace(self, edges=_between(self.edges, self.vertices.select(F.col("id").alias("__id"))), closed=True)

    def of_labels(self, *labels: str) -> Graph:
        """The induced subgraph on vertices of these labels; a null label is none of them."""
        return self.with_vertices(self.vertices.where(F.col("label").isin(*labels))).without_loose_ends()

    def properties(self, kind: str = "vertex") -> list[str]:
        fixed = VERTEX_COLUMNS if kind == "vertex" else EDGE_COLUMNS
        return [c for c in (self.vertices if kind == "vertex" else self.edges).columns if c not in fixed]


def _between(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids, F.col("src") == F.col("__id"), "left_semi").join(ids, F.col("dst") == F.col("__id"), "left_semi")


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """Each edge once per direction it can be walked: (near, far, direction, id,
    edge_type, ...). A self-loop appears twice, as it does in a neighbour bag."""
    cols = ["id", "edge_type", *keep]
    out = edges.select(F.col("src").alias("near"), F.col("dst").alias("far"), F.lit("out").alias("direction"), *cols)
    back = edges.select(F.col("dst").alias("near"), F.col("src").alias("far"), F.lit("in").alias("direction"), *cols)
    return out.unionAll(back)


def walkable(edges: DataFrame, direction: str = "both", *keep: str) -> DataFrame:
    """:func:`both_ways`, or only the 'out' or 'in' half."""
    if direction == "both":
        return both_ways(edges, *keep)
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.select(F.col(near).alias("near"), F.col(far).alias("far"), F.lit(direction).alias("direction"), "id", "edge_type", *keep)
