"""Pattern matching: alternating vertex and edge steps, one join per hop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.graph import Graph, walkable
from graphlake.sources.workspace import materialised


@dataclass(frozen=True)
class VertexStep:
    where: Column | None = None


@dataclass(frozen=True)
class EdgeStep:
    direction: str = "out"
    types: tuple[str, ...] = ()
    where: Column | None = None
    low: int = 1
    high: int = 1


Step = VertexStep | EdgeStep


def check(steps: list[Step]) -> None:
    """Steps alternate, end in a vertex, and do not begin with a variable edge."""
    if not steps or not isinstance(steps[-1], VertexStep):
        raise ValueError("a pattern ends in a vertex step")
    for a, b in zip(steps, steps[1:]):
        if isinstance(a, VertexStep) == isinstance(b, VertexStep):
            raise ValueError("vertex and edge steps alternate")
    for i, s in enumerate(steps):
        if isinstance(s, EdgeStep):
            if not 0 <= s.low <= s.high or s.high < 1:
                raise ValueError("an edge step needs 0 <= low <= high and high >= 1")
            if i == 0 and (s.low, s.high) != (1, 1):
                raise ValueError("a pattern does not begin with a variable-length edge")


def _edges(graph: Graph, step: EdgeStep) -> DataFrame:
    e = graph.edges if not step.types else graph.edges.where(F.col("edge_type").isin(*step.types))
    e = e if step.where is None else e.where(step.where)
    return walkable(e, step.direction).select(F.col("near").alias("__near"), F.col("far").alias("__far"), F.col("id").alias("__edge"))


def bindings(graph: Graph, steps: list[Step], vertices: DataFrame | None = None) -> DataFrame:
    """(path): the ids of every match in order, vertices and edges alternating. No
    match repeats a vertex or an edge; only the last vertex of a variable-length
    edge is tested by the step after it."""
    check(steps)
    v = graph.vertices if vertices is None else vertices
    at = lambda step: (v if step.where is None else v.where(step.where)).select(F.col("id").alias("__v")).distinct()
    first, rest = steps[0], steps[1:]
    if isinstance(first, VertexStep):
        paths = at(first).select(F.array("__v").alias("path"), F.col("__v").alias("last"))
    else:
        paths = _edges(graph, first).where("__near <> __far").select(F.array("__near", "__edge", "__far").alias("path"), F.col("__far").alias("last"))
    for step in rest:
        if isinstance(step, VertexStep):
            paths = paths.join(at(step), F.col("last") == F.col("__v"), "left_semi")
            continue
        edges = _edges(graph, step)
        out = paths if step.low == 0 else None
        for length in range(1, step.high + 1):
            on = paths.join(edges, F.col("last") == F.col("__near"))
            on = on.where(~F.array_contains("path", F.col("__far")) & ~F.array_contains("path", F.col("__edge")))
            paths = on.select(F.concat("path", F.array("__edge", "__far")).alias("path"), F.col("__far").alias("last"))
            if step.high > 1:
                paths = materialised(paths)
            if length >= step.low:
                out = paths if out is None else out.unionAll(paths)
        paths = out
    return paths.select("path")


def subgraph(graph: Graph, vertex_filter: Column | None = None, edge_filter: Column | None = None, steps: list[Step] | None = None, renumber: bool = False) -> Graph:
    """The vertices that pass, the passing edges between them, and of those, with a
    pattern, the elements on some match. With ``renumber`` ids become dense and
    ``source_id`` tells the old ones. No match gives an empty graph."""
    kept = graph if vertex_filter is None else graph.with_vertices(graph.vertices.where(vertex_filter))
    kept = kept.without_loose_ends()
    kept = kept if edge_filter is None else kept.filter_edges(edge_filter)
    if steps:
        ids = materialised(bindings(kept, steps).select(F.explode("path").alias("__id")).distinct())
        kept = Graph(
            kept.vertices.join(ids, F.col("id") == F.col("__id"), "left_semi"), kept.edges.join(ids, F.col("id") == F.col("__id"), "left_semi"), f"{graph.name}-match", closed=True
        )
    if renumber:
        from graphlake.operators.mutate import trim

        return trim(kept)
    return kept


def nested(graph: Graph, *recipes: dict) -> Graph:
    """Subgraphs of subgraphs: each recipe is the arguments of :func:`subgraph`."""
    for recipe in recipes:
        graph = subgraph(graph, **recipe)
    return graph
