"""Scans, filters and adjacency reads (all are plain filters and joins, so
predicates and column pruning reach the files)."""

from __future__ import annotations

from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake.graph import Graph, both_ways

COMPARE = {
    "eq": lambda c, x: c == x,
    "gt": lambda c, x: c > x,
    "ge": lambda c, x: c >= x,
    "lt": lambda c, x: c < x,
    "le": lambda c, x: c <= x,
    "ne": lambda c, x: c != x,
}
RESERVED = "$embedding"


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType | T.CharType | T.VarcharType):
        return "text"
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "time"
    return kind.typeName()


def _family_of(literal) -> str:
    if isinstance(literal, bool):
        return "boolean"
    if isinstance(literal, int | float | Decimal):
        return "number"
    if isinstance(literal, str):
        return "text"
    return "time" if isinstance(literal, date) else type(literal).__name__


def compare(column: Column, op: str, literal, kind: T.DataType | None = None) -> Column:
    """The comparison; an absent (null) property matches none, 'ne' included. With
    the column's type, a literal of another family (text, number, time, truth) is
    equal to no value and stands in no order with one: only 'ne' matches."""
    if kind is not None and _family(kind) != _family_of(literal):
        return column.isNotNull() if op == "ne" else F.lit(False)
    return COMPARE[op](column, F.lit(literal))


def of_kind(graph: Graph, kind: str) -> DataFrame:
    return {"vertex": graph.vertices, "edge": graph.edges, "both": graph.elements()}[kind]


def by_label(elements: DataFrame, label: str | None) -> DataFrame:
    return elements if label is None else elements.where(F.col("label") == label)


def property_scan(graph: Graph, key: str, op: str, literal, label: str | None = None, kind: str = "both") -> DataFrame:
    """Elements whose property compares; a key nobody has matches nothing."""
    found = by_label(of_kind(graph, kind), label)
    return found.where(compare(F.col(f"`{key}`"), op, literal, found.schema[key].dataType)) if key in found.columns else found.limit(0)


def any_property_scan(graph: Graph, term: str, label: str | None = None, kind: str = "both", strings_only: bool = False) -> DataFrame:
    """Elements any of whose properties, as text, contains the term regardless of
    case; a blank term matches nothing, reserved keys are not searched."""
    found = by_label(of_kind(graph, kind), label)
    fixed = {"id", "label", "src", "dst", "edge_type", "kind", "creation_ts", "modification_delta"}
    fields = [f for f in found.schema if f.name not in fixed and not f.name.startswith(RESERVED)]
    fields = [f for f in fields if isinstance(f.dataType, T.StringType) or not strings_only and isinstance(f.dataType, T.AtomicType)]
    if not term.strip() or not fields:
        return found.limit(0)
    tests = [F.coalesce(F.contains(F.lower(F.col(f"`{f.name}`").cast("string")), F.lit(term.lower())), F.lit(False)) for f in fields]
    return found.where(reduce(lambda a, b: a | b, tests))


def get(graph: Graph, ids: DataFrame, kind: str = "both", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(found elements, ids that are not there)."""
    wanted = ids.select(F.col(id_col).alias("__wanted")).distinct()
    elements = of_kind(graph, kind)
    found = elements.join(wanted, F.col("id") == F.col("__wanted"), "left_semi")
    missing = wanted.join(elements.select("id"), F.col("id") == F.col("__wanted"), "left_anti").withColumnRenamed("__wanted", id_col)
    return found, missing


def sample(graph: Graph, max_elements: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The first vertices, then the first edges, by id: a display sample."""
    return graph.vertices.orderBy("id").limit(max_elements), graph.edges.orderBy("id").limit(max_elements)


def stride_sample(elements: DataFrame, budget: int) -> DataFrame:
    """Every k-th element in id order, with the least k that gives ``budget`` rows or
    fewer; all where they fit. (A statistic over a sample; exact ones need none.)"""
    if budget < 1:
        raise ValueError("a budget is 1 or more")
    total = elements.count()
    if total <= budget:
        return elements
    from graphlake.operators.mutate import dense_ids

    return dense_ids(elements, into="__n").where(F.col("__n") % -(-total // budget) == 0).drop("__n")


def members(partitions: DataFrame, partition: int, column: str = "component", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the ids in one partition of an analytics result, in id order."""
    return page(partitions.where(F.col(column) == partition).select("id"), ["id"], limit, offset)


def page(df: DataFrame, order: list, limit: int = 100, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be 1 to 10000")
    return df.orderBy(*order).offset(offset).limit(limit)


def count_by_kind(graph: Graph) -> DataFrame:
    return graph.elements().groupBy("kind").agg(F.count("*").alias("n"))


def neighbors(graph: Graph, of: Column | None = None) -> DataFrame:
    """(id, neighbor, edge_id, direction): a bag, one entry per edge and end."""
    bag = both_ways(graph.edges).select(F.col("near").alias("id"), F.col("far").alias("neighbor"), F.col("id").alias("edge_id"), "direction")
    return bag.where(of) if of is not None else bag


def hop(frontier: DataFrame, graph: Graph, direction: str = "out", id_col: str = "id") -> DataFrame:
    """(near, far, edge_id, direction) for every edge that leaves the frontier."""
    from graphlake.graph import walkable

    at = frontier.select(F.col(id_col).alias("__at")).distinct()
    e = walkable(graph.edges, direction)
    return e.join(at, F.col("near") == F.col("__at"), "left_semi").select("near", "far", F.col("id").alias("edge_id"), "direction")


def degrees(graph: Graph, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """(id, degree) of every vertex, zero included; a self-loop counts out and in."""
    e = graph.edges if edge_type is None else graph.edges.where(F.col("edge_type") == edge_type)
    ends = {"out": [F.col("src")], "in": [F.col("dst")], "both": [F.col("src"), F.col("dst")]}[direction]
    counted = e.select(F.explode(F.array(*ends)).alias("__v")).groupBy("__v").agg(F.count("*").alias("__n"))
    return graph.vertices.select("id").join(counted, F.col("id") == F.col("__v"), "left").select("id", F.coalesce("__n", F.lit(0)).alias("degree"))


def edge_types(graph: Graph, vertex: int, direction: str = "out") -> DataFrame:
    return graph.edges.where(F.col("src" if direction == "out" else "dst") == vertex).select("edge_type").distinct()
