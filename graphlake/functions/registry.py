"""Named queries, user extensions, and checks of expression fragments.

Filters and costs are SQL expressions or Columns; Spark compiles them, so a
fragment is checked by analysing it against an empty frame of the right columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.graph import Graph


def check_fragment(df: DataFrame, expression: str, kind: str = "boolean") -> list[str]:
    """What is wrong with the expression over ``df``; an empty list if nothing."""
    try:
        found = df.limit(0).select(F.expr(expression).alias("x")).schema["x"].dataType.simpleString()
    except PySparkException as e:
        return [str(e).split("\n")[0]]
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    good = found == "boolean" if kind == "boolean" else found in numeric or found.startswith("decimal")
    return [] if good else [f"the expression is {found}, not {kind}"]


@dataclass
class NamedQuery:
    """A path or subgraph request that can be run by name."""

    name: str
    kind: str
    arguments: dict = field(default_factory=dict)


class QueryLibrary:
    """Named queries: 'path' and 'subgraph', kept as JSON."""

    KINDS = ("path", "subgraph")

    def __init__(self) -> None:
        self._queries: dict[str, NamedQuery] = {}

    def register(self, query: NamedQuery) -> None:
        if query.kind not in self.KINDS:
            raise ValueError(f"kind must be one of {self.KINDS}")
        if query.name in self._queries:
            raise ValueError(f"{query.name} exists")
        self._queries[query.name] = query

    def list(self) -> list[str]:
        return sorted(self._queries)

    def get(self, name: str) -> NamedQuery:
        return self._queries[name]

    def delete(self, name: str) -> None:
        del self._queries[name]

    def run(self, name: str, graph: Graph, **more) -> DataFrame | Graph:
        from graphlake.operators import paths, patterns

        q = self.get(name)
        arguments = {k: F.expr(v) if k.endswith(("_filter", "_cost")) else v for k, v in (q.arguments | more).items()}
        return paths.fewest_hops(graph, **arguments) if q.kind == "path" else patterns.subgraph(graph, **arguments)

    def to_json(self) -> str:
        return json.dumps([asdict(q) for q in self._queries.values()])

    @classmethod
    def from_json(cls, text: str) -> QueryLibrary:
        library = cls()
        for row in json.loads(text):
            library.register(NamedQuery(**row))
        return library


class Extensions:
    """User functions by contract: 'path', 'subgraph', 'analytics' and 'function'
    (graph and named parameters in, graph or table out)."""

    CONTRACTS = ("path", "subgraph", "analytics", "function")

    def __init__(self) -> None:
        self._found: dict[tuple[str, str], Callable] = {}

    def register(self, contract: str, name: str, f: Callable) -> None:
        if contract not in self.CONTRACTS:
            raise ValueError(f"contract must be one of {self.CONTRACTS}")
        if not callable(f):
            raise TypeError("an extension is a callable")
        if (contract, name) in self._found:
            raise ValueError(f"{name} exists")
        self._found[contract, name] = f

    def list(self, contract: str | None = None) -> list[tuple[str, str]]:
        return sorted(k for k in self._found if contract in (None, k[0]))

    def invoke(self, contract: str, name: str, graph: Graph, **parameters):
        return self._found[contract, name](graph, **parameters)

    def delete(self, contract: str, name: str) -> None:
        del self._found[contract, name]


@dataclass(frozen=True)
class TraversalContext:
    """A query vector and how to compare it, for semantic filters and costs."""

    query: list[float]
    metric: str = "cosine"

    def similarity(self, vector: Column) -> Column:
        from graphlake.operators.vectors import literal, similarity

        return similarity(vector, literal(self.query), self.metric)
