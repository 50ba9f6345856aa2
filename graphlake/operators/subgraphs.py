"""Named subgraphs by recipe, and namespaces of graphs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.operators.patterns import EdgeStep, subgraph
from graphlake.sources import versions
from graphlake.sources.workspace import discard


class QuotaExceeded(ValueError):
    """A registry would hold more than it may."""


@dataclass(frozen=True)
class Quota:
    """How much a registry may hold; a pattern's longest variable edge."""

    subgraphs: int = 1_024
    elements: int = 10_000_000
    total: int = 25_000_000
    variable_length: int = 20


@dataclass
class _Entry:
    recipe: dict
    source: str | None
    graph: Graph
    elements: int


@dataclass
class Subgraphs:
    """Subgraphs of ``source()`` kept with the recipe they were made by, the
    arguments of :func:`subgraph`; one may stand on another."""

    source: Callable[[], Graph]
    quota: Quota = field(default_factory=Quota)
    _held: dict[str, _Entry] = field(default_factory=dict)

    def _made(self, recipe: dict, on: str | None) -> tuple[Graph, int]:
        for step in recipe.get("steps") or []:
            if isinstance(step, EdgeStep) and step.high > self.quota.variable_length:
                raise QuotaExceeded(f"an edge may be {self.quota.variable_length} long at most")
        graph = subgraph(self._held[on].graph if on else self.source(), **recipe)
        size = graph.vertices.count() + graph.edges.count()
        if size > self.quota.elements:
            raise QuotaExceeded(f"{size} elements are more than {self.quota.elements}")
        return graph, size

    def _fits(self, more: int, but: str | None = None) -> None:
        if sum(e.elements for n, e in self._held.items() if n != but) + more > self.quota.total:
            raise QuotaExceeded(f"all subgraphs together may have {self.quota.total} elements")

    def create(self, name: str, recipe: dict, on: str | None = None) -> Graph:
        if name in self._held:
            raise ValueError(f"{name} exists")
        if on is not None and on not in self._held:
            raise KeyError(on)
        if len(self._held) >= self.quota.subgraphs:
            raise QuotaExceeded(f"there are {self.quota.subgraphs} subgraphs")
        graph, size = self._made(recipe, on)
        self._fits(size)
        self._held[name] = _Entry(recipe, on, graph, size)
        return graph

    def list(self) -> list[tuple[str, str | None, int]]:
        """(name, what it stands on, elements) by name."""
        return [(n, e.source, e.elements) for n, e in sorted(self._held.items())]

    def get(self, name: str) -> Graph:
        return self._held[name].graph

    def contents(self, name: str, kind: str = "vertex", limit: int = 100, offset: int = 0) -> DataFrame:
        from graphlake.operators.scan import page

        g = self.get(name)
        return page(g.vertices if kind == "vertex" else g.edges, ["id"], limit, offset)

    def recalculate(self, name: str) -> Graph:
        """Run the recipe again on its source as it is now, then those that stand on
        it. If one no longer fits, all stay as they were."""
        before = dict(self._held)
        try:
            todo = [name]
            while todo:
                at = todo.pop(0)
                old = self._held[at]
                graph, size = self._made(old.recipe, old.source)
                self._fits(size, at)
                self._held[at] = _Entry(old.recipe, old.source, graph, size)
                todo += [n for n, e in sorted(self._held.items()) if e.source == at]
        except QuotaExceeded:
            self._held = before
            raise
        return self.get(name)

    def remove(self, name: str) -> None:
        if used := [n for n, e in self._held.items() if e.source == name]:
            raise ValueError(f"{', '.join(sorted(used))} stands on {name}")
        del self._held[name]


class Namespaces:
    """Graphs by name under one folder, each with its saved versions and whether it
    is loaded at the start ('load') or when it is first asked for ('lazy')."""

    POLICIES = ("load", "lazy")

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._active: dict[str, Graph] = {}

    def _at(self, name: str) -> str:
        if not name or not all(c.isalnum() or c in "-_" for c in name):
            raise ValueError("a namespace is named by letters, digits, - and _")
        return f"{self.folder}/{name}"

    def _file(self, name: str) -> str:
        return f"{self._at(name)}/namespace"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def list(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if self._exists(f"{s.getPath()}/namespace")) if fs.exists(at) else []

    def get(self, name: str) -> dict:
        if not self._exists(self._file(name)):
            raise KeyError(name)
        return json.loads(self.spark.read.text(self._file(name)).first()[0])

    def create(self, name: str, policy: str = "lazy") -> None:
        if self._exists(self._file(name)):
            raise ValueError(f"{name} exists")
        self._put(name, {"policy": policy})

    def update(self, name: str, policy: str) -> None:
        self._put(name, self.get(name) | {"policy": policy})

    def _put(self, name: str, told: dict) -> None:
        if told["policy"] not in self.POLICIES:
            raise ValueError(f"policy must be one of {self.POLICIES}")
        self.spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(self._file(name))

    def save(self, name: str, graph: Graph, version: str) -> None:
        self.get(name)
        versions.save(graph, self._at(name), version)

    def activate(self, name: str) -> Graph:
        """The graph of the last saved version."""
        self.get(name)
        if name not in self._active:
            last = versions.versions(self.spark, self._at(name)).agg(F.max("version")).first()[0]
            self._active[name] = versions.load(self.spark, self._at(name), last)
        return self._active[name]

    def start(self) -> list[str]:
        """Activate those that are to be loaded at the start; their names."""
        names = [n for n in self.list() if self.get(n)["policy"] == "load"]
        for n in names:
            self.activate(n)
        return names

    def drop(self, name: str) -> None:
        self.get(name)
        self._active.pop(name, None)
        discard(self.spark, self._at(name))
