"""Queries over whole tables against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import pandas as pd
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphlake.graph import Graph
from graphlake.operators import documents, paths
from graphlake.sources.tables import KINDS, VERTEX

AT = "/root/testdata/sf0.001"
SUPPLIER, PART = KINDS["supplier"] * VERTEX, KINDS["part"] * VERTEX


@pytest.fixture(scope="module")
def tables():
    return {t: pd.read_parquet(f"{AT}/{t}.parquet") for t in ("lineitem", "part", "supplier")}


def run(spark, name):
    return [tuple(r) for r in entry.queries()[name](spark, AT).collect()]


def test_triangles_of_all_parts(spark, tables):
    near = defaultdict(set)
    for parts in tables["lineitem"].groupby("l_orderkey")["l_partkey"].unique():
        for u, v in combinations(parts, 2):
            near[u].add(v)
            near[v].add(u)
    want = {PART + p: sum(len(near[p] & near[q]) for q in near[p]) // 2 for p in tables["part"]["p_partkey"]}
    assert dict(run(spark, "triangles")) == want
    assert run(spark, "triangle_total") == [(sum(want.values()) // 3,)]


def test_passages(spark):
    item = [f"w{i}" for i in range(20)]
    items = [(1, " ".join(item)), (2, "only  three words"), (3, " "), (4, None)]
    docs = [(1, " ".join(["x", *item[10:]])), (2, " ".join(["y", *item[1:]])), (3, " ".join(item[:7])), (4, "these only three\nwords"), (5, "three words only"), (6, None)]
    found = documents.passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (4, 2)]


def test_components_and_costs_of_all_supply_edges(spark, tables):
    line = tables["lineitem"]
    arcs = defaultdict(lambda: float("inf"))
    for s, p, price in zip(SUPPLIER + line["l_suppkey"], PART + line["l_partkey"], line["l_extendedprice"]):
        arcs[s, p] = arcs[p, s] = min(arcs[s, p], round(price * 100))
    ids = [*(SUPPLIER + tables["supplier"]["s_suppkey"]), *(PART + tables["part"]["p_partkey"])]
    root, before = {i: i for i in ids}, None
    while root != before:
        before = dict(root)
        for a, b in arcs:
            root[b] = min(root[a], root[b])
    assert dict(run(spark, "wcc")) == root
    sizes = pd.Series(root).value_counts()
    assert sorted(run(spark, "partition_sizes")) == sorted(sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[:10])
    best = {SUPPLIER + 3: 0.0}
    for _ in range(4):
        now = dict(best)
        for (a, b), w in arcs.items():
            if a in best:
                now[b] = min(now.get(b, float("inf")), best[a] + w)
        best = now
    assert dict(run(spark, "dijkstra_cost")) == best


def test_k_cheapest_equals_all_simple_paths(spark):
    rng = random.Random(7)
    arcs = [(100 + i, *rng.sample(range(9), 2), rng.choice([0.1, 0.2, 0.3, 0.7])) for i in range(24)]
    edges = spark.createDataFrame([(i, a, b, "to", None, w) for i, a, b, w in arcs], "id long, src long, dst long, edge_type string, label string, weight double")
    g = Graph(spark.range(9).withColumn("label", F.lit("v")), edges)
    found = []

    def walk(at, seen, steps, weight):
        if at == 8:
            found.append((round(weight, 9), len(steps), ",".join(steps)))
        elif len(steps) < 4:
            for i, a, b, w in arcs:
                for near, far, way in ((a, b, "out"), (b, a, "in")):
                    if near == at and far not in seen:
                        walk(far, [*seen, far], [*steps, f"{i}:{way}"], weight + w)

    walk(0, [0], [], 0.0)
    for k in (1, 4, 1000):
        got = paths.k_cheapest(g, 0, 8, k, 4, edge_cost=F.col("weight")).select("weight", "hops", "signature").collect()
        weights = [w for w, _, _ in sorted(found)[:k]]
        assert [round(w, 9) for w, _, _ in got] == weights
        assert {(round(w, 9), h, s) for w, h, s in got} <= set(found)
        assert len({s for _, _, s in got}) == len(weights)


@pytest.mark.parametrize("direction", ["both", "out", "in"])
def test_k_cheapest_with_filters_and_costs_equals_all_simple_paths(spark, direction):
    rng = random.Random(8)
    arcs = [(100 + i, *rng.sample(range(10), 2), rng.choice([0.25, 0.5, 1.0])) for i in range(60)]
    edges = spark.createDataFrame([(i, a, b, "to", None, w) for i, a, b, w in arcs], "id long, src long, dst long, edge_type string, label string, weight double")
    g = Graph(spark.range(10).withColumn("label", F.lit("v")), edges)
    found = []

    def walk(at, seen, steps, weight):
        if at == 8:
            found.append((weight, len(steps), ",".join(steps)))
        elif len(steps) < 3:
            for i, a, b, w in arcs:
                for near, far, way in ((a, b, "out"), (b, a, "in")):
                    if near == at and far not in (*seen, 5) and direction in ("both", way) and i % 7:
                        walk(far, [*seen, far], [*steps, f"{i}:{way}"], weight + w + far / 8)

    walk(0, [0], [], 0.0)
    how = {"direction": direction, "edge_cost": F.col("weight"), "vertex_cost": F.col("id") / 8, "edge_filter": F.col("id") % 7 != 0, "vertex_filter": F.col("id") != 5}
    got = paths.k_cheapest(g, 0, 8, 1000, 3, **how).orderBy("rank").select("weight", "hops", "signature").collect()
    assert [tuple(r) for r in got] == sorted(found) and len({h for _, h, _ in found}) > 1
