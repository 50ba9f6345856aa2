"""Work that large inputs would pay for: joins, rows carried, shuffles."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphlake.operators import analytics
from graphlake.sources.tables import commerce, supply

AT = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scopes_join_edges_once_per_end(spark):
    assert plan(entry.queries()["degree_centrality"](spark, AT)).count("LeftSemi") == 2
    g = commerce(spark, AT).of_labels("part", "orders")
    assert g.closed and g.of_types("contains").closed and not g.with_vertices(g.vertices.limit(1)).closed
    assert analytics.in_scope(g) is g


def test_edges_that_lack_an_end_are_left_out(spark):
    g = supply(spark, AT)
    g = g.with_vertices(g.vertices.where("label = 'part'"))
    assert not g.closed and g.without_loose_ends().edges.count() == 0


def test_rounds_have_tasks_for_their_rows(spark, monkeypatch):
    from graphlake.sources import workspace

    monkeypatch.setattr(workspace, "TASK_ROWS", 1_000)
    seen, stored = [], analytics.stored

    def watched(df, what, *rest):
        seen.append((what, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        return stored(df, what, *rest)

    monkeypatch.setattr(analytics, "stored", watched)
    had = spark.conf.get("spark.sql.shuffle.partitions")
    arcs = 2 * supply(spark, AT).edges.count()
    for run in (analytics.pagerank, analytics.label_propagation):
        seen.clear()
        run(supply(spark, AT), rounds=2, direction="both")
        assert {n for _, n in seen} == {-(-arcs // 1_000)} and spark.conf.get("spark.sql.shuffle.partitions") == had


def test_triangles_carry_numbers_of_the_later_neighbours_only(spark):
    g = entry.queries()["triangle_total"](spark, AT)
    told = plan(g)
    assert "slice(near" in told and dict(analytics._triangles(supply(spark, AT), True)[0].dtypes) == dict.fromkeys(("low", "high", "other"), "int")


def test_chunks_are_made_from_arrow_batches(spark):
    from graphlake.functions import chunks

    docs = spark.createDataFrame([(i, "word " * 100_000) for i in range(9)] + [(50, None), (51, " ")], "doc_id long, text string").coalesce(1)
    found = chunks.chunk(docs)
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "MapInPandas" not in found._jdf.queryExecution().toString()
    assert found.groupBy("doc_id").agg({"chunk_no": "max", "*": "count"}).where("`max(chunk_no)` + 1 = `count(1)`").count() == 9


def test_feed_state_without_python_and_late_events(spark, tmp_path):
    from graphlake.streaming import feed

    def add(*rows):
        events = [("e0", seq, None, kind, "vertex", 1, "user", None, key, value) for seq, kind, key, value in rows]
        spark.createDataFrame(events, feed.SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))

    def told(n):
        stream = feed.materialise(feed.read_stream(spark, str(tmp_path / "in")))
        assert "Python" not in stream._jdf.queryExecution().analyzed().toString() and "InPandas" not in stream._jdf.queryExecution().analyzed().toString()
        feed.run_now(stream, str(tmp_path / "out"), str(tmp_path / "check"), mode="update")
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/batch={n}").select("key", "value", "seq", "removed").collect())

    add((5, "PropertySet", "a", "x"), (6, "PropertyRemoved", "b", "y"), (7, "VertexCreated", "c", "z"))
    assert told(0) == [("a", "x", 5, False), ("b", None, 6, True)]
    add((4, "PropertySet", "a", "late"), (8, "PropertySet", "b", "w"))
    assert told(1) == [("a", "x", 5, False), ("b", "w", 8, False)]


def test_export_sorts_rows_and_not_their_text(spark, tmp_path):
    from graphlake.sources import jsonl

    lines = jsonl.export_lines(supply(spark, AT))
    assert all("to_json" not in x for x in plan(lines).splitlines() if "Sort [" in x) and plan(lines).count("Sort [") == 2
    jsonl.write(supply(spark, AT), str(tmp_path / "g"), compression="gzip")
    numbers = [r["line"] for r in jsonl.numbered_lines(spark, str(tmp_path / "g")).orderBy("line").collect()]
    assert numbers == list(range(1, len(numbers) + 1))
    assert jsonl.read(spark, str(tmp_path / "g")).edges.count() == supply(spark, AT).edges.count()


def test_subgraph_of_a_closed_graph_joins_nothing(spark):
    from graphlake.operators import patterns
    from graphlake.sources.tables import supplies

    g = supplies(spark, AT)
    assert plan(patterns.subgraph(g).edges) == plan(g.edges)


def test_path_searches_number_the_lines_on_the_way_only_and_once(spark, monkeypatch):
    from graphlake.operators import paths

    seen, materialised = [], paths.materialised

    def watched(df):
        seen.append(plan(df))
        return materialised(df)

    monkeypatch.setattr(paths, "materialised", watched)
    for name in ("k_shortest", "bls_paths", "khop_reach", "dijkstra_cost"):
        seen.clear()
        entry.queries()[name](spark, AT).collect()
        numbered = [p for p in seen if "Window [" in p]
        assert len(numbered) == (name in ("k_shortest", "bls_paths")), name
        assert all("LeftSemi" in p[p.index("Window [") :] for p in numbered), name
        assert not any("LogicalRDD" in p or "Aggregate [near" in p for p in seen), name


def test_a_neighbour_list_goes_to_a_block_once(spark):
    near = [(a, list(range(a + 1, 30))) for a in range(29)]
    lists = spark.createDataFrame(near, "low int, near array<int>")
    assert sorted((r.low, r.at, r.near) for r in analytics._told(lists, 30).collect()) == [(a, 0, list(range(a + 1, 30))) for a in range(28)]
    halves = {(r.low, r.at): r.near for r in analytics._told(lists, 15).collect()}
    assert len(halves) == 42 and halves[13, 0] == list(range(14, 30)) and halves[13, 1] == list(range(15, 30)) and (28, 1) not in halves


def test_triangles_over_many_blocks(spark, monkeypatch):
    from graphlake.graph import Graph

    rng = random.Random(7)
    monkeypatch.setattr(analytics, "TASK_ROWS", 80)
    pairs = [(rng.choice((0, 5, rng.randrange(40))), rng.randrange(40)) for _ in range(220)]
    pairs += [(10**12 + a, 10**12 + b) for a in range(9) for b in range(9)] + [(3, 77), (77, 4), (3, 4), (None, 1)]
    near = defaultdict(set)
    for a, b in pairs:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = sorted((a, b, c) for a in near for b in near[a] if a < b for c in near[a] & near[b] if b < c)
    ids = [*range(40), *range(10**12, 10**12 + 9), 99]
    edges = spark.createDataFrame([(i, a, b, "e") for i, (a, b) in enumerate(pairs)], "id long, src long, dst long, edge_type string")
    g = Graph(spark.createDataFrame([(i, "v") for i in ids], "id long, label string"), edges)
    assert sorted(map(tuple, analytics.triangle_edges(g).collect())) == want
    assert analytics.triangle_total(g).first()[0] == len(want)
    closed = [t for t in want if 77 not in t]
    assert 0 < len(closed) < len(want)
    assert {r.id: r.triangles for r in analytics.triangles(g).table.collect()} == {i: sum(i in t for t in closed) for i in ids}
    assert not analytics.triangle_edges(g.filter_edges(F.lit(False))).count()


def test_triangles_close_the_graph_by_its_vertices_not_its_edges(spark, monkeypatch):
    seen, materialised = [], analytics.materialised

    def watched(df):
        seen.append(plan(df))
        return materialised(df)

    monkeypatch.setattr(analytics, "materialised", watched)
    assert not entry.queries()["triangles"](spark, AT).where("triangles < 0").count()
    assert "LeftSemi" not in seen[0] and "LeftSemi" in seen[1] and seen[0].count("RepartitionByExpression") == 1


def test_closed_pairs_in_pieces_and_batches(monkeypatch):
    def batch(*rows):
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    schema = pa.schema([("at", pa.int32()), ("told", pa.bool_()), ("low", pa.int64()), ("near", pa.list_(pa.int64()))])
    lists = [(0, False, a, list(range(a + 1, 20))) for a in range(10)]
    told = [(0, True, a, list(range(a + 1, 20))) for a in range(18)]
    want = [(a, b, c) for a in range(18) for b in range(a + 1, 10) for c in range(b + 1, 20)]
    for piece in (1, 7, 10_000):
        monkeypatch.setattr(analytics, "PIECE", piece)
        got = analytics._closed(10, 400)(iter([batch(*lists[:4]), batch(*lists[4:], *told[:3]), batch(*told[3:])]))
        assert sorted(tuple(r.values()) for b in got for r in b.to_pylist()) == want
    assert not list(analytics._closed(10, 400)(iter([batch((1, True, 3, [12, 15])), batch((1, True, 4, [12, 15]))])))


def test_edges_are_found_among_many_keys():
    rng = np.random.default_rng(3)
    low, high = rng.integers(0, 50, 5_000), rng.integers(0, 1_000, 5_000)
    lows, found = analytics._edge_test(np.append(low, low[:9]), np.append(high, high[:9]), 1_000)
    assert found(np.arange(50_000)).tolist() == sorted({int(np.searchsorted(lows, a)) * 1_000 + int(b) for a, b in zip(low, high)})
    assert not analytics._edge_test(low[:0], high[:0], 1_000)[1](np.arange(9)).size
