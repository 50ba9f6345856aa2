"""Small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.operators import analytics, indices, mutate, paths, patterns, scan, vectors
from graphlake.operators.components import connected_components
from graphlake.sources import jsonl, synthetic, versions


def graph(spark, n, links, weights=None):
    """Vertices 0 to n-1 and the links in order, edge ids after them."""
    v = spark.createDataFrame([(i, "node", f"v{i}") for i in range(n)], "id long, label string, name string")
    rows = [(n + k, a, b, "A", "link", float(weights[k]) if weights else 1.0) for k, (a, b) in enumerate(links)]
    return Graph(v, spark.createDataFrame(rows, "id long, src long, dst long, edge_type string, label string, weight double"))


def by_id(result, column):
    return {r["id"]: r[column] for r in result.table.select("id", column).collect()}


def test_degrees(spark):
    star = graph(spark, 4, [(0, 1), (0, 2), (0, 3)])
    assert by_id(analytics.degree_centrality(star), "score") == {0: 3, 1: 1, 2: 1, 3: 1}
    assert by_id(analytics.degree_centrality(star, "in"), "score") == {0: 0, 1: 1, 2: 1, 3: 1}
    loops = graph(spark, 3, [(0, 1), (0, 1), (2, 2)])
    assert by_id(analytics.degree_centrality(loops), "score") == {0: 2, 1: 2, 2: 2}


def test_pagerank(spark):
    g = graph(spark, 4, [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2)])
    scores = by_id(analytics.pagerank(g, epsilon=1e-9), "score")
    assert [scores[i] for i in range(4)] == pytest.approx([0.372526, 0.195824, 0.394150, 0.0375], abs=1e-4)
    assert sum(by_id(analytics.pagerank(graph(spark, 3, [(0, 1), (1, 2)])), "score").values()) == pytest.approx(1)
    flat = by_id(analytics.pagerank(graph(spark, 3, [(0, 1), (1, 2)]), damping=0.0), "score")
    assert list(flat.values()) == pytest.approx([1 / 3] * 3)


def test_components_and_communities(spark):
    g = graph(spark, 6, [(0, 1), (1, 2), (4, 3)])
    assert by_id(analytics.components(g), "component") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    cliques = graph(spark, 6, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)])
    found = by_id(analytics.label_propagation(cliques), "community")
    assert len({found[i] for i in (0, 1, 2)}) == 1 and len(set(found.values())) == 2


@pytest.mark.parametrize("n", [1, 300])
def test_components_of_shuffled_chains(spark, n):
    ids = random.Random(n).sample(range(10 * n + 1), 2 * n + 1)
    chains = [ids[: n + 1], ids[n + 1 :]]
    links = [(c[i], c[i + 1]) for c in chains for i in range(len(c) - 1)] + [(ids[0], ids[0]), (None, ids[0])]
    found = connected_components(spark.createDataFrame(links, "src long, dst long")).collect()
    assert sorted((r.id, r.component) for r in found) == sorted((x, min(c)) for c in chains if len(c) > 1 for x in c)


def test_components_of_random_graphs(spark):
    draw = random.Random(5)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(200)] + [(399, i) for i in range(50, 90)]
    root = {x: x for x in range(400)}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = connected_components(spark.createDataFrame(links, "src long, dst long")).collect()
    assert sorted((r.id, r.component) for r in found) == sorted((x, root[x]) for x in {v for a, b in links if a != b for v in (a, b)})


def test_triangles(spark):
    k4 = graph(spark, 4, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)])
    assert by_id(analytics.triangles(k4), "triangles") == {i: 3 for i in range(4)}
    assert analytics.triangle_edges(graph(spark, 4, [(0, 1), (1, 2), (2, 3), (3, 0)])).count() == 0
    assert analytics.triangle_edges(graph(spark, 3, [(0, 1), (0, 1), (1, 2), (2, 0), (2, 2)])).count() == 1


def test_paths(spark):
    people = synthetic.people(spark)
    ids = {r["name"]: r["id"] for r in people.vertices.collect()}
    assert paths.fewest_hops(people, ids["Mallory"], ids["Trent"]).count() == 2
    for a, b in (("Alice", "Bob"), ("Bob", "Alice")):
        assert paths.fewest_hops(people, ids[a], ids[b], max_depth=2, max_results=2).count() == 1
    assert paths.fewest_hops(graph(spark, 2, [(0, 1), (0, 1)]), 0, 1).count() == 2
    chain = graph(spark, 5, [(i, i + 1) for i in range(4)])
    assert paths.fewest_hops(chain, 0, 4, max_depth=3).count() == 0 and paths.fewest_hops(chain, 0, 0).count() == 0
    triangle = graph(spark, 3, [(0, 1), (0, 2), (2, 1)], [10, 1, 1])
    best = paths.k_cheapest(triangle, 0, 1, k=2, max_depth=3, edge_cost=F.col("weight")).collect()
    assert [(r.hops, r.weight) for r in best] == [(2, 2.0), (1, 10.0)]
    assert {r.id: r.weight for r in paths.cheapest(triangle, 0, edge_cost=F.col("weight"), direction="out").collect()} == {0: 0.0, 1: 2.0, 2: 1.0}
    tiers = graph(spark, 5, [(0, 1), (1, 4), (0, 2), (2, 3), (3, 4)])
    assert [r.hops for r in paths.k_cheapest(tiers, 0, 4, k=5, max_depth=4).collect()] == [2, 3]


def test_patterns(spark):
    g = graph(spark, 4, [(0, 1), (0, 2), (2, 3)])
    two_hops = [patterns.VertexStep(), patterns.EdgeStep(low=1, high=2), patterns.VertexStep()]
    kept = patterns.subgraph(g, steps=two_hops)
    assert (kept.vertices.count(), kept.edges.count()) == (4, 3)
    assert patterns.subgraph(g, F.col("id") < 2).edges.count() == 1


def test_scans_and_missing_properties(spark):
    g = graph(spark, 3, [(0, 1)])
    v = g.vertices.withColumn("age", F.when(F.col("id") < 2, F.col("id")))
    g = g.with_vertices(v)
    assert [r.id for r in scan.property_scan(g, "age", "ne", 0, kind="vertex").collect()] == [1]
    assert scan.any_property_scan(g, "V1", kind="vertex").count() == 1 and scan.any_property_scan(g, " ", kind="vertex").count() == 0
    assert scan.neighbors(graph(spark, 1, [(0, 0)])).count() == 2


def test_mutations(spark):
    g = graph(spark, 4, [(0, 1), (1, 2), (2, 3)])
    left = mutate.remove_elements(g, spark.createDataFrame([(1,)], "id long"))
    assert left.vertices.count() == 3 and left.edges.count() == 1
    trimmed = mutate.trim(left)
    assert sorted(r.id for r in trimmed.elements().collect()) == [0, 1, 2, 3]
    with pytest.raises(mutate.NotFound):
        mutate.create_edges(g, spark.createDataFrame([(0, 99, "A", None, 1.0)], "src long, dst long, edge_type string, label string, weight double"))


def test_lexical_pattern():
    assert indices.lexical_pattern("alpha beta") == "alpha|beta" and indices.lexical_pattern("a.*b") == r"a\.\*b"


def test_nearest_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [3.0, 4.0])]
    table = spark.createDataFrame(rows, "id long, vector array<float>")
    got = table.select("id", vectors.similarity(F.col("vector"), vectors.literal([1.0, 0.0])).alias("s")).orderBy(F.desc("s")).collect()
    assert [r.id for r in got] == [0, 3, 1, 2] and [r.s for r in got] == pytest.approx([1.0, 0.6, 0.0, -1.0])
    far = table.select("id", vectors.similarity(F.col("vector"), vectors.literal([0.0, 0.0]), "l2").alias("s")).where("id = 3").first()
    assert far.s == pytest.approx(5.0)


def test_nearest_vectors_in_blocks(spark):
    table = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5)]) for i in range(40)], "id long, vector array<float>")
    queries = table.selectExpr("id AS query_id", "vector AS query")
    whole, blocks = (vectors.nearest_batch(table, queries, 3, block=b).select("query_id", "id", "rank").collect() for b in (40, 9))
    assert len(whole) == 120 and sorted(blocks) == sorted(whole)


def test_jsonl_and_versions_round_trip(spark, tmp_path):
    g = graph(spark, 4, [(0, 1), (1, 2), (2, 3)])
    jsonl.write(g, str(tmp_path / "g"))
    back = jsonl.read(spark, str(tmp_path / "g"))
    assert back.vertices.count() == 4 and back.edges.count() == 3
    versions.save(g, str(tmp_path / "v"), "one")
    loaded = versions.load(spark, str(tmp_path / "v"), "one")
    assert sorted(loaded.edges.collect()) == sorted(g.edges.collect())
