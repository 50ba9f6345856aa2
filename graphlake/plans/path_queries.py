"""Reachability, paths and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.operators import paths, patterns
from graphlake.operators.patterns import EdgeStep, VertexStep
from graphlake.plans.registry import query
from graphlake.plans.scan_queries import EDGES_SQL, ID
from graphlake.sources.tables import commerce, supplies

C7, C11 = ID["customer"] + 7, ID["customer"] + 11
BOTH = f"e AS MATERIALIZED (SELECT id, src AS a, dst AS b, 'out' AS dir FROM {EDGES_SQL} WHERE edge_type IN ('placed', 'contains') UNION ALL SELECT id, dst, src, 'in' FROM {EDGES_SQL} WHERE edge_type IN ('placed', 'contains'))"


def _trade(spark, sf_dir) -> Graph:
    return commerce(spark, sf_dir).of_types("placed", "contains")


@query(f"WITH RECURSIVE {BOTH}, r AS (SELECT CAST({C7} AS BIGINT) AS id, 0 AS depth UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.id WHERE r.depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def khop_reach(spark, sf_dir):
    return paths.reach(_trade(spark, sf_dir), C7, 3)


_HOPS = f"""WITH RECURSIVE {BOTH}, p AS (SELECT CAST({C7} AS BIGINT) AS pos, 0 AS hops, '' AS signature
    UNION ALL SELECT e.b, p.hops + 1, CASE WHEN p.hops = 0 THEN '' ELSE p.signature || ',' END || e.id || ':' || e.dir FROM p JOIN e ON e.a = p.pos WHERE p.hops < 4 AND NOT (p.pos = {C11})),
  hit AS (SELECT hops, signature FROM p WHERE pos = {C11}), best AS (SELECT min(hops) AS m FROM hit)"""


@query(_HOPS + " SELECT hops, signature FROM hit, best WHERE hops = m")
def bls_paths(spark, sf_dir):
    return paths.fewest_hops(_trade(spark, sf_dir), C7, C11, max_depth=4).select("hops", "signature")


@query(_HOPS + " SELECT CAST(m AS INTEGER) AS hops, (SELECT count(*) FROM hit WHERE hops = m) AS n_paths FROM best WHERE m IS NOT NULL")
def bls_hops(spark, sf_dir):
    found = paths.fewest_hops(_trade(spark, sf_dir), C7, C11, max_depth=4)
    return found.groupBy("hops").agg(F.count("*").alias("n_paths"))


S3 = ID["supplier"] + 3


def _least_cost_sql(rounds: int) -> str:
    both = f"SELECT {ID['supplier']} + l_suppkey AS a, {ID['part']} + l_partkey AS b, l_extendedprice AS w FROM lineitem"
    steps = [f"l AS ({both})", "e AS MATERIALIZED (SELECT a, b, CAST(round(min(w) * 100) AS DOUBLE) AS w FROM (SELECT a, b, w FROM l UNION ALL SELECT b, a, w FROM l) GROUP BY a, b)"]
    steps.append(f"r0 AS (SELECT CAST({S3} AS BIGINT) AS id, CAST(0 AS DOUBLE) AS weight)")
    for i in range(1, rounds + 1):
        last = f"r{i - 1}"
        steps.append(f"r{i} AS MATERIALIZED (SELECT id, min(weight) AS weight FROM (SELECT id, weight FROM {last} UNION ALL SELECT e.b, q.weight + e.w FROM {last} q JOIN e ON e.a = q.id) GROUP BY id)")
    return "WITH " + ", ".join(steps) + f" SELECT id, weight FROM r{rounds}"


@query(_least_cost_sql(4))
def dijkstra_cost(spark, sf_dir):
    found = paths.cheapest(supplies(spark, sf_dir), S3, 4, edge_cost=F.round(F.col("extendedprice") * 100))
    return found.select("id", "weight")


@query(f"""WITH RECURSIVE x AS MATERIALIZED (SELECT id, src AS a, dst AS b, 'out' AS dir FROM {EDGES_SQL} WHERE edge_type = 'placed' UNION ALL SELECT id, dst, src, 'in' FROM {EDGES_SQL} WHERE edge_type = 'placed'
    UNION ALL SELECT id, src, dst, 'out' FROM {EDGES_SQL} WHERE edge_type = 'contains' UNION ALL SELECT id, dst, src, 'in' FROM {EDGES_SQL} WHERE edge_type = 'contains'),
  p AS (SELECT CAST({C7} AS BIGINT) AS pos, 0 AS hops, '' AS signature, [CAST({C7} AS BIGINT)] AS seen
    UNION ALL SELECT x.b, p.hops + 1, CASE WHEN p.hops = 0 THEN '' ELSE p.signature || ',' END || x.id || ':' || x.dir, list_append(p.seen, x.b)
    FROM p JOIN x ON x.a = p.pos WHERE p.hops < 4 AND NOT list_contains(p.seen, x.b) AND p.pos <> {C11})
  SELECT CAST(row_number() OVER (ORDER BY hops, signature) AS INTEGER) AS rank, hops, CAST(hops AS DOUBLE) AS weight, signature FROM p WHERE pos = {C11} ORDER BY hops, signature LIMIT 3""")
def k_shortest(spark, sf_dir):
    return paths.k_cheapest(_trade(spark, sf_dir), C7, C11, k=3, max_depth=4).select("rank", "hops", "weight", "signature")


def _ids(df):
    return df.select(F.explode("path").alias("id")).distinct()


P_V = f"SELECT {ID['customer']} + c_custkey AS c FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 3"


@query(f"""WITH m AS (SELECT e.src AS a, e.id AS i, e.dst AS b FROM {EDGES_SQL} e JOIN ({P_V}) ON c = e.src JOIN orders ON e.dst = {ID['orders']} + o_orderkey WHERE e.edge_type = 'placed' AND o_orderstatus = 'F')
  SELECT DISTINCT id FROM (SELECT a AS id FROM m UNION ALL SELECT i FROM m UNION ALL SELECT b FROM m)""")
def pattern_vev(spark, sf_dir):
    steps = [VertexStep((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") == 3)), EdgeStep("out", ("placed",)), VertexStep(F.col("o_orderstatus") == "F")]
    return _ids(patterns.bindings(commerce(spark, sf_dir), steps))


@query(f"""WITH m AS (SELECT e.dst AS a, e.id AS i, e.src AS b FROM {EDGES_SQL} e WHERE e.edge_type = 'contains' AND e.dst IN ({ID['part']} + 5, {ID['part']} + 6))
  SELECT DISTINCT id FROM (SELECT a AS id FROM m UNION ALL SELECT i FROM m UNION ALL SELECT b FROM m)""")
def pattern_incoming(spark, sf_dir):
    steps = [VertexStep(F.col("id").isin(ID["part"] + 5, ID["part"] + 6)), EdgeStep("in", ("contains",)), VertexStep()]
    return _ids(patterns.bindings(commerce(spark, sf_dir), steps))


@query(f"""WITH m AS (SELECT CASE WHEN src = {ID['nation']} + 3 THEN src ELSE dst END AS a, id AS i, CASE WHEN src = {ID['nation']} + 3 THEN dst ELSE src END AS b FROM {EDGES_SQL}
    WHERE edge_type IN ('in_region', 'located_in') AND (src = {ID['nation']} + 3 OR dst = {ID['nation']} + 3))
  SELECT DISTINCT id FROM (SELECT a AS id FROM m UNION ALL SELECT i FROM m UNION ALL SELECT b FROM m)""")
def pattern_undirected(spark, sf_dir):
    steps = [VertexStep(F.col("id") == ID["nation"] + 3), EdgeStep("both", ("in_region", "located_in")), VertexStep()]
    return _ids(patterns.bindings(commerce(spark, sf_dir), steps))


@query(f"""WITH c AS (SELECT id AS i, src AS a, dst AS b FROM {EDGES_SQL} WHERE edge_type = 'placed' AND src = {C7}),
  d AS (SELECT c.*, e.id AS j, e.dst AS p FROM c JOIN {EDGES_SQL} e ON e.src = c.b WHERE e.edge_type = 'contains')
  SELECT DISTINCT id FROM (SELECT unnest([a, i, b]) AS id FROM c UNION ALL SELECT unnest([a, i, b, j, p]) FROM d)""")
def pattern_varlen(spark, sf_dir):
    steps = [VertexStep(F.col("id") == C7), EdgeStep("out", ("placed", "contains"), low=1, high=2), VertexStep()]
    return _ids(patterns.bindings(commerce(spark, sf_dir), steps))


@query(f"""WITH m AS (SELECT id AS i, src AS a, dst AS b FROM {EDGES_SQL} WHERE edge_type = 'placed' AND src < {ID['customer']} + 20)
  SELECT DISTINCT id FROM (SELECT unnest([a, i, b]) AS id FROM m)""")
def pattern_edge_start(spark, sf_dir):
    steps = [EdgeStep("out", ("placed",), F.col("src") < ID["customer"] + 20), VertexStep(F.col("label") == "orders")]
    return _ids(patterns.bindings(commerce(spark, sf_dir), steps))


@query(f"SELECT count(DISTINCT a) + count(DISTINCT b) AS n_vertices, count(*) AS n_edges FROM (SELECT {ID['supplier']} + l_suppkey AS a, {ID['part']} + l_partkey AS b FROM lineitem)")
def subgraph_renumbered(spark, sf_dir):
    out = patterns.subgraph(supplies(spark, sf_dir), steps=[VertexStep(F.col("label") == "supplier"), EdgeStep("out"), VertexStep()], renumber=True)
    v = out.vertices.agg((F.max("id") + 1).alias("n_vertices"))
    return v.join(F.broadcast(out.edges.agg(F.count("*").alias("n_edges"))))
