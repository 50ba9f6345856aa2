"""Scans, adjacency, degrees and cardinalities over the commerce graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from graphlake.operators import aggregates, scan
from graphlake.plans.registry import query
from graphlake.sources.tables import KINDS, VERTEX, commerce, table

ID = {k: n * VERTEX for k, n in KINDS.items()}

VERTICES_SQL = f"""(
  SELECT {ID['region']} + r_regionkey AS id, 'region' AS label FROM region
  UNION ALL SELECT {ID['nation']} + n_nationkey, 'nation' FROM nation
  UNION ALL SELECT {ID['customer']} + c_custkey, 'customer' FROM customer
  UNION ALL SELECT {ID['supplier']} + s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT {ID['part']} + p_partkey, 'part' FROM part
  UNION ALL SELECT {ID['orders']} + o_orderkey, 'orders' FROM orders)"""
LINES_SQL = "(SELECT *, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS line_key FROM lineitem)"
EDGES_SQL = f"""(
  SELECT {11 * 10**15} + n_nationkey AS id, {ID['nation']} + n_nationkey AS src, {ID['region']} + n_regionkey AS dst, 'in_region' AS edge_type FROM nation
  UNION ALL SELECT {12 * 10**15} + c_custkey, {ID['customer']} + c_custkey, {ID['nation']} + c_nationkey, 'located_in' FROM customer
  UNION ALL SELECT {13 * 10**15} + s_suppkey, {ID['supplier']} + s_suppkey, {ID['nation']} + s_nationkey, 'located_in' FROM supplier
  UNION ALL SELECT {14 * 10**15} + o_orderkey, {ID['customer']} + o_custkey, {ID['orders']} + o_orderkey, 'placed' FROM orders
  UNION ALL SELECT {15 * 10**15} + line_key, {ID['orders']} + l_orderkey, {ID['part']} + l_partkey, 'contains' FROM {LINES_SQL}
  UNION ALL SELECT {16 * 10**15} + line_key, {ID['supplier']} + l_suppkey, {ID['part']} + l_partkey, 'supplies' FROM {LINES_SQL})"""

SIGN = {"eq": "=", "gt": ">", "ge": ">=", "lt": "<", "le": "<=", "ne": "<>"}


@query("SELECT p_partkey, p_name, count(*) AS in_degree FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name ORDER BY in_degree DESC, p_partkey LIMIT 20")
def top_in_degree(spark, sf_dir):
    """The parts that most lines contain."""
    g = commerce(spark, sf_dir)
    degree = g.of_types("contains").edges.groupBy("dst").agg(F.count("*").alias("in_degree"))
    found = degree.join(g.vertices.select("id", "p_name"), F.col("dst") == F.col("id"))
    top = found.select((F.col("id") - ID["part"]).alias("p_partkey"), "p_name", "in_degree")
    return top.orderBy(F.desc("in_degree"), "p_partkey").limit(20)


def _scan(op):
    @query(f"SELECT {ID['part']} + p_partkey AS id FROM part WHERE p_size {SIGN[op]} 25", f"scan_{op}")
    def run(spark, sf_dir):
        return scan.property_scan(commerce(spark, sf_dir), "p_size", op, 25, kind="vertex").select("id")

    return run


for _op in SIGN:
    _scan(_op)


@query(f"SELECT {ID['customer']} + c_custkey AS id, 'vertex' AS kind FROM customer WHERE c_acctbal <> 0")
def scan_missing_excluded(spark, sf_dir):
    return scan.property_scan(commerce(spark, sf_dir), "c_acctbal", "ne", 0.0, kind="both").select("id", "kind")


@query(f"""SELECT {ID['customer']} + c_custkey AS id, 'customer' AS label FROM customer WHERE lower(c_name) LIKE '%machinery%' OR lower(c_mktsegment) LIKE '%machinery%'
  UNION ALL SELECT {ID['supplier']} + s_suppkey, 'supplier' FROM supplier WHERE lower(s_name) LIKE '%machinery%'""")
def scan_all_props(spark, sf_dir):
    g = commerce(spark, sf_dir).of_labels("customer", "supplier")
    return scan.any_property_scan(g, "MaChInErY", kind="vertex").select("id", "label")


@query(f"SELECT label, count(*) AS n FROM {VERTICES_SQL} GROUP BY label")
def elements_by_label(spark, sf_dir):
    return commerce(spark, sf_dir).vertices.groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT 'vertex' AS kind, count(*) AS n FROM {VERTICES_SQL} UNION ALL SELECT 'edge', count(*) FROM {EDGES_SQL}")
def count_by_kind(spark, sf_dir):
    return scan.count_by_kind(commerce(spark, sf_dir))


@query(f"SELECT id, label FROM {VERTICES_SQL} WHERE id IN ({ID['part']} + 3, {ID['orders']} + 5)")
def get_elements(spark, sf_dir):
    g = commerce(spark, sf_dir)
    wanted = spark.createDataFrame([(ID["part"] + 3,), (ID["orders"] + 5,), (-1,)], "id long")
    return scan.get(g, wanted, kind="vertex")[0].select("id", "label")


@query("SELECT CAST(-1 AS BIGINT) AS id")
def get_missing(spark, sf_dir):
    g = commerce(spark, sf_dir)
    return scan.get(g, spark.createDataFrame([(ID["part"] + 3,), (-1,)], "id long"))[1]


@query(f"SELECT id, label FROM {VERTICES_SQL} ORDER BY id LIMIT 50")
def graph_sample(spark, sf_dir):
    return scan.sample(commerce(spark, sf_dir), 50)[0].select("id", "label")


@query(f"""SELECT id, neighbor, count(*) AS n FROM (SELECT src AS id, dst AS neighbor FROM {EDGES_SQL} UNION ALL SELECT dst, src FROM {EDGES_SQL})
  WHERE id >= {ID['part']} AND id < {ID['orders']} GROUP BY id, neighbor""")
def neighbors_bag(spark, sf_dir):
    parts = (F.col("near") >= ID["part"]) & (F.col("near") < ID["orders"])
    return scan.neighbors(commerce(spark, sf_dir), parts).groupBy("id", "neighbor").agg(F.count("*").alias("n"))


_C7 = f"{ID['customer']} + 7"


@query(f"SELECT e.dst AS id, e.edge_type FROM {EDGES_SQL} e WHERE e.src = {_C7}")
def hop_out(spark, sf_dir):
    g = commerce(spark, sf_dir)
    start = g.vertices.where(F.col("id") == ID["customer"] + 7)
    found = scan.hop(start, g, "out")
    return found.join(g.edges.select("id", "edge_type"), F.col("edge_id") == F.col("id")).select(F.col("far").alias("id"), "edge_type")


@query(f"SELECT src AS id, count(*) AS n FROM {EDGES_SQL} WHERE dst = {ID['part']} + 7 GROUP BY src")
def hop_in(spark, sf_dir):
    g = commerce(spark, sf_dir)
    start = g.vertices.where(F.col("id") == ID["part"] + 7)
    return scan.hop(start, g, "in").groupBy(F.col("far").alias("id")).agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT src AS a, dst AS b FROM {EDGES_SQL} UNION ALL SELECT dst, src FROM {EDGES_SQL}), one AS (SELECT DISTINCT b AS id FROM e WHERE a = {_C7})
  SELECT b AS id, count(*) AS n FROM e JOIN one ON a = one.id GROUP BY b""")
def hop_both(spark, sf_dir):
    g = commerce(spark, sf_dir)
    one = scan.hop(g.vertices.where(F.col("id") == ID["customer"] + 7), g, "both").select(F.col("far").alias("id"))
    return scan.hop(one, g, "both").groupBy(F.col("far").alias("id")).agg(F.count("*").alias("n"))


@query(f"SELECT edge_type, count(*) AS n FROM {EDGES_SQL} WHERE edge_type = 'supplies' GROUP BY edge_type")
def induced_scope(spark, sf_dir):
    return commerce(spark, sf_dir).of_labels("supplier", "part").edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def _degree(direction):
    ends = {"in": "SELECT dst AS v FROM e", "out": "SELECT src AS v FROM e", "both": "SELECT src AS v FROM e UNION ALL SELECT dst FROM e"}[direction]

    @query(
        f"""WITH e AS (SELECT * FROM {EDGES_SQL}), ends AS ({ends}), c AS (SELECT v, count(*) AS n FROM ends GROUP BY v)
        SELECT id, coalesce(n, 0) AS degree FROM {VERTICES_SQL} LEFT JOIN c ON v = id WHERE label IN ('part', 'supplier')""",
        f"degree_{direction}",
    )
    def run(spark, sf_dir):
        g = commerce(spark, sf_dir)
        some = g.with_vertices(g.vertices.where(F.col("label").isin("part", "supplier")))
        return scan.degrees(some, direction)


for _d in ("in", "out", "both"):
    _degree(_d)


@query(f"""WITH ends AS (SELECT src AS v FROM {EDGES_SQL} UNION ALL SELECT dst FROM {EDGES_SQL}), c AS (SELECT v, count(*) AS n FROM ends GROUP BY v),
  d AS (SELECT coalesce(n, 0) AS degree FROM {VERTICES_SQL} LEFT JOIN c ON v = id)
  SELECT min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 6) AS mean_degree, CAST(quantile_disc(degree, 0.5) AS BIGINT) AS p50,
         CAST(quantile_disc(degree, 0.9) AS BIGINT) AS p90, CAST(quantile_disc(degree, 0.99) AS BIGINT) AS p99 FROM d""")
def degree_stats(spark, sf_dir):
    return aggregates.degree_stats(commerce(spark, sf_dir))


@query(f"SELECT edge_type AS name, count(*) AS n FROM {EDGES_SQL} GROUP BY edge_type")
def label_cardinality(spark, sf_dir):
    return aggregates.label_cardinality(commerce(spark, sf_dir).edges, "edge_type")


@query("""SELECT 'p_name' AS key, count(*) AS n FROM part UNION ALL SELECT 'p_size', count(*) FROM part UNION ALL SELECT 'c_name', count(*) FROM customer
  UNION ALL SELECT 'o_orderdate', count(*) FROM orders UNION ALL SELECT 'n_name', count(*) FROM nation""")
def property_key_cardinality(spark, sf_dir):
    return aggregates.property_cardinality(commerce(spark, sf_dir).vertices, ["p_name", "p_size", "c_name", "o_orderdate", "n_name"])


@query("SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS stddev, round(median(o_totalprice), 4) AS median FROM orders")
def sample_statistics(spark, sf_dir):
    return aggregates.sample_stats(table(spark, sf_dir, "orders"), "o_totalprice")


@query(f"""SELECT (SELECT count(*) FROM {VERTICES_SQL}) AS n_vertices, CAST(6 AS BIGINT) AS n_labels, (SELECT count(*) FROM {EDGES_SQL}) AS n_edges, CAST(5 AS BIGINT) AS n_edge_types""")
def graph_statistics(spark, sf_dir):
    from graphlake.operators.analytics import statistics

    return statistics(commerce(spark, sf_dir))


@query(f"SELECT {ID['orders']} + o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' ORDER BY id LIMIT 25 OFFSET 50")
def page_of_results(spark, sf_dir):
    found = scan.property_scan(commerce(spark, sf_dir), "o_orderstatus", "eq", "F", kind="vertex").select("id")
    return scan.page(found, ["id"], 25, 50)


@query(f"SELECT count(*) AS n_edges, CAST(sum(dst % 1000003) AS BIGINT) AS checksum FROM {EDGES_SQL}")
def edge_sweep(spark, sf_dir):
    from graphlake.operators.paths import edge_sweep as sweep

    return sweep(commerce(spark, sf_dir))


@query(f"SELECT DISTINCT edge_type FROM {EDGES_SQL} WHERE dst = {ID['part']} + 7")
def edge_types_in(spark, sf_dir):
    return scan.edge_types(commerce(spark, sf_dir), ID["part"] + 7, "in")



@query("SELECT 'ne' AS op, p_partkey AS key FROM part")
def scan_other_type(spark, sf_dir):
    """A number against a text property: equal to none, in no order, unequal to all."""
    g = commerce(spark, sf_dir)
    found = [scan.property_scan(g, "p_name", op, 25, kind="vertex").select(F.lit(op).alias("op"), (F.col("id") - ID["part"]).alias("key")) for op in scan.COMPARE]
    return reduce(lambda a, b: a.unionAll(b), found)


@query("""SELECT id FROM (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS i, ceil(count(*) OVER () / 40) AS k FROM customer) WHERE i % k = 0""")
def stride_sample(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return scan.stride_sample(c, 40)


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 10 OFFSET 2")
def partition_members(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"))
    return scan.members(c, 3, "community", limit=10, offset=2)
