"""Graphs over the relational test tables. Ids are kind * 10**12 + key for
vertices; an edge id is kind * 10**15 + a key of its own table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.graph import Graph
from graphlake.sources.workspace import TASK_ROWS

KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6, "user": 7, "event_type": 8}
VERTEX = 10**12
EDGE = 10**15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vertex_id(kind: str, key: str):
    return F.lit(KINDS[kind] * VERTEX) + F.col(key).cast("long")


def _vertices(df: DataFrame, kind: str, key: str) -> DataFrame:
    return df.select(vertex_id(kind, key).alias("id"), F.lit(kind).alias("label"), *[c for c in df.columns if c != key])


def _edges(df: DataFrame, number: int, key, src, dst, edge_type: str, *props) -> DataFrame:
    return df.select(
        (F.lit(number * EDGE) + key).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(edge_type).alias("edge_type"), F.lit(None).cast("string").alias("label"), *props
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with ``line_key``: unique per row, numbered within the order."""
    within = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("line_key", F.col("l_orderkey") * 100 + F.row_number().over(within) - 1)


def commerce(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    kinds = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey")]
    vertices = None
    for kind, key in kinds:
        part = _vertices(t(kind), kind, key)
        vertices = part if vertices is None else vertices.unionByName(part, allowMissingColumns=True)
    line = lines(spark, sf_dir)
    props = [F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount"), F.col("l_shipdate").alias("shipdate")]
    edges = [
        _edges(t("nation"), 11, F.col("n_nationkey").cast("long"), vertex_id("nation", "n_nationkey"), vertex_id("region", "n_regionkey"), "in_region"),
        _edges(t("customer"), 12, F.col("c_custkey"), vertex_id("customer", "c_custkey"), vertex_id("nation", "c_nationkey"), "located_in"),
        _edges(t("supplier"), 13, F.col("s_suppkey"), vertex_id("supplier", "s_suppkey"), vertex_id("nation", "s_nationkey"), "located_in"),
        _edges(t("orders"), 14, F.col("o_orderkey"), vertex_id("customer", "o_custkey"), vertex_id("orders", "o_orderkey"), "placed"),
        _edges(line, 15, F.col("line_key"), vertex_id("orders", "l_orderkey"), vertex_id("part", "l_partkey"), "contains", *props),
        _edges(line, 16, F.col("line_key"), vertex_id("supplier", "l_suppkey"), vertex_id("part", "l_partkey"), "supplies", *props),
    ]
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e, allowMissingColumns=True)
    return Graph(vertices, all_edges, "commerce")


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers and parts, one edge per pair, weighted by the least price."""
    t = lambda name: table(spark, sf_dir, name)
    v = _vertices(t("supplier").select("s_suppkey", F.col("s_name").alias("name")), "supplier", "s_suppkey").unionByName(
        _vertices(t("part").select("p_partkey", F.col("p_name").alias("name")), "part", "p_partkey")
    )
    pairs = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_extendedprice").alias("weight"))
    key = F.col("l_suppkey") * 10**7 + F.col("l_partkey")
    return Graph(v, _edges(pairs, 17, key, vertex_id("supplier", "l_suppkey"), vertex_id("part", "l_partkey"), "supplies", "weight"), "supply")


def supplies(spark: SparkSession, sf_dir: str) -> Graph:
    """All suppliers and parts and every supplier-part edge."""
    return commerce(spark, sf_dir).of_types("supplies").of_labels("supplier", "part")


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts bought in one order, one edge per pair u < v."""
    line = table(spark, sf_dir, "lineitem")
    bought = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts")).where("l_orderkey is not null")
    firsts = bought.select("parts", F.posexplode("parts").alias("i", "u")).where("i + 1 < size(parts)")
    # Ranges keep the pairs of near keys together, which costs later shuffles less, and split a hub's.
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-line.count() // (TASK_ROWS // 2)))
    pairs = firsts.select("u", F.explode(F.expr("slice(parts, i + 2, size(parts))")).alias("v")).repartitionByRange(ranges, "u", "v").distinct()
    parts = table(spark, sf_dir, "part")
    return Graph(_vertices(parts, "part", "p_partkey"), _edges(pairs, 18, F.col("u") * 10**7 + F.col("v"), vertex_id("part", "u"), vertex_id("part", "v"), "bought_with"), "copurchase")


def activity(spark: SparkSession, sf_dir: str) -> Graph:
    """Users, event types, and a 'did' edge per event."""
    e = table(spark, sf_dir, "events")
    users = e.select("user_id").distinct()
    kinds = e.select("event_type").distinct().withColumn("key", F.ascii("event_type") * 1000 + F.length("event_type"))
    v = _vertices(users, "user", "user_id").unionByName(_vertices(kinds.select("key", F.col("event_type").alias("name")), "event_type", "key"), allowMissingColumns=True)
    did = e.withColumn("key", F.ascii("event_type") * 1000 + F.length("event_type"))
    return Graph(v, _edges(did, 19, F.col("event_id"), vertex_id("user", "user_id"), vertex_id("event_type", "key"), "did", "ts", "value"), "activity")


def dialog(spark: SparkSession, sf_dir: str) -> Graph:
    """Conversation turns with a 'next' edge to the following turn."""
    t = table(spark, sf_dir, "conversations")
    turns = t.withColumn("id", F.col("conv_id") * 10**4 + F.col("turn"))
    after = F.lead("id").over(Window.partitionBy("conv_id").orderBy("turn", "id"))
    nexts = turns.withColumn("after", after).where("after is not null")
    v = turns.select("id", F.lit("turn").alias("label"), "conv_id", "turn", "role", "text")
    return Graph(v, _edges(nexts, 20, F.col("id"), F.col("id"), F.col("after"), "next"), "dialog")
