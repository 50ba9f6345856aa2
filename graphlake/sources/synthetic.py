"""Generated and sample graphs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.graph import Graph

V = "id long, label string, name string"
E = "id long, src long, dst long, edge_type string, label string"


def uniform(spark: SparkSession, n: int, k: int, seed: int = 1) -> Graph:
    """n vertices with k distinct random targets each (all, if n is less). Draws are
    hashes, so the graph depends on the seed alone."""
    k = min(n, k)
    draws = min(n, 2 * k + 16)
    v = spark.range(n).select("id", F.lit("vertex").alias("label"))
    target = lambda j: F.pmod(F.xxhash64("id", F.lit(seed), j), F.lit(n))
    picks = v.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda j: target(j))).alias("j", "dst"))
    first = picks.groupBy("id", "dst").agg(F.min("j").alias("j"))
    if draws < n or k < n:
        walk = v.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.pmod(F.col("id") + j, F.lit(n)))).alias("j", "dst"))
        first = first.unionAll(walk.select("id", "dst", F.col("j") + draws)).groupBy("id", "dst").agg(F.min("j").alias("j"))
    else:
        first = v.select("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).cast("long").alias("dst")).withColumn("j", F.col("dst"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("j", "dst"))
    kept = first.withColumn("r", rank).where(F.col("r") <= k)
    e = kept.select((F.lit(n) + F.col("id") * k + F.col("r") - 1).alias("id"), F.col("id").alias("src"), "dst", F.lit("link").alias("edge_type"), F.lit(None).cast("string").alias("label"))
    return Graph(v, e, "uniform")


def preferential(spark: SparkSession, n: int, k: int, seed: int = 1) -> Graph:
    """Vertex i points at min(k, i) distinct earlier ones, n k - k (k + 1) / 2 edges
    in all. Drawing i * u**2 for a uniform u favours early vertices as attachment to
    degree does in the limit, and each vertex can be drawn on its own."""
    v = spark.range(n).select("id", F.lit("vertex").alias("label"))
    u = lambda j: F.pmod(F.xxhash64("id", F.lit(seed), j), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picks = v.where("id > 0").select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4 * k + 15)), lambda j: F.floor(F.col("id") * u(j) * u(j)))).alias("j", "dst"))
    rest = v.where("id > 0").select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.least(F.lit(k).cast("long"), F.col("id"))), lambda j: F.col("id") - j)).alias("j", "dst"))
    every = picks.unionAll(rest.select("id", F.col("j") + 4 * k + 16, "dst")).groupBy("id", "dst").agg(F.min("j").alias("j"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("j", "dst"))
    kept = every.withColumn("r", rank).where(F.col("r") <= F.least(F.lit(k).cast("long"), F.col("id")))
    e = kept.select((F.lit(n) + F.col("id") * k + F.col("r") - 1).alias("id"), F.col("id").alias("src"), "dst", F.lit("link").alias("edge_type"), F.lit(None).cast("string").alias("label"))
    return Graph(v, e, "preferential")


def graph_of(spark: SparkSession, names: list[str], links: list[tuple], label: str = "node", name: str = "sample") -> Graph:
    """A small graph from names and (src, type, dst) index triples."""
    v = spark.createDataFrame([(i, label, n) for i, n in enumerate(names)], V)
    e = spark.createDataFrame([(len(names) + i, a, b, t, t) for i, (a, t, b) in enumerate(links)], E)
    return Graph(v, e, name)


def people(spark: SparkSession) -> Graph:
    names = ["Alice", "Bob", "Eve", "Mallory", "Trent"]
    links = [(0, "communicatesWith", 1), (0, "trusts", 4), (1, "trusts", 4), (2, "attacks", 0), (3, "attacks", 0), (3, "attacks", 1)]
    return graph_of(spark, names, links, "person", "people")


def alphabet(spark: SparkSession) -> Graph:
    letters = [chr(ord("a") + i) for i in range(26)]
    return graph_of(spark, letters, [(i, "followedBy", i + 1) for i in range(25)], "letter", "alphabet")
