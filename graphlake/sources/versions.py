"""Saved versions of a graph, and a mutation log folded onto one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.graph import Graph


def save(graph: Graph, folder: str, version: str) -> None:
    """Write both tables under ``folder/version`` and, last, a manifest row, which
    makes the version visible: a save that breaks off is never loaded."""
    base = f"{folder.rstrip('/')}/{version}"
    graph.vertices.write.mode("errorifexists").parquet(f"{base}/vertices")
    graph.edges.write.mode("errorifexists").parquet(f"{base}/edges")
    spark = graph.vertices.sparkSession
    saved = Graph(spark.read.parquet(f"{base}/vertices"), spark.read.parquet(f"{base}/edges"))
    row = saved.vertices.agg(F.lit(version).alias("version"), F.lit(graph.name).alias("name"), F.count("*").alias("n_vertices"))
    row.join(saved.edges.agg(F.count("*").alias("n_edges"))).coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/manifest")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/manifest").orderBy("version")


def load(spark: SparkSession, folder: str, version: str) -> Graph:
    row = versions(spark, folder).where(F.col("version") == version).first()
    if row is None:
        raise FileNotFoundError(f"no version {version} in {folder}")
    base = f"{folder.rstrip('/')}/{version}"
    return Graph(spark.read.parquet(f"{base}/vertices"), spark.read.parquet(f"{base}/edges"), row["name"])


def replay(log: DataFrame) -> DataFrame:
    """The last state per element of a log (seq, op 'put' or 'remove', id, value):
    rows whose last operation is a put, with its value."""
    last = log.groupBy("id").agg(F.max(F.struct("seq", "op", "value")).alias("m"))
    return last.where("m.op = 'put'").select("id", "m.value")
