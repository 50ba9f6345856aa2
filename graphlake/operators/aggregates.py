"""Cardinalities, degree distribution, partition and score summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.operators.mutate import dense_ids
from graphlake.operators.scan import degrees


def label_cardinality(elements: DataFrame, column: str = "label", top: int | None = None) -> DataFrame:
    """(name, n) by count, then name; a null label is counted under ''."""
    out = elements.groupBy(F.coalesce(F.col(column), F.lit("")).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")
    return out if top is None else out.limit(top)


def property_cardinality(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(key, n): elements that have each property."""
    counts = elements.agg(*(F.count(F.col(f"`{k}`")).alias(k) for k in keys))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("n")) for k in keys))).alias("x")).select("x.*").where("n > 0")


def degree_stats(graph: Graph, direction: str = "both") -> DataFrame:
    """min, max, mean and nearest-rank p50, p90, p99 over all vertices."""
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by degree)").cast("long").alias(f"p{int(p * 100)}")
    return degrees(graph, direction).agg(
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("mean_degree"), rank(0.5), rank(0.9), rank(0.99)
    )


def partition_sizes(partitions: DataFrame, column: str = "component", top: int | None = None) -> DataFrame:
    out = partitions.groupBy(column).agg(F.count("*").alias("size")).orderBy(F.desc("size"), column)
    return out if top is None else out.limit(top)


def top_scores(scores: DataFrame, n: int, column: str = "score") -> DataFrame:
    return scores.orderBy(F.desc(column), "id").limit(n)


def sample_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, population standard deviation and median; no task holds all values."""
    c = F.col(column)
    known = df.select(c.cast("double").alias("value")).dropna()
    n = known.count()
    middle = dense_ids(known, "value", into="__n").where(F.col("__n").isin((n - 1) // 2, n // 2)).agg(F.round(F.avg("value"), 4).alias("median"))
    return df.agg(F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_pop(c), 4).alias("stddev")).join(F.broadcast(middle))


def content_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(content_hash, n, first_id) of texts that more than one document has."""
    return docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
