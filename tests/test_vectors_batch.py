"""Batched nearest neighbours against the plain score of every pair."""

import random

import pytest

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.operators import vectors


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(6000)]
    rows += [(6000 + i, rows[0][1]) for i in range(400)]  # copies
    rows += [(7000, [2 * x for x in rows[0][1]]), (7001, [0.0] * 8), (7002, [1.0] * 3), (7003, None), (7004, [float("nan")] * 8), (7005, [None] * 8)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    return v, v.where("id % 20 = 0 or id > 7000").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_batch_equals_all_pairs(tables, metric):
    v, q = tables
    got = vectors.nearest_batch(v, q, 5, metric, block=100)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    best = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    pairs = v.crossJoin(F.broadcast(q)).select("query_id", "id", vectors.similarity(F.col("vector"), F.col("query"), metric).alias("score")).where("score is not null and not isnan(score)")
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(best, "id"))).where("rank <= 5")
    assert sorted(map(tuple, got.select("query_id", "rank", "id", "score").collect())) == sorted(map(tuple, want.select("query_id", "rank", "id", "score").collect()))
