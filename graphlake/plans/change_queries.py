"""Mutations, import and export, the change feed and event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.operators import mutate
from graphlake.sources.workspace import shared_dir
from graphlake.plans.registry import query
from graphlake.plans.scan_queries import EDGES_SQL, ID, VERTICES_SQL
from graphlake.sources import jsonl, synthetic, versions
from graphlake.sources.tables import commerce, supplies, supply, table
from graphlake.streaming import feed


def _path(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@query(f"SELECT count(*) AS n, max(id) - (SELECT max(id) FROM {EDGES_SQL}) AS above FROM (SELECT id FROM {VERTICES_SQL} UNION ALL SELECT (SELECT max(id) FROM {EDGES_SQL}) + 1 + i FROM range(3) AS r(i))")
def mutate_create_vertices(spark, sf_dir):
    g = commerce(spark, sf_dir)
    out = mutate.create_vertices(g, spark.createDataFrame([("extra", "a"), ("extra", "b"), ("extra", "c")], "label string, p_name string"))
    return out.vertices.agg(F.count("*").alias("n"), (F.max("id") - (mutate.next_id(g) - 1)).alias("above"))


@query(f"SELECT count(*) + 1 AS n FROM {EDGES_SQL}")
def mutate_create_edges(spark, sf_dir):
    new = spark.createDataFrame([(ID["part"] + 1, ID["part"] + 2, "goes_with")], "src long, dst long, edge_type string")
    return mutate.create_edges(commerce(spark, sf_dir), new).edges.agg(F.count("*").alias("n"))


@query(f"""WITH gone AS (SELECT {ID['part']} + p_partkey AS id FROM part WHERE p_partkey < 50)
  SELECT 'vertex' AS kind, count(*) AS n, CAST(sum(id % 1000003) AS BIGINT) AS checksum FROM {VERTICES_SQL} WHERE id NOT IN (FROM gone)
  UNION ALL SELECT 'edge', count(*), CAST(sum((src + dst) % 1000003) AS BIGINT) FROM {EDGES_SQL} WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)""")
def mutate_remove_cascade(spark, sf_dir):
    g = commerce(spark, sf_dir)
    gone = g.vertices.where((F.col("label") == "part") & (F.col("id") < ID["part"] + 50))
    return mutate.digest(mutate.remove_elements(g, gone))


@query(f"SELECT {ID['part']} + p_partkey AS id, CASE WHEN p_partkey < 10 THEN 'second' ELSE p_brand END AS p_brand FROM part")
def mutate_set_last_wins(spark, sf_dir):
    g = commerce(spark, sf_dir)
    ids = g.vertices.where((F.col("label") == "part") & (F.col("id") < ID["part"] + 10)).select("id")
    writes = ids.select("id", F.lit("first").alias("value"), F.lit(1).alias("ord")).unionAll(ids.select("id", F.lit("second"), F.lit(2)))
    return mutate.set_property(g, "p_brand", writes).vertices.where("label = 'part'").select("id", "p_brand")


@query(f"SELECT {ID['part']} + p_partkey AS id, CASE WHEN p_partkey < 10 THEN NULL ELSE p_brand END AS p_brand FROM part")
def mutate_remove_property(spark, sf_dir):
    g = commerce(spark, sf_dir)
    ids = g.vertices.where((F.col("label") == "part") & (F.col("id") < ID["part"] + 10)).select("id")
    return mutate.remove_property(g, "p_brand", ids).vertices.where("label = 'part'").select("id", "p_brand")


@query(f"""WITH v AS (SELECT id AS source_id, row_number() OVER (ORDER BY id) - 1 AS id FROM (SELECT {ID['supplier']} + s_suppkey AS id FROM supplier UNION ALL SELECT {ID['part']} + p_partkey FROM part))
  SELECT id, source_id FROM v""")
def mutate_trim(spark, sf_dir):
    return mutate.trim(supply(spark, sf_dir)).vertices.select("id", "source_id")


@query("SELECT vec_id AS element_id FROM embeddings WHERE vec_id >= 3 UNION ALL SELECT CAST(-1 AS BIGINT)")
def mutate_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("element_id"), F.lit("default").alias("name"), F.col("embedding").alias("vector"))
    changes = spark.createDataFrame([(0, "default", None), (1, "default", None), (2, "default", None), (-1, "default", [1.0] * 64)], "element_id long, name string, vector array<float>")
    return mutate.set_embeddings(e, changes).select("element_id")


@query("SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS n_vertices, count(*) AS n_edges, round(sum(l_quantity), 2) AS quantity FROM lineitem")
def jsonl_roundtrip(spark, sf_dir):
    jsonl.write(supplies(spark, sf_dir), path := _path(spark, "graph"), compression="gzip")
    back = jsonl.read(spark, path)
    e = back.edges.agg(F.count("*").alias("n_edges"), F.round(F.sum(jsonl.typed("props", "quantity", "double")), 2).alias("quantity"))
    return back.vertices.agg(F.count("*").alias("n_vertices")).join(F.broadcast(e))


@query("SELECT CAST(0 AS BIGINT) AS n_edges, (SELECT count(*) FROM part) AS n_vertices")
def export_no_dangling(spark, sf_dir):
    g = jsonl.exported(supplies(spark, sf_dir), vertex_label="part")
    return g.edges.agg(F.count("*").alias("n_edges")).join(F.broadcast(g.vertices.agg(F.count("*").alias("n_vertices"))))


@query("SELECT 'v1' AS version, 'commerce' AS name, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS n_vertices, (SELECT count(*) FROM lineitem) AS n_edges")
def save_and_load(spark, sf_dir):
    folder = _path(spark, "saved")
    versions.save(supplies(spark, sf_dir), folder, "v1")
    g = versions.load(spark, folder, "v1")
    assert isinstance(g, Graph)
    return versions.versions(spark, folder)


@query("SELECT user_id AS id, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def log_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "remove").otherwise("put")
    return versions.replay(e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("id"), "value"))


@query("SELECT CAST(200 AS BIGINT) AS n_vertices, CAST(1000 AS BIGINT) AS n_edges, CAST(5 AS BIGINT) AS min_distinct")
def synthetic_uniform(spark, sf_dir):
    g = synthetic.uniform(spark, 200, 5)
    per = g.edges.groupBy("src").agg(F.count_distinct("dst").alias("d")).agg(F.min("d").alias("min_distinct"))
    counts = g.edges.agg(F.count("*").alias("n_edges"), F.lit(200).cast("long").alias("n_vertices"))
    return counts.join(F.broadcast(per))


@query("SELECT CAST(100 * 3 - 6 AS BIGINT) AS n_edges, CAST(0 AS BIGINT) AS forward")
def synthetic_preferential(spark, sf_dir):
    g = synthetic.preferential(spark, 100, 3)
    return g.edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("dst") >= F.col("src")).alias("forward"))


def _feed(spark, sf_dir):
    """The events as property changes: one key per event type, 'error' removes the
    user's click."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "PropertyRemoved").otherwise("PropertySet")
    key = F.when(F.col("event_type") == "error", "click").otherwise(F.col("event_type"))
    return e.select(
        F.lit("e0").alias("epoch"), (F.col("event_id") + 1).alias("seq"), "ts", kind.alias("kind"), F.lit("vertex").alias("element"), F.col("user_id").alias("id"),
        F.lit("user").alias("label"), F.lit(None).cast("string").alias("edge_type"), key.alias("key"), F.col("value").cast("string").alias("value"),
    )


def _streamed(spark, sf_dir):
    path = _path(spark, "feed")
    _feed(spark, sf_dir).write.parquet(path)
    return feed.read_stream(spark, path)


@query("SELECT event_id + 1 AS seq FROM events WHERE event_type = 'purchase'")
def feed_filter(spark, sf_dir):
    wanted = _streamed(spark, sf_dir).where(feed.passes(kinds=["PropertySet"], keys=["purchase"]))
    feed.run_now(wanted, out := _path(spark, "feed-out"), _path(spark, "feed-check"))
    return spark.read.parquet(out).select("seq")


@query("SELECT 'e0' AS epoch, event_id + 1 AS expected, event_id + 2 AS found FROM events WHERE event_id % 100 = 50 AND event_id + 1 < (SELECT count(*) FROM events)")
def feed_gap_resync(spark, sf_dir):
    return feed.gaps(_feed(spark, sf_dir).where("(seq - 1) % 100 <> 50"))


@query("""WITH c AS (SELECT event_id, user_id AS id, event_type = 'error' AS removed, CASE WHEN event_type = 'error' THEN 'click' ELSE event_type END AS key FROM events)
  SELECT id, key, max(event_id) + 1 AS seq FROM c GROUP BY id, key HAVING NOT arg_max(removed, event_id)""")
def feed_materialise(spark, sf_dir):
    feed.run_now(feed.materialise(_streamed(spark, sf_dir)), out := _path(spark, "state"), _path(spark, "state-check"), mode="update")
    every = spark.read.parquet(f"{out}/batch=*")
    last = every.groupBy("id", "key").agg(F.max(F.struct("seq", "removed")).alias("m")).where("not m.removed")
    return last.select("id", "key", "m.seq")


@query("""WITH c AS (SELECT event_id, user_id AS id, event_type = 'error' AS removed, CASE WHEN event_type = 'error' THEN 'click' ELSE event_type END AS key FROM events)
  SELECT id, key, max(event_id) + 1 AS seq FROM c GROUP BY id, key HAVING NOT arg_max(removed, event_id)""")
def feed_last_values(spark, sf_dir):
    return feed.last_values(_feed(spark, sf_dir)).select("id", "key", "seq")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def win_tumbling(spark, sf_dir):
    return feed.tumbling(table(spark, sf_dir, "events"))


@query("""SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS w, event_type FROM events) GROUP BY 1, 2""")
def win_sliding(spark, sf_dir):
    return feed.sliding(table(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def win_session(spark, sf_dir):
    return feed.sessions(table(spark, sf_dir, "events"))
