"""Keyed, range, full-text, vector and spatial access."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlake.operators import indices, spatial, vectors
from graphlake.plans.registry import query
from graphlake.plans.scan_queries import ID
from graphlake.sources.tables import commerce, table


def _parts(spark, sf_dir):
    return commerce(spark, sf_dir).vertices.where("label = 'part'")


@query(f"SELECT DISTINCT {ID['part']} + p_partkey AS element_id FROM part WHERE p_brand = 'Brand#2'")
def index_lookup(spark, sf_dir):
    return indices.lookup(indices.backfill(_parts(spark, sf_dir), "p_brand"), "eq", "Brand#2")


@query(f"SELECT o_custkey AS key, arg_max({ID['orders']} + o_orderkey, (o_orderdate, o_orderkey)) AS element_id FROM orders GROUP BY o_custkey")
def index_single_last_wins(spark, sf_dir):
    writes = table(spark, sf_dir, "orders").select("o_custkey", (F.lit(ID["orders"]) + F.col("o_orderkey")).alias("id"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return indices.last_wins(writes, "o_custkey", "id", "seq")


@query("SELECT DISTINCT key, element_id FROM (SELECT p_name AS key, p_partkey AS element_id FROM part UNION ALL SELECT p_brand, p_partkey FROM part)")
def index_prefix_backfill(spark, sf_dir):
    entry = lambda c: F.struct(F.lit("string").alias("type"), F.col(c).alias("value"))
    bag = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("tag.name"), entry("p_name"), F.lit("tag.brand"), entry("p_brand"), F.lit("kind"), entry("p_type")).alias("props"))
    return indices.backfill_prefix(bag, "tag.")


def _prices(spark, sf_dir):
    return indices.backfill(_parts(spark, sf_dir), "p_retailprice")


@query(f"SELECT p_retailprice AS key, {ID['part']} + p_partkey AS element_id FROM part WHERE p_retailprice >= 950 AND p_retailprice < 1000")
def range_between(spark, sf_dir):
    return indices.between(_prices(spark, sf_dir), 950.0, 1000.0, True, False)


@query(f"SELECT DISTINCT {ID['part']} + p_partkey AS element_id FROM part WHERE p_retailprice > 1000")
def range_gt_dedup(spark, sf_dir):
    return indices.lookup(_prices(spark, sf_dir), "gt", 1000.0)


@query(f"SELECT DISTINCT key, element_id FROM (SELECT CAST(p_size AS DOUBLE) AS key, {ID['part']} + p_partkey AS element_id FROM part UNION ALL SELECT p_retailprice, {ID['part']} + p_partkey FROM part) WHERE key BETWEEN 10 AND 905")
def range_between_dups(spark, sf_dir):
    both = _prices(spark, sf_dir).unionAll(indices.backfill(_parts(spark, sf_dir).withColumn("p_size", F.col("p_size").cast("double")), "p_size"))
    return indices.between(both, 10.0, 905.0)


@query(f"SELECT DISTINCT {ID['part']} + p_partkey AS element_id FROM part WHERE p_brand <> 'Brand#2' AND p_partkey >= 50")
def index_maintenance(spark, sf_dir):
    index = indices.remove_key(indices.backfill(_parts(spark, sf_dir), "p_brand"), "Brand#2")
    return indices.remove_element(index, _parts(spark, sf_dir).where(F.col("id") < ID["part"] + 50)).select("element_id")


@query("SELECT 'brand' AS name, count(DISTINCT p_brand) AS n_keys, count(*) AS n_pairs FROM part UNION ALL SELECT 'price', count(DISTINCT p_retailprice), count(*) FROM part")
def index_inventory(spark, sf_dir):
    return indices.index_inventory({"brand": indices.backfill(_parts(spark, sf_dir), "p_brand"), "price": _prices(spark, sf_dir)})


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("text").alias("key"), F.col("doc_id").alias("element_id"))


@query("SELECT doc_id AS element_id, len(regexp_extract_all(text, '(?i)license|the of')) AS score FROM documents WHERE len(regexp_extract_all(text, '(?i)license|the of')) > 0")
def fulltext_score(spark, sf_dir):
    return indices.fulltext(_texts(spark, sf_dir), "license|the of")


@query(r"""SELECT doc_id AS element_id, CAST(len(regexp_extract_all(text, '(?i)licens')) AS BIGINT) AS score,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)(\w*(?:licens)\w*)'))), '|') AS highlights
  FROM documents WHERE len(regexp_extract_all(text, '(?i)licens')) > 0""")
def fulltext_highlight(spark, sf_dir):
    return indices.fulltext(_texts(spark, sf_dir), "licens", highlight=True)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query(spark, sf_dir, i=0):
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == i).first()["embedding"]]


_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_SCORE = {"cosine": "list_cosine_similarity(embedding::DOUBLE[], q)", "dot": "list_inner_product(embedding::DOUBLE[], q)", "l2": "list_distance(embedding::DOUBLE[], q)"}


def _knn(metric, where="", extra=""):
    order = "ASC" if metric == "l2" else "DESC"
    return f"SELECT id, round(score, 6) AS score FROM (SELECT vec_id AS id, {_SCORE[metric]} AS score FROM embeddings, {_Q} {where}) ORDER BY score {order}, id LIMIT 10"


def _rounded(df):
    return df.select("id", F.round("score", 6).alias("score"))


@query(_knn("cosine"))
def knn_cosine(spark, sf_dir):
    return _rounded(vectors.nearest(_vectors(spark, sf_dir), _query(spark, sf_dir), 10))


@query(_knn("dot"))
def knn_dot(spark, sf_dir):
    return _rounded(vectors.nearest(_vectors(spark, sf_dir), _query(spark, sf_dir), 10, "dot"))


@query(_knn("l2"))
def knn_l2(spark, sf_dir):
    return _rounded(vectors.nearest(_vectors(spark, sf_dir), _query(spark, sf_dir), 10, "l2"))


@query(_knn("cosine", "WHERE label = 3"))
def knn_label_constraint(spark, sf_dir):
    return _rounded(vectors.nearest(_vectors(spark, sf_dir), _query(spark, sf_dir), 10, where=F.col("label") == 3))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
  SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def knn_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return vectors.nearest_batch(v, q, 5).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT CASE WHEN vec_id = -1 THEN 'wrong_dimension' WHEN vec_id = -2 THEN 'non_finite' WHEN vec_id = -3 THEN 'zero_norm' ELSE 'ok' END AS verdict, count(*) AS n
  FROM (SELECT vec_id FROM embeddings UNION ALL VALUES (-1), (-2), (-3)) GROUP BY 1""")
def vector_admission(spark, sf_dir):
    bad = spark.createDataFrame([(-1, [1.0]), (-2, [float("nan")] * 64), (-3, [0.0] * 64)], "id long, vector array<float>")
    every = _vectors(spark, sf_dir).select("id", "vector").unionAll(bad)
    return every.groupBy(vectors.admission(F.col("vector"), 64).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"SELECT vec_id AS id FROM embeddings, {_Q} WHERE list_cosine_similarity(embedding::DOUBLE[], q) >= 0.2")
def semantic_filter(spark, sf_dir):
    return _vectors(spark, sf_dir).where(vectors.passes(F.col("vector"), _query(spark, sf_dir), 0.2)).select("id")


@query(f"SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cost FROM embeddings, {_Q}")
def semantic_cost(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", F.round(vectors.cost(F.col("vector"), _query(spark, sf_dir)), 6).alias("cost"))


@query("SELECT vec_id AS id FROM embeddings WHERE embedding = (SELECT embedding FROM embeddings WHERE vec_id = 5)")
def vector_lookup(spark, sf_dir):
    exact = F.array(*(F.lit(x).cast("float") for x in _query(spark, sf_dir, 5)))
    return _vectors(spark, sf_dir).where(F.col("vector") == exact).select("id")


def _points(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    return p.select(F.col("p_partkey").alias("id"), x.alias("lo1"), x.alias("hi1"), y.alias("lo2"), y.alias("hi2"))


@query("SELECT p_partkey AS id FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice / 100 BETWEEN 9.5 AND 10.5")
def spatial_region(spark, sf_dir):
    return spatial.in_region(_points(spark, sf_dir), [(10.0, 20.0), (9.5, 10.5)]).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_size BETWEEN 22 AND 28 AND p_retailprice / 100 BETWEEN 7 AND 13")
def spatial_distance_box(spark, sf_dir):
    return spatial.in_distance(_points(spark, sf_dir), [(25.0, 25.0), (10.0, 10.0)], 3.0).select("id")


@query("SELECT p_partkey AS id, round(sqrt(pow(p_size - 25, 2) + pow(p_retailprice / 100 - 10, 2)), 6) AS distance FROM part WHERE p_partkey <> 3 ORDER BY sqrt(pow(p_size - 25, 2) + pow(p_retailprice / 100 - 10, 2)), id LIMIT 15")
def spatial_knn(spark, sf_dir):
    return spatial.nearest(_points(spark, sf_dir), [(25.0, 25.0), (10.0, 10.0)], 15, exclude=3).select("id", F.round("distance", 6).alias("distance"))


@query("SELECT p_partkey AS id, p_size = 10 OR p_size = 20 AS touching, TRUE AS inside FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice / 100 > 0 AND p_retailprice / 100 < 1000")
def spatial_predicates(spark, sf_dir):
    box = [(10.0, 20.0), (0.0, 1000.0)]
    return _points(spark, sf_dir).where(spatial.intersects(box)).select("id", spatial.touches(box).alias("touching"), spatial.within(box).alias("inside"))


@query("""SELECT p_partkey AS id, round(6371.0 * 2 * asin(sqrt(pow(sin(radians(p_size - 10) / 2), 2) + cos(radians(10)) * cos(radians(p_size)) * pow(sin(radians(p_retailprice / 100 - 20) / 2), 2))), 3) AS km FROM part""")
def geo_distance(spark, sf_dir):
    km = spatial.great_circle(F.lit(10.0), F.lit(20.0), F.col("lo1"), F.col("lo2"))
    return _points(spark, sf_dir).select("id", F.round(km, 3).alias("km"))
