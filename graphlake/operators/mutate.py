"""Changes as functions from graph to graph: a new pair of DataFrames, or an
error and no change at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.graph import EDGE_COLUMNS, Graph
from graphlake.sources.workspace import written


class Conflict(ValueError):
    """A property exists with another value."""


class NotFound(ValueError):
    """An element that the change needs is not there."""


def dense_ids(df: DataFrame, order: str = "id", start: int = 0, into: str = "new_id") -> DataFrame:
    """``df`` with ids start, start+1, ... in order. Rows are range-partitioned and
    counted per partition (one number each on the driver), so no task sees all."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    ranged = written(ranged, "numbered")  # counts and ids are of one evaluation
    counts = ranged.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("lo")).orderBy("__p").collect()
    base, at = [], start
    for p, size, low in counts:
        base.append((p, at - low))
        at += size
    shift = F.broadcast(spark.createDataFrame(base, "__p int, __shift long"))
    return ranged.join(shift, "__p").withColumn(into, F.col("__i") + F.col("__shift")).drop("__p", "__i", "__shift")


def next_id(graph: Graph) -> int:
    top = graph.elements().agg(F.max("id")).first()[0]
    return 0 if top is None else top + 1


def create_vertices(graph: Graph, new: DataFrame) -> Graph:
    """Add rows (label and properties); their ids follow the greatest id."""
    start = next_id(graph)
    numbered = dense_ids(new.withColumn("__row", F.monotonically_increasing_id()), "__row", start, "id").drop("__row")
    return graph.with_vertices(graph.vertices.unionByName(numbered, allowMissingColumns=True))


def create_edges(graph: Graph, new: DataFrame) -> Graph:
    """Add edges (src, dst, edge_type, ...); all or none: both ends must exist and
    the type must be given."""
    ids = graph.vertices.select(F.col("id").alias("__id"))
    ends = new.select(F.explode(F.array("src", "dst")).alias("__end")).distinct()
    if ends.join(ids, F.col("__end") == F.col("__id"), "left_anti").limit(1).count():
        raise NotFound("an edge's end is not in the graph")
    if new.where("edge_type is null or edge_type = ''").limit(1).count():
        raise ValueError("an edge needs a type")
    numbered = dense_ids(new.withColumn("__row", F.monotonically_increasing_id()), "__row", next_id(graph), "id").drop("__row")
    return graph.with_edges(graph.edges.unionByName(numbered, allowMissingColumns=True))


def _split(graph: Graph, kind: str) -> DataFrame:
    return graph.vertices if kind == "vertex" else graph.edges


def _put(graph: Graph, kind: str, df: DataFrame) -> Graph:
    return graph.with_vertices(df) if kind == "vertex" else graph.with_edges(df)


def set_property(graph: Graph, key: str, values: DataFrame, kind: str = "vertex", conflict: bool = False) -> Graph:
    """Set ``key`` from rows (id, value[, ord]); of several for one id the greatest
    ord wins. With ``conflict`` an existing other value, or two values for one id,
    is an error; an equal value is nothing new. Ids that are not there are an error."""
    if "ord" not in values.columns:
        values = values.withColumn("ord", F.lit(0))
    target = _split(graph, kind)
    if values.join(target.select("id"), "id", "left_anti").limit(1).count():
        raise NotFound("an element is not in the graph")
    if conflict:
        if values.groupBy("id").agg(F.count_distinct("value").alias("n")).where("n > 1").limit(1).count():
            raise Conflict(f"two values of {key} for one element")
        if key in target.columns and values.join(target, "id").where(F.col(key).isNotNull() & (F.col(key) != F.col("value"))).limit(1).count():
            raise Conflict(f"{key} has another value")
    last = values.groupBy(F.col("id").alias("__id")).agg(F.max_by("value", "ord").alias("__value"))
    joined = target.join(last, F.col("id") == F.col("__id"), "left")
    old = F.col(key) if key in target.columns else F.lit(None)
    return _put(graph, kind, joined.withColumn(key, F.when(F.col("__id").isNotNull(), F.col("__value")).otherwise(old)).drop("__id", "__value"))


def remove_property(graph: Graph, key: str, ids: DataFrame, kind: str = "vertex") -> Graph:
    target = _split(graph, kind)
    if key not in target.columns:
        return graph
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    joined = target.join(gone, F.col("id") == F.col("__gone"), "left")
    return _put(graph, kind, joined.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone"))


def remove_elements(graph: Graph, ids: DataFrame) -> Graph:
    """Remove vertices with all their edges, and edges; an unknown id is an error."""
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    if gone.join(graph.elements().select("id"), F.col("__gone") == F.col("id"), "left_anti").limit(1).count():
        raise NotFound("an element is not in the graph")
    edges = graph.edges
    for end in ("id", "src", "dst"):
        edges = edges.join(gone, F.col(end) == F.col("__gone"), "left_anti")
    return Graph(graph.vertices.join(gone, F.col("id") == F.col("__gone"), "left_anti"), edges, graph.name)


def set_embeddings(embeddings: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert (element_id, name, vector, model); a null vector removes. Of several
    changes of one key that with the greatest ``ord`` holds. A name must be given,
    the numbers finite, and as many as the name's other vectors have."""
    key = ["element_id", "name"]
    rank = F.col("ord") if "ord" in changes.columns else F.lit(0)
    rest = [c for c in changes.columns if c not in (*key, "ord")]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(rank, *rest)).alias("__last")).select(*key, "__last.*")
    if last.where("name is null or trim(name) = ''").limit(1).count():
        raise ValueError("an embedding needs a name")
    if last.where("exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))").limit(1).count():
        raise ValueError("an embedding holds a number that is not finite")
    out = embeddings.join(last.select(key), key, "left_anti").unionByName(last.where("vector is not null"), allowMissingColumns=True)
    if out.groupBy("name").agg(F.count_distinct(F.size("vector")).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("vectors of one name differ in length")
    return out


def trim(graph: Graph) -> Graph:
    """Dense ids from 0, vertices first, in the order of the old ones, which stay
    as ``source_id``."""
    v = dense_ids(graph.vertices.drop("source_id"))
    n = v.count()
    e = dense_ids(graph.edges.drop("source_id"), start=n)
    of = v.select(F.col("id").alias("__old"), F.col("new_id").alias("__new"))
    for end in ("src", "dst"):
        e = e.join(of, F.col(end) == F.col("__old")).withColumn(end, F.col("__new")).drop("__old", "__new")
    renamed = lambda df: df.withColumnRenamed("id", "source_id").withColumnRenamed("new_id", "id")
    return Graph(renamed(v), renamed(e), graph.name)


def clear(graph: Graph) -> Graph:
    return Graph(graph.vertices.limit(0), graph.edges.limit(0), graph.name)


def digest(graph: Graph) -> DataFrame:
    """(kind, n, checksum) to compare two states of a graph."""
    v = graph.vertices.agg(F.lit("vertex").alias("kind"), F.count("*").alias("n"), F.sum(F.col("id") % 1_000_003).alias("checksum"))
    e = graph.edges.select(*EDGE_COLUMNS[:3]).agg(F.lit("edge").alias("kind"), F.count("*").alias("n"), F.sum((F.col("src") + F.col("dst")) % 1_000_003).alias("checksum"))
    return v.union(e).select("kind", "n", F.coalesce("checksum", F.lit(0)).alias("checksum"))
