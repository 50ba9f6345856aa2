"""Line-delimited JSON graphs: a meta line, vertex lines, edge lines.

Property values are tagged, ``{"type": ..., "value": ...}``, so their types
survive. Export writes the tagged lines with Spark's text writer; import parses
them with a fixed schema and refuses what does not fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake.graph import EDGE_COLUMNS, VERTEX_COLUMNS, Graph
from graphlake.sources.workspace import written

FORMAT, VERSION = "graph-jsonl", 2

# Tags of Spark types, and back.
TAGS = {
    "string": "System.String", "boolean": "System.Boolean", "tinyint": "System.SByte", "smallint": "System.Int16", "int": "System.Int32",
    "bigint": "System.Int64", "float": "System.Single", "double": "System.Double", "timestamp": "System.DateTime", "timestamp_ntz": "System.DateTime", "array<float>": "System.Single[]",
}

# The fields a line of each type may have.
FIELDS = {
    "meta": ("type", "format", "version", "exportedAtUtc", "vertexCount", "edgeCount"),
    "vertex": ("type", "id", "label", "creationDate", "properties"),
    "edge": ("type", "id", "label", "creationDate", "properties", "edgePropertyId", "source", "target"),
}

SCHEMA = (
    "type string, format string, version int, vertexCount long, edgeCount long, id long, label string, edgePropertyId string, "
    "source long, target long, properties map<string,struct<type:string,value:string>>, _bad string"
)


def _tag(field: T.StructField) -> str:
    name = field.dataType.simpleString()
    if name.startswith("decimal"):
        return "System.Decimal"
    if name not in TAGS:
        raise ValueError(f"{field.name}: {name} has no tag")
    return TAGS[name]


def _properties(df: DataFrame, fixed: tuple[str, ...]):
    """A map of the tagged properties that a row has."""
    entries = []
    for f in df.schema:
        if f.name not in fixed:
            value = F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`").cast("string")
            entries.append(F.when(F.col(f"`{f.name}`").isNotNull(), F.struct(F.lit(f.name).alias("k"), F.struct(F.lit(_tag(f)).alias("type"), value.alias("value")).alias("v"))))
    if not entries:
        return F.lit(None).cast("map<string,struct<type:string,value:string>>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda x: x.isNotNull()))


def exported(graph: Graph, vertex_label: str | None = None, edge_label: str | None = None, edge_type: str | None = None) -> Graph:
    """What an export holds: filtered elements, without edges that lost an end."""
    v = graph.vertices if vertex_label is None else graph.vertices.where(F.col("label") == vertex_label)
    e = graph.edges if edge_label is None else graph.edges.where(F.col("label") == edge_label)
    e = e if edge_type is None else e.where(F.col("edge_type") == edge_type)
    return Graph(v, e, graph.name, closed=graph.closed and vertex_label is None).without_loose_ends()


def export_lines(graph: Graph) -> DataFrame:
    """(value): the meta line, then vertices, then edges, by id."""
    spark = graph.vertices.sparkSession
    # Sorted before they become text, which is several times as wide.
    v = graph.vertices.orderBy("id").select(F.to_json(F.struct(F.lit("vertex").alias("type"), "id", "label", _properties(graph.vertices, VERTEX_COLUMNS).alias("properties"))).alias("value"))
    line = F.struct(F.lit("edge").alias("type"), "id", F.col("edge_type").alias("edgePropertyId"), "label", F.col("src").alias("source"), F.col("dst").alias("target"), _properties(graph.edges, EDGE_COLUMNS).alias("properties"))
    e = graph.edges.orderBy("id").select(F.to_json(line).alias("value"))
    counts = (graph.vertices.count(), graph.edges.count())
    meta = f'{{"type":"meta","format":"{FORMAT}","version":{VERSION},"vertexCount":{counts[0]},"edgeCount":{counts[1]}}}'
    return spark.range(0, 1, 1, 1).select(F.lit(meta).alias("value")).unionAll(v).unionAll(e)


def write(graph: Graph, path: str, compression: str = "none", **filters) -> None:
    export_lines(exported(graph, **filters)).write.text(path, compression=compression)


class NotAGraph(ValueError):
    """An import that is refused, with the first line that is wrong."""

    def __init__(self, line: int | None, what: str) -> None:
        super().__init__(what if line is None else f"line {line}: {what}")
        self.line = line


def numbered_lines(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    """(line, value), or with ``columns`` these instead of the value: the lines of a
    file, or of a folder's files one after another, by their number from 1. One
    number per block of a file reaches the driver."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    said = F.trim("value") != ""
    # A blank line counts but says nothing, so only its place is kept.
    read = spark.read.text(path).select("value", *at, F.monotonically_increasing_id().alias("i"), said.alias("said"))
    lines = written(read.select("file", "block", "i", "said", *(columns or ["value"])), "lines")
    base, before = [], 0
    for r in lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("i").alias("low")).orderBy("file", "block").collect():
        base.append((r["file"], r["block"], before + 1 - r["low"]))
        before += r["n"]
    shift = F.broadcast(spark.createDataFrame(base, "file string, block long, shift long"))
    kept = [c for c in lines.columns if c not in ("file", "block", "i", "said")]
    return lines.join(shift, ["file", "block"]).where("said").select((F.col("i") + F.col("shift")).alias("line"), *kept)


def _fits(entry: Column) -> Column:
    """Whether a tagged value is one of its tag's type."""
    out = F.lit(False)
    for spark_type, tag in {"decimal(38,18)": "System.Decimal", **TAGS}.items():
        good = entry["value"].isNotNull() if spark_type == "string" else F.from_json(entry["value"], spark_type).isNotNull() if spark_type.startswith("array") else entry["value"].try_cast(spark_type).isNotNull()
        out = F.when(entry["type"] == tag, good).otherwise(out)
    return out


def _problem() -> Column:
    """What is wrong with a parsed line, or null."""
    allowed = F.lit(None).cast("array<string>")
    for kind, names in FIELDS.items():
        allowed = F.when(F.col("type") == kind, F.array(*map(F.lit, names))).otherwise(allowed)
    strange = F.array_join(F.array_except("keys", allowed), ", ")
    bad = F.array_join(F.map_keys(F.map_filter("properties", lambda _, v: ~F.coalesce(_fits(v), F.lit(False)))), ", ")
    element, edge = F.col("type") != "meta", F.col("type") == "edge"
    return F.coalesce(
        F.when(F.col("_bad").isNotNull() | F.col("keys").isNull(), "not a JSON object"),
        F.when(allowed.isNull(), "not a meta, vertex or edge line"),
        F.when(strange != "", F.concat(F.lit("unknown field "), strange)),
        F.when(F.size("keys") != F.size(F.array_distinct("keys")), "a field is given twice"),
        F.when(element & F.col("id").isNull(), "an element has no id"),
        F.when(edge & (F.coalesce("edgePropertyId", F.lit("")) == ""), "an edge has no type"),
        F.when(edge & (F.col("source").isNull() | F.col("target").isNull()), "an edge has no end"),
        F.when(bad != "", F.concat(F.lit("value does not fit its type: "), bad)),
    )


def read(spark: SparkSession, path: str) -> Graph:
    """The graph of a file or folder, properties as a tagged map ``props``.

    Refused as a whole, with the first wrong line (:class:`NotAGraph`): lines that
    are not JSON of this shape, fields that are unknown or given twice, values that
    do not fit their type, a missing, late or other meta line, counts that differ, ids
    used twice (vertices and edges share one space), edges without a type, and edges
    whose ends do not stand earlier in the file.
    """
    parsed = F.from_json("value", SCHEMA, {"columnNameOfCorruptRecord": "_bad"}).alias("x")
    lines = numbered_lines(spark, path, parsed, F.expr("json_object_keys(value)").alias("keys")).select("line", "keys", "x.*")

    def refuse(wrong: DataFrame) -> None:
        if first := wrong.orderBy("line").limit(1).collect():
            raise NotAGraph(first[0]["line"], first[0]["what"])

    refuse(lines.select("line", _problem().alias("what")).where("what is not null"))
    metas = lines.where("type = 'meta'").select("line", "format", "version", "vertexCount", "edgeCount").orderBy("line").limit(2).collect()
    first = lines.agg(F.min("line")).first()[0]
    if len(metas) != 1 or metas[0]["line"] != first or metas[0]["format"] != FORMAT or not 1 <= (metas[0]["version"] or 0) <= VERSION:
        raise NotAGraph(first, "one meta line of a known version must come first")
    elements = lines.where("type <> 'meta'")
    n = elements.agg(F.count_if(F.col("type") == "vertex"), F.count_if(F.col("type") == "edge")).first()
    if any(want is not None and want != got for want, got in zip(metas[0][3:], n)):
        raise NotAGraph(None, f"the meta line counts {tuple(metas[0][3:])}, the file has {tuple(n)}: it may be cut off")
    refuse(elements.groupBy("id").agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 1").select("line", F.lit("an id is used twice").alias("what")))
    v = lines.where("type = 'vertex'").select("id", "label", F.col("properties").alias("props"))
    e = lines.where("type = 'edge'").select("id", F.col("source").alias("src"), F.col("target").alias("dst"), F.col("edgePropertyId").alias("edge_type"), "label", F.col("properties").alias("props"))
    ends = lines.where("type = 'edge'").select("line", F.explode(F.array("source", "target")).alias("end"))
    places = lines.where("type = 'vertex'").select(F.col("id").alias("end"), F.col("line").alias("at"))
    refuse(ends.join(places, "end", "left").where("at is null or at > line").select("line", F.lit("an edge's end does not stand earlier in the file").alias("what")))
    return Graph(v, e, "imported")


def typed(column: str, key: str, spark_type: str):
    """A property of a tagged map as that type; null if absent or of another type."""
    entry = F.col(column)[key]
    return F.when(entry["type"] == TAGS[spark_type], entry["value"].try_cast(spark_type))
