"""Import, chunking, path, subgraph and search rules on small inputs."""

import os
import re
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphlake.functions import chunks, registry
from graphlake.functions import text as T
from graphlake.operators import documents, identity, mutate, paths, patterns, scan, spatial
from graphlake.operators.subgraphs import Namespaces, Quota, QuotaExceeded, Subgraphs
from graphlake.sources import csvfile, jsonl, workspace
from graphlake.streaming import feed
from tests.test_graph import graph

META = '{"type":"meta","format":"graph-jsonl","version":2,"vertexCount":2,"edgeCount":1}'
A, B = '{"type":"vertex","id":1,"label":"x"}', '{"type":"vertex","id":2,"properties":{"n":{"type":"System.Int32","value":"7"}}}'
E = '{"type":"edge","id":3,"edgePropertyId":"t","source":1,"target":2}'


@pytest.mark.parametrize(
    ("lines", "line", "what"),
    [
        ([META, A, B, E.replace('"id":3', '"id":3,"colour":1')], 4, "unknown field colour"),
        ([META, A, B.replace('"7"', '"not a number"'), E], 3, "does not fit"),
        ([META, A.replace('"id":1', '"id":1,"id":1'), B, E], 2, "twice"),
        ([META, A, E, B], 3, "earlier"),
        ([META, A, B.replace('"id":2', '"id":1'), E], 3, "used twice"),
        ([META, A, "", "{broken", E], 4, "JSON"),
        ([A, META, B, E], 1, "meta"),
        ([META, A, B], None, "cut off"),
        ([META, A, B, E.replace('"t"', '""')], 4, "no type"),
    ],
)
def test_import_names_the_first_wrong_line(spark, tmp_path, lines, line, what):
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    with pytest.raises(jsonl.NotAGraph, match=what) as e:
        jsonl.read(spark, str(tmp_path / "g.jsonl"))
    assert e.value.line == line


def test_import_of_a_whole_file(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text("\n".join([META, A, B, E]))
    g = jsonl.read(spark, str(tmp_path / "g.jsonl"))
    assert (g.vertices.count(), g.edges.count()) == (2, 1)
    assert [r[0] for r in g.vertices.orderBy("id").select(jsonl.typed("props", "n", "int")).collect()] == [None, 7]


def told(items, low=800, high=4000):
    return [(c.kind, c.heading, len(c.text)) for c in chunks.assembled(items, low, high)]


def test_short_chunks_join_the_next_and_long_ones_are_split():
    md = f"# A\n{'a' * 897}\n# B\n{'b' * 98}\n# C\n{'c' * 900}\n"
    assert told(chunks.markdown_items(md)) == [("text", "A", 900), ("text", "B", 101 + 2 + 903)]
    assert told(chunks.markdown_items("# A\n## B\n\n### C\n")) == [("text", "A", 7)]
    words = "x" * 30 + "\n" + "y" * 30 + "\t" + "z" * 70
    assert [c.text for c in chunks.assembled(chunks.markdown_items(words), 0, 64)] == ["x" * 30 + "\n" + "y" * 30, "z" * 64, "z" * 6]
    assert [c.text for c in chunks.assembled(chunks.markdown_items("aa\n\nbb\n\ncccc"), 0, 6)] == ["aa\n\nbb", "cccc"]
    assert chunks.markdown_items(" \n ") == [] and told([]) == []


def test_table_windows_repeat_the_header():
    grid = (("h|1", "h2"), *((f"r{i}", "v" * 20) for i in range(5)))
    windows = chunks.table_windows(tuple(tuple(map(chunks.cell_text, r)) for r in grid), 90)
    assert all(w.startswith("| h\\|1 | h2 |\n| --- | --- |\n| r") for w in windows) and all(len(w) <= 90 for w in windows)
    assert sum(w.count("\n") - 1 for w in windows) == 5 and len(windows) == 3
    assert chunks.table_windows((("a",),)) == ["| a |\n| --- |"] and chunks.table_windows(()) == []


def test_structured_documents(spark):
    import json

    ref = lambda *names: [{"$ref": n} for n in names]
    doc = {
        "body": {"children": ref("t", "h", "g", "tab", "foot", "g", "gone")},
        "texts": [
            {"self_ref": "t", "label": "title", "text": "Title", "prov": [{"page_no": 2}]},
            {"self_ref": "h", "label": "section_header", "level": 2, "text": " Part "},
            {"self_ref": "p", "label": "paragraph", "text": "Words.", "prov": [{"page_no": 4}, {"page_no": 3}]},
            {"self_ref": "foot", "label": "page_footer", "text": "page 1"},
        ],
        "groups": [{"self_ref": "g", "children": ref("p", "g")}],
        "tables": [{"self_ref": "tab", "data": {"grid": [[{"text": "a|b"}, None], [{"text": "1\n2"}, {"text": "3"}]]}}],
    }
    frame = spark.createDataFrame([(1, json.dumps(doc)), (2, None), (3, " ")], "doc_id long, text string")
    got = [tuple(r) for r in chunks.chunk(frame, low=0, structured=True).orderBy("chunk_no").collect()]
    assert got == [(1, 0, "text", "Title", 2, 2, "Title"), (1, 1, "text", "Title > Part", 3, 4, "Part\n\nWords."), (1, 2, "table", "Title > Part", None, None, "| a\\|b |  |\n| --- | --- |\n| 1 2 | 3 |")]


def test_identifiers_by_where_they_match(spark):
    frame = spark.createDataFrame([("xFooBar1Baz_ then ZETA_ONE then FooBar",), (None,)], "text string")
    assert [r[0] for r in frame.select(T.identifiers(F.col("text"), 1)).collect()] == [["ZETA_ONE"], []]


def test_identifiers_of_whole_documents(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for i, text in zip(docs.doc_id, docs.text):
        found = [(m.start(), m[0]) for p, least in T.IDENTIFIERS for m in re.finditer(p, text or "") if len(m[0]) >= least]
        first = []
        for _, x in sorted(found):
            if x not in first and len(first) < 64:
                first.append(x)
        want[i] = sorted(first)
    assert {r.doc_id: r.found for r in entry.queries()["identifiers_whole"](spark, "/root/testdata/sf0.001").collect()} == want


def test_scan_of_another_type(spark):
    g = graph(spark, 3, [(0, 1)])
    count = lambda key, op, x: scan.property_scan(g, key, op, x, kind="vertex").count()
    assert [count("name", op, 25) for op in scan.COMPARE] == [0, 0, 0, 0, 0, 3]
    assert count("id", "eq", "1") == 0 and count("id", "ne", True) == 3 and count("id", "ge", 1.5) == 1


def test_stride_and_members(spark):
    ids = spark.range(10).withColumn("component", F.col("id") % 2)
    assert sorted(r.id for r in scan.stride_sample(ids, 4).collect()) == [0, 3, 6, 9] and scan.stride_sample(ids, 10).count() == 10
    assert [r.id for r in scan.members(ids, 1, limit=2, offset=1).collect()] == [3, 5]


def test_searches_meet_and_end_at_their_budget(spark):
    g = graph(spark, 7, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 5), (5, 6)])
    ahead, behind = paths.meeting(g, 0, 4)
    assert len(ahead) + len(behind) - 2 == 4 and paths.meeting(g, 0, 4, max_depth=3) is None
    assert [r.hops for r in paths.fewest_hops(g, 0, 4).collect()] == [4]
    assert [r.hops for r in paths.fewest_hops(g, 0, 4, direction="out").collect()] == [4] and paths.fewest_hops(g, 4, 0, direction="out").count() == 0
    assert paths.fewest_hops(g, 0, 4, vertex_filter=F.col("id") != 2).count() == 0
    assert paths.fewest_hops(g, 0, 4, vertex_filter=F.col("id").isin(1, 2, 3)).count() == 1
    for search in (lambda b: paths.fewest_hops(g, 0, 4, budget=b), lambda b: paths.cheapest(g, 0, budget=b), lambda b: paths.k_cheapest(g, 0, 4, 1, budget=b)):
        with pytest.raises(paths.BudgetExceeded):
            search(paths.Budget(rows=2))
        with pytest.raises(paths.BudgetExceeded):
            search(paths.Budget(seconds=-1))
    assert paths.fewest_hops(g, 0, 4, budget=paths.Budget(rows=100, seconds=100)).count() == 1


def test_subgraph_registry(spark):
    held = {"graph": graph(spark, 4, [(0, 1), (1, 2), (2, 3)])}
    subs = Subgraphs(lambda: held["graph"], Quota(subgraphs=2, elements=8, total=12, variable_length=3))
    subs.create("low", {"vertex_filter": F.col("id") < 3})
    subs.create("lower", {"vertex_filter": F.col("id") < 2}, on="low")
    assert subs.list() == [("low", None, 5), ("lower", "low", 3)] and [r.id for r in subs.contents("lower").collect()] == [0, 1]
    with pytest.raises(QuotaExceeded):
        subs.create("more", {})
    with pytest.raises(ValueError, match="stands on"):
        subs.remove("low")
    held["graph"] = graph(spark, 4, [(0, 1), (0, 1)])
    subs.recalculate("low")
    assert subs.list() == [("low", None, 5), ("lower", "low", 4)]
    held["graph"] = graph(spark, 3, [(0, 1)] * 6)
    with pytest.raises(QuotaExceeded):
        subs.recalculate("low")
    assert subs.list() == [("low", None, 5), ("lower", "low", 4)]
    subs.remove("lower")
    with pytest.raises(QuotaExceeded):
        subs.create("long", {"steps": [patterns.VertexStep(), patterns.EdgeStep(low=1, high=4), patterns.VertexStep()]})


def test_namespaces(spark, tmp_path):
    spaces = Namespaces(spark, str(tmp_path / "spaces"))
    assert spaces.list() == []
    spaces.create("one")
    spaces.create("two", "load")
    with pytest.raises(ValueError):
        spaces.create("one")
    spaces.save("two", graph(spark, 2, [(0, 1)]), "v1")
    assert spaces.list() == ["one", "two"] and spaces.start() == ["two"] and spaces.activate("two").vertices.count() == 2
    spaces.update("two", "lazy")
    assert spaces.get("two") == {"policy": "lazy"} and spaces.start() == []
    spaces.drop("two")
    assert spaces.list() == ["one"]
    with pytest.raises(KeyError):
        spaces.activate("two")


def test_document_search_modes(spark):
    rows = [(1, 0, "red fox", [1.0, 0.0]), (2, 0, "red red dog", [0.0, 1.0]), (3, 0, "blue", [1.0, 0.1]), (4, 0, "red", None)]
    table = spark.createDataFrame(rows, "doc_id long, chunk_no int, text string, vector array<float>")

    def ids(**how):
        found, used = documents.search(table, **how)
        return [r.doc_id for r in found.collect()], used

    assert ids(text="red", mode="lexical") == ([2, 1, 4], "lexical") and ids(vector=[1.0, 0.0], mode="lexical") == ([1, 3, 2], "dense")
    assert ids(text="red", vector=[1.0, 0.0]) == ([1, 2, 3, 4], "fused") and ids(text=" ") == ([], "none")
    assert ids(text="red", vector=[1.0, 0.0], where=F.col("vector").isNull()) == ([4], "lexical")
    left, rest = documents.delete_documents(table.select("doc_id", "text"), table, spark.createDataFrame([(1,), (9,)], "doc_id long"))
    assert left.count() == 3 and rest.count() == 3


def test_snapshots(spark):
    records = spark.createDataFrame([("a", {"x": "1"}), ("b", {"x": "2"}), ("c", {})], "record_id string, props map<string,string>")
    claims = spark.createDataFrame([("a", "k:1", "strong"), ("a", "w:1", "weak"), ("b", "k:2", "strong"), ("b", "k:3", "strong")], "record_id string, claim string, strength string")
    elements = spark.createDataFrame([(1, {"x": "1", "y": "9"}, False), (2, {"x": "0"}, False), (3, {}, False)], "element_id long, props map<string,string>, durable boolean")
    known = spark.createDataFrame([("k:1", 1), ("k:2", 2), ("k:3", 3)], "claim string, element_id long")
    claimants = spark.createDataFrame([(1, "i"), (2, "i"), (3, "i")], "element_id long, instance string")
    links = spark.createDataFrame([("t", "a", "b")], "edge_type string, src string, dst string")
    done = identity.apply_snapshot(records, claims, elements, known, claimants, "i", True, links)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(done.resolved) == [("a", 1, "match"), ("b", 2, "ambiguous"), ("c", None, "create")]
    assert rows(done.created) == [("c", {}, None)] and rows(done.updated) == [(2, {"x": "2"})]
    assert rows(done.claimed) == [(1, "w:1"), (2, "k:3")] and rows(done.withdrawn) == rows(done.deleted) == [(3,)]
    assert [tuple(r)[1:] for r in done.edges.collect()] == [("k:1", "k:2", "t")]
    partial = identity.apply_snapshot(records, claims, elements, known, claimants, "i", False)
    assert partial.withdrawn.count() == partial.deleted.count() == partial.edges.count() == 0
    wrong = identity.validate(records.select("record_id", F.lit("x").alias("label")), spark.createDataFrame([("a", "mac", "00:11:22:33:44:55"), ("z", "mac", "x")], "record_id string, type string, value string"), links)
    assert rows(wrong) == [("b", "no-strong-identifier"), ("c", "no-strong-identifier"), ("z", "claim-of-unknown-record"), ("z", "rejected-identifier-value")]


def test_gaps_across_runs(spark, monkeypatch):
    monkeypatch.setattr(feed, "GAP_RUN", 4)
    seqs = [1, 2, 5, 6, 7, 8, 20, 21, 23]
    got = feed.gaps(spark.createDataFrame([("e", s) for s in seqs] + [("f", 2)], "epoch string, seq long")).collect()
    assert sorted(map(tuple, got)) == [("e", 3, 5), ("e", 9, 20), ("e", 22, 23), ("f", 1, 2)]


def test_late_events_of_a_stream(spark, tmp_path):
    """A row behind the watermark is left out of the windows of a stream."""
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, event_type string, value double"
    source = str(tmp_path / "in")
    for batch in ([(at(0, 10), "a", 1.0), (at(5), "a", 2.0)], [(at(5, 30), "a", 8.0)], [(at(0, 20), "a", 4.0), (at(9), "a", 16.0)], [(at(12), "a", 32.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    feed.run_now(feed.tumbling(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r.window_start.hour: (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (1, 1.0), 5: (2, 10.0), 9: (1, 16.0)}


def test_embeddings_are_checked(spark):
    old = spark.createDataFrame([(1, "d", [1.0, 2.0])], "element_id long, name string, vector array<float>")
    put = lambda *rows: mutate.set_embeddings(old, spark.createDataFrame(list(rows), "element_id long, name string, vector array<float>, ord int"))
    assert sorted((r.element_id, r.vector) for r in put((1, "d", [3.0, 4.0], 1), (1, "d", [5.0, 6.0], 2), (2, "d", [0.0, 1.0], 1)).collect()) == [(1, [5.0, 6.0]), (2, [0.0, 1.0])]
    assert put((1, "d", None, 1)).count() == 0
    for bad in ((1, " ", [1.0, 2.0], 1), (2, "d", [1.0], 1), (2, "d", [float("nan"), 1.0], 1)):
        with pytest.raises(ValueError):
            put(bad)


def test_property_conflicts_and_clear(spark):
    g = graph(spark, 2, [(0, 1)])
    values = lambda *rows: spark.createDataFrame(list(rows), "id long, value string")
    with pytest.raises(mutate.Conflict):
        mutate.set_property(g, "name", values((0, "other")), conflict=True)
    assert mutate.set_property(g, "name", values((0, "v0")), conflict=True).vertices.count() == 2
    with pytest.raises(mutate.NotFound):
        mutate.set_property(g, "name", values((9, "x")))
    assert mutate.clear(g).elements().count() == 0


def test_named_queries_and_extensions(spark):
    g = graph(spark, 3, [(0, 1), (1, 2)])
    assert registry.check_fragment(g.vertices, "id > 1") == [] and registry.check_fragment(g.vertices, "id + 1", "number") == []
    assert registry.check_fragment(g.vertices, "id + 1") and registry.check_fragment(g.vertices, "nothing > 1")
    library = registry.QueryLibrary()
    library.register(registry.NamedQuery("way", "path", {"source": 0, "target": 2, "vertex_filter": "id < 9"}))
    library.register(registry.NamedQuery("few", "subgraph", {"vertex_filter": "id < 2"}))
    again = registry.QueryLibrary.from_json(library.to_json())
    assert again.list() == ["few", "way"] and again.run("way", g).count() == 1 and again.run("few", g).edges.count() == 1
    with pytest.raises(ValueError):
        library.register(registry.NamedQuery("way", "path"))
    library.delete("way")
    extensions = registry.Extensions()
    extensions.register("function", "count", lambda graph, plus=0: graph.vertices.count() + plus)
    assert extensions.invoke("function", "count", g, plus=1) == 4 and extensions.list() == [("function", "count")]
    context = registry.TraversalContext([1.0, 0.0])
    assert spark.createDataFrame([([1.0, 0.0],)], "v array<float>").select(context.similarity(F.col("v"))).first()[0] == pytest.approx(1)


def test_text_and_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffid, name\n1,"x, ""y""\nz"\n2,\n', encoding="utf-8")
    got = csvfile.read(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "name"] and [tuple(r) for r in got.collect()] == [("1", 'x, "y"\nz'), ("2", None)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.md").write_text("# A\nb\n")
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in csvfile.read_texts(spark, str(tmp_path / "t")).collect()] == [("a.md", "# A\nb\n")]


def test_a_cluster_needs_a_shared_folder():
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="share"):
        workspace.shared_dir(Elsewhere)


ON_A_CLUSTER = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from graphlake.sources.workspace import ship_package

config = {"spark.checkpoint.dir": sys.argv[2], "spark.ui.enabled": "false"}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=config).getOrCreate()
for _ in range(2):
    ship_package(spark)

def where(frames):
    import graphlake
    for f in frames:
        yield f.assign(at=graphlake.__file__)

found = {r.at for r in spark.range(8, numPartitions=4).mapInPandas(where, "id long, at string").collect()}
assert all(".zip" in at for at in found), found
"""


def test_a_cluster_gets_the_package_through_the_shared_folder(tmp_path):
    root = str(Path(workspace.__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    run = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, root, str(tmp_path)], cwd=tmp_path, env=env | {"SPARK_SCALA_VERSION": "2.13"}, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]
    assert len(list(tmp_path.glob("graphlake-*.zip"))) == 1


def test_box_predicates(spark):
    boxes = spark.createDataFrame([(1, 0.0, 4.0, 0.0, 4.0), (2, 1.0, 2.0, 1.0, 2.0), (3, 4.0, 5.0, 0.0, 1.0)], "id int, lo1 double, hi1 double, lo2 double, hi2 double")
    ids = lambda test: [r.id for r in boxes.where(test).orderBy("id").collect()]
    box = [(1.0, 2.0), (1.0, 2.0)]
    assert ids(spatial.contains(box)) == [1, 2] and ids(spatial.equals(box)) == [2] and ids(spatial.within([(0.0, 4.0), (0.0, 4.0)])) == [1, 2]
    assert ids(spatial.touches([(0.0, 4.0), (0.0, 4.0)])) == [3] and ids(spatial.intersects([(4.5, 6.0), (0.0, 1.0)])) == [3]
    assert [r[0] for r in boxes.orderBy("id").select(spatial.distance([(7.0, 8.0), (4.0, 4.0)])).collect()] == [3.0, pytest.approx(29**0.5), pytest.approx(13**0.5)]
