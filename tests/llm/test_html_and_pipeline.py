"""Main-text extraction, the registered queries against their SQL, and the pipeline."""

import itertools
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from graphlake.llm.html_extraction import EDGES, HASHED, Forest, extract_text, labelled_pages, labels_of, marginals, train
from graphlake.llm.html_tree import parse


@pytest.fixture(scope="module")
def model():
    return train()


def test_messages_give_exact_marginals():
    tree = parse("<div>a<p>b</p><ul><li>c</ul></div>d")
    forest = Forest([tree])
    rng = np.random.default_rng(1)
    weights, pairs = rng.normal(size=HASHED), rng.normal(size=(EDGES, 2, 2))
    got, _ = marginals(forest, weights, pairs)
    n = len(tree.tag)
    own = np.bincount(forest.node, weights=weights[forest.feature], minlength=n)
    total, content = 0.0, np.zeros(n)
    for state in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(own[i] * state[i] for i in range(n)) + sum(pairs[forest.edge[i], state[tree.parent[i]], state[i]] for i in range(1, n)))
        total += p
        content += p * np.array(state)
    assert np.allclose(got, content / total)


def test_held_out_pages(model):
    right = total = 0
    for html in labelled_pages(150, seed=99):
        tree = parse(html)
        want = "\n".join(t for t, tag, y in zip(tree.text, tree.tag, labels_of(tree)) if tag == "#" and y)
        got = model.texts([html.replace("data-keep", "data-x")])[0]
        a, b = set(want.split("\n")), set(got.split("\n"))
        right, total = right + len(a & b), total + len(a | b)
    assert right / total > 0.93


def test_article_without_its_surroundings(model):
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
    <div class="cookie-notice">We use cookies to make this site better.</div>
    <article><h1>Caf&eacute; &amp; Bar</h1><p>First   paragraph,
    over two&nbsp;lines.<p>Second <b>one</b> with <a href="/x">a link</a> in it.</p><!-- no --><div class="ad">Buy this now, it is cheap.</div>
    <p>Third paragraph closes the article.</p></article>
    <aside class="sidebar"><h3>More</h3><ul><li><a href="/c">C</a></li></ul></aside>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this article very much.</p></div></section>
    <form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""
    assert model.texts([html])[0] == "Café & Bar\nFirst paragraph, over two lines.\nSecond one with a link in it.\nThird paragraph closes the article."


def test_formulae_drawings_and_bylines_are_of_the_article(model):
    html = """<html><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><article><h1>A heading</h1>
    <p class="byline">By Ann Author</p><p>Then <math><mi>E</mi><mo>=</mo><mi>m</mi></math> is a formula in this sentence.</p>
    <p>The drawing <svg><title>no</title><text>says this</text></svg> in a sentence.</p><p>One more paragraph ends the article.</p>
    <div class="author-box"><p>Ann Author writes about many things.</p></div></article>
    <div class="share"><a href="/s">Share</a></div><footer>Copyright of the site.</footer></body></html>"""
    want = ["A heading", "By Ann Author", "Then E=m is a formula in this sentence.", "The drawing says this in a sentence.", "One more paragraph ends the article.", "Ann Author writes about many things."]
    assert model.texts([html])[0].split("\n") == want


def test_registered_extraction(spark, model):
    """The query on whole pages: the article's blocks, nothing of what stands around."""
    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet").set_index("page_id")
    got = entry.queries()["op4_html_extraction"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages)
    for r in got:
        tree = parse(pages.html[r.page_id])
        inside = [False] * len(tree.tag)
        for i in range(1, len(inside)):
            inside[i] = inside[tree.parent[i]] or tree.tag[i] == "article"
        assert r.text == "\n".join(t for t, tag, y in zip(tree.text, tree.tag, inside) if tag == "#" and y) and r.n_chars == len(r.text)


def test_extraction_of_odd_rows(spark, model):
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<p>One sentence stands here."), (4, "u", "<article><p>A sentence that is cut off in a <b"), (5, "u", "<p>" + "word " * 200_000), (5, "u", "no markup at all, only one sentence."), (6, "u", "<div>" * 3000 + "deep words stand here." + "</div>" * 3000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = [tuple(r) for r in extract_text(frame, model).select("page_id", "url", "text", "n_chars").collect()]
    assert len(got) == 7 and all(n == len(t) for *_, t, n in got)
    assert got[0] == (1, "u", "", 0) and got[1] == (2, None, "", 0) and got[3][2] == "A sentence that is cut off in a" and got[4][3] == 999_999
    assert extract_text(frame.limit(0), model).count() == 0


LLM = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in LLM if n in entry.oracle_sql()])
def test_query_equals_its_sql(spark, name):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}/{table}.parquet')")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, at).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda df: df[order].sort_values(order).reset_index(drop=True).astype(str)
    pd.testing.assert_frame_equal(rows(got), rows(want))


def test_pipeline_stages(spark, make_docs, tmp_path):
    """Planted cases go where each stage should take them, the rest stays."""
    item = " ".join(f"item{i}" for i in range(40))
    line = "A line of more than forty characters that many documents share."
    docs = [(i, " ".join(f"w{(i * 37 + k * k) % 9973}" for k in range(60 + i))) for i in range(60)]
    docs += [(100 + i, docs[0][1]) for i in range(3)] + [(110, docs[1][1] + " tail")]
    docs += [(120, docs[5][1] + " " + item), (121, "you stupid clown, what trash, stupid clown")]
    docs += [(130 + i, line + "\n" + docs[10 + i][1].upper()) for i in range(6)] + [(140, None), (141, "")]
    frame = make_docs(docs)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    train_docs = [(i, 1, int(i == 121)) for i, _ in docs if i < 60 or i == 121]
    spark.createDataFrame(train_docs, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = frame
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, str(tmp_path))
        if name != "packing":
            assert seen.columns == frame.columns
        ids[name] = {r.doc_id: r for r in seen.collect()}
    assert 100 not in ids["ngram_jaccard_join"] and 0 in ids["ngram_jaccard_join"] and 110 not in ids["ngram_jaccard_join"]
    assert 120 in ids["ngram_jaccard_join"] and 120 not in ids["benchmark_decontamination"]
    assert [line in ids["line_dedup"][130 + i].text for i in range(6)] == [False] * 5 + [True]
    assert all(r.n_chars == len(r.text) for r in ids["line_dedup"].values())
    assert set(ids["packing"]) == set(ids["benchmark_decontamination"])
    assert set(range(60)) <= set(ids["packing"])


def test_pipeline_run(spark):
    stages, docs = corpus_pipeline.STAGES, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in stages] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    for _, stage in stages:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    assert rows(entry.queries()["pipeline"](spark, "/root/testdata/sf0.001")) == rows(docs)


def test_operators_stand_alone():
    """Nothing outside the subpackage imports it."""
    for folder, _, files in os.walk(os.path.join(entry.ROOT, "graphlake")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "graphlake.llm" not in source.read()


@pytest.mark.parametrize("start", ["<html><head><title>T</title>", "<html><head><title>T</title><meta charset=utf-8><style>s</style></head><body>", "<head><script>x</script><title>T</title>", "<head><title>T</title><body>"])
def test_head_may_stay_open(start):
    tree = parse(start + "<h1>A</h1><p>Let <math><mi>x</mi></math> be <object>one</object>.</p>")
    assert [text for tag, text in zip(tree.tag, tree.text) if tag == "#"] == ["A", "Let x be one."]


def test_text_ends_a_head():
    tree = parse("<html><head><title>T</title>\nbare text<p>more")
    assert [text for tag, text in zip(tree.tag, tree.text) if tag == "#"] == ["bare text", "more"]
