"""Line dedup, decontamination, licence scans, toxicity and quality."""

import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from graphlake.llm import quality as Q
from graphlake.llm import toxicity as T
from graphlake.llm.decontamination import contamination, decontaminate
from graphlake.llm.licenses import KNOWN, NO_ENDORSEMENT, TEXTS, license_scan
from graphlake.llm.line_dedup import PerfectHash, dedup_lines, without_shared_lines
from graphlake.llm.queries import queries

LONG = "This line is the same in many documents, and long."


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    split = [(i, (t or "").split("\n")) for i, t in rows]
    holders = {}
    for i, lines in split:
        for x in lines if i is not None else ():
            holders.setdefault(key(x), set()).add(i)
    out = []
    for i, lines in split:
        own = [holders.get(key(x), set()) for x in lines]
        kept = [x for x, h in zip(lines, own) if len(key(x)) < min_chars or len(h) < min_docs or i == max(h)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def check_lines(docs, rows):
    got = dedup_lines(docs)
    assert sorted((tuple(r) for r in got.select("doc_id", "kept", "n_lines", "n_dropped").collect()), key=str) == brute_lines(rows)


def test_line_dedup_equals_brute_force(make_docs):
    rng = random.Random(2)
    lines = [LONG, "  " + LONG.upper() + "\r", "ÄÖÜ " * 12 + "ende", "short line", "", "x" * 40, "é" * 39, "é" * 40 + "\t", *(f"unique line number {i} with enough letters in it" for i in range(200))]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 20)) if i % 9 else [LONG, LONG, "mine"])) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "\n\n"), (None, LONG + "\nnull id"), (7, LONG), (7, LONG)]
    check_lines(make_docs(rows), rows)


def test_line_dedup_of_large_ids_repeated_ids_and_long_texts(make_docs):
    big, other = 2**53, "Another line that is long enough to be compared at all."
    rows = [(big + i, f"{LONG}\nown {i}") for i in range(6)] + [(None, LONG + "\nrest"), (None, LONG), (None, None)]
    rows += [(1, f"{other}\n{i}") for i in range(5)] + [(2, other)]  # two documents, six rows
    rows += [(3, "\n".join([LONG, *(f"line {i} of a very long text that goes on and on" for i in range(50_000)), LONG]))]
    check_lines(make_docs(rows), rows)
    only = [(None, LONG + f"\n{i}") for i in range(7)]
    check_lines(make_docs(only), only)


def test_line_dedup_splits_a_hot_line(make_docs, monkeypatch):
    from graphlake.llm import line_dedup

    monkeypatch.setattr(line_dedup, "PROBE_LINES", 50)
    rows = [(i, f"{LONG}\nthis long line belongs to number {i} of all documents\n{'x' * (40 + i % 7)}") for i in range(300)]
    check_lines(make_docs(rows), rows)


def test_line_dedup_keeps_columns(make_docs):
    docs = make_docs([(i, LONG + f"\n{i}") for i in range(6)])
    kept = without_shared_lines(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {**{i: str(i) for i in range(5)}, 5: LONG + "\n5"}
    assert without_shared_lines(make_docs([])).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    mph = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(mph.index(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).index(keys).max() == -1


def brute_contamination(docs, items, threshold=0.8):
    """{(doc, item): (greatest similarity, starts of the windows that have it)}"""
    best = {}
    for item, said in items:
        words = (said or "").split()
        if not words:
            continue
        w = min(5, len(words))
        bag = lambda ws: Counter(tuple(ws[i : i + w]) for i in range(len(ws) - w + 1))
        want = bag(words)
        for doc, text in docs:
            own = (text or "").split()
            for s in range(max(1, len(own) - len(words) + 1)):
                have = bag(own[s : s + len(words)])
                if have:
                    common = (have & want).total()
                    near = common / (have.total() + want.total() - common)
                    if near >= threshold:
                        best.setdefault((doc, item), []).append((round(near, 9), s))
    return {k: (max(v)[0], {s for near, s in v if near == max(v)[0]}) for k, v in best.items()}


def check_found(df, want):
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in df.collect()}
    assert {k: near for k, (near, _) in got.items()} == {k: near for k, (near, _) in want.items()}
    assert all(s in want[k][1] for k, (_, s) in got.items())


def test_decontamination_equals_brute_force(spark, make_docs):
    rng = random.Random(4)
    word = lambda: "abcdefgh"[rng.randrange(8)] + str(rng.randint(0, 40))
    items = [(i, " ".join(word() for _ in range(rng.randint(30, 70)))) for i in range(12)] + [(20, "short item"), (21, None), (22, " "), (23, "a1 a1 a1 a1 a1 a1 a1 a1 a1")]
    docs = []
    for i in range(120):
        said = rng.choice(items[:12])[1].split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(said))
            kind = rng.randrange(3)
            said[at : at + (kind != 0)] = [word()] * (kind != 1)
        docs.append((i, " ".join([*(word() for _ in range(rng.randint(0, 40))), *said, *(word() for _ in range(rng.randint(0, 40)))])))
    docs += [(200, None), (201, ""), (202, "x short  item y"), (203, items[0][1] + " z " + items[0][1]), (204, "a1 " * 30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(docs, items)
    assert len(want) > 40
    check_found(contamination(make_docs(docs), benchmark), want)
    frame = make_docs(docs).selectExpr("*", "7 AS dirty_id", "8 AS similarity")
    kept = decontaminate(frame, benchmark)
    twice = make_docs([(1, items[0][1]), (1, "clean words"), (None, items[1][1]), (None, "clean too")])
    assert {r.text for r in decontaminate(twice, benchmark).collect()} == {"clean words", "clean too"}
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {d for d, _ in want}
    assert contamination(make_docs([]), benchmark).count() == 0
    assert contamination(make_docs(docs), benchmark.limit(0)).count() == 0


def test_decontamination_query(spark, small):
    docs, items = (pd.read_parquet(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))
    pairs = lambda df, key: list(zip(df[key].tolist(), df.text))
    check_found(queries()["op9_decontamination"](spark, small), brute_contamination(pairs(docs, "doc_id"), pairs(items, "item_id")))


def test_decontamination_is_native(spark, small):
    plan = queries()["op9_decontamination"](spark, small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_license_scan(make_docs):
    rows = [(1, "Code.\n released under the mit licence!\nCopyright 2020 A\nmore"), (2, "Licensed under the Apache License,\tVersion 2.0"), (3, None), (4, "mit license"), (None, "(c) me\nThe MIT License (MIT)\nThe MIT License (MIT)"), (2, "x")]
    got = {tuple(r) for r in license_scan(make_docs(rows)).collect()}
    assert got == {(1, "MIT", "line", 1), (2, "Apache-2.0", "text", 1), (2, "Apache-2.0", "line", 1), (None, "MIT", "line", 2)}
    assert license_scan(make_docs([])).count() == 0


def test_license_files(spark, make_docs):
    body = {i: t for i, t in KNOWN if len(t) > 400}
    wrapped = lambda t: "\n".join(textwrap.wrap(t, 76))
    shipped = {p.stem: p.read_text() for p in TEXTS.glob("*.txt")}
    two = shipped["BSD-2-Clause"].partition("\n")[2]
    three = two.replace("THIS SOFTWARE IS", f"3. {NO_ENDORSEMENT}\n\nTHIS SOFTWARE IS", 1)
    marked = "\n".join("# " + x for x in f"BSD 3-Clause License\n\nCopyright (c) 2020, A\nAll rights reserved.\n{wrapped(three)}".split("\n"))
    files = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 A\n\n" + wrapped(body["MIT"])),
        ("ISC", "ISC License\n\n// Copyright (c) 2020 A\n\n" + wrapped(body["ISC"])),
        ("BSD-2-Clause", "Copyright (c) 2020 A. All rights reserved.\n" + wrapped(two)),
        ("BSD-3-Clause", marked),
        ("Apache-2.0", shipped["Apache-2.0"].partition("http://www.apache.org/licenses/\n")[2]),
        ("GPL-3.0-only", shipped["GPL-3.0-only"].partition("How to Apply")[0]),
        *((name.removesuffix(".spdx"), text) for name, text in shipped.items()),
    ]
    found = {(r.doc_id, r.license_id) for r in license_scan(make_docs([(i, t) for i, (_, t) in enumerate(files)])).collect() if r.scope == "text"}
    assert found == {(i, name) for i, (name, _) in enumerate(files)}
    known = spark.createDataFrame([("Own", "Use it well.")], "license_id string, license_text string")
    assert [tuple(r) for r in license_scan(make_docs([(1, "x\n use IT well"), (2, files[0][1])]), known).collect()] == [(1, "Own", "line", 1)]


def labelled(sf):
    docs, labels = (pd.read_parquet(f"/root/testdata/{sf}/{n}.parquet") for n in ("documents", "labels"))
    return docs.merge(labels, on="doc_id")


def test_toxicity_on_held_out_labels():
    both = labelled("sf0.1")
    out = both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 0)
    model = T.fit(both[~out].text.tolist(), both[~out].toxic.to_numpy())
    assert len(model.thresholds) == 2
    p = np.array([model.probabilities(t) for t in both[out].text])
    assert model.thresholds[0] < model.thresholds[1] and (p[:, 0] >= p[:, 1]).all()
    said, true = p[:, 0] >= 0.5, both[out].toxic.to_numpy() == 1
    assert (said & ~true).sum() <= 0.01 * (~true).sum() and (said & true).sum() >= 0.88 * true.sum()


def test_ordinal_gradient_and_likelihood():
    rng = np.random.default_rng(1)
    n, features, levels = 30, 6, 3
    doc, at = np.repeat(np.arange(n), 3), rng.integers(0, features, 3 * n)
    value, y = rng.random(3 * n), rng.integers(0, levels + 1, n)
    state = rng.normal(size=features + levels)
    loss, g = T.loss_and_gradient(state, doc, at, value, y, levels, 0.01)
    t = T.thresholds(state, levels)
    assert (np.diff(t) > 0).all()
    chance = []
    for i in range(n):
        s = sum(state[a] * v for d, a, v in zip(doc, at, value) if d == i)
        p = [1.0, *(1 / (1 + np.exp(-(s - x))) for x in t), 0.0]
        chance.append(p[y[i]] - p[y[i] + 1])
    assert np.isclose(loss, -np.mean(np.log(chance)) + 0.005 * (state[:features] ** 2).sum())
    for k in range(len(state)):
        step = np.zeros_like(state)
        step[k] = 1e-5
        near = [T.loss_and_gradient(state + d, doc, at, value, y, levels, 0.01)[0] for d in (step, -step)]
        assert np.isclose(g[k], (near[0] - near[1]) / 2e-5, atol=1e-6)


def test_given_grades_are_used_as_they_are():
    rng = random.Random(6)
    signs = ["calm", "rude", "nasty", "vile"]
    grades = [i % 4 for i in range(400)]
    texts = [" ".join(rng.choice(["tree", "house", "walk", "river"]) for _ in range(20)) + f" {signs[g]}" * (g > 0) for g in grades]
    model = T.fit(texts, np.array(grades))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    severity = [model.probabilities(f"tree {s}").sum() for s in signs]
    assert severity == sorted(severity) and abs(severity[3] - 3) < 0.3 and severity[0] < 0.2


def test_toxicity_of_odd_rows(spark, make_docs):
    docs = make_docs([(i, "you stupid clown, what trash" if i % 3 == 0 else f"a calm text number {i}") for i in range(60)] + [(100, None), (101, ""), (None, "stupid trash clown"), (0, "stupid clown trash")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(50)] + [(51, 1, None), (None, 1, 1), (0, 0, 1)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.toxic) for r in T.toxicity(docs, labels).collect()]
    assert len(got) == 64 and all(t == int(i is None or i < 60 and i % 3 == 0) for i, t in got)
    none = T.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == 64 and {r.toxic for r in none} == {0}
    assert T.toxicity(make_docs([]), labels).count() == 0
    kept = T.without_toxic(docs, T.fit(*T.labelled_sample(docs, labels, "toxic", 1000)))
    assert kept.columns == docs.columns and kept.count() == 42


def test_quality_on_held_out_labels():
    both = labelled("sf0.01")
    out = both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    model = Q.fit(both[~out].text.tolist(), both[~out].quality.to_numpy())
    score, true = model.score(both[out].text.tolist()), both[out].quality.to_numpy()
    assert ((score >= 0.3) == (true == 1)).mean() >= 0.97 and 0 <= score.min() and score.max() <= 1


def test_votes_equal_brute_force():
    """Every document against every labelled vector, one by one, ties included."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["Good", "calm", "words", "BAD!!", "x9", "junk##", "the", "a"]) for _ in range(rng.randint(1, 12)))
    sample = [text() for _ in range(60)] + ["the same text"] * 20
    labels = np.array([rng.randint(0, 1) for _ in sample])
    model = Q.fit(sample, labels)
    asked = [text() for _ in range(40)] + ["the same text", "", "  "]
    vectors = model.project(asked)
    for t, own, score in zip(asked, vectors, model.score(asked)):
        near = [(round(float(np.float32(own @ v)), 6), -i, y) for i, (v, y) in enumerate(zip(model.vectors, model.labels))]
        best = sorted(near, reverse=True)[: Q.NEIGHBOURS]
        total = sum(max(c, 0) ** Q.SHARPNESS for c, _, _ in best)
        want = sum(max(c, 0) ** Q.SHARPNESS * y for c, _, y in best) / total if total else labels.mean()
        assert abs(score - want) < 1e-3 or sorted(near, reverse=True)[Q.NEIGHBOURS - 1][0] - sorted(near, reverse=True)[Q.NEIGHBOURS][0] < 2e-6 and near.count(best[-1]) == 1, t


def test_quality_never_learns_from_the_held_out_fifth(spark, make_docs):
    rows = [(i, "GOOD Words Here" if i % 2 else "bad!! bad!! bad!!") for i in range(100)] + [(200, None), (None, "bad!! bad!!")]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = lambda lie: spark.createDataFrame([(i, int(i % 2 if i not in held else lie), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: tuple(r) for r in Q.quality(make_docs(rows), labels(lie)).collect()} for lie in (0, 1))
    assert a == b and len(a) == 102 and {i for i, r in a.items() if r[1]} == set(held) | {i for i in (200,) if zlib.crc32(b"200") % 5 == 0}
    assert a[1][3] == 1 and a[2][3] == 0 and a[None][3] == 0
    assert Q.quality(make_docs([]), labels(0)).count() == 0
    assert {r.score for r in Q.quality(make_docs(rows), labels(0).limit(0)).collect()} == {0.5}
