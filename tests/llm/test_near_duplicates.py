"""Jaccard join and fingerprints against brute force."""

import hashlib
import itertools
import random

import pandas as pd

from graphlake.llm.fingerprints import edit_fingerprints, fingerprints, near_duplicates
from graphlake.llm.jaccard_join import jaccard_join, near_groups, one_of_each_group, verified
from graphlake.llm.common import keyed_texts
from graphlake.llm.minhash import bands_for, shingles
from graphlake.llm.queries import queries


def shingle_set(text):
    words = (text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, threshold=0.8):
    """[(doc_id, class_id, text_id, n_links)] of the rows, in order."""
    texts = {}
    for i, t in rows:
        texts.setdefault(tuple((t or "").split()), []).append(i)
    sets = {t: shingle_set(" ".join(t)) for t in texts}
    links = [(a, b) for a, b in itertools.combinations(texts, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    group = {t: t for t in texts}

    def find(x):
        return x if group[x] == x else find(group[x])

    for a, b in links:
        group[find(a)] = find(b)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    ids = {}
    for t, own in texts.items():
        ids.setdefault(find(t), []).extend(own)
    told = [(i, tuple((t or "").split())) for i, t in rows]
    return [(i, least(ids[find(t)]), least(texts[t]), sum(t in pair for pair in links)) for i, t in told]


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def planted(seed=5):
    """Random texts with exact copies, near copies, chains of them, and short ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 300))
    rows = [(i, " ".join(word() for _ in range(rng.randint(6, 120)))) for i in range(60)]
    for i in range(60, 200):
        words = rng.choice(rows)[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = word()
        rows.append((i, ("  " if rng.random() < 0.2 else " ").join(words)))
    return rows + [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "one two"), (205, "one two three")]


def test_shingles_are_hashes_of_word_runs():
    a, b = "a b c d e f g h", "x a  b c d e f\tg h"
    assert len(shingles(a)) == 4 and len(set(shingles(a)) & set(shingles(b))) == 4
    assert len(shingles("two words")) == 1 and len(shingles(" ")) == 0
    assert bands_for(0.8, 6, 0.9999) == 31


def test_join_equals_brute_force(make_docs):
    rows = planted()
    docs = make_docs(rows)
    want = brute(rows)
    assert any(n > 2 for *_, n in want) and any(c != t for _, c, t, _ in want)
    same(jaccard_join(docs), want)
    same(near_duplicates(docs), want)
    same(near_groups(docs), [(i, c) for i, c, *_ in want])
    assert sorted(r.doc_id for r in one_of_each_group(docs).collect()) == sorted({c for _, c, *_ in want})


def test_hot_groups_meet_in_blocks(make_docs):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(30)]
    for i in range(30, 70):
        words = list(base)
        words[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
    texts = keyed_texts(make_docs(rows))
    for how in ({"block": 8}, {"block_bytes": 4000}):
        _, found = verified(texts, 0.8, 5, **how)
        links = {r[0]: r[1] for r in found.groupBy("rep").sum("links").collect()}
        assert links == {t: n for _, _, t, n in brute(rows) if n}


def test_rows_without_an_id_and_ids_with_several_texts(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text + " more"), (None, text), (None, "lonely text here"), (None, text + " else"), (None, text + " else"), (7, text + " some"), (7, "a text of seven that copies nothing")]
    docs = make_docs(rows)
    want = brute(rows)
    assert {n for *_, n in want} == {0, 3}
    same(jaccard_join(docs), want)
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, text), (None, "lonely text here"), (7, "a text of seven that copies nothing")], key=str)
    anonymous = make_docs([(None, text), (None, text + " x"), (None, text)])
    same(jaccard_join(anonymous), [(None, None, None, 1)] * 3)
    assert one_of_each_group(anonymous).count() == 1
    assert jaccard_join(make_docs([])).count() == 0 and one_of_each_group(make_docs([])).count() == 0


def test_very_long_texts_and_ties(make_docs):
    long = " ".join(f"w{i}" for i in range(60_000))
    edge = [f"e{i}" for i in range(13)]  # 9 shingles; with 8 of 10 in common the similarity is 0.8
    rows = [(1, long), (2, long + " tail"), (3, " ".join(edge[:12])), (4, " ".join([*edge[:12], "x", "y"])), (5, None)]
    want = brute(rows)
    assert want[2][3] == 1
    same(jaccard_join(make_docs(rows)), want)


def test_join_query(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    same(queries()["op5_ngram_jaccard_join"](spark, small), brute(list(zip(docs.doc_id.tolist(), docs.text))))


def check_edits(got, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(rows)
    got = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for (key, text), nxt, r in zip(rows, rows[1:] + rows[:1], got):
        text, other = text or "", nxt[1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + other[:k]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (key, len(text), hashlib.sha256(edited.encode()).hexdigest())
        for a, b, near in ((text, edited, r.near_edited), (text, other, r.near_next)):
            a, b = shingle_set(a), shingle_set(b)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < 0.25 and (near == 1.0 if a == b else True)
    return got


def test_edit_fingerprints(spark, make_docs, small):
    rows = [(5, "a b c d e f g h i j k l"), (1, None), (2, ""), (9, "é" * 41), (7, " ".join(map(str, range(3000)))), (8, " ".join(map(str, range(3000)))), (-3, "x y z"), (None, "no id")]
    got = check_edits(edit_fingerprints(make_docs(rows)).collect(), rows)
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[7] == same[8] and same[1] == same[2]
    assert {r.doc_id: r.fingerprint for r in fingerprints(make_docs(rows)).collect()} == same
    assert edit_fingerprints(make_docs([])).count() == 0
    check_edits(edit_fingerprints(make_docs(rows[:1])).collect(), rows[:1])
    docs = pd.read_parquet(f"{small}/documents.parquet")
    check_edits(queries()["op6_document_fingerprints"](spark, small).collect(), list(zip(docs.doc_id.tolist(), docs.text)))
