"""Token output and packing against the tokenizer itself, an exact round trip and brute force."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphlake.llm.encoding import WordEncoder
from graphlake.llm.packing import cut, difference, pack, pack_documents
from graphlake.llm.queries import queries, word_bpe
from graphlake.llm.token_output import decode_block, decode_ranks, encode_block, encode_ranks, read_tokens, token_output, write_tokens

ODD = [None, "", " \n\t ", "Hello World!!", "don't stop", "ünïcödé ßtraße  x\r\ny", "東京 123 4.5e6", "<|endoftext|> a", "é     z", "a" * 5000, "'s 're n't", "x​y"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_bpe())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_the_tokenizer(tokenizer, small):
    texts = [t or "" for t in ODD] + pd.read_parquet(f"{small}/documents.parquet").text.fillna("").tolist()
    got = WordEncoder(word_bpe(), keep=1000).encode_batch(texts)
    for text, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(tokenizer, text), text[:80]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_word_encoder_on_any_text(texts):
    encode = test_word_encoder_on_any_text.encoder
    for text, raw in zip(texts, encode.encode_batch(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(encode.tokenizer, text)


test_word_encoder_on_any_text.encoder = WordEncoder(word_bpe())


@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=50))
def test_variable_length_code_round_trip(numbers):
    control, data = encode_ranks(np.array(numbers, "<u4"))
    assert decode_ranks(control, data, len(numbers)).tolist() == numbers


def test_common_ids_take_one_byte():
    ids = np.array([900] * 50 + [7] * 3 + [40_000], "<u4")
    vocab, control, data = encode_block(ids)
    assert np.frombuffer(vocab, "<u4").tolist() == [900, 7, 40_000]
    assert len(data) == len(ids) and len(control) == -(-len(ids) // 4)
    assert decode_block(vocab, control, data, len(ids)).tolist() == ids.tolist()


def expected_tokens(rows, tokenizer, end):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*ids_of(tokenizer, text), end], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def by_start(df):
    return [tuple(r) for r in df.orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]


def test_token_output_of_odd_rows(spark, make_docs, tokenizer, tmp_path):
    rows = [*enumerate(ODD), (None, "no id"), (3, "again"), (3, "again")]
    docs = make_docs(rows)
    assert by_start(token_output(docs, word_bpe(), 1)) == expected_tokens(rows, tokenizer, 1)
    write_tokens(docs, str(tmp_path / "t"), word_bpe(), 1, block_ids=16, num_partitions=3)
    back = read_tokens(spark, str(tmp_path / "t"))
    assert by_start(back) == expected_tokens(rows, tokenizer, 1)
    assert {tuple(r.ids) for r in back.where("doc_id = 4").collect()} == {(*ids_of(tokenizer, "don't stop"), 1)}
    assert token_output(make_docs([]), word_bpe(), 1).count() == 0


def test_token_output_query(spark, small, tokenizer):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    assert by_start(queries()["op1_token_output"](spark, small)) == expected_tokens(list(zip(docs.doc_id.tolist(), docs.text)), tokenizer, 1)


def test_differencing_balances_windows():
    rng = random.Random(3)
    for n, k in ((1, 1), (5, 3), (40, 7), (300, 20)):
        sizes = np.array([rng.randint(1, 500) for _ in range(n)])
        loads = np.bincount(difference(sizes, k), weights=sizes, minlength=k)
        assert loads.sum() == sizes.sum() and len(loads) == k
        if n > 10 * k:
            assert loads.max() - loads.min() <= 5
    windows, k = pack(np.array([400] * 11), 1000)
    assert np.bincount(windows).max() <= 2 and k >= 6  # the count rises where capacity is exceeded


@given(st.integers(1, 20_000))
def test_cut_covers_a_document(n):
    pieces = cut(n, 4096, 512)
    assert [s for s, _ in pieces] == np.cumsum([0] + [k for _, k in pieces])[:-1].tolist() and sum(k for _, k in pieces) == n
    assert all(0 < k <= 4096 for _, k in pieces)


def check_packing(pieces, rows, tokenizer, end, capacity):
    pieces = pieces.toPandas()
    ids = [np.array([*ids_of(tokenizer, t), end], "<u4") for _, t in rows]
    of = {}
    for (key, _), own in zip(rows, ids):
        of.setdefault(key, []).append(own)
    assert pieces.length.sum() == sum(map(len, ids))
    for key, part in pieces.groupby("doc_id", dropna=False):
        own = of[None if pd.isna(key) else int(key)]
        for r in part.itertuples():
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in own)
        if len(own) == 1:
            part = part.sort_values("start")
            assert part.start.tolist() == (part.length.cumsum() - part.length).tolist()
    for _, part in pieces.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == (part.length.cumsum() - part.length).tolist() and part.length.sum() <= capacity
    return pieces


def test_packing_of_odd_rows(make_docs, tokenizer):
    rows = [*enumerate(ODD), (None, "no id"), (3, "again"), (3, "again")]
    check_packing(pack_documents(make_docs(rows), word_bpe(), 2, capacity=64, piece=16, group_pieces=9), rows, tokenizer, 2, 64)
    assert pack_documents(make_docs([]), word_bpe()).count() == 0


def test_packing_query(spark, small, tokenizer):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    pieces = check_packing(queries()["op3_packing"](spark, small), list(zip(docs.doc_id.tolist(), docs.text)), tokenizer, 2, 4096)
    windows = pieces.groupby("sequence_id").length.sum()
    assert windows.sum() / (4096 * len(windows)) > 0.97
