"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

A dataset is a table of blocks. A block holds the ids of consecutive documents
(ascending id) up to ``block_ids`` ids, or one longer document. Its ids are
replaced by their frequency rank within the block, so that the 256 commonest
take one byte, and each rank is written in 1 to 4 bytes. The lengths stand
apart in a control stream, four 2-bit fields a byte, so a whole block is
decoded by one table lookup per control byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import keyed_texts, partitions, shared_path, tidied
from graphlake.llm.encoding import encoder, slices

BLOCK_SCHEMA = (
    "part long, part_start long, n_ids long, doc_ids binary, has_id binary, lengths binary, "
    "vocab binary, control binary, data binary"
)

#: For each control byte, which of the 4 x 4 bytes of four numbers are stored.
STORED = (np.arange(4) <= ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3)[:, :, None]).reshape(256, 16)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    for limit in (1 << 8, 1 << 16, 1 << 24):
        codes[: len(ranks)] += ranks >= limit
    control = (codes.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(axis=1, dtype=np.uint8)
    mask = np.arange(4) <= codes[: len(ranks), None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[mask].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of :func:`encode_ranks`; one lookup per control byte."""
    stored = STORED[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[stored] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(vocab, control, data): vocab lists the block's ids from the most frequent
    on, equal counts by id."""
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    vocab = used[np.lexsort((used, -counts[used]))].astype("<u4")
    rank = np.zeros(len(counts), "<u4")
    rank[vocab] = np.arange(len(vocab), dtype="<u4")
    return vocab.tobytes(), *encode_ranks(rank[ids])


def decode_block(vocab: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "<u4")
    return np.frombuffer(vocab, "<u4")[decode_ranks(control, data, n)]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = 1 << 21,
    num_partitions: int | None = None,
) -> None:
    """Write the ids of every document, each followed by ``end_id``, to ``path``.

    The table is range-partitioned and sorted by document id, so files, blocks
    and documents ascend; rows that share an id are ordered by text, rows whose
    id is null come first. A null text is empty and yields the end id alone. An
    empty table gives an empty dataset. Other columns are not read.
    """
    spark = docs.sparkSession
    n = num_partitions or partitions(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        part, done = TaskContext.get().partitionId(), 0
        keys: list = []
        texts: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(texts), "<u4")
            vocab, control, data = encode_block(ids)
            row = {
                "part": part,
                "part_start": done,
                "n_ids": len(ids),
                "doc_ids": np.array([k or 0 for k in keys], "<i8").tobytes(),
                "has_id": np.array([k is not None for k in keys], np.uint8).tobytes(),
                "lengths": np.array([len(t) // 4 for t in texts], "<i8").tobytes(),
                "vocab": vocab,
                "control": control,
                "data": data,
            }
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            ids, plain = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(plain):
                for k, raw in zip(ids[a:b], words.encode_batch(plain[a:b])):
                    if size and size + len(raw) // 4 >= block_ids:
                        yield block()
                        done += size
                        keys, texts, size = [], [], 0
                    keys.append(k)
                    texts.append(raw + end)
                    size += len(texts[-1]) // 4
        if keys:
            yield block()

    (
        keyed_texts(docs, id_col, text_col)
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(tidied(encode), BLOCK_SCHEMA)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per stored document: doc_id, start (ids before it in the whole
    dataset), n_tokens, ids_crc32, and the ids themselves if asked for."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row per file, so bounded by the number of partitions written.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    base = F.broadcast(spark.createDataFrame(starts, "part long, base long"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["vocab"], row["control"], row["data"], row["n_ids"])
                lengths = np.frombuffer(row["lengths"], "<i8")
                stops = np.cumsum(lengths)
                first = row["base"] + row["part_start"]
                cuts = list(zip((stops - lengths).tolist(), stops.tolist()))
                columns = [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["has_id"], np.uint8) == 0),
                    pa.array(first + stops - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in cuts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], stops]).astype(np.int32), ids.astype(np.int32)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    columns = ["base", "part_start", "n_ids", "doc_ids", "has_id", "lengths", "vocab", "control", "data"]
    return blocks.join(base, "part").select(columns).mapInArrow(decode, schema)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the dataset (to the shared folder unless told where) and return what
    its files hold, without the ids."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(spark, path, with_ids=False)
