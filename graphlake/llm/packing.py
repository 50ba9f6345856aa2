"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

Whole windows are cut from a document first; what is left is cut into pieces of
at most ``piece`` tokens. Pieces are dealt by hash into groups of bounded size,
and each group is packed on its own: every piece starts as a partial partition
of the group's windows with one filled window, and the two partial partitions
with the largest spread are merged again and again, fullest window onto
emptiest, until one is left. If a window exceeds the capacity, the group gets
more windows and is packed anew.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import keyed_texts, tidied, written
from graphlake.llm.encoding import encoder, slices

PIECE_SCHEMA = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long"
#: Windows a group can hold, as bits of sequence_id.
GROUP_BITS = 20


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each piece after multiway differencing."""
    n = len(sizes)
    if k == 1 or n == 1:
        return np.zeros(n, np.int64)
    # A partial partition: window loads ascending, their non-zero tail only.
    loads: dict[int, np.ndarray] = {i: sizes[i : i + 1].astype(np.int64) for i in range(n)}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    for new in range(n, 2 * n - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = loads.pop(a), loads.pop(b)
        both = np.zeros(min(k, len(x) + len(y)), np.int64)
        both[len(both) - len(x) :] = x
        both[: len(y)] += y[::-1]
        order = np.argsort(both, kind="stable")
        both = both[order]
        loads[new] = both
        merges.append((a, b, order.astype(np.int32)))
        heapq.heappush(heap, (-int(both[-1] - (both[0] if len(both) == k else 0)), new))
    # From the last merge back: the window of each slot of each partial partition.
    at: dict[int, np.ndarray] = {2 * n - 2: np.arange(k)[k - len(loads[2 * n - 2]) :]}
    length = {i: 1 for i in range(n)} | {n + j: len(m[2]) for j, m in enumerate(merges)}
    out = np.zeros(n, np.int64)
    for j in range(n - 2, -1, -1):
        a, b, order = merges[j]
        window = np.empty(len(order), np.int64)
        window[order] = at.pop(n + j)
        for child, slots in ((a, window[len(order) - length[a] :]), (b, window[: length[b]][::-1])):
            if child < n:
                out[child] = slots[0]
            else:
                at[child] = slots
    return out


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each piece, number of windows); no window exceeds ``capacity``."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        windows = difference(sizes, k)
        most = int(np.bincount(windows, weights=sizes, minlength=k).max())
        if most <= capacity:
            return windows, k
        # The excess over the mean is what differencing leaves: make room for it.
        room = capacity - (most - total / k)
        k = max(k + 1, int(np.ceil(total / room)) if room > capacity / 2 else k + 1)


def cut(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then even pieces."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    at, rest = full * capacity, n - full * capacity
    parts = -(-rest // piece)
    for i in range(parts):
        size = rest // parts + (i < rest % parts)
        out.append((at, size))
        at += size
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = 4096,
    piece: int = 512,
    group_pieces: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Null texts are empty and give one piece with the end id. Rows that repeat a
    document are packed each on its own (``copy``, a row number within the input
    partition, helps to keep their pieces apart). A null id stays null. An empty table
    gives no rows. Sequences are numbered group * 2**20 + window: unique, not
    dense. Within a sequence the pieces stand by doc_id and start without gaps.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        row = 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                out = []
                for key, raw in zip(keys[a:b], words.encode_batch(texts[a:b])):
                    raw += end
                    row += 1
                    for start, size in cut(len(raw) // 4, capacity, piece):
                        out.append((key, row, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), len(raw) // 4))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out)],
                    ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"],
                )

    cuts = written(keyed_texts(docs, id_col, text_col).mapInArrow(tidied(pieces), PIECE_SCHEMA), "pieces")
    groups = max(1, -(-cuts.count() // group_pieces))

    def windows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "copy", "start", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        sizes = rows["length"].to_numpy()
        full = sizes == capacity
        window = np.zeros(len(rows), np.int64)
        window[full] = np.arange(full.sum())
        if not full.all():
            window[~full], _ = pack(sizes[~full], capacity)
            window[~full] += full.sum()
        rows["sequence_id"] = (int(key[0]) << GROUP_BITS) + window
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows.drop(columns="group")

    group = F.pmod(F.xxhash64("doc_id", "copy", "start"), F.lit(groups))
    packed = cuts.withColumn("group", group).groupBy("group").applyInPandas(windows, PIECE_SCHEMA + ", sequence_id long, offset long")
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
