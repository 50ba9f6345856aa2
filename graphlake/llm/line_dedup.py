"""Line dedup by a sharded minimal perfect hash.

A line's key is hashed to 128 bits. The hashes of the keys that enough
documents share are dealt into shards of bounded size; a shard is a minimal
perfect hash (levels of bit arrays, a key's index is the rank of its bit) over
three arrays: a 64-bit fingerprint, the number of documents, and the largest
document id. The line hashes of the documents are dealt to the same shards and
probe the arrays there, 32 bytes a line; a shard that common lines make hot is
copied and its lines are dealt among the copies. The lines to drop come back to
their document by its id and a hash of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import keyed_texts, partitions, tidied, written
from graphlake.llm.minhash import mix

# What is stripped from both ends of a line.
EDGES = b" \t\n\x0b\x0c\r"
#: Keys of a shard and lines that probe one copy of it, on average, at most.
SHARD_KEYS = 100_000
PROBE_LINES = 500_000


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(w).astype(np.int64) for w in levels]
        self.base = np.cumsum([0] + [int(c.sum()) for c in counts])
        self.before = [np.cumsum(c) - c for c in counts]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(64 * words)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, levels = np.unique(keys), []
        while len(keys):
            words = max(1, -(-2 * len(keys) // 64))
            slot = cls._slot(keys, len(levels), words)
            alone = np.bincount(slot.astype(np.int64), minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[slot.astype(np.int64)]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; of a strange key any index, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            slot = self._slot(keys[open_], level, len(words))
            word, bit = (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)
            here = (words[word] >> bit) & np.uint64(1) == 1
            w, b = word[here], bit[here]
            below = np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
            out[open_[here]] = self.base[level] + self.before[level][w] + below
            open_ = open_[~here]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u8")
        return sizes.tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        words = np.frombuffer(raw, "<u8")
        sizes = words[1 : 1 + int(words[0])].astype(np.int64)
        return cls(np.split(words[1 + len(sizes) :], np.cumsum(sizes)[:-1]))


class Shard:
    def __init__(self, mph: bytes, prints: bytes, counts: bytes, lasts: bytes):
        self.mph = PerfectHash.from_bytes(mph)
        self.prints, self.counts, self.lasts = np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<i8"), np.frombuffer(lasts, "<i8")

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Where each key stands in the arrays, -1 for a key that is not stored."""
        at = self.mph.index(h1)
        return np.where((at >= 0) & (self.prints[at] == h2), at, -1)


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The line's key, or None if it is too short to count."""
    key = line.strip(EDGES).lower()  # bytes.lower() touches A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return key


def _hashes(lines: list[bytes], min_chars: int) -> tuple[list[int], np.ndarray]:
    """(positions, n x 2 hashes) of the lines that have a key."""
    at, marks = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and (key := key_of(line, min_chars)) is not None:
            at.append(i)
            marks.append(xxhash.xxh3_128_digest(key))
    return at, np.frombuffer(b"".join(marks), "<u8").reshape(-1, 2)


def _encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def line_hashes(texts: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, mark), once per row and key; mark is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.unique(_hashes(_encode(text).split(b"\n"), min_chars)[1], axis=0) for text in batch.column(2).to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]))
            both = np.concatenate(hashes).view("<i8") if hashes else np.zeros((0, 2), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column(0).take(owner), batch.column(1).take(owner)], ["h1", "h2", "doc_id", "mark"])

    return texts.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(tidied(run), "h1 long, h2 long, doc_id long, mark long")


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, last_doc) of the keys that at least min_docs ids hold."""
    held = lines.where("doc_id is not null").select("h1", "h2", "doc_id").distinct()
    return held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")).where(F.col("n_docs") >= min_docs)


def build_shards(shared: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its perfect hash and arrays. Hashes deal the keys evenly."""

    def build(table: pa.Table) -> pa.Table:
        h1 = table["h1"].to_numpy().view(np.uint64)
        mph = PerfectHash.build(h1)
        at = mph.index(h1)
        arrays = [np.zeros(len(h1), t) for t in ("<u8", "<i8", "<i8")]
        for array, name in zip(arrays, ("h2", "n_docs", "last_doc")):
            array[at] = table[name].to_numpy().view(array.dtype)
        parts = {n: [a.tobytes()] for n, a in zip(("prints", "counts", "lasts"), arrays)}
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "mph": [mph.to_bytes()]} | parts)

    return shared.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, "shard int, mph binary, prints binary, counts binary, lasts binary")


def _shard(shards: int) -> Column:
    return F.pmod("h1", F.lit(shards)).cast("int")


def dropped_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, mark, h1, h2) of the lines that go: their key is shared, and
    another document holds it last."""
    shared = written(shared_lines(lines, min_docs), "shared-lines")
    n, total = shared.count(), lines.count()
    shards = max(1, -(-n // SHARD_KEYS), -(-total // PROBE_LINES), min(n, partitions(lines.sparkSession)))
    table = written(build_shards(shared, shards), "line-shards")
    # Shards with over twice the mean: half of all at most, 12 bytes each.
    share = max(1, 2 * total // shards)
    dealt = lines.withColumn("shard", _shard(shards))
    hot = dealt.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(share)).cast("int").alias("copies")).where("copies > 1")
    hot = F.broadcast(written(hot, "hot-shards"))
    copies = F.coalesce("copies", F.lit(1))
    dealt = dealt.join(hot, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("doc_id", "mark"), copies)).drop("copies")
    table = table.join(hot, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - F.lit(1).cast("long")))).drop("copies")

    def probe(own: pa.Table, arrays: pa.Table) -> pa.Table:
        gone = np.zeros(own.num_rows, bool)
        if arrays.num_rows and own.num_rows:
            shard = Shard(*(arrays[c][0].as_py() for c in ("mph", "prints", "counts", "lasts")))
            h1, h2 = (own[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
            at = shard.find(h1, h2)
            known = at >= 0
            anonymous = own["doc_id"].is_null().to_numpy()
            other = own["doc_id"].fill_null(0).to_numpy() != shard.lasts[at]
            gone = known & (anonymous | other)
        return own.select(["doc_id", "mark", "h1", "h2"]).filter(pa.array(gone))

    keys = ["shard", "copy"]
    return dealt.groupBy(*keys).cogroup(table.groupBy(*keys)).applyInArrow(probe, "doc_id long, mark long, h1 long, h2 long")


#: What becomes of a text, as one struct column.
VERDICT = "kept string, n_lines long, n_dropped long"


def _without(lines: list[bytes], drop: set[int]) -> tuple[str, int, int]:
    kept = b"\n".join(x for p, x in enumerate(lines) if p not in drop) if drop else b"\n".join(lines)
    return kept.decode("utf-8", "surrogatepass"), len(lines), len(drop)


def with_verdict(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", verdict: str = "__lines") -> DataFrame:
    """All columns of ``docs`` and a struct of kept, n_lines and n_dropped."""
    lines = written(line_hashes(keyed_texts(docs, id_col, text_col), min_chars), "line-hashes")
    gone = dropped_lines(lines, min_docs).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    # A table, so that the join can split an id and text that many rows repeat.
    gone = written(gone.select(F.col("doc_id").alias("__drop_id"), F.col("mark").alias("__drop_mark"), F.col("gone.h1").alias("__g1"), F.col("gone.h2").alias("__g2")), "dropped-lines")

    @F.pandas_udf(VERDICT)
    def apply(texts: pd.Series, g1: pd.Series, g2: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, g1, g2):
            own, drop = _encode(text).split(b"\n"), set()
            if a is not None:
                marked = set(zip(a.tolist(), b.tolist()))
                at, h = _hashes(own, min_chars)
                drop = {p for p, pair in zip(at, h.view("<i8").tolist()) if tuple(pair) in marked}
            out.append(_without(own, drop))
        return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])

    key, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    joined = docs.join(gone, key.eqNullSafe(F.col("__drop_id")) & (F.xxhash64(text) == F.col("__drop_mark")), "left")
    return joined.withColumn(verdict, apply(text, F.col("__g1"), F.col("__g2"))).drop("__drop_id", "__drop_mark", "__g1", "__g2")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, kept (its text without the dropped lines),
    n_lines before dropping, n_dropped.

    Null and empty texts are one empty line. Rows that share an id are one document:
    together they count once for a key, and where their id holds it last they all
    keep it. A row without an id counts for no key and holds none last, so it loses
    every shared line. An empty table gives no rows; other columns are not read.
    """
    return with_verdict(keyed_texts(docs, id_col, text_col), min_chars, min_docs, verdict="lines").select("doc_id", "lines.*")


def without_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns in place, with the kept text; a null text
    becomes empty."""
    told = with_verdict(docs, min_chars, min_docs, id_col=id_col, text_col=text_col)
    return told.select(*(F.col("__lines.kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
