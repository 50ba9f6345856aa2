"""Document fingerprints: MinHash over word shingles, compared without the texts.

A fingerprint keeps the low 16 bits of each permutation's least value, as hex.
Its likeness to another is the share of equal values, an estimate of the
Jaccard of the two shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import keyed_texts, partitions, tidied
from graphlake.llm.jaccard_join import Banding, jaccard_join
from graphlake.llm.minhash import Permutations, shingles

PERMUTATIONS = 128
SEED = 6
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint(text: str, hashes: Permutations, width: int = 5) -> np.ndarray:
    return hashes.signature(shingles(text, width)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row. Null and empty texts share the
    fingerprint of the empty set; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Permutations(PERMUTATIONS, SEED)
        for batch in batches:
            marks = [fingerprint(t, hashes, width).tobytes().hex() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], ["doc_id", "fingerprint"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, fingerprint string")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, text_id, n_links (see :func:`jaccard_join`) of the texts
    whose fingerprints share one of their bands of ``rows`` values and whose shingle
    sets reach the threshold. The 32 bands of 4 find a pair at 0.8 but for a chance of
    5 in 100 million."""
    banding = Banding(PERMUTATIONS // rows, rows, SEED, bits=16)
    return jaccard_join(docs, threshold, width, id_col, text_col, banding)


def with_successor(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, text, ahead) in n id ranges, one partition each, sorted; after a
    range's own rows stand, marked ahead, the rows of the first id of the next
    range that has any (after the last range: of the first). A null id sorts first.

    One number per range reaches the driver, and the texts are shuffled once.
    """
    cuts = sorted({int(x) for x in texts.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []

    def part_of(ids: pa.Array) -> np.ndarray:
        at = np.searchsorted(np.array(cuts, np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, at)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int | None] = {}
        for batch in batches:
            for k, i in zip(part_of(batch.column(0)).tolist(), batch.column(0).to_pylist()):
                least[k] = i if k not in least or i is None else (None if least[k] is None else min(i, least[k]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(least), pa.int64()), pa.array(list(least.values()), pa.int64())], ["part", "first"]
        )

    # One row per range at most.
    found = (
        texts.select("doc_id")
        .mapInArrow(firsts, "part long, first long")
        .groupBy("part")
        .agg(F.min("first").alias("first"), F.max(F.isnull("first")).alias("null"))
        .orderBy("part")
        .collect()
    )
    before: dict[int | None, int] = {}
    for k, row in enumerate(found):
        before[None if row["null"] else row["first"]] = found[k - 1]["part"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "part", "ahead"]
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays([ids, text, pa.array(part_of(ids), pa.int32()), pa.array(np.zeros(len(ids), bool))], names)
            heads = [(i, before[k]) for i, k in enumerate(ids.to_pylist()) if k in before]
            if heads:
                at = pa.array([i for i, _ in heads])
                yield pa.RecordBatch.from_arrays([ids.take(at), text.take(at), pa.array([k for _, k in heads], pa.int32()), pa.array(np.ones(len(heads), bool))], names)

    parted = texts.mapInArrow(spread, "doc_id long, text string, part int, ahead boolean")
    return parted.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("ahead", "doc_id", "text").select("doc_id", "text", "ahead")


def edit_fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter of
    code points is replaced by the start of the next document in id order.

    Null texts are empty; the edited text of an empty text is empty, and two
    empty texts are alike (1.0). Rows that repeat an id follow one another by
    text; null ids come first. A single row is its own successor; an empty table
    gives no rows. Other columns are not read.
    """
    texts = keyed_texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Permutations(PERMUTATIONS, SEED)
        held: tuple | None = None
        out: list[tuple] = []
        over = False
        for batch in batches:
            for key, text, ahead in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if over or (ahead and held is None):
                    continue
                over = ahead
                mark = fingerprint(text, hashes, width)
                if held is not None:
                    before, said, own = held
                    k = len(said) // 4
                    edited = said[: len(said) - k] + text[:k]
                    new = fingerprint(edited, hashes, width)
                    out.append(
                        (
                            before,
                            len(said),
                            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            own.tobytes().hex(),
                            new.tobytes().hex(),
                            likeness(own, new),
                            likeness(own, mark),
                        )
                    )
                held = key, text, mark
            if out:
                yield _rows(out)
                out = []

    return with_successor(texts, partitions(docs.sparkSession)).mapInArrow(tidied(run), SCHEMA)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
