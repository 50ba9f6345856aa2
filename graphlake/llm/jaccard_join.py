"""N-gram Jaccard join: every pair of texts whose word-shingle sets overlap enough.

Equal texts form a class first, and only class representatives are compared.
Band and row counts follow from the target recall. Band hashes are shuffled on
their own (16 bytes a band); buckets with the same members are kept once. The
shingle sets of the bucket members then meet in blocks of bounded size, where
each pair is verified exactly and counted in the first bucket it shares. What
leaves a block is one row per member, never its pairs, so a group of n near
copies costs n rows and not n squared.

A class is told by the least of its rows: (rep, mark), the document id, or for
classes of rows without an id a hash of the text, and a hash of the text. So
rows without an id are compared like any other, and one id may have many texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import discard, keyed_texts, stored, tidied, written
from graphlake.llm.minhash import Permutations, band_hashes, bands_for, shingles
from graphlake.operators.components import connected_components

ROWS = 6
RECALL = 0.9999
#: Members and bytes of shingles of one block, on average; a task holds two blocks.
BLOCK = 128
BLOCK_BYTES = 32 << 20
CLASS = ["rep", "mark"]


@dataclass(frozen=True)
class Banding:
    """Which signature is cut into bands: ``bands`` of ``rows`` values of ``bits`` bits."""

    bands: int
    rows: int
    seed: int = 1
    bits: int = 32

    @classmethod
    def for_recall(cls, threshold: float, rows: int = ROWS, recall: float = RECALL) -> Banding:
        return cls(bands_for(threshold, rows, recall), rows)


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs of a left and a right set with Jaccard >= threshold:
    the left sets are looked up one by one in an inverted index of the right."""
    sizes = np.array([len(s) for s in sets])
    known, place = np.unique(np.concatenate([sets[j] for j in right]), return_inverse=True)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(known) + 1))
    owner = np.repeat(np.arange(len(right)), sizes[right])[order]
    out_i, out_j = [], []
    for i in left:
        at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
        at = at[known[at] == sets[i]]
        spans = starts[at + 1] - starts[at]
        within = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        common = np.bincount(owner[np.repeat(starts[at], spans) + within], minlength=len(right))
        good = np.flatnonzero((common > 0) & (common >= threshold * (sizes[i] + sizes[right] - common) - 1e-9))
        out_i.append(np.full(len(good), i))
        out_j.append(right[good])
    return np.concatenate(out_i), np.concatenate(out_j)


def _roots(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def digest(text: str) -> tuple[int, int]:
    """128 bits of a text's word sequence, as two signed numbers."""
    raw = xxhash.xxh3_128_digest(" ".join(text.split()).encode("utf-8", "surrogatepass"))
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def signatures(texts: DataFrame, width: int, banding: Banding) -> DataFrame:
    """One row per input row: doc_id, mark (hash of the text), k1, k2
    (:func:`digest`), its number of shingles and its band hashes (null without a
    word)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Permutations(banding.bands * banding.rows, banding.seed)
        low = np.uint32((1 << banding.bits) - 1)
        for batch in batches:
            marks, sizes, signs = [], [], []
            for text in batch.column(2).to_pylist():
                marks.append(digest(text))
                sh = shingles(text, width)
                sizes.append(len(sh))
                signs.append(band_hashes(hashes.signature(sh) & low, banding.rows).tobytes() if len(sh) else None)
            k1, k2 = ([m[k] for m in marks] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (k1, k2, sizes)), pa.array(signs, pa.binary())],
                ["doc_id", "mark", "k1", "k2", "size", "bands"],
            )

    rows = texts.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(tidied(sign), "doc_id long, mark long, k1 long, k2 long, size long, bands binary")


def _exploded(reps: DataFrame) -> DataFrame:
    """One row per representative and band."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = [np.frombuffer(b, "<i8") for b in batch.column(3).to_pylist()]
            if bands:
                per = len(bands[0])
                keys = [np.repeat(batch.column(k).to_numpy(zero_copy_only=False), per) for k in (0, 1, 2)]
                band = np.tile(np.arange(per, dtype=np.int32), len(bands))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, band, np.concatenate(bands))], [*CLASS, "size", "band", "bucket"])

    return reps.select(*CLASS, "size", "bands").mapInArrow(explode, "rep long, mark long, size long, band int, bucket long")


def _at(doc_id: str = "doc_id", mark: str = "mark") -> Column:
    """What stands for a row's id: the id, or the text's hash."""
    return F.coalesce(doc_id, mark)


def verified(texts: DataFrame, threshold: float, width: int, banding: Banding | None = None, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(members, found): members has doc_id and text_mark of every row, the class
    (rep, mark) it is in, and class_id, the least id in the class; found has, for a
    class and a block it was compared in, its links there and the ``root``, the
    least class of those it hangs together with in that block."""
    spark = texts.sparkSession
    signed, p1 = stored(signatures(texts, width, banding or Banding.for_recall(threshold)), "signed")
    # As a table of its own, so that the join can split a text that many rows have.
    least = F.min(F.struct(F.isnull("doc_id").alias("anonymous"), _at().alias("rep"), "mark")).alias("least")
    named, p2 = stored(signed.groupBy("k1", "k2").agg(least).select("k1", "k2", "least.*"), "classes")
    joined = signed.withColumnRenamed("mark", "text_mark").join(named, ["k1", "k2"])
    own = F.expr("rep = coalesce(doc_id, text_mark) and mark = text_mark and anonymous = (doc_id is null)")
    members, _ = stored(
        joined.select("doc_id", "text_mark", *CLASS, F.when(~F.col("anonymous"), F.col("rep")).alias("class_id"), "size", F.when(own, F.col("bands")).alias("bands")),
        "members",
    )
    reps = members.where("bands is not null").groupBy(*CLASS).agg(F.first("bands").alias("bands"), F.first("size").alias("size"))
    bands, p3 = stored(_exploded(reps), "bands")
    # A bucket's members are told by their count, the least one and two xors of hashes.
    told = ["n", "lead", "x1", "x2"]
    buckets = (
        bands.groupBy("bucket")
        .agg(
            F.count("*").alias("n"),
            F.sum("size").alias("sizes"),
            F.min("rep").alias("lead"),
            *(F.expr(f"bit_xor(xxhash64(rep, mark, {i}))").alias(f"x{i}") for i in (1, 2)),
        )
        .where("n > 1")
    )
    same = buckets.groupBy(told).agg(F.min("bucket").alias("unit"))
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(block), F.col("sizes") * 8 / F.lit(block_bytes))).cast("int")
    buckets = buckets.join(same, told).select("bucket", "unit", blocks.alias("blocks"))
    shared, p4 = stored(bands.join(buckets, "bucket").select(*CLASS, "band", "unit", "blocks"), "shared")

    own = shared.groupBy(*CLASS).agg(F.collect_list(F.struct("band", "unit")).alias("own"))
    needed = own.select(F.col("rep").alias("at"), "mark", F.col("own.band").alias("own_band"), F.col("own.unit").alias("own_unit"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # rows that repeat an id and a text give one set
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            first = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            kept = batch.take(pa.array(first, pa.int64()))
            sets = [shingles(t, width).tobytes() for t in kept.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array(sets, pa.binary()), kept.column(3), kept.column(4)],
                [*CLASS, "shingles", "own_band", "own_unit"],
            )

    keyed = texts.withColumn("mark", F.xxhash64("text")).withColumn("at", _at())
    sets = (
        keyed.join(needed, ["at", "mark"])
        .select("at", "mark", "text", "own_band", "own_unit")
        .mapInArrow(tidied(to_sets), "rep long, mark long, shingles binary, own_band array<int>, own_unit array<long>")
    )
    units = (
        shared.select(*CLASS, "unit", "blocks")
        .distinct()
        .withColumn("mine", F.pmod(F.xxhash64(*CLASS, "unit"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*CLASS, "unit", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        unit, bi, bj = key
        rows = rows.drop_duplicates(CLASS).sort_values(CLASS).reset_index(drop=True)
        reps, marks = (rows[c].to_numpy() for c in CLASS)
        mine = rows["mine"].to_numpy()
        left, right = np.flatnonzero(mine == bi), np.flatnonzero(mine == bj)
        if not len(left) or not len(right):
            return pd.DataFrame({c: reps[:0] for c in (*CLASS, "links", "root_rep", "root_mark")})
        a, b = _overlaps([np.frombuffer(s, np.uint64) for s in rows["shingles"]], left, right, threshold)
        if bi == bj:
            a, b = a[a < b], b[a < b]
        own = np.zeros((len(reps), 1 + max(max(x) for x in rows["own_band"])), np.int64)
        has = np.zeros(own.shape, bool)
        for r, (band, of) in enumerate(zip(rows["own_band"], rows["own_unit"])):
            own[r, band], has[r, band] = of, True
        both = (own[a] == own[b]) & has[a] & has[b]
        here = own[a, both.argmax(axis=1)] == unit
        a, b = a[here], b[here]
        links = np.bincount(np.concatenate([a, b]), minlength=len(reps))
        roots = np.array(_roots(len(reps), zip(a.tolist(), b.tolist())))
        hit = links > 0
        columns = {"rep": reps[hit], "mark": marks[hit], "links": links[hit], "root_rep": reps[roots[hit]], "root_mark": marks[roots[hit]]}
        return pd.DataFrame(columns)

    found = units.join(sets, CLASS).groupBy("unit", "i", "j").applyInPandas(verify, "rep long, mark long, links long, root_rep long, root_mark long")
    links = written(found, "links")
    discard(spark, p1, p2, p3, p4)
    return members.drop("bands", "size"), links


def grouped(members: DataFrame, found: DataFrame) -> DataFrame:
    """The classes that hang together by links: (rep, mark, group_rep, group_mark,
    group_id); group_id is the least document id among them, null without any."""
    ends = found.select(F.struct(*CLASS).alias("src"), F.struct(F.col("root_rep").alias("rep"), F.col("root_mark").alias("mark")).alias("dst"))
    parts = connected_components(ends).select("id.*", F.col("component.rep").alias("group_rep"), F.col("component.mark").alias("group_mark"))
    # One row a class before the join, so that a class of many rows is not dealt to one task.
    classes = written(members.select(*CLASS, "class_id").distinct().join(parts, CLASS), "grouped")
    # A table of its own, so that a group of many classes is split.
    leads = written(classes.groupBy("group_rep", "group_mark").agg(F.min("class_id").alias("group_id")), "leads")
    return written(classes.drop("class_id").join(leads, ["group_rep", "group_mark"]), "groups")


def jaccard_join(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", banding: Banding | None = None
) -> DataFrame:
    """One row per input row: doc_id, class_id, text_id, n_links.

    text_id is the least id among the documents with the same word sequence;
    n_links counts the other word sequences whose shingle sets have a Jaccard of
    ``threshold`` or more with this one's. class_id is the least id among all that
    equal texts and links join, directly or through others. Texts without a word
    (null, empty, white space) form one class without links. Repeated rows are one
    text; an id with several texts has a row for each. A row without an id is
    compared like any other; where no document of its text or class has an id,
    text_id or class_id is null. An empty table gives no rows; other columns are
    not read.
    """
    members, found = verified(keyed_texts(docs, id_col, text_col), threshold, width, banding)
    groups = grouped(members, found).select(*CLASS, "group_id")
    # A table too, so that this join can split a class that many rows have.
    told = written(found.groupBy(*CLASS).agg(F.sum("links").alias("n_links")).join(groups, CLASS), "link-counts")
    return members.join(told, CLASS, "left").select(
        "doc_id",
        F.when(F.isnull("n_links"), F.col("class_id")).otherwise(F.col("group_id")).alias("class_id"),
        F.col("class_id").alias("text_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def near_groups(docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id): documents joined by equal texts or links, directly or
    through others; group_id is the least id in the group."""
    return jaccard_join(docs, threshold, width, id_col, text_col).select("doc_id", F.col("class_id").alias("group_id"))


def one_of_each_group(docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each group of
    texts that links join, the row with the least id stays, once (of equal ids that
    of the least text hash; a row without an id only where none has one). A row is
    told by id and text, so another text of the same id is judged on its own."""
    members, found = verified(keyed_texts(docs, id_col, text_col), threshold, width)
    groups = grouped(members, found)
    group = [F.coalesce("group_rep", "rep").alias("group_rep"), F.coalesce("group_mark", "mark").alias("group_mark")]
    rows = members.join(groups, CLASS, "left").select(*group, F.isnull("doc_id").alias("anonymous"), _at("doc_id", "text_mark").alias("at"), "text_mark").distinct()
    rows = written(rows, "rows")
    keeper = F.min(F.struct("anonymous", "at", "text_mark")).alias("keeper")
    keepers = written(rows.groupBy("group_rep", "group_mark").agg(keeper), "keepers")
    lost = rows.join(keepers, ["group_rep", "group_mark"]).where(F.struct("anonymous", "at", "text_mark") != F.col("keeper"))
    losers = written(lost.select(F.col("anonymous").alias("__anonymous"), F.col("at").alias("__at"), F.col("text_mark").alias("__lost")), "losers")
    key = F.col(f"`{id_col}`").cast("long")
    mark = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    told = docs.withColumn("__mark", mark).withColumn("__id", F.coalesce(key, F.col("__mark"))).withColumn("__none", F.isnull(key))
    kept = told.join(losers, [F.col("__none") == F.col("__anonymous"), F.col("__id") == F.col("__at"), F.col("__mark") == F.col("__lost")], "left_anti")
    return kept.dropDuplicates(["__none", "__id", "__mark"]).select(*(F.col(f"`{c}`") for c in docs.columns))
