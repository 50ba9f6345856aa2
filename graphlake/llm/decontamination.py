"""Benchmark decontamination by SimHash of item-sized windows; DataFrame functions only.

A window can only be similar to an item if it holds one of the item's word
shingles, so windows are laid where a document shares a shingle with an item,
aligned with it and as long as the item; where two alignments stand close, as
around an inserted or dropped word, also at every start between them. The most
similar window of a document is always one of these. Each window and item gets a 64-bit
SimHash of its shingles. Fingerprints within the radius agree in at least one of
radius + 1 blocks, so an equi-join on (size, block, value) finds all of them;
the shingle bags of the pairs within the radius are then compared exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.llm.common import keyed_texts, written

WIDTH = 5
THRESHOLD = 0.8
#: Bits in which similar windows may differ. At a similarity of 0.8 a bit differs
#: with probability 0.15; 24 of 64 is five standard deviations above the mean.
RADIUS = 24
#: Item shingles that are broadcast at most (24 bytes each); beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000

#: Shingles of a bag that the 16-bit lanes of :func:`simhash` can count; larger bags
#: are compared without a fingerprint.
LANE_LIMIT = 32_767

LANES = "1000100010001"  # hex: the lowest bit of each 16-bit lane


def words_of(text: Column) -> Column:
    """The words between white space; an empty array for a blank text."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def shingle_hashes(hashed: Column, width: int) -> Column:
    """Hash of each run of ``width`` words, from the array of word hashes."""
    run = lambda i: F.xxhash64(*(F.element_at(hashed, i + k) for k in range(1, width + 1)))
    some = F.size(hashed) >= width
    return F.when(some, F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashed) - width, F.lit(0))), run)).otherwise(F.array().cast("array<long>"))


def simhash(shingles: Column) -> Column:
    """64-bit SimHash of a bag of 64-bit hashes (fewer than 32,768): bit b is set
    where more than half of the hashes have it. Four counters share a long."""
    mask = F.lit(int(LANES, 16)).cast("long")

    def lane_sums(j: int) -> Column:
        return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(mask))

    sums = [lane_sums(j) for j in range(16)]
    bits = []
    for j in range(16):
        for lane in range(4):
            count = F.shiftrightunsigned(sums[j], 16 * lane).bitwiseAND(F.lit(0xFFFF).cast("long"))
            bits.append(F.when(count * 2 > F.size(shingles), F.shiftleft(F.lit(1).cast("long"), 16 * lane + j)).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def block(fingerprint: Column, k: int, radius: int) -> Column:
    """The k-th of radius + 1 blocks that cover 64 bits."""
    first, after = 64 * k // (radius + 1), 64 * (k + 1) // (radius + 1)
    return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << (after - first)) - 1).cast("long"))


def blocks(fingerprint: Column, radius: int) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("k"), block(fingerprint, k, radius).alias("value")) for k in range(radius + 1)))


def bag_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two bags: sum of lesser counts over sum of greater ones."""
    count = lambda bag, s: F.size(F.filter(bag, lambda x: x == s))
    both = F.array_intersect(a, b)
    once = lambda bag: F.size(F.array_distinct(bag)) == F.size(bag)
    repeated = F.aggregate(both, F.lit(0), lambda acc, s: acc + F.least(count(a, s), count(b, s)))
    common = F.when(once(a) | once(b), F.size(both)).otherwise(repeated)
    return common / (F.size(a) + F.size(b) - common)


def with_starts_between(places: DataFrame, threshold: float) -> DataFrame:
    """``places`` and the starts between two of a document that stand close: each
    word that two alignments are apart is a shingle that is not shared, and a
    similar window has few of those."""
    before = F.lag("start").over(Window.partitionBy("doc_id", "n", "width").orderBy("start"))
    close = F.col("start") - F.col("before") <= F.ceil(F.col("n") * ((1 - threshold) / (1 + threshold)))
    first = F.when(close, F.col("before") + 1).otherwise(F.col("start"))
    return places.withColumn("before", before).withColumn("start", F.explode(F.sequence(first, F.col("start")))).drop("before")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, start
    (first word of the most similar window, of equals the earliest that a shared
    shingle aligns), similarity.

    A shingle is five words, or the whole item where it has fewer. Null and blank
    texts and items hold nothing. Rows that repeat an id are searched each and
    give the best window of any; null ids are searched as one document. A
    document shorter than an item is one window. Empty tables give no rows;
    other columns are not read.
    """
    hashed = lambda c: F.transform(words_of(c), lambda w: F.xxhash64(w))
    listed = keyed_texts(items, item_col, item_text_col).select(F.col("doc_id").alias("item_id"), hashed(F.col("text")).alias("hashed"))
    listed = listed.withColumn("n", F.size("hashed")).where("n > 0").withColumn("width", F.least(F.col("n"), F.lit(WIDTH)))
    of_width = lambda source: reduce(
        lambda other, k: F.when(F.col("width") == k, shingle_hashes(F.col(source), k)).otherwise(other), range(1, WIDTH), shingle_hashes(F.col(source), WIDTH)
    )
    listed = listed.withColumn("bag", of_width("hashed"))
    listed = written(listed.select("item_id", "n", "width", "bag", simhash(F.col("bag")).alias("print")), "items")
    widths = [r[0] for r in listed.select("width").distinct().collect()]  # five at most

    marks = listed.select("n", "width", F.posexplode("bag").alias("q", "shingle")).distinct()
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    plain = keyed_texts(docs, id_col, text_col)
    texts = plain.withColumn("hashed", hashed(F.col("text")))

    def hits(width: int) -> DataFrame:
        at = texts.select("doc_id", F.size("hashed").alias("size"), F.posexplode(shingle_hashes(F.col("hashed"), width)).alias("p", "shingle"))
        own = at.join(marks.where(F.col("width") == width), "shingle")
        start = F.greatest(F.least(F.col("p") - F.col("q"), F.col("size") - F.col("n")), F.lit(0))
        return own.select("doc_id", start.alias("start"), "n", "width")

    none = texts.limit(0).select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("width"))
    places = with_starts_between(reduce(DataFrame.union, map(hits, widths), none).distinct(), threshold)
    places = written(places.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "width")).alias("places")), "places")

    # Only the documents with a place are split into words again.
    found = plain.join(places.withColumnRenamed("doc_id", "place_id"), F.expr("doc_id <=> place_id")).withColumn("hashed", hashed(F.col("text")))
    found = found.select("doc_id", "hashed", F.explode("places").alias("w")).select("doc_id", "w.*", F.slice("hashed", F.col("w.start") + 1, F.col("w.n")).alias("part"))
    bags = found.select("doc_id", "start", "n", of_width("part").alias("bag")).where(F.size("bag") > 0)
    windows = written(bags.select("doc_id", "start", "n", "bag", simhash(F.col("bag")).alias("print")), "windows")

    mine = windows.select("doc_id", "start", "n", "print").distinct().withColumn("b", F.explode(blocks(F.col("print"), radius)))
    mine = mine.select("doc_id", "start", "n", "print", "b.k", "b.value")
    theirs = listed.select("item_id", "n", F.col("print").alias("item_print"), F.explode(blocks(F.col("print"), radius)).alias("b"))
    theirs = theirs.select("item_id", "n", "item_print", "b.k", "b.value")
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    first = F.coalesce(*(F.when(block(apart, k, radius) == 0, F.lit(k)) for k in range(radius + 1)))
    near = mine.join(theirs, ["n", "k", "value"]).where((F.bit_count(apart) <= radius) & (F.col("k") == first)).select("doc_id", "start", "n", "item_id")
    # Bags that the fingerprint's counters cannot hold: each place is of an item of its length.
    long = F.size("bag") > LANE_LIMIT
    near = near.union(windows.where(long).select("doc_id", "start", "n").join(listed.where(long).select("item_id", "n"), "n").select("doc_id", "start", "n", "item_id")).distinct()

    same = [F.expr("w.doc_id <=> c.doc_id"), F.expr("w.start = c.start"), F.expr("w.n = c.n")]
    pairs = near.alias("c").join(windows.alias("w"), same).join(listed.alias("i"), F.expr("c.item_id <=> i.item_id"))
    scored = pairs.select("c.doc_id", "c.item_id", "c.start", bag_similarity(F.col("w.bag"), F.col("i.bag")).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    kept = scored.where(F.col("similarity") >= threshold).groupBy("doc_id", "item_id").agg(best)
    return kept.select("doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item. A row is told by id and
    text, so another text of the same id is judged on its own."""
    mark = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    own = docs.select(mark.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    dirty = contamination(own, items, threshold).select(F.col("doc_id").alias("__dirty")).distinct()
    return docs.withColumn("__mark", mark).join(dirty, F.col("__mark") == F.col("__dirty"), "left_anti").drop("__mark")
