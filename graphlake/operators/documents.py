"""Document graphs and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.operators.indices import lexical_pattern
from graphlake.operators.vectors import literal, similarity
from graphlake.sources.workspace import stored

RRF = 60
BROADCAST_KEYS = 500_000


def chunk_links(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contains, next): document to chunk, and chunk to the following chunk."""
    contains = chunks.select("doc_id", "chunk_no", F.lit("contains").alias("edge_type"))
    after = F.lead("chunk_no").over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    nexts = chunks.select("doc_id", "chunk_no", after.alias("next_no")).where("next_no is not null").withColumn("edge_type", F.lit("next"))
    return contains, nexts


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_windows(words: Column, width: int) -> Column:
    """Every run of ``width`` words as one string. ``words`` should be a column of
    its own: an expression would be computed anew for every run."""
    last = F.size(words) - width
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, width), " "))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))


def passages(docs: DataFrame, targets: DataFrame, width: int = 8, cap: int | None = None) -> DataFrame:
    """(doc_id, item_id): targets of which any run of ``width`` words, or the whole
    where they are shorter, stands in the document; of more than ``cap``, if given,
    the least ids. Up to ``BROADCAST_KEYS`` runs of the targets are sent to every
    executor, and no run of a document is shuffled; more are joined by a shuffle."""
    items = targets.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(width)).alias("n")).distinct().collect()]
    if not lengths:
        return docs.select("doc_id").join(targets.select("item_id").limit(0))
    runs = lambda n: token_windows(F.col("words"), n)
    own = F.when(F.size("words") < width, F.array(F.array_join("words", " "))).otherwise(runs(width))
    keys = stored(items.select("item_id", F.explode(F.array_distinct(own)).alias("key")), "keys")[0]
    small = keys.count() <= BROADCAST_KEYS
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    held = words.select("doc_id", F.explode(F.array_distinct(F.concat(*map(runs, lengths)))).alias("key"))
    found = held.join(F.broadcast(keys) if small else keys, "key").select("doc_id", "item_id").distinct()
    if cap is None:
        return found
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("item_id"))
    return found.withColumn("__r", rank).where(F.col("__r") <= cap).drop("__r")


def entities(chunks: DataFrame, label: str = "label", text: str = "entity") -> DataFrame:
    """(entity_key, doc_id, chunk_no): one row per entity and chunk; the key is the
    label and the trimmed lower-case text."""
    key = F.concat_ws("|", F.upper(F.col(label)), F.lower(F.trim(F.col(text))))
    return chunks.select(key.alias("entity_key"), "doc_id", "chunk_no").distinct()


def mention_counts(entity_rows: DataFrame, kind: str | None = None, contains: str | None = None, top: int = 200) -> DataFrame:
    """(entity_key, n) by count, then key."""
    name = F.split("entity_key", r"\|")
    found = entity_rows
    if kind:
        found = found.where(F.lower(name[0]) == kind.lower())
    if contains:
        found = found.where(F.contains(name[1], F.lit(contains.lower())))
    return found.groupBy("entity_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_key").limit(top)


def rank_list(scored: DataFrame, depth: int, score: str = "score", id_col: str = "doc_id", descending: bool = True) -> DataFrame:
    """(doc_id, rank) of the best ``depth``; the rows to rank are few by then."""
    order = [F.col(score).desc() if descending else F.col(score).asc(), F.col(id_col)]
    best = scored.orderBy(*order).limit(depth)
    return best.select(F.col(id_col).alias("doc_id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fuse(*lists: DataFrame, k: int = 10, constant: int = RRF) -> DataFrame:
    """(doc_id, score): reciprocal-rank fusion of (doc_id, rank) lists, the best k."""
    every = lists[0]
    for other in lists[1:]:
        every = every.unionByName(other)
    fused = every.groupBy("doc_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return fused.orderBy(F.desc("score"), "doc_id").limit(k)


def depth_for(k: int) -> int:
    return min(max(50, 4 * k), 1024)


def _ranked(hits: DataFrame, depth: int) -> DataFrame:
    """(doc_id, chunk_no, score, rank) of the best ``depth`` by score."""
    order = [F.desc("score"), F.col("doc_id"), F.col("chunk_no")]
    return hits.orderBy(*order).limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def search(chunks: DataFrame, text: str = "", vector: list[float] | None = None, mode: str = "fused", k: int = 10, where: Column | None = None) -> tuple[DataFrame, str]:
    """((doc_id, chunk_no, score), mode used) of the ``k`` best chunks.

    ``chunks`` is (doc_id, chunk_no, text, vector). 'lexical' counts the query's
    terms in the text, 'dense' takes the cosine, 'fused' sums reciprocal ranks of
    both. Where one side has nothing to search by (no text; no query vector, or no
    chunk with one) the other is used alone, and is named; with neither, no rows.
    """
    if not 1 <= k <= 100:
        raise ValueError("k must be 1 to 100")
    if mode not in ("fused", "dense", "lexical"):
        raise ValueError("mode must be fused, dense or lexical")
    found = chunks if where is None else chunks.where(where)
    has_text = bool(text.strip())
    has_vector = bool(vector) and any(vector) and found.where("vector is not null").limit(1).count() > 0
    used = mode if has_text and has_vector else "lexical" if has_text else "dense" if has_vector else "none"
    depth, sides = depth_for(k), []
    if used in ("lexical", "fused"):
        pattern = F.lit(f"(?i){lexical_pattern(text)}")
        sides.append(_ranked(found.select("doc_id", "chunk_no", F.regexp_count("text", pattern).cast("double").alias("score")).where("score > 0"), depth))
    if used in ("dense", "fused"):
        scored = found.select("doc_id", "chunk_no", similarity(F.col("vector"), literal(vector), "cosine").alias("score"))
        sides.append(_ranked(scored.where("score is not null and not isnan(score)"), depth))
    if not sides:
        return found.select("doc_id", "chunk_no", F.lit(0.0).alias("score")).limit(0), used
    if used != "fused":
        return sides[0].where(F.col("rank") <= k).drop("rank"), used
    both = sides[0].unionByName(sides[1]).groupBy("doc_id", "chunk_no").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"))
    return both.orderBy(F.desc("score"), "doc_id", "chunk_no").limit(k), used


def document_list(docs: DataFrame, chunks: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, preview, n_chunks, stale): 240 characters of the text, and whether a
    chunk lacks a vector or has one of another model. ``chunks`` has doc_id, vector
    and model."""
    stale = F.col("vector").isNull() | ~F.col("model").eqNullSafe(F.lit(model))
    counted = chunks.groupBy(F.col("doc_id").alias("__d")).agg(F.count("*").alias("n_chunks"), F.max(stale).alias("stale"))
    joined = docs.join(counted, F.col("doc_id") == F.col("__d"), "left")
    return joined.select("doc_id", F.substring("text", 1, 240).alias("preview"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("stale", F.lit(False)).alias("stale"))


def delete_documents(docs: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, chunks) without the documents of ``ids`` (doc_id) and their chunks."""
    gone = ids.select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti"), chunks.join(gone, "doc_id", "left_anti")


def group_by_document(hits: DataFrame) -> DataFrame:
    """(doc_id, score, n_chunks): a document scores as its best chunk."""
    return hits.groupBy("doc_id").agg(F.max("score").alias("score"), F.count("*").alias("n_chunks"))


def context(chunks: DataFrame, hits: DataFrame, window: int = 1) -> DataFrame:
    """(doc_id, chunk_no, at, text): the chunks within ``window`` of each hit."""
    if not 0 <= window <= 5:
        raise ValueError("window must be 0 to 5")
    near = hits.select(F.col("doc_id").alias("__d"), F.col("chunk_no").alias("hit"), F.explode(F.sequence(F.col("chunk_no") - window, F.col("chunk_no") + window)).alias("__c"))
    return chunks.join(near, (F.col("doc_id") == F.col("__d")) & (F.col("chunk_no") == F.col("__c"))).select("doc_id", "hit", "chunk_no", "text")
