"""Keyed, range and full-text access paths: an index is a (key, element_id) table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.operators.scan import compare


def backfill(elements: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Index every element that has the property."""
    found = elements if label is None else elements.where(F.col("label") == label)
    return found.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("id").alias("element_id")).dropDuplicates()


def backfill_prefix(bag: DataFrame, prefix: str) -> DataFrame:
    """Index every value of a property map whose key starts with the prefix."""
    kept = F.map_filter("props", lambda k, _: F.startswith(k, F.lit(prefix)))
    return bag.select(F.col("id").alias("element_id"), F.explode(F.map_values(kept)).alias("v")).select(F.col("v.value").alias("key"), "element_id").dropDuplicates()


def lookup(index: DataFrame, op: str, literal) -> DataFrame:
    """Distinct element ids whose key compares."""
    return index.where(compare(F.col("key"), op, literal, index.schema["key"].dataType)).select("element_id").distinct()


def last_wins(writes: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """One element per key: that of the last write."""
    return writes.groupBy(F.col(key).alias("key")).agg(F.max_by(value, seq).alias("element_id"))


def between(index: DataFrame, low, high, include_low: bool = True, include_high: bool = True) -> DataFrame:
    """(key, element_id) in the range, an element once per key it stands under."""
    k = F.col("key")
    return index.where((k >= low if include_low else k > low) & (k <= high if include_high else k < high))


def remove_key(index: DataFrame, key) -> DataFrame:
    return index.where(~F.col("key").eqNullSafe(F.lit(key)))


def remove_element(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select(F.col("id").alias("__gone")), F.col("element_id") == F.col("__gone"), "left_anti")


def lexical_pattern(query: str) -> str:
    """White-space separated terms as a pattern that matches any of them literally."""
    return "|".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", t) for t in query.split())


def fulltext(index: DataFrame, pattern: str, highlight: bool = False, where: Column | None = None) -> DataFrame:
    """(element_id, score): case-blind matches in the element's best key; with
    ``highlight`` also the distinct matches with the words they stand in."""
    anywhere = F.concat(F.lit("(?i)"), F.lit(pattern))
    found = index if where is None else index.where(where)
    found = found.withColumn("score", F.regexp_count("key", anywhere)).where("score > 0")
    if not highlight:
        return found.groupBy("element_id").agg(F.max("score").cast("long").alias("score"))
    words = F.regexp_extract_all("key", F.lit(rf"(?i)(\w*(?:{pattern})\w*)"), F.lit(1))
    grouped = found.select("element_id", "score", F.explode(words).alias("word")).groupBy("element_id")
    return grouped.agg(F.max("score").cast("long").alias("score"), F.array_join(F.array_sort(F.collect_set("word")), "|").alias("highlights"))


def index_inventory(indices: dict[str, DataFrame]) -> DataFrame:
    """(name, keys, pairs) of several indices."""
    out = None
    for name, index in indices.items():
        row = index.agg(F.lit(name).alias("name"), F.count_distinct("key").alias("n_keys"), F.count("*").alias("n_pairs"))
        out = row if out is None else out.union(row)
    return out
