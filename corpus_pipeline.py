"""Corpus cleaning pipeline over ``documents``.

Five stages, each a numbered operator of ``graphlake.llm``; what a stage returns
is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import written
from graphlake.llm.decontamination import decontaminate
from graphlake.llm.jaccard_join import one_of_each_group
from graphlake.llm.line_dedup import without_shared_lines
from graphlake.llm.packing import pack_documents
from graphlake.llm.queries import word_bpe
from graphlake.llm.toxicity import fit, labelled_sample, without_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression calls toxic go."""
    return without_toxic(docs, fit(*labelled_sample(docs, _table(spark, sf_dir, "labels"), "toxic", rows=5000)))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in five documents or more stay in the last
    one only; n_chars follows the text."""
    kept = without_shared_lines(docs, min_chars=40, min_docs=5)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each_group(docs, threshold=0.8, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"), threshold=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left."""
    return pack_documents(docs, word_bpe(), end_id=2, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages hold a fitted model and exact tokenizer ids, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
