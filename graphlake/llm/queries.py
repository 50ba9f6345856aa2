"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.token_output import token_output

    return token_output(_table(spark, sf_dir, "documents"), word_bpe(), end_id=1)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), word_bpe(), end_id=2, capacity=4096)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.html_extraction import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.fingerprints import edit_fingerprints

    return edit_fingerprints(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.line_dedup import dedup_lines

    kept = dedup_lines(_table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
),
shared AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (SELECT l.*, s.key IS NOT NULL AND l.doc_id <> s.last_doc AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_output,
        op2_quality,
        op3_packing,
        op4_html_extraction,
        op5_ngram_jaccard_join,
        op6_document_fingerprints,
        op7_line_dedup,
        op8_license_scan,
        op9_decontamination,
        op10_toxicity,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from graphlake.llm import licenses

    return {"op7_line_dedup": OP7_SQL, "op8_license_scan": licenses.oracle_sql()}
