"""Comma-separated record lists: header row, quoted cells, doubled quotes, BOM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text or markdown files."""
    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value as text")
