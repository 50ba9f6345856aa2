"""Text functions: identifiers, chunks, canonical forms, literals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an identifier, and its least length.
IDENTIFIERS = [
    (r"\b[A-Z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+\b", 4),
    (r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b", 6),
    (r"\b0x[0-9A-Fa-f]{2,}\b", 4),
]


def identifiers(text: Column, cap: int = 64) -> Column:
    """Distinct identifiers of a text: the first ``cap`` by where they match, then
    sorted. An Arrow function, since Spark's own do not tell where a match stands."""
    patterns = [(re.compile(p), least) for p, least in IDENTIFIERS]

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            placed = sorted((m.start(), m[0]) for p, least in patterns for m in p.finditer(t or "") if len(m[0]) >= least)
            out.append(sorted(list(dict.fromkeys(x for _, x in placed))[:cap]))
        return pd.Series(out)

    return found(text)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def preview(text: Column, n: int = 240) -> Column:
    return F.substring(text, 1, n)


# Canonical forms of identifying values.
CANONICAL = {
    "lowerHexStripSeparators": lambda c: F.regexp_replace(F.lower(c), "[^0-9a-f]", ""),
    "trimUpper": lambda c: F.upper(F.trim(c)),
    "trimLower": lambda c: F.lower(F.trim(c)),
    "digitsOnly": lambda c: F.regexp_replace(c, "[^0-9]", ""),
}


def canonical(value: Column, form: str) -> Column:
    return CANONICAL[form](value)


# Literal type names and the Spark types that hold them.
LITERAL_TYPES = {
    "string": "string", "char": "string", "guid": "string", "bool": "boolean", "sbyte": "tinyint", "byte": "smallint", "short": "smallint",
    "ushort": "int", "int": "int", "uint": "bigint", "long": "bigint", "ulong": "decimal(20,0)", "float": "float", "double": "double",
    "decimal": "decimal(38,18)", "datetime": "timestamp", "datetimeoffset": "timestamp", "timespan": "interval day to second",
}


def literal(value: Column, kind: str) -> Column:
    """The text as that type; null if it is not one."""
    spark_type = LITERAL_TYPES[kind.lower()]
    return value if spark_type == "string" else value.try_cast(spark_type)


def to_stamp(moment: Column) -> Column:
    """Whole seconds since 1970, as elements keep their creation; null below 0."""
    seconds = F.unix_seconds(moment.cast("timestamp"))
    return F.when(seconds >= 0, seconds)


def from_stamp(stamp: Column) -> Column:
    return F.timestamp_seconds(stamp)


def modification_delta(created: Column, modified: Column) -> Column:
    """Seconds from an element's creation stamp to its modification; null if before it."""
    delta = to_stamp(modified) - created
    return F.when(delta >= 0, delta)
