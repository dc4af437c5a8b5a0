"""The canonical entries table and its metadata.

Every reader yields entries: ``seq`` (order is data, so it is a column),
``part``, ``terms`` (headword first), ``defi`` with a one-letter
``defi_format`` (m plain, h HTML, x XDXF, b binary), and resources as rows with
``is_data``, a file name and bytes.  Metadata is a small ordered table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_SCHEMA = "seq long, part int, terms array<string>, defi string, defi_format string, is_data boolean, fname string, data binary"
INFO_SCHEMA = "pos int, key string, value string"
ENTRY_COLUMNS = ("seq", "part", "terms", "defi", "defi_format", "is_data", "fname", "data")
FORMATS = ("m", "h", "x", "b")

# Metadata keys with other names for the same thing, in lower case.
INFO_ALIASES = {"title": "name", "bookname": "name", "dbname": "name", "sourcelang": "sourceLang", "inputlang": "sourceLang", "origlang": "sourceLang",
                "targetlang": "targetLang", "outputlang": "targetLang", "destlang": "targetLang", "license": "copyright", "date": "creationTime"}


@dataclass
class Glossary:
    """Entries with their metadata."""

    entries: DataFrame
    info: DataFrame

    def transform(self, f, *args, **kwargs) -> Glossary:
        return Glossary(f(self.entries, *args, **kwargs), self.info)


def s_term(terms: Column | str = "terms") -> Column:
    """The entry key: a single term as it is, several bar-joined with escapes."""
    terms = F.col(terms) if isinstance(terms, str) else terms
    escaped = F.transform(terms, lambda t: F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")))
    return F.when(F.size(terms) == 1, F.element_at(terms, 1)).otherwise(F.array_join(escaped, "|"))


def headword() -> Column:
    return F.get(F.col("terms"), F.lit(0))


def alternates() -> Column:
    return F.slice("terms", 2, F.greatest(F.size("terms"), F.lit(1)))


def entries(df: DataFrame, seq, terms: Column, defi: Column, defi_format: str | Column = "m") -> DataFrame:
    """Entries from any table: ``seq`` orders them, ``terms`` is an array."""
    kind = F.lit(defi_format) if isinstance(defi_format, str) else defi_format
    return df.select(
        (F.col(seq) if isinstance(seq, str) else seq).cast("long").alias("seq"), F.lit(0).alias("part"), terms.alias("terms"), defi.alias("defi"),
        kind.alias("defi_format"), F.lit(False).alias("is_data"), F.lit(None).cast("string").alias("fname"), F.lit(None).cast("binary").alias("data"),
    )


def info_table(spark: SparkSession, pairs: dict[str, str] | list[tuple[str, str]]) -> DataFrame:
    """Metadata in order; aliases become their canonical key, and a later value replaces an earlier one in its place."""
    merged: dict[str, str] = {}
    for key, value in pairs.items() if isinstance(pairs, dict) else pairs:
        merged[INFO_ALIASES.get(key.lower(), key)] = value
    return spark.createDataFrame([(k, key, value) for k, (key, value) in enumerate(merged.items())], INFO_SCHEMA)


def info_dict(info: DataFrame) -> dict[str, str]:
    """Metadata is a handful of rows."""
    return {r["key"]: r["value"] for r in info.orderBy("pos").collect()}
