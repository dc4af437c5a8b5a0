"""How readers make entries: native line scans, or a decoder per file in the executors."""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ENTRY_COLUMNS, INFO_SCHEMA, Glossary, info_table

#: What a decoder yields: an entry or a metadata pair.
Row = dict
BATCH = 2000


def entry(terms, defi: str, kind: str = "m") -> Row:
    return {"terms": [terms] if isinstance(terms, str) else list(terms), "defi": defi, "defi_format": kind}


def resource(name: str, data: bytes) -> Row:
    return {"terms": [name], "defi": f"File: {name}", "defi_format": "b", "is_data": True, "fname": name, "data": data}


def info(key: str, value: str) -> Row:
    return {"info_key": key, "info_value": value}


def uncompressed(name: str, content: bytes) -> bytes:
    ext = name.rpartition(".")[2].lower()
    if ext in ("gz", "dz"):
        return gzip.decompress(content)
    if ext == "bz2":
        return bz2.decompress(content)
    return lzma.decompress(content) if ext in ("lzma", "xz") else content


def decode_text(content: bytes, encoding: str = "utf-8") -> str:
    if encoding == "utf-8":
        for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if content.startswith(mark):
                return content.decode(name)
    return content.decode(encoding, "replace").lstrip("﻿")


_SCHEMA = "part int, n long, terms array<string>, defi string, defi_format string, is_data boolean, fname string, data binary, info_key string, info_value string"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def decoded(spark: SparkSession, path: str | list[str], decoder: Callable[..., Iterator[Row]], glob: str | None = None, order: Callable[[str], object] | None = None, **options) -> Glossary:
    """Every file under ``path`` through ``decoder(name, bytes, **options)``; files are decoded in parallel.

    Files are ordered by path or by ``order`` of it, rows by their place in the file.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                batch: list[Row] = []
                for n, row in enumerate(decoder(name, uncompressed(name, content), **options)):
                    batch.append({"n": n, "is_data": False} | row | {"_path": name})
                    if len(batch) >= BATCH:
                        yield pd.DataFrame(batch).reindex(columns=["_path", *_COLUMNS[1:]]).astype(object)
                        batch = []
                if batch:
                    yield pd.DataFrame(batch).reindex(columns=["_path", *_COLUMNS[1:]]).astype(object)

    def clean(frames):
        for pdf in run(frames):
            yield pdf.where(pdf.notna(), None)

    rows = files.mapInPandas(clean, "_path string, " + _SCHEMA.split(", ", 1)[1])
    paths = sorted((r["path"] for r in files.select("path").collect()), key=order or str)  # names only
    if len(paths) > 1:
        rows = rows.join(spark.createDataFrame(list(enumerate(paths)), "part int, _path string"), "_path")
    else:
        rows = rows.withColumn("part", F.lit(0))
    rows = rows.withColumn("seq", F.col("n"))
    meta = rows.filter("info_key is not null").select("part", "seq", "info_key", "info_value").orderBy("part", "seq").collect()  # a header's size
    return Glossary(rows.filter("info_key is null").select(*ENTRY_COLUMNS), info_table(spark, [(r["info_key"], r["info_value"]) for r in meta]))


def numbered_lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(seq, value): lines of one file, in order, read in splits.

    A line's number is its split's first byte plus its number in the task: it
    grows through the file and needs no shuffle.
    """
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    rows = reader.text(path)
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(place.alias("seq"), "value")


def as_entries(df: DataFrame) -> DataFrame:
    """Fill the columns that a reader left out."""
    defaults = {"part": F.lit(0), "defi_format": F.lit("m"), "is_data": F.lit(False), "fname": F.lit(None).cast("string"), "data": F.lit(None).cast("binary")}
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns}).select(*ENTRY_COLUMNS)


def no_info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INFO_SCHEMA)


def header_rows(rows: DataFrame, is_header) -> tuple[DataFrame, DataFrame]:
    """(header, body): the leading rows that ``is_header`` fits, and the rest from the first other row on."""
    first = rows.filter(~is_header).agg(F.min("seq").alias("_first"))
    marked = rows.crossJoin(F.broadcast(first))  # one row
    before = F.col("_first").isNull() | (F.col("seq") < F.col("_first"))
    return marked.filter(before).drop("_first"), marked.filter(~before).drop("_first")
