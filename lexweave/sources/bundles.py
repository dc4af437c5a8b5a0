"""Dictionaries of several files: their files meet in one decoder call per dictionary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import ENTRY_COLUMNS, Glossary, info_table
from .base import _COLUMNS, _SCHEMA, BATCH, uncompressed


def _suffix(name: str) -> str:
    """ifo, idx, dict, syn, index: the extension without a compression one."""
    stem = name.rpartition("/")[2]
    for ext in (".gz", ".dz"):
        stem = stem.removesuffix(ext)
    return stem.rpartition(".")[2]


def decoded_bundle(spark: SparkSession, paths: list[str], decoder, by_suffix: bool = True) -> Glossary:
    files = spark.read.format("binaryFile").load(paths).select("path", "content", F.lit(0).alias("one"))

    def run(frames):
        got = {}
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                got[_suffix(name) if by_suffix else name.rpartition("/")[2]] = uncompressed(name, bytes(content))
        batch = []
        for n, row in enumerate(decoder(got) if got else ()):
            batch.append({"part": 0, "n": n, "is_data": False} | row)
            if len(batch) >= BATCH:
                yield _frame(batch)
                batch = []
        if batch:
            yield _frame(batch)

    rows = files.coalesce(1).mapInPandas(run, _SCHEMA).withColumn("seq", F.col("n"))
    meta = rows.filter("info_key is not null").select("seq", "info_key", "info_value").orderBy("seq").collect()
    entries = rows.filter("info_key is null").select(*ENTRY_COLUMNS)
    return Glossary(entries, info_table(spark, [(r["info_key"], r["info_value"]) for r in meta]))


def _frame(batch) -> pd.DataFrame:
    pdf = pd.DataFrame(batch).reindex(columns=_COLUMNS).astype(object)
    return pdf.where(pdf.notna(), None)


def existing(spark: SparkSession, candidates: list[str]) -> list[str]:
    found = []
    for c in candidates:
        p = spark._jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            found.append(c)
    return found


def read_stardict(spark: SparkSession, path: str) -> Glossary:
    from . import formats

    base = path.removesuffix(".ifo")
    return decoded_bundle(spark, existing(spark, [f"{base}.{x}" for x in ("ifo", "idx", "idx.gz", "dict", "dict.dz", "syn", "syn.dz")]), formats.stardict)


def read_dictd(spark: SparkSession, path: str) -> Glossary:
    from . import formats

    base = path.removesuffix(".index")
    return decoded_bundle(spark, existing(spark, [f"{base}.{x}" for x in ("index", "dict", "dict.dz")]), formats.dictd)


def read_wordnet(spark: SparkSession, path: str) -> Glossary:
    from . import formats

    return decoded_bundle(spark, [f"{path}/data.*"], formats.wordnet, by_suffix=False)


def read_dicformids(spark: SparkSession, path: str) -> Glossary:
    from . import formats

    return decoded_bundle(spark, [f"{path}/*.csv"], formats.dicformids, by_suffix=False)
