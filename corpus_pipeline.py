"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontaminate, line_dedup, packing, quality_classifier, simhash
from lexweave.llm.common import stored, table
from lexweave.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts.

    Null and empty texts get no accusation and stay; repeated rows get equal
    results; without labels the seed lists decide; an empty table stays empty.
    """
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses lines goes with them if nothing but white space is left.

    Null, empty and blank texts stay as they are; repeated rows get equal
    results; n_chars follows the text; an empty table stays empty.
    """
    out, removed = line_dedup.dedup(docs), line_dedup.report_names(docs)[0]
    out = out.filter((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    columns = [F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: the smallest doc_id, once.

    Texts without words and rows without a doc_id all stay; an empty table
    stays empty.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows get equal results; without
    a benchmark all stay; an empty table stays empty.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences.

    Null and empty texts are one end token; repeated rows and null ids are
    packed like others; an empty table gives no rows.
    """
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]

#: The classifier, SVD and tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
