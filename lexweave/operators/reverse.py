"""Reverse lookup: which entries explain a word, by relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[\p{L}\p{N}_]"


def vocabulary(df: DataFrame, least: int = 3) -> DataFrame:
    """(word): distinct words of all definitions."""
    return df.select(F.explode(F.regexp_extract_all("defi", F.lit(f"{WORD}{{{least},}}"), F.lit(0))).alias("word")).distinct()


def relevance(df: DataFrame, least: int = 3, separators: str = ".,،") -> DataFrame:
    """(word, part, seq, terms, rel): for each word of a definition the largest share that it has of the words of a sentence part.

    Words are counted where they stand, so there is no product of vocabulary
    and entries, and the work grows with the length of a definition: entries
    are dealt out once, counts per sentence part and maxima stay in place.
    """
    entries = df.filter("not is_data").select("part", "seq", "terms", "defi").repartition("part", "seq")
    parts = entries.select("part", "seq", F.posexplode(F.split("defi", "[" + separators + "]")).alias("_i", "_p"))
    words = parts.select("part", "seq", "_i", F.regexp_extract_all("_p", F.lit(f"{WORD}{{{least},}}"), F.lit(0)).alias("_w"))
    each = words.select("part", "seq", "_i", F.size("_w").alias("_n"), F.explode("_w").alias("word"))
    counted = each.groupBy("part", "seq", "_i", "_n", "word").agg(F.count("*").alias("_c"))
    best = counted.groupBy("part", "seq", "word").agg(F.max(F.col("_c") / F.col("_n")).alias("rel"))
    return best.join(entries.select("part", "seq", "terms"), ["part", "seq"]).select("part", "seq", "terms", "word", "rel")


def label(term: Column, rel: Column, show: str = "Percent", before: Column | None = None) -> Column:
    shown = F.concat(term, F.lit("(%"), (100 * rel).cast("string"), F.lit(")"))
    out = F.when(rel > 0.5, term)
    if show == "Percent":
        return out.otherwise(shown)
    if show == "Percent At First":
        return out.when(before.eqNullSafe(rel), term).otherwise(shown)
    return term


def reverse(df: DataFrame, most: int = 100, least_relevance: float = 0.0, least: int = 3, show: str = "Percent") -> DataFrame:
    """(word, labels): for every word the terms that it explains, best first, at most ``most`` (0: all)."""
    rows = relevance(df, least).filter(F.col("rel") > least_relevance).select("word", "rel", "part", "seq", F.posexplode("terms").alias("at", "term"))
    best = Window.partitionBy("word").orderBy(F.desc("rel"), "part", "seq", "at")
    rows = rows.withColumn("_r", F.row_number().over(best)).withColumn("_before", F.lag("rel").over(best))
    if most > 0:
        rows = rows.filter(F.col("_r") <= most)
    labels = rows.withColumn("label", label(F.col("term"), F.col("rel"), show, F.col("_before")))
    return labels.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "label"))), lambda x: x["label"]), ", ").alias("labels"))


def containing(df: DataFrame, words: DataFrame, size: int = 3) -> DataFrame:
    """(word, seq): entries whose definition contains a word as a substring.

    Candidates share the word's first ``size`` characters, so this is an equi
    join and not a product; what is joined are numbers and grams, texts only
    meet candidates for the check.
    """
    longer = words.filter(F.length("word") >= size).withColumn("_g", F.substring("word", 1, size))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("defi") - (size - 1), F.lit(1))), lambda i: F.substring(F.col("defi"), i, F.lit(size))))
    have = df.filter("not is_data")
    met = have.select("seq", F.explode(grams).alias("_g")).join(longer, "_g").select("seq", "word").distinct()
    return met.join(have.select("seq", "defi"), "seq").filter(F.col("defi").contains(F.col("word"))).select("word", "seq").distinct()
