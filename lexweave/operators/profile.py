"""Statistics of a glossary, in one pass per kind of count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text
from ..model import s_term

TAG = r"(?i)<[a-z1-6]+[ />]"
STYLE = r"(?is)<([a-z1-6]+)[^<>]* style="


def _tags(defi: Column) -> Column:
    return F.transform(F.regexp_extract_all(defi, F.lit(TAG), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, "[< />]", "")))


def with_format(df: DataFrame) -> DataFrame:
    return df.withColumn("_f", F.when(F.col("is_data"), "b").when(F.col("defi_format") != "m", F.col("defi_format")).otherwise(text.detect_format(F.col("defi"))))


def counts(df: DataFrame) -> DataFrame:
    """One row: entries (resources too), word links, terms that aren't in lower case, resources."""
    links = F.size(F.regexp_extract_all("defi", F.lit("bword://"), F.lit(0)))
    cased = F.size(F.filter("terms", lambda t: t != F.lower(t)))
    return df.agg(
        F.count("*").alias("word_count"), F.coalesce(F.sum(links), F.lit(0)).alias("bword_count"), F.coalesce(F.sum(cased), F.lit(0)).alias("non_lowercase_word_count"), F.count_if("is_data").alias("data_entry_count")
    )


def histogram(df: DataFrame, kind: str) -> DataFrame:
    """(value, n, first): counts of ``format``, ``tag``, ``first_tag``, ``style``, ``extension`` or ``script``, with the first place of each."""
    rows = with_format(df)
    at = F.struct("part", "seq")
    if kind == "format":
        rows = rows.filter("_f <> 'b'").select(F.col("_f").alias("value"), at.alias("at"))
    elif kind in ("tag", "first_tag"):
        tags = _tags(F.col("defi"))
        rows = rows.filter("_f = 'h'").select(at.alias("at"), F.posexplode(tags if kind == "tag" else F.slice(tags, 1, 1)).alias("k", "value")).select("value", F.struct("at", "k").alias("at"))
    elif kind == "style":
        rows = rows.select(at.alias("at"), F.posexplode(F.regexp_extract_all("defi", F.lit(STYLE), F.lit(1))).alias("k", "value")).select("value", F.struct("at", "k").alias("at"))
    elif kind == "extension":
        rows = rows.filter("is_data").select(F.regexp_extract("fname", r"\.([^./]*)$", 1).alias("value"), at.alias("at"))
    elif kind == "script":
        rows = rows.select(F.coalesce(html.script(s_term()), F.lit("None")).alias("value"), at.alias("at"))
    else:
        raise ValueError(kind)
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def profile(df: DataFrame) -> dict[str, object]:
    """The statistics as an ordered mapping; histograms are short lists of names."""
    out: dict[str, object] = counts(df).first().asDict()
    for key, kind in (("data_entry_extension_count", "extension"), ("defi_format", "format"), ("defi_tag", "tag"), ("defi_first_tag", "first_tag"), ("style", "style"), ("source_script", "script")):
        order = ["value"] if kind == "format" else [F.desc("n"), "first"]
        out[key] = ", ".join(f"{r['value']}={r['n']}" for r in histogram(df, kind).orderBy(*order).collect())
    return out


def format_share(df: DataFrame, sample: int = 100) -> DataFrame:
    """(defi_format, share) among the first ``sample`` entries."""
    head = with_format(df.filter("not is_data")).orderBy("part", "seq").limit(sample)
    total = head.agg(F.count("*").alias("t"))
    return head.groupBy(F.col("_f").alias("defi_format")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("defi_format", (F.col("n") / F.col("t")).alias("share"))
