"""Entry filters: a fixed order of rules, each a DataFrame transform.

A rule is on by default, by its configuration key, or because a sink asks for
it.  Rules that sinks ask for hold in every mode here.  Resources pass most
filters unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html, text
from ..model import headword, s_term


def _edit(df: DataFrame, terms: Column | None = None, defi: Column | None = None) -> DataFrame:
    new = {}
    if terms is not None:
        new["terms"] = F.when(F.col("is_data"), F.col("terms")).otherwise(terms)
    if defi is not None:
        new["defi"] = F.when(F.col("is_data"), F.col("defi")).otherwise(defi)
    return df.withColumns(new)


def _terms(f) -> Column:
    return F.transform("terms", f)


def trim_whitespaces(df: DataFrame, _=None) -> DataFrame:
    def clean(c: Column) -> Column:
        return text.sub(text.strip(c), "\r", "")

    defi = text.sub(F.regexp_replace(text.strip(F.col("defi")), "(?:<BR>|<br>)+$", ""), "\r", "")
    return _edit(df, _terms(clean), defi)


def non_empty_term(df: DataFrame, _=None) -> DataFrame:
    return df.filter(F.col("is_data") | (s_term() != ""))


def non_empty_defi(df: DataFrame, _=None) -> DataFrame:
    return df.filter(F.col("is_data") | (F.col("defi") != ""))


def skip_resources(df: DataFrame, _=None) -> DataFrame:
    return df.filter(~F.col("is_data"))


def utf8_check(df: DataFrame, _=None) -> DataFrame:
    return _edit(df, _terms(lambda t: text.sub(t, "\0", "")), text.sub(F.col("defi"), "\0", ""))


def lower(df: DataFrame, _=None) -> DataFrame:
    return _edit(df, _terms(F.lower), html.lower_links(F.col("defi")))


def skip_duplicate_headword(df: DataFrame, _=None) -> DataFrame:
    """The first entry of each headword; resources take part."""
    # One small row per headword is found with partial aggregation, so a headword that a third of all rows has is no hot task.
    first = df.groupBy(headword().alias("_head")).agg(F.min(F.struct("part", "seq")).alias("_f")).select("_f.part", "_f.seq")
    return df.join(first, ["part", "seq"], "left_semi").select(*df.columns)


def skip_term_regex(df: DataFrame, pattern: str) -> DataFrame:
    """Drop entries with a term that the pattern matches from its start; only a last alternative is held to the end."""
    re.compile(pattern)
    return df.filter(F.col("is_data") | ~F.exists("terms", lambda t: t.rlike(f"\\A(?:{pattern}$)")))


# Arabic marks and letter forms.
ARABIC_MARKS = "[ً-ٟ]"
ALEF_FORMS, ALEF = "آأ", "اا"
PERSIAN_FROM, PERSIAN_TO = "يكہ", "یکه"


def trim_arabic_diacritics(df: DataFrame, _=None) -> DataFrame:
    """A headword without marks is put first where it differs."""
    bare = F.translate(F.regexp_replace(headword(), ARABIC_MARKS, ""), ALEF_FORMS, ALEF)
    return _edit(df, F.when((bare != headword()) & (bare != ""), F.array_prepend("terms", bare)).otherwise(F.col("terms")))


def rtl(df: DataFrame, _=None) -> DataFrame:
    return _edit(df, defi=F.concat(F.lit('<div dir="rtl">'), "defi", F.lit("</div>")))


def remove_html_all(df: DataFrame, _=None) -> DataFrame:
    d = F.regexp_replace("defi", "(?s)<p( [^<>]*?)?>(.*?)</p>", "$2\n")
    d = F.regexp_replace(text.sub(d, "</p>", "\n"), "(?s)<div( [^<>]*?)?>(.*?)</div>", "$2\n")
    d = F.regexp_replace(text.sub(d, "</div>", "\n"), "(?i)<br[ /]*>", "\n")
    return _edit(df, defi=text.strip(html.text_of(d)))


def remove_html(df: DataFrame, tags: str) -> DataFrame:
    names = "|".join(re.escape(t.strip()) for t in tags.split(",") if t.strip())
    return _edit(df, defi=F.regexp_replace("defi", f"</?(?:{names})( [^>]*)?>", "")) if names else df


def normalize_html(df: DataFrame, _=None) -> DataFrame:
    return _edit(df, defi=html.normalize_tags(F.col("defi")))


def unescape_word_links(df: DataFrame, _=None) -> DataFrame:
    return _edit(df, defi=html.unescape_links(F.col("defi")))


def lang(df: DataFrame, languages: tuple[str, ...] = ()) -> DataFrame:
    """Persian letters and spacing, if the source or target language is Persian; decided when the plan is made."""
    if not {"fa", "persian", "farsi"} & {x.lower() for x in languages or ()}:
        return df

    def persian(c: Column) -> Column:
        return text.space_after(text.sub(F.translate(c, PERSIAN_FROM, PERSIAN_TO), "ۂ", "هٔ"), "،")

    return _edit(df, _terms(persian), persian(F.col("defi")))


def remove_empty_dup_alt_terms(df: DataFrame, _=None) -> DataFrame:
    several = F.size("terms") > 1
    kept = F.when(several, F.array_distinct(F.filter("terms", lambda t: t != ""))).otherwise(F.col("terms"))
    return _edit(df, kept).filter(F.col("is_data") | (F.size("terms") > 0))


def prevent_duplicate_terms(df: DataFrame, _=None) -> DataFrame:
    """The whole key is unique: a repeat becomes ``key (n)`` with the smallest free n from 2.

    Keys that can collide share the part before their numbers.  Where all rows
    of such a root have one key, repeats are numbered in order; only roots with
    several keys (``a`` beside ``a (2)``) are settled together, as a numbered
    form may be taken there.
    """
    rooted = df.withColumn("_key", s_term()).withColumn("_root", F.regexp_replace("_key", r"( \(\d+\))+$", ""))
    sizes = rooted.groupBy("_root").agg((F.min("_key") != F.max("_key")).alias("_n"))
    rooted = rooted.join(sizes.filter("_n"), "_root", "left")
    place = F.row_number().over(Window.partitionBy("_key").orderBy("part", "seq"))
    single = rooted.filter("_n is null").withColumn("_at", place)
    unique = F.when(F.col("_at") == 1, F.col("_key")).otherwise(F.concat("_key", F.lit(" ("), F.col("_at"), F.lit(")")))
    single = single.withColumn("terms", F.when(F.col("is_data") & (F.col("_at") == 1), F.col("terms")).otherwise(F.array(unique))).drop("_at")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "seq"], kind="stable")
        used: set[str] = set()
        following: dict[str, int] = {}
        out = []
        for key in pdf["_key"]:
            new, n = key, following.get(key, 2)
            while new in used:
                new, n = f"{key} ({n})", n + 1
            following[key] = n
            used.add(new)
            out.append([new])
        return pdf.assign(terms=out)

    many = rooted.filter("_n is not null").groupBy("_root").applyInPandas(settle, rooted.schema)
    return single.unionByName(many).drop("_key", "_root", "_n")


def strip_full_html(df: DataFrame, _=None) -> DataFrame:
    return _edit(df, defi=text.strip_full_html(F.col("defi"))[0])


def md_to_html(df: DataFrame, _=None) -> DataFrame:
    plain = ~F.col("is_data") & (F.col("defi_format") == "m")
    return df.withColumns({"defi": F.when(plain, html.markdown(F.when(plain, F.col("defi")))).otherwise(F.col("defi")), "defi_format": F.when(plain, "h").otherwise(F.col("defi_format"))})


#: (key, on without configuration, transform), in the order of application.
RULES: tuple[tuple[str, bool, Callable], ...] = (
    ("trim_whitespaces", True, trim_whitespaces),
    ("non_empty_term", True, non_empty_term),
    ("skip_resources", False, skip_resources),
    ("utf8_check", False, utf8_check),
    ("lower", False, lower),
    ("skip_duplicate_headword", False, skip_duplicate_headword),
    ("skip_term_regex", False, skip_term_regex),
    ("trim_arabic_diacritics", False, trim_arabic_diacritics),
    ("rtl", False, rtl),
    ("remove_html_all", False, remove_html_all),
    ("remove_html", False, remove_html),
    ("normalize_html", False, normalize_html),
    ("unescape_word_links", False, unescape_word_links),
    ("lang", True, lang),
    ("non_empty_term", True, non_empty_term),
    ("non_empty_defi", True, non_empty_defi),
    ("remove_empty_dup_alt_terms", True, remove_empty_dup_alt_terms),
    ("prevent_duplicate_terms", False, prevent_duplicate_terms),
    ("strip_full_html", False, strip_full_html),
    ("md_to_html", False, md_to_html),
)


def apply(df: DataFrame, config: dict | None = None, languages: tuple[str, ...] = (), requested: tuple[str, ...] = ()) -> DataFrame:
    """All rules that are on.  A string-valued rule is on if its string isn't empty."""
    config = config or {}
    unknown = set(config) - {name for name, _, _ in RULES}
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    for name, always, rule in RULES:
        value = config.get(name)
        if always or value or name in requested:
            df = rule(df, languages if name == "lang" else value)
    return df
