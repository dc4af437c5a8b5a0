"""Bilingual word lists: fields with optional parts and abbreviations become the words one may look for."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import Glossary, info_table
from .base import as_entries, numbered_lines

# Abbreviations of persons and things, and what they stand for.
ABBREVIATIONS = {
    "en": {"sth.": ("something",), "sb.": ("somebody",), "sb.'s": ("somebody's",), "sb./sth.": ("somebody", "something", "somebody/something")},
    "de": {
        "jd.": ("jemand",), "jds.": ("jemandes",), "jdm.": ("jemandem",), "jdn.": ("jemanden",), "etw.": ("etwas",),
        "jd./etw.": ("jemand", "etwas", "jemand/etwas"), "jds./etw.": ("jemandes", "etwas", "jemandes/etwas"),
        "jdm./etw.": ("jemandem", "etwas", "jemandem/etwas"), "jdn./etw.": ("jemanden", "etwas", "jemanden/etwas"),
    },
}
# Words that may be left out at the start of a field of a word class.
LEADING = {("en", "verb"): {"to"}}
# Word classes whose translations come first.
CLASS_ORDER = ("adj", "verb", "noun")
_CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}


def field_parts(field: str) -> Iterator[tuple[str, str]]:
    """("word", w) and ("option", text in round brackets); other brackets go, and an unclosed one ends the field."""
    at = 0
    while at < len(field):
        opening = field[at]
        if opening == " ":
            at += 1
        elif opening in _CLOSING:
            depth, end = 1, at + 1
            while depth and end < len(field):
                depth += (field[end] == opening) - (field[end] == _CLOSING[opening])
                end += 1
            if depth:
                return
            if opening == "(":
                yield "option", field[at + 1 : end - 1]
            at = end
        else:
            end = re.compile(r"[ (\[{<]|$").search(field, at).start()
            yield "word", field[at:end]
            at = end


def field_variants(field: str, word_class: str, lang: str) -> set[str]:
    """The field with and without its options, and without abbreviations at its ends."""
    parts = list(field_parts(field))
    last = max((k for k, (kind, _) in enumerate(parts) if kind == "word"), default=-1)
    droppable = set(ABBREVIATIONS.get(lang, ()))
    leading = droppable | LEADING.get((lang, word_class), set())
    done: set[str] = set()
    now: set[str] = set()
    begun = any_word = False
    for k, (kind, value) in enumerate(parts):
        longer = {f"{w} {value}" for w in now} if begun else {value}
        if kind == "option":
            now = now | longer if begun else longer | {""}
        elif k == last and value in droppable:
            done |= now
            now = longer
        elif not any_word and value in leading:
            now = longer | {value, ""}
        else:
            now = longer
        begun, any_word = True, any_word or kind == "word"
    return {" ".join(w.split()) for w in now | done} - {""}


def spelled_out(word: str, lang: str) -> Iterator[tuple[str, bool]]:
    """(word, whether an abbreviation is written out), for every choice."""
    known = ABBREVIATIONS.get(lang)
    if not known:
        yield word, False
        return
    pieces = re.split("(?<![!-~])(" + "|".join(map(re.escape, known)) + ")(?![!-~])", word)
    choices = [[(p, False), *((full, True) for full in known.get(p, ()) if k % 2)] for k, p in enumerate(pieces)]
    for choice in product(*choices):
        yield " ".join("".join(p for p, _ in choice).split()), any(full for _, full in choice)


def read_dict_cc_lines(spark: SparkSession, path: str, source_lang: str) -> Glossary:
    """``word TAB word TAB class`` lines under a ``# XX-YY`` line: words with the same translations are one entry.

    Its headword is the longest word without written-out abbreviations (ties: the first by code point).
    """
    first = numbered_lines(spark, path).orderBy("seq").limit(1).collect()
    pair = (first[0]["value"].removeprefix("#").split() or [""])[0].lower() if first else ""
    sides, lang = pair.split("-"), source_lang.strip().lower()
    if len(sides) != 2 or lang not in sides:
        raise ValueError(f"source_lang {source_lang!r} is none of {pair!r}")
    turned = lang != sides[0]

    def expand(frames):
        for pdf in frames:
            out = []
            for seq, line in zip(pdf["seq"], pdf["value"], strict=True):
                cells = line.strip().split("\t")
                if line.strip().startswith("#") or len(cells) < 2:
                    continue
                source, target = (unicodedata.normalize("NFC", html.unescape(c)) for c in (reversed(cells[:2]) if turned else cells[:2]))
                kind, target = cells[2].strip().lower() if len(cells) > 2 else "", " ".join(target.split())
                if target:
                    words = {w for v in field_variants(source, kind, lang) for w in spelled_out(v, lang) if w[0]}
                    out += [(seq, w, full, kind or None, target) for w, full in sorted(words)]
            yield pd.DataFrame(out, columns=["seq", "word", "full", "kind", "target"]).astype(object)

    rows = numbered_lines(spark, path).mapInPandas(expand, "seq long, word string, full boolean, kind string, target string")
    last_kind = F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("seq")))
    pairs = rows.groupBy("word", "target").agg(F.min("seq").alias("seq"), F.max("full").alias("full"), last_kind.alias("kind"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, CLASS_ORDER)), F.col("kind")), F.lit(0))
    rank = F.when(rank == 0, len(CLASS_ORDER) + 1).otherwise(rank)
    words = pairs.groupBy("word").agg(F.min("seq").alias("seq"), F.max("full").alias("full"), F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.lower("target").alias("l"), F.col("target").alias("t")))).alias("ts"))
    words = words.select("word", "seq", "full", F.transform("ts", lambda x: x["t"]).alias("targets"))
    named = words.groupBy("targets").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("full", (-F.length("word")).alias("n"), "word"))).alias("ws"), F.min("word").alias("tie"))
    # Several groups may start in one line: their order is that of their first words.
    place = F.row_number().over(Window.partitionBy("seq").orderBy("tie"))
    terms = F.transform("ws", lambda w: w["word"])
    listed = F.array_join(F.transform("targets", lambda t: F.concat(F.lit(" "), text.xml_escape(t, quote=True), F.lit(" "))), "")
    defi = F.concat(F.lit(" "), listed, F.lit(" "))
    entries = named.withColumn("seq", F.col("seq") * (1 << 16) + place - 1).select("seq", F.concat(F.slice(terms, 1, 1), F.array_sort(F.slice(terms, 2, F.greatest(F.size(terms), F.lit(1))))).alias("terms"), defi.alias("defi"), F.lit("h").alias("defi_format"))
    return Glossary(as_entries(entries), info_table(spark, {"name": f"dict.cc {lang.upper()}-{sides[0 if turned else 1].upper()}"}))
