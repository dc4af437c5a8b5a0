"""Pinyin with tone numbers, and short forms of glosses."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

TONE_MARKS = {"1": "̄", "2": "́", "3": "̌", "4": "̀"}
# Which vowel of a syllable has the mark, tried in this order (the last letter is marked).
MARKED = ("a", "e", "o", "iu", "ui", "i", "u", "ü")
# Colours by tone.
TONE_COLORS = {"": "black", "1": "red", "2": "orange", "3": "green", "4": "blue", "5": "black"}
# Words that a short form leaves out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y "
    "ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
SUMMARY_WORDS = 10


def tone(syllable: Column) -> Column:
    """The tone number at the end: 1 to 5, else nothing."""
    return F.regexp_extract(syllable, "([1-5])$", 1)


def with_tone_mark(syllable: Column) -> Column:
    """``zhong1`` to ``zhōng``; the neutral tone 5 only goes, and what has no tone stays as it is."""
    base = F.lower(F.regexp_replace(syllable, ".$", ""))
    number, marked = tone(syllable), F.lit(None).cast("string")
    for vowel in reversed(MARKED):
        letter = vowel[-1]
        signs = F.create_map(*[F.lit(x) for n, m in TONE_MARKS.items() for x in (n, unicodedata.normalize("NFC", letter + m))])
        marked = F.when(F.contains(base, F.lit(vowel)), F.replace(base, F.lit(letter), signs[number])).otherwise(marked)
    plain = F.when(number == "5", base).otherwise(marked)
    capital = F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 30))
    spoken = F.when(syllable.rlike(r"^\p{Lu}"), capital).otherwise(plain)
    return F.when(number == "", syllable).otherwise(F.coalesce(F.when(plain.isNotNull(), spoken), base))


def syllables_html(syllables: Column, tones: Column, color: bool = True) -> Column:
    """Syllables in their tones' colours; a blank before a capital and an apostrophe before a vowel inside a word.

    Where syllables and tones don't pair up there are no colours."""
    paired = F.size(syllables) == F.size(tones)
    colors = F.create_map(*[F.lit(x) for pair in TONE_COLORS.items() for x in pair])

    def one(s: Column, k: Column) -> Column:
        n = F.when(paired, F.get(tones, k)).otherwise("")
        first = F.substring(s, 1, 1)
        inside = (k > 0) & (n != "")
        between = F.when(inside & first.rlike(r"\p{Lu}"), " ").when(inside & first.rlike("[aeiouāáǎàēéěèīíǐìōóǒòūúǔùüǖǘǚǜ]"), "'").otherwise("")
        shade = F.when(paired, colors[n]).otherwise("") if color else F.lit("")
        return F.concat(F.lit('<font color="'), shade, F.lit('">'), between, text.xml_escape(s, quote=False), F.lit("</font>"))

    return F.concat(F.lit('<div style="display: inline-block">'), F.array_join(F.transform(syllables, one), ""), F.lit("</div>"))


def summary(gloss: Column) -> Column:
    """A gloss without parentheses, punctuation and stop words (unless it has no others): its first ten words."""
    bare = F.regexp_replace(gloss, r"\([^)]++\)", "")
    marks = "".join(c for c in string.punctuation if c not in "-'")
    words = F.filter(F.split(F.translate(bare, marks, " " * len(marks)), r"(?U)\s+"), lambda w: w != "")
    telling = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return F.array_join(F.slice(F.when(F.size(telling) > 0, telling).otherwise(words), 1, SUMMARY_WORDS), " ")
