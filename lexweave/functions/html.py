"""HTML and script functions that built-in expressions can't give: Arrow-batched."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags whose case is normalised; entities that links keep.
NORMAL_TAGS = ("a", "font", "i", "b", "u", "p", "sup", "div", "span", "table", "tr", "th", "td", "ul", "ol", "li", "img", "br", "hr")
KEPT_ENTITIES = frozenset('<>&"\' ')
_TAG = re.compile("</?(?:" + "|".join(NORMAL_TAGS) + ")[^<>]*?>", re.S | re.I)
_LINK = re.compile(r'href=["\']bword://[^<>"]*["\']', re.I)
_ENTITY = re.compile(r"&[^&;\s]{1,32};")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_data(self, data):
        self.out.append(data)


def html_text(text: str) -> str:
    """The text of an HTML fragment."""
    parser = _Text()
    parser.feed(text)
    parser.close()
    return "".join(parser.out)


def unescape_text(text: str) -> str:
    """Entities decoded except those of ``KEPT_ENTITIES``."""
    return _ENTITY.sub(lambda m: m[0] if (c := html.unescape(m[0])) in KEPT_ENTITIES else c, text)


def _udf(f, kind: str = "string"):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def lower_links(defi: Column) -> Column:
    return _udf(lambda t: _LINK.sub(lambda m: m[0].lower(), t))(defi)


def normalize_tags(defi: Column) -> Column:
    return _udf(lambda t: _TAG.sub(lambda m: m[0].lower(), t))(defi)


def unescape_links(defi: Column) -> Column:
    return _udf(lambda t: _LINK.sub(lambda m: unescape_text(m[0]) if "&" in m[0] else m[0], t))(defi)


def text_of(defi: Column) -> Column:
    return _udf(html_text)(defi)


def unescape_entities(c: Column) -> Column:
    return _udf(unescape_text)(c)


def nfkc(c: Column) -> Column:
    return _udf(lambda t: unicodedata.normalize("NFKC", t))(c)


# --- Markdown: the block and inline subset that definitions use ------------------

_INLINE = ((re.compile(r"`([^`]+)`"), r"<code>\1</code>"), (re.compile(r"!\[([^\]]*)\]\(([^)\s]+)\)"), r'<img src="\2" alt="\1" />'), (re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)"), r'<a href="\2">\1</a>'),
           (re.compile(r"\*\*(.+?)\*\*|__(.+?)__"), lambda m: f"<strong>{m[1] or m[2]}</strong>"), (re.compile(r"\*(.+?)\*|(?<!\w)_(.+?)_(?!\w)"), lambda m: f"<em>{m[1] or m[2]}</em>"))


def markdown_html(text: str) -> str:
    """Headings, lists, quotes, rules, code fences and paragraphs, with inline marks."""

    def inline(s: str) -> str:
        s = html.escape(s, quote=False)
        for pattern, to in _INLINE:
            s = pattern.sub(to, s)
        return s

    out: list[str] = []
    for block in re.split(r"\n\s*\n", text.replace("\r\n", "\n").strip("\n")):
        lines = block.split("\n")
        if not block.strip():
            continue
        if m := re.fullmatch(r"```\w*\n(.*?)\n?```", block, re.S):
            out.append(f"<pre><code>{html.escape(m[1], quote=False)}\n</code></pre>")
        elif len(lines) == 1 and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", block)):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif re.fullmatch(r"\s*([-*_])(\s*\1){2,}\s*", block):
            out.append("<hr />")
        elif all(re.match(r"\s*[-*+]\s+", x) for x in lines):
            out.append("<ul>\n" + "".join(f"<li>{inline(re.sub(r'^\s*[-*+]\s+', '', x))}</li>\n" for x in lines) + "</ul>")
        elif all(re.match(r"\s*\d+[.)]\s+", x) for x in lines):
            out.append("<ol>\n" + "".join(f"<li>{inline(re.sub(r'^\s*\d+[.)]\s+', '', x))}</li>\n" for x in lines) + "</ol>")
        elif all(x.startswith(">") for x in lines):
            out.append("<blockquote>\n<p>" + inline("\n".join(x[1:].strip() for x in lines)) + "</p>\n</blockquote>")
        else:
            out.append("<p>" + inline(block) + "</p>")
    return "\n".join(out) + "\n" if out else ""


def markdown(defi: Column) -> Column:
    return _udf(markdown_html)(defi)


# --- scripts ----------------------------------------------------------------------

# First words of Unicode character names -> writing system.
SCRIPTS = {"LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek", "ARABIC": "Arabic", "HEBREW": "Hebrew", "ARMENIAN": "Armenian", "DEVANAGARI": "Devanagari", "BENGALI": "Bengali", "GURMUKHI": "Gurmukhi", "GUJARATI": "Gujarati",
           "TAMIL": "Tamil", "TELUGU": "Telugu", "KANNADA": "Kannada", "MALAYALAM": "Malayalam", "SINHALA": "Sinhala", "THAI": "Thai", "LAO": "Lao", "TIBETAN": "Tibetan", "MYANMAR": "Burmese", "GEORGIAN": "Georgian", "HANGUL": "Hangul",
           "ETHIOPIC": "Ge'ez", "KHMER": "Khmer", "MONGOLIAN": "Mongolian", "HIRAGANA": "Japanese", "KATAKANA": "Japanese", "CJK": "CJK", "SYRIAC": "Syriac", "THAANA": "Thaana", "TAGALOG": "Baybayin"}


def script_of(text: str) -> str | None:
    """The writing system of the first letter that has one, looking from the middle on, then from the start."""
    half = len(text) // 2
    for c in text[half:] + text[:half]:
        if not c.isascii() or c.isalpha():
            name = SCRIPTS.get(unicodedata.name(c, "").split(" ", 1)[0])
            if name:
                return name
    return None


def script(c: Column) -> Column:
    return _udf(script_of)(c)


def encode_lossy(c: Column, encoding: str) -> Column:
    """Bytes in a legacy charset, with ``?`` for what it lacks: a sort key."""
    return _udf(lambda t: t.encode(encoding, "replace"), "binary")(c)
