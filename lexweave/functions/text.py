"""Scalar text functions as column expressions (they stay in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Unicode white space, with the four separators U+001C to U+001F.
SPACE = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: An even run of backslashes, not after another backslash.
EVEN = r"((?<!\\)(?:\\\\)*)"


def sub(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def escape_ntb(c: Column, bar: bool = False) -> Column:
    """Backslash, tab, newline (and bar) escaped; carriage returns deleted."""
    c = sub(sub(sub(sub(c, "\\", "\\\\"), "\t", "\\t"), "\r", ""), "\n", "\\n")
    return sub(c, "|", "\\|") if bar else c


def unescape_ntb(c: Column, bar: bool = False) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, EVEN + r"\\n", "$1\n"), EVEN + r"\\t", "$1\t")
    if bar:
        c = F.regexp_replace(c, EVEN + r"\\\|", "$1|")
    return sub(c, "\\\\", "\\")


def escape_bar(c: Column) -> Column:
    return sub(sub(c, "\\", "\\\\"), "|", "\\|")


def unescape_bar(c: Column) -> Column:
    return sub(F.regexp_replace(c, EVEN + r"\\\|", "$1|"), "\\\\", "\\")


def split_bar(c: Column) -> Column:
    """Split at bars after an even run of backslashes; the run is swallowed."""
    return F.transform(F.split(c, r"(?:(?<!\\)(?:\\\\)*)\|", -1), unescape_bar)


def split_bar_unescape_ntb(c: Column) -> Column:
    return F.transform(F.split(c, r"(?:(?<!\\)(?:\\\\)*)\|", -1), lambda x: unescape_ntb(x, bar=True))


def join_bar(terms: Column) -> Column:
    return F.array_join(F.transform(terms, escape_bar), "|")


def escape_nrb(c: Column) -> Column:
    return sub(sub(sub(c, "\\", "\\\\"), "\n", "\\n"), "\r", "\\r")


def unescape_nrb(c: Column) -> Column:
    return sub(F.regexp_replace(F.regexp_replace(c, EVEN + r"\\n", "$1\n"), EVEN + r"\\r", "$1\r"), "\\\\", "\\")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc32hex(data: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(data.cast("binary")))), 8, "0")


def uint_bytes(n: Column, size: int = 4) -> Column:
    """Big-endian unsigned integer of ``size`` bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def uint_from_bytes(b: Column) -> Column:
    return F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")


def url_to_path(url: Column) -> Column:
    """Percent-decoded path; of ``file://`` URLs only the path, without a line end."""
    bare = F.when(url.startswith("file://"), F.regexp_replace(F.substring(url, 8, 1 << 30), "\r\n?$", "")).otherwise(url)
    return F.try_url_decode(sub(bare, "+", "%2B"))


def space_after(c: Column, ch: str) -> Column:
    """No space before ``ch``, one after it, none at the end."""
    c = sub(sub(sub(c, f" {ch}", ch), ch, f"{ch} "), f"{ch}  ", f"{ch} ")
    return F.regexp_replace(c, " $", "")


def xml_escape(c: Column, quote: bool = False) -> Column:
    c = sub(sub(sub(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return sub(sub(c, '"', "&quot;"), "'", "&#x27;") if quote else c


def xml_unescape(c: Column) -> Column:
    """The five predefined entities."""
    return sub(sub(sub(sub(sub(sub(c, "&lt;", "<"), "&gt;", ">"), "&quot;", '"'), "&#x27;", "'"), "&apos;", "'"), "&amp;", "&")


def is_kana(c: Column) -> Column:
    return c.rlike(r"^[\p{IsHiragana}\p{IsKatakana}]")


def is_cyrillic(c: Column) -> Column:
    return c.rlike(r"^\p{IsCyrillic}")


def is_kanji(c: Column) -> Column:
    return c.rlike(r"^\p{IsHan}")


def hiragana_to_katakana(c: Column) -> Column:
    first, last = 0x3041, 0x3096
    return F.translate(c, "".join(map(chr, range(first, last + 1))), "".join(chr(x + 0x60) for x in range(first, last + 1)))


def julian_day(date: Column) -> Column:
    """Days since the start of the Julian period, for a Gregorian date."""
    return F.datediff(date, F.lit("1970-01-01").cast("date")) + 2440588


def from_julian_day(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (day - 2440588).cast("int"))


# --- definition format ---------------------------------------------------------

# Tags that tell an HTML definition.
_OPEN_TAGS = ("font", "i", "b", "p", "div", "span", "img", "table", "sup", "u", "ul", "ol", "li", "h[1-6]", "audio")
_VOID_TAGS = ("br", "hr")
HTML_PATTERN = (
    r"(?is)(?:" + "|".join(rf"<{t}[ >]" for t in _OPEN_TAGS) + "|" + "|".join(rf"<{t}\s*/?\s*>" for t in _VOID_TAGS) + r"|<a |&[a-z]{2,8};|&#x?[0-9]{2,5};)"
)
XDXF_PATTERN = r"(?is)^<k>[^<>]*</k>"


def detect_format(defi: Column, default: str = "m") -> Column:
    return F.when(defi.rlike(XDXF_PATTERN), "x").when(defi.rlike(HTML_PATTERN), "h").otherwise(default)


def strip_full_html(defi: Column) -> tuple[Column, Column]:
    """(definition, error): the body of a whole HTML page.  With an error the definition stays."""
    doctype = "<!DOCTYPE html>"
    page = F.when(defi.startswith(doctype), strip(F.substring(defi, len(doctype) + 1, 1 << 30))).when(defi.startswith("<html>"), defi)
    after = F.substring(page, F.instr(page, "<body") + 5, 1 << 30)
    inner = F.substring(after, F.instr(after, ">") + 1, 1 << 30)
    end = F.instr(inner, "</body")
    error = (
        F.when(page.isNull(), F.lit(None))
        .when(defi.startswith(doctype) & ~page.startswith("<html"), "Has <!DOCTYPE html> but no <html>")
        .when(F.instr(page, "<body") == 0, "<body not found")
        .when(F.instr(after, ">") == 0, "'>' after <body not found")
        .when(end == 0, "</body close not found")
    )
    return F.when(page.isNull() | error.isNotNull(), defi).otherwise(F.substring(inner, F.lit(1), end - 1)), error


# --- keys and shards -------------------------------------------------------------


def shard_path(term: Column) -> Column:
    """Where a file-per-entry store keeps a term: hex shards of its ASCII-lower bytes, long ones with a SHA-1 tail."""
    low = ascii_lower(term).cast("binary")
    part = lambda start, size: F.lower(F.hex(F.substring(low, start, size)))
    tail = F.concat(part(5, 4), F.lit("-"), F.substring(F.sha1(term.cast("binary")), 1, 8))
    return (
        F.when(F.octet_length(low) <= 2, F.lower(F.hex(low)))
        .when(F.octet_length(low) <= 4, F.concat(part(1, 2), F.lit(".d/"), part(3, 2)))
        .otherwise(F.concat(part(1, 2), F.lit(".d/"), part(3, 2), F.lit(".d/"), tail))
    )


def trigrams(term: Column) -> Column:
    """Distinct three-letter grams of each space-separated word, with a newline before the word."""
    words = F.transform(F.split(term, " "), lambda w: F.concat(F.lit("\n"), w))
    grams = F.transform(words, lambda w: F.when(F.length(w) >= 3, F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(grams))
