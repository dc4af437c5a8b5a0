"""Sort keys: each gives the columns to order by; ``part`` and ``seq`` always follow, so ties keep their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text
from ..model import headword

SPECIAL = "SPECIAL"
# Characters that the mobile-dictionary key deletes.
PUNCTUATION = r"""[!"$§%&/()=?´`\\{}\[\]^°+*~#'\-_.:,;<>@|]"""


def _encoded(c: Column, encoding: str) -> Column:
    return c if encoding.lower().replace("-", "") == "utf8" else html.encode_lossy(c, encoding)


def by_headword(encoding: str = "utf-8", **_) -> list[Column]:
    return [_encoded(headword(), encoding)]


def by_headword_lower(encoding: str = "utf-8", **_) -> list[Column]:
    return [_encoded(F.lower(headword()), encoding)]


def by_headword_bytes_lower(encoding: str = "utf-8", **_) -> list[Column]:
    return [_encoded(text.ascii_lower(headword()), encoding)]


def by_stardict(encoding: str = "utf-8", **_) -> list[Column]:
    return [_encoded(text.ascii_lower(headword()), encoding), _encoded(headword(), encoding)]


def ebook_prefix(term: Column, length: int = 2) -> Column:
    prefix = F.substring(F.lower(term), 1, length)
    return F.when((F.substring(prefix, 1, 1) < "a") | (term == ""), SPECIAL).otherwise(prefix)


def by_ebook(encoding: str = "utf-8", length: int = 2, **_) -> list[Column]:
    return [_encoded(ebook_prefix(headword(), length), encoding), _encoded(headword(), encoding)]


def by_ebook_length3(encoding: str = "utf-8", **_) -> list[Column]:
    return by_ebook(encoding, 3)


def dicformids_key(term: Column) -> Column:
    return F.lower(text.strip(F.regexp_replace(F.regexp_replace(text.strip(term), PUNCTUATION, ""), "[ \t]+", " ")))


def by_dicformids(**_) -> list[Column]:
    return [dicformids_key(headword())]


def by_random(seed: int = 0, **_) -> list[Column]:
    return [F.rand(seed)]


KEYS: dict[str, Callable[..., list[Column]]] = {
    "headword": by_headword, "headword_lower": by_headword_lower, "headword_bytes_lower": by_headword_bytes_lower, "stardict": by_stardict,
    "ebook": by_ebook, "ebook_length3": by_ebook_length3, "dicformids": by_dicformids, "random": by_random,
}
LOCALE_KEYS = ("headword", "headword_lower", "random")


def key_columns(name: str = "headword_lower", encoding: str = "utf-8", **options) -> list[Column]:
    """Columns of a key; ``name:locale`` orders by that locale's collation."""
    name, _, locale = name.partition(":")
    if name not in KEYS:
        raise ValueError(f"unknown sort key {name!r}")
    if not locale:
        return KEYS[name](encoding=encoding, **options)
    if name not in LOCALE_KEYS:
        raise ValueError(f"sort key {name!r} has no locale variant")
    if name == "random":
        return by_random(**options)
    term = F.lower(headword()) if name == "headword_lower" else headword()
    return [F.collate(term, locale)]


def sort_entries(df: DataFrame, name: str = "headword_lower", encoding: str = "utf-8", reverse: bool = False, **options) -> DataFrame:
    keys = key_columns(name, encoding, **options)
    return df.orderBy(*[k.desc() if reverse else k.asc() for k in keys], "part", "seq")
