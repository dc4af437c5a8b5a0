"""Formats by name and extension, and the detection of input and output formats."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from ..sinks import package, slob
from ..sinks import text as text_sinks
from ..sources import bundles, containers, delimited, formats, wordlists
from ..sources.base import decoded

ALWAYS, DEFAULT_YES, DEFAULT_NO, NEVER = "always", "default yes", "default no", "never"
COMPRESSION = {".gz": "gzip", ".bz2": "bzip2", ".lzma": "lzma", ".dz": "gzip", ".zip": "zip"}


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...] = ()
    reader: Callable | None = None
    writer: Callable | None = None
    sort: str = DEFAULT_NO
    sort_key: str | None = None
    #: filters that the sink asks for
    filters: tuple[str, ...] = ()


def _file(decoder, glob: str | None = None):
    return lambda spark, path, **options: decoded(spark, path, decoder, glob, **options)


FORMATS: dict[str, Format] = {f.name: f for f in (
    Format("Tabfile", (".txt", ".tab", ".tsv"), delimited.read_tabfile, text_sinks.tabfile),
    Format("Csv", (".csv",), delimited.read_csv, text_sinks.csv),
    Format("Json", (".json",), None, text_sinks.json_object, filters=("prevent_duplicate_terms",)),
    Format("DiktJson", (), None, text_sinks.dikt_json, filters=("prevent_duplicate_terms",)),
    Format("Sql", (".sql",), None, text_sinks.sql),
    Format("LingoesLDF", (".ldf",), delimited.read_ldf, text_sinks.ldf),
    Format("Dictfile", (".df",), _file(formats.kobo_dictfile), text_sinks.kobo_dictfile),
    Format("DictOrgSource", (".dtxt",), None, text_sinks.dict_org_source),
    Format("GettextPo", (".po",), _file(formats.gettext_po), text_sinks.gettext_po, filters=("prevent_duplicate_terms",)),
    Format("Info", (".info",), delimited.read_info, text_sinks.info_json),
    Format("StardictTextual", (), _file(formats.stardict_textual), text_sinks.stardict_textual),
    Format("Stardict", (".ifo",), bundles.read_stardict, package.stardict, ALWAYS, "stardict"),
    Format("StardictMergeSyns", (), None, partial(package.stardict, merge_syns=True), ALWAYS, "stardict"),
    Format("DictOrg", (".index",), bundles.read_dictd, package.dictd),
    Format("AyanDictSQLite", (), _file(formats.ayandict_sqlite), package.ayandict_sqlite),
    Format("Edlin", (".edlin",), _file(formats.edlin), package.edlin),
    Format("CrawlerDir", (".crawler",), delimited.read_crawler, package.crawler),
    Format("Yomichan", (".zip",), _file(formats.yomichan), package.yomichan, ALWAYS, "headword", ("remove_html_all",)),
    Format("Epub2", (".epub",), None, package.epub2, ALWAYS, "ebook"),
    Format("Mobi", (".mobi",), None, package.mobi_source, DEFAULT_YES, "ebook"),
    Format("Kobo", (".kobo",), None, package.kobo, NEVER),
    Format("HtmlDir", (".hdir",), None, package.html_dir),
    Format("Dicformids", (".mids",), bundles.read_dicformids, package.dicformids, ALWAYS, "dicformids"),
    Format("AppleDict", (".apple",), _file(formats.apple_source), package.apple_source),
    Format("Aard2Slob", (".slob",), _file(containers.slob), slob.slob),
    Format("OctopusMdict", (".mdx",), containers.read_mdict),
    Format("Dictunformat", (".dictunformat",), _file(formats.dictunformat)),
    Format("ABBYYLingvoDSL", (".dsl",), _file(formats.dsl)),
    Format("EDICT2", (".u8",), delimited.read_cedict),
    Format("cc-kedict", (), _file(formats.cedict_yaml)),
    Format("Wiktextract", (".jsonl",), delimited.read_wiktextract),
    Format("WordFrequency", (".wordfrequency",), delimited.read_frequency),
    Format("Wordnet", (), bundles.read_wordnet),
    Format("Wordset", (), lambda spark, path: decoded(spark, path, formats.wordset, "*.json", order=formats.wordset_order)),
    Format("TMX", (".tmx",), _file(formats.tmx)),
    Format("XLIFF", (".xlf", ".xliff"), _file(formats.xliff)),
    Format("Xdxf", (".xdxf",), _file(formats.xdxf)),
    Format("XdxfCss", (), _file(formats.xdxf)),
    Format("XdxfLax", (), _file(formats.xdxf_lax)),
    Format("FreeDict", (".tei",), _file(formats.freedict)),
    Format("FreeDictMarkdown", (), lambda spark, path: decoded(spark, path, formats.freedict, markdown=True)),
    Format("JMDict", (), _file(formats.jmdict)),
    Format("JMnedict", (), _file(formats.jmdict)),
    Format("Almaany", (), _file(formats.almaany)),
    Format("AnkiApkg", (".apkg", ".colpkg"), _file(formats.anki)),
    Format("Dictcc", (), _file(formats.dict_cc)),
    Format("Dictcc_source", (), wordlists.read_dict_cc_lines),
    Format("Dictcc_split", (), _file(formats.dict_cc_split)),
    Format("DigitalNK", (), _file(formats.digitalnk)),
    Format("MakindoMedical", (), _file(formats.makindo)),
)}


def register(new: Format) -> None:
    """Add a format; a name that is taken, or a format without reader and writer, is refused."""
    if new.name in FORMATS:
        raise ValueError(f"format {new.name!r} exists")
    if new.reader is None and new.writer is None:
        raise ValueError(f"format {new.name!r} has neither reader nor writer")
    FORMATS[new.name] = new


def load_plugins(folder: str) -> list[str]:
    """Register the ``FORMATS`` of every Python file in ``folder``, in order of names; returns the new names.

    The files run in the driver: load only those you trust.
    """
    added = []
    for file in sorted(f for f in os.listdir(folder) if f.endswith(".py") and not f.startswith("_")):
        spec = importlib.util.spec_from_file_location(f"lexweave_plugin_{file[:-3]}", os.path.join(folder, file))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        for new in module.FORMATS:
            register(new)
            added.append(new.name)
    return added


def split_extension(path: str) -> tuple[str, str, str]:
    """(stem, extension, compression)."""
    stem, ext = os.path.splitext(path)
    if ext.lower() in COMPRESSION and os.path.splitext(stem)[1]:
        inner, inner_ext = os.path.splitext(stem)
        return inner, inner_ext.lower(), COMPRESSION[ext.lower()]
    return stem, ext.lower(), ""


def by_extension(extension: str) -> Format | None:
    return next((f for f in FORMATS.values() if extension and extension in f.extensions), None)


def detect_input(path: str, name: str = "") -> Format:
    found = FORMATS.get(name) if name else by_extension(split_extension(path)[1])
    if found is None:
        raise ValueError(f"unknown format {name!r}" if name else f"no format for {path!r}")
    if found.reader is None:
        raise ValueError(f"{found.name} can't be read")
    return found


def detect_output(path: str, name: str = "", add_extension: bool = False) -> tuple[Format, str, str]:
    """(format, path, compression)."""
    stem, ext, compression = split_extension(path)
    found = FORMATS.get(name) if name else by_extension(ext)
    if found is None:
        raise ValueError(f"unknown format {name!r}" if name else f"no format for {path!r}")
    if found.writer is None:
        raise ValueError(f"{found.name} can't be written")
    if add_extension and ext not in found.extensions and found.extensions:
        path += found.extensions[0]
    return found, path, compression
