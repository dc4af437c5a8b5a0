"""Conversion: source, filters, order, sink."""

from __future__ import annotations

import inspect
import logging
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..model import Glossary, info_dict, info_table
from ..operators import filters, ordered
from ..operators.sortkeys import key_columns
from ..storage import stored
from .compress import beside, compress
from .registry import ALWAYS, DEFAULT_YES, NEVER, detect_input, detect_output

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ConvertArgs:
    input: str
    output: str
    input_format: str = ""
    output_format: str = ""
    sort: bool | None = None
    sort_key: str = ""
    sort_encoding: str = "utf-8"
    source_lang: str = ""
    target_lang: str = ""
    read_options: dict = field(default_factory=dict)
    write_options: dict = field(default_factory=dict)
    filters: dict = field(default_factory=dict)
    info: dict = field(default_factory=dict)


def _known(f, options: dict) -> dict:
    """Options that a reader or writer has; others are logged and left out."""
    names = inspect.signature(f).parameters
    if any(p.kind is p.VAR_KEYWORD for p in names.values()):
        return options
    for key in set(options) - set(names):
        log.warning("unknown option %s", key)
    return {k: v for k, v in options.items() if k in names}


def read(spark: SparkSession, path: str, name: str = "", **options) -> Glossary:
    found = detect_input(path, name)
    return found.reader(spark, path, **_known(found.reader, options))


def in_order(g: Glossary, key: str, encoding: str = "utf-8") -> Glossary:
    """Entries with ``seq`` renumbered by a sort key, so that sinks and windows follow it."""
    named = {f"_k{i}": k for i, k in enumerate(key_columns(key, encoding))}
    rows = ordered.numbered(g.entries.withColumns(named), "_new", (*named, "part", "seq"))
    return Glossary(rows.withColumn("seq", rows["_new"]).drop("_new", *named), g.info)


def convert(spark: SparkSession, args: ConvertArgs) -> Glossary:
    """Read, filter, order and write; returns what was written."""
    if args.input == args.output:
        raise ValueError("input and output are the same file")
    sink, path, compression = detect_output(args.output, args.output_format)
    g = read(spark, args.input, args.input_format, **args.read_options)
    info = info_dict(g.info) | {k: v for k, v in (("sourceLang", args.source_lang), ("targetLang", args.target_lang)) if v} | args.info
    g = Glossary(g.entries, info_table(spark, {k: v for k, v in info.items() if v is not None}))
    languages = tuple(x for x in (info.get("sourceLang"), info.get("targetLang")) if x)
    g = Glossary(filters.apply(g.entries, args.filters, languages, sink.filters), g.info)
    wanted = sink.sort == ALWAYS or args.sort or (sink.sort == DEFAULT_YES and args.sort is not False)
    if wanted and sink.sort != NEVER:
        key = sink.sort_key if sink.sort == ALWAYS and sink.sort_key else args.sort_key or sink.sort_key or "headword_lower"
        # Ranges are found by a sample, which would run readers and filters a second time.
        g = in_order(Glossary(stored(g.entries, "filtered"), g.info), key, args.sort_encoding)
    options = dict(args.write_options)
    if compression in ("gzip", "bzip2") and "compression" in inspect.signature(sink.writer).parameters:
        options.setdefault("compression", compression)
        sink.writer(g, path, **_known(sink.writer, options))
    elif compression:  # written plain, then compressed
        with beside(path) as plain:
            sink.writer(g, plain, **_known(sink.writer, options))
            compress(plain, path, compression)
    else:
        sink.writer(g, path, **_known(sink.writer, options))
    return g
