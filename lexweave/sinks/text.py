"""Sinks of text rows.

Rows are formatted and sorted in Spark and written in order as part files; a
single file is made by joining the parts byte for byte, so no row passes
through the driver's memory.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..model import Glossary, headword, info_dict, s_term
from ..operators import ordered, profile, relational

ORDER = ("part", "seq")


def write_lines(lines: DataFrame, path: str, head: str = "", tail: str = "", order=ORDER, compression: str | None = None) -> None:
    """``line`` values in order, one file, between ``head`` and ``tail``.  gzip and bzip2 parts join to a valid file."""
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    codec = {"compression": compression} if compression else {}
    lines.orderBy(*order).select("line").write.options(**codec).text(folder)
    fs_path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(conf)
    names = sorted(s.getPath().toString() for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("part-"))
    ends = [_small(spark, f"{folder}/{k}", t, compression) for k, t in (("head", head), ("tail", tail))]
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
    try:
        for name in [*ends[:1], *names, *ends[1:]]:
            if name:
                source = fs.open(jvm.org.apache.hadoop.fs.Path(name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                finally:
                    source.close()
    finally:
        out.close()
    fs.delete(fs_path, True)


def _small(spark: SparkSession, folder: str, content: str, compression: str | None) -> str | None:
    """A head or tail as a file beside the parts."""
    if not content:
        return None
    lines = spark.createDataFrame([(content.removesuffix("\n"),)], "line string").coalesce(1)
    lines.write.options(**({"compression": compression} if compression else {})).text(folder)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return next(s.getPath().toString() for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("part-") and s.getLen() > 0)


def _words(g: Glossary) -> DataFrame:
    return g.entries.filter("not is_data")


def _titled(word_title: bool) -> Column:
    return F.concat(F.lit("<b>"), text.xml_escape(F.array_join("terms", " | ")), F.lit("</b><br>"), "defi") if word_title else F.col("defi")


def tabfile(g: Glossary, path: str, enable_info: bool = True, word_title: bool = False, file_size_approx: int = 0, compression: str | None = None) -> None:
    head = "".join(f"##{k}\t{_escape(v)}\n" for k, v in info_dict(g.info).items()) if enable_info else ""
    rows = _words(g).withColumn("line", F.concat(F.array_join(F.transform("terms", lambda t: text.escape_ntb(t, bar=True)), "|"), F.lit("\t"), text.escape_ntb(_titled(word_title))))
    if not file_size_approx:
        write_lines(rows, path, head, compression=compression)
        return
    head += "##file_count\t-1\n" if enable_info else ""
    parted = relational.size_parts(rows, F.octet_length("line") + 1, file_size_approx, 100)
    for k in range((parted.agg(F.max("file_part")).first()[0] or 0) + 1):
        write_lines(parted.filter(F.col("file_part") == k), f"{path}.{k}" if k else path, head if not k else "", compression=compression)


def _escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("\t", "\\t").replace("\r", "").replace("\n", "\\n")


def csv(g: Glossary, path: str, delimiter: str = ",", enable_info: bool = True, add_defi_format: bool = False, word_title: bool = False) -> None:
    """Every cell quoted; with ``add_defi_format`` the format is the third cell and alternates the fourth."""
    quote = lambda c: F.concat(F.lit('"'), text.sub(c, '"', '""'), F.lit('"'))
    alts = F.array_join(F.slice("terms", 2, F.greatest(F.size("terms"), F.lit(1))), ",")
    cells = [headword(), _titled(word_title), *([F.col("defi_format")] if add_defi_format else []), alts]
    cell = lambda s: '"' + s.replace('"', '""') + '"'
    head = "".join(delimiter.join((cell(f"#{k}"), cell(v))) + "\n" for k, v in info_dict(g.info).items()) if enable_info else ""
    write_lines(_words(g).withColumn("line", F.concat_ws(delimiter, *map(quote, cells))), path, head)


def _json_lines(g: Glossary, defi: Column) -> DataFrame:
    """``"key": "definition",`` lines with unique keys."""
    from ..operators.filters import prevent_duplicate_terms

    rows = prevent_duplicate_terms(_words(g))
    as_json = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return rows.withColumn("line", F.concat(F.lit("\t"), as_json(s_term()), F.lit(": "), as_json(defi), F.lit(",")))


def json_object(g: Glossary, path: str, enable_info: bool = True, word_title: bool = False) -> None:
    """One JSON object; the last pair is empty."""
    head = "{\n" + "".join(f"\t{json.dumps('info.' + k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)},\n" for k, v in info_dict(g.info).items()) if enable_info else "{\n"
    write_lines(_json_lines(g, _titled(word_title)), path, head, '\t"": ""\n}\n')


def dikt_json(g: Glossary, path: str, enable_info: bool = True) -> None:
    """The same without styles and classes in the markup."""
    bare = F.regexp_replace(F.regexp_replace("defi", r""" (style|class)=("[^"]*"|'[^']*')""", ""), r"</?font[^<>]*>", "")
    head = "{\n" + "".join(f"\t{json.dumps('info.' + k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)},\n" for k, v in info_dict(g.info).items()) if enable_info else "{\n"
    write_lines(_json_lines(g, bare), path, head, '\t"": ""\n}\n')


def ldf(g: Glossary, path: str) -> None:
    head = "".join(f"###{k.title()}: {v.strip()}\n" for k, v in info_dict(g.info).items()) + "\n"
    body = F.regexp_replace(text.sub(F.col("defi"), "\n", "<br/>"), "\r", "")
    write_lines(_words(g).withColumn("line", F.concat(text.join_bar(F.col("terms")), F.lit("\n"), body, F.lit("\n"))), path, head)


def dict_org_source(g: Glossary, path: str, remove_html_all: bool = True) -> None:
    """``:word:definition`` text."""
    from ..operators.filters import remove_html_all as strip

    rows = strip(_words(g)) if remove_html_all else _words(g)
    write_lines(rows.withColumn("line", F.concat(F.lit(":"), text.sub(headword(), ":", "\\:"), F.lit(":"), "defi", F.lit("\n"))), path)


def gettext_po(g: Glossary, path: str) -> None:
    quote = lambda c: F.concat(F.lit('"'), text.sub(text.sub(text.sub(text.sub(c, "\\", "\\\\"), '"', '\\"'), "\r", ""), "\n", "\\n"), F.lit('"'))
    fields = "".join(f'"{k}: {_escape(v).replace(chr(34), chr(92) + chr(34))}\\n"\n' for k, v in info_dict(g.info).items())
    from ..operators.filters import prevent_duplicate_terms

    rows = prevent_duplicate_terms(_words(g)).withColumn("line", F.concat(F.lit("msgid "), quote(s_term()), F.lit("\nmsgstr "), quote(F.col("defi")), F.lit("\n")))
    write_lines(rows, path, f'msgid ""\nmsgstr ""\n{fields}\n')


def kobo_dictfile(g: Glossary, path: str) -> None:
    alts = F.array_join(F.transform(F.slice("terms", 2, F.greatest(F.size("terms"), F.lit(1))), lambda t: F.concat(F.lit("& "), t, F.lit("\n"))), "")
    body = F.when(F.col("defi_format") == "h", F.concat(F.lit("<html>"), text.sub(F.col("defi"), "\n", " "))).otherwise(F.regexp_replace("defi", r"(?m)^([@&:])", " $1"))
    write_lines(_words(g).withColumn("line", F.concat(F.lit("@ "), headword(), F.lit("\n"), alts, body, F.lit("\n"))), path)


def sql(g: Glossary, path: str, info_keys: tuple[str, ...] = ("dbname", "author", "version", "direction", "origLang", "destLang", "license", "category", "description"), add_extra_info: bool = True, newline: str = "<br>", transaction: bool = False) -> None:
    """A script that makes word(id, w, m) and alt(id, w)."""
    fix = lambda c: text.sub(text.sub(text.sub(c, "'", "''"), "\r", ""), "\n", newline)
    plain = lambda s: s.replace("'", "''").replace("\0", "").replace("\r", "").replace("\n", newline)
    from ..model import INFO_ALIASES

    have = info_dict(g.info)
    canonical = {k: INFO_ALIASES.get(k.lower(), k) for k in info_keys}
    values = {k: plain(have.get(c, "")) for k, c in canonical.items()}
    head = "CREATE TABLE dbinfo (" + ", ".join(f"{k} char({len(v)})" for k, v in values.items()) + ");\n"
    if add_extra_info:
        head += "CREATE TABLE dbinfo_extra ('id' INTEGER PRIMARY KEY NOT NULL, 'name' TEXT UNIQUE, 'value' TEXT);\n"
    head += "CREATE TABLE word ('id' INTEGER PRIMARY KEY NOT NULL, 'w' TEXT, 'm' TEXT);\nCREATE TABLE alt ('id' INTEGER NOT NULL, 'w' TEXT);\n"
    head += ("BEGIN TRANSACTION;\n" if transaction else "") + "INSERT INTO dbinfo VALUES(" + ",".join(f"'{v}'" for v in values.values()) + ");\n"
    if add_extra_info:
        extra = [(k, v) for k, v in have.items() if k not in canonical.values()]
        head += "".join(f"INSERT INTO dbinfo_extra VALUES({n}, '{plain(k)}', '{plain(v)}');\n" for n, (k, v) in enumerate(extra, 1))
    number = F.col("id").cast("string")
    alts = F.transform(F.slice("terms", 2, F.greatest(F.size("terms"), F.lit(1))), lambda t: F.concat(F.lit("\nINSERT INTO alt VALUES("), number, F.lit(", '"), fix(t), F.lit("');")))
    line = F.concat(F.lit("INSERT INTO word VALUES("), number, F.lit(", '"), fix(headword()), F.lit("', '"), fix(F.col("defi")), F.lit("');"), F.array_join(alts, ""))
    tail = ("END TRANSACTION;\n" if transaction else "") + "".join(f"CREATE INDEX ix_{t}_{c} ON {t}({c} COLLATE NOCASE);\n" for t, c in (("word", "w"), ("alt", "id"), ("alt", "w")))
    write_lines(ordered.numbered(_words(g), "id").withColumn("line", line), path, head, tail)


def info_json(g: Glossary, path: str) -> None:
    """Metadata and statistics as JSON."""
    rows = info_dict(g.info) | profile.profile(g.entries)
    spark = g.entries.sparkSession
    write_lines(spark.createDataFrame([(0, 0, json.dumps(rows, ensure_ascii=False, indent="\t"))], "part int, seq long, line string"), path)


def stardict_textual(g: Glossary, path: str) -> None:
    esc = text.xml_escape
    alts = F.array_join(F.transform(F.slice("terms", 2, F.greatest(F.size("terms"), F.lit(1))), lambda t: F.concat(F.lit("<synonym>"), esc(t), F.lit("</synonym>\n"))), "")
    line = F.concat(F.lit("<article>\n<key>"), esc(headword()), F.lit("</key>\n"), alts, F.lit('<definition type="'), "defi_format", F.lit('">'), esc(F.col("defi")), F.lit("</definition>\n</article>"))
    shown = {"bookname" if k == "name" else k: v.replace("&", "&amp;").replace("<", "&lt;") for k, v in info_dict(g.info).items()}
    head = '<?xml version="1.0" encoding="UTF-8" ?>\n<stardict xmlns:xi="http://www.w3.org/2003/XInclude">\n<info>\n' + "".join(f"<{k}>{v}</{k}>\n" for k, v in shown.items() if k.isidentifier()) + "</info>\n"
    write_lines(_words(g).withColumn("line", line), path, head, "</stardict>\n")


def ebook_groups(df: DataFrame, prefix: Column) -> DataFrame:
    """``island`` of consecutive entries with one prefix (entries come sorted by it)."""
    return ordered.islands(df.withColumn("prefix", prefix), F.col("prefix"), "island")

