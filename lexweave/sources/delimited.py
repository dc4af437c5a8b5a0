"""Line formats that Spark scans in splits: tab files, CSV, blank-line blocks, CEDICT lines, JSON lines, frequency tables."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import chinese, text
from ..model import Glossary, info_table
from .base import as_entries, decoded, entry, header_rows, info, no_info, numbered_lines, resource
from .bundles import existing


def resources_of(spark: SparkSession, path: str):
    """Files of ``<path>_res``, if there is such a folder."""
    folder = f"{path}_res"
    jvm, p = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", f".*{folder.rpartition('/')[2].replace('.', '[.]')}/(.*)$", 1)
    return files.select(F.lit(1 << 62).alias("seq"), F.lit(0).alias("part"), F.array(name).alias("terms"), F.concat(F.lit("File: "), name).alias("defi"), F.lit("b").alias("defi_format"), F.lit(True).alias("is_data"), name.alias("fname"), F.col("content").alias("data"))


def more_parts(spark: SparkSession, path: str, count: int) -> list[str]:
    """``path.1``, ``path.2``, … (or compressed): ``count`` files with ``path`` itself, all that are there if it is -1."""
    found: list[str] = []
    while count == -1 or len(found) + 1 < count:
        name = f"{path}.{len(found) + 1}"
        file = existing(spark, [name, f"{name}.gz", f"{name}.bz2"])[:1]
        if not file:
            break
        found += file
    return found


def read_tabfile(spark: SparkSession, path: str, alternates: bool = True, skip_resources: bool = False) -> Glossary:
    """``term|alternate<TAB>definition`` with escapes; leading ``##key<TAB>value`` rows are metadata.

    ``file_count`` there says how many files the glossary has."""
    cut = F.split("value", "\t", 2)

    def cells(file: str):
        rows = numbered_lines(spark, file).withColumn("value", F.regexp_replace("value", "\r$", "")).filter(F.col("value").contains("\t"))
        return rows.select("seq", F.get(cut, F.lit(0)).alias("t"), F.get(cut, F.lit(1)).alias("d"))

    head, body = header_rows(cells(path), F.col("t").startswith("#"))
    meta = [(r["k"], r["v"]) for r in head.orderBy("seq").select(F.regexp_replace("t", "^#+", "").alias("k"), text.unescape_ntb(F.col("d")).alias("v")).collect()]
    count = dict(meta).get("file_count") or "1"
    meta = [(k, v) for k, v in meta if k != "file_count"]
    body = body.withColumn("part", F.lit(0))
    for k, file in enumerate(more_parts(spark, path, int(count)), 1):
        body = body.unionByName(cells(file).withColumn("part", F.lit(k)))
    terms = text.split_bar_unescape_ntb(F.col("t")) if alternates else F.array(text.unescape_ntb(F.col("t"), bar=True))
    entries = as_entries(body.select("seq", "part", terms.alias("terms"), text.unescape_ntb(F.col("d")).alias("defi")))
    extra = None if skip_resources else resources_of(spark, path)
    return Glossary(entries.unionByName(extra) if extra is not None else entries, info_table(spark, meta))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> Glossary:
    """term, definition, comma-joined alternates; leading ``#key`` rows are metadata."""
    rows = spark.read.csv(path, sep=delimiter, quote='"', escape='"', multiLine=True, encoding=encoding, schema="t string, d string, a string", mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)
    rows = rows.withColumn("seq", F.monotonically_increasing_id())  # a quoted file is one split, so this is its order
    head, body = header_rows(rows, F.coalesce(F.col("t").startswith("#"), F.lit(False)))
    meta = [(r["t"].lstrip("#"), r["d"] or "") for r in head.orderBy("seq").collect()]
    alts = F.when(F.col("a").isNull(), F.array().cast("array<string>")).otherwise(F.split("a", ","))
    body = body.filter("t is not null and d is not null")
    return Glossary(as_entries(body.select("seq", F.concat(F.array("t"), alts).alias("terms"), F.col("d").alias("defi"))), info_table(spark, meta))


def read_ldf(spark: SparkSession, path: str) -> Glossary:
    """Blocks between blank lines: terms, then the definition; ``###key: value`` lines are metadata."""
    rows = numbered_lines(spark, path, "\n\n").withColumn("lines", F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: x != ""))
    keys = rows.select("seq", F.posexplode("lines").alias("k", "line")).filter(F.col("line").startswith("###")).orderBy("seq", "k")
    meta = [(k.lstrip("#").strip().lower(), v.strip()) for k, _, v in (r["line"].partition(":") for r in keys.select("line").collect())]
    body = rows.withColumn("lines", F.filter("lines", lambda x: ~x.startswith("###"))).filter(F.size("lines") >= 2)
    defi = F.regexp_replace(F.array_join(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), "\n"), "<(br|BR)/?>", "\n")
    return Glossary(as_entries(body.select("seq", text.split_bar(F.get("lines", F.lit(0))).alias("terms"), defi.alias("defi"))), info_table(spark, meta))


CEDICT = r"^([^ ]+) ([^ ]+) \[([^\]]+)\] /(.+)/\r?$"


def read_cedict(spark: SparkSession, path: str, traditional_title: bool = False, colorize_tones: bool = True, summary_alternatives: bool = False) -> Glossary:
    """``traditional simplified [pinyin] /definition/…/`` lines; with ``summary_alternatives`` the pinyin and short glosses are terms too."""
    rows = numbered_lines(spark, path).filter(~F.col("value").startswith("#") & F.col("value").rlike(CEDICT))
    part = lambda k: F.regexp_extract("value", CEDICT, k)
    order = (1, 2) if traditional_title else (2, 1)
    rows = rows.select("seq", F.array_distinct(F.array(*map(part, order))).alias("names"), F.replace(part(3), F.lit("u:"), F.lit("ü")).alias("pinyin"), F.split(part(4), "/").alias("glosses"))
    spoken = F.filter(F.split("pinyin", r"\s+"), lambda s: s != "")
    rows = rows.withColumns({"syllables": F.transform(spoken, chinese.with_tone_mark), "tones": F.transform(spoken, chinese.tone)})
    written = F.transform("names", lambda name: chinese.syllables_html(F.split(name, ""), F.col("tones"), colorize_tones))
    head = F.concat(F.lit("<div><big>"), F.get(written, F.lit(0)), F.lit("</big>"), F.when(F.size("names") > 1, F.concat(F.lit("\xa0/\xa0"), F.get(written, F.lit(1)))).otherwise(""))
    head = F.concat(head, F.lit("<br><big>"), chinese.syllables_html(F.col("syllables"), F.col("tones"), colorize_tones), F.lit("</big></div>"))
    items = F.array_join(F.transform("glosses", lambda d: F.concat(F.lit("<li>"), text.xml_escape(d, quote=False), F.lit("</li>"))), "")
    defi = F.concat(F.lit('<div style="border: 1px solid; padding: 5px">'), head, F.lit("<div><ul>"), items, F.lit("</ul></div></div>"))
    terms = F.concat("names", F.array("pinyin"), F.transform("glosses", chinese.summary)) if summary_alternatives else F.col("names")
    return Glossary(as_entries(rows.select("seq", terms.alias("terms"), defi.alias("defi"), F.lit("h").alias("defi_format"))), no_info(spark))


WIKI = "word string, pos string, etymology_text string, forms array<struct<form:string,source:string,tags:array<string>>>, senses array<struct<glosses:array<string>,raw_glosses:array<string>,tags:array<string>,form_of:array<struct<word:string>>>>, sounds array<struct<ipa:string>>, synonyms array<struct<word:string>>, antonyms array<struct<word:string>>"
LONGEST_FORM = 80


def read_wiktextract(spark: SparkSession, path: str) -> Glossary:
    """JSON lines of extracted articles: forms become terms (inflections last), senses an ordered list."""
    rows = numbered_lines(spark, path).select("seq", F.from_json("value", WIKI).alias("j")).filter("j.word is not null").select("seq", "j.*")
    forms = F.filter(F.coalesce("forms", F.expr("array()").cast("array<struct<form:string,source:string,tags:array<string>>>")), lambda f: F.length(f["form"]) <= LONGEST_FORM)
    late = lambda f: F.coalesce(f["source"] == "Inflection", F.lit(False))
    pick = lambda want: F.transform(F.filter(forms, lambda f: late(f) == F.lit(want)), lambda f: f["form"])
    of = F.flatten(F.transform(F.coalesce("senses", F.expr("array()").cast("array<struct<glosses:array<string>,raw_glosses:array<string>,tags:array<string>,form_of:array<struct<word:string>>>>")), lambda s: F.coalesce(F.transform(s["form_of"], lambda x: x["word"]), F.array().cast("array<string>"))))
    terms = F.array_distinct(F.concat(F.array("word"), pick(False), of, pick(True)))
    gloss = lambda s: F.array_join(F.coalesce(s["raw_glosses"], s["glosses"], F.array().cast("array<string>")), "; ")
    sense = lambda s: F.concat(F.lit("<li>"), F.when(F.size(s["tags"]) > 0, F.concat(F.lit("("), F.array_join(s["tags"], ", "), F.lit(") "))).otherwise(""), text.xml_escape(gloss(s)), F.lit("</li>"))
    words = lambda c, name: F.when(F.size(c) > 0, F.concat(F.lit(f"<div>{name}: "), text.xml_escape(F.array_join(F.transform(c, lambda x: x["word"]), ", ")), F.lit("</div>"))).otherwise("")
    ipa = F.array_join(F.transform(F.filter("sounds", lambda x: x["ipa"].isNotNull()), lambda x: x["ipa"]), ", ")
    defi = F.concat(
        F.when(F.col("pos").isNotNull(), F.concat(F.lit("<i>"), "pos", F.lit("</i>"))).otherwise(""), F.when(F.length(ipa) > 0, F.concat(F.lit("<div>"), text.xml_escape(ipa), F.lit("</div>"))).otherwise(""),
        F.lit("<ol>"), F.coalesce(F.array_join(F.transform("senses", sense), ""), F.lit("")), F.lit("</ol>"), words(F.col("synonyms"), "Synonyms"), words(F.col("antonyms"), "Antonyms"),
        F.when(F.length("etymology_text") > 0, F.concat(F.lit("<div>Etymology: "), text.xml_escape(F.col("etymology_text")), F.lit("</div>"))).otherwise(""),
    )
    return Glossary(as_entries(rows.select("seq", terms.alias("terms"), defi.alias("defi"), F.lit("h").alias("defi_format"))), no_info(spark))


def frequency_rows(name: str, content: bytes):
    """Tab-separated counts by genre under repeated header rows; genres by falling count."""
    columns: list[str] = []
    for line in content.decode("utf-8-sig", "replace").split("\n"):
        cells = [c.strip() for c in line.rstrip("\r").split("\t")]
        if not any(cells):
            continue
        if cells[0].lower() in ("rank", "word", "lemma"):
            columns = cells
            continue
        row = dict(zip(columns, cells, strict=False))
        word = row.get("word") or row.get("lemma")
        if not word:
            continue
        counts = [(int(v), k) for k, v in row.items() if k.lower() not in ("rank", "word", "lemma", "pos") and v.isdigit() and int(v) > 0]
        counts.sort(key=lambda c: -c[0])
        yield entry(word, f"<b>{row.get('PoS') or row.get('pos') or ''}</b><br/>" + "<br/>".join(f"{k}: {n}" for n, k in counts), "h")


def read_frequency(spark: SparkSession, path: str) -> Glossary:
    return decoded(spark, path, frequency_rows)


def info_rows(name: str, content: bytes):
    for key, value in json.loads(content).items():
        yield info(key, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def read_info(spark: SparkSession, path: str) -> Glossary:
    """Metadata alone."""
    return decoded(spark, path, info_rows)


def crawler_rows(name: str, content: bytes):
    if name.endswith(".json") or "/res/" in name:
        if name.endswith("info.json"):
            yield from info_rows(name, content)
        else:
            yield resource(name.rpartition("/res/")[2], content)
        return
    head, _, defi = content.decode("utf-8", "replace").partition("\n")
    from .formats import split_bar_ntb

    yield entry(split_bar_ntb(head), defi)


def read_crawler(spark: SparkSession, path: str) -> Glossary:
    """One file per entry: its first line holds the terms."""
    return decoded(spark, path, crawler_rows)
