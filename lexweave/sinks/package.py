"""Sinks that are containers: their places and groups are computed in Spark, their bytes are streamed in order.

A container is one file by nature, so one writer streams sorted rows
(``toLocalIterator``: one partition at a time) to a local path.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import json
import os
import sqlite3
import struct
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..model import Glossary, headword, info_dict, s_term
from ..operators import ordered, relational
from ..operators.sortkeys import dicformids_key, ebook_prefix
from ..sources.formats import number_b64, xdxf_html

FIXED_TIME = (1980, 1, 1, 0, 0, 0)


def _rows(df: DataFrame, *order):
    return df.orderBy(*order).toLocalIterator(prefetchPartitions=True)


def _zip(path: str, files) -> None:
    """Reproducible: fixed times, given order."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            z.writestr(zipfile.ZipInfo(name, FIXED_TIME), content, zipfile.ZIP_DEFLATED)


def _resources(g: Glossary):
    return _rows(g.entries.filter("is_data").select("part", "seq", "fname", "data"), "part", "seq")


def _safe(folder: str, name: str) -> str | None:
    """A path inside ``folder``, or None for names that lead out of it."""
    path = os.path.normpath(os.path.join(folder, name))
    return path if not os.path.isabs(name) and path.startswith(os.path.normpath(folder) + os.sep) else None


def save_resources(g: Glossary, folder: str) -> None:
    for r in _resources(g):
        path = _safe(folder, r["fname"] or "")
        if path:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(r["data"] or b"")


def same_type(df: DataFrame, sample: int = 100) -> str | None:
    """The one definition type to declare: plain if nearly all are, HTML if most are, else none."""
    share = {r["defi_format"]: r["n"] for r in df.orderBy("part", "seq").limit(sample).groupBy("defi_format").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values()) or 1
    return "m" if share.get("m", 0) / total > 0.97 else "h" if share.get("h", 0) / total > 0.5 else None


def stardict(g: Glossary, path: str, large_file: bool = False, merge_syns: bool = False, sametypesequence: str | None = None, compress: bool = False) -> None:
    """ifo, idx, dict and syn.  Offsets are running sums; every alternate points to its entry's number."""
    base = path.removesuffix(".ifo")
    words = g.entries.filter("not is_data")
    kind = sametypesequence or same_type(words)
    block = F.col("defi").cast("binary") if kind else F.concat(F.col("defi_format").cast("binary"), F.col("defi").cast("binary"), F.lit(b"\0").cast("binary"))
    placed = relational.byte_offsets(ordered.numbered(words, "number").withColumn("block", block), F.octet_length(F.col("block")))
    form = ">QI" if large_file else ">II"
    opener = gzip.open if compress else open
    with opener(f"{base}.dict" + ".dz" * compress, "wb") as out:
        for r in _rows(placed.select("part", "seq", "block"), "part", "seq"):
            out.write(r["block"])
    key = placed.select("part", "seq", F.posexplode("terms").alias("k", "term"), "offset", "size", (F.col("number") - 1).alias("number"))
    order = [text.ascii_lower(F.col("term")), F.col("term"), "part", "seq", "k"]
    indexed = key if merge_syns else key.filter("k = 0")
    n = n_syn = n_bytes = 0
    with open(f"{base}.idx", "wb") as out:
        for r in _rows(indexed, *(order if merge_syns else ("part", "seq"))):
            n_bytes += out.write(r["term"].encode() + b"\0" + struct.pack(form, r["offset"], r["size"]))
            n += 1
    if not merge_syns:
        with open(f"{base}.syn", "wb") as out:
            for r in _rows(key.filter("k > 0"), *order):
                out.write(r["term"].encode() + b"\0" + struct.pack(">I", r["number"]))
                n_syn += 1
        if not n_syn:
            os.remove(f"{base}.syn")
    have = info_dict(g.info)
    name = have.pop("name", os.path.basename(base)).replace("\n", " ")
    lines = ["StarDict's dict ifo file", "version=3.0.0", f"bookname={name}", f"wordcount={n}", f"idxfilesize={n_bytes}"]
    lines += [f"sametypesequence={kind}"] * bool(kind) + ["idxoffsetbits=64"] * large_file + [f"synwordcount={n_syn}"] * bool(n_syn)
    lines += [f"{k}={v.replace(chr(10), ' ')}" for k, v in have.items() if k in ("author", "email", "website", "description", "date", "creationTime")]
    with open(f"{base}.ifo", "w", encoding="utf-8") as out:
        out.write("\n".join(lines) + "\n")
    save_resources(g, os.path.join(os.path.dirname(base) or ".", "res"))


def dictd(g: Glossary, path: str) -> None:
    """index sorted as ``sort -df`` does, and data."""
    base = path.removesuffix(".index")
    placed = relational.byte_offsets(g.entries.filter("not is_data").withColumn("block", F.concat(F.col("defi"), F.lit("\n"))), F.octet_length("block"))
    with open(f"{base}.dict", "w", encoding="utf-8") as out:
        for r in _rows(placed.select("part", "seq", "block"), "part", "seq"):
            out.write(r["block"])
    plain = F.upper(F.regexp_replace("term", "[^A-Za-z0-9 ]", ""))
    rows = placed.select(F.explode("terms").alias("term"), "offset", "size").withColumn("k", plain)
    with open(f"{base}.index", "w", encoding="utf-8") as out:
        for r in _rows(rows, "k", F.upper("term"), "offset"):
            out.write(f"{r['term']}\t{number_b64(r['offset'])}\t{number_b64(r['size'])}\n")


def ayandict_sqlite(g: Glossary, path: str, fuzzy: bool = True) -> None:
    """SQLite with meta, entry, alt and a three-letter index; a digest over the ordered keys."""
    rows = relational.sequential_ids(g.entries)
    con = sqlite3.connect(path)
    con.executescript("create table meta(key text primary key not null, value text); create table entry(id integer primary key not null, term text, article text); create table alt(id integer not null, term text); create table fuzzy3(sub text not null, term text not null, id integer not null);")
    digest = hashlib.md5()
    for r in _rows(rows.withColumn("key", s_term()), "id"):
        defi = r["defi"]
        if r["defi_format"] == "m" and "\n" in defi:
            defi = f"<pre>{defi}</pre>"
        elif r["defi_format"] == "x":
            defi = xdxf_html(defi)
        con.execute("insert into entry values(?, ?, ?)", (r["id"], r["terms"][0], defi))
        con.executemany("insert into alt values(?, ?)", [(r["id"], t) for t in r["terms"][1:]])
        digest.update(r["key"].encode())
    if fuzzy:
        grams = rows.select("id", F.posexplode("terms").alias("k", "term")).select("id", "k", "term", F.posexplode(text.trigrams(F.col("term"))).alias("g", "sub"))
        con.executemany("insert into fuzzy3 values(?, ?, ?)", ((r["sub"], r["term"], r["id"]) for r in _rows(grams, "id", "k", "g")))
    con.executemany("insert into meta values(?, ?)", [*info_dict(g.info).items(), ("hash", digest.hexdigest())])
    con.executescript("create index idx_entry_term on entry(term collate nocase); create index idx_alt_id on alt(id); create index idx_alt_term on alt(term collate nocase); create index idx_fuzzy3_sub on fuzzy3(sub collate nocase);")
    con.commit()
    con.close()


def edlin(g: Glossary, folder: str, prev_link: bool = True) -> None:
    """A file per entry, linked to the one before and after; equal hashes get a hex number."""
    words = g.entries.filter("not is_data").withColumn("hash", F.substring(F.sha1(s_term().cast("binary")), 1, 8))
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("hash").orderBy("part", "seq"))
    named = words.withColumn("file", F.when(n == 1, F.col("hash")).otherwise(F.concat("hash", F.lower(F.hex(n - 2)))))
    path = F.concat(F.substring("file", 1, 2), F.lit("/"), F.substring("file", 3, 64))
    linked = ordered.neighbours(named.withColumn("at", path), F.col("at"), "before", "after")
    os.makedirs(folder, exist_ok=True)
    root, count = "", 0
    for r in _rows(linked.withColumn("key", text.escape_ntb(s_term())), "part", "seq"):
        root, count = root or r["at"], count + 1
        os.makedirs(os.path.join(folder, os.path.dirname(r["at"])), exist_ok=True)
        links = ([r["before"] or "START"] if prev_link else []) + [r["after"] or "END"]
        with open(os.path.join(folder, r["at"]), "w", encoding="utf-8") as out:
            out.write("\n".join((" ".join(links), r["key"], r["defi"])))
    with open(os.path.join(folder, "info.json"), "w", encoding="utf-8") as out:
        json.dump(info_dict(g.info) | {"root": root, "wordCount": count, "prev_link": prev_link}, out, ensure_ascii=False, indent="\t")


def crawler(g: Glossary, folder: str, compression: str = "") -> None:
    """A file per entry under hex shards of its key; a second entry with such a file adds a digest of its definition."""
    from ..plans.compress import OPEN

    opened = OPEN[compression or "plain"]
    os.makedirs(folder, exist_ok=True)
    count = 0
    for r in _rows(g.entries.filter("not is_data").withColumn("head", F.array_join(F.transform("terms", lambda t: text.escape_ntb(t, bar=True)), "|")).withColumn("at", text.shard_path(s_term())), "part", "seq"):
        path, ending, count = os.path.join(folder, r["at"]), f".{compression}" if compression else "", count + 1
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if os.path.exists(path + ending):
            path += "-" + hashlib.sha1(r["defi"].encode()).hexdigest()[:4]
        path += ending
        with opened(path, "wt", encoding="utf-8") as out:
            out.write(r["head"] + "\n" + r["defi"])
    save_resources(g, os.path.join(folder, "res"))
    with open(os.path.join(folder, "info.json"), "w", encoding="utf-8") as out:
        json.dump({"name": "", "wordCount": count} | info_dict(g.info), out, ensure_ascii=False, indent="\t")


def yomichan(g: Glossary, path: str, term_bank_size: int = 10_000) -> None:
    """A zip of term banks; every term of an entry is a row, a bank ends at an entry's end."""
    have = info_dict(g.info)
    index = {"title": have.get("name", ""), "format": 3, "revision": have.get("version", "1"), "sequenced": True} | {k: have[k] for k in ("author", "url", "description", "attribution") if k in have}

    def banks():
        yield "index.json", json.dumps(index, ensure_ascii=False)
        bank, number = [], 0
        for n, r in enumerate(_rows(g.entries.filter("not is_data"), "part", "seq"), 1):
            bank += [[t, "", "", "", 0, [r["defi"]], n, ""] for t in r["terms"]]
            if len(bank) >= term_bank_size:
                number += 1
                yield f"term_bank_{number}.json", json.dumps(bank, ensure_ascii=False)
                bank = []
        if bank:
            yield f"term_bank_{number + 1}.json", json.dumps(bank, ensure_ascii=False)
        for r in _resources(g):
            yield r["fname"], bytes(r["data"] or b"")

    _zip(path, banks())


PAGE = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{title}</title></head><body>\n{body}\n</body></html>\n'


def _grouped(g: Glossary, prefix):
    """(label, entries) of consecutive entries with one prefix, in order."""
    now, batch = None, []
    for r in _rows(g.entries.filter("not is_data").withColumn("prefix", prefix), "part", "seq"):
        if batch and r["prefix"] != now:
            yield now, batch
            batch = []
        now = r["prefix"]
        batch.append(r)
    if batch:
        yield now, batch


def epub2(g: Glossary, path: str, group_by_prefix_length: int = 2, include_index_page: bool = False) -> None:
    """An e-book: a page per group of entries, table of contents, package file."""
    title = html.escape(info_dict(g.info).get("name", "Dictionary"))

    def files():
        yield "mimetype", "application/epub+zip"
        yield "META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
        names = []
        for k, (label, rows) in enumerate(_grouped(g, ebook_prefix(headword(), group_by_prefix_length))):
            body = "".join(f'<div class="entry"><b>{html.escape(", ".join(r["terms"]))}</b><br/>{r["defi"] if r["defi_format"] == "h" else html.escape(r["defi"])}</div>\n' for r in rows)
            names.append((f"g{k:06d}.xhtml", label, f"{rows[0]['terms'][0]} - {rows[-1]['terms'][0]}"))
            yield f"OEBPS/{names[-1][0]}", PAGE.format(title=html.escape(label), body=body)
        if include_index_page:
            yield "OEBPS/index.xhtml", PAGE.format(title="Index", body="".join(f'<a href="{n}">{html.escape(shown)}</a><br/>' for n, _, shown in names))
        points = "".join(f'<navPoint id="n{k}" playOrder="{k + 1}"><navLabel><text>{html.escape(shown)}</text></navLabel><content src="{n}"/></navPoint>' for k, (n, _, shown) in enumerate(names))
        yield "OEBPS/toc.ncx", f'<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{title}</text></docTitle><navMap>{points}</navMap></ncx>'
        items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, (n, _, _) in enumerate(names))
        spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(names)))
        yield "OEBPS/content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title><dc:identifier id="uid">{hashlib.md5(title.encode()).hexdigest()}</dc:identifier><dc:language>en</dc:language></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>'

    _zip(path, files())


def kobo(g: Glossary, path: str) -> None:
    """A zip with a gzipped page per prefix; an entry is on the page of each prefix that its terms have."""
    rows = g.entries.filter("not is_data").select("part", "seq", "terms", "defi", F.explode(F.array_distinct(F.transform("terms", relational.kobo_prefix))).alias("prefix"))

    def files():
        now, out = None, []
        for r in _rows(rows, "prefix", "part", "seq"):
            if out and r["prefix"] != now:
                yield f"{now}.html", gzip.compress(("<?xml version=\"1.0\" encoding=\"utf-8\"?><html>" + "".join(out) + "</html>").encode(), mtime=0)
                out = []
            now = r["prefix"]
            variants = "".join(f'<variant name="{html.escape(t.lower())}"/>' for t in r["terms"][1:])
            out.append(f'<w><p><a name="{html.escape(r["terms"][0])}" /><b>{html.escape(", ".join(r["terms"]))}</b><br/>{r["defi"]}<var>{variants}</var></p></w>')
        if out:
            yield f"{now}.html", gzip.compress(("<?xml version=\"1.0\" encoding=\"utf-8\"?><html>" + "".join(out) + "</html>").encode(), mtime=0)
        yield "words.txt", "".join(r["term"] + "\n" for r in _rows(g.entries.filter("not is_data").select(F.explode("terms").alias("term")).distinct(), "term"))

    _zip(path, files())


def html_dir(g: Glossary, folder: str, max_file_size: int = 102_400, word_title: bool = True) -> None:
    """Pages by size, an index of terms, and links resolved to the first page that has the target, else marked broken."""
    words = g.entries.filter("not is_data")
    paged = relational.size_parts(words, F.octet_length("defi") + 100, max_file_size)
    paged = ordered.numbered(paged, "number").withColumnRenamed("file_part", "page")
    index = paged.select(F.explode("terms").alias("term"), "page", F.col("number").alias("at"))
    links = paged.select("seq", F.explode(F.array_distinct(F.regexp_extract_all("defi", F.lit('href="bword://([^"]*)"'), F.lit(1)))).alias("target"))
    found = relational.resolve_links(links, index).groupBy("seq").agg(F.collect_list(F.struct("target", "page", "target_at", "broken")).alias("links"))
    os.makedirs(folder, exist_ok=True)
    out, now = None, None
    for r in _rows(paged.join(found, "seq", "left"), "part", "seq"):
        if r["page"] != now:
            if out:
                out.write("</body></html>\n")
                out.close()
            now, out = r["page"], open(os.path.join(folder, f"{r['page']:05d}.html"), "w", encoding="utf-8")
            out.write("<!DOCTYPE html><html><head><meta charset=\"utf-8\"></head><body>\n")
        defi = r["defi"]
        for link in r["links"] or ():
            to = 'class="broken" href="#"' if link["broken"] else f'href="{link["page"]:05d}.html#entry-{link["target_at"]}"'
            defi = defi.replace(f'href="bword://{link["target"]}"', to)
        title = f"<b>{html.escape(' | '.join(r['terms']))}</b><br>\n" if word_title else ""
        out.write(f'<div id="entry-{r["number"]}">{title}{defi}</div>\n<hr>\n')
    if out:
        out.write("</body></html>\n")
        out.close()
    with open(os.path.join(folder, "index.txt"), "w", encoding="utf-8") as f:
        for r in _rows(index, "at", "term"):
            f.write(f"{r['term']}\t{r['page']:05d}.html#entry-{r['at']}\n")
    save_resources(g, os.path.join(folder, "res"))


def dicformids(g: Glossary, folder: str, rows: int = 500) -> None:
    """Directory files of 500 entries and an index of normalised keys with file and byte position."""
    words = relational.buckets(g.entries.filter("not is_data"), rows)
    os.makedirs(folder, exist_ok=True)
    line = F.concat(F.array_join("terms", "; "), F.lit("\t"), text.sub(text.sub(F.col("defi"), "\t", " "), "\n", "\\n"), F.lit("\n"))
    now, out, place = None, None, 0
    index = open(os.path.join(folder, "index1.csv"), "w", encoding="utf-8")
    for r in _rows(words.withColumn("line", line).withColumn("key", dicformids_key(headword())), "part", "seq"):
        if r["bucket"] != now:
            if out:
                out.close()
            now, place = r["bucket"], 0
            out = open(os.path.join(folder, f"directory{now + 1}.csv"), "w", encoding="utf-8")
        index.write(f"{r['key']}\t{now + 1}-{place}-B\n")
        out.write(r["line"])
        place += len(r["line"].encode())
    if out:
        out.close()
    index.close()
    with open(os.path.join(folder, "DictionaryForMIDs.properties"), "w", encoding="utf-8") as f:
        f.write("infoText=" + info_dict(g.info).get("name", "") + "\ndictionaryFileSeparationCharacter='\\t'\nnumberOfIndexFiles=1\n")


def apple_source(g: Glossary, path: str) -> None:
    """XML of entries with their index values."""
    ids = relational.sequential_ids(g.entries)
    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<d:dictionary xmlns="http://www.w3.org/1999/xhtml" xmlns:d="http://www.apple.com/DTDs/DictionaryService-1.0.rng">\n')
        for r in _rows(ids, "id"):
            name = html.escape(r["terms"][0])
            body = r["defi"] if r["defi_format"] == "h" else html.escape(r["defi"])
            out.write(f'<d:entry id="_{r["id"]:x}" d:title="{name}">' + "".join(f'<d:index d:value="{html.escape(t)}" d:title="{html.escape(t)}"/>' for t in r["terms"]) + f"<h1>{name}</h1>{body}</d:entry>\n")
        out.write("</d:dictionary>\n")


def mobi_source(g: Glossary, folder: str, group_bytes: int = 271_360) -> None:
    """The pages and package file that an e-book compiler takes: groups bounded by size, inflections per entry."""
    os.makedirs(folder, exist_ok=True)
    names, out, used = [], [], 0

    def page():
        names.append(f"g{len(names):06d}.xhtml")
        with open(os.path.join(folder, names[-1]), "w", encoding="utf-8") as f:
            f.write('<html xmlns:idx="http://www.mobipocket.com/idx"><body><mbp:frameset>' + "".join(out) + "</mbp:frameset></body></html>\n")

    for r in _rows(g.entries.filter("not is_data"), "part", "seq"):
        forms = "".join(f'<idx:iform value="{html.escape(t)}"/>' for t in r["terms"][1:])
        item = f'<idx:entry name="word" scriptable="yes" spell="yes"><idx:orth value="{html.escape(r["terms"][0])}"><b>{html.escape(r["terms"][0])}</b>' + (f"<idx:infl>{forms}</idx:infl>" if forms else "") + f"</idx:orth><br/>{r['defi']}</idx:entry><hr/>\n"
        if out and used + len(item.encode()) > group_bytes:
            page()
            out, used = [], 0
        out.append(item)
        used += len(item.encode())
    if out:
        page()
    with open(os.path.join(folder, "content.opf"), "w", encoding="utf-8") as f:
        f.write("<package><manifest>" + "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names)) + "</manifest><spine>" + "".join(f'<itemref idref="i{k}"/>' for k in range(len(names))) + "</spine></package>")
