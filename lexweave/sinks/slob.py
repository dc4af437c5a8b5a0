"""The Slob sink: bins are numbered by running sums and compressed in the executors; one writer joins them."""

from __future__ import annotations

import bz2
import lzma
import os
import re
import shutil
import struct
import tempfile
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..model import Glossary, info_dict
from ..operators import ordered, relational
from ..sources.containers import LZMA2, SLOB_MAGIC
from ..storage import stored

BIN_BYTES = 384 * 1024
#: Bytes an item counts at least, so that the items of a bin can be numbered with 16 bits.
ITEM_BYTES = 8
PACK = {"": bytes, "zlib": lambda b: zlib.compress(b, 9), "bz2": lambda b: bz2.compress(b, 9), "lzma2": lambda b: lzma.compress(b, lzma.FORMAT_RAW, filters=LZMA2)}

# Content types of resources by extension.
RESOURCE_TYPES = {
    "bmp": "image/bmp", "gif": "image/gif", "ico": "image/x-icon", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "svg": "image/svg+xml", "tif": "image/tiff",
    "tiff": "image/tiff", "webp": "image/webp", "css": "text/css", "ini": "text/plain", "js": "application/javascript", "json": "application/json", "woff": "application/font-woff",
    "woff2": "application/font-woff2", "ttf": "application/x-font-ttf", "otf": "application/x-font-opentype", "eot": "application/vnd.ms-fontobject", "pdf": "application/pdf",
    "mp3": "audio/mpeg", "ogg": "audio/ogg", "opus": "audio/ogg", "oga": "audio/ogg", "spx": "audio/x-speex", "wav": "audio/wav", "mp4": "video/mp4", "m4a": "audio/mp4", "m4b": "audio/mp4",
    "aac": "audio/aac", "webm": "audio/webm", "weba": "audio/webm",
}
HTML_TYPE, PLAIN_TYPE = "text/html; charset=utf-8", "text/plain; charset=utf-8"


def _web(defi: Column, audio_goldendict: bool) -> Column:
    """Links without ``bword://``, sounds that play by themselves, image paths without a root."""
    for quote in "\"'":
        defi = F.replace(defi, F.lit(f"{quote}bword://"), F.lit(quote))
        if not audio_goldendict:
            defi = F.replace(defi, F.lit(f"href={quote}sound://"), F.lit(f'onclick="new Audio(this.href).play(); return false;" href={quote}'))
            defi = F.replace(F.replace(defi, F.lit(f"<img src={quote}/"), F.lit(f"<img src={quote}")), F.lit(f"<img src={quote}file:///"), F.lit(f"<img src={quote}"))
    return defi


def blobs(df: DataFrame, content_type: str = "", separate_alternates: bool = False, word_title: bool = False, audio_goldendict: bool = False) -> DataFrame:
    """(part, seq, k, keys, kind, body): what goes into the archive; resources of unknown types stay out."""
    is_html = (F.col("defi_format") == "h") | (F.lit(word_title) & (F.col("defi_format") == "m"))
    title = F.concat(F.lit("<b>"), text.xml_escape(F.get("terms", F.lit(0))), F.lit("</b><br>")) if word_title else F.lit("")
    defi = F.when(is_html, _web(F.concat(title, F.col("defi")), audio_goldendict)).otherwise(F.col("defi"))
    kind = F.lit(content_type) if content_type else F.when(is_html, HTML_TYPE).otherwise(PLAIN_TYPE)
    words = df.filter(~F.col("is_data") & (F.size("terms") > 0)).select("part", "seq", "terms", kind.alias("kind"), defi.cast("binary").alias("body"))
    if separate_alternates:
        head = F.get("terms", F.lit(0))
        alts = F.transform(F.slice("terms", 2, F.size("terms")), lambda t: F.array(F.concat(t, F.lit(", "), head)))
        words = words.select("part", "seq", F.posexplode(F.concat(F.array(F.array(head)), alts)).alias("k", "keys"), "kind", "body")
    else:
        words = words.select("part", "seq", F.lit(0).alias("k"), F.col("terms").alias("keys"), "kind", "body")
    types = F.create_map(*[F.lit(x) for pair in RESOURCE_TYPES.items() for x in pair])
    files = df.filter("is_data").withColumn("kind", types[F.lower(F.regexp_extract("fname", r"\.([^./]*)$", 1))]).filter("kind is not null")
    return words.unionByName(files.select("part", "seq", F.lit(0).alias("k"), F.array("fname").alias("keys"), "kind", F.coalesce("data", F.lit(b"")).alias("body")))


def _bins(placed: DataFrame, types: list[str], compression: str) -> DataFrame:
    """(bin, block): each bin as it is in the file."""

    def packed(bin_: int, kinds: list[int], bodies: list[bytes]) -> tuple[int, bytes]:
        at, places = 0, []
        for body in bodies:
            places.append(at)
            at += 4 + len(body)
        raw = struct.pack(f">{len(places)}I", *places) + b"".join(struct.pack(">I", len(b)) + b for b in bodies)
        data = PACK[compression](raw)
        return bin_, struct.pack(">I", len(kinds)) + bytes(kinds) + struct.pack(">I", len(data)) + data

    def run(frames):
        now, kinds, bodies = None, [], []
        for pdf in frames:
            out = []
            for bin_, kind, body in zip(pdf["bin"], pdf["kind"], pdf["body"], strict=True):
                if bin_ != now and now is not None:
                    out.append(packed(now, kinds, bodies))
                    kinds, bodies = [], []
                now = bin_
                kinds.append(types.index(kind))
                bodies.append(bytes(body))
            yield pd.DataFrame(out, columns=["bin", "block"])
        if now is not None:
            yield pd.DataFrame([packed(now, kinds, bodies)], columns=["bin", "block"])

    rows = placed.select("bin", "item", "kind", "body").repartitionByRange("bin").sortWithinPartitions("bin", "item")
    return rows.mapInPandas(run, "bin long, block binary")


def _list(blocks, folder: str, name: str) -> str:
    """A file with a list: a count, places, items."""
    items, places, at, n = os.path.join(folder, f"{name}-items"), os.path.join(folder, f"{name}-places"), 0, 0
    with open(items, "wb") as body, open(places, "wb") as index:
        for block in blocks:
            index.write(struct.pack(">Q", at))
            at += body.write(block)
            n += 1
    path = os.path.join(folder, name)
    with open(path, "wb") as out:
        out.write(struct.pack(">I", n))
        for part in (places, items):
            with open(part, "rb") as source:
                shutil.copyfileobj(source, out)
    return path


def _string(value: str, width: str, pad: bool = False) -> bytes:
    raw = value.encode()
    most = (1 << 8 * struct.calcsize(width)) - 1
    if len(raw) > most:
        raw = raw[:most].decode("utf-8", "ignore").encode()
    return struct.pack(width, most) + raw.ljust(most, b"\0") if pad else struct.pack(width, len(raw)) + raw


def slob(g: Glossary, path: str, compression: str = "zlib", content_type: str = "", separate_alternates: bool = False, word_title: bool = False, audio_goldendict: bool = False) -> None:
    """One archive.  Keys are in Unicode collation order without punctuation and spaces, then with them, then by code point."""
    order = ("part", "seq", "k")
    rows = blobs(g.entries, content_type, separate_alternates, word_title, audio_goldendict)
    sized = ordered.running_total(rows, F.greatest(F.octet_length("body"), F.lit(0)).cast("long") + ITEM_BYTES, "_at", order)
    sized = sized.withColumn("bin", F.floor(F.col("_at") / BIN_BYTES).cast("long"))
    sized = stored(ordered.numbered(sized, "_n", order), "slob_blobs")
    # Bins may lack numbers where a blob is longer than a bin: they are numbered anew, with their first blob.
    firsts = ordered.numbered(sized.groupBy("bin").agg(F.min("_n").alias("_first")), "_b", ("bin",))
    placed = stored(sized.join(firsts, "bin").select("keys", "kind", "body", (F.col("_b") - 1).alias("bin"), (F.col("_n") - F.col("_first")).alias("item")), "slob_placed")
    types = sorted(r["kind"] for r in placed.select("kind").distinct().collect())  # at most the fixed types
    count = placed.count()
    keys = placed.select(F.explode("keys").alias("key"), "bin", "item")
    plain = F.regexp_replace("key", r"[\p{P}\p{Z}\s]", "")
    keys = keys.orderBy(F.collate(plain, "UNICODE"), F.collate("key", "UNICODE"), "key", "bin", "item")
    folder = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        refs = _list((_string(r["key"], ">H") + struct.pack(">IH", r["bin"], r["item"]) + b"\0" for r in keys.toLocalIterator(True)), folder, "refs")
        store = _list((bytes(r["block"]) for r in _bins(placed, types, compression).orderBy("bin").toLocalIterator(True)), folder, "store")
        have = info_dict(g.info)
        tags = {"label": have.get("name", ""), "created.at": have.get("creationTime"), "created.by": have.get("author"), "license.name": have.get("copyright")}
        tags = {k: v for k, v in tags.items() if v is not None} | {"uri": re.sub(r"[^A-Za-z0-9_-]+", "_", os.path.basename(path))}
        head = SLOB_MAGIC + uuid.uuid4().bytes + _string("utf-8", ">B") + _string(compression, ">B")
        head += bytes([len(tags)]) + b"".join(_string(k, ">B") + _string(v, ">B", pad=True) for k, v in tags.items())
        head += bytes([len(types)]) + b"".join(_string(t, ">H") for t in types)
        store_at = len(head) + 4 + 8 + 8 + os.path.getsize(refs)
        with open(path, "wb") as out:
            out.write(head + struct.pack(">IQQ", count, store_at, store_at + os.path.getsize(store)))
            for part in (refs, store):
                with open(part, "rb") as source:
                    shutil.copyfileobj(source, out)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
