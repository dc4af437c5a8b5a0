"""Binary containers with an index and compressed blocks: Slob archives and MDict files."""

from __future__ import annotations

import bz2
import lzma
import re
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import SparkSession

from ..model import Glossary
from ..operators.relational import attach_redirects
from .base import entry, info, resource
from .bundles import decoded_bundle, existing

SLOB_MAGIC = b"!-1SLOB\x1f"
LZMA2 = [{"id": lzma.FILTER_LZMA2}]
SLOB_UNPACK = {"": bytes, "zlib": zlib.decompress, "bz2": bz2.decompress, "lzma2": lambda b: lzma.decompress(b, lzma.FORMAT_RAW, filters=LZMA2)}


class Cursor:
    """A place in bytes; numbers are big-endian, strings have a length before them."""

    def __init__(self, data, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def number(self, width: int) -> int:
        return int.from_bytes(self.take(width), "big")

    def string(self, width: int, encoding: str = "utf-8") -> str:
        """A string of the greatest length may be padded with NULs."""
        raw = self.take(self.number(width))
        return (raw.partition(b"\0")[0] if len(raw) == (1 << 8 * width) - 1 else raw).decode(encoding)

    def places(self, width: int, count: int | None = None) -> list[int]:
        """A list's item places in bytes: the list has their distances from its end first."""
        count = self.number(4) if count is None else count
        raw = np.frombuffer(self.take(count * width), f">u{width}").astype(np.int64)
        return (raw + self.at).tolist()


def slob(name: str, content: bytes):
    """Each blob once, under its first key in the order of keys; links get ``bword://``, blobs that aren't text are resources."""
    c = Cursor(memoryview(content))
    if c.take(8) != SLOB_MAGIC:
        raise ValueError(f"{name} is no slob archive")
    uuid.UUID(bytes=c.take(16))
    encoding = c.string(1)
    unpack = SLOB_UNPACK[c.string(1, encoding)]
    tags = dict([(c.string(1, encoding), c.string(1, encoding)) for _ in range(c.number(1))])
    types = [c.string(2, encoding) for _ in range(c.number(1))]
    c.number(4)
    store_at, _ = c.number(8), c.number(8)
    yield from _slob_info(tags)
    refs, bins = c.places(8), Cursor(c.data, store_at).places(8)
    seen, open_bin, items = set(), None, []
    for place in refs:
        ref = Cursor(c.data, place)
        key, bin_, item = ref.string(2, encoding), ref.number(4), ref.number(2)
        if (bin_, item) in seen:
            continue
        seen.add((bin_, item))
        if open_bin != bin_:
            packed = Cursor(c.data, bins[bin_])
            kinds = packed.take(packed.number(4))
            block = Cursor(unpack(packed.take(packed.number(4))))
            open_bin, items = bin_, block.places(4, len(kinds))
        blob = Cursor(block.data, items[item])
        body, kind = blob.take(blob.number(4)), types[kinds[item]].partition(";")[0]
        if kind in ("text/html", "text/plain"):
            text = re.sub(r"<a href=[^<>]+?>", lambda m: m[0] if "//" in m[0] else re.sub("href=([\"'])", r"href=\1bword://", m[0]), body.decode("utf-8"), flags=re.I)
            yield entry(key, text, "h" if kind == "text/html" else "m")
        else:
            yield resource(key.removeprefix("~/"), body)


# Archive tags and the metadata they are.
SLOB_TAGS = {"label": "name", "created.at": "creationTime", "created.by": "author", "uri": "website", "edition": "edition"}
SLOB_RIGHTS = ("copyright", "license.name", "license.url")


def _slob_info(tags: dict[str, str]):
    rights = [tags[k] for k in SLOB_RIGHTS if k in tags]
    for key, value in tags.items():
        if key in SLOB_TAGS:
            yield info(SLOB_TAGS[key], value)
        elif key not in SLOB_RIGHTS:
            yield info(f"slob.{key}", value)
    if rights:
        yield info("copyright", "\n".join(rights))


# --- MDict --------------------------------------------------------------------------------------

# Fixed values of RIPEMD-128: message order and shifts of both lines, four rounds of sixteen; constants by round.
_ORDER = (
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 7, 4, 13, 1, 10, 6, 15, 3, 12, 0, 9, 5, 2, 14, 11, 8,
     3, 10, 14, 4, 9, 15, 8, 1, 2, 7, 0, 6, 13, 11, 5, 12, 1, 9, 11, 10, 0, 8, 12, 4, 13, 3, 7, 15, 14, 5, 6, 2],
    [5, 14, 7, 0, 9, 2, 11, 4, 13, 6, 15, 8, 1, 10, 3, 12, 6, 11, 3, 7, 0, 13, 5, 10, 14, 15, 8, 12, 4, 9, 1, 2,
     15, 5, 1, 3, 7, 14, 6, 9, 11, 8, 12, 2, 10, 0, 4, 13, 8, 6, 4, 1, 3, 11, 15, 0, 5, 12, 2, 13, 9, 7, 10, 14],
)
_SHIFT = (
    [11, 14, 15, 12, 5, 8, 7, 9, 11, 13, 14, 15, 6, 7, 9, 8, 7, 6, 8, 13, 11, 9, 7, 15, 7, 12, 15, 9, 11, 7, 13, 12,
     11, 13, 6, 7, 14, 9, 13, 15, 14, 8, 13, 6, 5, 12, 7, 5, 11, 12, 14, 15, 14, 15, 9, 8, 9, 14, 5, 6, 8, 6, 5, 12],
    [8, 9, 9, 11, 13, 15, 15, 5, 7, 7, 8, 11, 14, 14, 12, 6, 9, 13, 15, 7, 12, 8, 9, 11, 7, 7, 12, 7, 6, 15, 13, 11,
     9, 7, 15, 11, 8, 6, 6, 14, 12, 13, 5, 14, 13, 13, 7, 5, 15, 5, 8, 11, 14, 14, 6, 14, 6, 9, 12, 9, 12, 5, 15, 8],
)
_ADD = ([0, 0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC], [0x50A28BE6, 0x5C4DD124, 0x6D703EF3, 0])
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MIX = (lambda x, y, z: x ^ y ^ z, lambda x, y, z: (x & y) | (~x & z), lambda x, y, z: (x | ~y) ^ z, lambda x, y, z: (x & z) | (y & ~z))


def ripemd128(message: bytes) -> bytes:
    """The digest that keys of protected indexes are made with."""
    state = list(_START)
    padded = message + b"\x80" + b"\0" * ((55 - len(message)) % 64) + struct.pack("<Q", 8 * len(message))
    for at in range(0, len(padded), 64):
        words = struct.unpack_from("<16I", padded, at)
        lines = []
        for side in (0, 1):
            a, b, c, d = state
            for k in range(64):
                round_ = k // 16
                t = (a + _MIX[3 - round_ if side else round_](b, c, d) + words[_ORDER[side][k]] + _ADD[side][round_]) & 0xFFFFFFFF
                s = _SHIFT[side][k]
                a, b, c, d = d, (t << s | t >> (32 - s)) & 0xFFFFFFFF, b, c
            lines.append((a, b, c, d))
        left, right = lines
        state = [(state[(k + 1) % 4] + left[(k + 2) % 4] + right[(k + 3) % 4]) & 0xFFFFFFFF for k in range(4)]
    return struct.pack("<4I", *state)


def unscramble(data: bytes, key: bytes) -> bytes:
    """Each byte has its halves swapped and is mixed with the scrambled byte before it, its place and the key."""
    b = np.frombuffer(data, np.uint8)
    place = np.arange(len(b))
    before = np.concatenate([[0x36], b[:-1]]).astype(np.uint8)[: len(b)]
    return (((b >> 4) | (b << 4)) ^ before ^ (place & 0xFF).astype(np.uint8) ^ np.frombuffer(key, np.uint8)[place % len(key)]).tobytes()


def _block(raw: bytes) -> bytes:
    """Compression and encryption in four bytes, a checksum, and the data."""
    flags, check = struct.unpack("<L", raw[:4])[0], struct.unpack(">L", raw[4:8])[0]
    packing, locked, n_locked = flags & 15, flags >> 4 & 15, flags >> 8 & 255
    if packing not in (0, 2) or locked > 1:
        raise ValueError(f"MDict blocks with compression {packing} and encryption {locked} can't be read")
    data = raw[8:]
    if locked:
        data = unscramble(data[:n_locked], ripemd128(raw[4:8])) + data[n_locked:]
    data = zlib.decompress(data) if packing else data
    if zlib.adler32(data) != check:
        raise ValueError("MDict block with a wrong checksum")
    return data


def mdict(content: bytes, encoding: str = ""):
    """(header, records): attributes of the header, and (key, record bytes) in order, of versions 1 and 2."""
    c = Cursor(memoryview(content))
    head = c.take(c.number(4))
    c.take(4)
    pairs = re.findall(r'(\w+)="(.*?)"', head.decode("utf-16-le", "replace").rstrip("\0"), re.S)
    header = {k: v.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&") for k, v in pairs}
    version, protection = float(header.get("GeneratedByEngineVersion", "2.0")), {"No": "0", "Yes": "1", "": "0"}.get(header.get("Encrypted", ""), header.get("Encrypted", ""))
    if version >= 3 or int(protection) & 1:
        raise ValueError(f"MDict version {version} with protection {protection} can't be read")
    given = encoding or header.get("Encoding") or "utf-8"
    charset = {"GBK": "gb18030", "GB2312": "gb18030", "UTF-16": "utf-16-le"}.get(given.upper(), given)
    wide, modern = charset == "utf-16-le", version >= 2
    width, unit = (8 if modern else 4), (2 if wide else 1)
    n_blocks, _ = c.number(width), c.number(width)
    if modern:
        c.number(width)
    n_index, n_keys = c.number(width), c.number(width)
    if modern:
        c.take(4)
    index = c.take(n_index)
    if modern:
        if int(protection) & 2:
            index = index[:8] + unscramble(index[8:], ripemd128(index[4:8] + struct.pack("<L", 0x3695)))
        index = zlib.decompress(index[8:])
    sizes, at = [], Cursor(index)
    for _ in range(n_blocks):
        at.number(width)
        for _ in ("first", "last"):
            at.take((at.number(2 if modern else 1) + modern) * unit)
        sizes.append((at.number(width), at.number(width))[0])
    keys: list[tuple[int, str]] = []
    end = c.at + n_keys
    for size in sizes:
        block = Cursor(_block(c.take(size)))
        while block.at < len(block.data):
            start, stop = block.number(width), block.at
            while block.data[stop : stop + unit] != b"\0" * unit:
                stop += unit
            keys.append((start, block.take(stop - block.at).decode(charset, "ignore").strip()))
            block.take(unit)
    c.at = end
    n_records, _, _, _ = (c.number(width) for _ in range(4))
    packed = [(c.number(width), c.number(width)) for _ in range(n_records)]

    def records():
        k = base = 0
        for size, _ in packed:
            block = _block(c.take(size))
            while k < len(keys) and keys[k][0] - base < len(block):
                stop = keys[k + 1][0] - base if k + 1 < len(keys) else len(block)
                yield keys[k][1], block[keys[k][0] - base : min(stop, len(block))]
                k += 1
            base += len(block)

    return header, charset, records()


def styled(text: str, styles: dict[str, tuple[str, str]]) -> str:
    """`n` starts a stretch in style n: the style's begin and end go around it."""
    first, *rest = re.split(r"`(\d+)`", text)
    out = [first]
    for number, stretch in zip(rest[::2], rest[1::2], strict=True):
        before, after = styles.get(number, ("", ""))
        out.append(f"{before}{stretch.rstrip()}{after}\r\n" if stretch.endswith("\n") else f"{before}{stretch}{after}")
    return "".join(out)


def mdict_files(files: dict[str, bytes], encoding: str = "", substyle: bool = True, audio: bool = False):
    """The entries of the .mdx, then the resources of its .mdd files; redirects are still entries."""
    for name in sorted(files, key=lambda n: (not n.endswith(".mdx"), len(n), n)):
        if not name.endswith(".mdx"):
            for key, body in mdict(files[name], "UTF-16")[2]:
                yield resource(key.replace("\\", "/").lstrip("/"), body)
            continue
        header, charset, records = mdict(files[name], encoding)
        title = header.get("Title", "").strip()
        if title and title != "Title (No HTML code allowed)":
            yield info("name", title)
        if header.get("Description"):
            yield info("description", header["Description"])
        lines = header.get("StyleSheet", "").splitlines()
        styles = {n: (a, b) for n, a, b in zip(lines[::3], lines[1::3], lines[2::3], strict=False)}
        for key, body in records:
            text = body.decode(charset, "ignore").strip("\0")
            text = (styled(text, styles) if substyle and styles else text).strip()
            text = re.sub("href=([\"'])(?:entry://|[dx]:)", r"href=\1bword://", text).replace(' src="file://', ' src=".')
            if audio:
                text = re.sub(r'<a (?:type="sound" )?(?:[^<>]*? )?href="sound://([^<>"]+)"(?: .*?)?>.*?</a>', r'<audio controls src="\1"></audio>', text)
            yield entry(key, text, "h")


def read_mdict(spark: SparkSession, path: str, encoding: str = "", substyle: bool = True, audio: bool = False) -> Glossary:
    """``x.mdx`` with ``x.mdd``, ``x.1.mdd``, ``x.2.mdd``, …; entries that only link are alternates of their target."""
    base = path.removesuffix(".mdx")
    paths, n = existing(spark, [path, f"{base}.mdd", f"{base}.1.mdd"]), 2
    while more := existing(spark, [f"{base}.{n}.mdd"]):
        paths, n = paths + more, n + 1
    g = decoded_bundle(spark, paths, lambda files: mdict_files(files, encoding, substyle, audio), by_suffix=False)
    return Glossary(attach_redirects(g.entries), g.info)
