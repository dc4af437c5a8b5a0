import struct
import zlib

import pytest

from lexweave.model import Glossary, info_dict, info_table
from lexweave.plans.convert import read
from lexweave.sinks.slob import slob
from lexweave.sources import containers

from .test_formats import content, rows
from .test_operators import make


def test_ripemd128():
    assert containers.ripemd128(b"").hex() == "cdf26213a150dc3ecb610f18f6b38b46"
    assert containers.ripemd128(b"abc").hex() == "c14a12199c66e4ba84636b0f69144c77"
    assert containers.ripemd128(b"1234567890" * 8).hex() == "3f45ef194732c2dbb2c4a2c769795fa3"


@pytest.mark.parametrize("compression", ["", "zlib", "bz2", "lzma2"])
def test_slob_round_trip(spark, tmp_path, compression):
    big = "<p>" + "x" * 500_000
    g = Glossary(make(spark, (["b", "B2"], '<a href="bword://a">a</a>', "h"), (["a"], "plain"), (["(c)"], big, "h"), (["é"], "", "m"), ("pic.png", b"\x00png"), ("odd.zzz", b"?")), info_table(spark, {"name": "N", "author": "me", "creationTime": "2020", "license": "free"}))
    path = str(tmp_path / "o.slob")
    slob(g, path, compression)
    back = read(spark, path)
    assert content(back) == [(["a"], "plain"), (["b"], '<a href="bword://a">a</a>'), (["(c)"], big), (["é"], "")]
    assert [(r["fname"], bytes(r["data"])) for r in back.entries.filter("is_data").collect()] == [("pic.png", b"\x00png")]
    have = info_dict(back.info)
    assert (have["name"], have["author"], have["creationTime"], have["copyright"], have["website"]) == ("N", "me", "2020", "free", "o_slob")


def test_slob_options_and_empty(spark, tmp_path):
    g = Glossary(make(spark, (["a", "b"], "x & y")), info_table(spark, {}))
    slob(g, str(tmp_path / "o.slob"), separate_alternates=True, word_title=True)
    assert content(read(spark, str(tmp_path / "o.slob"))) == [(["a"], "<b>a</b><br>x & y"), (["b, a"], "<b>a</b><br>x & y")]
    slob(Glossary(g.entries.filter("false"), g.info), str(tmp_path / "e.slob"))
    assert content(read(spark, str(tmp_path / "e.slob"))) == []
    with pytest.raises(ValueError):
        list(containers.slob("x", b"no archive"))


def scramble(data: bytes, key: bytes) -> bytes:
    out, before = [], 0x36
    for k, x in enumerate(data):
        t = x ^ before ^ (k & 255) ^ key[k % len(key)]
        before = (t >> 4 | t << 4) & 255
        out.append(before)
    return bytes(out)


def block(data: bytes, packed: bool = True) -> bytes:
    return struct.pack("<L", 2 if packed else 0) + struct.pack(">L", zlib.adler32(data)) + (zlib.compress(data) if packed else data)


def mdx(records, version=2.0, charset="UTF-8", protect=False, attributes=""):
    """A file with two keys a block and three records a block."""
    codec, wide = {"UTF-16": "utf-16-le"}.get(charset, charset), ">Q" if version >= 2 else ">I"
    unit, short, nul = (2 if charset == "UTF-16" else 1), (">H" if version >= 2 else ">B"), b"\0" * (2 if charset == "UTF-16" else 1)
    num = lambda *x: b"".join(struct.pack(wide, n) for n in x)
    header = f'<Dictionary GeneratedByEngineVersion="{version}" Encrypted="{2 if protect else "No"}" Encoding="{charset}" {attributes}/>\r\n\0'.encode("utf-16-le")
    bodies = [t if isinstance(t, bytes) else t.encode(codec) + nul for _, t in records]
    starts = [sum(map(len, bodies[:k])) for k in range(len(bodies))]
    entries = [num(s) + k.encode(codec) + nul for s, (k, _) in zip(starts, records, strict=True)]
    raw = [b"".join(entries[k : k + 2]) for k in range(0, len(entries), 2)]
    packed = [block(x, k % 2 == 0) for k, x in enumerate(raw)]
    index = b""
    for k, (r, p) in enumerate(zip(raw, packed, strict=True)):
        inside = records[2 * k : 2 * k + 2]
        index += num(len(inside))
        for key in (inside[0][0], inside[-1][0]):
            e = key.encode(codec)
            index += struct.pack(short, len(e) // unit) + e + (nul if version >= 2 else b"")
        index += num(len(p), len(r))
    plain = len(index)
    if version >= 2:
        data, check = zlib.compress(index), struct.pack(">L", zlib.adler32(index))
        data = scramble(data, containers.ripemd128(check + struct.pack("<L", 0x3695))) if protect else data
        index = b"\2\0\0\0" + check + data
    numbers = num(len(packed), len(records), *([plain] if version >= 2 else []), len(index), sum(map(len, packed)))
    out = struct.pack(">L", len(header)) + header + struct.pack("<L", zlib.adler32(header)) + numbers
    out += (struct.pack(">L", zlib.adler32(numbers)) if version >= 2 else b"") + index + b"".join(packed)
    chunks = [b"".join(bodies[k : k + 3]) for k in range(0, len(bodies), 3)]
    blocks = [block(c) for c in chunks]
    out += num(len(blocks), len(records), 2 * struct.calcsize(wide) * len(blocks), sum(map(len, blocks)))
    return out + b"".join(num(len(b), len(c)) for b, c in zip(blocks, chunks, strict=True)) + b"".join(blocks)


@pytest.mark.parametrize("options", [{}, {"version": 1.2}, {"charset": "UTF-16"}, {"protect": True}])
def test_mdict(spark, tmp_path, options):
    records = [("abc", "@@@LINK=b"), ("b", '<a href="entry://c">x</a>'), ("c", "`1`é`2`z"), ("d", "@@@LINK=b"), ("e", '<img src="file://p.png">')]
    path = tmp_path / "o.mdx"
    path.write_bytes(mdx(records, attributes='Title="My &amp; T" Description="D" StyleSheet="1\n<b>\n</b>\n2\n<i>\n</i>\n"', **options))
    (tmp_path / "o.mdd").write_bytes(mdx([("\\img\\p.png", b"\x01\x02"), ("\\q.css", b"q")], charset="UTF-16"))
    (tmp_path / "o.1.mdd").write_bytes(mdx([("\\r.css", b"r")], charset="UTF-16"))
    g = read(spark, str(path))
    assert content(g) == [(["b", "abc", "d"], '<a href="bword://c">x</a>'), (["c"], "<b>é</b><i>z</i>"), (["e"], '<img src=".p.png">')]
    assert sorted((r["fname"], bytes(r["data"])) for r in g.entries.filter("is_data").collect()) == [("img/p.png", b"\x01\x02"), ("q.css", b"q"), ("r.css", b"r")]
    assert info_dict(g.info) == {"name": "My & T", "description": "D"}


def test_mdict_refuses_what_it_cannot_read():
    with pytest.raises(ValueError):
        containers.mdict(mdx([("a", "b")], version=3.0))
    assert rows(lambda name, data: containers.mdict_files({"a.mdx": data}), mdx([("a", "b")])) == [(["a"], "b")]
