import base64
import json
import zlib

import pytest

from lexweave.operators.relational import images_to_resources
from lexweave.plans import registry
from lexweave.plans.convert import read
from lexweave.sources.wordlists import field_parts, field_variants, spelled_out

from .test_formats import content
from .test_operators import make


def test_fields():
    assert list(field_parts("a (b (c) d) {f} <x> [y] e (open")) == [("word", "a"), ("option", "b (c) d"), ("word", "e")]
    assert field_variants("to go (away) {past}", "verb", "en") == {"go", "to go", "go away", "to go away"}
    assert field_variants("to go", "noun", "en") == {"to go"}
    assert field_variants("give sb. sth.", "verb", "en") == {"give sb.", "give sb. sth."}
    assert field_variants("(old) house", "", "en") == {"house", "old house"}
    assert field_variants("sth.", "", "en") == {"sth."} and field_variants("{x}", "", "en") == set()
    assert field_variants("sth. new", "", "fr") == {"sth. new"}
    assert set(spelled_out("see sb./sth. x", "en")) == {("see sb./sth. x", False), ("see somebody x", True), ("see something x", True), ("see somebody/something x", True)}
    assert list(spelled_out("jd. geht", "de")) == [("jd. geht", False), ("jemand geht", True)]
    assert list(spelled_out("xsth. a", "en")) == [("xsth. a", False)]


def test_dict_cc_lines(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_text("# EN-DE vocabulary\tx\n\nhouse\tHaus {n}\tnoun\n(big) house\tHaus {n}\tnoun\nquick\tschnell\tadj\nquick\trasch  bald\tadv\nquick\tschnell\t\na &amp; b\tc\t\nbad line\n", encoding="utf-8")
    g = read(spark, str(path), "Dictcc_source", source_lang="en")
    assert content(g) == [(["big house", "house"], "  Haus {n}  "), (["quick"], "  schnell  rasch bald  "), (["a & b"], "  c  ")]
    back = content(read(spark, str(path), "Dictcc_source", source_lang="DE"))
    assert back[0] == (["Haus"], "  (big) house  house  ") and [t for t, _ in back] == [["Haus"], ["rasch bald", "schnell"], ["c"]]
    with pytest.raises(ValueError):
        read(spark, str(path), "Dictcc_source", source_lang="fr")


def test_images(spark):
    png, gif = b"\x89PNG1", b"GIF8"
    b64 = lambda b: base64.b64encode(b).decode()
    name = f"{zlib.crc32(png):08x}.png"
    rows = make(spark, ("a", f'<img src="data:image/png;base64,{b64(png)}"> <img src="data:image/png;base64,{b64(png)}">', "h"), ("b", f'<img src="data:image/png;base64,{b64(png)}"><img src="data:image/gif;base64,{b64(gif)}"><img src="data:image/x,y">', "h"), ("c", "plain"))
    out = images_to_resources(rows).orderBy("is_data", "part", "seq", "fname").collect()
    assert [r["defi"] for r in out[:3]] == [f'<img src="./{name}"> <img src="./{name}">', f'<img src="./{name}"><img src="./{zlib.crc32(gif):08x}.gif"><img >', "plain"]
    assert sorted((r["fname"], bytes(r["data"])) for r in out[3:]) == sorted([(name, png), (f"{zlib.crc32(gif):08x}.gif", gif)])


def test_wordset_files_in_order(spark, tmp_path):
    for file, words in (("misc", ["a"]), ("b", ["y", "X"]), ("z", ["q"])):
        (tmp_path / f"{file}.json").write_text(json.dumps({w: {"meanings": []} for w in words}), encoding="utf-8")
    assert [t[0] for t, _ in content(read(spark, str(tmp_path), "Wordset"))] == ["X", "y", "q", "a"]


def test_plugins(spark, tmp_path):
    (tmp_path / "mine.py").write_text("from lexweave.plans.registry import Format\nfrom lexweave.sources.delimited import read_tabfile\nFORMATS = [Format('Mine', ('.mine',), read_tabfile)]\n", encoding="utf-8")
    try:
        assert registry.load_plugins(str(tmp_path)) == ["Mine"]
        (tmp_path / "x.mine").write_text("a\tb\n", encoding="utf-8")
        assert content(read(spark, str(tmp_path / "x.mine"))) == [(["a"], "b")]
        with pytest.raises(ValueError):
            registry.load_plugins(str(tmp_path))
    finally:
        registry.FORMATS.pop("Mine", None)
