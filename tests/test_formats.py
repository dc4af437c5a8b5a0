import io
import json
import sqlite3
import zipfile

import pytest

from lexweave.model import Glossary, info_dict, info_table, s_term
from lexweave.plans.convert import ConvertArgs, convert, read
from lexweave.plans.registry import FORMATS, detect_input, detect_output, split_extension
from lexweave.sinks import package
from lexweave.sinks import text as text_sinks
from lexweave.sources import formats

from .test_operators import make

ROWS = [(["a", "b|c"], "x\ty\nz"), (["d\\e"], 'q "r", s'), (["é"], "<b>h</b>", "h")]


@pytest.fixture
def glossary(spark):
    return Glossary(make(spark, *ROWS), info_table(spark, {"name": "N", "sourceLang": "en"}))


def content(g):
    return [(list(r["terms"]), r["defi"]) for r in g.entries.filter("not is_data").orderBy("part", "seq").collect()]


@pytest.mark.parametrize("name", ["Tabfile", "Csv", "StardictTextual", "Stardict", "AyanDictSQLite", "GettextPo"])
def test_round_trips(spark, glossary, tmp_path, name):
    fmt = FORMATS[name]
    path = str(tmp_path / ("out" + (fmt.extensions[0] if fmt.extensions else ".x")))
    fmt.writer(glossary, path)
    back = fmt.reader(spark, path)
    got, want = content(back), [(r[0], r[1]) for r in ROWS]
    if name == "GettextPo":
        want = [([x], d) for x, d in zip(("a|b\\|c", "d\\e", "é"), (d for _, d in want), strict=True)]
    if name == "AyanDictSQLite":
        want[0] = (want[0][0], "<pre>x\ty\nz</pre>")
    assert got == want
    if name in ("Tabfile", "Csv", "Stardict", "StardictTextual"):
        assert info_dict(back.info)["name"] == "N"


def test_tab_golden(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("##name\tT\nq bee|q party\tA social event\nsclerous\thard\nvoid\t\n\tnone\nno tab here\n", encoding="utf-8")
    convert(spark, ConvertArgs(str(source), str(tmp_path / "out.txt")))
    assert (tmp_path / "out.txt").read_text(encoding="utf-8") == "##name\tT\nq bee|q party\tA social event\nsclerous\thard\n"


def test_sorted_conversion_and_compression(spark, tmp_path):
    import gzip

    source = tmp_path / "in.tsv"
    source.write_text("b\t1\nA\t2\na\t3\n", encoding="utf-8")
    convert(spark, ConvertArgs(str(source), str(tmp_path / "out.txt.gz"), sort=True))
    assert gzip.open(tmp_path / "out.txt.gz", "rt").read() == "A\t2\na\t3\nb\t1\n"


def test_sql_script(spark, glossary, tmp_path):
    path = tmp_path / "o.sql"
    text_sinks.sql(glossary, str(path))
    con = sqlite3.connect(":memory:")
    con.executescript(path.read_text(encoding="utf-8"))
    assert con.execute("select id, w, m from word order by id").fetchall() == [(1, "a", "x\ty<br>z"), (2, "d\\e", 'q "r", s'), (3, "é", "<b>h</b>")]
    assert con.execute("select * from alt").fetchall() == [(1, "b|c")]


def test_json_sinks(spark, glossary, tmp_path):
    text_sinks.json_object(glossary, str(tmp_path / "o.json"))
    got = json.loads((tmp_path / "o.json").read_text(encoding="utf-8"))
    assert got["a|b\\|c"] == "x\ty\nz" and got["info.name"] == "N" and got[""] == ""
    text_sinks.info_json(glossary, str(tmp_path / "o.info"))
    assert json.loads((tmp_path / "o.info").read_text(encoding="utf-8"))["word_count"] == 3


def test_ldf(spark, tmp_path):
    g = Glossary(make(spark, (["a", "b"], "x\ny"), (["c"], "z")), info_table(spark, {"name": "N"}))
    text_sinks.ldf(g, str(tmp_path / "o.ldf"))
    assert content(read(spark, str(tmp_path / "o.ldf"))) == [(["a", "b"], "x\ny"), (["c"], "z")]


def test_dictd(spark, tmp_path):
    g = Glossary(make(spark, (["b"], "two"), (["a"], "one"), (["a"], "more {b}")), info_table(spark, {}))
    package.dictd(g, str(tmp_path / "o.index"))
    assert content(read(spark, str(tmp_path / "o.index"))) == [(["a"], 'one\n\n<hr>\n\nmore <a href="bword://b">b</a>'), (["b"], "two")]
    assert [formats.b64_number(formats.number_b64(n)) for n in (0, 63, 64, 12345678)] == [0, 63, 64, 12345678]


def test_folders(spark, glossary, tmp_path):
    package.crawler(glossary, str(tmp_path / "c"))
    assert sorted(t for t, _ in content(FORMATS["CrawlerDir"].reader(spark, str(tmp_path / "c")))) == sorted([["a", "b|c"], ["d\\e"], ["é"]])
    package.edlin(glossary, str(tmp_path / "e"))
    assert len(content(FORMATS["Edlin"].reader(spark, str(tmp_path / "e")))) == 3
    package.html_dir(glossary, str(tmp_path / "h"), 50)
    assert len(list((tmp_path / "h").glob("*.html"))) == 3
    package.dicformids(glossary, str(tmp_path / "m"))
    assert len(content(FORMATS["Dicformids"].reader(spark, str(tmp_path / "m")))) == 3
    package.mobi_source(glossary, str(tmp_path / "mobi"))
    assert (tmp_path / "mobi" / "content.opf").exists()


def test_packages(spark, glossary, tmp_path):
    package.epub2(glossary, str(tmp_path / "o.epub"))
    assert zipfile.ZipFile(tmp_path / "o.epub").namelist()[0] == "mimetype"
    package.kobo(glossary, str(tmp_path / "o.kobo"))
    assert "words.txt" in zipfile.ZipFile(tmp_path / "o.kobo").namelist()
    package.yomichan(glossary, str(tmp_path / "o.zip"), 2)
    got = content(FORMATS["Yomichan"].reader(spark, str(tmp_path / "o.zip")))
    assert len(got) == 4 and got[0][0] == ["a"]
    package.apple_source(glossary, str(tmp_path / "o.apple"))
    assert [t for t, _ in content(FORMATS["AppleDict"].reader(spark, str(tmp_path / "o.apple")))] == [["a", "b|c"], ["d\\e"], ["é"]]


def test_unsafe_resources_stay_out(spark, tmp_path):
    g = Glossary(make(spark, ("../evil", b"1"), ("sub/ok", b"2")), info_table(spark, {}))
    package.save_resources(g, str(tmp_path / "r"))
    assert (tmp_path / "r" / "sub" / "ok").read_bytes() == b"2" and not (tmp_path / "evil").exists()


def rows(decoder, text, **options):
    return [(r["terms"], r["defi"]) for r in decoder("x", text.encode() if isinstance(text, str) else text, **options) if "terms" in r]


def test_block_decoders():
    assert rows(formats.dictunformat, "_____\n\n00-database-short\n00-database-short\n name\n_____\n\nfoo\nfoo\n bar\n") == [(["foo"], " bar")]
    assert rows(formats.gettext_po, 'msgid ""\nmsgstr "Language: en\\n"\n\n#: c\nmsgid "a"\n"b"\nmsgstr "c\\nd"\n') == [(["ab"], "c\nd")]
    assert rows(formats.kobo_dictfile, "@ a\n& b\n:: v\n: note\nbody\n@ c\n<html><b>x</b>\n") == [(["a", "b"], "note\nbody"), (["c"], "<b>x</b>")]
    assert rows(formats.dsl, '#NAME "T"\nword\n\t[m1][b]bold[/b] [ref]x[/ref][/m]\nother\n\ty\n') == [(["word"], '<p style="padding-left:1em;margin:0"><b>bold</b> <a href="bword://x">x</a></p>'), (["other"], "y")]
    assert rows(formats.cedict_yaml, "- word: a\n  definitions:\n  - x\n  - y\n") == [(["a"], "<div><b>definitions</b>: x</div><div><b>definitions</b>: y</div>")]


def test_xml_decoders():
    assert rows(formats.tmx, '<tmx><body><tu><tuv xml:lang="en"><seg>a</seg></tuv><tuv xml:lang="de"><seg>b</seg></tuv></tu></body></tmx>') == [(["a"], "b")]
    assert rows(formats.xliff, '<xliff xmlns="urn:x"><trans-unit><source>a</source><target>b</target></trans-unit><trans-unit><source>a</source></trans-unit></xliff>') == [(["a"], "b")]
    assert rows(formats.xdxf, "<xdxf><ar><k>a<opt>b</opt></k> x <kref>y</kref></ar></xdxf>")[0][0] == ["ab", "a"]
    assert rows(formats.xdxf_lax, "<ar><k>a</k> x & y</ar>") == [(["a"], "<k>a</k> x & y")]
    assert rows(formats.freedict, "<TEI><entry><form><orth>a</orth><pron>/x/</pron></form><sense><cit type='trans'><quote>b</quote></cit></sense></entry></TEI>") == [(["a"], "/x/<br/>b")]
    assert rows(formats.jmdict, "<J><entry><k_ele><keb>日</keb></k_ele><r_ele><reb>ひ</reb></r_ele><sense><gloss>sun</gloss></sense></entry></J>")[0][0] == ["日", "ひ", "日・ひ"]


def _database(script):
    con = sqlite3.connect(":memory:")
    con.executescript(script)
    return con.serialize()


def test_sqlite_decoders():
    db = _database("create table main_ft(term1, term2, entry_type); insert into main_ft values('Hund {m}', 'dog', 'noun'), ('Hund {m}', 'hound', 'noun');")
    assert [t for t, _ in rows(formats.dict_cc, db)] == [["Hund", "Hund {m}"], ["dog"], ["hound"]]
    assert rows(formats.dict_cc_split, db)[0] == (["Hund {m} {noun}"], "dog")
    db = _database("create table WordsTable(id, word, searchword, root, meaning); create table Keys(wordkey, searchwordkey); insert into WordsTable values(1, 'w', 's', '', 'a|b'); insert into Keys values('w', 'k');")
    assert rows(formats.almaany, db) == [(["w", "k"], '<div dir="rtl">a<br>b</div>')]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("collection.anki2", _database("create table notes(id, flds, tags); insert into notes values(1, 'q' || char(31) || 'a' || char(31) || 'b', ' t ');"))
    assert rows(formats.anki, buffer.getvalue()) == [(["q"], "a<br>b")]


def test_line_readers(spark, tmp_path):
    (tmp_path / "d.u8").write_text("# c\n中國 中国 [Zhong1 guo2] /China/Middle/\nbad\n", encoding="utf-8")
    red, orange = '<font color="red">', '<font color="orange">'
    box = '<div style="display: inline-block">'
    article = f'<div style="border: 1px solid; padding: 5px"><div><big>{box}{red}中</font>{orange}国</font></div></big>\xa0/\xa0{box}{red}中</font>{orange}國</font></div><br><big>{box}{red}Zhōng</font>{orange}guó</font></div></big></div><div><ul><li>China</li><li>Middle</li></ul></div></div>'
    assert content(read(spark, str(tmp_path / "d.u8"))) == [(["中国", "中國"], article)]
    (tmp_path / "e.u8").write_text("西安 西安 [Xi1 an1] /Xi'an (city) in the west; a & b/the/\n", encoding="utf-8")
    g = content(read(spark, str(tmp_path / "e.u8"), summary_alternatives=True, colorize_tones=False))
    assert g[0][0] == ["西安", "Xi1 an1", "Xi'an west b", "the"] and '<font color="">Xī</font><font color="">\'ān</font>' in g[0][1] and "a &amp; b" in g[0][1]
    (tmp_path / "w.jsonl").write_text(json.dumps({"word": "go", "pos": "verb", "forms": [{"form": "went"}], "senses": [{"glosses": ["to move"]}]}) + "\n", encoding="utf-8")
    assert content(read(spark, str(tmp_path / "w.jsonl"))) == [(["go", "went"], "<i>verb</i><ol><li>to move</li></ol>")]
    (tmp_path / "f.wordfrequency").write_text("rank\tlemma\tPoS\tblog\tnews\n1\tgo\tv\t3\t9\n", encoding="utf-8")
    assert content(read(spark, str(tmp_path / "f.wordfrequency"))) == [(["go"], "<b>v</b><br/>news: 9<br/>blog: 3")]


def test_detection():
    assert split_extension("a/b.txt.gz") == ("a/b", ".txt", "gzip")
    assert detect_input("x.csv").name == "Csv" and detect_output("x.epub")[0].name == "Epub2"
    for bad in ("x.unknown", "x.sql"):
        with pytest.raises(ValueError):
            detect_input(bad)
    with pytest.raises(ValueError):
        detect_output("x.tmx")


def test_streaming_equals_batch(spark, tmp_path):
    from lexweave.streaming.replay import fan_out, filtered_stream, text_entries

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("#x\ty\n a |b\t x \nc\t\n", encoding="utf-8")
    out = []
    fan_out(filtered_stream(text_entries(spark, str(tmp_path / "in"))), [lambda batch, n: out.extend(r["k"] for r in batch.select(s_term().alias("k")).collect())], str(tmp_path / "c")).awaitTermination()
    assert out == ["a|b"]


def test_files_in_parts(spark, tmp_path):
    g = Glossary(make(spark, *[([f"w{k:03}"], "x" * 50) for k in range(300)]), info_table(spark, {"name": "N"}))
    path = str(tmp_path / "o.txt")
    text_sinks.tabfile(g, path, file_size_approx=5000)
    assert (tmp_path / "o.txt.1").exists() and (tmp_path / "o.txt.2").exists()
    back = read(spark, path)
    assert content(back) == [([f"w{k:03}"], "x" * 50) for k in range(300)] and info_dict(back.info) == {"name": "N"}
    (tmp_path / "two.txt").write_text("##file_count\t2\na\t1\n", encoding="utf-8")
    (tmp_path / "two.txt.1").write_text("b\t2\n", encoding="utf-8")
    (tmp_path / "two.txt.2").write_text("c\t3\n", encoding="utf-8")
    assert content(read(spark, str(tmp_path / "two.txt"))) == [(["a"], "1"), (["b"], "2")]
