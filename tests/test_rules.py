"""Fixed rules of formats: ebook prefixes, markup, compressed outputs, files per entry."""

import bz2
import gzip
import lzma
import zipfile

import pytest
from pyspark.sql import functions as F

from lexweave.model import ENTRY_SCHEMA, Glossary, info_table
from lexweave.operators import filters, relational, reverse
from lexweave.plans.convert import ConvertArgs, convert, read
from lexweave.sinks import package
from lexweave.sources.formats import dsl_html

# Terms and the pages that readers look them up on.
PREFIXES = {
    "test": "te", "a": "aa", "Èe": "èe", "multiple words": "mu", "àççèñts": "àç", "à": "àa", "": "11", " ": "11", " x": "xa", " 123": "11", "x 23": "xa", "д ": "д", "дaд": "дa",
    "未未": "未", "未": "未", "  未": "11", " 未": "未", "a-": "11", "-an": "11", "GB": "gb", "a1": "11", "x": "xa", "\t\t": "11", "  x": "11", "aд": "aд", " дд": "д",
    " あ": "ア", "あの": "アノ", "あっ": "アッ", "アノ": "アノ", "\x00x": "11", "x\x00": "xa", "猫犬": "猫",
}


def test_kobo_prefixes(spark):
    rows = spark.createDataFrame([(k,) for k in PREFIXES], "term string").select("term", relational.kobo_prefix(F.col("term")).alias("p")).collect()
    assert {r["term"]: r["p"] for r in rows} == PREFIXES


def test_lingvo_markup():
    assert dsl_html("[b]~[/b] \\~ a < b", "key") == "<b>key</b> ~ a &lt; b"
    assert dsl_html("[m1]x[/m]\n[m0]y[/m]\nz") == '<p style="padding-left:1em;margin:0">x</p><p style="padding-left:0.3em;margin:0">y</p><br/>z'
    assert dsl_html("[t]t[/t][']o[/'][c]g[/c][c red]r[/c]") == '<font face="Helvetica" class="dsl_t">t</font><u class="accent">o</u><font color="green">g</font><font color="red">r</font>'
    assert dsl_html("[ref]go[/ref]<<on>>[url]a.b[/url]") == '<a href="bword://go">go</a><a href="bword://on">on</a><a href="http://a.b">a.b</a>'
    assert dsl_html('[ref target="x"]go[/ref]') == '<a href="bword://x">go</a>'
    assert dsl_html("{{hidden}}[trn]a[/trn][!trs]b[/!trs]") == "ab"


def glossary(spark, rows):
    entries = spark.createDataFrame([(k, 0, terms, defi, "m", False, None, None) for k, (terms, defi) in enumerate(rows)], ENTRY_SCHEMA)
    return Glossary(entries, info_table(spark, {"name": "n"}))


@pytest.mark.parametrize(("extension", "opened"), [("gz", gzip.open), ("bz2", bz2.open), ("lzma", lzma.open)])
def test_compressed_text(spark, tmp_path, extension, opened):
    (tmp_path / "in.txt").write_text("##name\tn\na\tone\nb|c\ttwo\n", encoding="utf-8")
    for name in ("out.txt", "out.csv"):
        convert(spark, ConvertArgs(str(tmp_path / "in.txt"), str(tmp_path / name)))
        convert(spark, ConvertArgs(str(tmp_path / "in.txt"), str(tmp_path / f"{name}.{extension}")))
        with opened(tmp_path / f"{name}.{extension}", "rb") as packed:
            assert packed.read() == (tmp_path / name).read_bytes()


def test_zipped_text(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a\tone\n", encoding="utf-8")
    convert(spark, ConvertArgs(str(tmp_path / "in.txt"), str(tmp_path / "out.txt")))
    convert(spark, ConvertArgs(str(tmp_path / "in.txt"), str(tmp_path / "two.txt.zip")))
    with zipfile.ZipFile(tmp_path / "two.txt.zip") as z:
        assert z.namelist() == ["two.txt"] and z.read("two.txt") == (tmp_path / "out.txt").read_bytes()


@pytest.mark.parametrize("compression", ["", "gz"])
def test_files_per_entry_keep_all(spark, tmp_path, compression):
    rows = [(["key\tone"], "first"), (["key\tone"], "second"), (["a|b", "c\\d"], "third\nline")]
    package.crawler(glossary(spark, rows), str(tmp_path / "out"), compression=compression)
    back = read(spark, str(tmp_path / "out"), "CrawlerDir").entries.collect()
    assert sorted((r["terms"], r["defi"]) for r in back) == sorted(rows)


def test_repeats_get_free_numbers(spark):
    keys = ["a", "a", "b", "a (2)", "a", "b", "b", "c (2)", "c (2)"]
    got = filters.prevent_duplicate_terms(glossary(spark, [([k], "x") for k in keys]).entries).orderBy("seq").collect()
    used, want = set(), []
    for key in keys:
        new, n = key, 2
        while new in used:
            new, n = f"{key} ({n})", n + 1
        used.add(new)
        want.append([new])
    assert [r["terms"] for r in got] == want


def test_first_of_each_headword(spark):
    rows = [(["a"], "1"), (["b"], "2"), (["a"], "3"), (["a", "b"], "4")]
    got = filters.skip_duplicate_headword(glossary(spark, rows).entries).orderBy("seq").collect()
    assert [r["defi"] for r in got] == ["1", "2"]


def test_relevance_is_the_best_share(spark):
    got = reverse.relevance(glossary(spark, [(["t"], "red red blue. red"), (["u"], "")]).entries).collect()
    assert {(r["word"], r["rel"]) for r in got} == {("red", 1.0), ("blue", 1 / 3)}


def test_long_chains_of_aliases_end(spark):
    chain = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(300)], "alias string, target string")
    assert {r["target"] for r in relational.resolve_aliases(chain).collect()} == {"n300"}
