import pytest
from pyspark.sql import functions as F

from lexweave.functions import html, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(("plain", "escaped"), [("a\tb", "a\\tb"), ("a\nb", "a\\nb"), ("a\\b", "a\\\\b"), ("a\\tb", "a\\\\tb"), ("", ""), ("é\n\t\\", "é\\n\\t\\\\")])
def test_escapes(spark, plain, escaped):
    assert one(spark, plain, text.escape_ntb) == escaped
    assert one(spark, escaped, text.unescape_ntb) == plain
    assert one(spark, "a|b", lambda c: text.escape_ntb(c, bar=True)) == "a\\|b"
    assert one(spark, "x\r\ny", text.escape_ntb) == "x\\ny"


@pytest.mark.parametrize(("joined", "parts"), [("a|b", ["a", "b"]), ("a\\|b|c", ["a|b", "c"]), ("a||b|", ["a", "", "b", ""]), ("", [""])])
def test_bars(spark, joined, parts):
    assert one(spark, joined, text.split_bar) == parts
    assert spark.createDataFrame([(parts,)], "t array<string>").select(text.join_bar(F.col("t"))).first()[0] == joined


def test_numbers(spark):
    assert one(spark, "", text.crc32hex) == "00000000"
    assert one(spark, "abc", text.crc32hex) == "352441c2"
    assert spark.range(1).select(text.uint_bytes(F.lit(0x3E8), 4)).first()[0] == b"\0\0\x03\xe8"
    assert spark.range(1).select(text.uint_from_bytes(F.lit(b"\0\0\x03\xe8").cast("binary"))).first()[0] == 1000


def test_url_and_space(spark):
    assert one(spark, "file:///home/test%20a+b.txt\r\n", text.url_to_path) == "/home/test a+b.txt"
    assert one(spark, "a ، b،c", lambda c: text.space_after(c, "،")) == "a، b، c"
    assert one(spark, "ﾅ\x1c a \n", text.strip) == "ﾅ\x1c a"


@pytest.mark.parametrize(("defi", "kind"), [("abc", "m"), ("a <b>c</b>", "h"), ("<k>a</k> b", "x"), ("&nbsp;", "h"), ("a<br/>b", "h"), ("a < b", "m"), ("line\n<div class='x'>", "h")])
def test_format(spark, defi, kind):
    assert one(spark, defi, text.detect_format) == kind


@pytest.mark.parametrize(
    ("page", "body", "error"),
    [
        ("<!DOCTYPE html><html><head></head><body>x</body></html>", "x", None), ("<html><body a='b'>x <b>y</b></body></html>", "x <b>y</b>", None), ("text", "text", None), ("<b>x</b>", "<b>x</b>", None),
        ("<!DOCTYPE html>no", None, "Has <!DOCTYPE html> but no <html>"), ("<html>x", None, "<body not found"), ("<html><body", None, "'>' after <body not found"), ("<html><body>x", None, "</body close not found"),
    ],
)
def test_full_page(spark, page, body, error):
    r = spark.createDataFrame([(page,)], "c string").select(*[c.alias(n) for c, n in zip(text.strip_full_html(F.col("c")), ("b", "e"), strict=True)]).first()
    assert (r["b"], r["e"]) == (page if body is None else body, error)


def test_html_functions(spark):
    assert one(spark, "<A HREF='X'>y</A><CUSTOM>", html.normalize_tags) == "<a href='x'>y</a><CUSTOM>"
    assert one(spark, '<a href="bword://Abc">Abc</a>', html.lower_links) == '<a href="bword://abc">Abc</a>'
    assert one(spark, '<a href="bword://caf&eacute;&amp;x">', html.unescape_links) == '<a href="bword://café&amp;x">'
    assert one(spark, "<p>a &amp; b</p>", html.text_of) == "a & b"
    assert one(spark, "# T\n\na *b* **c**\n\n- x\n- y", html.markdown) == "<h1>T</h1>\n<p>a <em>b</em> <strong>c</strong></p>\n<ul>\n<li>x</li>\n<li>y</li>\n</ul>\n"
    assert one(spark, "1 سلام", html.script) == "Arabic"
    assert one(spark, "123", html.script) is None
    assert one(spark, None, html.script) is None


def test_trigrams_and_shards(spark):
    assert one(spark, "ab c", text.trigrams) == ["\nab"]
    assert one(spark, "a", text.shard_path) == "61"
    assert one(spark, "Abcde", text.shard_path).startswith("6162.d/6364.d/65-")


def test_days(spark):
    assert one(spark, "2000-01-01", lambda c: text.julian_day(c.cast("date"))) == 2451545
    assert str(one(spark, "2000-01-01", lambda c: text.from_julian_day(text.julian_day(c.cast("date"))))) == "2000-01-01"


def test_pinyin(spark):
    from lexweave.functions import chinese

    cases = {"zhong1": "zhōng", "Guo2": "Guó", "nü3": "nǚ", "liu4": "liù", "gui1": "guī", "xiao3": "xiǎo", "ma5": "ma", "De5": "De", "r": "r", "hng4": "hng", "A4": "À", "B": "B", "an6": "an6"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["m"] for r in df.select("s", chinese.with_tone_mark(df.s).alias("m")).collect()} == cases
    assert [r[0] for r in df.select(chinese.tone(df.s)).collect()][:2] == ["1", "2"]
