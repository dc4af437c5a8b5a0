import pytest
from pyspark.sql import functions as F

from lexweave.model import ENTRY_SCHEMA, headword, info_dict, info_table, s_term
from lexweave.operators import filters, ordered, profile, relational, reverse, sortkeys


def make(spark, *rows):
    """(terms, defi) or (terms, defi, format) or ("name", bytes) for a resource."""
    out = []
    for n, row in enumerate(rows):
        if isinstance(row[1], bytes):
            out.append((n, 0, [row[0]], f"File: {row[0]}", "b", True, row[0], row[1]))
        else:
            out.append((n, 0, list(row[0]), row[1], row[2] if len(row) > 2 else "m", False, None, None))
    return spark.createDataFrame(out, ENTRY_SCHEMA)


def keys(df):
    return [(r["k"], r["defi"]) for r in df.withColumn("k", s_term()).orderBy("part", "seq").collect()]


def test_always_on_filters(spark):
    e = make(spark, ([" a\n", "b", "b", ""], " x <br><BR>"), (["", ""], "y"), (["c"], " "), ([""], "z"), ("r.png", b"1"), (["d\r"], "q\rr"))
    assert keys(filters.apply(e)) == [("a|b", "x "), ("r.png", "File: r.png"), ("d", "qr")]


def test_unknown_filter(spark):
    with pytest.raises(ValueError):
        filters.apply(make(spark, (["a"], "b")), {"nope": True})


def test_configured_filters(spark):
    e = make(spark, (["Ab"], '<a href="bword://X">'), (["ab", "B"], "p"), (["skip1"], "q"))
    assert keys(filters.apply(e, {"lower": True, "skip_duplicate_headword": True, "skip_term_regex": "skip.*"})) == [("ab", '<a href="bword://x">')]
    assert keys(filters.apply(make(spark, (["a"], "<b>x</b><br/>")), {"remove_html": "b"})) == [("a", "x<br/>")]
    assert keys(filters.apply(make(spark, (["a"], "<p>x</p><div>y</div>z<br>w &lt;")), {"remove_html_all": True})) == [("a", "x\ny\nz\nw <")]
    assert keys(filters.apply(make(spark, (["سَلام"], "x")), {"trim_arabic_diacritics": True}))[0][0].split("|")[0] == "سلام"
    assert keys(filters.apply(make(spark, (["كي"], "x")), languages=("fa",))) == [("کی", "x")]
    assert keys(filters.apply(make(spark, (["a"], "**x**")), {"md_to_html": True})) == [("a", "<p><strong>x</strong></p>\n")]


def test_skip_pattern_binds_to_the_end_only_in_its_last_part(spark):
    e = make(spark, (["foox"], "1"), (["bar"], "2"), (["barx"], "3"))
    assert [k for k, _ in keys(filters.skip_term_regex(e, "foo|bar"))] == ["barx"]


def test_unique_terms_with_taken_numbers(spark):
    e = make(spark, (["a"], "1"), (["a (2)"], "2"), (["a"], "3"), (["b", "c"], "4"), (["b", "c"], "5"))
    assert [r["terms"][0] for r in filters.prevent_duplicate_terms(e).orderBy("seq").collect()] == ["a", "a (2)", "a (3)", "b|c", "b|c (2)"]


def test_sort_keys(spark):
    e = make(spark, (["b"], "1"), (["É"], "2"), (["A"], "3"), (["a"], "4"), (["1x"], "5"))
    order = lambda name, **o: [r["terms"][0] for r in sortkeys.sort_entries(e, name, **o).collect()]
    assert order("headword") == ["1x", "A", "a", "b", "É"]
    assert order("headword_lower") == ["1x", "A", "a", "b", "É"]
    assert order("stardict") == ["1x", "A", "a", "b", "É"]
    assert order("ebook") == ["1x", "A", "a", "b", "É"]
    assert order("headword_lower:fr") == ["1x", "A", "a", "b", "É"]
    assert sorted(order("random", seed=3)) == sorted(order("headword"))
    assert order("headword", reverse=True)[0] == "É"
    with pytest.raises(ValueError):
        sortkeys.key_columns("stardict:fa")


def test_ordered_across_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), F.lit(0).alias("part"), (F.col("id") % 7).alias("v")).repartition(13)
    total = 0
    for r in ordered.running_total(df, F.col("v"), "t").orderBy("seq").collect():
        assert r["t"] == total
        total += r["v"]
    near = ordered.neighbours(df, F.col("seq"), "b", "a").orderBy("seq").collect()
    assert [r["b"] for r in near] == [None, *range(999)] and [r["a"] for r in near] == [*range(1, 1000), None]
    runs = ordered.islands(df, F.floor(F.col("seq") / 10), "run").groupBy("run").count().collect()
    assert len(runs) == 100 and {r["count"] for r in runs} == {10}


def test_merge(spark):
    e = make(spark, (["a", "x"], "1"), (["a", "y"], "2"), (["b"], "3"), ("r", b""), (["b"], "4"), (["a"], "5"))
    merged = relational.merge_consecutive(e).orderBy("seq").collect()
    assert [(r["terms"], r["defi"]) for r in merged] == [(["a"], "1\n\n" + "-" * 40 + "\na, y\n2"), (["b"], "3"), (["b"], "4"), (["a"], "5")]


def test_redirects_and_lemmas(spark):
    e = make(spark, (["go"], "move"), (["went"], "@@@LINK=go"), (["gone"], "@@@LINK=go\r\n"))
    assert [r["terms"] for r in relational.attach_redirects(e).collect()] == [["go", "went", "gone"]]
    forms = spark.createDataFrame([("go", "goes"), ("be", "is")], "lemma string, form string")
    got = sorted(tuple(r["terms"]) for r in relational.attach_lemmas(make(spark, (["go"], "x")), forms).collect())
    assert got == [("be", "is"), ("go", "goes")]


def test_diff(spark):
    a = make(spark, (["a"], "1"), (["b"], "2"), (["c"], "3"), (["d"], "4"))
    b = make(spark, (["a"], "1"), (["b"], "x"), (["c", "cc"], "3"), (["e"], "5"))
    assert sorted((r["term"], r["status"]) for r in relational.diff(a, b).collect()) == [("a", "same"), ("b", "changed"), ("c", "alternates"), ("d", "removed"), ("e", "added")]


def test_aliases(spark):
    got = relational.resolve_aliases(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "alias string, target string"))
    assert {r["alias"]: r["target"] for r in got.collect() if r["alias"] in "abc"} == {"a": "d", "b": "d", "c": "d"}


def test_size_parts(spark):
    e = make(spark, *[([str(k)], "x" * 10) for k in range(10)])
    assert [r["file_part"] for r in relational.size_parts(e, F.length("defi"), 25).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]


def test_reverse(spark):
    e = make(spark, (["dog"], "animal. big animal"), (["cat"], "animal"), (["x"], "other thing"))
    got = {r["word"]: r["labels"] for r in reverse.reverse(e).collect()}
    assert got["animal"] == "dog, cat" and got["thing"] == "x(%50.0)"
    assert {(r["word"], r["seq"]) for r in reverse.containing(e, spark.createDataFrame([("nima",)], "word string")).collect()} == {("nima", 0), ("nima", 1)}


def test_profile(spark):
    e = make(spark, (["A", "b"], '<div style="x">1</div> bword://q', "h"), (["c"], "plain"), ("i.png", b""))
    p = profile.profile(e)
    assert (p["word_count"], p["bword_count"], p["non_lowercase_word_count"], p["data_entry_count"]) == (3, 1, 1, 1)
    assert (p["defi_format"], p["defi_tag"], p["style"], p["data_entry_extension_count"]) == ("h=1, m=1", "div=1", "div=1", "png=1")


def test_info_aliases(spark):
    assert info_dict(info_table(spark, [("bookname", "x"), ("title", "y"), ("q", "z")])) == {"name": "y", "q": "z"}
    assert make(spark, (["a", "b"], "")).select(headword()).first()[0] == "a"
