"""The quality classifier rejects bad documents however rare they are."""

from lexweave.llm import quality_classifier


def corpus(spark, n, bad):
    good = [f"The plain prose number {k} has a few words and it ends with a dot. It goes on with more plain words of the day {k * 7}." for k in range(n)]
    junk = [f"WIN!! CASH!! NOW{k}!! ### $$$ CLICK!! {k} %%% &&& FREE!! MONEY!! *** GET!! RICH!! FAST!! TODAY!! {k * 3} BUY!! IT!! HERE!! {k * 5} SAVE!! BIG!!" for k in range(bad)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    return docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_rare_bad_documents_go(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "TRAIN_ROWS", 40)
    docs, labels = corpus(spark, 1500, 3)
    kept = {r["doc_id"] for r in quality_classifier.keep(docs, labels).collect()}
    assert not kept & {1500, 1501, 1502}
    assert len(kept) >= 1485


def test_one_class_falls_back_on_the_label_model(spark):
    docs, labels = corpus(spark, 0, 30)
    rows = quality_classifier.classify(docs, labels).collect()
    assert all(r["posterior"] is not None and r["kept"] == (r["posterior"] >= 0.5) for r in rows)
    assert not any(r["kept"] for r in rows)


def test_toxic_words_come_from_all_labelled_rows(spark):
    """A word that all toxic and none but 2 % of the clean rows have: counts are of all rows, not of a sample."""
    docs = spark.range(8000).selectExpr("id AS doc_id", "concat('row ', id, if(id % 2 = 0, ' says zorgling to you', if(id % 100 = 1, ' zorgling', ' nothing'))) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "cast(doc_id % 2 = 0 AS int) AS toxic")
    lexicons = quality_classifier.toxic_lexicons(docs, labels)
    assert all(b"zorgling" not in words for words in lexicons), "found in 80 clean rows: 2 % against the 1 % allowed"
    once = docs.selectExpr("doc_id", "if(doc_id = 7777, concat(text, repeat(' zorgling', 100)), if(doc_id % 100 = 1, 'row', text)) AS text")
    fold = spark.range(1).selectExpr("pmod(xxhash64(7777L), 2) AS f").first()["f"]
    lexicons = quality_classifier.toxic_lexicons(once, labels)
    assert b"zorgling" in lexicons[2 - fold] and b"zorgling" not in lexicons[1 + fold], "the one row with it counts"


def test_words_are_joined_by_text(spark, monkeypatch):
    """Words go in one row a text, and of the clean rows only words are counted that a part of them hasn't shown to be common."""
    made = []

    def seen(docs, marks, listed=None, real=quality_classifier._word_rows):
        rows = real(docs, marks, listed)
        made.append((None if listed is None else set(listed.value), rows.count()))
        return rows

    monkeypatch.setattr(quality_classifier, "_word_rows", seen)
    common = " ".join(f"{a}{b}mon" for a in "abcdefgh" for b in "abcdefgh")
    docs = spark.range(4000).selectExpr("id AS doc_id", f"concat('{common} row', if(id % 10 = 0, concat(' zorgling ', translate(id, '0123456789', 'abcdefghij')), if(id = 5, ' zorgling', ''))) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "cast(doc_id % 10 = 0 AS int) AS toxic")
    lexicons = quality_classifier.toxic_lexicons(docs, labels)
    assert all({b"zorgling"} == words for words in lexicons[1:3]) and lexicons[3] == {b"zorgl"}
    assert made[0] == (None, 400), "a row for each toxic text"
    assert len(made[1][0]) > 60 and made[-1] == ({"zorgling", "zorgl*"}, 1), "all clean rows are counted; one has a word that is left"
