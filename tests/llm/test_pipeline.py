"""The pipeline on a small fixture, each stage judged on its own input."""

import random

import pytest

from tests.llm.test_duplicates import brute_dedup


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(21)
    function = "the of and to in is that for it was".split()
    word = lambda: "".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(4, 8)))
    prose = lambda n: " ".join(rng.choice(function) if rng.random() < 0.4 else word() for _ in range(n)) + "."
    items = [prose(40) for _ in range(8)]
    rows, labels = [], []
    for k in range(160):
        text, quality, toxic = "\n".join(prose(40) for _ in range(4)), 1, 0
        if k % 8 == 1:
            text, quality = " ".join(w.upper() + "!!" for w in text.split()), 0
        elif k % 8 == 2:
            text, toxic = text.replace(" the ", " idiot scum ", 2), 1
        elif k % 8 == 3 and k > 8:
            text = rows[k - 3][1]  # an exact copy
        elif k % 8 == 5:
            text += "\n" + items[k % 8]
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, quality, toxic))
    rows.append((999, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        path = f"{folder}/stage{n}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if n < 4:
            assert docs.columns == columns
            kept[name] = {r["doc_id"] for r in after}
        if n == 0:
            assert sum(k % 8 == 1 for k in kept[name] if k != 999) <= 2, "junk goes"
            assert sum(k % 8 == 0 for k in kept[name] if k != 999) >= 19, "clean documents stay"
        if n == 1:
            ids = sorted(before)
            want = dict(zip(ids, brute_dedup([before[k]["text"] for k in ids]), strict=True))
            assert all((r["text"] or "") == want[r["doc_id"]] for r in after)
            assert not any(k % 8 == 3 and k > 8 for k in kept[name] if k != 999), "copies lose all lines and go"
        if n == 3:
            items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            leaking = {k for k, r in before.items() if any(i in (r["text"] or "") for i in items)}
            assert leaking and not leaking & kept[name], "leaks go; copies of a leak went with their lines before"
            assert set(before) - leaking == kept[name]
    assert {r["doc_id"] for r in after} == set(before)


def test_run(spark, folder):
    import corpus_pipeline

    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, folder).count() > 0
