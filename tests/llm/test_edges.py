"""Brute-force versions of the latent search and the Markov scores; names that clash, repeated rows, odd texts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import decontaminate, langid, line_dedup, pii, quality_classifier, simhash, url_filter
from lexweave.llm.common import free_name, hash_sample


# --- Markov models -----------------------------------------------------------------------


def brute_model(texts):
    grams: dict = {}
    for t in texts:
        framed = b"\x02" * url_filter.ORDER + t.lower() + b"\x03"
        for at in range(url_filter.ORDER, len(framed)):
            for k in range(url_filter.ORDER + 1):
                follow = grams.setdefault(framed[at - k : at], {})
                follow[framed[at]] = follow.get(framed[at], 0) + 1
    return grams


def brute_probability(grams, context, byte):
    p = 1 / 256
    for k in range(len(context) + 1):
        follow = grams.get(context[len(context) - k :])
        if follow:
            p = (follow.get(byte, 0) + len(follow) * p) / (sum(follow.values()) + len(follow))
    return p


def brute_score(accept, reject, t):
    framed = b"\x02" * url_filter.ORDER + t.lower() + b"\x03"
    each = [(framed[at - url_filter.ORDER : at], framed[at]) for at in range(url_filter.ORDER, len(framed))]
    return sum(math.log(brute_probability(accept, c, b)) - math.log(brute_probability(reject, c, b)) for c, b in each) / len(each)


def test_markov_scores_equal_brute_force(spark):
    good = [f"{a}.example.net/en/{k}".encode() for k, a in enumerate(("river", "Stone", "field", "wood", "é") * 4)]
    bad = [f"casino-{a}.net/win/{k}".encode() for k, a in enumerate(("gold", "jack", "gold") * 4)]
    judged = [b"", b"casino", b"new.example.org/" + b"x" * 3000, "ü/é".encode()]
    rows = [(k, t, side, held) for k, (t, side, held) in enumerate([(t, "accept", False) for t in good] + [(t, "reject", False) for t in bad] + [(t, None, False) for t in judged] + [(good[0], "accept", True)])]
    got = {r["_row"]: r["score"] for r in url_filter.scored(spark.createDataFrame([(k, bytearray(t), s, h) for k, t, s, h in rows], "_row long, t binary, side string, held boolean")).collect()}
    accept, reject = brute_model(good), brute_model(bad)
    for k, t, _, _ in rows:
        assert got[k] == pytest.approx(brute_score(accept, reject, t), abs=1e-8)


# --- latent retrieval --------------------------------------------------------------------


def words_of(rng, n, size=60):
    return [f"w{min(rng.randrange(size), rng.randrange(size))}".encode() for _ in range(n)]


def test_common_subsequences_equal_one_by_one():
    rng = random.Random(3)
    named = [words_of(rng, n) for n in (1, 5, 20, 63, 64, 65, 130)]
    items = decontaminate.Items(named)
    text = words_of(rng, 900, 80)
    codes = np.array([items.words.get(w, 0) for w in text], np.int64)
    pairs = [(rng.randrange(len(named)), *sorted((rng.randrange(900), rng.randrange(900)))) for _ in range(300)]
    got = items.common(*(np.array([p[k] for p in pairs]) for k in range(3)), codes)
    assert got.tolist() == [decontaminate.lcs_length(named[i], text[a:b]) for i, a, b in pairs]


def test_search_equals_all_windows_one_by_one():
    rng = random.Random(5)
    named = [words_of(rng, n) for n in (8, 25, 40)]
    texts = [words_of(rng, n, 90) for n in (0, 3, 47, 48, 49, 200, 700)]
    texts[5][60:85] = named[1]
    texts[6][300:340] = [w if k % 4 else b"other" for k, w in enumerate(named[2])]
    texts[6][500:525] = named[1]
    items = decontaminate.Items(named)
    rows = np.random.default_rng(2).standard_normal((items.wide, 16)).astype(np.float32)
    rows[0] = 0
    latent = decontaminate._unit(np.stack([rows[c].sum(0) for c in items.coded]))
    coded = [np.array([items.words.get(w, 0) for w in t], "<i4") for t in texts]
    got = decontaminate.near_items(decontaminate.Layout([c.tobytes() for c in coded]), items, rows, latent, 1)
    want = {}
    for d, (t, c) in enumerate(zip(texts, coded, strict=True)):
        for start in range(0, max(len(t) - decontaminate.WINDOW, 0) + decontaminate.STRIDE, decontaminate.STRIDE):
            z = rows[c[start : start + decontaminate.WINDOW]].sum(0)
            for i, item in enumerate(named):
                if not c[start : start + decontaminate.WINDOW].any() or z @ latent[i] / max(np.linalg.norm(z), 1e-9) < decontaminate.CANDIDATE:
                    continue
                near = t[max(0, start - len(item)) : start + decontaminate.WINDOW + len(item)]
                share = decontaminate.lcs_length(item, near) / len(item)
                answer = item[-decontaminate.ANSWER :]
                if share >= decontaminate.LEAK or share >= decontaminate.LEAK_WITH_ANSWER and decontaminate.lcs_length(answer, near) >= 0.75 * len(answer):
                    want[d, i] = max(want.get((d, i), 0.0), share)
    assert {(f[0], f[1]): f[3] for f in got} == want
    assert {(5, 1), (6, 1), (6, 2)} <= set(want)


def test_svd_equals_the_exact_one(spark):
    rng = random.Random(7)
    items = decontaminate.Items([words_of(rng, 30, 25) for _ in range(4)])
    texts = [np.array([items.words.get(w, 0) for w in words_of(rng, n, 30)], "<i4") for n in (10, 60, 150, 300)]
    weight = np.linspace(0.5, 2, items.wide).astype(np.float32)
    weight[0] = 0
    passages = spark.createDataFrame([(bytearray(c.tobytes()),) for c in texts], "codes binary")
    got = decontaminate.randomized_svd(passages, items, weight, rank=3, rounds=60)
    rows = []
    for c in [*texts, *(c.astype("<i4") for c in items.coded)]:
        for start in range(0, max(len(c) - decontaminate.WINDOW, 0) + decontaminate.STRIDE, decontaminate.STRIDE):
            row = np.zeros(len(items.features))
            size = 0.0
            for w in c[start : start + decontaminate.WINDOW]:
                if w:
                    row[items.feature[w]] += weight[w]
                    size += weight[w] ** 2
            if size:
                rows.append(row / np.sqrt(size))
    exact = np.linalg.svd(np.array(rows))[2][:3].T
    assert np.linalg.svd(exact.T @ got)[1].min() > 0.99  # the same space


def test_the_svd_sees_every_document(spark, monkeypatch):
    """The space is fitted on all rows, repeated ones too, not on a sample."""
    seen, real = [], decontaminate.randomized_svd
    monkeypatch.setattr(decontaminate, "randomized_svd", lambda passages, *rest: (seen.append(passages.count()), real(passages, *rest))[1])
    docs = spark.range(2500).selectExpr("id DIV 2 AS doc_id", "concat('the owl sat on word', id DIV 2, ' of the old oak') AS text")
    items = spark.createDataFrame([(1, "the owl sat on word7 of the old oak")], "item_id long, text string")
    assert 7 in {r["doc_id"] for r in decontaminate.leaks(docs, items).collect()}
    assert seen == [2500]


def test_short_items_leak_as_whole_lines(spark):
    docs = spark.createDataFrame([(1, "first\nTwo  words!\nlast", 9), (2, "not two words here", 9), (None, "two words", 9), (4, None, 9)], "doc_id long, text string, _leak int")
    items = spark.createDataFrame([(7, "Two words."), (8, ""), (9, None)], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in decontaminate.leaks(docs, items).collect()) == [("1", 7), ("None", 7)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [2, 4]


# --- names, repeats, odd texts -----------------------------------------------------------

CLASH = "doc_id long, text string, _h string, _drop string, _drop_hash string, _removed string, _bytes string, `a.b` string"


def test_clashing_names_and_repeats(spark):
    same = " ".join(f"word{k}" for k in range(40))
    rows = [(1, same, *"abcdef"), (1, same, *"abcdef"), (1, "another text altogether under the first number", *"abcdef"), (2, same, *"ghijkl"), (3, None, *"ghijkl"), (None, same, *"ghijkl")]
    docs = spark.createDataFrame(rows, CLASH)
    kept = [tuple(r) for r in simhash.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
    out = line_dedup.dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and len(set(out.columns)) == len(out.columns)
    assert [r["_h"] for r in out.orderBy("doc_id", "text").collect()].count("a") == 3
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.keep(docs, labels).columns == docs.columns
    assert free_name(docs, "drop") == "__drop" and free_name(docs, "x") == "_x"


def test_samples_take_repeated_rows_once(spark):
    rows = spark.range(50).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"))
    assert hash_sample(rows, ["doc_id", "text"], 10, 5).count() == 1


def test_odd_texts():
    assert pii.base_spans("0" * 5000 + ".1.1.1 and 9" + "0" * 5000 + ".1.1.1") == [(0, 5006, 1)]
    assert not len(langid.buckets("\U000f0000\U000e0041 12")) and len(langid.buckets("\U00030000"))


def test_similar_pairs_are_found(spark):
    rng = random.Random(11)
    rows, pairs = [], []
    for k in range(60):  # similarity of five-word shingles a little over 0.8: every edit takes five shingles away
        words = [f"{k}v{rng.randrange(10**6)}" for _ in range(304)]
        other = list(words)
        for at in range(3, 304, 304 // 6):
            other[at] = f"{k}x{at}"
        a, b = ({tuple(w[j : j + 5]) for j in range(300)} for w in (words, other))
        assert 0.8 <= len(a & b) / len(a | b) < 0.86
        pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    kept = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(a in kept for a, _ in pairs) and sum(b not in kept for _, b in pairs) >= 0.9 * len(pairs)
