"""Operator 8: quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document; those that
look at one aspect (``ASPECTS``: marks, noise, toxic words) overlap.
Expectation-maximisation over the histogram of vote patterns (at most
3 ** labellers rows, from all documents) estimates for each aspect the share of
bad documents, each labeller's rates in both classes and each pattern's
posterior; a document is good if it is so in every aspect.
The posteriors of a hash sample of at most ``TRAIN_ROWS`` distinct documents, half of
them bad if there are so many, then train a linear scorer over hashed n-grams
and the labellers' measures; the scorer, calibrated on a fifth of the sample
with both sides weighted back to their numbers, decides.  Where all documents
are on one side, the label model's posterior decides.

The toxic word lists are learned from all labelled rows: words and word starts
that toxic rows have and others don't, in two folds for two labellers, beside a
fixed seed list.

Defined cases: null, empty and short texts get no votes and so the prior,
which keeps them; very long texts are processed whole; repeated rows get equal
results; empty tables and missing labels leave the seed list; extra columns
pass through ``keep`` unchanged.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import fit_in_task, fit_logistic, fit_platt, stored, text_bytes
from .features import DIM, groups, mean_weight, sparse_row, word_codes
from .quality_rules import repeated_words

TRAIN_ROWS = 2000
LEXICON_WORDS = 400
#: One in so many clean rows is counted first: what is too frequent in these alone needs no further count.
FIRST_ROWS = 16
PREFIX = 5
SHORT = 20
KEEP = 0.5
GOOD, BAD, NONE = 0, 1, 2
# Seed list of insults; frequent words of the corpus languages.
INSULTS = frozenset(b"idiot pathetic loser scum worthless clown disgusting moron stupid trash".split())
FUNCTION_WORDS = frozenset("the of and to in is that for it was de la le les et des du en un une que el los y se las por der die und den von zu das mit ist ein".encode().split())
_LETTERS = re.compile(r"[^\W\d_]+").findall
_BUCKETS = 1 << 20
_STRIP = b".,;:!?\"'()[]"


#: ASCII characters that are neither letters, digits, white space nor control characters.
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def marks(raw: np.ndarray, n: int) -> tuple[float, float]:
    """Runs of marks and marks that stand alone, by the number of words."""
    mark = np.concatenate([[False, False], _MARK[raw], [False]])
    gap = np.concatenate([[True, True], raw <= 32, [True]])
    runs = mark[2:-1] & mark[1:-2] & ~mark[:-3]
    alone = mark[2:-1] & gap[1:-2] & gap[3:]
    return float(runs.sum()) / n, float(alone.sum()) / n


def measures(text: bytes, words: list[bytes], codes: np.ndarray, lexicons: list[frozenset]) -> np.ndarray:
    """Shares that labellers and scorer look at."""
    n = max(len(words), 1)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = max(len(text) - count[9:14].sum() - count[32], 1)
    low = text.lower()
    plain = [w.strip(_STRIP) for w in low.split()]
    upper = count[65:91].sum() / max(count[65:91].sum() + count[97:123].sum(), 1)
    return np.array([
        len(words),
        sum(count[c] for c in b"#*$%&<>") / chars,
        upper,
        count[ord("|")] / n,
        count[ord("!")] / n,
        float((codes[1:] == codes[:-1]).mean()) if len(codes) > 1 else 0.0,
        len(np.unique(codes)) / n if len(words) else 1.0,
        repeated_words(words, codes) / n,
        sum(w in FUNCTION_WORDS for w in plain) / n,
        count[ord(".")] / n,
        *(float(sum(w in lex for w in plain)) for lex in lexicons[:3]),
        float(sum(w[:PREFIX] in lexicons[3] for w in plain)) if lexicons[3] else 0.0,
        *marks(np.frombuffer(text, np.uint8), n),
        count[_MARK].sum() / chars,
    ])


N_FORM = 11
#: Labellers of one aspect overlap and are modelled together: a text is bad if it is in one of these ways.  With how
#: many accusations an aspect starts as bad.
ASPECTS = {"marks": ((0, 2, 3, 8, 9, 10), 1), "noise": ((1, 4, 5, 6, 7), 1), "toxic": ((11, 12, 13, 14), 2)}


def votes(m: np.ndarray) -> str:
    """One digit per labeller: eleven on form, four on toxic words.

    A form labeller accuses beyond its limit, finds a text good within half of
    it and says nothing between, nor about a text of under SHORT words.
    """
    if m[0] < SHORT:
        form = [NONE] * N_FORM
    else:
        over = [m[1] / 0.05, m[2] / 0.5, m[3] / 0.2, m[4] / 0.3, m[5] / 0.2, varied(m[0]) / max(m[6], 1e-9), m[7] / 0.8, 0.01 / max(m[8], 1e-9), m[14] / 0.2, m[15] / 0.2, m[16] / 0.1]
        form = [BAD if x >= 1 else GOOD if x <= 0.5 else NONE for x in over]
    return "".join(map(str, form + [BAD if x > 0 else GOOD for x in m[10:14]]))


def varied(n: float) -> float:
    """The least share of distinct words that a text of ``n`` words may have: it falls as texts get longer."""
    return 0.2 * min(1.0, float(np.sqrt(2000 / n)) / 2)


def expectation_maximisation(patterns: list[str], counts: np.ndarray, at: tuple[int, ...], sure: int = 1, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """P(bad) per pattern and the table [labeller, class, vote] of vote probabilities.

    Each labeller has its own rates in both classes; a labeller that says
    nothing about a document is left out there.  The share of bad documents is
    estimated along with them.  The start takes documents with at least
    ``sure`` accusations for bad.
    """
    v = np.array([[int(p[k]) for k in at] for p in patterns])
    one = np.eye(3)[v]  # pattern, labeller, vote
    bad = (v == BAD).sum(1)
    post = np.where(bad >= sure, 0.97, np.where(bad > 0, 0.3, 0.01))
    rates = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        prior = min(max(float((post * counts).sum() / counts.sum()), 1e-3), 0.5)
        for c, w in ((0, 1 - post), (1, post)):
            rates[:, c] = (np.einsum("p,plv->lv", w * counts, one) + 0.01) / ((w * counts).sum() + 0.03)
        told = (one * (np.log(rates[:, 1]) - np.log(rates[:, 0])))[:, :, :NONE]
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + told.sum((1, 2)), -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, rates


def _word_rows(docs: DataFrame, marks: DataFrame, listed=None) -> DataFrame:
    """(doc_id, h, w, n): the words and word starts of each text of ``marks`` and how often they are in it.

    Of all words, or of those of ``listed``; texts without any give no row.  A bounded set of hash buckets spares
    most other texts the reading; the texts themselves aren't shuffled, and words go in one row a text.
    """
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(_BUCKETS)).cast("int")
    near = docs.join(F.broadcast(marks.select(bucket.alias("_b")).distinct()), bucket == F.col("_b"), "left_semi")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, words, many, ends = [], [], [], [0]
            for k, t in enumerate(batch.column(2).to_pylist()):
                own = Counter(x for x in _LETTERS(t.lower()) if len(x) > 2)
                for x, n in list(own.items()):
                    if len(x) >= PREFIX:
                        own[x[:PREFIX] + "*"] += n
                if listed is not None:
                    own = {x: own[x] for x in listed.value & own.keys()}
                if own:
                    at.append(k)
                    words += own.keys()
                    many += own.values()
                    ends.append(len(words))
            take, ends = pa.array(at, pa.int64()), pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((words, pa.string()), (many, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *lists], names=["doc_id", "h", "w", "n"])

    rows = near.filter("text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, w array<string>, n array<long>")
    return rows.join(marks.select("doc_id"), "doc_id")


def toxic_lexicons(docs: DataFrame, labels: DataFrame) -> list[frozenset]:
    """Seed words, words of two folds, word starts."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") > 0.5).alias("_t"))
    sizes = {r["_t"]: r["n"] for r in marks.groupBy("_t").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return [INSULTS, frozenset(), frozenset(), frozenset()]
    n_t, n_c = max(1, sizes[True] / 2), max(1, sizes[False] / 2)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold")
    # In toxic rows a word counts once per text, so copies of one text don't make a toxic word.
    texts = _word_rows(docs, marks.filter("_t")).select("h", fold, "w").groupBy("h", "fold").agg(F.first("w").alias("w"))
    toxic = texts.select("fold", F.explode("w").alias("w")).groupBy("w", "fold").agg(F.count("*").alias("t"))
    strong = stored(toxic.filter(F.col("t") >= max(4.0, 0.01 * n_t)), "toxic_candidates")
    # Counts only grow with the rows: a word that is too frequent in a part of the clean rows is so in all of them.
    # So few words are left for the count of all; a text has a bounded number of words that a hundredth of the toxic ones have.
    clean = marks.filter("not _t")
    for part in (clean.filter(F.pmod(F.xxhash64("doc_id", F.lit("first")), F.lit(FIRST_ROWS)) == 0), clean):
        listed = docs.sparkSession.sparkContext.broadcast(frozenset(r["w"] for r in strong.select("w").distinct().collect()))
        rows = _word_rows(docs, part, listed).select(fold, F.explode(F.arrays_zip("w", "n")).alias("x"))
        counted = rows.groupBy(F.col("x.w").alias("w"), "fold").agg(F.sum("x.n").alias("c"))
        strong = strong.select("w", "fold", "t").join(counted, ["w", "fold"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
        strong = stored(strong.filter(F.col("c") / n_c <= 0.01 * F.col("t") / n_t), "toxic_words")
    found = strong.orderBy(F.desc("t"), "w", "fold").limit(3 * LEXICON_WORDS).collect()  # bounded by the parameter
    words = [frozenset(r["w"].encode() for r in found if r["fold"] == fold and not r["w"].endswith("*")) for fold in (0, 1)]
    both = {r["w"] for r in found if r["fold"] == 0} & {r["w"] for r in found if r["fold"] == 1}
    return [INSULTS, *words, frozenset(w[:-1].encode() for w in both if w.endswith("*"))]


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    lexicons = toxic_lexicons(docs, labels)

    def vote(batches):
        """Numbers of patterns, and for each the documents that come first by hash: TRAIN_ROWS at most."""
        total: dict[str, int] = {}
        first: dict[str, set[int]] = {}
        for batch in batches:
            for t, row in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = (raw := t.as_py()).split()
                key = votes(measures(raw, words, word_codes(words), lexicons))
                total[key] = total.get(key, 0) + 1
                if row is None:
                    continue
                own = first.setdefault(key, set())
                own.add(row)
                if len(own) >= 4 * TRAIN_ROWS:
                    first[key] = set(sorted(own)[:TRAIN_ROWS])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([sorted(first.get(p, ()))[:TRAIN_ROWS] for p in total], pa.list_(pa.int64()))], names=["p", "n", "rows"])

    keyed = docs.select("doc_id", text_bytes().alias("_bytes")).withColumn("_row", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "_bytes", F.lit("sample"))))
    voted = stored(keyed.select("_bytes", "_row").mapInArrow(vote, "p string, n long, rows array<long>"), "quality_votes")
    histogram = voted.groupBy("p").agg(F.sum("n").alias("n")).collect()
    if not histogram:
        return {"lexicons": lexicons, "w": None, "posterior": {}}
    histogram.sort(key=lambda r: r["p"])
    patterns, counts = [r["p"] for r in histogram], np.array([r["n"] for r in histogram], float)
    fine, rates = np.ones(len(patterns)), {}
    for aspect, (at, sure) in ASPECTS.items():
        bad, rates[aspect] = expectation_maximisation(patterns, counts, at, sure)
        fine *= 1 - bad
    posterior = dict(zip(patterns, fine.tolist(), strict=True))
    label_model = {"lexicons": lexicons, "w": None, "posterior": posterior, "rates": rates}
    sides = docs.sparkSession.createDataFrame([(p, bool(q > KEEP)) for p, q in posterior.items()], "p string, good boolean")
    listed = voted.join(F.broadcast(sides), "p").select("good", F.explode("rows").alias("_row"))  # a row per pattern
    bad = listed.filter("not good").select("_row").distinct().orderBy("_row").limit(TRAIN_ROWS).collect()
    good = listed.filter("good").select("_row").distinct().orderBy("_row").limit(TRAIN_ROWS).collect()
    n_bad = min(len(bad), max(TRAIN_ROWS // 2, TRAIN_ROWS - len(good)))
    chosen = [(r["_row"],) for r in bad[:n_bad] + good[: TRAIN_ROWS - n_bad]]
    if not bad or not good:
        return label_model
    sample = keyed.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "_row long")), "_row").groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("_bytes").alias("_bytes")).select("doc_id", "_bytes")

    def featurise(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1):
                words = (raw := t.as_py()).split()
                codes = word_codes(words)
                m = measures(raw, words, codes, lexicons)
                i, v = sparse_row(groups(np.frombuffer(raw, np.uint8), codes))
                rows.append((votes(m), i.astype(np.int32).tobytes(), v.tobytes(), dense(m).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), *(pa.array([r[k] for r in rows], pa.string() if k == 0 else pa.binary()) for k in range(4))], names=["k", "p", "i", "v", "d"])

    scorer = fit_in_task(sample.mapInArrow(featurise, "k string, p string, i binary, v binary, d binary"), lambda got: _fit_scorer(got, posterior, patterns, counts))
    return label_model | (scorer or {})


def _fit_scorer(got: list[dict], posterior: dict[str, float], patterns: list[str], counts: np.ndarray) -> dict | None:
    """The linear scorer and its calibration, or None where the sample is on one side."""
    got.sort(key=lambda r: (r["k"], bytes(r["i"])))
    y = np.array([posterior[r["p"]] for r in got])
    if not ((y > KEEP).any() and (y <= KEEP).any()):
        return None
    x = [(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32)) for r in got]
    d = np.stack([np.frombuffer(r["d"], np.float64) for r in got])
    held = word_codes([r["k"].encode() for r in got]) % 5 == 0
    if len(set(y[~held] > 0.5)) < 2:
        held[:] = False
    use = np.flatnonzero(~held)
    good = y[use] > 0.5
    balance = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) * len(use)
    w, dw, b = fit_logistic([x[k] for k in use], d[use], y[use], balance, 4 * DIM, steps=80)
    test = np.flatnonzero(held) if held.any() and len(set(y[held] > 0.5)) == 2 else use
    z = np.array([float(x[k][1] @ w[x[k][0]]) for k in test]) + d[test] @ dw + b
    # Both sides count in the calibration as they do in the corpus.
    on_good = np.array([posterior[p] > 0.5 for p in patterns])
    share = np.where(y[test] > 0.5, counts[on_good].sum() / (y[test] > 0.5).sum(), counts[~on_good].sum() / (y[test] <= 0.5).sum())
    a, c = fit_platt(z, (y[test] > 0.5).astype(float), share * len(test) / counts.sum())
    return {"w": w, "d": dw, "b": b, "a": a, "c": c}


def dense(m: np.ndarray) -> np.ndarray:
    """Bounded forms of the measures, and which labellers accuse."""
    v = votes(m)
    return np.concatenate([np.minimum(m[1:10], 2.0), np.minimum(m[10:14], 3.0), np.minimum(m[14:], 2.0), [float(c == "1") for c in v]])


def score(docs: DataFrame, model: dict, keep: float = KEEP) -> DataFrame:
    """doc_id, votes, posterior (of the label model), quality_prob (of the scorer), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * DIM weights, 3 * LEXICON_WORDS words, a row per pattern
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes().alias("_bytes")).mapInArrow(_scorer(shared, keep, 1), f"doc_id {kind}, votes string, posterior double, quality_prob double, kept boolean")


def _scorer(shared, keep: float, text_at: int):
    def run(batches):
        m = shared.value
        for batch in batches:
            rows = []
            for t in batch.column(text_at):
                words = (raw := t.as_py()).split()
                codes = word_codes(words)
                seen = measures(raw, words, codes, m["lexicons"])
                pattern = votes(seen)
                q = m["posterior"].get(pattern)
                p = q
                if p is None:  # never seen by the label model: any accusation decides
                    p = float(str(BAD) not in pattern)
                if m["w"] is not None:
                    z = mean_weight(groups(np.frombuffer(raw, np.uint8), codes), m["w"]) + float(dense(seen) @ m["d"]) + m["b"]
                    p = float(1 / (1 + np.exp(-np.clip(m["a"] * z + m["c"], -30, 30))))
                rows.append((pattern, q, p, p >= keep))
            columns = batch.columns[:text_at]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in rows], k_type) for k, k_type in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_())))], names=[*batch.schema.names[:text_at], "votes", "posterior", "quality_prob", "kept"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    run = _scorer(shared, least, 0)

    def accepted(batches):
        for batch in batches:
            ok = next(iter(run([pa.RecordBatch.from_arrays([batch.column(1)], names=["text"])]))).column(3)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["row"]).filter(ok)

    # All columns in one, so that any name passes.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_bytes().alias("text"))
    kept = rows.mapInArrow(accepted, StructType([StructField("row", docs.schema)]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
