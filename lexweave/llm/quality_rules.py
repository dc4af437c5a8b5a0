"""Operator 3: quality rules.

Exact text statistics with fixed base rules, then a logistic regression over
hashed word and byte n-grams: trained on labelled quality rows (a hash sample
of at most about ``TRAIN_ROWS``), calibrated on a fifth held out, and applied
in Arrow batches against the fixed threshold ``KEEP``.

Defined cases: a null or empty text has no words and fails the base rules;
very long texts are processed whole; repeated rows and ties get equal results;
an empty table gives no rows; without labels of both classes the base rules
alone decide.  Labels of one document that disagree count with their mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_task, fit_logistic, fit_platt, hash_sample, text_bytes
from .features import DIM, groups, mean_weight, sparse_row, word_codes

TRAIN_ROWS = 2000
KEEP = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

_byte = np.arange(256)
_IN_WORD = ((_byte & 0xC0) != 0x80) & (_byte != 32) & ~((_byte >= 9) & (_byte <= 13))
_SYMBOL = np.isin(_byte, list(SYMBOLS))


def repeated_words(words: list[bytes], codes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside ``width``-word windows that occur at least twice."""
    size = len(words) - width + 1
    if size < 2:
        return 0
    h = np.zeros(size, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + size].astype(np.uint64) + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    marked = np.zeros(size, bool)
    marked[order[1:][same]] = marked[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    hit = np.zeros(size + width, np.int64)
    for at in np.flatnonzero(marked).tolist():  # equal hashes are checked on the words
        first = seen.setdefault(tuple(words[at : at + width]), at)
        if first != at:
            for start in (first, at):
                hit[start] = 1
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit[:size])
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(text: bytes, words: list[bytes], codes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), int(count[_IN_WORD].sum()), int(count[_SYMBOL].sum()), len(lines) - len(set(lines)), repeated_words(words, codes)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """Weights and calibration, or None without both classes."""
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("_y"))
    chosen = hash_sample(marks, "doc_id", rows, marks.count())
    # One text for each id: repeated ids don't make the sample larger.
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("_y").alias("_y"))
    texts = own.select("doc_id", text_bytes().alias("_bytes"), F.col("_y").cast("double"))

    def featurise(batches):
        for batch in batches:
            idx, val = [], []
            for t in batch.column(1):
                raw = t.as_py()
                i, v = sparse_row(groups(np.frombuffer(raw, np.uint8), word_codes(raw.split())))
                idx.append(i.astype(np.int32).tobytes())
                val.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["k", "y", "i", "v"])

    return fit_in_task(texts.mapInArrow(featurise, "k string, y double, i binary, v binary"), _fit)


def _fit(got: list[dict]) -> dict | None:
    got.sort(key=lambda r: (r["k"], bytes(r["i"])))
    y = np.array([r["y"] for r in got])
    if len(y) == 0 or not ((y > 0.5).any() and (y <= 0.5).any()):
        return None
    x = [(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32)) for r in got]
    held = word_codes([r["k"].encode() for r in got]) % 5 == 0
    if len(set(y[~held] > 0.5)) < 2:
        held[:] = False
    fit = np.flatnonzero(~held)
    good = y[fit] > 0.5
    balance = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) * len(fit)
    w, _, b = fit_logistic([x[k] for k in fit], np.zeros((len(fit), 0)), y[fit], balance, 4 * DIM)
    test = np.flatnonzero(held) if held.any() and len(set(y[held] > 0.5)) == 2 else fit
    z = np.array([float(x[k][1] @ w[x[k][0]]) + b for k in test])
    a, c = fit_platt(z, (y[test] > 0.5).astype(float))
    return {"w": w, "b": b, "a": a, "c": c}


def judge(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, quality_prob, kept."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 4 * DIM weights
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            stats, prob = [], []
            for t in batch.column(1):
                raw = t.as_py()
                words = raw.split()
                codes = word_codes(words)
                stats.append(statistics(raw, words, codes))
                p = 1.0
                if m is not None:
                    z = mean_weight(groups(np.frombuffer(raw, np.uint8), codes), m["w"]) + m["b"]
                    p = float(1 / (1 + np.exp(-np.clip(m["a"] * z + m["c"], -30, 30))))
                prob.append(p)
            failed = [s[0] < MIN_WORDS or 100 * s[4] > MAX_REPEAT_PERCENT * s[0] for s in stats]
            kept = [not f and p >= keep for f, p in zip(failed, prob, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([s[k] for s in stats], pa.int64()) for k in range(5)), pa.array(failed, pa.bool_()), pa.array(prob, pa.float64()), pa.array(kept, pa.bool_())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_prob", "kept"],
            )

    return docs.select("doc_id", text_bytes().alias("_bytes")).mapInArrow(
        run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_prob double, kept boolean"
    )
