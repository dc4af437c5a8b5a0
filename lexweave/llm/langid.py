"""Operator 9: language identification by nearest centroid.

A text is lower-cased, everything but letters becomes a gap, and its character
1- to 3-grams are hashed.  Vectors are (1 + log tf) * idf, normalised; each
language has a few centroids from spherical k-means, and a text gets the
language of the centroid with the highest cosine.  The idf covers every
training document; centroids are fitted on a hash sample of about
``PER_LANGUAGE`` documents a language.  ``rejected`` marks texts farther from
their centroid than ``MAX_DISTANCE`` times what training texts of that
centroid show.

Training uses text and non-null lang of the documents for which
crc32(doc_id as text) mod 3 is not 1.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
so is every text if nothing was learned; very long texts are processed whole;
ties go to the language that sorts first; repeated rows get equal results; a
null doc_id counts as held out (its remainder is unknown, so it isn't learned).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_task

DIM = 1 << 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 500
CENTROIDS = 3
MAX_DISTANCE = 1.5
UNKNOWN = "und"

#: code point -> itself if a letter, else 0
_LETTER = np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def buckets(text: str) -> np.ndarray:
    """Bucket of each character n-gram; empty if the text has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = _LETTER[points]
    if not points.any():
        return np.zeros(0, np.int64)
    points = np.concatenate([[0], points, [0]]).astype(np.uint32)
    points = points[(points != 0) | np.concatenate([[True], points[:-1] != 0])]  # one gap at a time
    out = []
    h = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        size = len(points) - n + 1
        if size <= 0:
            break
        h = (h[:size] ^ points[n - 1 :]) * np.uint32(2654435761)
        h ^= h >> np.uint32(16)
        keep = h[points[:size] != 0] if n == 1 else h
        out.append((keep * np.uint32(2246822519)) >> np.uint32(17))
    return np.concatenate(out).astype(np.int64)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, normalised weights)."""
    count = np.bincount(buckets(text), minlength=DIM)
    at = np.flatnonzero(count)
    w = (1 + np.log(count[at])) * idf[at]
    size = float(np.sqrt((w * w).sum()))
    return at, (w / size if size > 0 else w).astype(np.float32)


def is_held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, started by farthest points."""
    c = [x.mean(0)]
    for _ in range(k - 1):
        c.append(x[np.argmin(np.max(np.stack([x @ (y / max(np.linalg.norm(y), 1e-9)) for y in c]), 0))])
    c = np.stack(c)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame) -> dict | None:
    learn = docs.filter(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                seen = np.zeros(DIM, bool)
                seen[buckets(t.as_py())] = True
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["b", "n"])

    rows = learn.select("text").mapInArrow(frequencies, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()  # DIM + 1 rows at most
    total = int(rows.loc[rows["b"] == -1, "n"].sum())
    if total == 0:
        return None
    idf = np.full(DIM, np.log(1.0 + total) + 1, np.float32)
    rows = rows[rows["b"] >= 0]
    idf[rows["b"].to_numpy()] = np.log((1.0 + total) / (1.0 + rows["n"].to_numpy())) + 1
    counts = learn.groupBy("lang").agg((F.lit(2.0**32 * PER_LANGUAGE) / F.count("*")).alias("_share"))
    # Chosen by text, equal texts once: neither repeated ids nor repeated rows make the sample larger.
    chosen = learn.join(F.broadcast(counts), "lang").filter("(xxhash64(text, 'sample') & 4294967295) < _share").select("lang", "text").distinct()

    def vectors(batches):
        for batch in batches:
            rows = [vector(t.as_py(), idf) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary()), pa.array([w.tobytes() for _, w in rows], pa.binary())], names=["lang", "i", "w"])

    found = fit_in_task(chosen.select("text", "lang").mapInArrow(vectors, "lang string, i binary, w binary"), _centroids)
    return found if found is None else found | {"idf": idf}


def _centroids(got: list[dict]) -> dict | None:
    got = sorted((r for r in got if r["i"]), key=lambda r: (r["lang"], bytes(r["i"]), bytes(r["w"])))
    if not got:
        return None
    langs, centres, spread = [], [], []
    for lang in sorted({r["lang"] for r in got}):
        own = [r for r in got if r["lang"] == lang]
        x = np.zeros((len(own), DIM), np.float32)
        for k, r in enumerate(own):
            x[k, np.frombuffer(r["i"], np.int32)] = np.frombuffer(r["w"], np.float32)
        c = _kmeans(x, min(CENTROIDS, len(own)))
        cos = x @ c.T
        near = cos.argmax(1)
        for j in range(len(c)):
            langs.append(lang)
            centres.append(c[j])
            own_cos = cos[near == j, j]
            spread.append(float(np.quantile(1 - own_cos, 0.99)) if len(own_cos) else 1.0)
    return {"langs": langs, "centres": np.ascontiguousarray(np.stack(centres).T), "spread": np.array(spread)}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine, 0 to 1), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM * CENTROIDS floats a language
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            lang, score, rejected = [], [], []
            for t in batch.column(1):
                at = w = None
                if m is not None and t.is_valid:
                    at, w = vector(t.as_py(), m["idf"])
                if at is None or not len(at):
                    lang.append(UNKNOWN), score.append(0.0), rejected.append(True)
                    continue
                cos = w @ m["centres"][at]
                best = int(cos.argmax())
                lang.append(m["langs"][best])
                score.append(min(1.0, max(0.0, float(cos[best]))))
                rejected.append(bool(1 - cos[best] > MAX_DISTANCE * m["spread"][best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text", is_held_out().alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
