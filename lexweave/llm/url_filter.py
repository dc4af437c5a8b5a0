"""Operator 10: URL filters.

Host rules decide first (the longest that fits); other URLs get the verdict of
two character language models, one of accepted and one of rejected URLs: the
length-normalised difference of their log-likelihoods against a threshold
calibrated on held-out training URLs.

Training URLs: rejected are those whose host has a word of ``SEED_TERMS``;
accepted are the others except those that a rule blocks (a block is policy and
says nothing about the spelling).  Counts cover all pages; every fifth URL (by
hash) is left out of the counts and sets the threshold.

The models are variable-order Markov models over bytes: Witten-Bell smoothing
backs off from ``ORDER`` preceding bytes to none.  All counts are exact and in
tables that grow with the corpus: one row per distinct window of ORDER + 1
bytes.  Windows that share their two bytes before the last meet in one
partition, which has all that orders 2 to ORDER need; orders 0 and 1 have at
most 256 * 257 counts, which are broadcast.  URLs are scored by a join with the
table of windows; frequent windows are salted.

Defined cases: null URLs and URLs without ``://`` have an empty host and path;
with nothing to judge (empty URL) or only one kind of training URL, the method
allows, with score 0; very long URLs are scored whole; repeated rows get equal
results each; an empty table gives no rows; a null page_id keeps its row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, stored

ORDER = 5
HELD_OUT = 5
# Words of hosts that seed the rejected model.
SEED_TERMS = (
    "ads", "adult", "bet", "bets", "betting", "bingo", "casino", "cialis", "clickbait", "cracked", "dating", "escort", "gambling", "hookup", "jackpot",
    "keygen", "loan", "loans", "lottery", "malware", "nude", "payday", "pharma", "phishing", "pills", "poker", "popup", "porn", "replica", "scam",
    "sex", "slots", "spam", "spyware", "tracker", "viagra", "warez", "xxx",
)
# Fixed values: (verdict, host, path start).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the longest is tried first
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(own + start).alias("rule"))).otherwise(out)
    return out


def _scored_part(url: Column) -> Column:
    """What the models read: everything after ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit("")).cast("binary")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of all positions of all texts: a byte and the ORDER bytes before it, as one number."""
    framed = [b"\x02" * ORDER + t.lower() + b"\x03" for t in texts]
    raw = np.frombuffer(b"".join(framed), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, framed), np.int64, len(framed))
    row = np.repeat(np.arange(len(framed)), size)
    at = np.flatnonzero(np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size) >= ORDER)
    window = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        window = window << 8 | raw[at - k]
    return row[at], window


def _order_counts(window: np.ndarray, count: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: count of its last order + 1 bytes, count of their context, and how many bytes follow that."""
    gram = window & ((1 << 8 * (order + 1)) - 1)
    grams, own = np.unique(gram, return_inverse=True)
    c = np.bincount(own, count, len(grams))
    contexts, of = np.unique(grams >> 8, return_inverse=True)
    n, kinds = np.bincount(of, c, len(contexts)), np.bincount(of, c > 0, len(contexts))
    return c[own], n[of][own], kinds[of][own]


def witten_bell(window: np.ndarray, count: np.ndarray, p: np.ndarray, orders) -> np.ndarray:
    """Probabilities of the last bytes of ``window`` after ``orders``, from those of the order before."""
    for order in orders:
        c, n, kinds = _order_counts(window, count, order)
        p = np.where(n > 0, (c + kinds * p) / np.maximum(n + kinds, 1), p)
    return p


def log_ratios(counted: DataFrame) -> DataFrame | None:
    """(w, n, d): log-likelihood difference, accepted minus rejected, of each window of ``counted`` (w, accept, reject, n)."""
    low = counted.groupBy(F.col("w").bitwiseAND(F.lit(0xFFFF)).alias("g")).agg(F.sum("accept").alias("a"), F.sum("reject").alias("r")).collect()  # 256 * 257 rows at most
    pairs = np.array([r["g"] for r in low], np.int64)
    sides = [np.array([r[k] for r in low], float) for k in ("a", "r")]
    if not all(x.sum() > 0 for x in sides):
        return None
    order = np.argsort(pairs)
    known = pairs[order], [witten_bell(pairs, x, np.full(len(pairs), 1 / 256), (0, 1))[order] for x in sides]
    shared = counted.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        parts = [[batch.column(k).to_numpy() for k in range(4)] for batch in batches]
        if not parts:
            return
        w, accept, reject, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
        keys, start = shared.value
        at = np.searchsorted(keys, w & 0xFFFF)
        logs = [np.log(witten_bell(w, x.astype(float), p[at], range(2, ORDER + 1))) for x, p in zip((accept, reject), start, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n), pa.array(logs[0] - logs[1])], names=["w", "n", "d"])

    dealt = counted.select("w", "accept", "reject", "n").repartition(F.shiftright("w", 8).bitwiseAND(F.lit(0xFFFF)))
    return dealt.mapInArrow(run, "w long, n long, d double")


def scored(rows: DataFrame) -> DataFrame:
    """(_row, score) of ``rows`` (_row, t, side, held): mean log-likelihood difference a character; no rows without both sides."""

    def spread(batches):
        for batch in batches:
            row, w = windows(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row]), pa.array(w)], names=["_row", "w"])

    def count(batches):
        """Counts of one batch at a time: memory doesn't grow with the partition."""
        for batch in batches:
            row, w = windows(batch.column(0).to_pylist())
            side = batch.column(1).to_numpy()[row]
            own, at = np.unique(w, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(np.bincount(at, use, len(own)).astype(np.int64)) for use in (side == 1, side == 2, np.ones(len(w))))], names=["w", "accept", "reject", "n"])

    learns = F.when(F.col("held") | F.col("side").isNull(), 0).when(F.col("side") == "accept", 1).otherwise(2)
    counted = rows.select("t", learns.cast("long").alias("s")).mapInArrow(count, "w long, accept long, reject long, n long")
    counted = stored(counted.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("accept", "reject", "n")]), "url_windows")
    ratios = log_ratios(counted)
    if ratios is None:
        return rows.select("_row", F.lit(0.0).alias("score")).filter("false")
    each = rows.select("_row", "t").mapInArrow(spread, "_row long, w long")
    met = join_by_key(each, stored(ratios, "url_ratios"), "w", "n")
    return met.groupBy("_row").agg(F.round(F.avg("d"), 9).alias("score"))  # rounded: the order of a sum isn't fixed


def threshold(judged: DataFrame) -> float:
    """The middle of the best plateau of balanced accuracy, from held-out scores in 401 fixed bins by side."""
    at = F.least(F.greatest(F.round(F.col("score") * 50) + 200, F.lit(0)), F.lit(400)).cast("int")
    total = np.zeros((2, 401))
    for r in judged.filter("held and side is not null").groupBy((F.col("side") == "accept").cast("int").alias("s"), at.alias("at")).agg(F.count("*").alias("n")).collect():
        total[r["s"], r["at"]] = r["n"]
    if not (total[0].sum() and total[1].sum()):
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(total, 1)], 1)
    gain = below[0] / total[0].sum() + 1 - below[1] / total[1].sum()
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[len(best) // 2] - 0.5 - 200) / 50)


def judge(pages: DataFrame, rules=RULES, seeds=SEED_TERMS) -> DataFrame:
    """page_id, host, path, rule, verdict, score."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seeded = F.col("host").rlike(r"(^|[.\-])(" + "|".join(seeds) + r")([.\-]|$)")
    side = F.when(F.col("host") == "", F.lit(None)).when(seeded, "reject").when(F.col("_r.verdict") == "block", F.lit(None)).otherwise("accept")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), rule_column(host, path, rules).alias("_r"), _scored_part(F.col("url")).alias("t"), (F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0).alias("held"))
    rows = rows.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("by_rule"), "t", side.alias("side"), "held", F.monotonically_increasing_id().alias("_row"))
    rows = stored(rows, "urls")  # from here on a row keeps its number
    judged = rows.join(stored(scored(rows), "url_scores"), "_row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    limit = threshold(judged)
    allowed = (F.length("t") == 0) | (F.col("score") >= limit)
    verdict = F.coalesce("by_rule", F.when(allowed, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
