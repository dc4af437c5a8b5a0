"""Operator 4: personal data by base patterns and bootstrapped contextual extraction.

Base kinds are exact regular expressions with checks.  Beside them, tokens of
letters and digits are candidate identifiers, and so is any value that stands
after a key, whatever its characters and length; such a value has its key as
its only pattern, unless it is such a token too.  A candidate is an instance that
is linked to patterns: the key before it (``password=``, ``token: "``), the
class of its characters, and its prefix with class and length.  Seeds are the
base entities and candidates after a key of ``SEED_KEYS`` or with a prefix of
``SEED_PREFIXES``.  Spark scores the graph for ``ROUNDS`` rounds: a pattern's
confidence is the smoothed share of trusted weight among its instances, an
instance's weight the noisy-or of its confident patterns.  Candidates of
patterns with at least ``CONFIDENT`` in the end are added as kind ``id``.

Defined cases: a null text is empty and has no spans; very long texts are
processed whole; repeated rows get equal results; equal starts are ordered by
kind; an empty table gives no rows; a null doc_id keeps its row.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, stored

KINDS = ("email", "ip", "card", "phone", "id")
# Where trust starts.
SEED_KEYS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey")
SEED_PREFIXES = ("AKIA",)
ROUNDS = 3
CONFIDENT = 0.6
SUPPORT = 3
MIN_LENGTH = 8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9_]+")
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_KEY = re.compile(r"([A-Za-z_]{2,20})\s{0,3}[=:]\s{0,3}[\"']?\Z")

_AFTER = re.compile(r"[=:]\s{0,3}[\"']?(?=[A-Za-z0-9_(])")
#: A number in three groups, or words joined by single signs.
_VALUE = re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,4}(?![A-Za-z0-9_])|[A-Za-z0-9_]+(?:[-.@+/][A-Za-z0-9_]+)*")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base kinds, by start, then kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # the leftmost match with this @ starts where its run of local characters does
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.groups()):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((*m.span(), 2))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((*m.span(), 3))
        at = text.find("+", m.end() if m else at + 1)
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def shape(token: str) -> str:
    if all(c in "0123456789abcdef" for c in token):
        return "hex"
    letters = [c for c in token if c.isalpha()]
    return "upper" if all(c.isupper() for c in letters) else "lower" if all(c.islower() for c in letters) else "mixed"


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, list[str], bool]]:
    """(start, end, patterns, seed) of identifier-like tokens outside ``taken``."""
    out, free = [], 0
    cover = iter(sorted((s, e) for s, e, _ in taken))
    span = next(cover, None)
    for digit in _DIGIT.finditer(text):
        if digit.start() < free:
            continue
        start = digit.start()
        while start > free and text[start - 1] in _TOKEN_CHARS:
            start -= 1
        end = free = _TOKEN.match(text, start).end()
        while span is not None and span[1] <= start:
            span = next(cover, None)
        if span is not None and span[0] < end or end - start < MIN_LENGTH:
            continue
        token = text[start:end]
        if sum(c.isdigit() for c in token) < 2 or not any(c.isalpha() for c in token):
            continue
        key = _KEY.search(text, max(0, start - 32), start)
        kind = shape(token)
        patterns = [f"class:{kind}", f"form:{kind}:{'' if kind == 'hex' else token[:4]}:{end - start}"]
        if key:
            patterns.append(f"key:{key[1].lower()}")
        out.append((start, end, patterns, token.startswith(SEED_PREFIXES) or bool(key and key[1].lower() in SEED_KEYS)))
    return out


def keyed(text: str, taken: list[tuple[int, int, int]], known: set[tuple[int, int]]) -> list[tuple[int, int, list[str], bool]]:
    """(start, end, patterns, seed) of values after a key that are outside ``taken`` and not ``known`` yet."""
    out = []
    spans = sorted((s, e) for s, e, _ in taken)
    starts, ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    for m in _AFTER.finditer(text):
        value = _VALUE.match(text, m.end())
        key = value and _KEY.search(text, max(0, m.end() - 32), m.end())
        if not key or value.span() in known:
            continue
        before = bisect_left(starts, value.end())
        if before and ends[before - 1] > value.start():
            continue
        out.append((*value.span(), [f"key:{key[1].lower()}"], key[1].lower() in SEED_KEYS))
    return out


_SPAN = "struct<start:long,end:long,kind:int>"
_CAND = "struct<start:long,end:long,inst:long,seed:boolean,patterns:array<string>>"


def _instance(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode()) - 2**63


def scan(docs: DataFrame) -> DataFrame:
    """Per document: base spans and candidates, with a row number for later joins."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])),
             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("inst", pa.int64()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]))]

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            spans, found, rows = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in base])
                free = candidates(text, base)
                free += keyed(text, base, {(s, e) for s, e, _, _ in free})
                cand = [{"start": s, "end": e, "inst": _instance(text[s:e]), "seed": seed, "patterns": p} for s, e, p, seed in free]
                cand += [{"start": s, "end": e, "inst": _instance(text[s:e]), "seed": True, "patterns": [f"key:{m[1].lower()}"]}
                         for s, e, _ in base if (m := _KEY.search(text, max(0, s - 32), s))]
                found.append(cand)
                rows.append(number)
                number += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, types[0]), pa.array(spans, types[1]), pa.array(found, types[2])], names=["doc_id", "_row", "base", "cand"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, _row long, base array<{_SPAN}>, cand array<{_CAND}>")


def learn_patterns(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, conf) of all patterns by iterated scoring of the pattern-instance graph."""
    cand = scanned.select(F.explode("cand").alias("c")).select("c.inst", "c.seed", F.explode("c.patterns").alias("pattern"))
    edges = stored(cand.groupBy("inst", "pattern").agg(F.max("seed").alias("seed")), "pii_edges")
    weights = edges.groupBy("inst").agg(F.max(F.col("seed").cast("double")).alias("w"), F.count("*").alias("_n"))
    patterns = None
    for _ in range(rounds):
        weighed = join_by_key(edges, stored(weights, "pii_weights"), "inst", "_n")
        scored = weighed.groupBy("pattern").agg(F.sum("w").alias("trust"), F.count("*").alias("_n"))
        conf = F.when(F.col("trust") >= SUPPORT, F.col("trust") / (F.col("_n") + 1)).otherwise(F.lit(0.0))
        patterns = stored(scored.select("pattern", conf.alias("conf"), "_n"), "pii_patterns")
        linked = join_by_key(edges, patterns, "pattern", "_n")
        miss = F.sum(F.when(F.col("conf") >= CONFIDENT, F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf")))).otherwise(F.lit(0.0)))
        weights = linked.groupBy("inst").agg(F.greatest(F.max(F.col("seed").cast("double")), 1 - F.exp(miss)).alias("w"), F.count("*").alias("_n"))
    return patterns


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of each kind, base_sha256, spans, n_id."""
    scanned = stored(scan(docs), "pii_scan")
    patterns = learn_patterns(scanned)
    rows = scanned.select("_row", F.explode("cand").alias("c")).select("_row", "c.start", "c.end", F.explode("c.patterns").alias("pattern"))
    best = join_by_key(rows, patterns, "pattern", "_n").filter(F.col("conf") >= CONFIDENT)
    added = best.select("_row", F.struct(F.col("start"), F.col("end"), F.lit(4).alias("kind")).alias("s")).distinct().groupBy("_row").agg(F.collect_list("s").alias("added"))
    both = scanned.join(added, "_row", "left")
    base = F.col("base")
    free = F.filter(F.coalesce("added", F.expr(f"cast(array() as array<{_SPAN}>)")), lambda a: ~F.exists(base, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    # A token inside a longer value that is added too says nothing more.
    free = F.filter(free, lambda a: ~F.exists(free, lambda b: (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & (b["end"] - b["start"] > a["end"] - a["start"])))
    everything = F.array_sort(F.transform(F.concat(base, free), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return both.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(everything).alias("spans"), F.size(free).cast("long").alias("n_id"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
