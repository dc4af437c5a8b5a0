"""Operator 2: benchmark decontamination by latent semantic retrieval.

Every document is written once as the numbers of its words in the benchmark's
vocabulary (0: not there).  Words are features (hashed into ``DIM``), weighted
by inverse document frequency over all documents; words in more than
``COMMON`` of the items weigh ``FLOOR`` only (how many documents have a word
doesn't matter there: a passage that a third of them share must be found too).
A distributed randomised SVD of items and of every window of every document
gives a ``RANK``-dimensional space: ``ITEM_ROUNDS`` of subspace iteration on
the items choose where it starts, then in ``POWER_ROUNDS`` over all documents
executors multiply and sum blocks and the driver gets one vocabulary x
``RANK`` matrix a round.  Every window of ``WINDOW`` words (stride ``STRIDE``) of every document
is projected and compared by cosine with every item.  Each pair above
``CANDIDATE`` is then read word by word: the longest common subsequence of the
item with the text around the window, and the item's answer (its last
``ANSWER`` words) there.  A pair is a leak with at least ``LEAK`` of the item's
words in order, or ``LEAK_WITH_ANSWER`` and the answer.

Windows side by side that are near the same item are first read as one stretch:
what it has in common with the item bounds what each window can have, so only
windows of stretches over the limit are read one by one.

Items come in blocks of ``ITEM_BLOCK``, so what is broadcast is bounded.  Items
under ``MIN_ITEM`` words say too little for a subsequence: they leak where a
whole line of a document has just their words.

Defined cases: null and empty texts, and items without words, match nothing;
very long documents are searched whole, in pieces of bounded size; repeated
documents and items each give their own rows; of equally good windows the
first is reported; empty tables give no rows; a null doc_id keeps its rows;
extra columns pass through ``clean`` unchanged, whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored
from .features import word_codes

DIM = 1 << 15
RANK = 128
WINDOW, STRIDE = 48, 12
PARTS = WINDOW // STRIDE
COMMON = 0.1
FLOOR = 0.1
ITEM_ROUNDS = 2
POWER_ROUNDS = 1
CANDIDATE = 0.25
LEAK, LEAK_WITH_ANSWER = 0.6, 0.45
ANSWER = 8
MIN_ITEM = 5
ITEM_BLOCK = 20_000
#: Windows that are read as one stretch at most; cells of a window x item table; words projected at once; pairs read side by side.
STRETCH = 16
CELLS = 1 << 22
WORDS_AT_ONCE = 1 << 16
GRAM_WORDS = 1 << 12  # what a product touches stays in a core's cache
PAIRS = 1 << 12
#: Cells of a dense item x word table; larger ones are searched by key.
DENSE = 1 << 24
_DROP = b".,;:!?\"'()[]{}"


def plain_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(None, _DROP).split()


def lcs_length(pattern: list, text: list) -> int:
    """Longest common subsequence, bit-parallel: a bit per pattern word."""
    where: dict = {}
    for k, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(pattern)) - 1
    v = full
    for w in text:
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


class Items:
    """A block of items: their words as numbers from 1, and bit masks of each word's places in each item."""

    def __init__(self, items: list[list[bytes]]):
        self.words = {w: k for k, w in enumerate(sorted({w for i in items for w in i}), 1)}
        self.coded = [np.fromiter(map(self.words.get, i), np.int64, len(i)) for i in items]
        self.sizes = np.fromiter(map(len, items), np.int64, len(items))
        self.wide = len(self.words) + 1
        hashed = (word_codes(list(self.words)) * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)
        self.features, own = np.unique(hashed, return_inverse=True)
        self.feature = np.concatenate([[-1], own])  # of each word
        key = np.concatenate([np.zeros(0, np.int64), *(k * self.wide + c for k, c in enumerate(self.coded))])
        bit = np.concatenate([np.zeros(0, np.uint64), *(np.uint64(1) << np.minimum(np.arange(len(c)), 63).astype(np.uint64) for c in self.coded)])
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.masks = np.bitwise_or.reduceat(bit[order], first) if len(first) else bit
        self.table: np.ndarray | None = None

    def mask(self, item: np.ndarray, code: np.ndarray) -> np.ndarray:
        if len(self.sizes) * self.wide <= DENSE:
            if self.table is None:
                self.table = np.zeros(len(self.sizes) * self.wide, np.uint64)
                self.table[self.keys] = self.masks
            return self.table[item * self.wide + code]
        key = item * self.wide + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.masks[at], np.uint64(0))

    def common(self, item: np.ndarray, low: np.ndarray, high: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Longest common subsequences of items with codes[low:high], many pairs side by side."""
        out, size = np.zeros(len(item), np.int64), high - low
        long = self.sizes[item] > 64
        for k in np.flatnonzero(long).tolist():
            out[k] = lcs_length(self.coded[item[k]].tolist(), codes[low[k] : high[k]].tolist())
        todo = np.flatnonzero(~long)
        todo = todo[np.argsort(-size[todo], kind="stable")]
        for at in range(0, len(todo), PAIRS):
            part = todo[at : at + PAIRS]
            who, place, steps = item[part], low[part], size[part]
            v = np.full(len(part), ~np.uint64(0))
            for t in range(int(steps[0])):
                now = int(np.searchsorted(-steps, -t, "left"))  # those with more than t words
                m = self.mask(who[:now], codes[place[:now] + t])
                u = v[:now]
                v[:now] = (u + (u & m)) | (u & ~m)
            n = self.sizes[who]
            unused = np.bitwise_count(np.where(n < 64, v & ((np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1)), v))
            out[part] = n - unused
        return out


class Layout:
    """The words of many documents end to end, cut into blocks of STRIDE words; a window is PARTS blocks.

    After each document come PARTS - 1 blocks, so no window has words of two.
    """

    def __init__(self, payloads: list[bytes]):
        codes = np.frombuffer(b"".join(payloads), "<i4")
        self.size = np.fromiter(map(len, payloads), np.int64, len(payloads)) // 4
        self.begin = np.cumsum(self.size) - self.size
        self.windows = np.where(self.size > 0, np.maximum(self.size - WINDOW + STRIDE - 1, 0) // STRIDE + 1, 0)
        blocks = np.where(self.size > 0, self.windows + PARTS - 1, 0)
        self.base = np.cumsum(blocks) - blocks
        self.total = int(blocks.sum())
        self.at = np.flatnonzero(codes)  # places of the vocabulary's words
        self.code = codes[self.at].astype(np.int64)
        doc = np.searchsorted(self.begin + self.size, self.at, "right")
        self.block = self.base[doc] + (self.at - self.begin[doc]) // STRIDE
        self.doc = np.repeat(np.arange(len(payloads)), blocks)  # of each block
        self.number = np.arange(self.total) - self.base[self.doc]  # of the window that starts with a block

    def pieces(self, words: int = WORDS_AT_ONCE):
        """(first block, last block, first word, last word) of pieces of bounded size."""
        first = 0
        while first < self.total:
            low = int(np.searchsorted(self.block, first))
            last = min(first + words // STRIDE, self.total)
            yield first, last, low, int(np.searchsorted(self.block, last + PARTS - 1))
            first = last

    def sums(self, first: int, last: int, low: int, high: int, rows: np.ndarray) -> np.ndarray:
        """Sums of ``rows[feature]`` over the windows that start with blocks first to last."""
        out = np.zeros((last - first + PARTS - 1, rows.shape[1]), np.float32)
        if high > low:
            block, code = self.block[low:high], self.code[low:high]
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            many = np.diff(np.concatenate([starts, [len(block)]]))
            order = np.argsort(-many, kind="stable")  # fullest blocks first; STRIDE words at most
            starts, many = starts[order], many[order]
            total = rows[code[starts]]
            for k in range(1, int(many[0])):
                now = int(np.searchsorted(-many, -k, "left"))
                total[:now] += rows[code[starts[:now] + k]]
            out[block[starts] - first] = total
        return _together(out)


def _together(blocks: np.ndarray) -> np.ndarray:
    """Sums of PARTS rows that follow each other."""
    return sum(blocks[k : len(blocks) - PARTS + 1 + k] for k in range(PARTS))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-9)


def _encoded(docs: DataFrame, words) -> DataFrame:
    """(doc_id, h, codes): the words of each text as numbers of the vocabulary; h is the text's hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        get = words.value.get
        for batch in batches:
            out = []
            for t in batch.column(2):
                own = plain_words(t.as_py())
                out.append(np.fromiter(map(get, own, repeat(0)), "<i4", len(own)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "h", "codes"])

    return docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, codes binary")


def document_frequencies(coded: DataFrame, wide: int) -> tuple[np.ndarray, int]:
    """In how many documents each of the vocabulary's words is, and how many documents there are."""

    def run(batches):
        df, n = np.zeros(wide, np.int64), 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            codes = np.frombuffer(b"".join(own), "<i4").astype(np.int64)
            doc = np.repeat(np.arange(len(own)), np.fromiter(map(len, own), np.int64, len(own)) // 4)
            use = codes > 0
            seen = np.unique(doc[use] * wide + codes[use])
            df += np.bincount(seen % wide, minlength=wide)
            n += len(own)
        df[0] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["w", "n"])

    rows = coded.select("codes").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # a row per word of a block of items
    df = np.zeros(wide, np.int64)
    for r in rows:
        df[r["w"]] = r["n"]
    return df, int(df[0])


def _gram(block: np.ndarray, weight: np.ndarray, feature: np.ndarray, laid: Layout) -> np.ndarray:
    """A'A times ``block``, where a row of A is a window: the weights of its words, scaled to length one."""
    out, per_word = np.zeros_like(block), np.zeros((len(weight), block.shape[1]), np.float32)
    rows = weight[:, None] * block[feature]  # of each word
    rows[0] = 0
    squares = (weight**2)[:, None].astype(np.float32)
    for first, last, low, high in laid.pieces(GRAM_WORDS):
        projected = laid.sums(first, last, low, high, rows)
        size = laid.sums(first, last, low, high, squares)
        projected /= np.maximum(size, 1e-12)  # both factors have the scale
        projected[laid.number[first:last] >= laid.windows[laid.doc[first:last]]] = 0
        if high == low:
            continue
        pad = np.zeros((PARTS - 1, projected.shape[1]), np.float32)
        back = _together(np.concatenate([pad, projected, pad]))  # of each block: its windows' sums
        order = np.argsort(laid.code[low:high], kind="stable")
        code, at = laid.code[low:high][order], laid.block[low:high][order] - first
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        per_word[code[starts]] += np.add.reduceat(back[at], starts, axis=0)
    np.add.at(out, feature, weight[:, None] * per_word)
    return out


def randomized_svd(passages: DataFrame, items: Items, weight: np.ndarray, rank: int = RANK, rounds: int = POWER_ROUNDS) -> np.ndarray:
    """The leading right singular vectors (features x rank) of the windows of ``passages`` (column codes) and ``items``.

    Subspace iteration on the Gram matrix, started where the items are: every
    round multiplies A'A with the current block in the executors; their partial products are cut into strips
    and summed by strip in other tasks, so the driver gets one matrix.
    """
    n, feature = len(items.features), np.maximum(items.feature, 0)
    rank = min(rank, n)
    start = np.random.default_rng(7).standard_normal((DIM, rank)).astype(np.float32)[items.features]
    block = np.linalg.qr(start)[0].astype(np.float32)
    spark, strip = passages.sparkSession, 1024
    own = Layout([c.astype("<i4").tobytes() for c in items.coded])
    for _ in range(ITEM_ROUNDS):  # a little of the block stays, for items may have fewer directions than it
        block = np.linalg.qr(_gram(block, weight, feature, own) + np.float32(0.01) * block)[0].astype(np.float32)

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((block, weight, feature))  # features * rank floats

        def run(batches, shared=shared):
            block, weight, feature = shared.value
            total = np.zeros_like(block)
            for batch in batches:
                total += _gram(block, weight, feature, Layout(batch.column(0).to_pylist()))
            parts = [total[k : k + strip].tobytes() for k in range(0, len(total), strip)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(parts, pa.binary())], names=["k", "g"])

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sums[k] = sums[k] + np.frombuffer(g, np.float32) if k in sums else np.frombuffer(g, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["k", "g"])

        total = _gram(block, weight, feature, own)
        for row in passages.mapInArrow(run, "k long, g binary").repartition("k").mapInArrow(add, "k long, g binary").collect():  # one matrix
            total[row["k"] * strip : (row["k"] + 1) * strip] += np.frombuffer(row["g"], np.float32).reshape(-1, rank)
        block = np.linalg.qr(total)[0].astype(np.float32)
        shared.unpersist()
    return block


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    named = benchmark.select("item_id", "text").filter("text is not null")
    many = -(-named.count() // ITEM_BLOCK)
    return [named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k) for k in range(many)]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_found, start, end): leaked items with the place in words."""
    return _leaks(docs, benchmark).drop("h")


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = None
    kinds = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    for part in _blocks(benchmark):
        rows = [(r["item_id"], plain_words(r["text"])) for r in part.collect()]  # ITEM_BLOCK at most
        rows = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is not None, r[0], r[1]))
        for found in (_retrieved(docs, [r for r in rows if len(r[1]) >= MIN_ITEM], kinds), _short(docs, [r for r in rows if len(r[1]) < MIN_ITEM], kinds)):
            if found is not None:
                out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], _schema(kinds))


def _schema(kinds) -> str:
    return f"doc_id {kinds[0].simpleString()}, h long, item_id {kinds[1].simpleString()}, cosine double, lcs_share double, answer_found boolean, start long, end long"


def _short(docs: DataFrame, items: list, kinds) -> DataFrame | None:
    """Lines that are just an item's words."""
    if not items:
        return None
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, b" ".join(w).decode()) for i, w in items], f"item_id {kinds[1].simpleString()}, _w string")
    marks = "".join(map(chr, _DROP))
    lines = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.explode(F.split(F.lower("text"), "\n")).alias("_l"))
    plain = F.trim(F.regexp_replace(F.translate("_l", marks, ""), r"[\x20\x09-\x0D]+", " "))
    met = lines.select("doc_id", "h", plain.alias("_w")).join(F.broadcast(table), "_w").select("doc_id", "h", "item_id").distinct()  # ITEM_BLOCK rows at most
    return met.select("doc_id", "h", "item_id", F.lit(1.0).alias("cosine"), F.lit(1.0).alias("lcs_share"), F.lit(True).alias("answer_found"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))


def _retrieved(docs: DataFrame, named: list, kinds) -> DataFrame | None:
    if not named:
        return None
    spark = docs.sparkSession
    items = Items([w for _, w in named])
    coded = stored(_encoded(docs, spark.sparkContext.broadcast(items.words)), "coded")
    df, total = document_frequencies(coded, items.wide)
    in_items = np.bincount(np.concatenate([np.unique(c) for c in items.coded]), minlength=items.wide)
    weight = np.where(in_items <= max(COMMON * len(named), 3), np.log((1 + total) / (1 + df)) + FLOOR, FLOOR).astype(np.float32)
    weight[0] = 0
    # A leak has LEAK_WITH_ANSWER of an item's words at least; a third of those of the shortest item must be in one window.
    least = max(1, int(LEAK_WITH_ANSWER * int(items.sizes.min()) / 3))
    space = randomized_svd(coded.select("codes"), items, weight)
    rows = weight[:, None] * space[np.maximum(items.feature, 0)]
    rows[0] = 0
    latent = _unit(np.stack([rows[c].sum(0) for c in items.coded]))
    shared = spark.sparkContext.broadcast((rows.astype(np.float32), latent.astype(np.float32), items, [i for i, _ in named]))  # the words' vectors and one block of items

    def search(batches):
        rows, latent, items, ids = shared.value
        for batch in batches:
            found = near_items(Layout(batch.column(2).to_pylist()), items, rows, latent, least)
            take = pa.array([f[0] for f in found], pa.int64())
            names = pa.array([ids[f[1]] for f in found], id_type)
            more = [pa.array([f[k] for f in found], t) for k, t in ((2, pa.float64()), (3, pa.float64()), (4, pa.bool_()), (5, pa.int64()), (6, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), names, *more], names=["doc_id", "h", "item_id", "cosine", "lcs_share", "answer_found", "start", "end"])

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds[1].simpleString()]
    return coded.mapInArrow(search, _schema(kinds))


def near_items(laid: Layout, items: Items, rows: np.ndarray, latent: np.ndarray, least: int) -> list[tuple]:
    """(document, item, cosine, share, answer found, start, end) of leaks, the best window of each pair."""
    best: dict[tuple[int, int], tuple] = {}
    many = np.bincount(laid.block, minlength=laid.total + PARTS)
    in_window = _together(many)[: laid.total]
    starts_here = (laid.number < laid.windows[laid.doc]) & (in_window >= least)
    for first, last, low, high in laid.pieces():
        live = first + np.flatnonzero(starts_here[first:last])
        if not len(live):
            continue
        z = _unit(laid.sums(first, last, low, high, rows)[live - first])
        for k in range(0, len(live), max(CELLS // len(latent), 64)):
            part = live[k : k + max(CELLS // len(latent), 64)]
            cosine = latent @ z[k : k + len(part)].T
            item, window = np.nonzero(cosine >= CANDIDATE)
            if len(item):
                _read(laid, items, item, part[window], cosine[item, window], best)
    return [(*pair, *what) for pair, what in sorted(best.items())]


def _read(laid: Layout, items: Items, item: np.ndarray, block: np.ndarray, cosine: np.ndarray, best: dict) -> None:
    """Read candidate pairs (sorted by item, then window) word by word."""
    doc = laid.doc[block]
    start, n = laid.number[block] * STRIDE, items.sizes[item]

    def stretch(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``laid.code`` around the windows first to last."""
        d = doc[first]
        from_ = laid.begin[d] + np.maximum(start[first] - n[first], 0)
        to = laid.begin[d] + np.minimum(start[last] + WINDOW + n[first], laid.size[d])
        return np.searchsorted(laid.at, from_), np.searchsorted(laid.at, to)

    new = np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (block[1:] // STRETCH != block[:-1] // STRETCH)])
    firsts = np.flatnonzero(new)
    lasts = np.concatenate([firsts[1:], [len(item)]]) - 1
    low, high = stretch(firsts, lasts)
    need = LEAK_WITH_ANSWER * n
    full = high - low >= need[firsts]
    enough = np.zeros(len(firsts), bool)
    enough[full] = items.common(item[firsts[full]], low[full], high[full], laid.code) >= need[firsts[full]]
    each = np.flatnonzero(enough[np.cumsum(new) - 1])
    if not len(each):
        return
    low, high = stretch(each, each)
    got = items.common(item[each], low, high, laid.code)
    for k in np.flatnonzero(got >= need[each]).tolist():
        i, e = int(item[each[k]]), each[k]
        share = float(got[k] / n[e])
        answer = items.coded[i][-ANSWER:].tolist()
        found = lcs_length(answer, laid.code[low[k] : high[k]].tolist()) >= 0.75 * len(answer)
        if share >= LEAK or found:
            pair, d = (int(doc[e]), i), doc[e]
            what = (float(cosine[e]), share, found, int(max(start[e] - n[e], 0)), int(min(start[e] + WINDOW + n[e], laid.size[d])))
            if pair not in best or (share, what[0]) > (best[pair][1], best[pair][0]):
                best[pair] = what


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a leaked item."""
    id_, hash_ = free_name(docs, "leak"), free_name(docs, "leak_hash")
    found = stored(_leaks(docs, benchmark).select(F.col("doc_id").alias(id_), F.col("h").alias(hash_)).distinct(), "leaks")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & F.xxhash64("text").eqNullSafe(F.col(hash_)), "left_anti")
