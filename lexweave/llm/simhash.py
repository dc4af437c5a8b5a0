"""Operator 6: SimHash fingerprints, pigeonhole block join, components.

A fingerprint has four 16-bit blocks.  Two fingerprints that differ in at most
two bits agree on at least two whole blocks, so each distinct fingerprint is
filed under its six block pairs and only members of one file are compared.
Files with more than ``SMALL_FILE`` members are not compared pairwise: there
every member is filed again under itself and each fingerprint one bit away (in
the 32 bits outside the shared blocks).  Two members within two bits share
such a midpoint, and everyone at a midpoint is within two bits of each other,
so a star per midpoint has the same components and grows with the members.

Defined cases: null, empty and blank texts have fingerprint zero and are linked
like any other; repeated rows share their component; an empty table gives no
rows; a null doc_id keeps its row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_by_key, stored, text_bytes
from .graph import components

SEED = 42
SMALL_FILE = 64
BLOCKS = 4
RADIUS = 2
_CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of lower-cased (A-Z) words in ``width``-word shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - width + 1, 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : min(at + _CHUNK, n)].tolist(), last[at : min(at + _CHUNK, n)].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", text_bytes().alias("_bytes")).mapInArrow(run, f"doc_id {kind}, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of ``fps.fp`` within two bits."""
    filed = []
    for t, kept in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS)):
        mask = sum(0xFFFF << (16 * b) for b in kept)
        signed = mask - 2**64 if mask >= 2**63 else mask
        filed.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed)).alias("k"), F.lit(~signed).alias("free")))
    rows = fps.select("fp", F.explode(F.array(*filed)).alias("_f")).select("fp", "_f.t", "_f.k", "_f.free")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = stored(sizes, "simhash_files")
    small = rows.join(sizes.filter(F.col("n") <= SMALL_FILE), ["t", "k"])
    a, b = small.alias("a"), small.alias("b")
    near = F.expr("bit_count(a.fp ^ b.fp) <= 2 AND a.fp < b.fp")
    pairs = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k")) & near)
    pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    large = rows.join(sizes.filter(F.col("n") > SMALL_FILE), ["t", "k"], "left_semi")
    flips = F.expr("transform(filter(sequence(0, 63), i -> (shiftright(free, i) & 1L) = 1L), i -> fp ^ shiftleft(1L, i))")
    mids = large.select("t", "fp", F.explode(F.concat(F.array("fp"), flips)).alias("mid"))
    stars = mids.groupBy("t", "mid").agg(F.min("fp").alias("m"), F.count("*").alias("n")).filter("n > 1").select("t", "mid", "m")
    starred = mids.join(stars, ["t", "mid"]).filter("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v"))
    return pairs.union(starred).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    marked = stored(fingerprints(docs, width), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct_fingerprints")
    member = components(links(fps.select("fp")))
    rooted = fps.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_m"))
    per_fp = stored(join_by_key(rooted.select("root", "fp", "n"), ids, "root", "_m").select("fp", "component_id", "n"), "components")
    joined = join_by_key(marked, per_fp, "fp", "n")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Grouping at a given shingle similarity.  At 0.8 (five words) two fingerprints
# differ in about 15 % of their bits, which needs longer fingerprints and
# blocks that are tried by chance instead of the two-bit guarantee above.
# Fingerprints only propose pairs; the shingle sets decide.

WIDE_WORDS = 4  # 64-bit words of a wide fingerprint
WIDE_BLOCK = 16
ORDERS = 2 * WIDE_WORDS  # orders of the bits, each cut into blocks and filed with an extreme shingle hash of its own
#: Only a prefilter: of 256 bits 39 differ on average at a similarity of 0.8, with a deviation of 6.
WIDE_RADIUS = 64
NEAR_RADIUS = 30  # pairs to try first: they usually are similar
NEAREST = 2  # members to try before all others
SKETCH = 256  # smallest shingle hashes that are compared before a pair is made
SIMILAR = 0.8
_BITS = np.stack([np.arange(64 * WIDE_WORDS), *(np.random.default_rng(SEED + k).permutation(64 * WIDE_WORDS) for k in range(1, ORDERS))])


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of lower-cased (A-Z) words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - width + 1, 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last[:n].tolist(), strict=True)], np.uint64))


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)).astype(np.int64))


def wide_fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four 64-bit words: every shingle hash is mixed into four; and the least and the greatest of each of the four."""
    ones = np.zeros(64 * WIDE_WORDS, np.int64)
    least, most = np.full(WIDE_WORDS, 2**64 - 1, np.uint64), np.zeros(WIDE_WORDS, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        h = hashes[at : at + _CHUNK]
        wide = np.empty((len(h), WIDE_WORDS), "<u8")
        for k in range(WIDE_WORDS):
            m = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
            m = (m ^ (m >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            m = (m ^ (m >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            wide[:, k] = m ^ (m >> np.uint64(31))
        ones += 2 * np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) - len(h)
        least, most = np.minimum(least, wide.min(0)), np.maximum(most, wide.max(0))
    return np.packbits(ones > 0, bitorder="little").view("<i8"), np.concatenate([least, most]).view(np.int64)


_NAMES = [f"f{k}" for k in range(WIDE_WORDS)]
_ENDS = [f"e{k}" for k in range(ORDERS)]


def _files(distinct: DataFrame) -> DataFrame:
    """(id, files, f0...): a row for each node that shares a file with others; it has at most as many files as there are blocks.

    A node is filed by each block of each order of its bits, together with the
    order's extreme shingle hash.  Sets of a similarity of SIMILAR have that
    hash in common in so many of the orders; texts that share no shingle never
    do, so blocks that are equal by chance make no files, however many texts
    there are.
    """
    per_order = 64 * WIDE_WORDS // WIDE_BLOCK

    def file(batches):
        for batch in batches:
            fps = np.stack([batch.column(1 + k).to_numpy() for k in range(WIDE_WORDS)], 1)
            ends = np.stack([batch.column(1 + WIDE_WORDS + k).to_numpy() for k in range(ORDERS)], 1).view(np.uint64)
            bits = np.unpackbits(fps.astype("<i8").view(np.uint8), axis=1, bitorder="little")
            blocks = np.concatenate([np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view("<u2") for order in _BITS], 1).astype(np.uint64)
            keys = (np.arange(blocks.shape[1], dtype=np.uint64) << np.uint64(WIDE_BLOCK) | blocks) * np.uint64(0x9E3779B97F4A7C15) + np.repeat(ends, per_order, axis=1)
            keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            keys ^= keys >> np.uint64(27)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["file", "id"])

    def shared(batches):
        """Rows of files with two members or more, from rows sorted by file."""
        held_file = held_id = np.zeros(0, np.int64)
        again = False  # whether the held row's file had an earlier row
        for batch in batches:
            f, i = np.concatenate([held_file, batch.column(0).to_numpy()]), np.concatenate([held_id, batch.column(1).to_numpy()])
            if not len(f):
                continue
            same = np.concatenate([[again], f[1:] == f[:-1]])
            use = (same | np.concatenate([same[1:], [False]]))[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(f[:-1][use]), pa.array(i[:-1][use])], names=["file", "id"])
            held_file, held_id, again = f[-1:], i[-1:], bool(same[-1])
        if again:
            yield pa.RecordBatch.from_arrays([pa.array(held_file), pa.array(held_id)], names=["file", "id"])

    rows = distinct.select("id", *_NAMES, *_ENDS).mapInArrow(file, "file long, id long")
    met = stored(rows.repartition("file").sortWithinPartitions("file", "id").mapInArrow(shared, "file long, id long"), "wide_files")
    # Joins are on nodes; a row for each file is made where members meet, by tasks that nodes are dealt to evenly.
    packed = met.groupBy("id").agg(F.collect_list("file").alias("files"))
    return stored(packed.join(distinct.select("id", *_NAMES), "id"), "wide_members").repartition("id")


def _by_file(members: DataFrame, *columns: str) -> DataFrame:
    """(file, id, root, f0..., columns): members of one file follow each other in one task, in order."""
    rows = members.select(F.explode("files").alias("file"), "id", "root", *_NAMES, *columns)
    return rows.repartition("file").sortWithinPartitions("file", "id")


def _proposed(members: DataFrame, radius: int, leaders_only: bool = False, nearest: int = 0) -> DataFrame:
    """(u, v): pairs within ``radius`` in a file and of different ``root``; with ``leaders_only`` each member
    is paired with the nearest of its file's leaders, the members that no earlier leader was near; with
    ``nearest`` with so many of the nearest members before it.  Where members have a sketch (column hashes),
    only pairs that may be similar by it are returned."""
    def pair(frames):
        """Runs of one file, in order; what members are compared with is carried over batch borders."""
        sketches: list[np.ndarray] = []
        now, seen, ids, roots, size = None, np.zeros((64, WIDE_WORDS), np.uint64), np.zeros(64, np.int64), np.zeros(64, np.int64), 0
        for pdf in frames:
            out_u, out_v = [], []
            file, own, root, fp = pdf["file"].to_numpy(), pdf["id"].to_numpy(), pdf["root"].to_numpy(), pdf[_NAMES].to_numpy().view(np.uint64)
            own_sketches = [np.frombuffer(h, "<u8") for h in pdf["hashes"]] if "hashes" in pdf else []
            for j in range(len(file)):
                if file[j] != now:
                    now, size = file[j], 0
                    sketches = []
                sketches += own_sketches[j : j + 1]
                if size:
                    away = np.bitwise_count(seen[:size] ^ fp[j]).sum(1)
                    if leaders_only:
                        best = int(away.argmin())
                        if away[best] <= radius:
                            out_u.append(own[j])
                            out_v.append(ids[best])
                            continue
                    else:
                        near = np.flatnonzero((away <= radius) & (roots[:size] != root[j]))
                        if 0 < nearest < len(near):
                            near = near[np.argpartition(away[near], nearest)[:nearest]]
                        if own_sketches:
                            near = near[[may_be_similar(own_sketches[j], sketches[k]) for k in near.tolist()]] if len(near) else near
                        out_u += [own[j]] * len(near)
                        out_v += ids[near].tolist()
                if size == len(ids):
                    seen, ids, roots = np.concatenate([seen, seen]), np.concatenate([ids, ids]), np.concatenate([roots, roots])
                seen[size], ids[size], roots[size] = fp[j], own[j], root[j]
                size += 1
            met = np.array([out_u, out_v], np.int64)
            met = np.unique(np.sort(met, axis=0), axis=1) if met.size else met  # a pair that meets in several files of a batch goes out once
            yield pd.DataFrame({"u": met[1], "v": met[0]})

    pairs = _by_file(members, *(["hashes"] if "hashes" in members.columns else [])).mapInPandas(pair, "u long, v long")
    return pairs.distinct()


def may_be_similar(a: np.ndarray, b: np.ndarray) -> bool:
    """From the SKETCH smallest hashes of two shingle sets: exact for sets with fewer, else with four deviations' room."""
    both = np.intersect1d(a, b, assume_unique=True)
    if len(a) < SKETCH and len(b) < SKETCH:
        return len(both) >= SIMILAR * (len(a) + len(b) - len(both)) - 1e-9
    last = np.union1d(a, b)[:SKETCH][-1]
    return (both <= last).sum() / SKETCH >= SIMILAR - 4 * np.sqrt(SIMILAR * (1 - SIMILAR) / SKETCH)


def _crowded(members: DataFrame, radius: int) -> DataFrame:
    """(id): members that have another within ``radius`` in a file, of a different ``root``."""

    def run(frames):
        now, seen, ids, roots, met, size = None, np.zeros((64, WIDE_WORDS), np.uint64), np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, bool), 0
        for pdf in frames:
            out: list[int] = []
            file, own, root, fp = pdf["file"].to_numpy(), pdf["id"].to_numpy(), pdf["root"].to_numpy(), pdf[_NAMES].to_numpy().view(np.uint64)
            for j in range(len(file)):
                if file[j] != now:
                    now, size = file[j], 0
                if size == len(ids):
                    seen, ids, roots, met = (np.concatenate([x, x]) for x in (seen, ids, roots, met))
                near = (np.bitwise_count(seen[:size] ^ fp[j]).sum(1) <= radius) & (roots[:size] != root[j])
                out += ids[:size][near & ~met[:size]].tolist()
                met[:size] |= near
                seen[size], ids[size], roots[size], met[size] = fp[j], own[j], root[j], near.any()
                out += [own[j]] if met[size] else []
                size += 1
            yield pd.DataFrame({"id": np.array(out, np.int64)})

    return _by_file(members).mapInPandas(run, "id long").distinct()


def _sets(ids: DataFrame, distinct: DataFrame, docs: DataFrame, width: int, most: int | None = None) -> DataFrame:
    """(id, hashes): the shingle sets of the nodes ``ids``, or their ``most`` smallest hashes, made anew from the texts."""

    def sets(batches):
        for batch in batches:
            got = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(h) for h in got], pa.int64()), pa.array([h[:most].astype("<u8").tobytes() for h in got], pa.binary())], names=["s", "hashes"])

    nodes = ids.distinct().join(distinct.select("id", F.col("k.s").alias("s"), F.col("first.doc_id").alias("first")), "id")
    nodes = stored(nodes, "wide_needed")
    texts = docs.select(F.col("doc_id").alias("_d"), text_bytes().alias("_bytes")).join(nodes.select("first").distinct(), F.expr("_d <=> first"), "left_semi")
    made = texts.select("_bytes").mapInArrow(sets, "s long, hashes binary")
    return stored(nodes.select("id", "s").join(made, "s").groupBy("id").agg(F.first("hashes").alias("hashes")), "wide_sets")


def _verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Those of ``pairs`` whose shingle sets have a similarity of at least SIMILAR; sets are made anew for their nodes only."""

    def compare(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both >= SIMILAR * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    pairs = stored(pairs, "wide_pairs")
    hashes = _sets(pairs.select(F.col("u").alias("id")).union(pairs.select("v")), distinct, docs, width)
    both = pairs.join(hashes.withColumnRenamed("id", "u").withColumnRenamed("hashes", "a"), "u").join(hashes.withColumnRenamed("id", "v").withColumnRenamed("hashes", "b"), "v")
    return stored(both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"), "wide_edges")


def similar_groups(docs: DataFrame, width: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """(doc_id, h, component_id, component_h, n, n_words) of documents in groups of similar texts; h is the text's hash.

    Nodes are distinct shingle sets.  Two that meet in a file and whose
    fingerprints are within ``radius`` are linked if their exact shingle
    similarity is SIMILAR or more.  Members are tried with leaders first, which
    gathers groups of copies at a comparison a member, then with their nearest
    members of other groups; in the end all pairs that are still in different
    groups are tried, so links through members count.  A
    group is named by its first (doc_id, h), of which there are n rows.
    Documents without words or without a doc_id are in no group; ties don't
    matter, as similarity has no order; repeated rows are members each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mark(batches):
        for batch in batches:
            got = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            fps = np.stack([np.concatenate(wide_fingerprint(h)) for h in got]) if got else np.zeros((0, WIDE_WORDS + ORDERS), np.int64)
            more = [pa.array([set_key(h) for h in got], pa.int64()), pa.array([len(t.as_py().split()) for t in batch.column(1)], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(fps[:, k]) for k in range(fps.shape[1])), *more], names=["doc_id", "h", *_NAMES, *_ENDS, "s", "n_words"])

    rows = docs.filter("doc_id is not null").select("doc_id", text_bytes().alias("_bytes"), F.xxhash64("text").alias("h"))
    marked = rows.mapInArrow(mark, f"doc_id {kind}, h long, " + ", ".join(f"{c} long" for c in (*_NAMES, *_ENDS)) + ", s long, n_words long")
    marked = stored(marked.withColumn("k", F.struct(*_NAMES, "s")), "wide_fingerprints")
    own = marked.filter("n_words > 0").groupBy("k", "doc_id", "h").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in _ENDS])
    distinct = own.groupBy("k").agg(F.min(F.struct("doc_id", "h", F.col("n").alias("rows"))).alias("first"), F.sum("n").alias("n"), *[F.min(c).alias(c) for c in _ENDS])
    distinct = stored(distinct.select(F.monotonically_increasing_id().alias("id"), "k", *[F.col(f"k.{c}").alias(c) for c in _NAMES], "first", "n", *_ENDS), "wide_distinct")
    members = _files(distinct)
    edges = _verified(_proposed(members.withColumn("root", F.col("id")), min(NEAR_RADIUS, radius), leaders_only=True), distinct, docs, width)
    member = stored(components(edges), "wide_near")
    for nearest in (NEAREST, 0):
        joined = members.join(member.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        if not nearest:  # only those with others left nearby, with sketches: pairs that can't be similar end where they meet
            joined = joined.join(_sets(_crowded(joined, radius), distinct, docs, width, SKETCH), "id")
        edges = edges.union(_verified(_proposed(joined, radius, nearest=nearest), distinct, docs, width))
        member = stored(components(edges), "wide_near")
    rooted = distinct.join(member.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("c"), F.count("*").alias("_m"))
    per_fp = stored(join_by_key(rooted.select("root", "k", "n"), firsts, "root", "_m").select("k", "c", "n"), "wide_components")
    joined = join_by_key(marked.filter("n_words > 0").select("doc_id", "h", "k", "n_words"), per_fp, "k", "n")
    return joined.select("doc_id", "h", F.col("c.doc_id").alias("component_id"), F.col("c.h").alias("component_h"), F.col("c.rows").alias("n"), "n_words")


def keep_first(docs: DataFrame, width: int = 5, radius: int = WIDE_RADIUS) -> DataFrame:
    """``docs`` with one document of each group of similar texts: the one with the smallest doc_id.

    Of repeated rows (same doc_id, same text) one stays; rows without words or
    without a doc_id all stay; another text under a dropped doc_id isn't dropped.
    """
    id_, hash_, many = (free_name(docs, n) for n in ("drop", "drop_hash", "drop_rows"))
    groups = stored(similar_groups(docs, width, radius), "similar_groups")
    away = groups.filter("doc_id <> component_id OR h <> component_h OR n > 1").groupBy("doc_id", "h").agg(F.max(F.expr("CASE WHEN doc_id = component_id AND h = component_h THEN n ELSE 0 END")).alias("n"))
    away = away.select(F.col("doc_id").alias(id_), F.col("h").alias(hash_), F.col("n").alias(many))
    same = (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    once = docs.join(away.filter(F.col(many) > 0), same).dropDuplicates([id_, hash_]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.join(away, same, "left_anti").unionByName(once)
