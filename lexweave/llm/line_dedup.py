"""Operator 7: line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines (split at ``\\n``, white space around them aside) of at least
``MIN_CHARS`` characters are compared over the whole corpus.  Equal lines are
collapsed first.  A line is cut into EDITS + 1 segments; two lines within EDITS
edits share at least one of them unchanged, at a place that the length
difference bounds.  So every line is indexed under (length, segment number,
segment) and probes the indexes of its own and of up to EDITS smaller lengths
at those places only.  Pairs that meet must agree on the counts of characters up to
2 * EDITS (inside the join, so a busy segment makes no rows), and are verified
by a banded bit-parallel edit distance.  Linked lines
form classes; of each class the first line stays, in the document with the
smallest id, at its first place there.

Defined cases: null texts have no lines; shorter and blank lines always stay;
rows with the same doc_id count as one document, and equal rows get equal
results; very long lines are compared whole; an empty table gives no rows;
extra columns pass through ``dedup`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, join_by_key, release_shuffles, stored
from .graph import components

MIN_CHARS = 20
EDITS = 2
#: Characters whose counts are compared before verification; all others are counted together.
LETTERS = " etaoinhsrdlu"
_BUCKETS = 1 << 20


def _let(value: Column, then) -> Column:
    """Name a value inside an expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def edit_distance_within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """The edit distance of two arrays of characters if at most ``edits``, else some larger number.

    Bit-parallel over a band of 2 * edits + 1 rows that moves down the
    diagonal: a bit stands for a row of the column, VP and VN for vertical
    differences +1 and -1, D0 for a diagonal without cost.  Lengths must
    differ by ``edits`` at most and be at least ``edits``.
    """
    # Bound once: inside the lambda an expression would be computed anew at every step.
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda both: _banded(both["a"], both["b"], edits))


def _banded(a: Column, b: Column, edits: int) -> Column:
    width, k = 2 * edits + 1, edits
    mask = (1 << width) - 1
    inverse = lambda x: x.bitwiseXOR(F.lit(mask).cast("long"))

    def column(state: Column, i: Column) -> Column:
        here = F.get(b, i)
        equal = F.lit(0).cast("long")
        for t in range(width):
            equal = equal + F.when(F.get(a, i + F.lit(t - k)) == here, F.lit(1 << t).cast("long")).otherwise(F.lit(0).cast("long"))
        vp, vn = state["vp"], state["vn"]

        def diagonal(pm: Column) -> Column:
            total = (pm.bitwiseAND(vp) + vp).bitwiseAND(F.lit(mask).cast("long"))
            return total.bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn)

        def step(d0: Column) -> Column:
            hp, hn = vn.bitwiseOR(inverse(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            past = i - (F.size(a) - k)  # how far the band's last row is below the last character of a
            bit = lambda x, at: F.shiftright(x, at).bitwiseAND(F.lit(1).cast("long"))
            along = F.array(*[bit(hp, width - 2 - t) - bit(hn, width - 2 - t) for t in range(width - 1)])
            grown = F.when(past < 0, 1 - bit(d0, width - 1)).otherwise(F.get(along, past))
            return F.struct(
                hn.bitwiseOR(inverse(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (state["d"] + grown).alias("d")
            )

        return _let(_let(equal, diagonal), step)

    start = F.struct(F.lit(mask & ~((1 << k) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(k).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, column, lambda s: s["d"])


def characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, _h, at, line, h1, h2): the lines that are compared."""
    cut = docs.select("doc_id", _text_hash().alias("_h"), F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\r\x0b\f")))).alias("at", "line"))
    cut = cut.filter(F.length("line") >= MIN_CHARS)
    return cut.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def measured(lines: DataFrame) -> DataFrame:
    """``lines`` with ``len`` and ``counts``: two bits for the count of each of ``LETTERS`` and of all other characters.

    Letters are taken out one after the other, so each step reads what the ones
    before left.  A count modulo 4 is written in Gray code: one more or one
    less flips one bit, so bits that differ never exceed the counts' distance.
    """
    out = lines.withColumn("len", F.length("line")).withColumn("_rest0", F.col("line"))
    for k, letter in enumerate(LETTERS):
        out = out.withColumn(f"_rest{k + 1}", F.replace(F.col(f"_rest{k}"), F.lit(letter), F.lit("")))
    # A letter is one byte, so bytes tell how many went, and needn't be read for that; only what is left is counted in characters.
    size = [F.octet_length(f"_rest{k}") for k in range(len(LETTERS) + 1)]
    gone = [size[k] - size[k + 1] for k in range(len(LETTERS))] + [F.length(f"_rest{len(LETTERS)}")]
    total = F.lit(0).cast("long")
    for k, many in enumerate(gone):
        n = many.bitwiseAND(F.lit(3))
        total = total + F.shiftleft(n.bitwiseXOR(F.shiftright(n, 1)).cast("long"), 2 * k)
    return out.withColumn("counts", total).select(*lines.columns, "len", "counts")


def segment_rows(lines: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """Index rows and probe rows (key, id, counts) of measured distinct lines (id, line, len, counts)."""
    parts = edits + 1
    index, probe = [], []
    for shorter in range(edits + 1):
        for number in range(1, parts + 1):
            for shift in range(max(1 - number, shorter - (parts - number)), min(number - 1, shorter + parts - number) + 1):
                probe.append((shorter, number, shift))
                if shorter == 0 and shift == 0:
                    index.append((shorter, number, shift))
    # One small expression over a literal list: a key apiece would make a method too large to be compiled.
    own = F.col("len") - F.col("p.shorter")
    size, longer, number = (own / parts).cast("int"), own % parts, F.col("p.number")
    start = size * (number - 1) + F.greatest(F.lit(0), longer - (parts + 1 - number)) + F.col("p.shift")
    length = size + F.when(longer >= parts + 1 - number, 1).otherwise(0)
    # Places in a string are found by reading it from its start; where all characters are bytes, bytes at that place are taken.
    segment = F.when(F.col("_bytes").isNotNull(), F.substring(F.col("_bytes"), start + 1, length)).otherwise(F.substring(F.col("line"), start + 1, length).cast("binary"))
    key = F.xxhash64(own, number, segment).alias("key")
    lines = lines.withColumn("_bytes", F.when(F.octet_length("line") == F.col("len"), F.col("line").cast("binary")))

    def keyed(places):
        listed = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(place, ("shorter", "number", "shift"), strict=True)]) for place in places])
        return lines.select("id", "counts", "line", "_bytes", "len", F.explode(listed).alias("p")).select(key, "id", "counts")

    return keyed(index), keyed(probe)


def line_links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Edges (u, v) between the ids of measured distinct lines within ``edits`` edits."""
    index, probe = segment_rows(lines, edits)
    a, b = index.alias("a"), probe.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & (F.bit_count(F.col("a.counts").bitwiseXOR(F.col("b.counts"))) <= 2 * edits))
    pairs = met.select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")).distinct()
    pairs = stored(pairs, "line_candidates")
    # Only lines of candidates are needed; a bounded set of hash buckets spares the rest the shuffle.
    bucket = F.pmod(F.xxhash64("id"), F.lit(_BUCKETS)).cast("int")
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v"))
    few = lines.select("id", "line").join(F.broadcast(ids.select(bucket.alias("_b")).distinct()), bucket == F.col("_b"), "left_semi")
    for side, name in (("u", "x"), ("v", "y")):
        pairs = pairs.join(few.select(F.col("id").alias(side), F.col("line").alias(name)), side)
    close = F.abs(F.length("x") - F.length("y")) <= edits
    return pairs.filter(F.when(close, edit_distance_within(characters(F.col("x")), characters(F.col("y")), edits) <= edits).otherwise(False)).select("u", "v")


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h1, h2, first_doc, root, n) for every distinct line that isn't alone in its class; h1 and h2 are the line's hash."""
    distinct = _lines(docs).groupBy("line").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    distinct = distinct.select(F.monotonically_increasing_id().alias("id"), "line", "first_doc", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    distinct = stored(measured(distinct), "lines")
    member = stored(components(line_links(distinct.select("id", "line", "len", "counts"), edits)), "line_components")
    facts = distinct.select("id", "first_doc", "n", "h1", "h2")
    rooted = facts.join(member.withColumnRenamed("node", "id"), "id", "left").filter("root is not null or n > 1").withColumn("root", F.coalesce("root", "id"))
    firsts = rooted.groupBy("root").agg(F.min("first_doc").alias("_first"))
    classes = stored(rooted.join(firsts, "root").select("h1", "h2", F.col("_first").alias("first_doc"), "root", "n"), "line_classes")
    discard(docs.sparkSession, distinct.stored_at)  # the largest table here
    return classes


def repeated_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, _h, drop, sources): places of the lines to drop, and the documents that keep their like."""
    classes = line_classes(docs, edits)
    # A bounded set of hash buckets spares lines that are alone the shuffle.
    bucket = F.pmod("h1", F.lit(_BUCKETS)).cast("int")
    seen = _lines(docs).select("doc_id", "_h", "at", "h1", "h2").join(F.broadcast(classes.select(bucket.alias("_b")).distinct()), bucket == F.col("_b"), "left_semi")
    hits = join_by_key(seen, classes, ["h1", "h2"], "n")
    # A document's places by class and place: of a class that begins here the first one stays.
    own = hits.groupBy("doc_id", "_h").agg(F.array_sort(F.collect_set(F.struct("root", "at", "first_doc"))).alias("_all"))
    begins = lambda x, i: (i == 0) | (F.get("_all", F.greatest(i - 1, F.lit(0)))["root"] != x["root"])
    drop = F.filter("_all", lambda x, i: ~(x["first_doc"].eqNullSafe(F.col("doc_id")) & begins(x, i)))
    dropped = own.select("doc_id", "_h", drop.alias("_gone")).filter(F.size("_gone") > 0)
    return dropped.select("doc_id", "_h", F.col("_gone.at").alias("_drop"), F.array_sort(F.array_distinct("_gone.first_doc")).alias("_sources"))


def report_names(docs: DataFrame) -> tuple[str, str, str]:
    """The names of the columns that ``dedup`` adds: ``_removed``, ``_left`` and ``_sources`` where they are free."""
    return free_name(docs, "removed"), free_name(docs, "left"), free_name(docs, "sources")


def dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and (see ``report_names``) how many lines went, how
    many compared lines stay, and the documents that keep their like."""
    drops = stored(repeated_lines(docs, edits).toDF("_doc", "_hash", "_drop", "_sources"), "line_drops")
    release_shuffles(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # helpers can't clash in there
    rows = rows.select("row", F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("_h"))
    # Only rows that lose lines need the join; a bounded set of hash buckets tells most others apart.
    bucket = F.pmod("_h", F.lit(_BUCKETS)).cast("int")
    hit = F.broadcast(drops.select(F.pmod("_hash", F.lit(_BUCKETS)).cast("int").alias("_b")).distinct())
    some = rows.join(hit, bucket == F.col("_b"), "left_semi").join(drops, F.col("row.doc_id").eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_hash")), "left")
    none = rows.join(hit, bucket == F.col("_b"), "left_anti")
    cut = F.split("row.text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_cut") - 1), "_drop"), lambda i: F.get(F.col("_cut"), i))
    some = some.select("row", "_drop", "_sources", cut.alias("_cut")).withColumn("_stay", F.when(F.col("_drop").isNull(), F.col("_cut")).otherwise(kept))
    empty = F.array().cast(drops.schema["_sources"].dataType)
    compared = lambda lines: F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: F.length(F.trim(x, F.lit(" \t\r\x0b\f"))) >= MIN_CHARS))).cast("long")
    text = F.when(F.col("_drop").isNull(), F.col("row.text")).otherwise(F.array_join("_stay", "\n"))
    names = report_names(docs)
    own = lambda text: [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    some = some.select(*own(text), *[x.alias(n) for x, n in zip((F.coalesce(F.size("_drop"), F.lit(0)).cast("long"), compared("_stay"), F.coalesce("_sources", empty)), names, strict=True)])
    none = none.select(*own(F.col("row.text")), *[x.alias(n) for x, n in zip((F.lit(0).cast("long"), compared(cut), empty), names, strict=True)])
    return some.unionByName(none)
