"""The joins, groups and set operations that dictionary work needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..model import headword, s_term
from ..storage import stored
from .ordered import islands, numbered, running_total

RULE = "\n\n" + "-" * 40 + "\n"


def merge_consecutive(df: DataFrame, markup: bool = False) -> DataFrame:
    """Consecutive entries of one headword become one.

    Plain: later definitions follow a rule and their terms; HTML: each shows
    its terms in bold, joined by ``<hr>``.  Alternates of merged entries are
    lost; resources are dropped and end a run.
    """
    runs = islands(df, F.when(F.col("is_data"), F.lit(None)).otherwise(F.struct(headword())), "_run").filter("not is_data")
    item = F.struct("part", "seq", "terms", "defi", "defi_format")
    groups = runs.groupBy("_run").agg(F.array_sort(F.collect_list(item)).alias("_all"))  # a run of one headword
    first = F.get("_all", F.lit(0))
    shown = lambda x: F.array_join(x["terms"], ", ")
    if markup:
        body = lambda x: F.when(x["defi_format"] == "m", F.concat(F.lit("<pre>"), x["defi"], F.lit("</pre>"))).otherwise(x["defi"])
        merged, kind = F.array_join(F.transform("_all", lambda x: F.concat(F.lit("<b>"), shown(x), F.lit("</b><br>"), body(x))), "\n<hr>\n"), "h"
    else:
        later = F.transform(F.slice("_all", 2, F.greatest(F.size("_all"), F.lit(1))), lambda x: F.concat(F.lit(RULE), shown(x), F.lit("\n"), x["defi"]))
        merged, kind = F.concat(first["defi"], F.array_join(later, "")), "m"
    many = F.size("_all") > 1
    return groups.select(
        first["seq"].alias("seq"), first["part"].alias("part"), F.when(many, F.slice(first["terms"], 1, 1)).otherwise(first["terms"]).alias("terms"),
        F.when(many, merged).otherwise(first["defi"]).alias("defi"), F.when(many, kind).otherwise(first["defi_format"]).alias("defi_format"),
        F.lit(False).alias("is_data"), F.lit(None).cast("string").alias("fname"), F.lit(None).cast("binary").alias("data"),
    )


def merge_same_word(df: DataFrame, separator: str = "\n", key: Column | None = None) -> DataFrame:
    """All entries of one word, in order, as one definition."""
    key = headword() if key is None else key
    item = F.struct("part", "seq", "defi")
    grouped = df.groupBy(key.alias("word")).agg(F.array_sort(F.collect_list(item)).alias("_all"), F.min("seq").alias("seq"))
    return grouped.select("word", "seq", F.array_join(F.transform("_all", lambda x: x["defi"]), separator).alias("defi"))


def with_alternates(words: DataFrame, word_key: str, alternates: DataFrame, alt_key: str, alt: str) -> DataFrame:
    """Left join of words with their alternates, collected in order."""
    per_word = alternates.groupBy(alt_key).agg(F.array_sort(F.collect_set(alt)).alias("alts"))
    return words.join(per_word.withColumnRenamed(alt_key, "_k"), F.col(word_key) == F.col("_k"), "left").withColumn("alts", F.coalesce("alts", F.array().cast("array<string>"))).drop("_k")


def attach_redirects(df: DataFrame, mark: str = "@@@LINK=") -> DataFrame:
    """Redirect entries (definition = mark + target) become alternates of their target and go."""
    redirect = F.col("defi").startswith(mark) & ~F.col("is_data")
    target = text.strip(F.substring(F.col("defi"), len(mark) + 1, 1 << 30))
    sources = df.filter(redirect).select(target.alias("_t"), "part", "seq", headword().alias("_s")).groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "_s"))).alias("_alts"))
    kept = df.filter(~redirect).withColumn("_h", headword())
    joined = kept.join(sources, F.col("_h") == F.col("_t"), "left")
    alts = F.transform("_alts", lambda x: x["_s"])
    return joined.withColumn("terms", F.when(F.col("_alts").isNotNull(), F.concat("terms", alts)).otherwise(F.col("terms"))).select(*df.columns)


def attach_lemmas(df: DataFrame, forms: DataFrame) -> DataFrame:
    """Inflected forms (lemma, form) become alternates of their lemma; lemmas without an entry get their own rows."""
    per = forms.groupBy("lemma").agg(F.array_sort(F.collect_set("form")).alias("_forms"))
    joined = df.withColumn("_h", headword()).join(per, F.col("_h") == F.col("lemma"), "left")
    known = joined.withColumn("terms", F.when(F.col("_forms").isNotNull(), F.array_distinct(F.concat("terms", "_forms"))).otherwise(F.col("terms"))).select(*df.columns)
    orphans = per.join(df.select(headword().alias("_h")).distinct(), F.col("lemma") == F.col("_h"), "left_anti")
    own = orphans.select(
        F.lit(None).cast("long").alias("seq"), F.lit(0).alias("part"), F.array_distinct(F.concat(F.array("lemma"), "_forms")).alias("terms"), F.lit("").alias("defi"),
        F.lit("m").alias("defi_format"), F.lit(False).alias("is_data"), F.lit(None).cast("string").alias("fname"), F.lit(None).cast("binary").alias("data"),
    )
    return known.unionByName(own)


def both_directions(df: DataFrame, left: str, right: str) -> DataFrame:
    """(direction, term, translations): each side's distinct terms with the other side's, in order."""
    def one(a: str, b: str, name: str) -> DataFrame:
        return df.groupBy(F.col(a).cast("string").alias("term")).agg(F.array_sort(F.collect_set(F.col(b).cast("string"))).alias("translations")).select(F.lit(name).alias("direction"), "term", "translations")

    return one(left, right, "forward").unionByName(one(right, left, "backward"))


def group_by_translations(df: DataFrame, word: str, translation: str) -> DataFrame:
    """Words with the same set of translations are one entry; the longest word leads."""
    per = df.groupBy(word).agg(F.array_sort(F.collect_set(translation)).alias("translations"))
    lead = F.min_by(word, F.struct(-F.length(word), F.col(word)))
    return per.groupBy("translations").agg(lead.alias("headword"), F.array_sort(F.collect_list(word)).alias("words"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(term, status, defi_a, defi_b) by key: same, changed, removed, added; then entries whose alternates changed pair up."""
    side = lambda df, n: df.filter("not is_data").select(s_term().alias(f"k{n}"), headword().alias(f"h{n}"), F.col("terms").alias(f"t{n}"), F.col("defi").alias(f"d{n}"))
    one, two = side(a, 1), side(b, 2)
    full = one.join(two, F.col("k1") == F.col("k2"), "full_outer")
    status = F.when(F.col("k2").isNull(), "removed").when(F.col("k1").isNull(), "added").when(F.col("d1") == F.col("d2"), "same").otherwise("changed")
    base = full.withColumn("status", status)
    gone, new = base.filter("status = 'removed'").select("k1", "h1", "t1", "d1"), base.filter("status = 'added'").select("k2", "h2", "t2", "d2")
    moved = gone.join(new, (F.md5(F.col("d1").cast("binary")) == F.md5(F.col("d2").cast("binary"))) & (F.col("d1") == F.col("d2")) & (F.array_contains("t2", F.col("h1")) | F.array_contains("t1", F.col("h2"))))
    moved = moved.groupBy("k1").agg(F.min("k2").alias("k2"), F.first("d1").alias("d1"))
    rest = base.join(moved.select(F.col("k1").alias("m1")), F.col("k1") == F.col("m1"), "left_anti").join(moved.select(F.col("k2").alias("m2")), F.col("k2") == F.col("m2"), "left_anti")
    out = rest.select(F.coalesce("k1", "k2").alias("term"), "status", F.col("d1").alias("defi_a"), F.col("d2").alias("defi_b"))
    return out.unionByName(moved.select(F.col("k1").alias("term"), F.lit("alternates").alias("status"), F.col("d1").alias("defi_a"), F.col("d1").alias("defi_b")))


def resolve_links(links: DataFrame, index: DataFrame) -> DataFrame:
    """links (seq, target) with the place of the first index row (term, page, at) of the target; ``broken`` without one."""
    first = index.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy("at"))).filter("_r = 1").select("term", "page", F.col("at").alias("target_at"))
    return links.join(first, F.col("target") == F.col("term"), "left").select("seq", "target", "page", "target_at", F.col("page").isNull().alias("broken"))


def resolve_aliases(aliases: DataFrame, rounds: int = 64) -> DataFrame:
    """(alias, target) followed to the end by pointer doubling; aliases that end in a circle keep their last step.

    A chain of n steps takes log2(n) rounds, so 64 rounds end any chain.
    """
    now = aliases.select("alias", "target")
    for _ in range(rounds):
        step = now.alias("a").join(now.select(F.col("alias").alias("_a"), F.col("target").alias("_t")).alias("b"), F.col("a.target") == F.col("_a"), "left")
        moved = step.select("alias", F.coalesce("_t", "target").alias("target"), (F.col("_t").isNotNull() & (F.col("_t") != F.col("target")) & (F.col("_t") != F.col("alias"))).alias("_moved"))
        moved = stored(moved, "aliases")
        again = moved.filter("_moved").limit(1).count() > 0
        now = moved.drop("_moved")
        if not again:
            break
    return now


# --- places and groups -----------------------------------------------------------------


def byte_offsets(df: DataFrame, size: Column) -> DataFrame:
    """``offset`` and ``size``: where each entry's bytes start in one file, in order."""
    return running_total(df.withColumn("size", size.cast("long")), F.col("size"), "offset")


def buckets(df: DataFrame, rows: int) -> DataFrame:
    """``bucket``: consecutive groups of ``rows`` entries."""
    return numbered(df, "_n").withColumn("bucket", F.floor((F.col("_n") - 1) / rows)).drop("_n")


def size_parts(df: DataFrame, size: Column, limit: int, check_every: int = 1) -> DataFrame:
    """``file_part``: a new part starts once the bytes so far reach ``limit``.

    The running sum starts anew at each part, so parts are folded over blocks
    of entries: block sizes are summed in Spark, and only they (one row per
    ``check_every`` entries) are folded in order on a single iterator.
    """
    rows = numbered(df.withColumn("_size", size.cast("long")), "_n").withColumn("_block", F.floor((F.col("_n") - 1) / check_every))
    sums = rows.groupBy("_block").agg(F.sum("_size").alias("_s")).orderBy("_block")

    def fold(frames):
        part, used = 0, 0
        for pdf in frames:
            parts = []
            for s in pdf["_s"]:
                if used >= limit:
                    part, used = part + 1, 0
                parts.append(part)
                used += s
            yield pdf[["_block"]].assign(file_part=parts)

    folded = sums.coalesce(1).sortWithinPartitions("_block").mapInPandas(fold, "_block long, file_part long")
    return rows.join(folded, "_block").drop("_block", "_n", "_size")


def prefix_groups(df: DataFrame, prefix: Column) -> DataFrame:
    """(prefix, first, last, n): groups of entries by a prefix of the headword."""
    return df.filter("not is_data").withColumn("prefix", prefix).withColumn("_h", headword()).groupBy("prefix").agg(F.min("_h").alias("first"), F.max("_h").alias("last"), F.count("*").alias("n"))


def kobo_prefix(term: Column) -> Column:
    """The page of a term, from its first two characters in lower case without white space around them.

    Han characters file alone, kana as katakana, Cyrillic as it is; other
    letters are padded with ``a``; all else files under ``11``.
    """
    two = F.regexp_replace(F.lower(text.strip(F.substring(term, 1, 2))), r"(?s)(?<=.)\x00$", "")
    by_letters = F.when(two.rlike(r"^\p{L}+$"), F.rpad(two, 2, "a")).otherwise("11")
    out = F.when(text.is_kana(two), text.hiragana_to_katakana(two)).when(text.is_cyrillic(two), two).otherwise(by_letters)
    return F.when(text.is_kanji(two), F.substring(two, 1, 1)).otherwise(out)


def trigram_index(df: DataFrame) -> DataFrame:
    """(sub, term, seq) of every term."""
    return df.filter("not is_data").select("seq", F.explode("terms").alias("term")).select(F.explode(text.trigrams(F.col("term"))).alias("sub"), "term", "seq")


def sequential_ids(df: DataFrame) -> DataFrame:
    """``id`` from 1 in entry order."""
    return numbered(df.filter("not is_data"), "id")


INLINE_IMAGE = 'src="(data:image/[^<>"]*)"'


def images_to_resources(df: DataFrame, prefix: str = "") -> DataFrame:
    """Images inside definitions (base 64) become resources, each once; the definitions name them.

    A file's name is ``prefix``, the checksum of its bytes and its type.  A
    ``src`` that isn't base 64 is taken out.
    """
    inline, part = F.regexp_extract_all("defi", F.lit(INLINE_IMAGE), F.lit(1)), r"^data:image/([^;]*);base64,(.*)$"
    bytes_of = lambda s: F.try_to_binary(F.regexp_extract(s, part, 2), F.lit("base64"))
    name_of = lambda s: F.concat(F.lit(prefix), text.crc32hex(bytes_of(s)), F.lit("."), F.regexp_extract(s, part, 1))
    good = lambda s: s.rlike(part) & bytes_of(s).isNotNull()
    has = ~F.col("is_data") & F.coalesce(F.col("defi").contains('src="data:image/'), F.lit(False))
    swap = lambda d, s: F.replace(d, F.concat(F.lit('src="'), s, F.lit('"')), F.when(good(s), F.concat(F.lit('src="./'), name_of(s), F.lit('"'))).otherwise(""))
    named = df.withColumn("defi", F.when(has, F.aggregate(F.array_distinct(inline), F.col("defi"), swap)).otherwise(F.col("defi")))
    found = df.filter(has).select("part", "seq", F.explode(F.array_distinct(inline)).alias("_s")).filter(good(F.col("_s")))
    files = found.select("part", "seq", name_of(F.col("_s")).alias("fname"), bytes_of(F.col("_s")).alias("data"))
    once = files.groupBy("fname").agg(F.min(F.struct("part", "seq")).alias("at"), F.first("data").alias("data"))
    made = once.select("at.seq", "at.part", F.array("fname").alias("terms"), F.concat(F.lit("File: "), "fname").alias("defi"), F.lit("b").alias("defi_format"), F.lit(True).alias("is_data"), "fname", "data")
    return named.unionByName(made.select(*df.columns))
