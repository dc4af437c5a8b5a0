"""Registered queries over the driver's tables, each with the same computation in DuckDB SQL.

Tables become entries: ``documents`` (headword = first word, alternate =
language), ``pages`` (HTML definitions), ``conversations`` (consecutive rows of
one headword), ``part`` (the words of a name as terms).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chinese, html, text
from ..model import entries, headword, s_term
from ..operators import filters, ordered, profile, relational, reverse, sortkeys
from ..storage import stored

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return entries(d, "doc_id", F.array(F.get(F.split("text", " "), F.lit(0)), "lang"), F.col("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(_table(spark, sf_dir, "pages"), "page_id", F.array("url"), F.col("html"), "h")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(_table(spark, sf_dir, "part"), "p_partkey", F.split("p_name", " "), F.concat_ws("\n", "p_brand", "p_type"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return entries(c, F.col("conv_id") * 1000 + F.col("turn"), F.array(F.col("conv_id").cast("string"), F.col("role")), F.coalesce("text", F.lit("")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries, through the always-on filters, in headword order with their rank."""
    return clean_and_sort(spark, sf_dir)


# --- text functions ---------------------------------------------------------------------

_ESC = "replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(13), ''), chr(10), chr(92) || 'n')"


@query(f"select p_partkey, array_to_string(string_split(p_name, ' '), '|') || chr(9) || {_ESC.format('p_brand || chr(10) || p_type')} as line from part")
def tabfile_encode(spark, sf_dir):
    p = parts(spark, sf_dir)
    return p.select(F.col("seq").alias("p_partkey"), F.concat(text.join_bar(F.col("terms")), F.lit("\t"), text.escape_ntb(F.col("defi"))).alias("line"))


@query("select p_partkey, p_name as terms, p_brand || chr(10) || p_type as defi from part")
def tabfile_decode(spark, sf_dir):
    line = tabfile_encode(spark, sf_dir)
    cut = F.split("line", "\t", 2)
    return line.select("p_partkey", F.array_join(text.split_bar_unescape_ntb(F.get(cut, F.lit(0))), " ").alias("terms"), text.unescape_ntb(F.get(cut, F.lit(1))).alias("defi"))


@query(f"select doc_id, {_ESC.format('text')} as escaped, length({_ESC.format('text')}) as n from documents")
def escape_text(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    e = text.escape_ntb(F.col("text"))
    return d.select("doc_id", e.alias("escaped"), F.length(e).cast("long").alias("n"))


@query("select doc_id, replace(text, chr(13), '') as back from documents")
def unescape_text(spark, sf_dir):
    return escape_text(spark, sf_dir).select("doc_id", text.unescape_ntb(F.col("escaped")).alias("back"))


@query("select p_partkey, replace(p_name, ' ', '|') as joined, len(string_split(p_name, ' ')) as n from part")
def bar_join_split(spark, sf_dir):
    p = parts(spark, sf_dir)
    joined = text.join_bar(F.col("terms"))
    return p.select(F.col("seq").alias("p_partkey"), joined.alias("joined"), F.size(text.split_bar(joined)).cast("long").alias("n"))


@query("select p_partkey, case when len(string_split(p_name, ' ')) = 1 then p_name else replace(p_name, ' ', '|') end as term, string_split(p_name, ' ')[1] as head, array_to_string(string_split(p_name, ' ')[2:], ',') as alts from part")
def entry_keys(spark, sf_dir):
    return parts(spark, sf_dir).select(F.col("seq").alias("p_partkey"), s_term().alias("term"), headword().alias("head"), F.array_join(F.slice("terms", 2, F.greatest(F.size("terms"), F.lit(1))), ",").alias("alts"))


@query("select p_partkey, sha1(p_name) as digest, md5(p_name) as m, lower(hex(encode(lower(p_name))))[1:4] as shard from part")
def digests(spark, sf_dir):
    b = F.col("p_name").cast("binary")
    path = text.shard_path(F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.sha1(b).alias("digest"), F.md5(b).alias("m"), F.substring(path, 1, 4).alias("shard"))


@query()
def crc_and_integers(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", text.crc32hex(F.col("p_name")).alias("crc"), text.uint_from_bytes(text.uint_bytes(F.col("p_partkey"), 8)).cast("long").alias("back"))


@query("select page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as escaped, url as back from pages")
def markup_escape(spark, sf_dir):
    e = text.xml_escape(F.col("url"), quote=True)
    return _table(spark, sf_dir, "pages").select("page_id", e.alias("escaped"), text.xml_unescape(e).alias("back"))


@query("select o_orderkey, date_diff('day', date '1970-01-01', o_orderdate::date) + 2440588 as jd, o_orderdate::date as back from orders")
def julian_days(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    jd = text.julian_day(day)
    return _table(spark, sf_dir, "orders").select("o_orderkey", jd.cast("long").alias("jd"), text.from_julian_day(jd).alias("back"))


# --- filters ------------------------------------------------------------------------------


@query("select doc_id as seq, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '(<BR>|<br>)+$', '') as defi from documents where text <> ''")
def trim_filter(spark, sf_dir):
    return filters.non_empty_defi(filters.trim_whitespaces(documents(spark, sf_dir))).select("seq", "defi")


@query("""with w as (select doc_id as seq, unnest(string_split(text, ' ')) as w, unnest(range(1, len(string_split(text, ' ')) + 1)) as i from documents),
f as (select seq, w, min(i) as i from w where w <> '' group by seq, w) select seq, string_agg(w, ' ' order by i) as terms from f group by seq""")
def distinct_alternates(spark, sf_dir):
    """All words of a text as terms, each once, in the order of their first places."""
    e = entries(_table(spark, sf_dir, "documents"), "doc_id", F.split("text", " "), F.lit("x"))
    return filters.remove_empty_dup_alt_terms(filters.non_empty_term(e)).select("seq", F.array_join("terms", " ").alias("terms"))


@query("select seq, head from (select doc_id as seq, string_split(text, ' ')[1] as head, row_number() over (partition by string_split(text, ' ')[1] order by doc_id) as r from documents) where r = 1")
def skip_duplicate_headword(spark, sf_dir):
    return filters.skip_duplicate_headword(documents(spark, sf_dir)).select("seq", headword().alias("head"))


@query("select p_partkey as seq, case when r = 1 then k else k || ' (' || r || ')' end as term from (select p_partkey, replace(p_name, ' ', '|') as k, row_number() over (partition by p_name order by p_partkey) as r from part)")
def unique_terms(spark, sf_dir):
    return filters.prevent_duplicate_terms(parts(spark, sf_dir)).select("seq", s_term().alias("term"))


@query("select page_id as seq, url as term from pages where not regexp_matches(url, '^http://')")
def skip_terms_by_pattern(spark, sf_dir):
    return filters.skip_term_regex(pages(spark, sf_dir), "http://.*").select("seq", s_term().alias("term"))


@query("select page_id as seq, lower(url) as term from pages")
def lower_filter(spark, sf_dir):
    return filters.lower(pages(spark, sf_dir)).select("seq", headword().alias("term"))


@query("select page_id as seq, '<div dir=\"rtl\">' || html || '</div>' as defi from pages")
def rtl_filter(spark, sf_dir):
    return filters.rtl(pages(spark, sf_dir)).select("seq", "defi")


@query("select page_id as seq, regexp_replace(html, '</?(a|li|p)( [^>]*)?>', '', 'g') as defi from pages")
def remove_tags(spark, sf_dir):
    return filters.remove_html(pages(spark, sf_dir), "a,li,p").select("seq", "defi")


@query()
def remove_all_tags(spark, sf_dir):
    return filters.remove_html_all(pages(spark, sf_dir)).select("seq", "defi")


@query()
def normalize_tags(spark, sf_dir):
    upper = pages(spark, sf_dir).withColumn("defi", F.regexp_replace("defi", "<(/?)li>", "<$1LI>"))
    return filters.normalize_html(upper).select("seq", "defi")


_BODY = "substr(html, instr(html, '<body') + 5)"
_INNER = f"substr({_BODY}, instr({_BODY}, '>') + 1)"


@query(f"select page_id as seq, case when html like '<!DOCTYPE html><html%' and instr(html, '<body') > 0 and instr({_INNER}, '</body') > 0 then substr({_INNER}, 1, instr({_INNER}, '</body') - 1) else html end as defi from pages")
def strip_pages(spark, sf_dir):
    return filters.strip_full_html(pages(spark, sf_dir)).select("seq", "defi")


@query("select doc_id as seq, replace(text, chr(0), '') as defi from documents")
def utf8_check(spark, sf_dir):
    return filters.utf8_check(documents(spark, sf_dir)).select("seq", "defi")


@query()
def markdown_filter(spark, sf_dir):
    return filters.md_to_html(turns(spark, sf_dir)).select("seq", "defi", "defi_format")


_FORMAT = "case when regexp_matches({0}, '^<k>[^<>]*</k>', 'is') then 'x' when regexp_matches({0}, '(<(font|i|b|p|div|span|img|table|sup|u|ul|ol|li|h[1-6]|audio)[ >]|<(br|hr)\\s*/?\\s*>|<a |&[a-z]{{2,8}};|&#x?[0-9]{{2,5}};)', 'is') then 'h' else 'm' end"


@query(f"select page_id as id, {_FORMAT.format('html')} as defi_format from pages union all select doc_id + 1000000, {_FORMAT.format('text')} from documents")
def detect_format(spark, sf_dir):
    p, d = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents")
    rows = p.select(F.col("page_id").alias("id"), F.col("html").alias("t")).unionByName(d.select((F.col("doc_id") + 1000000).alias("id"), F.col("text").alias("t")))
    return rows.select("id", text.detect_format(F.col("t")).alias("defi_format"))


@query("select defi_format, count(*) / 100.0::double as share from (select case when regexp_matches(html, '<[a-z]', 'i') then 'h' else 'm' end as defi_format from pages order by page_id limit 100) group by 1")
def format_share(spark, sf_dir):
    return profile.format_share(pages(spark, sf_dir), 100)


@query("""with e as (select doc_id, string_split(text, ' ')[1] as h, lang, text from documents where text <> ''), t as (select doc_id, trim(h, chr(9) || chr(10) || chr(13) || ' ') as h, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as d from e)
select doc_id as seq, h as head, length(d) as n, row_number() over (order by lower(h), doc_id) as rank from t where h <> ''""")
def clean_and_sort(spark, sf_dir):
    clean = stored(filters.apply(documents(spark, sf_dir)), "filtered").withColumn("_k", F.lower(headword()))  # ranges are found by a sample of it
    return ordered.numbered(clean, "rank", ("_k", "part", "seq")).select("seq", headword().alias("head"), F.length("defi").cast("long").alias("n"), "rank")


# --- sort keys ------------------------------------------------------------------------------


def _rank(df: DataFrame, keys) -> DataFrame:
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    return ordered.numbered(df.withColumns(named), "rank", (*named, "part", "seq")).select("seq", "rank")


_HEAD = "string_split(text, ' ')[1]"


@query(f"select doc_id as seq, row_number() over (order by {_HEAD}, doc_id) as rank from documents")
def sort_headword(spark, sf_dir):
    return _rank(documents(spark, sf_dir), sortkeys.key_columns("headword"))


@query(f"select doc_id as seq, row_number() over (order by lower({_HEAD}), doc_id) as rank from documents")
def sort_headword_lower(spark, sf_dir):
    return _rank(documents(spark, sf_dir), sortkeys.key_columns("headword_lower"))


_AL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"select doc_id as seq, row_number() over (order by {_AL.format(_HEAD)}, doc_id) as rank from documents")
def sort_bytes_lower(spark, sf_dir):
    return _rank(documents(spark, sf_dir), sortkeys.key_columns("headword_bytes_lower"))


@query(f"select doc_id as seq, row_number() over (order by {_AL.format(_HEAD)}, {_HEAD}, doc_id) as rank from documents")
def sort_stardict(spark, sf_dir):
    return _rank(documents(spark, sf_dir), sortkeys.key_columns("stardict"))


def _ebook_sql(n: int) -> str:
    return f"select doc_id as seq, row_number() over (order by case when substr(lower({_HEAD}), 1, 1) < 'a' or {_HEAD} = '' then 'SPECIAL' else substr(lower({_HEAD}), 1, {n}) end, {_HEAD}, doc_id) as rank from documents"


@query(_ebook_sql(2))
def sort_ebook(spark, sf_dir):
    return _rank(documents(spark, sf_dir), sortkeys.key_columns("ebook"))


@query(_ebook_sql(3))
def sort_ebook_length3(spark, sf_dir):
    return _rank(documents(spark, sf_dir), sortkeys.key_columns("ebook_length3"))


@query("select c_custkey as seq, row_number() over (order by lower(replace(c_name, '#', '')), c_custkey) as rank from customer")
def sort_dicformids(spark, sf_dir):
    e = entries(_table(spark, sf_dir, "customer"), "c_custkey", F.array("c_name"), F.col("c_mktsegment"))
    return _rank(e, sortkeys.key_columns("dicformids"))


@query()
def sort_random(spark, sf_dir):
    return sortkeys.sort_entries(parts(spark, sf_dir), "random", seed=7).select("seq")


@query()
def sort_locale(spark, sf_dir):
    return sortkeys.sort_entries(documents(spark, sf_dir), "headword_lower:fr").select("seq")


@query()
def sort_legacy_charset(spark, sf_dir):
    return sortkeys.sort_entries(documents(spark, sf_dir), "headword", "windows-1252").select("seq")


# --- groups, joins, windows ---------------------------------------------------------------


@query("""with t as (select conv_id * 1000 + turn as seq, conv_id, role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn) as r, count(*) over (partition by conv_id) as n from conversations)
select min(seq) as seq, conv_id::varchar as head, string_agg(case when r = 1 then text else chr(10) || chr(10) || repeat('-', 40) || chr(10) || conv_id || ', ' || role || chr(10) || text end, '' order by seq) as defi from t group by conv_id""")
def merge_consecutive(spark, sf_dir):
    return relational.merge_consecutive(turns(spark, sf_dir)).select("seq", headword().alias("head"), "defi")


@query("select conv_id::varchar as word, min(conv_id * 1000 + turn) as seq, string_agg(coalesce(text, ''), chr(10) order by turn) as defi from conversations group by conv_id")
def merge_same_word(spark, sf_dir):
    return relational.merge_same_word(turns(spark, sf_dir))


@query("""select count(*) as word_count, sum(len(regexp_extract_all(html, 'bword://'))) as bword_count, sum(case when lower(url) <> url then 1 else 0 end) as non_lowercase_word_count, 0 as data_entry_count from pages""")
def profile_counts(spark, sf_dir):
    return profile.counts(pages(spark, sf_dir)).select("word_count", F.col("bword_count").cast("long"), F.col("non_lowercase_word_count").cast("long"), "data_entry_count")


@query("select lower(regexp_replace(t, '[< />]', '', 'g')) as value, count(*) as n from (select unnest(regexp_extract_all(html, '<[a-zA-Z1-6]+[ />]')) as t from pages) group by 1")
def profile_tags(spark, sf_dir):
    return profile.histogram(pages(spark, sf_dir), "tag").select("value", "n")


@query("select lower(regexp_replace(regexp_extract(html, '<[a-zA-Z1-6]+[ />]'), '[< />]', '', 'g')) as value, count(*) as n from pages group by 1")
def profile_first_tags(spark, sf_dir):
    return profile.histogram(pages(spark, sf_dir), "first_tag").select("value", "n")


@query("select lower(t) as value, count(*) as n from (select unnest(regexp_extract_all(html, '<([a-z1-6]+)[^<>]* style=', 1, 'is')) as t from pages) group by 1")
def profile_styles(spark, sf_dir):
    return profile.histogram(pages(spark, sf_dir), "style").select(F.lower("value").alias("value"), "n")


@query()
def profile_scripts(spark, sf_dir):
    return profile.histogram(documents(spark, sf_dir), "script").select("value", "n")


@query("select n_name as word, list_sort(list(distinct s_name)) as alts from nation left join supplier on n_nationkey = s_nationkey group by n_name".replace("list_sort(list(distinct s_name))", "coalesce(array_to_string(list_sort(list(distinct s_name) filter (where s_name is not null)), '|'), '')"))
def alternates_join(spark, sf_dir):
    n, s = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "supplier")
    return relational.with_alternates(n, "n_nationkey", s, "s_nationkey", "s_name").select(F.col("n_name").alias("word"), F.array_join("alts", "|").alias("alts"))


@query("""select p.p_partkey as seq, p.p_name || coalesce((select '|' || string_agg('alias' || q.p_partkey, '|' order by q.p_partkey) from part q where q.p_partkey % 10 = 3 and q.p_partkey - 3 = p.p_partkey), '') as terms from part p where p.p_partkey % 10 <> 3""")
def redirects(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    is_link = F.col("p_partkey") % 10 == 3
    word = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    e = entries(p, "p_partkey", F.array(F.when(is_link, F.concat(F.lit("alias"), F.col("p_partkey").cast("string"))).otherwise(word)), F.when(is_link, F.concat(F.lit("@@@LINK=#"), (F.col("p_partkey") - 3).cast("string"))).otherwise("text"))
    keyed = e.withColumn("terms", F.transform("terms", lambda t: F.when(t.contains("#"), F.concat(F.lit("#"), F.substring_index(t, "#", -1))).otherwise(t)))
    names = p.select(F.col("p_partkey").alias("k"), "p_name")
    got = relational.attach_redirects(keyed).join(names, F.col("seq") == F.col("k"))
    return got.select("seq", F.array_join(F.concat(F.array("p_name"), F.slice("terms", 2, F.greatest(F.size("terms"), F.lit(1)))), "|").alias("terms"))


@query("""with g as (select o_custkey as lemma, array_to_string(list_sort(list(distinct o_orderpriority)), '|') as forms from orders group by o_custkey)
select s_suppkey::varchar || coalesce('|' || forms, '') as terms from supplier left join g on s_suppkey = lemma union all select lemma::varchar || '|' || forms from g where lemma not in (select s_suppkey from supplier)""")
def lemma_join(spark, sf_dir):
    """Suppliers get the forms of the orders with their number; other numbers are lemmas of their own."""
    s, o = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "orders")
    e = entries(s, "s_suppkey", F.array(F.col("s_suppkey").cast("string")), F.col("s_name"))
    forms = o.select(F.col("o_custkey").cast("string").alias("lemma"), F.col("o_orderpriority").alias("form"))
    return relational.attach_lemmas(e, forms).select(F.array_join("terms", "|").alias("terms"))


@query("select 'forward' as direction, n_name as term, r_name as translations from nation join region on n_regionkey = r_regionkey union all select 'backward', r_name, string_agg(n_name, '|' order by n_name) from nation join region on n_regionkey = r_regionkey group by r_name")
def both_directions(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    both = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return relational.both_directions(both, "n_name", "r_name").select("direction", "term", F.array_join("translations", "|").alias("translations"))


@query("""with w as (select p_name as word, array_to_string(list_sort(list(distinct p_brand)), '|') as tr from part group by p_name)
select tr as translations, first(word order by -length(word), word) as headword, string_agg(word, '|' order by word) as words from w group by tr""")
def translation_groups(spark, sf_dir):
    g = relational.group_by_translations(_table(spark, sf_dir, "part"), "p_name", "p_brand")
    return g.select(F.array_join("translations", "|").alias("translations"), "headword", F.array_join("words", "|").alias("words"))


@query("""with a as (select doc_id, text from documents where doc_id % 5 <> 0), b as (select doc_id, case when doc_id % 7 = 0 then text || '!' else text end as text from documents where doc_id % 3 <> 0)
select coalesce(a.doc_id, b.doc_id)::varchar as term, case when b.doc_id is null then 'removed' when a.doc_id is null then 'added' when a.text = b.text then 'same' else 'changed' end as status from a full join b on a.doc_id = b.doc_id""")
def diff_versions(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    make = lambda df: entries(df, "doc_id", F.array(F.col("doc_id").cast("string")), F.col("text"))
    a = make(d.filter("doc_id % 5 <> 0"))
    b = make(d.filter("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return relational.diff(a, b).select("term", "status")


@query("select distinct unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]{3,}')) as word from documents")
def vocabulary(spark, sf_dir):
    return reverse.vocabulary(documents(spark, sf_dir))


@query("""with s as (select doc_id, regexp_extract_all(unnest(string_split_regex(text, '[.,،]')), '[\\p{L}\\p{N}_]{3,}') as w from documents), t as (select doc_id, unnest(w) as word, len(w) as n, rowid as r from (select *, row_number() over () as rowid from s)),
c as (select doc_id, r, word, count(*) / any_value(n) as rel from t group by doc_id, r, word), m as (select doc_id, word, max(rel) as rel from c group by doc_id, word)
select word, doc_id as seq, rel, rank from (select *, row_number() over (partition by word order by rel desc, doc_id) as rank from m) where rank <= 5""")
def reverse_top(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = reverse.relevance(documents(spark, sf_dir)).withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("rel"), "seq")))
    return rows.filter("rank <= 5").select("word", "seq", "rel", F.col("rank").cast("long").alias("rank"))


@query()
def reverse_lookup(spark, sf_dir):
    return reverse.reverse(turns(spark, sf_dir), 100)


@query("select n_name as word, c_custkey as seq from nation join customer on contains(c_name || ' ' || n_name, n_name) and c_nationkey = n_nationkey where length(n_name) >= 3".replace("join customer on contains(c_name || ' ' || n_name, n_name) and c_nationkey = n_nationkey", "join (select c_custkey, c_name || ' ' || n2.n_name as d from customer join nation n2 on c_nationkey = n2.n_nationkey) on contains(d, n_name)"))
def substring_search(spark, sf_dir):
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    e = entries(c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey), "c_custkey", F.array("c_name"), F.concat_ws(" ", "c_name", "n_name"))
    return reverse.containing(e, n.select(F.col("n_name").alias("word")))


@query("""with w as (select p_partkey as seq, unnest(string_split(p_name, ' ')) as term), x as (select seq, term, chr(10) || term as e from w)
select distinct seq, term, substr(e, i::bigint, 3) as sub from (select seq, term, e, unnest(range(1, length(e) - 1)) as i from x)""".replace("with w as (select p_partkey as seq, unnest(string_split(p_name, ' ')) as term)", "with w as (select p_partkey as seq, unnest(string_split(p_name, ' ')) as term from part)"))
def trigram_index(spark, sf_dir):
    return relational.trigram_index(parts(spark, sf_dir)).distinct()


@query("select l_orderkey * 10 + l_linenumber as seq, length(l_returnflag || l_linestatus || l_extendedprice::varchar) * 0 + l_linenumber as size, (sum(l_linenumber) over (order by l_orderkey * 10 + l_linenumber, l_partkey rows between unbounded preceding and 1 preceding)) as offset from lineitem".replace("length(l_returnflag || l_linestatus || l_extendedprice::varchar) * 0 + ", "").replace("(sum(l_linenumber) over (order by l_orderkey * 10 + l_linenumber, l_partkey rows between unbounded preceding and 1 preceding)) as offset", "coalesce(sum(l_linenumber) over (order by l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), 0)::bigint as offset"))
def byte_offsets(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_linenumber").alias("size"))
    return ordered.running_total(rows, F.col("size").cast("long"), "offset", ("seq", "l_partkey", "l_suppkey", "l_extendedprice")).select("seq", "size", "offset")


@query("select p_partkey as seq, ((row_number() over (order by p_partkey) - 1) // 500)::bigint as bucket from part")
def buckets_of_500(spark, sf_dir):
    return relational.buckets(parts(spark, sf_dir), 500).select("seq", "bucket")


@query("select p_partkey as seq, lag(p_partkey) over (order by p_partkey) as prev, lead(p_partkey) over (order by p_partkey) as next from part")
def linked_list(spark, sf_dir):
    return ordered.neighbours(parts(spark, sf_dir), F.col("seq"), "prev", "next").select("seq", "prev", "next")


@query("""with recursive r as (select doc_id, strlen(text) as s, row_number() over (order by doc_id) as n from documents), b as (select (n - 1) // 100 as k, sum(s)::bigint as s from r group by 1),
f as (select k, s as used, 0::bigint as part from b where k = 0 union all select b.k, case when f.used >= 100000 then b.s else f.used + b.s end, case when f.used >= 100000 then f.part + 1 else f.part end from f join b on b.k = f.k + 1)
select doc_id as seq, part as file_part from r join f on (n - 1) // 100 = k""")
def size_parts(spark, sf_dir):
    return relational.size_parts(documents(spark, sf_dir), F.octet_length("defi"), 100_000, 100).select("seq", F.col("file_part").cast("long").alias("file_part"))


@query("select case when substr(lower(h), 1, 1) < 'a' or h = '' then 'SPECIAL' else substr(lower(h), 1, 2) end as prefix, min(h) as first, max(h) as last, count(*) as n from (select string_split(text, ' ')[1] as h from documents) group by 1")
def ebook_groups(spark, sf_dir):
    return relational.prefix_groups(documents(spark, sf_dir), sortkeys.ebook_prefix(headword()))


@query("""with h as (select string_split(text, ' ')[1] as h from documents), t as (select h, lower(trim(substr(h, 1, 2), chr(9) || chr(10) || chr(13) || ' ')) as two from h)
select case when regexp_full_match(two, '\\p{L}+') then rpad(two, 2, 'a') else '11' end as prefix, min(h) as first, max(h) as last, count(*) as n from t group by 1""")
def kobo_groups(spark, sf_dir):
    return relational.prefix_groups(documents(spark, sf_dir), relational.kobo_prefix(headword()))


@query("select string_split(p_name, ' ')[1] as term from part where p_partkey % 2 = 0 union select string_split(p_name, ' ')[1] from part where p_partkey % 2 = 1")
def union_terms(spark, sf_dir):
    p = parts(spark, sf_dir).select((F.col("seq") % 2).alias("side"), headword().alias("term"))
    return p.filter("side = 0").select("term").union(p.filter("side = 1").select("term")).distinct()


@query("select p_name as term from part where p_partkey % 2 = 0 intersect select p_name from part where p_partkey % 2 = 1")
def common_terms(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return p.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("term")).intersect(p.filter("p_partkey % 2 = 1").select("p_name"))


@query("select p_brand as term, p_size as size from part where p_partkey % 2 = 0 except all select p_brand, p_size from part where p_partkey % 2 = 1")
def except_terms(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    pick = lambda k: p.filter(f"p_partkey % 2 = {k}").select(F.col("p_brand").alias("term"), F.col("p_size").alias("size"))
    return pick(0).exceptAll(pick(1))


@query("""with l as (select page_id as seq, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) as target from pages), i as (select string_split(text, ' ')[1] as term, min(doc_id) as place from documents group by 1)
select seq, target, place as target_at, place is null as broken from l left join i on target = term""")
def resolve_links(spark, sf_dir):
    links = pages(spark, sf_dir).select("seq", F.explode(F.regexp_extract_all("defi", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target"))
    index = documents(spark, sf_dir).select(headword().alias("term"), F.lit(0).alias("page"), F.col("seq").alias("at"))
    return relational.resolve_links(links, index).select("seq", "target", "target_at", "broken")


@query("select p_partkey as alias, p_partkey - p_partkey % 8 as target from part where p_partkey % 8 <> 0")
def resolve_aliases(spark, sf_dir):
    p = _table(spark, sf_dir, "part").filter("p_partkey % 8 <> 0").select(F.col("p_partkey").alias("alias"), (F.col("p_partkey") - 1).alias("target"))
    return relational.resolve_aliases(p)


@query("select doc_id as seq, row_number() over (order by doc_id) as id from documents")
def sequential_ids(spark, sf_dir):
    return relational.sequential_ids(documents(spark, sf_dir)).select("seq", "id")


@query("select count(distinct p_name) + count(distinct p_type) as n from part")
def count_both_sides(spark, sf_dir):
    return _table(spark, sf_dir, "part").agg((F.count_distinct("p_name") + F.count_distinct("p_type")).alias("n"))


@query("select p_partkey as seq, regexp_extract(p_type, '^([A-Z]+)', 1) as word, p_name || ' {' || p_type || '}' as term from part")
def typed_terms(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("seq"), F.regexp_extract("p_type", "^([A-Z]+)", 1).alias("word"), F.format_string("%s {%s}", "p_name", "p_type").alias("term"))


@query("select page_id as seq, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)[1] as first_link, length(html) as n from pages")
def link_extraction(spark, sf_dir):
    return pages(spark, sf_dir).select("seq", F.get(F.regexp_extract_all("defi", F.lit('<a href="([^"]*)"'), F.lit(1)), F.lit(0)).alias("first_link"), F.length("defi").cast("long").alias("n"))


@query("select doc_id as seq, text as defi from documents where text <> ''".replace("text as defi", "regexp_replace(text, '^\\s+|\\s+$', '', 'g') as defi"))
def streaming_filters(spark, sf_dir):
    """The filters as a stream over the documents, one batch, into a table."""
    import uuid

    from ..storage import shared_dir
    from ..streaming.replay import fan_out, filtered_stream

    base = f"{shared_dir(spark)}/lexweave/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    schema = _table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, sf_dir, base, schema))
    rows = entries(stream, "doc_id", F.array(F.coalesce(F.get(F.split("text", " "), F.lit(0)), F.lit("-")), "lang"), F.col("text"))
    out = filtered_stream(rows)
    fan_out(out, [lambda batch, n: batch.write.mode("append").parquet(f"{base}/out")], f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out").select("seq", "defi")


def _stream_folder(spark, sf_dir, base, schema) -> str:
    """Streams read folders: the documents, written to one."""
    spark.read.schema(schema).parquet(f"{sf_dir}/documents.parquet").write.parquet(f"{base}/in")
    return f"{base}/in"


@query("select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark, sf_dir):
    """Beyond dictionaries: tumbling windows over events."""
    w = F.window("ts", "1 hour")
    return _table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query(f"""with w as (select doc_id as seq, list_filter(regexp_split_to_array(translate(regexp_replace(text, '\\([^)]+\\)', '', 'g'), '!"#$%&()*+,./:;<=>?@[\\]^_`{{|}}~', repeat(' ', 30)), '\\s+'), lambda x: x <> '') as words from documents),
f as (select seq, words, list_filter(words, lambda x: x not in ({', '.join(repr(x) for x in chinese.STOP_WORDS)})) as telling from w)
select seq, array_to_string((case when len(telling) > 0 then telling else words end)[1:10], ' ') as summary from f where words is not null""")
def gloss_summary(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("seq"), chinese.summary(F.col("text")).alias("summary"))


@query("""with s as (select p_partkey as seq, lower(string_split(p_name, ' ')[1]) as base, (p_partkey % 6)::int as n from part),
v as (select *, case when contains(base, 'a') then 'a' when contains(base, 'e') then 'e' when contains(base, 'o') then 'o' when contains(base, 'iu') then 'u' when contains(base, 'ui') then 'i' when contains(base, 'i') then 'i' when contains(base, 'u') then 'u' end as vowel from s)
select seq, case when n = 0 then base || '0' when n = 5 or vowel is null then base else replace(base, vowel, substr(case vowel when 'a' then 'āáǎà' when 'e' then 'ēéěè' when 'o' then 'ōóǒò' when 'i' then 'īíǐì' else 'ūúǔù' end, n, 1)) end as syllable, case when n = 0 then '' else n::varchar end as tone from v""")
def pinyin_syllables(spark, sf_dir):
    spoken = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lower(F.get(F.split("p_name", " "), F.lit(0))), (F.col("p_partkey") % 6).cast("string")).alias("s"))
    return spoken.select("seq", chinese.with_tone_mark(F.col("s")).alias("syllable"), chinese.tone(F.col("s")).alias("tone"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
