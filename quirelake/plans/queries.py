"""Registered queries over the driver's tables, each with the same question in DuckDB SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import keys
from quirelake.operators import documents, graph, library, membership, positions, resolve, sections, series
from quirelake.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: One class of white space for both engines.
WS = r"[\t-\r \x{00a0}]"
FOLD = "strip_accents(lower({}))"
WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- catalogue ---------------------------------------------------------------------------------------------------


@query(
    "library_list",
    """
with o as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders)
select c_custkey, c_name, n_name, o_orderkey, o_orderdate,
       case when o_orderkey is null then 'unread' when o_orderstatus = 'F' then 'finished' else 'reading' end status
from customer left join nation on n_nationkey = c_nationkey left join o on o_custkey = c_custkey and o.n = 1
""",
)
def library_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with their owner and the one reader's progress; the reader's predicate stays on the right side."""
    last = library.latest(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    out = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    out = out.join(last, F.col("o_custkey") == F.col("c_custkey"), "left")
    status = F.when(F.col("o_orderkey").isNull(), "unread").when(F.col("o_orderstatus") == "F", "finished").otherwise("reading")
    return out.select("c_custkey", "c_name", "n_name", "o_orderkey", "o_orderdate", status.alias("status"))


@query(
    "user_reading_stats",
    "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) books_started, (select max(o_orderdate) from orders where o_custkey = c_custkey) last_read from customer",
)
def user_reading_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12, D04."""
    return library.with_counts(_t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderdate")


@query("semi_markedited", "select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 45)")
def semi_markedited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: books that are members."""
    touched = _t(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name").join(touched, "p_partkey", "left_semi")


@query("anti_prune", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def anti_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a dear order, as series without a member."""
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_name").join(_t(spark, sf_dir, "orders").where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("readers_of_book", "select o_orderkey, c_name, o_totalprice from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT'")
def readers_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C03, B14."""
    users = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return library.readers(_t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumn("k", F.col("o_custkey")), users, "k").select("o_orderkey", "c_name", "o_totalprice")


@query("distinct_genres", "select distinct p_brand genre from part where p_brand <> ''")
def distinct_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D02."""
    return _t(spark, sf_dir, "part").where("p_brand <> ''").select(F.col("p_brand").alias("genre")).distinct()


@query(
    "genre_of_series",
    """
with n as (select p_brand series, p_type genre, count(distinct p_partkey) n from part where p_type <> '' group by all),
t as (select series, max(n) top from n group by series),
l as (select n.series, count(*) leaders, min(genre) g from n join t on t.series = n.series and n = top group by n.series)
select series, case when leaders = 1 then g else '' end genre from l
""",
)
def genre_of_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C06, D03."""
    return library.genre_of_series(_t(spark, sf_dir, "part").select(F.col("p_brand").alias("series"), "p_partkey", "p_type"), "series", "p_partkey", "p_type").select("series", "genre")


@query(
    "most_common_spelling",
    """
with m as (select p_size, case when p_partkey % 3 = 0 then upper(p_name) else p_name end name, p_partkey from part),
c as (select p_size, name, count(*) n, min(p_partkey) first_seen from m group by all)
select p_size, name, n from c qualify row_number() over (partition by p_size order by n desc, contains(name, ','), first_seen) = 1
""",
)
def most_common_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D08."""
    m = _t(spark, sf_dir, "part").select("p_size", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), "p_partkey")
    return library.most_common_spelling(m, ["p_size"], "name", "p_partkey").select("p_size", "name", "n")


@query(
    "most_common_key",
    """
with m as (select p_brand, lower(p_name) key, case when p_partkey % 3 = 0 then upper(p_name) else p_name end name, p_partkey from part),
q as (select p_brand, key, count(*) uses, min(p_partkey) f from m group by all), k as (select * from q qualify row_number() over (partition by p_brand order by uses desc, f) = 1),
c as (select m.p_brand, m.key, name, count(*) n, min(p_partkey) g from m join k on k.p_brand = m.p_brand and k.key = m.key group by all)
select c.p_brand, c.key, name, uses from c join k on k.p_brand = c.p_brand and k.key = c.key
qualify row_number() over (partition by c.p_brand, c.key order by n desc, contains(name, ','), g) = 1
""",
)
def most_common_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D07."""
    m = _t(spark, sf_dir, "part").select("p_brand", F.lower("p_name").alias("key"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), "p_partkey")
    return library.most_common_key(m, ["p_brand"], "key", "name", "p_partkey").select("p_brand", "key", "name", "uses")


_MEMBERS = """select p_brand series, p_partkey book, p_name title, cast(p_size as double) as position,
  case when p_partkey % 7 = 0 then cast(p_size + 3 as double) end position_end,
  case p_partkey % 3 when 0 then 'unread' when 1 then 'finished' else 'reading' end status,
  case p_partkey % 3 when 0 then null when 1 then 1.0 else 0.5 end percent,
  cast(p_partkey % 1000 as bigint) read_at, cast(p_partkey as bigint) added_at from part"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as members of numbered series, one series a brand."""
    third = F.col("p_partkey") % 3
    return _t(spark, sf_dir, "part").select(
        F.col("p_brand").alias("series"), F.col("p_partkey").alias("book"), F.col("p_name").alias("title"), F.col("p_size").cast("double").alias("position"),
        F.when(F.col("p_partkey") % 7 == 0, (F.col("p_size") + 3).cast("double")).alias("position_end"),
        F.when(third == 0, "unread").when(third == 1, "finished").otherwise("reading").alias("status"),
        F.when(third == 1, 1.0).when(third == 2, 0.5).alias("percent"), (F.col("p_partkey") % 1000).cast("long").alias("read_at"), F.col("p_partkey").cast("long").alias("added_at"),
    )


@query(
    "series_summary",
    f"""
with m as ({_MEMBERS}), g as (
select series, count(*) books, count(*) filter (status = 'finished') finished, bool_or(position is not null) numbered, count(*) filter (status <> 'unread') begun,
       greatest(0, max(read_at)) last_read, max(added_at) last_added,
       cast(round(100 * avg(case when status = 'finished' then 1.0::double else coalesce(percent, 0)::double end)) as bigint) percent from m group by series)
select * exclude (begun), case when finished = books then 'finished' when begun > 0 then 'reading' else 'unread' end state from g
""",
)
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D05, D16."""
    return library.series_summary(_members(spark, sf_dir), "series")


@query(
    "continue_reading_top6",
    f"with m as ({_MEMBERS}) select book, title, read_at from m where status = 'reading' order by read_at desc, book limit 6",
)
def continue_reading_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature."""
    return _members(spark, sf_dir).where("status = 'reading'").orderBy(F.desc("read_at"), "book").limit(6).select("book", "title", "read_at")


@query("search_filter", "select p_partkey, p_name from part where contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B03, B04."""
    return library.search(_t(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], " Brand#1 ").select("p_partkey", "p_name")


@query(
    "insert_or_ignore",
    """
with b as (select l_orderkey k, l_linenumber v, 0 side from lineitem where l_linenumber <= 2 union all select l_orderkey, l_linenumber + 10, 1 from lineitem where l_linenumber >= 2)
select k, v from b qualify row_number() over (partition by k order by side, v) = 1
""",
)
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H02."""
    li = _t(spark, sf_dir, "lineitem")
    old = li.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v"))
    new = li.where("l_linenumber >= 2").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") + 10).alias("v"))
    return library.insert_or_ignore(old, new, ["k"])


@query(
    "snapshot_delta",
    """
with a as (select o_custkey, o_orderpriority from orders where o_orderstatus <> 'P'), b as (select o_custkey, o_orderpriority from orders where o_orderstatus <> 'O')
select *, 'added' as change from (select * from b except all select * from a) union all select *, 'removed' as change from (select * from a except all select * from b)
""",
)
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots: all orders that were ready before, and all that are now."""
    o = _t(spark, sf_dir, "orders")
    pick = lambda gone: o.where(F.col("o_orderstatus") != gone).select("o_custkey", "o_orderpriority")
    return library.snapshot_delta(pick("P"), pick("O"))


@query(
    "sections_by_author",
    r"""
with n as (select p_partkey, unnest(case when p_size % 4 = 0 then [''] when p_size % 2 = 0 then ['Ann ' || p_type, 'Bo ' || p_brand] else [p_type || ', Ann'] end) as name from part),
k as (select p_partkey, name, array_to_string(list_sort(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')), ' ') as key from n),
g as (select key, count(distinct p_partkey) books from k group by 1),
c as (select key, name, count(*) c, min(p_partkey) f from k group by all), s as (select * from c qualify row_number() over (partition by key order by c desc, contains(name, ','), f) = 1),
o as (select g.key, s.name, books, case when contains(s.name, ',') then split_part(s.name, ',', 1) else split_part(s.name, ' ', -1) end surname from g join s on s.key = g.key)
select key, name, books, row_number() over (order by name = '', surname, name) as place from o
""",
)
def sections_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book under each of its authors, however the name is written; by surname, none last.

    Sections are as few as authors; they are numbered without a window over all of them.
    """
    line = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 2 == 0, F.concat(F.lit("Ann "), "p_type", F.lit(" & Bo "), "p_brand")).otherwise(F.concat("p_type", F.lit(", Ann")))
    names = _t(spark, sf_dir, "part").select("p_partkey", F.explode_outer(F.when(line == "", F.array(F.lit(""))).otherwise(keys.author_names(line))).alias("name"))
    n = names.withColumn("key", keys.author_key(F.col("name")))
    books = n.groupBy("key").agg(F.countDistinct("p_partkey").alias("books"))
    spelled = library.most_common_spelling(n, ["key"], "name", "p_partkey").select("key", "name")
    found = books.join(spelled, "key").withColumn("at", F.struct((F.col("name") == "").alias("last"), keys.surname(F.col("name")).alias("surname"), "name"))
    return membership._numbered(found, "at").select("key", "name", "books", F.col("n").cast("long").alias("place"))


# -- keys --------------------------------------------------------------------------------------------------------


@query(
    "fingerprint_duplicates",
    "select sha256(text) fingerprint, count(*) n, min(doc_id) first_doc from documents group by text having count(*) > 1",
)
def fingerprint_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files uploaded twice; only digests are shuffled."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("title_key", rf"select doc_id, array_to_string(regexp_extract_all({FOLD.format('split_part(text, chr(10), 1)')}, '[\p{{L}}\p{{N}}]+'), ' ') title_key from documents")
def title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the first lines."""
    return _t(spark, sf_dir, "documents").select("doc_id", keys.title_key(F.substring_index("text", "\n", 1)).alias("title_key"))


@query("author_key", rf"select doc_id, array_to_string(list_sort(regexp_extract_all({FOLD.format('split_part(text, chr(10), 1)')}, '[\p{{L}}\p{{N}}]+')), ' ') author_key from documents")
def author_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J02."""
    return _t(spark, sf_dir, "documents").select("doc_id", keys.author_key(F.substring_index("text", "\n", 1)).alias("author_key"))


@query(
    "loose_series_key",
    r"""
with t as (select p_partkey, 'The  ' || p_name || ' -  ' || p_brand || case when p_partkey % 2 = 0 then ' Series' else ' -' end s from part),
c as (select p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(s, '[\t-\r ]+', ' ', 'g'), '^[\t-\r ,:;\-–—]+', ''), '[\t-\r ,:;\-–—]+$', '')) k from t)
select p_partkey, k series_key, regexp_replace(regexp_replace(k, '^the ', ''), '[ -]series$', '') loose_key from c
""",
)
def loose_series_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J03-J05."""
    end = F.when(F.col("p_partkey") % 2 == 0, " Series").otherwise(" -")
    name = F.concat(F.lit("The  "), F.col("p_name"), F.lit(" -  "), F.col("p_brand"), end)
    return _t(spark, sf_dir, "part").select("p_partkey", keys.series_key(name).alias("series_key"), keys.loose_key(name).alias("loose_key"))


_PLACES = "case p_partkey % 6 when 0 then p_size::varchar when 1 then p_size || ',5' when 2 then ' ' || p_size || ' - ' || (p_size + 4) || ' ' when 3 then '0' || p_size when 4 then p_size || '-' || p_size else 'no. ' || p_size end"


@query(
    "parse_place",
    rf"""
with t as (select p_partkey, {_PLACES} s from part),
m as (select p_partkey, regexp_extract(s, '^\s*(\d{{1,5}}(?:[.,]\d+)?)(?:\s*[-–—]\s*(\d{{1,5}}(?:[.,]\d+)?))?\s*$', ['a', 'b']) g from t),
n as (select p_partkey, try_cast(replace(g.a, ',', '.') as double) a, try_cast(replace(g.b, ',', '.') as double) b from m)
select p_partkey, case when b is null or b >= a then a end as position, case when b > a then b end as position_end from n
""",
)
def parse_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J08, J09 over numbers written in six ways."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    s = F.when(k == 0, size).when(k == 1, F.concat(size, F.lit(",5"))).when(k == 2, F.concat(F.lit(" "), size, F.lit(" - "), (F.col("p_size") + 4).cast("string"), F.lit(" ")))
    s = s.when(k == 3, F.concat(F.lit("0"), size)).when(k == 4, F.concat(size, F.lit("-"), size)).otherwise(F.concat(F.lit("no. "), size))
    p = keys.parse_place(s)
    return _t(spark, sf_dir, "part").select("p_partkey", p["position"].alias("position"), p["position_end"].alias("position_end"))


@query(
    "isbn_normalise",
    """
with t as (select p_partkey, lpad(p_partkey::varchar, 9, '0') b from part),
d as (select p_partkey, b, list_transform(string_split(b, ''), lambda x: x::int) n, list_transform(string_split('978' || b, ''), lambda x: x::int) m from t),
c as (select p_partkey, b, (11 - list_sum(list_transform(n, lambda x, i: x * (11 - i))) % 11) % 11 c10, (10 - list_sum(list_transform(m, lambda x, i: x * case when i % 2 = 0 then 3 else 1 end)) % 10) % 10 c13 from d)
select p_partkey, case p_partkey % 4 when 0 then '978' || b || c13 when 1 then '978' || b || c13 when 2 then null else null end isbn from c
""",
)
def isbn_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18 over identifiers built from keys: 13 digits, marked 10 digits, bare 10 digits, a wrong check digit."""
    b = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    s10 = sum((F.substring(b, i + 1, 1).cast("int") * (10 - i) for i in range(9)), F.lit(0))
    c10 = (11 - s10 % 11) % 11
    x = F.concat(F.lit("978"), b)
    s13 = sum((F.substring(x, i + 1, 1).cast("int") * (3 if i % 2 else 1) for i in range(12)), F.lit(0))
    c13 = (10 - s13 % 10) % 10
    ten = F.concat(b, F.when(c10 == 10, "X").otherwise(c10.cast("string")))
    k = F.col("p_partkey") % 4
    s = F.when(k == 0, F.concat(x, c13.cast("string"))).when(k == 1, F.concat(F.lit("urn:isbn:"), ten)).when(k == 2, ten).otherwise(F.concat(x, ((c13 + 1) % 10).cast("string")))
    return _t(spark, sf_dir, "part").select("p_partkey", keys.read_isbn(s).alias("isbn"))


@query(
    "slug_dedupe",
    r"""
with s as (select p_partkey, p_brand, regexp_replace(regexp_replace(lower(trim(p_name)), '[^\p{L}\p{N}\s-]', '', 'g'), '\s+', '-', 'g') slug from part),
n as (select *, row_number() over (partition by p_brand, slug order by p_partkey) - 1 n from s)
select p_partkey, case when n > 0 then slug || '-' || n else slug end anchor from n
""",
)
def slug_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11, J27."""
    s = _t(spark, sf_dir, "part").withColumn("slug", keys.slugify(F.col("p_name")))
    return sections.unique_slugs(s, "p_brand", "slug", "p_partkey").select("p_partkey", "anchor")


@query(
    "date_label",
    """
with t as (select event_id, ts at time zone 'UTC' at time zone 'Europe/Copenhagen' t, (select max(ts) from events) at time zone 'UTC' at time zone 'Europe/Copenhagen' n from events)
select event_id, case when t::date = n::date then strftime(t, '%H:%M') when year(t) = year(n) then strftime(t, '%-d %b') else strftime(t, '%-d %b %Y') end label from t
""",
)
def date_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Now is the last event's time, one row that is joined by broadcast."""
    e = _t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_id", keys.date_label(F.col("ts"), F.col("now")).alias("label"))


# -- series ------------------------------------------------------------------------------------------------------

_HELD = """h as (select distinct series, unnest(list_distinct([position] || case when ceil(position) <= floor(coalesce(position_end, position))
  then list_transform(range(cast(ceil(position) as bigint), cast(floor(coalesce(position_end, position)) as bigint) + 1), lambda x: x::double) else [] end)) number from m where position is not null)"""
_SPARSE = _MEMBERS.replace("cast(p_size as double) as position", "cast(p_size as double) as position").replace("from part", "from part where p_size % 3 <> 0 or p_partkey % 11 = 0")


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).where("position % 3 <> 0 or book % 11 = 0")


@query("series_held", f"with m as ({_MEMBERS}), {_HELD} select series, number from h")
def series_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17."""
    return series.held(_members(spark, sf_dir), "series")


@query(
    "series_gaps",
    f"""
with m as ({_SPARSE}), {_HELD},
t as (select series, greatest(0, max(coalesce(position_end, position, 0))) top from m group by series),
g as (select series, unnest(range(1, cast(ceil(top) as bigint)))::double number from t),
l as (select g.* from g where not exists (select 1 from h where h.series = g.series and h.number = g.number))
select series, number from l qualify count(*) over (partition by series) <= 50
""",
)
def series_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D18, E08, H03."""
    return series.gaps(_sparse(spark, sf_dir), "series")


@query(
    "missing_books",
    f"""
with m as ({_SPARSE}), {_HELD},
t as (select series, greatest(0, max(coalesce(position_end, position, 0))) top from m group by series),
x as (select distinct p_brand series, cast(p_size as double) number from part),
r as (select distinct series, 9.0::double number from m)
select x.* from x join t on t.series = x.series where number >= 1 and number < top
  and not exists (select 1 from h where h.series = x.series and h.number = x.number) and not exists (select 1 from r where r.series = x.series and r.number = x.number)
""",
)
def missing_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts are the external list, the sparse ones the library; number 9 is removed everywhere."""
    m = _sparse(spark, sf_dir)
    listed = _members(spark, sf_dir).select("series", F.col("position").alias("number")).distinct()
    removed = m.select("series", F.lit(9.0).alias("number")).distinct()
    return series.missing(m, listed, "series", removed)


@query(
    "series_order",
    f"with m as ({_MEMBERS}) select series, book, row_number() over (partition by series order by coalesce(position_end, position) asc nulls last, coalesce(position, 0) desc, title, book) place from m",
)
def series_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10, G02."""
    place = F.row_number().over(Window.partitionBy("series").orderBy(*series.in_order(), "book"))
    return _members(spark, sf_dir).select("series", "book", place.cast("long").alias("place"))


_NEXT = """select p_brand || '/' || p_size series, p_partkey book, p_name || p_partkey title, cast(row_number() over (partition by p_brand, p_size order by p_partkey) as double) as position,
  cast(null as double) position_end, case when p_partkey % 5 = 0 then 'finished' else 'unread' end status, cast(p_partkey as bigint) read_at from part"""


@query(
    "series_next_item",
    f"""
with m as ({_NEXT}), o as (select *, row_number() over (partition by series order by position) ord from m),
d as (select series, max(ord) done from o where status = 'finished' group by series),
k as (select o.*, coalesce(done, 0) done from o left join d using (series) where status = 'unread')
select series, book, case when done > 0 then 'Next up' else 'Start with' end verb from k
qualify row_number() over (partition by series order by case when ord > done then 1 else 2 end, ord) = 1
""",
)
def series_next_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E09."""
    w = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    m = _t(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("series"), F.col("p_partkey").alias("book"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("title"),
        F.row_number().over(w).cast("double").alias("position"), F.lit(None).cast("double").alias("position_end"),
        F.when(F.col("p_partkey") % 5 == 0, "finished").otherwise("unread").alias("status"), F.col("p_partkey").cast("long").alias("read_at"),
    )
    return series.next_item(m, "series").select("series", "book", "verb")


# -- duplicates and matches --------------------------------------------------------------------------------------

_BOOKS = """select p_partkey id, lower(p_name) || ' ' || p_size title, case when p_partkey % 4 = 0 then '' else p_brand end author,
  case when p_partkey % 9 = 0 then 'f' || (p_partkey % 100) else '' end file, case when p_partkey % 10 = 0 then 'i' || (p_partkey % 150) else '' end isbn from part"""


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(
        k.alias("id"), F.concat_ws(" ", F.lower("p_name"), F.col("p_size").cast("string")).alias("title"), F.when(k % 4 == 0, "").otherwise(F.col("p_brand")).alias("author"),
        F.when(k % 9 == 0, F.concat(F.lit("f"), (k % 100).cast("string"))).otherwise("").alias("file"), F.when(k % 10 == 0, F.concat(F.lit("i"), (k % 150).cast("string"))).otherwise("").alias("isbn"),
    )


_EDGES = """e as (select a.id a, b.id b, 1 p from books a join books b on a.file = b.file and a.file <> '' and a.id < b.id
  union all select a.id, b.id, 2 from books a join books b on a.isbn = b.isbn and a.isbn <> '' and a.id < b.id
  union all select a.id, b.id, 3 from books a join books b on a.title = b.title and a.id < b.id and (a.author = '' or b.author = '' or a.author = b.author))"""


def _different(books: DataFrame) -> DataFrame:
    return books.where("id % 5 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))


@query("duplicate_pairs", f"with books as ({_BOOKS}), {_EDGES} select a, b, (['file', 'isbn', 'title'])[min(p)] reason from e where not (a % 5 = 0 and b = a + 1) group by a, b")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14-C16, D11."""
    b = _books(spark, sf_dir)
    return resolve.duplicate_pairs(b, "id", "file", "isbn", "title", "author", _different(b))


@query(
    "duplicate_components",
    f"""
with recursive books as ({_BOOKS}), {_EDGES}, p as (select distinct a, b from e where not (a % 5 = 0 and b = a + 1)), u as (select a, b from p union select b, a from p),
r(a, b) as (select a, a from u union select r.a, u.b from r join u on r.b = u.a)
select a node, min(b) component from r group by a
""",
)
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star a file, ISBN and title is enough, but where a pair was declared different."""
    b = _books(spark, sf_dir)
    linked = [resolve.component_edges(b, key, "id", key, _different(b), by) for key, by in (("file", None), ("isbn", None), ("title", "author"))]
    return graph.components(linked[0].unionByName(linked[1]).unionByName(linked[2]))


_TELL = "case when len(list_filter(w, lambda x: not list_contains({c}, x))) > 0 then list_filter(w, lambda x: not list_contains({c}, x)) else w end".format(c="[" + ", ".join(f"'{w}'" for w in keys.COMMON) + "]")
_LINES = rf"""w as (select item_id id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')) w from benchmark), t as (select id, {_TELL} w from w)"""


@query(
    "title_jaccard_match",
    f"""
with {_LINES}, p as (select a.id left_id, b.id right_id, len(list_intersect(a.w, b.w)) n, len(a.w) x, len(b.w) y from t a join t b on a.id < b.id)
select left_id, right_id, round(n / (x + y - n), 6) score from p where n > 0 and n / (x + y - n) >= 0.05
""",
)
def title_jaccard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19, J20, H04 over the whole texts of benchmark items, at a lower bar to have matches."""
    t = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"))
    return resolve.similar_titles(t, t, 0.05).where("left_id < right_id").withColumn("score", F.round("score", 6))


@query("text_jaccard_match")
def text_jaccard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19, J20, H04 over the whole texts of benchmark items, at a bar of 0.05: the likeliest pair of the smallest table has 0.099."""
    t = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"))
    return resolve.similar_titles(t, t, 0.05).where("left_id < right_id").withColumn("score", F.round("score", 6))


@query(
    "rank_matches_top5",
    """
with m as (select l_orderkey lookup, l_partkey % 40 as key, l_linenumber * 1000000 + l_partkey ord, case when l_orderkey % 4 = 0 then 0.0 else round(l_discount, 2) end score, l_suppkey % 3 = 0 by_author from lineitem),
o as (select * from m qualify row_number() over (partition by lookup, key order by ord) = 1),
s as (select *, max(score) over (partition by lookup) best from o),
r as (select lookup, key, ord, score, row_number() over (partition by lookup order by score desc, ord) place from s where score > 0 or (best = 0 and by_author))
select * from r where place <= 5
""",
)
def rank_matches_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of order lines with one number and part, the first in the table counts."""
    m = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lookup"), (F.col("l_partkey") % 40).alias("key"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), F.when(F.col("l_orderkey") % 4 == 0, 0.0).otherwise(F.round("l_discount", 2)).alias("score"), (F.col("l_suppkey") % 3 == 0).alias("by_author"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return resolve.rank_matches(m, "lookup", at=("_file", "_row")).drop("by_author").withColumn("place", F.col("place").cast("long"))


@query(
    "catalogue_merge",
    """
with a as (select s_suppkey k, case when s_suppkey % 3 = 0 then '' else s_name end title from supplier where s_suppkey % 2 = 0),
b as (select s_suppkey k, upper(s_name) title from supplier where s_suppkey % 5 <> 0)
select coalesce(a.k, b.k) k, coalesce(nullif(a.title, ''), b.title) title, case when a.k is null then 'other' when b.k is null then 'preferred' else 'both' end source from a full join b on a.k = b.k
""",
)
def catalogue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20, H01."""
    s = _t(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "k")
    a = s.where("k % 2 = 0").select("k", F.when(F.col("k") % 3 == 0, "").otherwise(F.col("s_name")).alias("title"))
    return resolve.merge_catalogues(a, s.where("k % 5 <> 0").select("k", F.upper("s_name").alias("title")), "k", ["title"])


# -- sections ----------------------------------------------------------------------------------------------------

_SECTIONS = "s as (select conv_id, turn, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) chars from conversations), o as (select *, coalesce(sum(chars) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint start from s)"


@query("section_offsets", f"with {_SECTIONS} select conv_id, turn, chars, start from o")
def section_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E01, D24."""
    return sections.section_offsets(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "chars", "start")


@query(
    "place_at_percent",
    f"""
with {_SECTIONS}, t as (select conv_id, sum(chars) total, (conv_id % 100) / 80.0::double percent from o group by conv_id),
x as (select *, least(greatest(percent, 0), 1) * total as goal from t), h as (select x.conv_id, percent, goal, o.turn section, o.start from x asof join o on x.conv_id = o.conv_id and x.goal >= o.start)
select conv_id, percent, section, cast(greatest(0, floor(goal - start + 0.5)) as bigint) as offset from h
""",
)
def place_at_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C21, J33."""
    s = sections.section_offsets(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text").withColumnRenamed("turn", "section")
    t = s.select("conv_id").distinct().withColumn("percent", (F.col("conv_id") % 100) / F.lit(80.0))
    return sections.place_at_percent(s, t, "conv_id")


@query(
    "carry_forward_title",
    "select conv_id, turn, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn) carried from conversations",
)
def carry_forward_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E02."""
    c = _t(spark, sf_dir, "conversations").withColumn("title", F.when(F.col("role") == "user", F.col("text")))
    return sections.carry_title(c, "conv_id", "turn", "title").select("conv_id", "turn", "carried")


@query(
    "title_islands",
    f"""
with {_SECTIONS}, t as (select conv_id, turn, start as "at", start + chars as "end", turn % 3 as key from o),
n as (select *, case when lag(t."end") over (partition by conv_id order by turn) = t."at" and t."at" - lag(t."at") over (partition by conv_id order by turn) < 1000 then 0 else 1 end fresh from t),
c as (select *, sum(fresh) over (partition by conv_id order by turn) c, max(turn) over (partition by conv_id, key) last from n),
k as (select *, "end" - "at" >= 1000 and (count(*) over (partition by conv_id, c) < 3 or last = turn) ok from c)
select conv_id, turn, ok and (count(*) over (partition by conv_id, key, ok) < 3 or row_number() over (partition by conv_id, key, ok order by turn) = 1) chosen from k
""",
)
def title_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E03."""
    s = sections.section_offsets(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    t = s.select("conv_id", "turn", F.col("start").alias("at"), (F.col("start") + F.col("chars")).alias("end"), (F.col("turn") % 3).alias("key"))
    return sections.choose_titles(t, "conv_id", "turn").select("conv_id", "turn", "chosen")


@query(
    "running_lines",
    r"""
with l as (select source, doc_id, trim(regexp_replace(translate(regexp_replace(unnest(string_split(text, chr(10))), '[0-9]+(\s[0-9]+)*', '#', 'g'), '"''`“”‘’„«»', ''), '[\s|·•—–-]+', ' ', 'g')) k from documents),
p as (select source, count(*) pages from documents group by source)
select l.source, lower(k) as key, count(*) n from l join p on p.source = l.source where k <> '' group by l.source, lower(k), pages having count(*) >= greatest(3, ceil(pages * 0.02))
""",
)
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a book, a document a page."""
    d = _t(spark, sf_dir, "documents")
    lines = d.select("source", F.explode(F.split("text", "\n")).alias("line"))
    return sections.running_lines(lines, "source", "line", d.groupBy("source").agg(F.count("*").alias("pages")))


@query(
    "numbered_lines",
    """
with t as (select l_orderkey // 20 book, l_orderkey page, cast(l_quantity as bigint) number from lineitem),
s as (select *, page - number shift from t)
select book, page, number, (select count(distinct q.page) from s q where q.book = s.book and q.shift = s.shift and q.page between s.page - 8 and s.page + 8) >= 3 running from s
""",
)
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E06."""
    t = _t(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 20).cast("long").alias("book"), F.col("l_orderkey").alias("page"), F.col("l_quantity").cast("long").alias("number"))
    return sections.numbered_lines(t, "book", "page", "number").select("book", "page", "number", "running")


@query("upper_median", "select p_brand, (list_sort(list(p_retailprice)))[count(*) // 2 + 1] median from part group by p_brand")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14."""
    return sections.upper_medians(_t(spark, sf_dir, "part"), "p_brand", "p_retailprice")


@query("near_equal_cuts")
def near_equal_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are the places, user turns rank first."""
    s = sections.section_offsets(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    total = F.sum("chars").over(Window.partitionBy("conv_id"))
    places = s.select("conv_id", F.col("turn").cast("long").alias("ord"), F.col("start").alias("position"), F.when(F.col("role") == "user", 0).otherwise(1).alias("rank"), total.alias("total"))
    return sections.near_equal_cuts(places, "conv_id", 1500)


# -- text and HTML -----------------------------------------------------------------------------------------------


@query(
    "paragraph_blocks",
    r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) ord from documents),
f as (select doc_id, count(*) filter (trim(line) <> '') lines, count(*) filter (trim(line) <> '' and length(line) > 50 and length(line) < 100) longish from l group by doc_id)
select l.doc_id, ord::int ord, case when length(trim(line)) < 80 and not regexp_matches(trim(line), '[.,;:]$') and (regexp_matches(trim(line), '(?i)^(chapter|part|book|prologue|epilogue|section)\b')
    or (regexp_matches(trim(line), '^[A-Z0-9 .,''"!?:;-]+$') and regexp_matches(trim(line), '[A-Z]{2}'))) then 'h2' else 'p' end kind, length(trim(line)) chars,
  lines > 20 and longish / lines > 0.5 hard_wrapped from l join f on f.doc_id = l.doc_id where trim(line) <> ''
""",
)
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a block, and whether its document is hard-wrapped."""
    return documents.text_blocks(_t(spark, sf_dir, "documents"), "doc_id", "text")


_MARKED = "m as (select doc_id, coalesce(text, '') || chr(10) || case doc_id % 3 when 0 then ' * * *' when 1 then '•' else '• • •' end || chr(10) || 'end' as text from documents)"


@query("scene_breaks", rf"with {_MARKED}, l as (select doc_id, unnest(string_split(text, chr(10))) line from m) select doc_id, count(*) n from l where regexp_matches(trim(line), '^(?:[*#~⁂]\s*)+$') or regexp_matches(trim(line), '^(?:[•·]\s*){{3,}}$') group by doc_id")
def scene_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are only a mark; every document gets a last line with one, or with a bullet."""
    mark = F.when(F.col("doc_id") % 3 == 0, " * * *").when(F.col("doc_id") % 3 == 1, "•").otherwise("• • •")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), mark, F.lit("\nend"))
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(text, "\n")).alias("line"))
    return lines.where(keys.is_scene_break(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


_CREDITED = "d as (select doc_id, case doc_id % 4 when 0 then 'Scanned & proofed by ' || source when 1 then 'Translated by ' || source when 2 then 'Get it at libgen' else '- Re-formatted by X' end || chr(10) || coalesce(text, '') as text from documents)"


@query(
    "credit_lines_first20",
    rf"""
with {_CREDITED}, l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) ord from d),
n as (select *, row_number() over (partition by doc_id order by ord) n, trim(regexp_replace(line, '\s+', ' ', 'g')) t from l where trim(line) <> '')
select doc_id, n, length(t) chars from n where n <= 20 and length(t) < 200 and (regexp_matches(t, '(?i)^[\p{{P}}\p{{S}}\s]*{keys._CREDIT}(?:\s*(?:,|&|\+|/|\band\b)\s*(?:and\s+)?{keys._CREDIT})*\s+by\b') or regexp_matches(t, '(?i){keys.CREDIT_SITES}'))
""",
)
def credit_lines_first20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit lines among the first 20 paragraphs; every document gets a line in front that is one or looks like one."""
    four = F.col("doc_id") % 4
    line = F.when(four == 0, F.concat(F.lit("Scanned & proofed by "), "source")).when(four == 1, F.concat(F.lit("Translated by "), "source")).when(four == 2, "Get it at libgen").otherwise("- Re-formatted by X")
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(line, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return documents.early_lines(docs, "doc_id", "text")


@query("site_mark_strip", r"select page_id, length(regexp_replace(url, '(?i)(?:https?://)?(?:www\.)?example\.com\b/?', '', 'g')) chars from pages")
def site_mark_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a site taken out of addresses, which hold no white space."""
    return _t(spark, sf_dir, "pages").select("page_id", F.length(keys.strip_site_marks(F.col("url"), "example.com")).alias("chars"))


@query(
    "hyphen_join",
    r"""
with l as (select p_partkey, 'a ' || split_part(p_name, ' ', 1) || case when p_partkey % 2 = 0 then '-' else '' end a, case when p_partkey % 3 = 0 then upper(split_part(p_name, ' ', 2)) else split_part(p_name, ' ', 2) end b from part),
w as (select *, regexp_extract(a, '(\S+?)-$', 1) word from l)
select p_partkey, case when word <> '' then case when regexp_matches(word, '\d$') or not regexp_matches(b, '^[a-z]') or word in ({prefixes}) then a || b else left(a, length(a) - 1) || b end end joined from w
""".replace("{prefixes}", ", ".join(f"'{p}'" for p in keys.COMPOUND_PREFIXES)),
)
def hyphen_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I19."""
    w = lambda i: F.coalesce(F.get(F.split("p_name", " "), F.lit(i)), F.lit(""))
    a = F.concat(F.lit("a "), w(0), F.when(F.col("p_partkey") % 2 == 0, "-").otherwise(""))
    b = F.when(F.col("p_partkey") % 3 == 0, F.upper(w(1))).otherwise(w(1))
    return _t(spark, sf_dir, "part").select("p_partkey", keys.join_hyphenated(a, b).alias("joined"))


@query("html_links", "select page_id, h.href, count(*) n from (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) href from pages) h group by page_id, h.href")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets of pages, as written."""
    links = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("html_text_extract")
def html_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of allowed elements with collapsed text."""
    return documents.html_blocks(_t(spark, sf_dir, "pages"), "page_id", "html")


# -- positions and sync ------------------------------------------------------------------------------------------


@query("word_diff")
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J29, J31 over each turn and the next one of its conversation."""
    c = _t(spark, sf_dir, "conversations").withColumn("after", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("after is not null")
    return positions.diff_columns(c, "text", "after").select("conv_id", "turn", "changes", "shift")


@query("place_move")
def place_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a conversation follow into a version without its first turn."""
    c = _t(spark, sf_dir, "conversations")
    old = c.select(F.col("conv_id").alias("book"), F.col("turn").alias("section"), "text")
    new = c.where("turn > 0").select(F.col("conv_id").alias("book"), (F.col("turn") - 1).alias("section"), "text")
    places = c.select(F.col("conv_id").alias("book"), F.col("turn").alias("section"), F.floor(F.length("text") / 2).cast("long").alias("offset"))
    return positions.move_places(places, old, new)


@query(
    "patch_replay",
    """select conv_id book, turn fix_id, true applied, 0 to_section, turn place from conversations where turn % 2 = 1""",
)
def patch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each second turn is fixed, and fixes are replayed in order on the conversation, by their neighbours."""
    c = _t(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    paragraphs = c.select(F.col("conv_id").alias("book"), F.lit(0).alias("section"), F.col("turn").alias("ord"), "text")
    near = c.withColumns({"before": F.coalesce(F.lag("text").over(w), F.lit("")), "after": F.coalesce(F.lead("text").over(w), F.lit(""))}).where("turn % 2 = 1")
    fixes = near.select(F.col("conv_id").alias("book"), F.col("turn").alias("fix_id"), F.lit(0).alias("section"), F.col("turn").alias("at"), F.array("text").alias("old_text"), F.array(F.concat(F.lit("Fixed: "), F.col("text"))).alias("new_text"), "before", "after")
    return positions.replay_fixes(paragraphs, fixes)


@query(
    "progress_latest",
    "select user_id, event_type, max(ts) ts, arg_max(event_id, (ts, event_id)) event_id, count(*) writes from events group by user_id, event_type",
)
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L01 without conflicts: one aggregate with a map-side part."""
    return sync.latest_progress(_t(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id")


@query("progress_optimistic")
def progress_optimistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device that has not seen the last write is rejected."""
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("book_id"), "event_id", F.col("ts").cast("timestamp").alias("updated_at"), (F.col("event_id") % 5 == 0).alias("stale"))
    known = F.when(F.col("stale"), F.col("updated_at") - F.expr("interval 2 days"))
    return sync.accept_progress(e.withColumn("known_updated_at", known).drop("stale").withColumn("force", F.col("event_id") % 7 == 0))


@query("progress_status", "select event_id, case when k is null then 'unread' when k >= 0.98 then 'finished' else 'reading' end status from (select event_id, try_cast(json_extract_string(props, '$.k') as double) / 100 k from events)")
def progress_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B02."""
    k = F.get_json_object("props", "$.k").try_cast("double") / 100
    return _t(spark, sf_dir, "events").select("event_id", keys.reading_status(k).alias("status"))


@query(
    "session_windows",
    """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) s from g)
select user_id, min(ts) began, max(ts) last_seen, count(*) requests from s group by user_id, s
""",
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L09 with a gap of 6 hours; the exact expiry, which extends at most hourly, is sync.session_expiry."""
    return sync.sessions(_t(spark, sf_dir, "events"), "user_id", "ts", "6 hours")
