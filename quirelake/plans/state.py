"""Registered queries on memberships, state changes and what users send."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import keys
from quirelake.operators import edits, library, membership
from quirelake.operators.staging import tasks_for
from quirelake.plans.queries import _t, query

_SHELF = """shelf as (select l_orderkey series, l_partkey book, case when min(l_quantity) < 40 then cast(min(l_linenumber) as double) end as position,
  case when min(l_quantity) < 10 then cast(min(l_linenumber) + 2 as double) end position_end, min(l_linenumber) * 10000000 + l_partkey ord from lineitem group by l_orderkey, l_partkey)"""
_SERIES = "named as (select o_orderkey series, o_orderpriority || ' ' || (o_orderkey % 300) as name from orders)"
_BOOKS = "books as (select p_partkey book, p_name title, p_brand author, case when p_size < 5 then '' else p_type end genre from part)"


def _shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as memberships: the order is the series, the part the book."""
    n, q = F.min("l_linenumber"), F.min("l_quantity")
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_partkey").alias("book"), "l_linenumber", "l_quantity")
    return lines.repartition(tasks_for(lines), "series").groupBy("series", "book").agg(F.when(q < 40, n.cast("double")).alias("position"), F.when(q < 10, (n + 2).cast("double")).alias("position_end"), (n * 10_000_000 + F.col("book")).alias("ord"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("o_orderpriority", F.lit(" "), (F.col("o_orderkey") % 300).cast("string"))
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("series"), name.alias("name"))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    genre = F.when(F.col("p_size") < 5, "").otherwise(F.col("p_type"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), genre.alias("genre"))


def _text(values: Column) -> Column:
    """An array of values as text, to compare it as one value."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


# -- joins ---------------------------------------------------------------------------------------------------------


@query(
    "series_of_books",
    f"""with {_SHELF}, {_SERIES}
select book, string_agg(case when position is null then name else name || ' #' || cast(position as int) || coalesce('–' || cast(position_end as int), '') end, '; ' order by ord, series) as series
from shelf join named using (series) group by book""",
)
def series_of_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's series as shown, in the order they were given."""
    found = membership.of_books(_shelf(spark, sf_dir), _series(spark, sf_dir))
    return found.select("book", F.array_join(F.transform("entries", lambda e: membership.series_label(e["name"], e["position"], e["position_end"])), "; ").alias("series"))


@query("books_in_series", f"with {_SHELF}, {_BOOKS} select series, book, title, author, position, position_end from shelf join books using (book)")
def books_in_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C05."""
    return membership.books_in(_shelf(spark, sf_dir), _books(spark, sf_dir))


@query(
    "genre_beside",
    f"""with {_SHELF}, {_BOOKS},
n as (select mine.book, genre, count(distinct other.book) n from shelf mine join shelf other on other.series = mine.series and other.book <> mine.book
      join books b on b.book = other.book where mine.position is not null and genre <> '' group by 1, 2),
t as (select book, max(n) n from n group by 1)
select book, case when count(*) = 1 then min(genre) else '' end genre from n join t using (book, n) group by book""",
)
def genre_beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genre of the other books in the numbered series that a book is in."""
    return membership.genre_beside(_shelf(spark, sf_dir), _books(spark, sf_dir))


@query("orders_with_names", "select o_orderkey, c_name, o_orderdate from orders left join customer on c_custkey = o_custkey")
def orders_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the name of who made them, newest first; the name is null for users who are gone."""
    users = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    out = _t(spark, sf_dir, "orders").join(users, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("o_orderkey", "c_name", "o_orderdate").orderBy(F.desc("o_orderkey"))


@query("settings_with_names", "select n_nationkey, n_name, r_name from nation left join region on r_regionkey = n_regionkey")
def settings_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings and who changed them."""
    who = F.broadcast(_t(spark, sf_dir, "region"))  # five rows
    return _t(spark, sf_dir, "nation").join(who, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("n_nationkey", "n_name", "r_name")


@query("session_users", "select event_id, c_name, c_mktsegment = 'MACHINERY' is_admin from events join customer on c_custkey = user_id")
def session_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their user; a session of no user is none."""
    users = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", (F.col("c_mktsegment") == "MACHINERY").alias("is_admin"))
    return _t(spark, sf_dir, "events").join(users, "user_id").select("event_id", "c_name", "is_admin")


@query("user_counts", "select count(*) users, count(*) filter (c_mktsegment = 'MACHINERY') admins from customer")
def user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01."""
    return _t(spark, sf_dir, "customer").agg(F.count("*").alias("users"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("admins"))


@query("book_ids_by_series", f"with {_SHELF} select series, string_agg(cast(book as varchar), ',' order by book) books from (select distinct series, book from shelf) group by series")
def book_ids_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C28."""
    return membership.book_ids(_shelf(spark, sf_dir)).select("series", _text(F.col("books")).alias("books"))


@query(
    "book_with_file",
    "select sha256(text) sha256, arg_min(doc_id, doc_id) doc_id, count(*) copies from documents where text is not null group by 1",
)
def book_with_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first book added with each file."""
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min_by("doc_id", "doc_id").alias("doc_id"), F.count("*").alias("copies"))


# -- series --------------------------------------------------------------------------------------------------------


@query(
    "merge_series",
    f"""with {_SHELF}, {_SERIES},
moves as (select series source, min(series) over (partition by lower(name)) target from named),
m as (select target series, book, source <> target moved, source, position, position_end, ord from shelf join moves on source = series),
p as (select *, row_number() over (partition by series, book order by position is null, moved, source) n, row_number() over (partition by series, book order by moved, source) k from m)
select p.series, p.book, p.position, p.position_end, q.ord from p join p q on q.series = p.series and q.book = p.book and q.k = 1 where p.n = 1""",
)
def merge_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose names have one key become one, that of the smallest id."""
    named = _series(spark, sf_dir).withColumn("key", keys.series_key(F.col("name")))
    first = named.groupBy("key").agg(F.min("series").alias("target"))
    moves = named.join(first, "key").where("series <> target").select(F.col("series").alias("source"), "target")
    return membership.merge_series(_shelf(spark, sf_dir), moves)


@query(
    "merge_removed",
    f"""with {_SERIES}, moves as (select series, min(series) over (partition by lower(name)) target from named)
select distinct target series, l_linenumber number from lineitem join moves on series = l_orderkey where l_returnflag = 'R'""",
)
def merge_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed numbers follow their series."""
    named = _series(spark, sf_dir).withColumn("key", keys.series_key(F.col("name")))
    moves = named.join(named.groupBy("key").agg(F.min("series").alias("target")), "key").where("series <> target").select(F.col("series").alias("source"), "target")
    removed = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("number"))
    return membership.merge_removed(removed, moves)


@query("removed_numbers", "select l_orderkey series, string_agg(distinct cast(l_linenumber as varchar), ',' order by cast(l_linenumber as varchar)) numbers from lineitem where l_returnflag = 'R' group by 1")
def removed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10."""
    removed = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("number"))
    return membership.removed_numbers(removed).select("series", _text(F.col("numbers")).alias("numbers"))


_ENTRIES = """entries as (select p_partkey book, k ord, case k when 0 then upper(p_type) when 1 then p_brand else lower(p_type) || ' ' end as name,
  case when k = 2 then cast(p_size as double) when k = 1 then 7.0 end as position, cast(null as double) position_end from part, range(3) r(k) where p_size > 25)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users gave as the series of large books: one of them twice, in two spellings."""
    p = _t(spark, sf_dir, "part").where("p_size > 25").select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("ord"))
    name = F.when(F.col("ord") == 0, F.upper("p_type")).when(F.col("ord") == 1, F.col("p_brand")).otherwise(F.concat(F.lower("p_type"), F.lit(" ")))
    place = F.when(F.col("ord") == 2, F.col("p_size").cast("double")).when(F.col("ord") == 1, 7.0)
    return p.select(F.col("p_partkey").alias("book"), "ord", name.alias("name"), place.alias("position"), F.lit(None).cast("double").alias("position_end"))


@query(
    "unique_series",
    f"""with {_ENTRIES}, e as (select book, ord, trim(name) as name, lower(trim(name)) as key, position from entries)
select book, key, arg_min(name, ord) as name, min(ord) ord, arg_min(position, ord) filter (position is not null) as position from e group by book, key""",
)
def unique_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first spelling and the first number of each series."""
    return membership.unique_entries(_entries(spark, sf_dir), "book").select("book", "key", "name", "ord", "position")


@query(
    "set_series",
    f"""with {_ENTRIES}, {_SHELF}, {_SERIES},
e as (select book, lower(trim(name)) as key, arg_min(trim(name), ord) as name, min(ord) ord, arg_min(position, ord) filter (position is not null) as position from entries group by 1, 2),
new as (select key, (select max(series) from named) + row_number() over (order by min(row(book, ord))) series, arg_min(name, row(book, ord)) as name from e where key not in (select lower(name) from named) group by key)
select series, book, position, position_end from shelf where book not in (select book from e)
union all select series, book, position, null from e join new using (key)""",
)
def set_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships after large books were given series by name."""
    return membership.set_for_books(_shelf(spark, sf_dir), _series(spark, sf_dir), _entries(spark, sf_dir))[0].select("series", "book", "position", "position_end")


@query(
    "set_series_names",
    f"""with {_ENTRIES}, {_SHELF}, {_SERIES},
e as (select book, lower(trim(name)) as key, arg_min(trim(name), ord) as name, min(ord) ord from entries group by 1, 2),
new as (select key, (select max(series) from named) + row_number() over (order by min(row(book, ord))) series, arg_min(name, row(book, ord)) as name from e where key not in (select lower(name) from named) group by key)
select series, name from named where series in (select series from shelf where book not in (select book from e)) union all select series, name from new""",
)
def set_series_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series that are left, and new ones."""
    return membership.set_for_books(_shelf(spark, sf_dir), _series(spark, sf_dir), _entries(spark, sf_dir))[1]


@query(
    "known_names",
    """with known as (select distinct p_type as name from part), asked as (select distinct case when p_size % 2 = 0 then 'The ' || p_type else lower(p_type) || case when p_size % 3 = 0 then ' series' else '' end end as name from part)
select asked.name, coalesce(known.name, asked.name) known from asked left join known on lower(known.name) = regexp_replace(regexp_replace(lower(asked.name), '^the ', ''), '[ -]series$', '')""",
)
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as the library spells them."""
    part = _t(spark, sf_dir, "part")
    even = F.concat(F.lit("The "), F.col("p_type"))
    odd = F.concat(F.lower("p_type"), F.when(F.col("p_size") % 3 == 0, " series").otherwise(""))
    asked = part.select(F.when(F.col("p_size") % 2 == 0, even).otherwise(odd).alias("name")).distinct()
    return membership.known_names(asked, part.select(F.col("p_type").alias("name"), F.col("p_type").alias("ord")).distinct())


@query(
    "remove_series",
    f"with {_SHELF}, gone as (select o_orderkey series from orders where o_orderstatus = 'F') select series, book, position from shelf where series not in (select series from gone)",
)
def remove_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships after series were dissolved."""
    gone = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("series"))
    return membership.without_series(_shelf(spark, sf_dir), _series(spark, sf_dir), gone)[0].select("series", "book", "position")


@query(
    "main_authors",
    f"""with {_SHELF}, {_BOOKS},
n as (select series, author, count(*) n, min(ord) seen from shelf join books using (book) where author <> 'Brand#1' group by 1, 2),
t as (select *, row_number() over (partition by series order by n desc, seen) k, count(*) over (partition by series) a from n)
select s.series, coalesce(t.author || case when a > 1 then ' and others' else '' end, '') author from (select distinct series from shelf) s left join t on t.series = s.series and k = 1""",
)
def main_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author most books of a series share. One brand stands for books without an author."""
    b = _books(spark, sf_dir).withColumn("author", F.when(F.col("author") == "Brand#1", "").otherwise(F.col("author")))
    return membership.main_author(_shelf(spark, sf_dir).join(b, "book"), "series", "author", "ord")


@query("book_count", f"with {_SHELF} select count(distinct series) series, count(*) books from shelf")
def book_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books among series shown as one."""
    folded = membership.book_ids(_shelf(spark, sf_dir))
    return folded.agg(F.count("*").alias("series"), F.sum(F.size("books")).alias("books"))


# -- state ---------------------------------------------------------------------------------------------------------

_COVERS = """state as (select o_orderkey book, case when o_orderpriority = '1-URGENT' then 'custom' when o_orderpriority = '5-LOW' then 'none' else 'file' end cover_source,
  o_orderstatus = 'F' has_cover, case when o_orderstatus = 'O' then 0 else o_orderkey * 3 end converted_at, case when o_orderkey % 2 = 0 then 0 else o_custkey end cover_edited_at, o_orderkey + 5 added_at,
  'processing' status_, o_totalprice from orders)"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as books with their covers and times."""
    source = F.when(F.col("o_orderpriority") == "1-URGENT", "custom").when(F.col("o_orderpriority") == "5-LOW", "none").otherwise("file")
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("book"), source.alias("cover_source"), (F.col("o_orderstatus") == "F").alias("has_cover"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(F.col("o_orderkey") * 3).alias("converted_at"),
        F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(F.col("o_custkey")).alias("cover_edited_at"), (F.col("o_orderkey") + 5).alias("added_at"), "o_totalprice",
    )


@query(
    "shaped_books",
    f"with {_COVERS} select book, cover_source = 'custom' or (cover_source = 'file' and has_cover) shows_cover, coalesce(nullif(greatest(converted_at, cover_edited_at), 0), added_at) cover_version from state",
)
def shaped_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B01."""
    return _state(spark, sf_dir).withColumns(edits.book_columns()).select("book", "shows_cover", "cover_version")


@query(
    "set_covers",
    f"""with {_COVERS} select book, case when o_totalprice > 250000 then 'custom' else cover_source end cover_source,
case when o_totalprice > 250000 then greatest(book * 2, converted_at + 1, cover_edited_at + 1) else cover_edited_at end cover_edited_at from state""",
)
def set_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K20."""
    books = _state(spark, sf_dir)
    covers = books.where("o_totalprice > 250000").select("book", F.lit("custom").alias("source"), (F.col("book") * 2).alias("now"))
    return edits.set_cover(books, covers).select("book", "cover_source", "cover_edited_at")


@query(
    "visible_books",
    """select p_partkey book from part where contains(lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_type), 'red')
and (case p_partkey % 3 when 0 then 'unread' when 1 then 'finished' else 'reading' end) = 'reading'""",
)
def visible_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search and a filter at once. Parts are read by a rule of their key."""
    third = F.col("p_partkey") % 3
    status = edits.book_status(F.lit("ready"), F.when(third == 1, 1.0).when(third == 2, 0.5))
    books = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.array("p_type").alias("series"), F.col("p_type").alias("genre"), status.alias("status"), F.lit(False).alias("flagged"))
    return edits.visible(books, " RED ", "reading").select("book")


@query(
    "visible_series",
    f"with {_SHELF}, {_BOOKS}, {_SERIES} select series from shelf join books using (book) join named using (series) group by series, name having contains(lower(name || ' ' || string_agg(title || ' ' || author || ' ' || genre, ' ')), 'small ring') ",
)
def visible_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with a member that a search finds."""
    items = F.collect_list(F.struct("title", "author", "genre", F.lit(False).alias("flagged"))).alias("items")
    groups = _shelf(spark, sf_dir).join(_books(spark, sf_dir), "book").join(_series(spark, sf_dir), "series").groupBy("series", "name").agg(items).withColumn("state", F.lit("unread"))
    return edits.visible_series(groups, "small ring").select("series")


_WORK = """work as (select o_orderkey book, case o_orderstatus when 'P' then 'processing' else 'ready' end status, o_custkey % 5 metadata_version,
  case when o_totalprice < 100000 then '' else 'x' end sha256, o_orderdate added_at from orders)"""


@query(
    "work_left",
    f"""with {_WORK} select 'convert' kind, book, row_number() over (order by added_at, book) place from work where status = 'processing'
union all select 'details', book, row_number() over (order by added_at, book) from work where status = 'ready' and metadata_version < 3
union all select 'fingerprint', book, row_number() over (order by added_at, book) from work where sha256 = '' and status <> 'processing'""",
)
def work_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work that is left, numbered in the order in which one worker takes it."""
    status = F.when(F.col("o_orderstatus") == "P", "processing").otherwise("ready")
    sha = F.when(F.col("o_totalprice") < 100000, "").otherwise("x")
    books = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), status.alias("status"), (F.col("o_custkey") % 5).alias("metadata_version"), sha.alias("sha256"), F.col("o_orderdate").alias("added_at"))
    out = None
    for kind, left in edits.to_backfill(books, 3).items():
        numbered = membership._numbered(left.select("book", F.struct("added_at", "book").alias("at")), "at").select(F.lit(kind).alias("kind"), "book", F.col("n").cast("long").alias("place"))
        out = numbered if out is None else out.unionByName(numbered)
    return out


@query(
    "set_genre",
    """select p_partkey book, case when p_brand = 'Brand#7' then 'Crime' else p_type end genre from part""",
)
def set_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A genre for all chosen books: the user may change each of them."""
    books = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), "p_brand", F.col("p_type").alias("genre"))
    chosen = books.where("p_brand = 'Brand#7'").select("book")
    return edits.set_genre(books, chosen, F.col("p_brand") == "Brand#7", "Crime").select("book", "genre")


@query("set_genre_refused", "select p_partkey book, p_type genre from part")
def set_genre_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book that the user may not change refuses the whole change."""
    books = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), "p_brand", "p_size", F.col("p_type").alias("genre"))
    chosen = books.where("p_brand = 'Brand#7'").select("book")
    return edits.set_genre(books, chosen, F.col("p_size") < 40, "Crime").select("book", "genre")


@query(
    "edit_details",
    """with e as (select l_partkey book, max(l_comment_) new_title, max(l_shipdate) "at" from (select l_partkey, l_shipdate, case when l_quantity >= 45 then 'Part ' || l_partkey end l_comment_ from lineitem where l_returnflag = 'R') group by 1)
select p_partkey book, coalesce(new_title, p_name) title, p_brand author, case when new_title is not null then "at" end edited_at from part left join e on book = p_partkey""",
)
def edit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles edited by hand, and when."""
    lines = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    title = F.max(F.when(F.col("l_quantity") >= 45, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))))
    changes = lines.groupBy(F.col("l_partkey").alias("book")).agg(title.alias("new_title"), F.lit(None).cast("string").alias("new_author"), F.max("l_shipdate").alias("at"))
    books = _books(spark, sf_dir).withColumn("edited_at", F.lit(None).cast("timestamp_ntz"))
    out = edits.edit_details(books.withColumn("edited_at", F.col("edited_at").cast(changes.schema["at"].dataType)), changes)
    return out.select("book", "title", "author", "edited_at")


@query(
    "mark_different",
    "select distinct least(l_partkey, l_suppkey) a, greatest(l_partkey, l_suppkey) b from lineitem where l_partkey <> l_suppkey",
)
def mark_different(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in any order, each once."""
    pairs = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return edits.mark_different(pairs.where("a < b"), pairs.where("a > b"))


@query(
    "shifted_places",
    """with c as (select l_orderkey book, l_linenumber section, cast(l_quantity as bigint) start, cast(l_quantity as bigint) + 10 "end", cast(l_discount * 100 as bigint) - 20 delta from lineitem),
p as (select l_orderkey book, l_linenumber + l_suppkey % 2 section, l_partkey % 70 "offset", l_partkey from lineitem)
select p.book, p.section, l_partkey, case when delta is null then "offset" when "offset" >= "end" then greatest(0, "offset" + delta) when "offset" > start then start else "offset" end "offset" from p left join c using (book, section)""",
)
def shifted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of readers after a change in their section."""
    lines = _t(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    changes = lines.select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("section"), q.alias("start"), (q + 10).alias("end"), (F.round(F.col("l_discount") * 100).cast("long") - 20).alias("delta"))
    places = lines.select(F.col("l_orderkey").alias("book"), (F.col("l_linenumber") + F.col("l_suppkey") % 2).cast("int").alias("section"), "l_partkey", (F.col("l_partkey") % 70).alias("offset"))
    return edits.shift_places(places, changes)


@query(
    "places_now",
    """select o_orderkey, case when o_custkey % 3 > 0 and o_custkey % 3 <> o_orderkey % 4 then o_custkey % 7 else o_orderkey % 50 end section,
case when o_custkey % 3 > 0 and o_custkey % 3 <> o_orderkey % 4 then o_custkey % 11 else o_orderkey % 70 end "offset" from orders""",
)
def places_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places sent from another version of the book are found again by their percent."""
    o, key = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    sent = o.select(key, (key % 50).alias("section"), (key % 70).alias("offset"), (F.col("o_custkey") % 3).alias("version"), (key % 4).alias("current"))
    found = o.select(key, (F.col("o_custkey") % 7).alias("now_section"), (F.col("o_custkey") % 11).alias("now_offset"))
    return edits.place_now(sent, found, ["o_orderkey"]).select("o_orderkey", "section", "offset")


@query(
    "renamed_titles",
    """with s as (select conv_id book, turn section, role title from conversations), f as (select book, min(section) "at" from s where title = 'user' group by 1),
x as (select s.book, s.section, s.title, "at", min(s.section) filter (s.title <> 'user' and s.section > "at") over (partition by s.book) stop from s left join f using (book))
select book, section, case when section >= "at" and section < coalesce(stop, 1000000) and title = 'user' then 'Reader' else title end title from x""",
)
def renamed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title changes in its section and those after it that have the same one."""
    s = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("section"), F.col("role").alias("title"))
    first = s.where("title = 'user'").groupBy("book").agg(F.min("section").alias("at"))
    return edits.rename_titles(s, first.select("book", "at", F.lit("user").alias("from"), F.lit("Reader").alias("to"))).select("book", "section", "title")


# -- what users send -----------------------------------------------------------------------------------------------


@query(
    "checked_series",
    """with e as (select p_partkey book, p_type as name, case p_size % 4 when 0 then '' when 1 then cast(p_size as varchar) when 2 then p_size || '-' || (p_size + 2) else 'no. ' || p_size end number from part)
select book, case when number like 'no%' then 'number: ' || name end error, case when number not like 'no%' and number <> '' then cast(split_part(number, '-', 1) as double) end as position,
case when contains(number, '-') then cast(split_part(number, '-', 2) as double) end position_end from e""",
)
def checked_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that users typed, with the number read or what is wrong with it."""
    size = F.col("p_size").cast("string")
    number = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, size).when(F.col("p_size") % 4 == 2, F.concat(size, F.lit("-"), (F.col("p_size") + 2).cast("string"))).otherwise(F.concat(F.lit("no. "), size))
    sent = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("book"), F.array(F.struct(F.col("p_type").alias("name"), number.alias("number")), F.struct(F.lit(" ").alias("name"), F.lit("x").alias("number"))).alias("sent"))
    out = sent.withColumn("c", edits.checked_series(F.col("sent")))
    first = F.get("c.series", F.lit(0))
    return out.select("book", F.col("c.error").alias("error"), first["position"].alias("position"), first["position_end"].alias("position_end"))


@query(
    "checked_fixes",
    r"""with t as (select conv_id, turn, text, case turn % 4 when 0 then text when 1 then '' when 2 then text || chr(7) || ' more' else text || '  ' end after_ from conversations),
w as (select *, trim(regexp_replace(text, '[\t-\r \x{00a0}]+', ' ', 'g')) old, trim(regexp_replace(replace(after_, chr(7), ''), '[\t-\r \x{00a0}]+', ' ', 'g')) new from t)
select conv_id, turn, case when old = '' then 'nothing before' when old = new then 'no change' end error, case when old <> '' and old <> new then new end as fixed from w""",
)
def checked_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of one paragraph."""
    t = F.coalesce("text", F.lit(""))
    four = F.col("turn") % 4
    after = F.when(four == 0, t).when(four == 1, "").when(four == 2, F.concat(t, F.lit("\x07 more"))).otherwise(F.concat(t, F.lit("  ")))
    out = _t(spark, sf_dir, "conversations").where("text is not null").withColumn("c", edits.checked_fix(F.lit(0), F.lit(0), F.array(t), F.array(after)))
    return out.select("conv_id", "turn", F.col("c.error").alias("error"), F.when(F.col("c.error").isNull(), F.coalesce(F.get("c.after", F.lit(0)), F.lit(""))).alias("fixed"))


@query(
    "toggled_selection",
    """with s as (select l_orderkey, list(distinct l_partkey) filter (l_returnflag <> 'N') sel, list(distinct l_partkey) filter (l_linenumber <= 2) ids from lineitem group by 1),
c as (select l_orderkey, coalesce(sel, []) sel, coalesce(ids, []) ids from s)
select l_orderkey, array_to_string(list_sort(case when len(ids) > 0 and len(list_filter(ids, lambda x: not list_contains(sel, x))) = 0 then list_filter(sel, lambda x: not list_contains(ids, x)) else list_distinct(sel || ids) end), ',') selected from c""",
)
def toggled_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection after a press on a series."""
    of = lambda where: F.collect_set(F.when(where, F.col("l_partkey")))
    s = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(of(F.col("l_returnflag") != "N").alias("sel"), of(F.col("l_linenumber") <= 2).alias("ids"))
    return s.select("l_orderkey", _text(edits.toggled(F.col("sel"), F.col("ids"))).alias("selected"))


@query(
    "second_search_only",
    """with s as (select l_orderkey, coalesce(list(l_partkey order by l_linenumber, l_partkey) filter (l_quantity < 25), []) one, coalesce(list(l_partkey order by l_linenumber, l_partkey) filter (l_quantity >= 20), []) two from lineitem group by 1)
select l_orderkey, array_to_string(list_filter(two, lambda x: not list_contains(one, x)), ',') more from (select l_orderkey, one, list_transform(list_sort(list_transform(list_distinct(two), lambda x: {'i': list_position(two, x), 'x': x})), lambda y: y.x) two from s)""",
)
def second_search_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second search adds to a first one, in its order."""
    of = lambda where: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("l_linenumber", "l_partkey")))), lambda x: x["l_partkey"])
    s = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(of(F.col("l_quantity") < 25).alias("one"), of(F.col("l_quantity") >= 20).alias("two"))
    return s.select("l_orderkey", _text(edits.only_second(F.col("one"), F.col("two"))).alias("more"))


@query(
    "merged_details",
    "select o_orderkey, coalesce(nullif(case when o_custkey % 3 = 0 then c_name else '' end, ''), nullif(case when o_custkey % 2 = 0 then o_orderpriority else '' end, ''), o_orderstatus) title from orders left join customer on c_custkey = o_custkey",
)
def merged_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detail edited by hand, else from the package file, else from the book, else from its name."""
    users = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    t = _t(spark, sf_dir, "orders").join(users, F.col("c_custkey") == F.col("o_custkey"), "left")
    t = t.withColumns({"hand": F.when(F.col("o_custkey") % 3 == 0, F.col("c_name")).otherwise(""), "package": F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise("")})
    return t.select("o_orderkey", edits.merged_details("hand", "package", "o_orderstatus").alias("title"))


@query(
    "library_orders",
    """select p_partkey, row_number() over (order by p_retailprice desc, p_size desc, p_partkey) recent, row_number() over (order by p_size desc, p_partkey) added,
row_number() over (order by p_name, p_partkey) title, row_number() over (order by case when p_brand = 'Brand#1' then 1 else 0 end, p_brand, p_name, p_partkey) author from part""",
)
def library_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each book in the four orders of the library, ties by key; no author comes last."""
    books = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("read"), F.col("p_size").alias("added"), F.col("p_name").alias("title"), F.when(F.col("p_brand") == "Brand#1", "").otherwise(F.col("p_brand")).alias("author"))
    out = None
    for name, order in library.orders().items():
        ranked = membership._numbered(books.select("p_partkey", F.struct(*order, F.col("p_partkey")).alias("_at")), "_at").select("p_partkey", F.col("n").cast("long").alias(name))
        out = ranked if out is None else out.join(ranked, "p_partkey")
    return out
