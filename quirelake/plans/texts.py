"""Registered queries on contents, pages, keys and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import keys, titles
from quirelake.operators import assembly, markup, outline, sections, styles
from quirelake.plans.queries import _t, query
from quirelake.streaming import sync

_TURNS = """turns as (select conv_id book, turn ord, turn * 7 % 4 depth, turn * 100 "at", (select max(turn) from conversations c where c.conv_id = d.conv_id) * 100 + 100 total, length(text) chars, role, text from conversations d)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as entries of a conversation's contents."""
    c = _t(spark, sf_dir, "conversations")
    total = c.groupBy("conv_id").agg((F.max("turn") * 100 + 100).alias("total"))
    return c.join(total, "conv_id").select(F.col("conv_id").alias("book"), F.col("turn").alias("ord"), (F.col("turn") * 7 % 4).alias("depth"), (F.col("turn") * 100).alias("at"), "total", F.length("text").cast("long").alias("chars"), "role", "text")


@query("contents_tree", f"with {_TURNS} select book, ord, depth, (select max(p.ord) from turns p where p.book = t.book and p.ord < t.ord and p.depth < t.depth) parent from turns t")
def contents_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of entries that come flat with depths."""
    return outline.with_parents(_turns(spark, sf_dir), "book", "ord", "depth").select("book", "ord", "depth", "parent")


@query("contents_extents", f"""with {_TURNS} select book, ord, coalesce((select min(n."at") from turns n where n.book = t.book and n.ord > t.ord and n.depth <= t.depth), total) - t."at" holds from turns t""")
def contents_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E04."""
    return outline.with_extents(_turns(spark, sf_dir), "book", "ord", "depth", "at", "total").select("book", "ord", "holds")


@query(
    "heading_ids",
    f"""with {_TURNS}, h as (select book, ord, ord // 3 section, case when ord % 2 = 0 then 'own' || ord else '' end id from turns where trim(coalesce(text, '')) <> '')
select book, ord, case when id <> '' then id else 'rr' || section || '-h' || (count(*) filter (id = '') over (partition by book, section order by ord)) end anchor from h""",
)
def heading_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12."""
    h = _turns(spark, sf_dir).withColumns({"section": F.floor(F.col("ord") / 3), "id": F.when(F.col("ord") % 2 == 0, F.concat(F.lit("own"), F.col("ord").cast("string"))).otherwise("")})
    return outline.heading_ids(h, "book", "section", "ord", "text", "id").select("book", "ord", "anchor")


@query(
    "contents_of_headings",
    f"""with {_TURNS}, r as (select *, dense_rank() over (partition by book order by depth) k from turns),
p as (select book, ord, k, max(case when k = 1 then ord end) over (partition by book order by ord) top from r where k <= 2)
select book, ord, case when k = 2 then top end parent from p""",
)
def contents_of_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E14, G10."""
    return outline.contents_of_headings(_turns(spark, sf_dir), "book", "ord", "depth").select("book", "ord", "parent")


@query(
    "page_at_offset",
    """with m as (select l_orderkey book, l_linenumber * 40 "at", l_linenumber page from lineitem where l_returnflag <> 'R'),
t as (select o_orderkey book, o_custkey % 300 "offset" from orders)
select book, "offset", coalesce((select max(page) from m where m.book = t.book and m."at" <= "offset"), 1) page from t""",
)
def page_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page shown at a place: the last page mark at or before it."""
    marks = _t(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("book"), (F.col("l_linenumber") * 40).alias("at"), F.col("l_linenumber").alias("value"))
    targets = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), (F.col("o_custkey") % 300).alias("offset"))
    return outline.marker_at(targets, marks, "book", F.lit(1)).withColumnRenamed("value", "page")


@query(
    "section_of_page",
    """with s as (select l_orderkey book, l_linenumber - 1 section, l_linenumber * 10 a, l_linenumber * 10 + l_quantity % 10 b from lineitem),
n as (select book, count(*) n from s group by 1), t as (select o_orderkey book, o_custkey % 90 page from orders)
select t.book, page, coalesce((select min(section) from s where s.book = t.book and page between a and b), greatest(0, least(page - 1, n - 1))) section from t join n on n.book = t.book""",
)
def section_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C23."""
    n = F.col("l_linenumber")
    s = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), (n - 1).alias("section"), (n * 10).alias("page_start"), (n * 10 + F.col("l_quantity") % 10).alias("page_end"))
    t = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), (F.col("o_custkey") % 90).alias("page"))
    return outline.section_of_page(t, s, "book").withColumn("section", F.col("section").cast("long"))


@query("scanned_books", "select l_orderkey book, count(*) pages, count(*) filter (l_returnflag <> 'N') text_pages, 2 * count(*) filter (l_linestatus = 'O') >= count(*) scan from lineitem group by 1")
def scanned_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15."""
    pages = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), (F.col("l_linestatus") == "O").alias("scanned"), (F.col("l_returnflag") != "N").alias("has_text"))
    return outline.page_facts(pages, "book")


@query(
    "line_pitch",
    """with g as (select l_suppkey book, l_orderkey page, l_extendedprice - lag(l_extendedprice) over (partition by l_suppkey, l_orderkey order by l_extendedprice) gap from lineitem),
p as (select book, page, (list_sort(list(gap)))[count(*) // 2 + 1] m from g where gap > 0 group by 1, 2)
select book, (list_sort(list(m)))[count(*) // 2 + 1] pitch from p group by 1""",
)
def line_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D25, D14."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_orderkey").alias("page"), F.col("l_extendedprice").alias("y"))
    return outline.line_pitch(lines, "book", "page", "y")


@query("useful_titles", "select conv_id, turn, case when (select count(distinct role) from conversations c where c.conv_id = d.conv_id) > 1 then role else '' end title from conversations d")
def useful_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D21."""
    return outline.useful_titles(_t(spark, sf_dir, "conversations"), "conv_id", "role").select("conv_id", "turn", "title")


@query(
    "pages_carried_on",
    r"""with t as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) before from conversations)
select conv_id, turn, coalesce(not regexp_matches(rtrim(before), '[.!?:;"”’»)…]$') and regexp_matches(ltrim(text), '^[\p{Ll}]'), false) continues from t""",
)
def pages_carried_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn stands on a page of its own."""
    return outline.carries_on(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "turn", "text").select("conv_id", "turn", "continues")


@query("text_pieces")
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns added up to pieces of more than 2000 characters."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    return outline.pieces_of(c, "conv_id", "turn", "chars")


@query(
    "duplicate_groups",
    """with g as (select sha256(text) file, doc_id, n_chars from documents where text is not null), c as (select file from g group by 1 having count(*) > 1)
select file, string_agg(cast(doc_id as varchar), ',' order by n_chars, doc_id) books from g join c using (file) group by 1""",
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal files, in the order they were added."""
    d = _t(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("file"), "doc_id", "n_chars", "source")
    several = d.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").select("file")
    out = outline.oldest_first(d.join(several, "file", "left_semi"), "file", "n_chars", "doc_id", "source")
    return out.select("file", F.array_join(F.transform("books", lambda b: b.cast("string")), ",").alias("books"))


@query("earlier_covers", "select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber) place from lineitem")
def earlier_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G07."""
    return outline.latest_first(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_shipdate", "l_linenumber").select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query(
    "path_order",
    r"""select page_id, array_to_string(list_transform(regexp_extract_all(lower(url), '[0-9]+|[^0-9]+'), lambda p: case when regexp_matches(p, '^[0-9]') then lpad(regexp_replace(p, '^0+([0-9])', '\1'), 20, '0') else p end), '') as key from pages""",
)
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by which paths sort with numbers by value."""
    return _t(spark, sf_dir, "pages").select("page_id", keys.path_key(F.col("url")).alias("key"))


@query(
    "unique_isbns",
    "with l as (select o_custkey, list('i' || (o_orderkey % 7) order by o_orderkey) a, list(case when o_orderstatus = 'P' then '' else o_orderstatus end order by o_orderkey) b from orders group by 1), u as (select o_custkey, a || b x from l) select o_custkey, array_to_string(list_filter(list_filter(x, lambda y, i: list_position(x, y) = i), lambda y: y <> ''), ' ') isbns from u",
)
def unique_isbns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists as one, without repeats, in their order."""
    def ordered(value):
        return F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", value.alias("v")))), lambda x: x["v"])

    a = F.concat(F.lit("i"), (F.col("o_orderkey") % 7).cast("string"))
    b = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    lists = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(ordered(a).alias("a"), ordered(b).alias("b"))
    return lists.select("o_custkey", F.array_join(outline.unique_in_order(F.col("a"), F.col("b")), " ").alias("isbns"))


@query(
    "percent_of_place",
    "with s as (select conv_id, turn, length(text) chars, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) start, sum(length(text)) over (partition by conv_id) total from conversations where text is not null) select conv_id, turn, round(case when total > 0 then least(greatest((start + least(37, chars)) / total, 0.0), 1.0) else 0.0 end, 9) percent from s",
)
def percent_of_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percent of the 37th character of each turn."""
    from pyspark.sql import Window

    c = sections.section_offsets(_t(spark, sf_dir, "conversations").where("text is not null"), "conv_id", "turn", "text")
    c = c.withColumn("total", F.sum("chars").over(Window.partitionBy("conv_id")))
    return c.select("conv_id", "turn", F.round(outline.percent_of(F.col("start"), F.lit(37), F.col("chars"), F.col("total")), 9).alias("percent"))


# -- keys ----------------------------------------------------------------------------------------------------------


@query("start_keys", r"select conv_id, turn, lower(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+')[1:5], ' ')) as key from conversations")
def start_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five words that a paragraph is known by."""
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", keys.five_words(F.col("text")).alias("key"))


@query("genre_keys", "select p_partkey, lower(p_type || ' ' || replace(p_brand, '#', '-')) as key from part")
def genre_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres with odd spaces, quotes and dashes have the key of the plain spelling."""
    name = F.concat(F.lit("  "), F.col("p_type"), F.lit(" \t "), F.replace("p_brand", F.lit("#"), F.lit("–")), F.lit(" "))
    return _t(spark, sf_dir, "part").select("p_partkey", keys.genre_key(name).alias("key"))


@query(
    "language_tags",
    "select doc_id, case doc_id % 5 when 0 then lang when 1 then lang || '-GB' when 2 then case lang when 'en' then 'en' when 'de' then 'de' when 'fr' then 'fr' when 'es' then 'es' end when 3 then '' else '' end tag from documents where lang is not null",
)
def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags out of codes of two and three letters, with and without a region; `und` and words are none."""
    five = F.col("doc_id") % 5
    long = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "eng", "de", "ger", "fr", "FRA", "es", "spa")]), F.col("lang"))
    said = F.when(five == 0, F.upper("lang")).when(five == 1, F.concat("lang", F.lit("-gb"))).when(five == 2, long).when(five == 3, "und").otherwise("no language")
    return _t(spark, sf_dir, "documents").where("lang is not null").select("doc_id", keys.language_tag(said).alias("tag"))


@query("book_uuids", "select p_partkey, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', cast(('0x' || h[17]) as int) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] uuid from (select p_partkey, sha1('ereader:' || p_partkey) h from part)")
def book_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J35."""
    return _t(spark, sf_dir, "part").select("p_partkey", keys.book_uuid(F.col("p_partkey")).alias("uuid"))


@query("search_texts", r"""select p_partkey, trim(regexp_replace(regexp_replace('by (' || p_name || '): ' || p_brand || '?', '[+\-&|!(){}\[\]^"~*?:\\/]', ' ', 'g'), '\s+', ' ', 'g')) as search from part""")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches without characters of the query language."""
    text = F.concat(F.lit("by ("), "p_name", F.lit("): "), "p_brand", F.lit("?"))
    return _t(spark, sf_dir, "part").select("p_partkey", keys.search_text(text).alias("search"))


@query("public_images", "select page_id, url is not null and starts_with(url, 'https://') ok from pages")
def public_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that pictures may be fetched from; the pages' hosts are all public names."""
    return _t(spark, sf_dir, "pages").select("page_id", keys.public_image_url(F.col("url")).isNotNull().alias("ok"))


@query("valid_names", "select c_custkey, regexp_matches(c_name, '^[a-zA-Z0-9._-]{2,32}$') name_ok, length(c_mktsegment) between 4 and 256 word_ok from customer")
def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J43."""
    return _t(spark, sf_dir, "customer").select("c_custkey", keys.valid_username(F.col("c_name")).alias("name_ok"), keys.valid_password(F.col("c_mktsegment")).alias("word_ok"))


@query("base32_numbers", "select p_partkey, p_partkey n from part")
def base32_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in 32 digits and read again."""
    return _t(spark, sf_dir, "part").select("p_partkey", keys.base32(F.conv(F.col("p_partkey").cast("string"), 10, 32)).alias("n"))


@query(
    "file_details",
    """select p_partkey, case p_partkey % 3 when 0 then upper(p_name[1]) || p_name[2:] else upper(p_name[1]) || p_name[2:] end title, case when p_partkey % 3 = 0 then 'The ' || p_type end series, case when p_partkey % 3 = 0 then cast(p_size as double) end as position from part""",
)
def file_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What file names tell of books without a title: "07 - Series - Title", "07 - Title", "Title (v1)"."""
    title = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", F.lit(2), F.length("p_name")))
    number = F.lpad(F.col("p_size").cast("string"), 2, "0")
    three = F.col("p_partkey") % 3
    name = F.when(three == 0, F.concat(number, F.lit(" - The "), "p_type", F.lit(" - "), title)).when(three == 1, F.concat(number, F.lit(" - "), title)).otherwise(F.concat(F.replace(title, F.lit(" "), F.lit("_")), F.lit(" (v1.2)")))
    d = _t(spark, sf_dir, "part").withColumn("d", titles.file_details(F.concat(F.lit("books/"), name, F.lit(".epub"))))
    return d.select("p_partkey", "d.title", F.col("d.name").alias("series"), "d.position")


@query("title_series", "select p_partkey, p_name title, p_type series, cast(p_size as double) as position from part")
def title_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that titles name in one of five forms."""
    size, form = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("p_") else F.col(p) if isinstance(p, str) else p for p in parts])
    brand = F.col("p_type")
    text = (
        F.when(form == 0, name("p_name", " (", brand, ", Book ", size, ")"))
        .when(form == 1, name("p_name", " [", brand, " Bd. ", size, "]"))
        .when(form == 2, name("p_name", ": Book ", size, " of ", brand))
        .when(form == 3, name("p_name", " - ", brand, ", Bind ", size))
        .otherwise(name(brand, ", Vol. ", size, ": ", "p_name"))
    )
    d = _t(spark, sf_dir, "part").withColumn("d", titles.series_of(text))
    return d.select("p_partkey", "d.title", F.col("d.name").alias("series"), "d.position")


@query("export_names", "select p_partkey, p_brand || '-' || p_name || '.epub' name, replace(p_brand, '#', '#') || '-' || p_name || '.epub' plain from part")
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that books download under; characters that a file name can't hold are spaces."""
    title = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(": "))
    name = titles.export_name(title, F.col("p_brand"))
    return _t(spark, sf_dir, "part").select("p_partkey", name.alias("name"), titles.ascii_name(name).alias("plain"))


@query("settled_writes")
def settled_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of writes of a user in quick succession only the last is sent."""
    return sync.settled(_t(spark, sf_dir, "events"), ["user_id"], "ts", "10 minutes")


# -- HTML ----------------------------------------------------------------------------------------------------------


@query("normalised_pages")
def normalised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cleaned."""
    return markup.normalised_pages(_t(spark, sf_dir, "pages"), "page_id", "html")


@query(
    "page_styles",
    """select page_id, '.sec p{margin-top:' || page_id % 5 || 'em;text-align:center}' || chr(10) || '.sec h1,.sec .x{font-style:italic}' || case when page_id % 2 = 0 then chr(10) || '.sec q{text-indent:1.5em}' else '' end css from pages""",
)
def page_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles made for each page, cut down and put below a section."""
    size = (F.col("page_id") % 5 * 16).cast("string")
    media = F.when(F.col("page_id") % 2 == 0, "@media screen{").otherwise("@media print{")
    css = F.concat(F.lit("/* x */ p { margin-top: "), size, F.lit("px; color: red; text-align:center !important } body{margin-top:1em} h1 , .x,[a]{font-style:italic}"), media, F.lit("q{text-indent:18pt}}"))
    return _t(spark, sf_dir, "pages").select("page_id", styles.scoped(css).alias("css"))


@query("book_sections")
def book_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host as the chapters of a book, cut into sections of 3,000 characters at most."""
    pages = _t(spark, sf_dir, "pages").where("url is not null")
    chapters = pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("book"), F.col("page_id").alias("ord"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("key"), "html", F.lit("").alias("title"), F.lit(False).alias("continues"))
    return assembly.section_table(assembly.assembled(chapters, budget=3000))
