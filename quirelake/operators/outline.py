"""Contents, headings and pages of books as rows: parents, extents, identifiers, markers, and what pages add up to.

Depths are few (MAX_LEVELS at most), so the nearest row of a smaller depth is one window a depth, and no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LEVELS, MAX_CONTENTS, TITLE_CHARS = 6, 2000, 200


def _latest_above(df: DataFrame, book: str, order: str, depth: str) -> Column:
    """The last row before, of any smaller depth, by its order."""
    w = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col(depth) > k, F.last(F.when(F.col(depth) == k, F.col(order)), ignorenulls=True).over(w)) for k in range(MAX_LEVELS)]
    return F.greatest(*last)


def with_parents(df: DataFrame, book: str, order: str, depth: str) -> DataFrame:
    """Entries by depth as a tree: the parent is the latest entry before that is less deep."""
    return df.withColumn("parent", _latest_above(df, book, order, depth))


def with_extents(df: DataFrame, book: str, order: str, depth: str, at: str, total: str) -> DataFrame:
    """How much text an entry holds: up to the next entry that is no deeper, else to the end of the book."""
    w = Window.partitionBy(book).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    nxt = [F.when(F.col(depth) >= k, F.first(F.when(F.col(depth) == k, F.col(at)), ignorenulls=True).over(w)) for k in range(MAX_LEVELS)]
    return df.withColumn("holds", F.coalesce(F.least(*nxt), F.col(total)) - F.col(at))


def heading_ids(df: DataFrame, book: str, section: str, order: str, text: str, name: str) -> DataFrame:
    """Headings with text; those without an id get the section's next number."""
    full = df.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    w = Window.partitionBy(book, section).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count_if(F.coalesce(name, F.lit("")) == "").over(w)
    return full.withColumn("anchor", F.coalesce(F.nullif(F.col(name), F.lit("")), F.concat(F.lit("rr"), F.col(section).cast("string"), F.lit("-h"), n.cast("string"))))


def contents_of_headings(df: DataFrame, book: str, order: str, level: str) -> DataFrame:
    """The two most significant levels of a book's headings; the second under the latest first; at most 2000 of these."""
    ranked = df.withColumn("rank", F.dense_rank().over(Window.partitionBy(book).orderBy(level))).where("rank <= 2")
    w = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = ranked.withColumn("_top", F.last(F.when(F.col("rank") == 1, F.col(order)), ignorenulls=True).over(w))
    t = t.withColumn("parent", F.when((F.col("rank") == 2), F.col("_top"))).withColumn("depth", F.col("parent").isNotNull().cast("int"))
    nth = F.sum(F.when(F.col("depth") == 0, 1).otherwise(0)).over(w)
    return t.withColumn("_nth", nth).where(F.col("_nth") <= MAX_CONTENTS).drop("_top", "_nth", "rank")


def marker_at(targets: DataFrame, markers: DataFrame, book: str, default: Column) -> DataFrame:
    """The last marker (book, at, value) at or before each target's offset, else the default.

    Markers of a book are one sorted array, so a target is one array filter.
    """
    lists = markers.groupBy(book).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("_m"))
    hit = F.try_element_at(F.filter(F.coalesce("_m", F.array().cast(lists.schema["_m"].dataType)), lambda m: m["at"] <= F.col("offset")), F.lit(-1))
    return targets.join(lists, book, "left").withColumn("value", F.coalesce(hit["value"], default)).drop("_m")


def section_of_page(targets: DataFrame, sections: DataFrame, book: str) -> DataFrame:
    """The first section (book, section, page_start, page_end) that has a page, else the page's own number, clamped."""
    spans = sections.groupBy(book).agg(F.sort_array(F.collect_list(F.struct("section", "page_start", "page_end"))).alias("_s"))
    holds = lambda s: (s["page_start"] <= F.col("page")) & (F.col("page") <= s["page_end"])
    hit = F.get(F.filter("_s", holds), F.lit(0))["section"]
    clamped = F.greatest(F.lit(0), F.least(F.col("page") - 1, F.size("_s") - 1))
    return targets.join(spans, book).withColumn("section", F.coalesce(hit, clamped)).drop("_s")


def page_facts(pages: DataFrame, book: str) -> DataFrame:
    """Pages (scanned, has_text) of a book: how many have text, and whether the book is a scan."""
    scanned = F.count_if("scanned")
    return pages.groupBy(book).agg(F.count("*").alias("pages"), F.count_if("has_text").alias("text_pages"), (2 * scanned >= F.count("*")).alias("scan"))


def line_pitch(lines: DataFrame, book: str, page: str, y: str) -> DataFrame:
    """A book's usual distance between lines: the upper median of its pages' upper medians of gaps."""
    from quirelake.operators.sections import upper_medians

    gap = F.abs(F.lag(y).over(Window.partitionBy(book, page).orderBy(y)) - F.col(y))
    gaps = lines.withColumn("_gap", gap).where("_gap > 0").withColumn("_key", F.struct(book, page))
    by_page = upper_medians(gaps, "_key", "_gap").select(F.col(f"_key.{book}").alias(book), F.col("median").cast("double").alias("_median"))
    return upper_medians(by_page, book, "_median").withColumnRenamed("median", "pitch")


def useful_titles(chapters: DataFrame, book: str, title: str) -> DataFrame:
    """Chapter titles, but for books whose chapters all have the same one."""
    n = F.size(F.collect_set(F.nullif(F.col(title), F.lit(""))).over(Window.partitionBy(book)))
    return chapters.withColumn("title", F.when(n > 1, F.col(title)).otherwise(""))


def carries_on(blocks: DataFrame, book: str, order: str, page: str, text: str) -> DataFrame:
    """Whether a page's first block goes on with the sentence that the page before left open."""
    w = Window.partitionBy(book).orderBy(order)
    before, other = F.lag(text).over(w), F.lag(page).over(w) != F.col(page)
    open_ = ~F.rtrim(before).rlike("[.!?:;\"”’»)…]$") & F.ltrim(F.col(text)).rlike(r"^[\p{Ll}]")
    return blocks.withColumn("continues", F.coalesce(other & open_, F.lit(False)))


def pieces_of(df: DataFrame, book: str, order: str, chars: str, least: int = 2000) -> DataFrame:
    """Pieces are added up until they hold more than `least` characters; rows get the number of their run.

    The next run depends on where the one before ended, so a book is one fold over an array of sizes.
    """
    sizes = df.groupBy(book).agg(F.sort_array(F.collect_list(F.struct(order, chars))).alias("_p"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        total = a["sum"] + x[chars]
        full = total > least
        return F.struct((a["n"] + F.when(full, 1).otherwise(0)).alias("n"), F.when(full, 0).otherwise(total).cast("long").alias("sum"), F.concat(a["out"], F.array(a["n"])).alias("out"))

    runs = sizes.withColumn("_r", F.aggregate("_p", zero, step, lambda a: a["out"]))
    rows = runs.select(book, F.explode(F.arrays_zip("_p", "_r")).alias("x"))
    return rows.select(book, F.col(f"x._p.{order}").alias(order), F.col(f"x._p.{chars}").alias(chars), F.col("x._r").alias("run"))


def oldest_first(members: DataFrame, group: str, added: str, id_: str, title: str) -> DataFrame:
    """Duplicate groups with their books oldest first, and the title that the group is sorted by."""
    rows = F.sort_array(F.collect_list(F.struct(added, id_, title)))
    return members.groupBy(group).agg(rows.alias("_b")).select(group, F.transform("_b", lambda b: b[id_]).alias("books"), F.col("_b")[0][title].alias("title"))


def latest_first(files: DataFrame, book: str, time: str, name: str) -> DataFrame:
    """A book's earlier covers, the last put away first, with their place."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(book).orderBy(F.desc(time), F.col(name))))


def unique_in_order(*lists: Column) -> Column:
    """Lists one after the other, without repeats and empty ones."""
    return F.filter(F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), lambda x: x.isNotNull() & (x != ""))


def within_limits(title: Column, entries: Column, limit: int = MAX_CONTENTS) -> tuple[Column, Column]:
    """A heading's text and a list cut to what is kept of them."""
    return F.substring(title, 1, TITLE_CHARS), F.slice(entries, 1, limit)


def percent_of(start: Column, offset: Column, chars: Column, total: Column) -> Column:
    """How far into a book a place is, 0 for an empty book."""
    return F.when(total > 0, F.least(F.greatest((start + F.least(offset, chars)) / total, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
