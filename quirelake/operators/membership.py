"""Memberships of books in series and collections: lists, merges, replacement, names already in use.

A membership has series, book, position, position_end and ord, its place in the order of insertion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import keys
from quirelake.operators.library import latest
from quirelake.operators.staging import staged, tasks_for


def number_label(position: Column, end: Column) -> Column:
    """B07: "3", "1–3" for a range, null without a number. Whole numbers have no point."""
    plain = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.when(position.isNotNull(), F.when(end.isNotNull(), F.concat(plain(position), F.lit("–"), plain(end))).otherwise(plain(position)))


def series_label(name: Column, position: Column, end: Column) -> Column:
    """The name of a series with the book's number in it, if it has one."""
    return F.when(position.isNotNull(), F.concat(name, F.lit(" #"), number_label(position, end))).otherwise(name)


def of_books(members: DataFrame, series: DataFrame) -> DataFrame:
    """Each book's series in the order they were given; a field of a range is null without one."""
    entry = F.struct("ord", "series", "name", "position", "position_end")
    return members.join(series, "series").groupBy("book").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def books_in(members: DataFrame, books: DataFrame) -> DataFrame:
    """Title, author and number of the books of each series."""
    return members.join(books, "book").select("series", "book", "title", "author", "position", "position_end")


def genres_beside(members: DataFrame, books: DataFrame) -> DataFrame:
    """For each book, the genres of the other books of its numbered series, and how many books have each.

    Each exchange has as many partitions as the memberships ask for; the pairs are sent once, by book.
    """
    n = tasks_for(members)
    mine = members.where("position is not null").select("series", F.col("book").alias("mine")).repartition(n, "series").distinct()
    genres = books.where("genre <> ''").select(F.col("book").alias("other"), "genre")
    other = members.select("series", F.col("book").alias("other")).repartition(n, "other").distinct().join(genres, "other").repartition(n, "series")
    pairs = mine.join(other, "series").where("mine <> other").select(F.col("mine").alias("book"), "genre", "other")
    return pairs.repartition(n, "book").distinct().groupBy("book", "genre").agg(F.count("*").alias("n"))


def genre_beside(members: DataFrame, books: DataFrame) -> DataFrame:
    """The genre most of these books have; empty when two genres are as common."""
    led = genres_beside(members, books).groupBy("book").agg(F.sort_array(F.collect_list(F.struct("n", "genre")), asc=False).alias("g"))
    shared = (F.size("g") > 1) & (F.get("g", F.lit(0))["n"] == F.get("g", F.lit(1))["n"])
    return led.select("book", F.when(shared, "").otherwise(F.col("g")[0]["genre"]).alias("genre"))


def unique_entries(entries: DataFrame, owner: str) -> DataFrame:
    """Entries (owner, ord, name, position, position_end) once for each key: first spelling, first place given."""
    e = entries.withColumn("name", keys.clean_series_name(F.col("name"))).withColumn("key", keys.series_key(F.col("name"))).where("key <> ''")
    place = F.struct("position", "position_end")
    out = e.groupBy(owner, "key").agg(F.min_by("name", "ord").alias("name"), F.min_by(place, F.when(F.col("position").isNotNull(), F.col("ord"))).alias("place"), F.min("ord").alias("ord"))
    return out.select(owner, "ord", "key", "name", "place.position", "place.position_end")


def known_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """Names with the spelling in use: of the same key, else of the same loose key, else their own.

    `known` has (name, ord); of several with one key the first counts.
    """
    def by(key: str, of) -> DataFrame:
        return known.withColumn("_key", of(F.col("name"))).where("_key <> ''").groupBy("_key").agg(F.min_by("name", "ord").alias(key))

    clean = keys.clean_series_name(F.col("name"))
    n = names.withColumns({"_exact": keys.series_key(F.col("name")), "_loose": keys.loose_key(F.col("name")), "_clean": clean})
    n = n.join(by("_same", keys.series_key), F.col("_exact") == F.col("_key"), "left").drop("_key")
    n = n.join(by("_like", keys.loose_key), F.col("_loose") == F.col("_key"), "left")
    return n.withColumn("known", F.coalesce("_same", "_like", "_clean")).drop("_key", "_exact", "_loose", "_clean", "_same", "_like")


def set_for_books(members: DataFrame, series: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memberships, series) after the books of entries (book, ord, name, position, position_end) have these alone.

    A name joins the series of its key. New keys get the ids after the largest, in the order of their first entry.
    Series without a member go.
    """
    e = unique_entries(entries, "book")
    have = series.select("series", keys.series_key(F.col("name")).alias("key"))
    new = e.join(have, "key", "left_anti").groupBy("key").agg(F.min_by("name", F.struct("book", "ord")).alias("name"), F.min(F.struct("book", "ord")).alias("at"))
    top = series.agg(F.coalesce(F.max("series"), F.lit(0)).alias("top"))
    new = _numbered(new, "at").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("n")).alias("series"), "name", "key")
    every = have.unionByName(new.select("series", "key"))
    last = members.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last"))
    added = e.join(every, "key").crossJoin(F.broadcast(last)).select("series", "book", "position", "position_end", (F.col("last") + 1 + F.col("ord")).alias("ord"))
    kept = members.join(e.select("book").distinct(), "book", "left_anti").select("series", "book", "position", "position_end", "ord").unionByName(added)
    names = series.select("series", "name").unionByName(new.select("series", "name"))
    return kept, names.join(kept.select("series").distinct(), "series", "left_semi")


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """df with n, 1 and up, for a column that gives an order; sorted in parallel, then numbered by the sizes of the ranges before.

    Ranges are cut by a sample, so the sorted rows are written once: a plan that is read twice may cut them in two ways.
    """
    sorted_ = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).drop(order).withColumn("_m", F.monotonically_increasing_id())
    within = staged(sorted_, "numbered").withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND((1 << 33) - 1) + 1}).drop("_m")
    sizes = within.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return within.join(F.broadcast(before), "_p").withColumn("n", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def merge_series(members: DataFrame, moves: DataFrame) -> DataFrame:
    """Memberships after series `source` of moves went into series `target`.

    Sources go in the order of their ids. A book keeps its place in the target; where it has none there, it takes
    the pair of numbers from the first source that has one.
    """
    m = members.join(moves.select(F.col("source").alias("series"), "target"), "series", "left")
    m = m.withColumn("into", F.coalesce("target", "series")).withColumn("turn", F.when(F.col("target").isNull(), F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("series").cast("long").alias("b"))))
    place = F.min_by(F.struct("position", "position_end"), F.when(F.col("position").isNotNull(), F.col("turn")))
    return m.groupBy(F.col("into").alias("series"), "book").agg(place.alias("p"), F.min_by("ord", "turn").alias("ord")).select("series", "book", "p.position", "p.position_end", "ord")


def merge_removed(removed: DataFrame, moves: DataFrame) -> DataFrame:
    """Removed numbers (series, number) move along; a number removed twice is one row."""
    r = removed.join(moves.select(F.col("source").alias("series"), "target"), "series", "left")
    return r.select(F.coalesce("target", "series").alias("series"), "number").distinct()


def without_series(members: DataFrame, series: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships and series without the series of `gone`; books stay."""
    return members.join(gone, "series", "left_anti"), series.join(gone, "series", "left_anti")


def removed_numbers(removed: DataFrame) -> DataFrame:
    """The numbers removed from each series, lowest first."""
    return removed.groupBy("series").agg(F.array_sort(F.collect_set("number")).alias("numbers"))


def book_ids(members: DataFrame) -> DataFrame:
    """The books of each series, in the order of their ids."""
    return members.groupBy("series").agg(F.sort_array(F.collect_set("book")).alias("books"))


def main_author(df: DataFrame, group: str, author: str, order: str) -> DataFrame:
    """The author most rows of a group have (ties: seen first), "and others" if there are more; empty without one."""
    counts = df.where(F.col(author) != "").groupBy(group, author).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    many = counts.groupBy(group).agg(F.count("*").alias("authors"))
    top = latest(counts, [group], [F.desc("n"), F.col("seen")]).join(many, group)
    named = top.select(group, F.when(F.col("authors") > 1, F.concat(F.col(author), F.lit(" and others"))).otherwise(F.col(author)).alias("main"))
    return df.select(group).distinct().join(named, group, "left").select(group, F.coalesce("main", F.lit("")).alias("author"))


def place_of(position: Column, end: Column) -> Column:
    """A place as struct: none without a number, an end only above the number."""
    return F.when(position.isNotNull(), F.struct(position.alias("position"), F.when(end > position, end).alias("position_end")))


def pick_series(lookups: DataFrame, own: DataFrame, found: DataFrame, listed: DataFrame) -> DataFrame:
    """For each library series (series, name) the catalogue's series that it is, with its score.

    own: (series, title, author, position) of the library's books. found: (series, candidate, ord, name, author) and
    listed: (candidate, title, author, position) what the catalogue has under a lookup. A candidate counts if two
    titles agree, or one with its number and author, or its name and a title or an author. It scores 3 a title, 2 for
    the name and 1 for an author; of equals the first wins. Pairs meet in one series only.
    """
    c = found.join(lookups.select("series", F.col("name").alias("own_name")), "series")
    c = c.join(listed.select("candidate").distinct(), "candidate", "left_semi").withColumn("named", F.coalesce(keys.same_series_name(F.col("name"), F.col("own_name")), F.lit(False)))
    mine = own.select("series", F.struct("title", "author", "position").alias("b")).distinct()
    theirs = listed.select("candidate", F.struct("title", "author", "position").alias("e"))
    pairs = c.select("series", "candidate").join(mine, "series").join(theirs, "candidate")
    same = keys.likeness(F.col("b.title"), F.col("e.title")) >= keys.SAME_TITLE
    by = (F.col("b.author") != "") & (F.col("e.author") != "") & keys.same_author(F.col("b.author"), F.col("e.author"))
    placed = same & by & F.col("b.position").eqNullSafe(F.col("e.position"))
    facts = pairs.groupBy("series", "candidate", "b").agg(F.bool_or(same).alias("title"), F.bool_or(by).alias("by"), F.bool_or(placed).alias("placed"))
    facts = facts.groupBy("series", "candidate").agg(F.count_if("title").alias("titles"), F.bool_or("by").alias("by"), F.bool_or("placed").alias("placed"))
    lead = c.select("series", "candidate", F.col("author").alias("lead")).join(mine, "series").groupBy("series", "candidate").agg(F.bool_or((F.col("b.author") != "") & (F.col("lead") != "") & keys.same_author(F.col("b.author"), F.col("lead"))).alias("led"))
    t = c.join(facts, ["series", "candidate"]).join(lead, ["series", "candidate"]).withColumn("by", F.col("by") | F.coalesce("led", F.lit(False)))
    fits = (F.col("titles") >= 2) | F.col("placed") | (F.col("named") & (F.col("by") | (F.col("titles") > 0)))
    score = 3 * F.col("titles") + F.when(F.col("named"), 2).otherwise(0) + F.when(F.col("by"), 1).otherwise(0)
    return latest(t.where(fits).withColumn("score", score), ["series"], [F.desc("score"), F.col("ord")]).select("series", "candidate", "score")
