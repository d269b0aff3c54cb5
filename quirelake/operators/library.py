"""Catalogue operators: status, representative spellings, sections, summaries and orders of a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order (E15, L01 without conflicts)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_counts(users: DataFrame, events: DataFrame, key: str, user_key: str, at: str) -> DataFrame:
    """Rows of users with how many events they have and the last one; zero and null without any."""
    stats = events.groupBy(F.col(user_key).alias(key)).agg(F.count("*").alias("books_started"), F.max(at).alias("last_read"))
    return users.join(stats, key, "left").withColumn("books_started", F.coalesce("books_started", F.lit(0)).cast("long"))


def most_common_spelling(df: DataFrame, group: list[str], name: str, order: str) -> DataFrame:
    """The most frequent spelling; of equals one without a comma, then the one seen first."""
    counts = df.groupBy(*group, name).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return latest(counts, group, [F.desc("n"), F.instr(name, ",") > 0, F.col("first_seen")])


def most_common_key(df: DataFrame, group: list[str], key: str, name: str, order: str) -> DataFrame:
    """The most frequent key (ties: first seen), as most spell it."""
    top = latest(df.groupBy(*group, key).agg(F.count("*").alias("uses"), F.min(order).alias("seen")), group, [F.desc("uses"), F.col("seen")])
    spelled = most_common_spelling(df.join(top.select(*group, key), [*group, key]), [*group, key], name, order)
    return spelled.join(top.select(*group, key, "uses"), [*group, key])


def genre_of_series(members: DataFrame, series: str, book: str, genre: str) -> DataFrame:
    """The genre most books of a series have; empty if two share the lead."""
    counts = members.where(F.col(genre) != "").groupBy(series, genre).agg(F.countDistinct(book).alias("n"))
    best = counts.groupBy(series).agg(F.max("n").alias("top"))
    led = counts.join(best, series).where("n = top").groupBy(series).agg(F.count("*").alias("leaders"), F.min(genre).alias("g"))
    return led.select(series, F.when(F.col("leaders") == 1, F.col("g")).otherwise("").alias("genre"))


def series_summary(members: DataFrame, series: str) -> DataFrame:
    """One row a series from members with status, percent, position, read_at, added_at and title."""
    finished = F.col("status") == "finished"
    out = members.groupBy(series).agg(
        F.count("*").alias("books"),
        F.count_if(finished).alias("finished"),
        F.bool_or(F.col("position").isNotNull()).alias("numbered"),
        F.count_if(F.col("status") != "unread").alias("begun"),
        F.greatest(F.lit(0), F.max("read_at")).alias("last_read"),
        F.max("added_at").alias("last_added"),
        F.round(100 * F.avg(F.when(finished, 1.0).otherwise(F.coalesce("percent", F.lit(0.0)))), 0).cast("long").alias("percent"),
    )
    return out.withColumn("state", F.when(F.col("finished") == F.col("books"), "finished").when(F.col("begun") > 0, "reading").otherwise("unread")).drop("begun")


def readers(progress: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """Readers of each book."""
    return progress.join(users, key, "inner")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key old lacks are added; the first of equal keys stays."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return latest(both, keys, [F.col("_side"), *[F.col(c) for c in rest]]).drop("_side")


def snapshot_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that came and rows that went, with multiplicity."""
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))


def search(df: DataFrame, fields: list[str], query: str) -> DataFrame:
    """The fields, joined and lower-cased, contain the query."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(query.strip().lower())))


def orders() -> dict[str, list[Column]]:
    """Sort keys, all ascending, of the library's four orders over read, added, title and author.

    Titles and authors go by the root collation of Unicode, as in a catalogue; a book without an author comes last.
    """
    by = lambda c: F.collate(F.col(c), "UNICODE")
    newest = lambda c: (-F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return {
        "recent": [newest("read"), newest("added")],
        "added": [newest("added")],
        "title": [by("title")],
        "author": [(F.col("author") == "").cast("int"), by("author"), by("title")],
    }
