"""Numbered series: what members hold, what is missing, their order and what comes next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators import resolve

MAX_GAPS = 50


def whole_numbers(position: Column, position_end: Column) -> Column:
    """The whole numbers that a place covers; none for a number such as 2.5."""
    low, high = F.ceil(position).cast("int"), F.floor(F.coalesce(position_end, position)).cast("int")
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def held(places: DataFrame, series: str) -> DataFrame:
    """The distinct numbers that books of a series hold: their own, and all whole ones of a range."""
    p = places.where("position is not null")
    numbers = F.array_union(F.array(F.col("position").cast("double")), whole_numbers(F.col("position"), F.col("position_end")).cast("array<double>"))
    return p.select(series, F.explode(numbers).alias("number")).distinct()


def highest(series: str, places: DataFrame) -> DataFrame:
    """The last number that a series' books reach, 0 at least."""
    return places.groupBy(series).agg(F.greatest(F.lit(0.0), F.coalesce(F.max(F.coalesce("position_end", "position")), F.lit(0.0))).alias("top"))


def gaps(places: DataFrame, series: str, removed: DataFrame | None = None) -> DataFrame:
    """Whole numbers from 1 to below the highest that no book holds. A series with more than 50 has none."""
    top = highest(series, places).withColumn("last", F.ceil("top").cast("int") - 1)
    all_numbers = top.where("last >= 1").select(series, F.explode(F.sequence(F.lit(1), F.col("last")).cast("array<double>")).alias("number"))
    left = all_numbers.join(held(places, series), [series, "number"], "left_anti")
    if removed is not None:
        left = left.join(removed, [series, "number"], "left_anti")
    few = left.groupBy(series).agg(F.count("*").alias("n")).where(F.col("n") <= MAX_GAPS).select(series)
    return left.join(few, series, "left_semi")


def missing(places: DataFrame, listed: DataFrame, series: str, removed: DataFrame, everything: bool = False) -> DataFrame:
    """Listed members not held and not removed; without `everything` those from 1 to below the highest.

    If both inputs have a title, a listed member is also held when a book of the series has the same title.
    """
    if "title" in listed.columns and "title" in places.columns:
        titles = lambda df: df.select(series, F.col("title").alias("id"), "title").distinct()
        same = resolve.similar_titles(titles(listed), titles(places), within=(series,)).select(series, F.col("left_id").alias("title")).distinct()
        listed = listed.join(same, [series, "title"], "left_anti")
    out = listed.join(held(places, series), [series, "number"], "left_anti").join(removed, [series, "number"], "left_anti")
    return out if everything else out.join(highest(series, places), series).where("number >= 1 and number < top").drop("top")


def in_order() -> list[Column]:
    """By the end of a place, a range after what it holds, without a place last, then by title."""
    return [F.coalesce("position_end", "position").asc_nulls_last(), F.coalesce("position", F.lit(0.0)).desc(), F.col("title").asc()]


def next_item(members: DataFrame, series: str) -> DataFrame:
    """The book being read (latest first), else the first unread one after the last finished, else the first.

    Members whose numbers finished ones hold already do not come next.
    """
    w = Window.partitionBy(series)
    m = members.withColumn("ord", F.row_number().over(w.orderBy(*in_order())))
    m = m.withColumn("numbers", F.when(F.col("position").isNull(), F.array().cast("array<int>")).otherwise(whole_numbers(F.col("position"), F.col("position_end"))))
    read = m.where("status = 'finished'").groupBy(series).agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("have"), F.max("ord").alias("done"))
    m = m.join(read, series, "left").withColumns({"done": F.coalesce("done", F.lit(0)), "have": F.coalesce("have", F.array().cast("array<int>"))})
    open_ = (F.col("status") == "unread") & ~((F.size("numbers") > 0) & (F.size(F.array_except("numbers", "have")) == 0))
    kind = F.when(F.col("status") == "reading", 0).when(open_ & (F.col("ord") > F.col("done")), 1).when(open_, 2)
    first = w.orderBy("kind", F.when(F.col("kind") == 0, F.col("read_at")).desc_nulls_last(), "ord")
    verb = F.when(F.col("kind") == 0, "Continue").when(F.col("done") > 0, "Next up").otherwise("Start with")
    return m.withColumn("kind", kind).where("kind is not null").withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("verb", verb)
