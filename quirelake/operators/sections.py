"""Sections of documents: offsets, places, titles, running lines, even cuts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import keys

CHAPTER_MIN = 1000


def section_offsets(df: DataFrame, book: str, section: str, text: str) -> DataFrame:
    """Characters of each section and where it starts in its book."""
    chars = keys.utf16_len(F.coalesce(F.col(text), F.lit(""))).cast("long")
    before = Window.partitionBy(book).orderBy(section).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("chars", chars).withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)))


def place_at_percent(sections: DataFrame, targets: DataFrame, book: str) -> DataFrame:
    """The last section that starts at or before a share of the book, and the characters into it.

    Sections of a book become one sorted array, so each target is one array filter and no range join.
    """
    lists = sections.groupBy(book).agg(F.sort_array(F.collect_list(F.struct("section", "start"))).alias("_s"), F.sum("chars").alias("_total"))
    t = targets.join(lists, book).withColumn("_at", F.least(F.greatest(F.col("percent"), F.lit(0.0)), F.lit(1.0)) * F.col("_total"))
    hit = F.coalesce(F.try_element_at(F.filter("_s", lambda s: s["start"] <= F.col("_at")), F.lit(-1)), F.col("_s")[0])
    t = t.withColumn("_hit", hit)
    offset = F.greatest(F.lit(0), F.floor(F.col("_at") - F.col("_hit.start") + 0.5)).cast("long")
    return t.select(*targets.columns, F.col("_hit.section").alias("section"), offset.alias("offset"))


def carry_title(df: DataFrame, book: str, section: str, title: str) -> DataFrame:
    """The latest title so far."""
    w = Window.partitionBy(book).orderBy(section).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("carried", F.last(title, ignorenulls=True).over(w))


def choose_titles(df: DataFrame, book: str, order: str) -> DataFrame:
    """Titles (at, end, key) that count: enough text follows, and they are no entry of a list of contents."""
    w = Window.partitionBy(book).orderBy(order)
    close = (F.lag("end").over(w) == F.col("at")) & (F.col("at") - F.lag("at").over(w) < CHAPTER_MIN)
    t = df.withColumn("_new", F.when(F.coalesce(close, F.lit(False)), 0).otherwise(1)).withColumn("_c", F.sum("_new").over(w))
    t = t.withColumn("_size", F.count("*").over(Window.partitionBy(book, "_c"))).withColumn("_last", F.max(order).over(Window.partitionBy(book, "key")))
    t = t.withColumn("_ok", (F.col("end") - F.col("at") >= CHAPTER_MIN) & ((F.col("_size") < 3) | (F.col("_last") == F.col(order))))
    by_key = Window.partitionBy(book, "key", "_ok")
    t = t.withColumns({"_times": F.count("*").over(by_key), "_nth": F.row_number().over(by_key.orderBy(order))})
    return t.withColumn("chosen", F.col("_ok") & ((F.col("_times") < 3) | (F.col("_nth") == 1))).drop("_new", "_c", "_size", "_last", "_ok", "_times", "_nth")


def running_lines(df: DataFrame, book: str, line: str, pages: str) -> DataFrame:
    """Keys of lines on max(3, 2 % of a book's pages) pages or more; `pages` has (book, pages)."""
    counts = df.withColumn("key", keys.line_key(F.col(line))).where("key <> ''").groupBy(book, "key").agg(F.count("*").alias("n"))
    return counts.join(pages, book).where(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.02))).drop("pages")


def numbered_lines(df: DataFrame, book: str, page: str, number: str, reach: int = 8) -> DataFrame:
    """Lines whose number keeps step with the page on two more pages close by."""
    t = df.withColumn("shift", F.col(page) - F.col(number))
    w = Window.partitionBy(book, "shift").orderBy(page).rangeBetween(-reach, reach)
    return t.withColumn("running", F.size(F.collect_set(page).over(w)) >= 3)


def upper_median(values: Column) -> Column:
    """The upper of the two middle values of an array; null without one."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def upper_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """D14 over a table: rows are ranked where they are sorted, and no group is held in a row."""
    v = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(group, value)
    sizes = v.groupBy(group).agg((F.floor(F.count("*") / 2) + 1).alias("_middle"))
    ranked = v.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(value)))
    return ranked.join(sizes, group).where("_n = _middle").select(group, F.col(value).alias("median"))


def unique_slugs(df: DataFrame, book: str, slug: str, order: str) -> DataFrame:
    """The second `x` becomes `x-1`."""
    n = F.row_number().over(Window.partitionBy(book, slug).orderBy(order)) - 1
    return df.withColumn("anchor", F.when(n > 0, F.concat_ws("-", slug, n.cast("string"))).otherwise(F.col(slug)))


def cuts(places: list[tuple[int, int]], total: int, budget: int) -> list[int]:
    """Indexes of the places (position, rank) that cut a text into the fewest parts, of nearly equal size.

    For each cut the candidates behind the one before are scored once: in the budget and close to the ideal place
    by rank, else in the budget, else the nearest of all.
    """
    if total <= budget:
        return []
    parts = math.ceil(total / budget)
    size, chosen, behind, start = total / parts, [], 0, 0
    for j in range(1, parts):
        ideal = j * size
        open_ = [(i, p, r) for i, (p, r) in enumerate(places) if i >= start and behind < p < total]
        if not open_:
            break
        fits = [x for x in open_ if x[1] - behind <= budget and total - x[1] <= (parts - j) * budget]
        good = [x for x in fits if abs(x[1] - ideal) <= size / 4]
        away = lambda x: abs(x[1] - ideal)  # noqa: B023, E731
        pick = min(good, key=lambda x: (x[2], away(x), x[0])) if good else min(fits or open_, key=lambda x: (away(x), x[0]))  # noqa: B023
        chosen.append(pick[0])
        behind, start = pick[1], pick[0] + 1
    return chosen


def near_equal_cuts(df: DataFrame, book: str, budget: int) -> DataFrame:
    """E16 over rows (book, ord, position, rank, total): the rows chosen as cuts. Each cut depends on the one before,
    so a book's places, which are few, are folded together."""
    kind = df.schema[book].dataType.simpleString()

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("ord")
        return t.iloc[cuts(list(zip(t["position"], t["rank"], strict=True)), int(t["total"].iloc[0]), budget)][[book, "ord", "position"]]

    return df.groupBy(book).applyInPandas(fold, f"{book} {kind}, ord long, position long")
