"""Documents as blocks: plain text in expressions, and HTML through the cleaner of `markup`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import keys
from quirelake.operators import markup

def html_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """Rows (key, ord, tag, text) of a document's paragraphs."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *x) for k, h in zip(b[key], b[html], strict=True) for i, x in enumerate(markup.paragraphs(markup.normalised(h)))]
            yield pd.DataFrame(rows, columns=[key, "ord", "tag", "text"])

    return df.select(key, html).mapInPandas(run, f"{key} {kind}, ord int, tag string, text string")


def text_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, ord, kind, chars, hard_wrapped), a block a line with text.

    The wrap ratio is worked out inside the row, so nothing is shuffled.
    """
    lines = F.split(text, "\n")
    full = F.filter("_lines", lambda x: F.trim(x) != "")
    longish = F.size(F.filter(full, lambda x: (F.length(x) > 50) & (F.length(x) < 100)))
    t = df.select(key, lines.alias("_lines")).withColumn("hard_wrapped", (F.size(full) > 20) & (longish / F.size(full) > 0.5))
    t = t.select(key, "hard_wrapped", F.posexplode("_lines").alias("p", "line")).withColumn("t", F.trim("line")).where("t <> ''")
    x = F.col("t")
    named = x.rlike(r"(?i)^(chapter|part|book|prologue|epilogue|section)\b")
    capitals = x.rlike(r"^[A-Z0-9 .,'\"!?:;-]+$") & x.rlike("[A-Z]{2}")
    heading = (F.length(x) < 80) & ~x.rlike(r"[.,;:]$") & (named | capitals)
    return t.select(key, (F.col("p") + 1).cast("int").alias("ord"), F.when(heading, "h2").otherwise("p").alias("kind"), F.length(x).cast("long").alias("chars"), "hard_wrapped")


def early_lines(df: DataFrame, key: str, text: str, reach: int = 20) -> DataFrame:
    """Credit lines among the first `reach` paragraphs of a document."""
    full = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    t = df.select(key, F.posexplode(F.slice(full, 1, reach)).alias("p", "line"))
    return t.where(keys.is_credit_line(F.col("line"))).select(key, (F.col("p") + 1).cast("long").alias("n"), F.length(keys.collapse(F.col("line"))).cast("long").alias("chars"))


def chapter_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks with the number of the chapter they are in; a block that names a chapter starts it."""
    starts = keys.is_chapter_title(F.col("text")).cast("int")
    return blocks.withColumn("chapter", F.sum(starts).over(Window.partitionBy(key).orderBy("ord")))
