"""Connected components of a link table (D12) by hooking and contraction, all in Spark.

Each round every node hooks onto its smallest smaller neighbour, pointers are doubled, and the links are rewritten
to what their ends now point at; links inside one node and repeats go. The smallest node of a component never
moves, so it is what remains. Rounds are logarithmic in the size of a component. Every round's tables are written
to the shared folder and deleted when the next round stands: nothing is collected, and hot nodes meet only in joins
whose inputs are plain exchanges, which Spark splits when they are skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.operators.staging import release, staged


def _moved(df: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    to = moves.select(F.col("child").alias("_child"), F.col("parent").alias("_parent"))
    return df.join(to, F.col(column) == F.col("_child"), "left").withColumn(column, F.coalesce("_parent", column)).drop("_child", "_parent")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable."""
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = staged(links.where("a <> b").select(*pair).distinct(), "links")
    labels = staged(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("component")), "nodes")
    while not left.isEmpty():
        first = staged(left.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent")), "moves")
        moves = staged(_moved(first, first, "parent"), "moves")
        after = staged(_moved(labels, moves, "component"), "nodes")
        rest = staged(_moved(_moved(left, moves, "a"), moves, "b").where("a <> b").select(*pair).distinct(), "links")
        release(first, moves, labels, left)
        left, labels = rest, after
    return labels
