"""What the corpus operators share: the cluster's shared folder, folds, column helpers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.staging import release, shared_dir, staged  # noqa: F401

#: Spark and DuckDB write the same class of characters differently; these are Java regexes.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def ascii_lower(text: Column) -> Column:
    """Only A-Z are lower-cased."""
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def appended(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with new columns; columns of the same name (any case) are replaced."""
    low = {k.lower() for k in new}
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() not in low]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new.values()], [*(batch.schema.names[i] for i in keep), *new])


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns whose names the operator gives itself (any case)."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
