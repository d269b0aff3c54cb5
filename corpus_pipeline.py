"""A training corpus from raw documents: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Null and empty texts are `und` and go in the first stage. An empty table passes through all stages as one. Extra
columns are carried along up to the last stage.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake import ship
from quirelake.llm import bpe_coding, language_id, near_duplicates, repeated_passages, source_mixing
from quirelake.llm._shared import staged, table


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier accepts."""
    ship(spark)
    model = language_id.fit(docs)
    return _columns(language_id.identify(docs, model).where("accepted"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    ship(spark)
    return near_duplicates.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; texts that have none stay as they are."""
    ship(spark)
    out = repeated_passages.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    return _columns(out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, dealt to shards and shuffled inside each."""
    ship(spark)
    return source_mixing.mix(docs, ["doc_id"])


def coding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of what they decode to."""
    ship(spark)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]

    def finish(runs: list[str], decoded: bytes) -> tuple[int, np.ndarray, str]:
        ids = bpe_coding.numbers(runs)
        return len(ids), ids, hashlib.sha256(decoded).hexdigest()

    return bpe_coding.code(docs, finish, fields).drop("text")


STAGES = [
    ("language identification", language_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("repeated-passage removal", substring_stage),
    ("source mixing", mixing_stage),
    ("token coding", coding_stage),
]

#: Trained models and trees of draws have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{k}")
    return docs
