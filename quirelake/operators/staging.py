"""Tables written once to the cluster's shared folder, to cut lineage where a plan is read again and again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only one machine (tests) gets a temporary one where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quirelake-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def staged(df: DataFrame, what: str = "table") -> DataFrame:
    """df written once to the shared folder and read back: a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/quirelake-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quirelake_path = path
    return out


def tasks_for(df: DataFrame, task_bytes: int = 1_000_000) -> int:
    """Partitions for df by Spark's estimate of its size, spark.sql.shuffle.partitions at least: tasks stay alike as tables grow.

    A repartition to a number is not merged again, as exchanges that Spark plans are.
    """
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, size // task_bytes) if size < 1 << 50 else least  # beyond it the size is not known


def release(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        at = getattr(df, "_quirelake_path", None)
        if at:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
