"""quirelake: document-library analytics on Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once an application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        fd, path = tempfile.mkstemp(prefix="quirelake_", suffix=".zip")
        with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
            for folder, _, files in os.walk(top):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("quirelake", os.path.relpath(full, top)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
