"""Connected components of links between documents or vectors.

Up to ONE_TASK different links are joined in one task, whose memory they bound; more are the library's own affair,
hooked and contracted in Spark. Both give the same labels, and neither brings a link to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.operators import graph

from ._shared import release, staged

#: Links that a task may hold: some 100 MB at most.
ONE_TASK = 1_000_000


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's smallest reachable node over the edges (a, b)."""
    label = np.arange(n)
    while a.size:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [[c.to_numpy() for c in batch.columns] for batch in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *(e[i] for e in ends)]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[joined(nodes.size, at[: a.size], at[a.size :])])], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable."""
    left = staged(links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a <> b").distinct(), "links")
    if left.count() > ONE_TASK:
        out = graph.components(left)
    else:
        out = staged(left.repartition(1).mapInArrow(_in_one_task, "node bigint, component bigint"), "nodes")
    release(left)
    return out
