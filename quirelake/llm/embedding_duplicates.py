"""Near-duplicate embeddings through a pivot-permutation index.

Equal vectors become one class first. Reference points (pivots) are a bounded sample of the classes, about twice
the square root of their number, of which none links to another. Each class is described by its NEAREST nearest
pivots, in order, and posted to the inverted lists of all pairs among the first POSTED of them. Within a list the
shared pivots of two classes are counted, and only pairs with SHARED or more of them have their cosine taken, in
double precision. Long lists are cut into tiles of TILE classes, and all pairs of tiles are compared, so no list is
capped and no task grows with a list. A pair in several lists is verified in the first of them.

A tile pair returns, for each of its classes, how many vectors it links to, and links that span its components:
never all pairs. Recall against brute force is measured in the tests (0.9 at least) and stated in the README.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and stay. Vectors of
different lengths never link: each length has pivots and lists of its own, and one list where no sampled vector
has it. Equal cosines need no order; of equal vectors the smallest id stands for the class. Repeated rows count as
vectors of their own. Rows without an id link with nothing. An empty table gives an empty result; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import release, staged, table
from .components import components

THRESHOLD = 0.9
#: Pivots are at most MAX_PIVOTS of 4 times as many sampled classes.
MAX_PIVOTS, NEAREST, POSTED, SHARED, TILE = 1024, 10, 4, 4, 1024
#: Pairs of a tile whose cosines are taken at a time.
PAIRS = 1 << 15


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, flat[start[rows][:, None] + np.arange(n)]


def _apart(units: list[np.ndarray], n: int) -> np.ndarray:
    """The first n that link to none before them: a dense cluster gets one pivot, so its members agree on it."""
    out = np.zeros((0, units[0].size))
    for u in units:
        if len(out) < n and not (out @ u >= THRESHOLD).any():
            out = np.vstack([out, u])
    return out


def _spanning(link: np.ndarray) -> np.ndarray:
    """Each node's smallest reachable node in a symmetric link matrix."""
    label = np.arange(link.shape[0])
    while True:
        low = np.minimum(label, np.where(link, label[None, :], link.shape[0]).min(axis=1, initial=link.shape[0]))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _lists(near: np.ndarray) -> np.ndarray:
    """The lists of each class: one for each pair of its first pivots."""
    first = np.sort(near[:, :POSTED], axis=1).astype(np.int64)
    if first.shape[1] < 2:
        return first
    return np.stack([first[:, a] * MAX_PIVOTS + first[:, b] for a, b in combinations(range(first.shape[1]), 2)], 1)


def _links(near: np.ndarray, raw: np.ndarray, which: int) -> np.ndarray:
    """Verified links among candidates: enough shared pivots, and this list is the first that both are in."""
    n, seen = near.shape[0], np.unique(near)
    hot = np.zeros((n, seen.size), np.float32)
    hot[np.arange(n)[:, None], np.searchsorted(seen, near)] = 1
    a, b = np.nonzero(np.triu(hot @ hot.T >= min(SHARED, near.shape[1]), 1))
    lists, unit, out = _lists(near), _units(raw), np.zeros((n, n), bool)
    for k in range(0, a.size, PAIRS):
        i, j = a[k : k + PAIRS], b[k : k + PAIRS]
        both = (lists[i][:, :, None] == lists[j][:, None, :]).any(axis=2)
        once = np.where(both, lists[i], np.iinfo(np.int64).max).min(axis=1) == which
        i, j = i[once], j[once]
        ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= THRESHOLD
        out[i[ok], j[ok]] = out[j[ok], i[ok]] = True
    return out


def _compare(t: pa.Table) -> pa.Table:
    """Partial link counts and spanning links of one pair of tiles."""
    low, high = t["low"][0].as_py(), t["high"][0].as_py()
    raw = np.frombuffer(b"".join(t["raw"].to_pylist()), np.float32 if t["narrow"][0].as_py() else np.float64).reshape(t.num_rows, -1)
    near = np.frombuffer(b"".join(t["near"].to_pylist()), np.int32).reshape(t.num_rows, -1)
    tile, rep, n = (np.array(t[c].to_pylist(), np.int64) for c in ("tile", "rep", "n"))
    link = _links(near, raw, t["list"][0].as_py())
    if low != high:
        link &= tile[:, None] != tile[None, :]
    added = link @ n
    label = _spanning(link)
    got, joined = np.flatnonzero(added), np.flatnonzero(label != np.arange(label.size))
    a = np.concatenate([rep[got], rep[joined]])
    b = np.concatenate([np.full(got.size, -1), rep[label[joined]]])
    add = np.concatenate([added[got], np.zeros(joined.size, np.int64)])
    kind = np.concatenate([np.zeros(got.size, bool), np.ones(joined.size, bool)])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "add": pa.array(add, pa.int64()), "is_link": pa.array(kind)})


def link_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) for every row."""
    v = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("v", F.when(finite & F.col("id").isNotNull(), F.col("v")))
    classes = staged(v.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    total = classes.count()
    n_pivots = min(MAX_PIVOTS, max(16, int(2 * total**0.5)))
    # a seeded hash draws about 4 times as many classes as pivots; only these come to the driver
    drawn = F.pmod(F.xxhash64("v"), F.lit(max(1, total // (4 * n_pivots))))
    sample = classes.where(drawn == 0).select("v", F.xxhash64("v").alias("h"), "rep").limit(32 * n_pivots).toArrow().sort_by([("h", "ascending"), ("rep", "ascending")])
    pivots = {}
    if sample.num_rows:
        for _, x in _by_length(sample["v"].combine_chunks()):
            pivots[x.shape[1]] = _apart(list(_units(x)), n_pivots)
    narrow = isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    posted_as = "dim int, list long, rep long, n long, near binary, raw binary"

    def describe(batches):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            reps, ns = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for rows, x in _by_length(batch.column(0)):
                p = pivots.get(x.shape[1])
                near = np.argsort(-(_units(x) @ p.T), axis=1, kind="stable")[:, :NEAREST].astype(np.int32) if p is not None else np.zeros((len(rows), 1), np.int32)
                lists = _lists(near)
                each = lists.shape[1]
                raw = [r.tobytes() for r in x.astype(np.float32 if narrow else np.float64)]
                told = [r.tobytes() for r in near]
                again = lambda v, each=each: [y for y in v for _ in range(each)]
                cols = (np.full(lists.size, x.shape[1]), lists.ravel(), np.repeat(reps[rows], each), np.repeat(ns[rows], each), again(told), again(raw))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["dim", "list", "rep", "n", "near", "raw"])

    posted = staged(classes.mapInArrow(describe, posted_as).withColumn("narrow", F.lit(narrow)), "posted")
    tiles = posted.groupBy(F.col("dim").alias("d"), F.col("list").alias("l")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = posted.join(tiles, (F.col("dim") == F.col("d")) & (F.col("list") == F.col("l"))).drop("d", "l")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("rep", "list"), F.col("tiles")).cast("int"))
    rows = rows.select("dim", "list", "rep", "n", "near", "raw", "narrow", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    rows = rows.select("dim", "list", "rep", "n", "near", "raw", "narrow", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    found = staged(rows.groupBy("dim", "list", "low", "high").applyInArrow(_compare, "a long, b long, add long, is_link boolean"), "links")
    degrees = found.where("not is_link").groupBy(F.col("a").alias("r")).agg(F.sum("add").alias("others"))
    labels = components(found.where("is_link").select("a", "b"))
    told = classes.join(degrees, F.col("rep") == F.col("r"), "left").join(labels, F.col("rep") == F.col("node"), "left")
    release(posted)
    told = staged(told.select(F.col("v").alias("_v"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "told")
    out = v.join(told, F.col("v") == F.col("_v"), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))


def op6_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its number of links and its component."""
    out = link_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = f"""
with recursive t as (select row_number() over () r, vec_id, cast(embedding as double[]) e from embeddings),
v as (select r, vec_id, e from t where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.r r, b.r other, a.vec_id a, b.vec_id b from v a join v b on a.r <> b.r and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
d as (select r, count(*) n from p group by r),
reach(a, b) as (select distinct vec_id, vec_id from t union select reach.a, p.b from reach join p on reach.b = p.a),
c as (select a, min(b) component_id from reach group by a)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept from t left join d using (r) join c on c.a = vec_id
"""
