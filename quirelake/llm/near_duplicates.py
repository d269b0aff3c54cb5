"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct 5-word shingles. Equal sets become one class first, so copies cost nothing. Each
class has COORDINATES minwise tokens. In each of TREES independent trees the root picks one coordinate, and a node below (a set of classes)
one pair of them, or with a chance of 7 in 9 two pairs, by a hash of its path; a class follows the branches named by
its tokens there. A pair of similarity 0.75 shares one branch a level on average, so rows don't multiply with depth.
The trees together meet a pair in a node of the first level with probability 1 - 0.25**TREES, in one of the second with
1 - 0.44**TREES and in one of the third with 1 - 0.54**TREES at least.

1. Nodes of at most LEAF classes are leaves. All pairs of a leaf are compared on their minwise tokens, and what
   shares SKETCH tokens or more is a candidate. Leaves with the same members are compared once.
2. A larger node is a cluster of near copies, or texts that share a passage. It is cut into tiles that all hold the
   node's smallest class too, so one pass over the node finds a cluster's links. They are confirmed on full sets at
   once, which the first level computes for its candidates in one pass over the texts; classes of one component get
   one label, kept once a class. Pairs of one label need no further comparison: a node whose members have one label is
   done, one that has REST pairs of different labels or fewer is a leaf, and only the others branch again.
3. The full sets of all other candidates are computed in a second pass and written once. Links are confirmed on
   them, and the components of all confirmed links are the groups.

Nodes that are still large at level DEPTH are compared tile by tile, all pairs of tiles. Only ids travel through
the levels; a group of candidates has no more members than its leaf or tile. Nothing is dropped, capped or sampled:
what a pair can miss is the trees' chance and that of sharing fewer than SKETCH of COORDINATES tokens (2e-7).

Null, empty and blank texts have an empty set and link with nothing. A text of 1 to 4 words is one shingle. Texts
are read whole, in slices of whole texts, whatever their length. Rows of the same id are one document: they share
its component. Repeated rows and equal sets are one class; of equals the smallest id names the group, so ties need
no order. Null ids take no part, are their own group and are kept. An empty table gives an empty result; extra
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._kernel import ASCII_LOWER, U, _stream, mix, text_slices, trimmed, window_names, word_names, words
from ._shared import release, staged, table
from .components import components, joined

SHINGLE, PERCENT = 5, 75
COORDINATES, TREES, DEPTH, LEAF = 32, 10, 24, 200
#: Tokens of COORDINATES that a pair must share to be confirmed on full sets.
SKETCH = 10
#: A node of up to WIDE classes is a leaf too, if it has at most WORK pairs of different labels.
WIDE, WORK = 20 * LEAF, 4 * LEAF * LEAF
#: One that has been tiled has lost its clusters' pairs where they are labelled; it may have more.
REST = 100 * LEAF * LEAF
#: Pairs of a leaf that are compared at a time.
BLOCK = 1 << 18
#: Large nodes are labelled anew when there is a new link for so many of their rows.
PRUNE = 50


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle names of each text."""
    start, end, first = words(buf, offs)
    names = word_names(buf, start, end, ASCII_LOWER)
    grams = window_names(names, k)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(mix(window_names(names[a:b], int(b - a)) + U(b - a)) if b > a else np.zeros(0, U))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors, adds = _stream(101, COORDINATES) | U(1), _stream(202, COORDINATES)
    for batch in batches:
        n, f1, f2, sig = [], [], [], []
        for _, _, buf, offs in text_slices(batch.column(1)):
            sets = shingle_sets(buf, offs)
            size = np.array([s.size for s in sets], np.int64)
            full = size > 0
            flat = np.concatenate([*sets, np.zeros(0, U)])
            at = (np.cumsum(size) - size)[full]

            def by_text(ufunc: np.ufunc, x: np.ndarray, full: np.ndarray = full, at: np.ndarray = at) -> np.ndarray:
                out = np.zeros(full.size, U)
                if at.size:
                    out[full] = ufunc.reduceat(x, at)
                return out

            with np.errstate(over="ignore"):
                low = [by_text(np.minimum, (flat * a + b) >> U(32)) for a, b in zip(factors, adds, strict=True)]
                f1.append(mix(by_text(np.add, mix(flat ^ U(0xA5A5A5A5)))).view(np.int64))
                f2.append(mix(by_text(np.add, mix(flat + U(0x5A5A5A5A)))).view(np.int64))
            n.append(size)
            sig.append(np.stack(low, 1).astype(np.uint32).view(np.int32))
        if n:
            flat_sig = np.concatenate(sig).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat_sig.size + 1, COORDINATES, np.int32)), pa.array(flat_sig))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(np.concatenate(f1)), pa.array(np.concatenate(f2)), lists], ["id", "n", "f1", "f2", "sig"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, buf, offs in text_slices(batch.column(1)):
            sets = shingle_sets(buf, offs)
            with np.errstate(over="ignore"):
                f1 = [int(mix(np.add.reduce(mix(s ^ U(0xA5A5A5A5)), keepdims=True)).view(np.int64)[0]) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(f1, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "f1", "grams"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, rest: Callable[[pa.RecordBatch], Iterator]) -> Iterator[tuple[list, bool]]:
    """Rows of equal first `keys` columns together, from sorted batches; None between batches."""
    now, rows = None, []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(keys)]
        for key, row in zip(zip(*cols, strict=True), rest(batch), strict=True):
            if key != now:
                if len(rows) > 1:
                    yield rows
                now, rows = key, []
            rows.append(row)
        yield None
    if len(rows) > 1:
        yield rows


def _near(rows: list[tuple]) -> Iterator[tuple]:
    """From a node's rows (id, f1, label, tokens): groups of members that share tokens across labels, as rows (g, h, id, f1)."""
    sig = np.array([r[3] for r in rows], np.int32)
    _, label, count = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True, return_counts=True)
    own = np.flatnonzero(label != count.argmax()) if count.max() > 1 else np.arange(len(rows))
    if not own.size:
        return
    group = np.arange(len(rows))
    for part in np.array_split(own, -(-own.size * len(rows) // BLOCK)):
        same = np.zeros((part.size, len(rows)), np.int8)
        for c in sig.T:
            same += c[part][:, None] == c[None, :]
        same[label[part][:, None] == label[None, :]] = 0
        a, b = np.nonzero(same >= SKETCH)
        group = joined(len(rows), np.concatenate([part[a], np.arange(len(rows))]), np.concatenate([b, group]))
    order = np.argsort(group, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if part.size > 1:
            members = sorted(rows[i][:2] for i in part)
            name = np.frombuffer(hashlib.blake2b(np.array(members, np.int64).tobytes(), digest_size=16).digest(), np.int64).tolist()
            for i, f in members:
                yield *name, i, f


def _screened(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """Candidate groups of the nodes in rows (path, id, f1), under the labels in sigs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rest(batch: pa.RecordBatch) -> Iterator[tuple]:
            tokens = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1)
            return zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), tokens, strict=True)

        out: list[tuple] = []
        for node in _grouped(batches, 1, rest):
            if node is not None:
                out += _near(node)
            if node is None or len(out) > 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["g", "h", "id", "f1"])

    with_sig = _with(rows.select("path", "id", "f1"), sigs).select("path", "id", "f1", "label", "sig")
    return with_sig.repartition("path").sortWithinPartitions("path", "id", "f1").mapInArrow(trimmed(run), "g bigint, h bigint, id bigint, f1 bigint")


def _compare(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of a candidate group."""
    order = sorted(range(len(ids)), key=lambda i: (sets[i].size, ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    size, label = np.array([s.size for s in sets]), np.arange(len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    by_gram = np.argsort(gram, kind="stable")
    ends = np.cumsum(np.bincount(gram))
    starts = ends - np.bincount(gram)
    at = np.concatenate([[0], np.cumsum(size)])
    links = []
    for i in range(len(sets)):
        open_ = (label != label[i]) & (100 * size[i] >= PERCENT * size) & (np.arange(len(sets)) > i)
        if not open_.any():
            continue
        mine = gram[at[i] : at[i + 1]]
        a, n = starts[mine], ends[mine] - starts[mine]
        places = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[by_gram[places]], minlength=len(sets))
        near = np.flatnonzero(open_ & (100 * both >= PERCENT * (size[i] + size - both)))
        for j in near:
            if label[j] != label[i]:
                links.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links of each group, from rows (g, h, id, grams) sorted by group."""

    def rest(batch: pa.RecordBatch) -> Iterator[tuple]:
        return zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)

    out: list[tuple[int, int]] = []
    for group in _grouped(batches, 2, rest):
        if group is not None:
            out += _compare([r[0] for r in group], [np.frombuffer(r[1], U) for r in group])
        else:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
            out = []
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def _confirmed(screened: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that span the components of each candidate group, on full sets."""
    members = screened.select("g", "h", F.col("id").alias("_id"), F.col("f1").alias("_f")).distinct()
    rows = members.join(sets.hint("merge"), (F.col("_id") == F.col("id")) & (F.col("_f") == F.col("f1"))).select("g", "h", "id", "grams")
    return rows.repartition("g", "h").sortWithinPartitions("g", "h", "id").mapInArrow(trimmed(_verify), "a bigint, b bigint")


def _branches(path: Column, sig: Column) -> Column:
    """The paths a class takes from a node: one pair of coordinates, or two in seven nodes of nine, by a hash of the path."""
    pick = lambda k, n: F.pmod(F.xxhash64(path, F.lit(k)), F.lit(n))
    one = pick(1, COORDINATES)
    at = [F.pmod(one + x, F.lit(COORDINATES)).cast("int") for x in (F.lit(0), 1 + pick(2, 10), 11 + pick(3, 10), 21 + pick(4, COORDINATES - 21))]
    first, second = (F.xxhash64(path, a, F.get(sig, a), b, F.get(sig, b)) for a, b in (at[:2], at[2:]))
    return F.when(pick(5, 9) < 7, F.array(first, second)).otherwise(F.array(first))


def _roots(classes: DataFrame) -> DataFrame:
    coordinate = lambda t: F.pmod(F.xxhash64(F.lit(t).cast("long"), F.lit(1)), F.lit(COORDINATES)).cast("int")
    paths = F.array(*[F.xxhash64(F.lit(t).cast("long"), coordinate(t), F.get(F.col("sig"), coordinate(t))) for t in range(TREES)])
    return classes.select("id", "f1", F.explode(paths).alias("path"))


def _nodes(rows: DataFrame, labelled: bool) -> DataFrame:
    """rows (path, id, f1, label) of nodes with pairs of different labels, with the node's size and number of such pairs."""
    if labelled:
        counts = rows.groupBy("path", "label").agg(F.count("*").alias("n")).groupBy(F.col("path").alias("_p"))
        sizes = counts.agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n").cast("double")).alias("squares"))
        sizes = sizes.select("_p", "size", ((F.col("size") * F.col("size").cast("double") - F.col("squares")) / 2).alias("work"))
    else:
        sizes = rows.groupBy(F.col("path").alias("_p")).agg(F.count("*").alias("size")).withColumn("work", F.col("size") * (F.col("size") - 1.0) / 2)
    return rows.join(sizes.where("work > 0").hint("merge"), F.col("path") == F.col("_p")).drop("_p")


def _with(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with what is known of their classes (_id, _f, ...)."""
    return rows.join(classes.hint("merge"), (F.col("id") == F.col("_id")) & (F.col("f1") == F.col("_f"))).drop("_id", "_f")


def _labelled(sigs: DataFrame, labels: DataFrame) -> DataFrame:
    """Classes under new labels: one row a class, however many nodes it is in."""
    return sigs.join(labels.hint("merge"), F.col("_id") == F.col("node"), "left").select("_id", "_f", F.coalesce("component", "label").alias("label"), "sig")


def _tiles(large: DataFrame) -> DataFrame:
    """The rows of large nodes in tiles of about LEAF classes, each with the node's smallest class as well."""
    reps = large.groupBy(F.col("path").alias("_p")).agg(F.min(F.struct("id", "f1")).alias("rep"), F.ceil(F.count("*") / LEAF).cast("int").alias("tiles"))
    rows = large.join(reps.hint("merge"), F.col("path") == F.col("_p"))
    name = lambda tile: F.xxhash64("rep.id", "rep.f1", "tiles", tile).alias("path")
    own = rows.select(name(F.pmod(F.xxhash64("id", "f1", "rep.id"), F.col("tiles")).cast("int")), "id", "f1")
    again = reps.select("rep", "tiles").distinct().select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    return own.union(again.select(name(F.col("t")), "rep.id", "rep.f1")).distinct()


def _tile_pairs(large: DataFrame) -> DataFrame:
    """The rows of large nodes in all pairs of their tiles: the exact way for nodes that branching does not part."""
    rows = large.withColumn("tiles", F.ceil(F.col("size") / LEAF).cast("int")).withColumn("tile", F.pmod(F.xxhash64("id", "f1"), F.col("tiles")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    return rows.select(F.xxhash64("path", F.least("tile", "t"), F.greatest("tile", "t")).alias("path"), "id", "f1")


def _once(leaves: DataFrame) -> DataFrame:
    """Of leaves with the same members only one; two 64-bit digests tell members apart."""
    digest = [F.bit_xor(F.xxhash64(F.lit(k), "id", "f1")).alias(f"d{k}") for k in (0, 1)]
    nodes = leaves.groupBy("path").agg(F.count("*").alias("n"), *digest).groupBy("n", "d0", "d1").agg(F.min("path").alias("_p"))
    return leaves.join(nodes.select("_p").hint("merge"), F.col("path") == F.col("_p")).drop("_p")


def _descend(rows: DataFrame, sigs: DataFrame, link: Callable[[DataFrame], DataFrame]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Candidate groups that are to be confirmed, and links that are; link() confirms a level's tiles."""
    found, leaves, fresh, labels = [], [], [], None
    known, small = ["path", "id", "f1"], (F.col("size") <= LEAF) | ((F.col("work") <= WORK) & (F.col("size") <= WIDE))
    rest = small | ((F.col("work") <= REST) & (F.col("size") <= WIDE))
    for depth in range(1, DEPTH + 1):
        members = staged(_nodes(rows, labels is not None), "members")
        leaves.append(members.where(small).select(known))
        large = members.where(~small)
        if large.isEmpty():
            break
        if depth == DEPTH:
            leaves.append(_tile_pairs(large))
            break
        if depth & (depth - 1) == 0:  # at levels 1, 2, 4, 8 and so on: a cluster that hides among others is met in a later one
            tiles = staged(_screened(_tiles(large), sigs), "tiles")
            if depth > 1:  # may have members whose full sets the first level did not compute
                found.append(tiles)
            fresh.append(link(tiles))
            if PRUNE * _all(fresh).count() >= large.count():  # fewer links would not spare what it costs to label
                labels, fresh = components(_all(fresh if labels is None else [_links(labels), *fresh])), []
                sigs = staged(_labelled(sigs, labels), "sigs")
                large = staged(_nodes(staged(_with(large.select(known), sigs.drop("sig")), "labelled"), True), "members")
            leaves.append(large.where(rest).select(known))
            large = large.where(~rest)
            if large.isEmpty():
                break
        again = _with(large.select(known), sigs)
        rows = staged(again.select(F.explode(_branches(F.col("path"), F.col("sig"))).alias("path"), "id", "f1", "label"), "paths")
    # leaves of earlier levels have pairs that a later one has linked: all are compared under the last labels
    found.append(staged(_screened(_once(_all(leaves)), sigs), "leaves"))
    return found, [*([] if labels is None else [_links(labels)]), *fresh]


def _links(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of df; ids are integers."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sketches = staged(docs.mapInArrow(trimmed(_sketch), "id bigint, n bigint, f1 bigint, f2 bigint, sig array<int>"), "sketches")
    full = sketches.where("n > 0 and id is not null")
    classes = staged(full.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), "classes")
    same_id = classes.groupBy("id").count().where("count > 1").isEmpty()
    sigs = classes.select(F.col("id").alias("_id"), F.col("f1").alias("_f"), F.col("id").alias("label"), "sig")

    sets: list[DataFrame] = []

    def gather(screened: list[DataFrame]) -> None:
        ids = _all(screened).select(F.col("id").alias("_id")).distinct()
        if sets:
            ids = ids.join(sets[0].select(F.col("id").alias("_k")).hint("merge"), F.col("_id") == F.col("_k"), "left_anti")
        texts = docs.join(ids.hint("merge"), F.col("id") == F.col("_id"), "left_semi")
        full = texts.mapInArrow(trimmed(_full_sets), "id bigint, f1 bigint, grams binary")
        sets.append(staged(full.groupBy("id", "f1").agg(F.first("grams").alias("grams")), "sets"))

    def link(tiles: DataFrame) -> DataFrame:
        if not sets:
            gather([tiles])
        return staged(_confirmed(tiles, sets[0]), "pairs")

    screened, links = _descend(_roots(classes), sigs, link)
    gather(screened)
    labels = components(staged(_all([*links, _confirmed(_all(screened), _all(sets))]), "pairs"))
    of_class = staged(classes.join(labels, F.col("id") == F.col("node"), "left").select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.col("n").alias("_s"), F.coalesce("component", "id").alias("component")), "components")
    release(classes, *sets, *screened)
    out = sketches.select("id", "n", "f1", "f2").join(of_class, (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & (F.col("n") == F.col("_s")), "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    if not same_id:
        lowest = out.groupBy(F.col("id").alias("_id")).agg(F.min("component_id").alias("_c"))
        out = out.join(staged(lowest, "ids"), F.col("id") == F.col("_id"), "left").withColumn("component_id", F.coalesce("_c", "component_id")).drop("_id", "_c")
    return out


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without near duplicates: of each group the row of the smallest id stays, and rows without an id."""
    from pyspark.sql import Window

    found = groups(df, key, text)
    gone = staged(found.where("id <> component_id").select(F.col("id").alias("__quirelake_id")).distinct(), "gone")
    left = df.join(gone, F.col(f"`{key}`") == F.col("__quirelake_id"), "left_anti")
    repeated = found.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
    if repeated:
        return left
    rank = F.row_number().over(Window.partitionBy(F.col(f"`{key}`")).orderBy(F.xxhash64(F.col(f"`{text}`"))))
    return left.withColumn("__quirelake_rank", rank).where(F.col(f"`{key}`").isNull() | (F.col("__quirelake_rank") == 1)).drop("__quirelake_rank")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and its group."""
    out = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = rf"""
with recursive t as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
g as (select distinct r, doc_id, g from (
      select r, doc_id, unnest(case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) end) g from t)),
n as (select r, count(*) n from g group by r),
p as (select a.r ra, b.r rb, count(*) shared from g a join g b on a.g = b.g and a.r < b.r group by all),
e as (select x.doc_id a, y.doc_id b from p join n na on na.r = ra join n nb on nb.r = rb join t x on x.r = ra join t y on y.r = rb
      where 100 * shared >= {PERCENT} * (na.n + nb.n - shared)),
both_ways as (select a, b from e union select b, a from e),
reach(a, b) as (select distinct doc_id, doc_id from t union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
c as (select a, min(b) component_id from reach group by a)
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept
from t left join n using (r) join c on c.a = doc_id
"""
