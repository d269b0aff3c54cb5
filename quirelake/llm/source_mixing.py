"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Word counts per document, written once to the shared folder; totals per source (partial sums before the
   shuffle, so a hot source costs nothing).
2. Targets: each source's weight share of the wanted total, stopped at 2 times its size, the excess reshared.
3. A source is cut into 2**k blocks by the leading bits of a seeded hash of the document. The target is whole passes
   over all blocks and a rest, whose quota is the number of blocks that the rest is worth. Each pass visits the blocks
   in an affine permutation of its own.
4. The tree: the vector of all sources' quotas is split between the left and the right half of the output shards by a
   multivariate hypergeometric draw, and so on down to one shard; the blocks of the last pass that are not wanted are
   split alike. A shard's zone of a source's permuted blocks is as long as its two counts together and its wanted
   blocks are the first of it. So the tree decides which blocks, hence which documents, are taken, the shards' blocks
   are disjoint, and together they are the quota. Beyond COARSE shards, each shard of the tree deals its blocks to
   shards of its own by a seeded hash.
5. Blocks differ in words. In the order of the tree, wanted blocks first, whole blocks are taken while they fit into
   the rest; of the block after them the documents in hash order while they fit, RUNS times: each run goes on behind
   the document that stopped the one before, with those no larger than what is left. Then the one document more that
   comes nearest.
6. Rows look up their shards with expressions over a one-row-per-source table and are shuffled within a shard by
   a seeded hash. No window or sort ever sees a whole source.

The driver holds one entry per source; more than MAX_SOURCES sources raise an error instead of being dropped.
Null is a source of its own, last in order; a null or empty text has size 0 and adds no words however often it
is drawn; texts are counted whole, whatever their length. Rows with the same id and text are drawn alike; null or
repeated ids with different texts are not. An empty table gives an empty result; extra columns are carried along and
columns named like a result are replaced. Everything depends on the seed and the rows alone, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import WORD, release, staged, table, without

WEIGHTS, TOTAL_PERCENT, MAX_REPEATS = (5, 2, 1), 150, 2
#: Documents per block at least, and the most blocks of one source (a power of two).
BLOCK_DOCS, MAX_BLOCKS, MAX_SOURCES = 64, 65_536, 10_000
#: Runs of documents that are taken from the last block, to come near the target.
RUNS = 5
#: Words of an output shard, if the number of shards is not given, and the shards that the tree itself has.
SHARD_WORDS, COARSE = 4_000_000, 256
_H = "__quirelake_"
NEW = ["size", "source_size", "target", "taken", "draws"]


@dataclass
class Source:
    name: str | None
    docs: int
    size: int
    target: float = 0.0
    bits: int = 0
    passes: int = 0
    whole: int = 0
    runs: list[tuple[int, int, int]] = field(default_factory=list)  # hashes from and to, and the largest size, of documents taken from the block after the whole ones
    extra: int | None = None  # hash of one document more, for what is then left
    bounds: list[int] = field(default_factory=list)  # draws of whole passes before each shard's end
    zones: list[int] = field(default_factory=list)  # where each shard's zone of the last pass starts
    wanted: list[int] = field(default_factory=list)  # blocks that the tree takes from the start of each zone

    @property
    def blocks(self) -> int:
        return 1 << self.bits

    @property
    def quota(self) -> int:
        """Blocks of the last pass that the rest is worth."""
        return min(self.blocks, max(0, round(self.rest / self.size * self.blocks))) if self.size else 0

    @property
    def rest(self) -> float:
        return self.target - self.passes * self.size


def targets(sizes: list[int], weights: list[float], total: float, most: float = MAX_REPEATS) -> list[float]:
    """Weight shares of total; those above `most` times the size stop there and the excess is reshared by weight."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in sorted(over):
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
        open_ -= over
    return out


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts: column sums are the quotas, row sums differ by one at most."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    n = int(quotas.sum())
    draw, chosen, below = n * left // shards, np.zeros_like(quotas), n
    for i, q in enumerate(quotas):  # a multivariate hypergeometric draw, one source after the other
        below -= int(q)
        chosen[i] = rng.hypergeometric(int(q), below, draw) if draw and q else 0
        draw -= int(chosen[i])
    return np.vstack([splitting_tree(chosen, left, rng), splitting_tree(quotas - chosen, shards - left, rng)])


def _odd(seed: int, source: int, turn: int) -> tuple[int, int]:
    rng = np.random.default_rng([seed, source, turn])
    return int(rng.integers(0, MAX_BLOCKS // 2)) * 2 + 1, int(rng.integers(0, MAX_BLOCKS))


def _place(block: Column, bits: Column, factor: Column, shift: Column) -> Column:
    """Where a block stands in a pass: an affine permutation modulo 2**bits."""
    return (block * factor + shift).bitwiseAND(F.call_function("shiftleft", F.lit(1), bits) - 1)


@dataclass
class Plan:
    sources: list[Source]
    sized: DataFrame  # carried columns, size, source, hash
    seed: int
    shards: int


def _before(counts: list[int]) -> list[int]:
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int).tolist() if counts else []


def _source_table(spark: SparkSession, sources: list[Source], seed: int) -> DataFrame:
    rows = []
    for i, s in enumerate(sources):
        odd = [_odd(seed, i, t) for t in range(MAX_REPEATS + 1)]
        left = [b - a - w for a, b, w in zip(s.zones, [*s.zones[1:], s.blocks], s.wanted, strict=True)]
        ahead = [sum(s.wanted) + x for x in _before(left)]
        rows.append((s.name, s.size, float(s.target), s.bits, s.passes, s.whole, s.runs, s.extra, [a for a, _ in odd], [b for _, b in odd], s.bounds, s.zones, s.wanted, _before(s.wanted), ahead))
    schema = "k string, source_size long, target double, bits int, passes int, whole int, runs array<struct<a:bigint,b:bigint,most:bigint>>, extra long, factors array<int>, shifts array<int>, bounds array<long>, zones array<int>, wanted array<int>, first array<int>, ahead array<int>"
    names = [f"{_H}{n}" for n in ("k", "source_size", "target", "bits", "passes", "whole", "runs", "extra", "factors", "shifts", "bounds", "zones", "wanted", "first", "ahead")]
    return spark.createDataFrame(rows, schema).toDF(*names)


def _grow_tree(sources: list[Source], shards: int, seed: int) -> None:
    """Split all quotas over the shards: draws of whole passes, wanted blocks of the last pass, and the others."""
    rng, n = np.random.default_rng(seed), len(sources)
    quotas = np.array([s.passes * s.blocks for s in sources] + [s.quota for s in sources], np.int64)
    counts = splitting_tree(quotas, shards, rng)
    others = splitting_tree(np.array([s.blocks - s.quota for s in sources], np.int64), shards, rng)
    for i, s in enumerate(sources):
        s.bounds = np.cumsum(counts[:, i]).tolist()
        s.wanted = counts[:, n + i].tolist()
        s.zones = _before((counts[:, n + i] + others[:, i]).tolist())


def _hash(key: list[str], text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key], F.col(f"`{text}`"))


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def plan(df: DataFrame, key: list[str], text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, percent: float = TOTAL_PERCENT, shards: int | None = None, seed: int = 42, carry: list[str] | None = None) -> Plan:
    """Sizes, targets, block quotas and the splitting tree. `key` columns identify a document for its hash."""
    spark = df.sparkSession
    h = lambda n: F.col(_H + n)
    sized = df.select(
        *[F.col(f"`{c}`") for c in (carry or [])],
        _size(text).alias(_H + "size"),
        F.col(f"`{source}`").cast("string").alias(_H + "source"),
        _hash(key, text, seed).alias(_H + "hash"),
    )
    sized = staged(sized, "mix")
    rows = sized.groupBy(_H + "source").agg(F.count("*"), F.sum(_H + "size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give coarser source names")
    found = sorted((Source(k, n, size) for k, n, size in rows), key=lambda s: (s.name is None, [ord(c) for c in s.name or ""]))
    total = sum(s.size for s in found) * percent / 100
    for i, (s, t) in enumerate(zip(found, targets([s.size for s in found], [weights[i % len(weights)] for i in range(len(found))], total), strict=True)):
        s.target = t
        s.passes = min(MAX_REPEATS, int(t // s.size)) if s.size else 0
        s.bits = max(0, min(MAX_BLOCKS, s.docs // BLOCK_DOCS).bit_length() - 1)
    shards = shards or max(1, -(-int(total) // SHARD_WORDS))
    if not found:
        return Plan([], sized, seed, shards)
    _grow_tree(found, min(shards, COARSE), seed)
    joined = _joined(sized, found, seed)
    at = _turn()
    blocks = joined.groupBy(h("k"), at.alias("p")).agg(F.sum(h("size")).alias("n"))
    before = F.sum("n").over(_by_source().orderBy("p")) - F.col("n")
    last = blocks.select(h("k"), "p", "n", before.alias("before"))
    of = {s.name: s for s in found}
    rest = spark.createDataFrame([(s.name, s.rest) for s in found], "rk string, rest double")
    over = last.join(rest, F.col(_H + "k").eqNullSafe(F.col("rk"))).where(F.col("before") + F.col("n") > F.col("rest"))
    taken = {s.name: 0 for s in found}
    for s in found:
        s.whole = 1 << s.bits
    for k, place, words in over.groupBy(h("k")).agg(F.min("p"), F.min_by("before", "p")).collect():
        of[k].whole, taken[k] = int(place), int(words)
    part = staged(_joined(sized, found, seed).where((_turn() == h("whole")) & (h("size") > 0)).select(h("k"), h("hash"), h("size")), "mix-rest")
    room, after = {s.name: s.rest - taken[s.name] for s in found}, dict.fromkeys(of, -(2**63))
    kinds = "rk string, room long, after long, runs array<struct<a:bigint,b:bigint,most:bigint>>"

    def open_() -> DataFrame:
        left = spark.createDataFrame([(k, int(v), after[k], of[k].runs) for k, v in room.items()], kinds)
        return part.join(left, F.col(_H + "k").eqNullSafe(F.col("rk")))

    for _ in range(RUNS):
        run = F.sum(h("size")).over(_by_source().orderBy(h("hash")).rangeBetween(-(2**63), 0))
        rows = open_().where((h("hash") > F.col("after")) & (h("size") <= F.col("room"))).withColumn("run", run)
        fits = F.col("run") <= F.col("room")
        for k, last, words, stop in rows.groupBy(h("k")).agg(F.max(F.when(fits, h("hash"))), F.max(F.when(fits, F.col("run"))), F.min(F.when(~fits, h("hash")))).collect():
            if last is not None:
                of[k].runs.append((after[k], int(last), int(room[k])))
                room[k] -= int(words)
            after[k] = 2**63 - 1 if stop is None else int(stop)
    gap = F.abs(F.col("room") - h("size"))
    spare = open_().where(~_in_runs(F.col("runs"), h("hash"), h("size")) & (gap < F.col("room")))
    for k, extra in spare.groupBy(h("k")).agg(F.min_by(h("hash"), F.struct(gap, h("hash")))).collect():
        of[k].extra = int(extra)
    release(part)
    return Plan(found, sized, seed, shards)


def _in_runs(runs: Column, at: Column, size: Column) -> Column:
    return F.exists(runs, lambda r: (at > r["a"]) & (at <= r["b"]) & (size <= r["most"]))


def _by_source():
    from pyspark.sql import Window

    return Window.partitionBy(_H + "k")


def _joined(df: DataFrame, sources: list[Source], seed: int) -> DataFrame:
    """df with its source's row; Spark broadcasts the source table where its size allows, or splits hot sources."""
    t = _source_table(df.sparkSession, sources, seed)
    return df.join(t, F.col(_H + "source").eqNullSafe(F.col(_H + "k")))


def _block() -> Column:
    h = lambda n: F.col(_H + n)
    return F.call_function("shiftrightunsigned", F.shiftrightunsigned(h("hash"), 1), F.lit(63) - h("bits")).cast("int")


def _last_place() -> Column:
    """The block's place in the pass that is taken in part."""
    h = lambda n: F.col(_H + n)
    return _place(_block(), h("bits"), F.get(h("factors"), h("passes")), F.get(h("shifts"), h("passes")))


def _zone() -> Column:
    """The shard whose zone of the last pass has the block."""
    h = lambda n: F.col(_H + n)
    at = _last_place()
    return F.size(F.filter(h("zones"), lambda z: z <= at)) - 1


def _turn() -> Column:
    """When the block's turn is in the last pass: wanted blocks shard by shard, then the others."""
    h = lambda n: F.col(_H + n)

    def turn(zone: Column) -> Column:
        within = _last_place() - F.get(h("zones"), zone)
        return F.when(within < F.get(h("wanted"), zone), F.get(h("first"), zone) + within).otherwise(F.get(h("ahead"), zone) + within - F.get(h("wanted"), zone))

    return F.transform(F.array(_zone()), turn)[0]


def _draws(shards: int, seed: int) -> Column:
    """The shards that take the document, one entry for each time it is taken."""
    h = lambda n: F.col(_H + n)
    each = -(-shards // COARSE)
    fine = lambda shard, turn: (shard * each + F.pmod(F.xxhash64(F.lit(seed), h("k"), _block(), turn), F.lit(each))).cast("int") if each > 1 else shard
    shard = lambda place: F.size(F.filter(h("bounds"), lambda b: b <= place))
    full = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1)), lambda t: t < h("passes")),
        lambda t: fine(shard(F.call_function("shiftleft", F.lit(1), h("bits")) * t + _place(_block(), h("bits"), F.get(h("factors"), t), F.get(h("shifts"), t))), t),
    )
    taken = F.transform(F.array(_turn()), lambda at: (at < h("whole")) | ((at == h("whole")) & (_in_runs(h("runs"), h("hash"), h("size")) | h("hash").eqNullSafe(h("extra")))))[0]
    return F.concat(full, F.when(taken, F.array(fine(_zone(), F.lit(MAX_REPEATS)))).otherwise(F.array().cast("array<int>")))


def drawn(p: Plan, rows: DataFrame) -> DataFrame:
    """rows (with the plan's hidden columns) with size, source_size, target, taken words and draws."""
    out = _joined(rows, p.sources, p.seed).withColumn(_H + "draws", _draws(p.shards, p.seed))
    h = lambda n: F.col(_H + n)
    carried = [c for c in without(rows, NEW).columns if not c.startswith(_H)]
    return out.select(*[F.col(f"`{c}`") for c in carried], h("size").alias("size"), h("source_size").alias("source_size"), h("target").alias("target"), (h("size") * F.size(h("draws"))).alias("taken"), h("draws").alias("draws"), h("hash"))


def mix(df: DataFrame, key: list[str], text: str = "text", source: str = "source", shards: int | None = None, seed: int = 42, **kw) -> DataFrame:
    """The mixed rows of df: a row for each time a document is taken, dealt to shards and shuffled inside them."""
    p = plan(df, key, text, source, shards=shards, seed=seed, **kw)
    cols = df.columns
    if not p.sources:
        return df.limit(0)
    rows = df.select("*", F.col(f"`{source}`").cast("string").alias(_H + "source"), _hash(key, text, seed).alias(_H + "hash"), _size(text).alias(_H + "size"))
    out = _joined(rows, p.sources, seed).withColumn(_H + "draws", _draws(p.shards, seed))
    p.shards = -(-p.shards // COARSE) * min(p.shards, COARSE)
    out = out.select(*[F.col(f"`{c}`") for c in cols], F.col(_H + "hash"), F.posexplode(_H + "draws").alias(_H + "copy", _H + "shard"))
    order = F.xxhash64(F.lit(seed + 1), F.col(_H + "hash"), F.col(_H + "copy"))
    return out.repartitionById(p.shards, F.col(_H + "shard")).sortWithinPartitions(F.col(_H + "shard"), order, *[F.col(f"`{c}`") for c in key]).select(*[F.col(f"`{c}`") for c in cols])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    p = plan(docs, ["doc_id"], carry=["doc_id"])
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string("size long, source_size long, target double, taken long").fields])
    if not p.sources:
        return spark.createDataFrame([], out)
    return drawn(p, p.sized).select(out.names)
