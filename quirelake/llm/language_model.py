"""Perplexity scores of an interpolated modified Kneser-Ney n-gram model that is counted in Spark.

Tokens are names (64-bit hashes) of the lower-cased words, with one end token a text; start tokens stand before the
first word. Documents are packed into chunks of bounded size, compressed, by one shuffle that all steps read. The model
of ORDER words is built from the longest n-grams down, one exchange a length:

1. Each chunk sends its distinct n-grams of a length as sorted hash arrays, packed by range of hash. Of the longest it
   sends training counts; of a shorter one, for the longer ones that the chunk owns, how many end in it, and the sum and
   the numbers of ones, twos and more of those that begin with it.
2. A range is the model's part for its hashes: it merges the arrays, keeps sums in the order of the sorted hashes, and
   answers each chunk with the sums of all its n-grams. One of the chunks that have an n-gram owns it. Counts of counts,
   from which the discounts follow, go by way of one chunk to all.
3. Chunks score their texts from the answers to all lengths.

What is gathered is all n-grams of the corpus, and it stays distributed: no task and no driver ever holds the model,
only its own range's or chunk's part, which Arrow hands over as mapped buffers without a copy. A hot word or n-gram is
sent once a chunk. Discounts that counts of counts can't give (tiny corpora) fall back to 0.5, 1 and 1.5.

Null is an empty text: one end token. Very long texts are one piece of a chunk and scored whole. Rows with a null id
are scored and not learned from. Repeated rows count as often as they occur; ties have no order to keep. An empty table
gives an empty result; extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._kernel import ASCII_LOWER, U, mix, trimmed_group, trimmed_groups, word_names, words
from ._shared import fold, partitions, table

#: Words of an n-gram, bytes of text in a chunk, and of texts that are packed together.
ORDER, CHUNK_BYTES, PIECE_BYTES = 3, 12 << 20, 1 << 20
START, END = U(0x5354415254), U(0x454E44)
GOLDEN = 0.6180339887498949
#: Tokens that are scored at a time.
STEP = 1 << 17
_H = "__quirelake_"
_SENT = "range int, chunk int, names binary, vals binary, more binary, share array<bigint>"
_TOLD = "to int, range int, level int, vals binary, more binary, own binary, rest binary, rest_more binary, share array<bigint>"
_OUT = "id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Texts are written once and read at every step, names and counts are as random as their odds.
_TEXTS, _CODEC = pa.Codec("zstd", 9), pa.Codec("zstd", 1)
#: A share: n-grams seen once, twice, three and four times, those seen more than twice, all that were seen, tokens, types.
SHARE = 8


# -- packing ----------------------------------------------------------------------------------------------------


def _shrunk(raw: pa.Buffer) -> bytes:
    """A piece's bytes, lower-cased as their words are read."""
    return _TEXTS.compress(ASCII_LOWER[np.frombuffer(raw, np.uint8)].tobytes(), asbytes=True)


def _packed(parts: list[np.ndarray]) -> bytes:
    """Bytes, each part compressed by itself (its symbols have odds of their own) where that helps."""
    raw = [x.tobytes() for x in parts]
    less = [_CODEC.compress(x, asbytes=True) for x in raw]
    kept = [y if len(y) < len(x) else x for x, y in zip(raw, less, strict=True)]
    return b"".join([np.array([len(raw), *map(len, raw), *map(len, kept)], np.int64).tobytes(), *kept])


def _unpacked(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    raw, kept = np.frombuffer(blob, np.int64, 2 * n, 8).reshape(2, n).tolist()
    at, out = 8 + 16 * n, []
    for size, held in zip(raw, kept, strict=True):
        part = memoryview(blob)[at : at + held]
        out.append(np.frombuffer(part if held == size else _CODEC.decompress(part, size), np.uint8))
        at += held
    return out


def _small(x: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, with those from 255 on apart: codes of the rows that occur most, and the other rows. A single column is read four a row."""
    n, columns = x.shape
    if not columns:
        return b"", b""
    low = np.minimum(x, 255).astype(np.uint8)
    if columns == 1:
        low = np.append(low, np.zeros(-n % 4, np.uint8)).reshape(-1, 4)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, : low.shape[1]] = low
    rows, of, times = np.unique(wide.view(U), return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(order.size, np.int64)
    rank[order] = np.arange(order.size)
    code = np.minimum(rank, 255)[of.ravel()].astype(np.uint8)
    frequent = rows[order[:255]].view(np.uint8).reshape(-1, 8)[:, : low.shape[1]]
    return _packed([np.array([n]), frequent.T, code, low[code == 255].T]), x.T[x.T >= 255].astype(np.int64).tobytes()


def _large(vals: bytes, more: bytes, columns: int) -> np.ndarray:
    n, frequent, code, other = _unpacked(vals)
    width = 4 if columns == 1 else columns
    rows = np.empty((code.size, width), np.uint8)
    known = code < 255
    rows[known], rows[~known] = frequent.reshape(width, -1).T[code[known]], other.reshape(width, -1).T
    x = (rows.reshape(-1, columns)[: int(n.view(np.int64)[0])].T).astype(np.int64)
    x[x == 255] = np.frombuffer(more, np.int64)
    return x.T


def _bits(x: np.ndarray) -> bytes:
    return _packed([np.packbits(x)])


def _planes(x: np.ndarray) -> bytes:
    """Steps between sorted names: all first bytes, all second ones and so on. The upper ones are small or nothing."""
    return _packed(list(np.ascontiguousarray(np.diff(x, prepend=U(0)).view(np.uint8).reshape(x.size, 8).T)))


def _unplanes(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.stack(_unpacked(blob)).T).view(U).ravel(), dtype=U)


def _cuts(names: np.ndarray, log2: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted names, by their leading bits."""
    at = np.searchsorted(names, np.arange(1, 1 << log2, dtype=U) << U(64 - log2)) if log2 else np.zeros(0, int)
    return [(r, int(a), int(b)) for r, (a, b) in enumerate(zip([0, *at], [*at, names.size], strict=True)) if b > a]


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in names.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, cols, strict=True)})


def _packer(chunks: int, piece: int, id_type: pa.DataType):
    """Batches (id, text, train, held_out, part) as rows (chunk, ids, train, held, sizes, blob): texts of about a piece."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            text = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            offs, i, rows = np.concatenate([[0], np.cumsum(size)]), 0, []
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + piece, "right")) - 1)
                at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
                raw = text.buffers()[2].slice(int(at[i]), int(offs[j] - offs[i])) if offs[j] > offs[i] else pa.py_buffer(b"")
                first = int(batch.column(4)[0].as_py() * GOLDEN % 1 * chunks)  # turns start far apart, so that chunks get alike
                rows.append(((first + turn) % chunks, i, j, size[i:j], _shrunk(raw) if offs[j] > offs[i] else b""))
                i, turn = j, turn + 1
            lists = lambda col, rows=rows: pa.ListArray.from_arrays(pa.array([r[1] for r in rows] + [rows[-1][2]], pa.int32()), col)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), lists(batch.column(0).cast(id_type)), lists(batch.column(2)), lists(batch.column(3)), lists(pa.array(size)), pa.array([r[4] for r in rows], pa.binary())],
                    [_H + "chunk", "ids", "train", "held", "sizes", "blob"],
                )

    return pack


# -- a chunk ----------------------------------------------------------------------------------------------------


def _chain(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Names of n-grams from those of all words but the last, and of the last."""
    with np.errstate(over="ignore"):
        return mix(before * U(0x9E3779B97F4A7C15) + mix(last))


class Chunk:
    """Tokens of the texts of a chunk, and its distinct n-grams of the lengths asked for."""

    def __init__(self, t: pa.Table, levels: list[int]):
        names, size = [], []
        for sizes, blob in zip(t["sizes"], t["blob"], strict=True):
            n = np.array(sizes.as_py(), np.int64)
            buf = np.frombuffer(pa.decompress(blob.as_buffer(), int(n.sum()), codec="zstd"), np.uint8) if n.sum() else np.zeros(0, np.uint8)
            start, end, first = words(buf, np.concatenate([[0], np.cumsum(n)]))
            names.append(np.insert(word_names(buf, start, end, ASCII_LOWER), first[1:], END))
            size.append(np.diff(first) + 1)
        self.size, token = np.concatenate(size), np.concatenate(names)
        self.train = np.array([x for part in t["train"].to_pylist() for x in part], bool)
        self.token_train = np.repeat(self.train, self.size)
        begins = np.cumsum(self.size) - self.size
        self.begins, self.names, self.of, self.context = begins, {}, {}, {}
        gram, opening = token, START
        for k in range(1, max(levels) + 1):
            if k > 1:  # the last words of the texts before the first are start tokens
                shifted = np.empty_like(gram)
                shifted[1:], shifted[begins] = gram[:-1], opening
                gram, opening = _chain(shifted, token), _chain(np.array([opening]), np.array([START]))[0]
            if k in levels:
                # the name of start tokens alone is one more: texts begin in their context
                self.names[k], of = np.unique(np.append(gram, opening), return_inverse=True)
                self.of[k] = of[:-1].astype(np.int32)
                self.context[k] = np.empty_like(self.of[k])
                self.context[k][1:], self.context[k][begins] = self.of[k][:-1], of[-1]

    def ends(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct n-gram of k words, those of k - 1 that it ends in and begins with."""
        at = np.zeros(self.names[k].size, np.int64)
        at[self.of[k]] = np.arange(self.of[k].size)
        return self.of[k - 1][at], self.context[k - 1][at]


def _share_of(told: pa.Table, level: int) -> np.ndarray:
    """The counts of counts that ranges sent, added up."""
    rows = [s.as_py() for s, k, r in zip(told["share"], told["level"].to_pylist(), told["range"].to_pylist(), strict=True) if k == level and r < 0]
    return np.sum([np.zeros(SHARE, np.int64), *rows], axis=0).astype(np.int64)


def _messages(chunk: int, names: np.ndarray, vals: np.ndarray, log2: int, share: np.ndarray | None) -> pa.Table:
    said = share.tolist() if share is not None else None
    rows = [(r, chunk, _planes(names[a:b]), *_small(vals[a:b]), said) for r, a, b in _cuts(names, log2)]
    if share is not None:  # all ranges are told, those too that this chunk has nothing for
        have = {r[0] for r in rows}
        rows += [(r, chunk, b"", b"", b"", said) for r in range(1 << log2) if r not in have]
    return _table(rows, _SENT)


def _answers(told: pa.Table, level: int, columns: int, own: bool = False, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a chunk's n-grams in the order of their names; with `own` their first column, and whether it owns them.

    What a chunk has all occurrences of (`counts`, its own) is its own, and not said.
    """
    fields = ["range", "level", "vals", "more", *(["own"] if own else ["rest", "rest_more"])]
    told = told.filter((pc.field("level") == level) & (pc.field("range") >= 0)).select(fields).sort_by("range")
    rows = told.to_pylist()
    vals = [_large(r["vals"], r["more"], 1) for r in rows]
    if own:
        bits, value = [_unpacked(r["own"])[0] for r in rows], np.concatenate(vals)
        if counts is None:
            return value, np.concatenate([np.unpackbits(x, count=len(v)) for x, v in zip(bits, vals, strict=True)]).astype(bool)
        mine, open_ = counts > 0, counts != value[:, 0]
        each = np.split(open_, np.cumsum([len(v) for v in vals])[:-1])
        mine[open_] = np.concatenate([np.unpackbits(x, count=int(o.sum())) for x, o in zip(bits, each, strict=True)])
        return value, mine
    if columns > 1:
        vals = [np.hstack([v, _large(r["rest"], r["rest_more"], columns - 1)]) for r, v in zip(rows, vals, strict=True)]
    return np.concatenate(vals), np.zeros(0, bool)


def _columns(level: int, order: int) -> int:
    return 1 if level == order else 5 if level > 1 else 6


def _first(t: pa.Table, order: int, log2: int) -> pa.Table:
    c = Chunk(t, [order])
    counts = np.bincount(c.of[order][c.token_train], minlength=c.names[order].size)
    return _messages(t[_H + "chunk"][0].as_py(), c.names[order], counts[:, None], log2, None)


def _next(t: pa.Table, told: pa.Table, level: int, order: int, log2: int) -> pa.Table:
    """What a chunk sends of n-grams of a length after it heard of those one word longer."""
    chunk = t[_H + "chunk"][0].as_py() if t.num_rows else told["to"][0].as_py()
    share = _share_of(told, level + 1) if chunk == 0 else None
    if not t.num_rows:
        return _messages(chunk, np.zeros(0, U), np.zeros((0, _columns(level, order)), np.int64), log2, share)
    c = Chunk(t, [level, level + 1])
    counts = np.bincount(c.of[order][c.token_train], minlength=c.names[order].size) if level + 1 == order else None
    vals, own = _answers(told, level + 1, _columns(level + 1, order), True, counts)
    value, (suffix, prefix) = vals[:, 0], c.ends(level + 1)
    of = lambda where, what, weight=None: np.bincount(where[what], None if weight is None else weight[what], c.names[level].size).astype(np.int64)
    sums = [of(suffix, own), of(prefix, own, value), of(prefix, own & (value == 1)), of(prefix, own & (value == 2)), of(prefix, own & (value > 2))]
    if level == 1:
        sums.append(np.bincount(c.of[1][c.token_train], minlength=c.names[1].size))
    return _messages(chunk, c.names[level], np.stack(sums, 1), log2, share)


def _merge(t: pa.Table, level: int, order: int) -> pa.Table:
    """A range's part of the model, as answers to the chunks that asked, and its share of the counts of counts."""
    rows, columns = t.to_pylist(), _columns(level, order)
    heard = next((r["share"] for r in rows if r["share"]), None)
    rows = [r for r in rows if r["names"]]
    names = [_unplanes(r["names"]) for r in rows]
    vals = np.concatenate([*(_large(r["vals"], r["more"], columns) for r in rows), np.zeros((0, columns), np.int64)])
    _, of = np.unique(np.concatenate([*names, np.zeros(0, U)]), return_inverse=True)
    total = np.stack([np.bincount(of, vals[:, i]) for i in range(columns)], 1).astype(np.int64)
    seen = np.flatnonzero(vals[:, 0] > 0)
    own = np.zeros(of.size, bool)
    first = np.full(len(total), of.size)
    np.minimum.at(first, of[seen], seen)
    own[first[first < of.size]] = True
    v = total[:, 0]
    share = [*((v == k).sum() for k in (1, 2, 3, 4)), (v > 2).sum(), v.sum(), *((total[:, 5].sum(), (total[:, 5] > 0).sum()) if level == 1 else (0, 0))]
    told, at = total[of], 0
    said = vals[:, 0] != told[:, 0] if level == order else np.full(of.size, level > 1)
    here = t["range"][0].as_py()
    out = [(0 if level > 1 else -1, -1 - here, level, b"", b"", b"", b"", b"", [int(x) for x in share])]
    for r, n in zip(rows, names, strict=True):
        mine = told[at : at + n.size]
        out.append((r["chunk"], here, level, *_small(mine[:, :1]), _bits(own[at : at + n.size][said[at : at + n.size]]), *_small(mine[:, 1:]), heard))
        at += n.size
    return _table(out, _TOLD)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) == 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


def _score(t: pa.Table, told: pa.Table, order: int, id_type: pa.DataType) -> pa.Table:
    if not t.num_rows:
        return pa.table({"id": pa.array([], id_type), "held_out": pa.array([], pa.bool_()), **{n: pa.array([], pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")}, **{n: pa.array([], pa.float64()) for n in ("base_score", "score")}})
    c = Chunk(t, list(range(1, order + 1)))
    c.names.clear()
    share = {1: np.array(t[_H + "share"][0].as_py(), np.int64)}
    for s, k, r in zip(told["share"], told["level"].to_pylist(), told["range"].to_pylist(), strict=True):
        if s.is_valid and k < order and r >= 0:
            share.setdefault(k + 1, np.array(s.as_py(), np.int64))
    links, tokens, types = (int(x) for x in share[1][5:])
    stats, _ = _answers(told, 1, 6)
    left, token, d = stats[:, 0], stats[:, 5], discounts(share[1][:4])
    rest = (d[1] * share[1][0] + d[2] * share[1][1] + d[3] * share[1][4]) / links if links else 1.0
    p = ((np.maximum(left - d[np.minimum(left, 3)], 0) / links if links else np.zeros(left.size)) + rest / (types + 1))[c.of[1]]
    for k in range(2, order + 1):
        vals, d, lower = _answers(told, k, _columns(k, order))[0], discounts(share[k][:4]), p
        p = np.empty_like(lower)
        for a in range(0, p.size, STEP):
            at = slice(a, a + STEP)
            _, total, once, twice, more = stats[c.context[k - 1][at], :5].T
            v = vals[c.of[k][at], 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                longer = np.maximum(v - d[np.minimum(v, 3)], 0) / total + (d[1] * once + d[2] * twice + d[3] * more) / total * lower[at]
            p[at] = np.where(total > 0, longer, lower[at])
        stats = vals
    by_doc = lambda x: np.add.reduceat(x, c.begins)
    flat = lambda n, kind: pa.concat_arrays([a.flatten() for a in t[n].chunks]).cast(kind)
    return pa.table({
        "id": flat("ids", id_type), "held_out": flat("held", pa.bool_()), "n_tokens": pa.array(c.size, pa.int64()),
        "n_known": pa.array(by_doc((token > 0)[c.of[1]].astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(c.size.size, tokens), pa.int64()),
        "base_score": pa.array(by_doc(np.log10((token + 1) / (tokens + 1 * (types + 1)))[c.of[1]])), "score": pa.array(by_doc(np.log10(p))),
    })


def score(df: DataFrame, learn: Column, held_out: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all rows; the model learns from `learn`."""
    if order < 2:
        raise ValueError("an n-gram has two words at least")
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    spread = partitions(df.sparkSession)
    chunks = max(spread, -(-total // chunk_bytes))
    log2 = (chunks - 1).bit_length()
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), learn.alias("train"), held_out.alias("held_out"), F.spark_partition_id().alias("part"))
    kind = rows.schema["id"].dataType
    id_type = to_arrow_type(kind)
    packed = rows.mapInArrow(_packer(chunks, min(PIECE_BYTES, max(1, chunk_bytes // 4)), id_type), f"{_H}chunk int, ids array<{kind.simpleString()}>, train array<boolean>, held array<boolean>, sizes array<bigint>, blob binary")
    docs = packed.repartition(spread, _H + "chunk")

    def first(t: pa.Table) -> pa.Table:
        return _first(t, order, log2)

    def merge(level: int):
        def run(t: pa.Table) -> pa.Table:
            return _merge(t, level, order)

        return run

    def after(level: int):
        def run(t: pa.Table, told: pa.Table) -> pa.Table:
            return _next(t, told, level, order, log2)

        return run

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        return _score(t, told, order, id_type)

    sent, told = docs.groupBy(_H + "chunk").applyInArrow(trimmed_group(first), _SENT), {}
    for level in range(order, 0, -1):
        # dealt once: what a chunk hears before it sends the next length is what it scores from
        merged = sent.groupBy("range").applyInArrow(trimmed_group(merge(level)), _TOLD)
        told[level] = merged.repartition(spread, "to")
        if level > 1:
            sent = docs.groupBy(_H + "chunk").cogroup(told[level].groupBy("to")).applyInArrow(trimmed_groups(after(level - 1)), _SENT)
    share = merged.where("to = -1").agg(F.array(*[F.coalesce(F.sum(F.get("share", F.lit(i))), F.lit(0)) for i in range(SHARE)]).alias(_H + "share"))
    every = told[order]
    for level in range(order - 1, 0, -1):
        every = every.unionByName(told[level])
    last = docs.crossJoin(F.broadcast(share)).groupBy(_H + "chunk").cogroup(every.groupBy("to"))
    return last.applyInArrow(trimmed_groups(finish), _OUT.format(id=kind.simpleString()))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model log-probabilities, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    of = fold(F.col("doc_id"), 7)
    return score(docs, F.coalesce(of != 2, F.lit(False)), F.coalesce(of == 2, F.lit(False))).withColumnRenamed("id", "doc_id")
