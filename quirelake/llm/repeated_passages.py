"""Repeated passages by recompression: every word of a 35-word window that occurs twice anywhere is removed.

Words get 64-bit names. Long runs of one word keep 34 words at either end, and what lies between becomes one run
symbol. Then come three rounds of pair naming: a hash of each symbol's name puts it in the left or the right class,
and every left symbol followed by a right one becomes a symbol with a name of its own. Names are hashes of what
they stand for, so all tasks name alike and no round needs an exchange of its own. Equal passages are parsed
alike except at their borders: a round can lose one symbol at each side, of 1, 2 and 4 words at most, so of 35
repeated words at least 21 in the middle are the same symbols, of 8 words at most, in both places. The name of
consecutive symbols that cover 14 words or more (21 at most) therefore occurs in each repeated window.

1. Chunks of documents send their distinct high-level names, packed by range of name; ranges find those that
   occur twice and tell the chunks that asked.
2. Around these, and only there, chunks hash the 35-word windows and exchange them the same way: this verifies.
3. Chunks remove the words that verified windows cover.

A name is sent once a chunk however often it occurs, so a passage that many documents share is no hot spot, and
a packed row is never smaller than one name. Chunks and ranges grow in number with the data, not in size. All three
steps read one shuffle of the documents.

Null, empty and short texts keep everything; a very long text is parsed whole, in one piece. Windows are judged on the input; equal rows are different documents,
so their windows repeat. An empty table gives an empty result; extra columns are carried along and columns named
like a result are replaced. The kept text is the kept words joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._kernel import U, mix, powers, text_slices, trimmed_group, trimmed_groups, window_names, word_names, words
from ._shared import partitions, table, without

WINDOW, ROUNDS, COVER = 35, 3, 14
CHUNK_BYTES = 8 << 20
NEW = ["n_words", "n_removed", "kept_text", "kept_sha256"]
_H = "__quirelake_"


class Parsed:
    """The words of some whole texts, and their high-level names with the words each covers."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.start, self.end, self.first = words(buf, offs)
        self.names = word_names(buf, self.start, self.end)
        n = np.diff(self.first)
        self.doc = np.repeat(np.arange(n.size), n)
        self.last = np.repeat(self.first[1:], n)  # of each word's text

    def high_names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(name, first word, word after the last, whether it repeats by itself)."""
        size = self.names.size
        if not size:
            return (np.zeros(0, U),) + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
        with np.errstate(over="ignore"):
            sym, at = self.names, np.arange(size)
            new = np.ones(size, bool)
            new[1:] = (sym[1:] != sym[:-1]) | (self.doc[1:] != self.doc[:-1])
            run = np.flatnonzero(new)
            length = np.diff(np.append(run, size))
            pure = length >= WINDOW
            run_names = mix(sym[run[pure]] ^ U(0x52554E))
            run_from, run_to, run_twice = run[pure], run[pure] + length[pure], length[pure] > WINDOW
            long = length > 2 * WINDOW
            if long.any():
                edge = np.zeros(size + 1, np.int64)
                np.add.at(edge, run[long] + WINDOW, 1)
                np.add.at(edge, run[long] + length[long] - (WINDOW - 1), -1)
                sym = sym.copy()
                sym[run[long] + WINDOW - 1] = mix(sym[run[long]] + U(0x4C4F4E47))
                at = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                sym = sym[at]
            for r in range(ROUNDS):
                left = (mix(sym + U(7919 * (r + 1))) >> U(63)).astype(bool)
                pair = np.zeros(sym.size, bool)
                pair[:-1] = left[:-1] & ~left[1:] & (self.doc[at[:-1]] == self.doc[at[1:]])
                i = np.flatnonzero(pair)
                sym = sym.copy()
                sym[i] = mix(sym[i] * U(0xC2B2AE3D27D4EB4F) + sym[i + 1] + U(r + 1))
                keep = np.ones(sym.size, bool)
                keep[i + 1] = False
                sym, at = sym[keep], at[keep]
            ends = np.append(at[1:], size)
            j = np.searchsorted(ends, at + COVER, "left")
            ok = j < sym.size
            i, j = np.flatnonzero(ok), j[ok]
            ok = (ends[j] <= self.last[at[i]]) & (ends[j] - at[i] <= WINDOW) & (self.last[at[i]] - self.first[self.doc[at[i]]] >= WINDOW)
            i, j = i[ok], j[ok]
            up, down = powers(sym.size + 1)
            sums = np.zeros(sym.size + 1, U)
            np.cumsum(sym * up[:-1], out=sums[1:])
            name = mix((sums[j + 1] - sums[i]) * down[i] + (j - i).astype(U))
        return np.concatenate([name, run_names]), np.concatenate([at[i], run_from]), np.concatenate([ends[j], run_to]), np.concatenate([np.zeros(i.size, bool), run_twice])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of the windows that start at each word, and where a whole window starts."""
        names = window_names(self.names, WINDOW)
        return names, np.flatnonzero(np.arange(names.size) + WINDOW <= self.last[: names.size])

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Names of the windows around repeated high-level names."""
        name, a, e, _ = self.high_names()
        hit = member(name, repeated)
        a, e = a[hit], e[hit]
        inner = e - a <= WINDOW
        lo = np.where(inner, np.maximum(e - WINDOW, self.first[self.doc[a]]), a)
        hi = np.where(inner, np.minimum(a, self.last[a] - WINDOW), e - WINDOW)
        names, whole = self.windows()
        edge = np.zeros(self.names.size + 1, np.int64)
        good = hi >= lo
        np.add.at(edge, lo[good], 1)
        np.add.at(edge, hi[good] + 1, -1)
        return names[whole[np.cumsum(edge)[whole] > 0]]

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Which words lie in a repeated window."""
        names, whole = self.windows()
        at = whole[member(names[whole], repeated)]
        edge = np.zeros(self.names.size + 1, np.int64)
        edge[at] += 1
        edge[at + WINDOW] -= 1
        return np.cumsum(edge[:-1]) > 0


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which x are in the sorted `of`; a bit table spares most of the searches."""
    if not of.size or not x.size:
        return np.zeros(x.size, bool)
    bits = np.zeros(1 << 22, bool)
    bits[(of >> U(42)).astype(np.int64)] = True
    out = bits[(x >> U(42)).astype(np.int64)]
    i = np.flatnonzero(out)
    j = np.searchsorted(of, x[i])
    j[j == of.size] = 0
    out[i] = of[j] == x[i]
    return out


def _packed(chunk: int, names: list[np.ndarray], twice: list[np.ndarray], ranges_log2: int) -> pa.Table:
    """Distinct names of a chunk by range, with a bit for those that the chunk itself has twice."""
    flat = np.concatenate([*names, np.zeros(0, U)])
    one, first, count = np.unique(flat, return_index=True, return_counts=True)
    flags = np.concatenate([*twice, np.zeros(0, bool)])
    again = count > 1
    if flags.any():
        again |= np.isin(one, flat[flags])
    cut = np.searchsorted(one, np.arange(1, 1 << ranges_log2, dtype=U) << U(64 - ranges_log2)) if ranges_log2 else np.zeros(0, int)
    rows = [(r, a, b) for r, (a, b) in enumerate(zip([0, *cut], [*cut, one.size], strict=True)) if b > a]
    return pa.table({
        "range": pa.array([r for r, _, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()),
        "names": pa.array([one[a:b].tobytes() for _, a, b in rows], pa.binary()), "again": pa.array([np.packbits(again[a:b]).tobytes() for _, a, b in rows], pa.binary()),
    })


_PACKED = "range int, chunk int, names binary, again binary"
_ANSWER = "to int, repeated binary"


def _answer(t: pa.Table) -> pa.Table:
    """For each chunk of a range: which of its names occur twice over all chunks."""
    parts = [np.frombuffer(b, U) for b in t["names"].to_pylist()]
    again = [np.unpackbits(np.frombuffer(b, np.uint8), count=p.size).astype(bool) for b, p in zip(t["again"].to_pylist(), parts, strict=True)]
    flat = np.concatenate([*parts, np.zeros(0, U)])
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    same = np.zeros(s.size, bool)
    same[1:] = s[1:] == s[:-1]
    hit = same.copy()
    hit[:-1] |= same[1:]
    hit |= np.concatenate([*again, np.zeros(0, bool)])[order]
    # a name flagged by one chunk repeats for all: it then stands next to its equals, which are hits already
    out = np.empty(s.size, bool)
    out[order] = hit
    cuts = np.cumsum([p.size for p in parts])[:-1]
    rows = [(c, p[h]) for c, p, h in zip(t["chunk"].to_pylist(), parts, np.split(out, cuts), strict=True)]
    rows = [(c, p) for c, p in rows if p.size]
    return pa.table({"to": pa.array([c for c, _ in rows], pa.int32()), "repeated": pa.array([p.tobytes() for _, p in rows], pa.binary())})


def _repeated(t: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([*(np.frombuffer(b, U) for b in t["repeated"].to_pylist()), np.zeros(0, U)]))


def _each(t: pa.Table, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for chunk, base in _chunks(t[text]):
        for i, j, buf, offs in text_slices(chunk):
            yield base + i, base + j, buf, offs


def _chunks(col: pa.ChunkedArray) -> Iterator[tuple[pa.Array, int]]:
    at = 0
    for c in col.chunks:
        yield c, at
        at += len(c)


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", digest: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """df with n_words, n_removed and kept_text (its digest kept_sha256 if asked for)."""
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    chunks = max(partitions(spark), -(-total // chunk_bytes))
    log2 = (chunks - 1).bit_length()
    names = [c for c in without(df, NEW).columns]
    carried = names if text in names else [*names, text]
    docs = df.select(*[F.col(f"`{c}`") for c in carried], F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"), F.spark_partition_id()), F.lit(chunks)).cast("int").alias(_H + "chunk"))
    docs = docs.repartition(partitions(spark), _H + "chunk")

    def ask(t: pa.Table) -> pa.Table:
        found = [Parsed(buf, offs).high_names() for _, _, buf, offs in _each(t, text)]
        return _packed(t[_H + "chunk"][0].as_py(), [f[0] for f in found], [f[3] for f in found], log2)

    def verify(t: pa.Table, told: pa.Table) -> pa.Table:
        known = _repeated(told)
        if not t.num_rows or not known.size:
            return _packed(0, [], [], log2)
        found = [Parsed(buf, offs).candidates(known) for _, _, buf, offs in _each(t, text)]
        return _packed(t[_H + "chunk"][0].as_py(), found, [], log2)

    def remove(t: pa.Table, told: pa.Table) -> pa.Table:
        known = _repeated(told)
        n_words, n_removed, kept = [], [], []
        for _, _, buf, offs in _each(t, text):
            p = Parsed(buf, offs)
            gone = p.covered(known) if known.size else np.zeros(p.names.size, bool)
            raw = buf.tobytes()
            lost = np.concatenate([[0], np.cumsum(gone)])
            for i, (a, b) in enumerate(zip(p.first[:-1], p.first[1:], strict=True)):
                n_words.append(int(b - a))
                n_removed.append(int(lost[b] - lost[a]))
                if n_removed[-1]:
                    keep = a + np.flatnonzero(~gone[a:b])
                    kept.append(b" ".join([raw[s:e] for s, e in zip(p.start[keep].tolist(), p.end[keep].tolist(), strict=True)]))
                else:
                    kept.append(b" ".join(raw[offs[i] : offs[i + 1]].split()))
        shown = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()) if digest else pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())
        out = t.select([n for n in t.schema.names if n in names])
        return out.append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64())).append_column(last, shown)

    last = "kept_sha256" if digest else "kept_text"
    schema = T.StructType([*df.select([F.col(f"`{c}`") for c in names]).schema.fields, *T._parse_datatype_string(f"n_words long, n_removed long, {last} string").fields])
    told = docs.groupBy(_H + "chunk").applyInArrow(trimmed_group(ask), _PACKED).groupBy("range").applyInArrow(trimmed_group(_answer), _ANSWER)
    packed = docs.groupBy(_H + "chunk").cogroup(told.groupBy("to")).applyInArrow(trimmed_groups(verify), _PACKED)
    told = packed.groupBy("range").applyInArrow(trimmed_group(_answer), _ANSWER)
    return docs.groupBy(_H + "chunk").cogroup(told.groupBy("to")).applyInArrow(trimmed_groups(remove), schema)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, how many of them repeat, and a digest of what is left."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).drop("text")


SQL = rf"""
with t as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
v as (select r, i, list_slice(w, i, i + {WINDOW - 1}) g from (select r, w, unnest(range(1, len(w) - {WINDOW - 2})) i from t)),
d as (select r, i from v qualify count(*) over (partition by hash(g), g) > 1),
c as (select distinct r, unnest(range(i, i + {WINDOW})) p from d),
k as (select r, list(p) gone from c group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(gone), 0) as bigint) n_removed,
       sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) kept_sha256
from t left join k using (r)
"""
