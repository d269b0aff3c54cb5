"""Byte-level BPE encoding and decoding through a minimal acyclic transducer lexicon.

Spark counts words over the whole corpus; the most frequent ones, LEXICON_WORDS at most (a bound, not a cap: all
other words are merged exactly), are compiled into a minimal acyclic automaton. States with equal right languages are
shared, every edge carries the number of words that sort before it, so a walk yields the word's rank, and the rank
points at its ids. The automaton is one flat file of a few MB that Spark hands to every executor (addFile, so a
new executor fetches it again), where workers memory-map it. Words that it lacks are merged by rank, with a heap
for long ones. Each worker keeps a bounded memo of the words it has met.

Null is an empty text: no ids, and the empty text decoded. Strings of special tokens in a text become their
special ids. Repeated rows are encoded each by itself, an empty table gives an empty result, extra columns are
carried along and columns named like a result are replaced. Texts are encoded whole, whatever their length; results
leave a worker ROWS texts at a time. Of equally frequent words all or none go into the lexicon: ties need no order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._kernel import trimmed
from ._shared import appended, release, staged, table, without

LEXICON_WORDS = 32_768
#: Words a worker remembers before it starts anew.
MEMO_WORDS = 150_000
#: Texts that are encoded and handed on at a time.
ROWS = 256
NEW = ["n_tokens", "token_ids", "decoded"]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# -- the vocabulary ---------------------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, spec: bytes):
        j = json.loads(spec)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.ids = {raw(t): i for t, i in j["model"]["vocab"].items() if t not in special}
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []  # by rank
        for rank, m in enumerate(j["model"]["merges"]):
            a, b = map(raw, m if isinstance(m, list) else m.split(" "))
            self.ranks.setdefault((self.ids[a], self.ids[b]), rank)
            self.merged.append(self.ids[a + b])
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in special.items()}
        self.written = {i: str(i) for i in self.bytes_of}
        self.special = special
        self.splitter = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._pair_table()

    def merge(self, word: bytes) -> list[int]:
        """The exact ids of one word: always the pair of lowest rank, the leftmost of equals."""
        ids = [self.single[b] for b in word]
        if len(ids) > 100:
            return self._merge_long(ids)
        get, merged, none = self.ranks.get, self.merged, len(self.merged)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = merged[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _pair_table(self) -> None:
        """Pairs in an open-addressed table, for merging many words at once."""
        pairs = np.array(list(self.ranks), np.uint64)
        self.keys = (pairs[:, 0] << np.uint64(32)) | pairs[:, 1]
        values = np.fromiter(self.ranks.values(), np.int32, len(self.ranks))
        self.slots, self.slot_rank = np.full(1 << 20, np.iinfo(np.uint64).max, np.uint64), np.full(1 << 20, len(self.merged), np.int32)
        left, step = np.arange(len(self.keys)), 0
        while left.size:
            at = (self._slot(self.keys[left]) + step) & 0xFFFFF
            free = self.slots[at] == np.iinfo(np.uint64).max
            _, one = np.unique(at, return_index=True)
            put = np.zeros(left.size, bool)
            put[one] = True
            put &= free
            self.slots[at[put]], self.slot_rank[at[put]] = self.keys[left[put]], values[left[put]]
            left, step = left[~put], step + 1
        self.result = np.array([*self.merged, -1], np.int32)
        self.first = np.array(self.single, np.int32)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; past the last rank where there is none or an end is missing (-1)."""
        keys = ((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)).ravel()
        slot = self._slot(keys)
        there = self.slots.take(slot)
        hit = there == keys
        out = np.where(hit, self.slot_rank.take(slot), np.int32(len(self.merged)))
        left = np.flatnonzero(~hit & (there != np.iinfo(np.uint64).max))  # an empty slot ends the search
        while left.size:
            slot[left] = at = (slot[left] + 1) & 0xFFFFF
            there = self.slots[at]
            hit = there == keys[left]
            out[left[hit]] = self.slot_rank[at[hit]]
            left = left[~hit & (there != np.iinfo(np.uint64).max)]
        return out.reshape(a.shape)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """merge() of many words, in lockstep; long ones go one by one."""
        out: list = [None] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for top in (4, 8, 12, 16, 24, 40, 100):
            at = np.flatnonzero((length > low) & (length <= top))
            low = top
            for part in np.array_split(at, max(1, at.size // 20_000)):
                if part.size:
                    for i, ids in zip(part.tolist(), self._merge_block([words[i] for i in part], length[part], top), strict=True):
                        out[i] = ids
        return [self.merge(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _merge_block(self, words: list[bytes], n: np.ndarray, width: int) -> list[list[int]]:
        none, cols = len(self.merged), np.arange(width)
        ids = np.full((len(words), width), -1, np.int32)
        ids[cols < n[:, None]] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width), none, np.int32)
        ranks[:, :-1] = self._rank_of(ids[:, :-1], ids[:, 1:])
        done, rows = ids.copy(), np.arange(len(words))
        while rows.size:
            i = ranks.argmin(axis=1)
            every = np.arange(rows.size)
            best = ranks[every, i]
            go = best < none
            if not go.all():
                done[rows[~go]] = ids[~go]
                ids, ranks, rows, i, best = ids[go], ranks[go], rows[go], i[go], best[go]
                if not rows.size:
                    break
                every = np.arange(rows.size)
            shift = cols + (cols > i[:, None])
            last = shift >= width
            shift[last] = width - 1
            ids = np.take_along_axis(ids, shift, 1)
            ids[last] = -1
            ids[every, i] = self.result[best]
            shift = cols + (cols >= i[:, None])
            shift[shift >= width] = width - 1
            ranks = np.take_along_axis(ranks, shift, 1)
            ranks[:, -1] = none
            ranks[every, i] = self._rank_of(ids[every, i], ids[every, np.minimum(i + 1, width - 1)])
            ranks[i == width - 1, -1] = none
            prev = np.flatnonzero(i > 0)
            ranks[prev, i[prev] - 1] = self._rank_of(ids[prev, i[prev] - 1], ids[prev, i[prev]])
        size = (done >= 0).sum(axis=1)
        return [row[:k] for row, k in zip(done.tolist(), size.tolist(), strict=True)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.merged[ranks[pair]], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return [x for x in ids if x >= 0]


# -- splitting text into words ----------------------------------------------------------------------------------

_SPACE = r"\t-\r \x85\xa0  -     　"
_SHAPE = " ?[{L}]+| ?[{N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_FAST_TOP = 0x250


def _class(prop: str, top: int) -> str:
    """Members of a Unicode property below `top`, as the inside of a character class."""
    found = [c for c in range(top) if regex.match(rf"\p{{{prop}}}", chr(c))]
    out, i = "", 0
    while i < len(found):
        j = i
        while j + 1 < len(found) and found[j + 1] == found[j] + 1:
            j += 1
        out += f"\\u{found[i]:04x}-\\u{found[j]:04x}"
        i = j + 1
    return out


@lru_cache(1)
def _splitters() -> tuple:
    fast = _SHAPE.format(L=_class("L", _FAST_TOP), N=_class("N", _FAST_TOP), S=r"\t-\r \x85\xa0")
    return re.compile(fast).findall, re.compile(f"[^\\x00-\\u{_FAST_TOP - 1:04x}]").search, regex.compile(_SHAPE.format(L=r"\p{L}", N=r"\p{N}", S=_SPACE)).findall


def split_words(text: str) -> list[str]:
    fast, beyond, full = _splitters()
    return fast(text) if text.isascii() or not beyond(text) else full(text)


# -- the transducer ---------------------------------------------------------------------------------------------

_MAGIC = b"QLEX1\0\0\0"


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """A minimal acyclic automaton of the words, with their ids by rank, as one flat block."""
    words = sorted(dict(words).items())
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...)), equal right languages only once

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open states along the last word

    def close(depth: int, last: bytes) -> None:
        while len(path) > depth + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(done)))

    last = b""
    for word, _ in words:
        common = len(os.path.commonprefix([last, word]))
        close(common, last)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    close(0, last)
    root = freeze(path[0])

    size = [0] * len(states)  # words below each state; targets always come first
    first, target, skip, label = [0], [], [], bytearray()
    for k, (final, edges) in enumerate(states):
        n = int(final)
        for b, t in edges:
            label.append(b)
            target.append(t)
            skip.append(n)
            n += size[t]
        size[k] = n
        first.append(len(target))
    offs, flat = [0], []
    for _, ids in words:
        flat += ids
        offs.append(len(flat))
    parts = [struct.pack(f"<{len(x)}I", *x) for x in (first, target, skip, offs, flat)] + [bytes(label), bytes(int(f) for f, _ in states)]
    return _MAGIC + struct.pack("<8I", root, *map(len, (first, target, skip, offs, flat, label, states))) + b"".join(parts)


class Lexicon:
    """A memory-mapped lexicon."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        assert self.map[:8] == _MAGIC
        self.root, *lens = struct.unpack("<8I", self.map[8:40])
        view, at, out = memoryview(self.map), 40, []
        for n in lens[:5]:
            out.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.target, self.skip, self.offs, self.ids = out
        self.label_at, self.final = at, view[at + lens[5] : at + lens[5] + lens[6]]
        source = np.repeat(np.arange(lens[6], dtype=np.int64), np.diff(np.frombuffer(self.first, np.uint32)))
        self.edges = source << 8 | np.frombuffer(view[at : at + lens[5]], np.uint8)  # sorted: by state, then by byte

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word of the lexicon, else None."""
        state, rank = self.root, 0
        first, at, find = self.first, self.label_at, self.map.find
        for i in range(len(word)):
            a = first[state]
            e = find(word[i : i + 1], at + a, at + first[state + 1])
            if e < 0:
                return None
            rank += self.skip[e - at]
            state = self.target[e - at]
        return list(self.ids[self.offs[rank] : self.offs[rank + 1]]) if self.final[state] else None

    def get_many(self, words: list[bytes]) -> list[list[int] | None]:
        """get() of many words, in lockstep."""
        out: list = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        buf, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        skip, target, final = np.frombuffer(self.skip, np.uint32), np.frombuffer(self.target, np.uint32), np.frombuffer(self.final, np.uint8)
        left, state, rank, step = np.arange(size.size), np.full(size.size, self.root, np.int64), np.zeros(size.size, np.int64), 0
        while left.size:
            ends = size[left] == step
            hit = ends & (final[state] > 0)
            for i, r in zip(left[hit].tolist(), rank[hit].tolist(), strict=True):
                out[i] = list(self.ids[self.offs[r] : self.offs[r + 1]])
            left, state, rank = left[~ends], state[~ends], rank[~ends]
            key = state << 8 | buf[at[left] + step]
            e = np.searchsorted(self.edges, key)
            e[e == self.edges.size] = 0
            on = self.edges[e] == key if self.edges.size else np.zeros(key.size, bool)
            left, state, rank = left[on], target[e[on]].astype(np.int64), rank[on] + skip[e[on]]
            step += 1
        return out


# -- coding -----------------------------------------------------------------------------------------------------


class Coder(dict):
    """Word -> its ids, comma-joined; `spelled`: the same ids -> the bytes they decode to."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.v, self.lexicon, self.spelled = vocabulary, lexicon, {}

    def forget(self) -> None:
        """Workers live on between tasks; their memos don't, so that the next stage has the memory."""
        self.clear()
        self.spelled.clear()

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: special ones, the lexicon's, and the rest merged."""
        raw = [w.encode() for w in words]
        found = self.lexicon.get_many(raw) if self.lexicon else [None] * len(words)
        for w in self.v.special.keys() & set(words):
            found[words.index(w)] = [self.v.special[w]]
        unseen = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unseen, self.v.merge_many([raw[i] for i in unseen]), strict=True):
            found[i] = ids
        spell, written, spelled = self.v.bytes_of, self.v.written, self.spelled
        for w, ids in zip(words, found, strict=True):
            self[w] = out = ",".join([written[i] for i in ids])
            spelled[out] = b"".join([spell[i] for i in ids])

    def _words(self, text: str) -> list[str]:
        if self.v.splitter is None or not self.v.splitter.search(text):
            return split_words(text)
        out, at = [], 0
        for m in self.v.splitter.finditer(text):
            out += split_words(text[at : m.start()]) + [m[0]]
            at = m.end()
        return out + split_words(text[at:])

    def encode_many(self, texts: list[str]) -> Iterator[list[str]]:
        """Each text's words as id runs. New words of a few texts are learned together."""
        i = 0
        while i < len(texts):
            split, size = [], 0
            while i < len(texts) and (not split or size + len(texts[i]) < 500_000):
                split.append(self._words(texts[i]))
                size += len(texts[i])
                i += 1
            if len(self) > MEMO_WORDS:
                self.forget()
            self._learn(list(set().union(*split).difference(self)))
            for ws in split:
                yield list(map(self.__getitem__, ws))

    def decode(self, runs: list[str]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, runs))


@lru_cache(1)
def _vocabulary(load) -> Vocabulary:
    return Vocabulary(load())


@lru_cache(1)
def _coder(path: str, digest: str, load) -> Coder:
    """The coder of a lexicon; one at a time, as workers live on, and all of a tokenizer share its vocabulary."""
    return Coder(_vocabulary(load), Lexicon(path))


class _Load:
    """Hashable access to the broadcast vocabulary."""

    def __init__(self, spec, digest: str):
        self.spec, self.digest = spec, digest

    def __call__(self) -> bytes:
        return self.spec.value

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other) -> bool:
        return isinstance(other, _Load) and other.digest == self.digest


def frequent_words(df: DataFrame, text: str = "text", n: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of letters over all texts, at most n, counted in Spark.

    A small table of how many words occur how often gives the least count at which n words or fewer are left; only
    these words come to the driver.
    """
    words = df.select(F.explode(F.split(F.col(f"`{text}`"), " ")).alias("w")).groupBy("w").count()
    counts = staged(words.where(F.col("w").rlike(r"^\p{L}+$") & (F.length("w") <= 64) & (F.col("count") > 1)), "words")
    step = F.floor(F.log2("count") * 64).cast("int")  # 64 steps for each doubling: a few thousand rows at most
    least, left = None, n
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        left -= row["words"]
        if left < 0:
            break
        least = row["step"]
    found = [] if least is None else [r[0] for r in counts.where(step >= least).select("w").collect()]
    release(counts)
    return found


def lexicon_file(spark: SparkSession, words: list[str], vocabulary: Vocabulary) -> str:
    """Compile the words, after a space and at a start, and hand the file to all executors; its name there."""
    pairs = [(raw, vocabulary.merge(raw)) for w in words for raw in (w.encode(), b" " + w.encode())]
    block = compile_lexicon(pairs or [(b" ", vocabulary.merge(b" "))])
    name = f"quirelake-{uuid.uuid4().hex}.lex"
    path = os.path.join(tempfile.mkdtemp(prefix="quirelake-"), name)
    with open(path, "wb") as f:
        f.write(block)
    spark.sparkContext.addFile(path)
    return name


def code(df: DataFrame, finish, fields: list[T.StructField], text: str = "text", tokenizer: str | None = None, words: list[str] | None = None) -> DataFrame:
    """df with the columns that finish(runs, decoded bytes) returns for each text: a value for each field."""
    spark = df.sparkSession
    with open(tokenizer or default_tokenizer(), "rb") as f:
        spec = f.read()
    digest = hashlib.sha256(spec).hexdigest()
    words = frequent_words(df, text) if words is None else words
    name = lexicon_file(spark, words, Vocabulary(spec))
    load = _Load(spark.sparkContext.broadcast(spec), digest)
    names = [x.name for x in fields]
    kept = without(df, names)
    schema = T.StructType([*kept.schema.fields, *fields])
    arrow = [T.StructType([x]) for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(a.fields[0].dataType) for a in arrow]
        coder = _coder(SparkFiles.get(name), name + digest, load)
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), ROWS):
                part = batch.slice(a, ROWS)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                out = [finish(runs, coder.decode(runs)) for runs in coder.encode_many([x or "" for x in texts])]
                cols = list(zip(*out, strict=True)) if out else [()] * len(names)
                yield appended(part, {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})
        coder.forget()

    return df.mapInArrow(trimmed(run), schema)


def numbers(runs: list[str]) -> np.ndarray:
    """The ids of joined runs."""
    return np.fromstring(",".join(runs), np.int32, sep=",") if runs else np.zeros(0, np.int32)


def encode(df: DataFrame, text: str = "text", **kw) -> DataFrame:
    """df with n_tokens, token_ids and the text decoded from them."""

    def finish(runs: list[str], decoded: bytes) -> tuple:
        ids = numbers(runs)
        return len(ids), ids, decoded.decode("utf-8", "replace")

    return code(df, finish, [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], text, **kw)


def digest(df: DataFrame, text: str = "text", **kw) -> DataFrame:
    """df with n_tokens and SHA-256 digests of the ids and of the decoded text."""

    def finish(runs: list[str], decoded: bytes) -> tuple:
        joined = ",".join(runs)
        n = joined.count(",") + 1 if joined else 0
        return n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return code(df, finish, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], text, **kw)


def op4_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of token ids, their digest, and that of what they decode to."""
    return digest(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
