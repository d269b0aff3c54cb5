"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's features are the byte n-grams of its lower-cased UTF-8 form, with every run of non-letters read as one
kind of space. Each n-gram hashes to a bucket with an embedding; a text is the average of its n-grams' embeddings,
and a linear softmax over that average gives the language. Both layers are trained together in numpy by
stochastic gradient descent, in two steps. The driver makes a start from a bounded sample of labelled rows
(SAMPLE_ROWS, drawn evenly over the languages, reduced to bucket counts before they are sent). From there learners, one
for some LEARNER_BYTES of text, go once over all labelled rows, batch by batch in mixed order; the model is the mean of
the learners, weighted by their rows and summed in Spark, block by block.

Calibration uses all labelled rows that the start has not learned from: each is judged by its learner before it is
learned from, and as a text of no language once more with its bytes shuffled. The logits stay in the shared folder; sums
of losses and counts of scores (BINS) come to the driver. A temperature is fitted on the rows. A text whose calibrated
score is below the threshold is not accepted: the threshold rejects REJECT_SHARE of these rows at most, and
is no higher than it takes to reject NOISE_SHARE of the shuffled ones. Reruns over the same files agree.

As both layers are linear, prediction sums one row of logits per n-gram, over whole texts, in numpy, a piece of a
text at a time: memory is bounded whatever the length of a text.

Null texts and texts without a letter are `und` with score 0 and are rejected. Without labelled rows everything
is `und`. Of languages with equal scores the first by name is said. Repeated rows are judged each by itself, an
empty table gives an empty result, extra columns are carried along and columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._kernel import U, mix, text_slices, trimmed
from ._shared import appended, fold, release, staged, table, without

#: Labelled rows of the start, hash buckets (a power of two) and embedding width; only the MAX_LABELS most frequent
#: labels are learned.
SAMPLE_ROWS, BUCKETS_LOG2, WIDTH, MAX_LABELS = 1500, 15, 12, 1000
#: Text of a learner, the least number of learners, their rate, and blocks that their weights are summed in.
LEARNER_BYTES, LEARNERS, RATE, BLOCKS = 32 << 20, 8, 0.4, 64
#: Steps of scores that calibration counts.
BINS = 1 << 16
SIZES = (1, 2, 3, 4)
REJECT_SHARE, NOISE_SHARE = 0.001, 0.99
#: Places of a text whose n-grams are held at a time.
PIECE = 1 << 16
#: Rows that are held and judged at a time.
ROWS = 512
UNKNOWN = "und"
NEW = ["lang_pred", "score", "accepted"]

#: Letters of ASCII and all bytes of other characters stay; everything else is a space.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_SHOWN = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def _shown(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces, and where each text starts: punctuation and layout leave no trace."""
    shown = _SHOWN[buf]
    keep = np.ones(buf.size, bool)
    keep[1:] = (shown[1:] != 32) | (shown[:-1] != 32)
    keep[offs[:-1][offs[:-1] < buf.size]] = True  # whatever the text before ends in
    return shown[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def _pieces(shown: np.ndarray, offs: np.ndarray, log2: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece and n-gram size: texts [from, to), buckets by start place, and the places of each text's n-grams."""
    for a in range(0, shown.size, PIECE):
        b = min(a + PIECE, shown.size)
        first, last = int(np.searchsorted(offs, a, "right")) - 1, int(np.searchsorted(offs, b, "left"))
        part = shown[a : b + max(SIZES) - 1].astype(U)
        h = np.full(part.size, 0x1000193, U)
        with np.errstate(over="ignore"):
            for n in range(1, max(SIZES) + 1):
                h = h[: part.size - n + 1] * U(0x100000001B3) ^ part[n - 1 :] if part.size >= n else h[:0]
                if n in SIZES:
                    start = np.minimum(np.maximum(offs[first:last] - a, 0), b - a)
                    end = np.minimum(np.maximum(offs[first + 1 : last + 1] - (n - 1) - a, start), b - a)
                    yield first, last, _bucket(h + U(n), log2), start, end


def _bucket(x: np.ndarray, log2: int) -> np.ndarray:
    """mix(x) >> (64 - log2) as indices; x is overwritten."""
    high = x >> U(30)
    x ^= high
    x *= U(0xBF58476D1CE4E5B9)
    np.right_shift(x, U(27), out=high)
    x ^= high
    x *= U(0x94D049BB133111EB)
    np.right_shift(x, U(31), out=high)
    x ^= high
    x >>= U(64 - log2)
    return x.view(np.int64)


@dataclass
class LanguageModel:
    labels: list[str]
    logits: np.ndarray  # (buckets, labels), summed over n-grams and divided by their number
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def raw(self, texts: pa.Array) -> np.ndarray:
        """Logits of whole texts."""
        out = []
        log2 = int(self.logits.shape[0]).bit_length() - 1
        for _, _, buf, offs in text_slices(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), 1 << 18):
            out.append(self.of_bytes(buf, offs, log2))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)))

    def of_bytes(self, buf: np.ndarray, offs: np.ndarray, log2: int) -> np.ndarray:
        shown, offs = _shown(buf, offs)
        total, count = np.zeros((offs.size - 1, len(self.labels))), np.zeros(offs.size - 1)
        for first, last, b, start, end in _pieces(shown, offs, log2):
            got, ends, some = np.zeros(b.size + 1), np.stack([start, end], 1).ravel(), end > start
            for k, of_label in enumerate(self._by_label()):
                of_label.take(b, out=got[:-1], mode="clip")
                total[first:last, k] += np.where(some, np.add.reduceat(got, ends)[::2], 0)
            count[first:last] += end - start
        return total / np.maximum(count, 1)[:, None] + self.bias

    def _by_label(self) -> np.ndarray:
        """The logits, one row a label."""
        if getattr(self, "_rows", None) is None or self._of is not self.logits:
            self._rows, self._of = np.ascontiguousarray(self.logits.T, np.float64), self.logits
        return self._rows

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "_of")}

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        z = raw / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _step(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, b: np.ndarray, c: np.ndarray, y: int, step: float) -> np.ndarray:
    """Learn one text; its logits before. emb has a row for each dimension."""
    rows = emb.take(b, axis=1)
    v = rows @ c
    z = v @ out + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[y] -= 1
    back = out @ p
    out -= step * np.outer(v, p)
    bias -= 0.01 * step * p
    rows -= np.outer(step * back, c)
    for k, row in enumerate(rows):
        emb[k][b] = row
    return z


def _train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, log2: int, width: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and the bias; plain SGD, text by text, with a falling rate."""
    rng = np.random.default_rng(seed)
    emb = np.ascontiguousarray((rng.random((1 << log2, width)) - 0.5).T) / width
    out, bias = np.zeros((width, n_labels)), np.zeros(n_labels)
    steps, done = epochs * len(x), 0
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            _step(emb, out, bias, *x[i], y[i], rate * (1 - done / steps))
            done += 1
    return np.ascontiguousarray(emb.T), out, bias


def _counted(buf: np.ndarray, offs: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text, and how often it has them."""
    shown, offs = _shown(buf, offs)
    if shown.size <= PIECE and log2 <= 16:  # counted by a radix sort
        b = np.sort(np.concatenate([b[start[0] : end[0]].astype(np.uint16) for _, _, b, start, end in _pieces(shown, offs, log2)] or [np.zeros(0, np.uint16)]), kind="stable")
        at = np.flatnonzero(np.concatenate([np.ones(min(1, b.size), bool), b[1:] != b[:-1]]))
        return b[at].astype(np.int32), np.diff(np.append(at, b.size)).astype(np.float32)
    counts = np.zeros(1 << log2, np.int64)
    for _, _, b, start, end in _pieces(shown, offs, log2):
        counts += np.bincount(b[start[0] : end[0]], minlength=1 << log2)
    b = np.flatnonzero(counts)
    return b.astype(np.int32), counts[b].astype(np.float32)


def _noise(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, buf: np.ndarray, offs: np.ndarray, keys: list[int], log2: int) -> np.ndarray:
    """Logits of texts whose bytes are shuffled, each by its key; emb has a row for each dimension."""
    few = out.shape[1] < len(emb)
    told, by = [], LanguageModel([""] * (out.shape[1] if few else len(emb)), (out.T @ emb if few else emb).T, np.zeros(1))
    at = 0
    while at < len(keys):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 18), "right")) - 1)
        shuffled, ends = buf[offs[at] : offs[to]].copy(), offs[at : to + 1] - offs[at]
        for k, a, b in zip(keys[at:to], ends[:-1], ends[1:], strict=True):
            np.random.default_rng(k & 0xFFFFFFFF).shuffle(shuffled[a:b])
        told.append(by.of_bytes(shuffled, ends, log2))
        at = to
    told = np.concatenate(told)
    return (told if few else told @ out) + bias


_LEARNED = "part int, block int, n double, weights binary, y binary, z binary, noise binary"


def _learned(rows: DataFrame, start: tuple[np.ndarray, ...], labels: list[str], log2: int) -> DataFrame:
    """One pass of SGD over rows (t, y, k, judged): each learner's weights by block, and logits of what it judged first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.float64()), *((c, pa.binary()) for c in ("weights", "y", "z", "noise"))])
        part, at, n = TaskContext.get().partitionId(), {y: i for i, y in enumerate(labels)}, 0
        emb, out, bias = (np.array(w, np.float64) for w in start)
        emb = np.ascontiguousarray(emb.T)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some, told = batch.slice(a, ROWS), []
                truth, key, judged = (some.column(i).to_pylist() for i in (1, 2, 3))
                _, _, buf, offs = next(text_slices(pc.utf8_lower(some.column(0).cast(pa.large_string())), 1 << 62))
                noise = _noise(emb, out, bias, buf, offs, key, log2) if any(judged) else None
                for i in np.random.default_rng([part, n]).permutation(some.num_rows):
                    b, c = _counted(buf[offs[i] : offs[i + 1]], offs[i : i + 2] - offs[i], log2)
                    y = at[truth[i]]
                    z = _step(emb, out, bias, b.astype(np.int64), c / max(1.0, float(c.sum())), y, RATE)
                    if judged[i]:
                        told.append((y, z, noise[i]))
                    n += 1
                if told:
                    y, z, noise = (np.array(x) for x in zip(*told, strict=True))
                    yield pa.RecordBatch.from_pylist([{"part": part, "block": -1, "y": y.astype(np.int32).tobytes(), "z": z.astype(np.float32).tobytes(), "noise": noise.astype(np.float32).tobytes()}], schema)
        if n:
            flat = np.concatenate([emb.T.ravel(), out.ravel(), bias]) * n
            yield pa.RecordBatch.from_pylist([{"part": part, "block": k, "n": float(n), "weights": w.tobytes()} for k, w in enumerate(np.array_split(flat, BLOCKS))], schema)

    return rows.mapInArrow(trimmed(run), _LEARNED)


def _mean(learned: DataFrame, start: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The learners' weighted mean."""

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        total = np.sum([np.frombuffer(w, np.float64) for w in t["weights"].to_pylist()], axis=0)
        return pa.table({"part": t["part"][:1], "block": t["block"][:1], "n": pa.array([float(np.sum(t["n"].to_numpy()))]), "weights": pa.array([total.tobytes()], pa.binary())})

    shape, some = "part int, block int, n double, weights binary", learned.where("block >= 0").select("part", "block", "n", "weights")
    few = some.groupBy("block", F.floor(F.col("part") / 256)).applyInArrow(lambda key, t: add(t), shape)
    rows = few.groupBy("block").applyInArrow(add, shape).orderBy("block").collect()
    flat, out, at = np.concatenate([np.frombuffer(r["weights"], np.float64) / r["n"] for r in rows]), [], 0
    for w in start:
        out.append(flat[at : at + w.size].reshape(w.shape))
        at += w.size
    return tuple(out)


def _calibrate(model: LanguageModel, learned: DataFrame) -> None:
    """Fit the temperature and the threshold on all judged rows."""
    told, width, grid = learned.where("block < 0").select("y", "z", "noise"), len(model.labels), np.geomspace(0.1, 20, 60)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y, z = np.frombuffer(y, np.int32), np.frombuffer(z, np.float32).reshape(-1, width)
                of = [-np.sum(np.log(LanguageModel(model.labels, model.logits, model.bias, t).calibrated(z)[np.arange(y.size), y] + 1e-12)) for t in grid]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(grid.size)), pa.array(np.round(np.array(of) * 2**20).astype(np.int64))], ["k", "loss"])

    found = {r["k"]: r["loss"] for r in told.mapInArrow(losses, "k bigint, loss bigint").groupBy("k").agg(F.sum("loss").alias("loss")).collect()}
    model.temperature = float(grid[min(range(grid.size), key=lambda k: found[k])])

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in (1, 2):
                z = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x, np.float32) for x in batch.column(kind).to_pylist())]).reshape(-1, width)
                at, n = np.unique(np.minimum(model.calibrated(z).max(axis=1) * BINS, BINS - 1).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, kind)), pa.array(at), pa.array(n)], ["kind", "bin", "n"])

    counts = np.zeros((3, BINS), np.int64)
    for r in told.mapInArrow(tops, "kind bigint, bin bigint, n bigint").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["kind"], r["bin"]] = r["n"]
    below = np.cumsum(counts, axis=1)
    low = int(np.searchsorted(below[1], int(REJECT_SHARE * below[1][-1]), "right"))
    high = int(np.searchsorted(below[2], NOISE_SHARE * below[2][-1], "left")) + 1
    model.threshold = min(low, high) / BINS


def fit(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, log2: int = BUCKETS_LOG2, width: int = WIDTH, epochs: int = 10, rate: float = 4.0, seed: int = 1) -> LanguageModel:
    """Learn from all labelled rows of df, after a start from about `rows` of them, drawn by a hash of the key.

    Labels share the rows of the start evenly; a rare label gives four fifths of what it has.
    """
    labelled = df.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{label}`").isNotNull()).select(F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").cast("string").alias("y"), F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string")).alias("k"))
    counts = labelled.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("bytes")).orderBy(F.desc("n"), "y").limit(MAX_LABELS).collect()
    if not counts:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0))
    labels = sorted(r["y"] for r in counts)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["y"], min(0.8, rows / len(labels) / r["n"]))])
    labelled = labelled.withColumn("first", F.shiftrightunsigned("k", 44) / F.lit(float(1 << 20)) < F.element_at(share, F.col("y"))).where("first is not null")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_counted(buf, offs, log2) for i in range(batch.num_rows) for _, _, buf, offs in text_slices(pc.utf8_lower(batch.column(0).slice(i, 1).cast(pa.large_string())), 1)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1))], ["y", "k", "b", "c"])

    sample = labelled.where("first").select("t", "y", "k").limit(2 * rows + len(labels))
    got = sample.mapInArrow(reduce, "y string, k bigint, b binary, c binary").toArrow().sort_by([("k", "ascending"), ("b", "ascending")])
    x = []
    for b, c in zip(got["b"], got["c"], strict=True):
        counted = np.frombuffer(c.as_buffer(), np.float32)
        x.append((np.frombuffer(b.as_buffer(), np.int32), counted / max(np.float32(1), counted.sum())))
    start = _train(x, np.array([labels.index(n) for n in got["y"].to_pylist()]), len(labels), log2, width, epochs, rate, seed)

    learners = max(LEARNERS, -(-sum(r["bytes"] for r in counts) // LEARNER_BYTES))
    judged = has_letter(F.col("t"))
    if len(x) < sum(r["n"] for r in counts):  # else every labelled row was learned from
        judged = judged & ~F.col("first")
    learned = staged(_learned(labelled.select("t", "y", "k", judged.alias("judged")).coalesce(learners), start, labels, log2), "learned")
    emb, out, bias = _mean(learned, start)
    model = LanguageModel(labels, (emb @ out).astype(np.float32), bias)
    if not learned.where("block < 0").isEmpty():
        _calibrate(model, learned)
    release(learned)
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """df with lang_pred, score (calibrated, 0 to 1) and accepted."""
    kept = without(df, NEW)
    flag = "__quirelake_letter"
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    names = np.array(model.labels, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, max(1, b.num_rows), ROWS)):
            at = batch.schema.names.index(flag)
            letter = batch.column(at).to_numpy(zero_copy_only=False)
            texts = batch.column(batch.schema.get_field_index(text))
            batch = batch.select([i for i in range(batch.num_columns) if i != at])
            if names.size and batch.num_rows:
                p = model.calibrated(model.raw(texts))
                best = p.argmax(axis=1)
                score = np.where(letter, p[np.arange(len(best)), best], 0.0)
                said = np.where(letter, names[best], UNKNOWN)
            else:
                score, said = np.zeros(batch.num_rows), np.full(batch.num_rows, UNKNOWN, object)
            ok = (said != UNKNOWN) & (score >= model.threshold)
            yield appended(batch, {"lang_pred": pa.array(said.tolist(), pa.string()), "score": pa.array(score), "accepted": pa.array(ok.astype(bool))})

    return df.withColumn(flag, has_letter(F.col(f"`{text}`"))).mapInArrow(trimmed(run), schema)


def held_out(key: Column) -> Column:
    """Whether the row is kept from training: crc32 of the id as text modulo 4 is 2; a null id is not."""
    return F.coalesce(fold(key, 4) == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
