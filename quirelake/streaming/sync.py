"""Reading progress and sessions: batch folds and their Structured Streaming twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_progress(df: DataFrame, keys: list[str], ts: str, event: str) -> DataFrame:
    """L01 without conflicts: the last write of each key, with how many there were."""
    return df.groupBy(*keys).agg(F.max(ts).alias(ts), F.max_by(event, F.struct(ts, event)).alias(event), F.count("*").alias("writes"))


_OUT = "user_id long, book_id string, event_id long, updated_at timestamp, accepted boolean"


def _fold(rows: pd.DataFrame, held: pd.Timestamp | None) -> tuple[list[bool], pd.Timestamp | None]:
    """Whether each write, in order, is accepted: not if what is held is newer than what its device knew."""
    said = []
    for at, known, force in zip(rows["updated_at"], rows["known_updated_at"], rows["force"], strict=True):
        ok = held is None or pd.isna(known) or bool(force) or not held > known
        held = at if ok else held
        said.append(ok)
    return said, held


def _sorted_folds(batches: Iterator[pd.DataFrame], keys: list[str], begin, step, columns: list[str]) -> Iterator[pd.DataFrame]:
    """One fold a key over rows that come sorted by it, a batch at a time: step(state, row) gives (state, values)."""
    now, state = None, None
    for b in batches:
        out = []
        for row in b.itertuples(index=False):
            key = tuple(getattr(row, k) for k in keys)
            if key != now:
                now, state = key, begin(row)
            state, said = step(state, row)
            out.append(said)
        yield pd.DataFrame(out, columns=columns)


def accept_progress(df: DataFrame) -> DataFrame:
    """L01, L02 over a batch: rows (user_id, book_id, event_id, updated_at, known_updated_at, force) in time order.

    Rows are sorted within partitions of keys and folded as they stream by: a key is never held, however hot.
    """

    def step(held: pd.Timestamp | None, r) -> tuple:
        ok = held is None or pd.isna(r.known_updated_at) or bool(r.force) or not held > r.known_updated_at
        return (r.updated_at if ok else held), (r.user_id, r.book_id, r.event_id, r.updated_at, ok)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _sorted_folds(batches, ["user_id", "book_id"], lambda _: None, step, ["user_id", "book_id", "event_id", "updated_at", "accepted"])

    rows = df.select("user_id", "book_id", "event_id", F.col("updated_at").cast("timestamp"), F.col("known_updated_at").cast("timestamp"), "force")
    return rows.repartition("user_id", "book_id").sortWithinPartitions("user_id", "book_id", "updated_at", "event_id").mapInPandas(run, _OUT)


def accept_progress_stream(df: DataFrame) -> DataFrame:
    """The same over a stream: what is held of each key is state; rejected writes are rows too, not dropped late data."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.Timestamp(state.get[0]) if state.exists else None
        t = pd.concat(list(batches)).sort_values(["updated_at", "event_id"])
        t["accepted"], held = _fold(t, held)
        if held is not None:
            state.update((held.to_pydatetime(),))
        yield t[["user_id", "book_id", "event_id", "updated_at", "accepted"]]

    return df.groupBy("user_id", "book_id").applyInPandasWithState(run, _OUT, "held timestamp", "append", GroupStateTimeout.NoTimeout)


def sessions(df: DataFrame, user: str, ts: str, gap: str) -> DataFrame:
    """Requests of a user with less than `gap` between them."""
    w = df.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("began"), F.max(ts).alias("last_seen"), F.count("*").alias("requests"))
    return w.drop("w")


def session_expiry(df: DataFrame, token: str, ts: str, life: str = "30 days", touch: str = "1 hour") -> DataFrame:
    """L09 exactly: a request extends a session's expiry only an hour or more after the last touch; behind its
    expiry the session is gone. Requests of a token are one ordered fold."""
    kind = df.schema[token].dataType.simpleString()
    span, least = pd.Timedelta(life), pd.Timedelta(touch)

    def step(state: tuple, r) -> tuple:
        (seen, expires), at = state, getattr(r, ts)
        ok = at < expires
        if ok and at - seen >= least:
            seen, expires = at, at + span
        return (seen, expires), (getattr(r, token), at, ok, expires)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _sorted_folds(batches, [token], lambda r: (getattr(r, ts), getattr(r, ts) + span), step, [token, ts, "valid", "expires"])

    rows = df.select(token, F.col(ts).cast("timestamp").alias(ts)).repartition(token).sortWithinPartitions(token, ts)
    return rows.mapInPandas(run, f"{token} {kind}, {ts} timestamp, valid boolean, expires timestamp")


def settled(df: DataFrame, keys: list[str], ts: str, quiet: str = "1200 milliseconds") -> DataFrame:
    """Of writes closer together than `quiet` only the last is sent, when it has been quiet for so long."""
    w = df.groupBy(*keys, F.session_window(F.col(ts).cast("timestamp"), quiet).alias("w"))
    return w.agg(F.max(ts).alias("last_write"), F.count("*").alias("writes")).withColumn("sent_at", F.col("w.end")).drop("w")


def one_worker(queue: DataFrame, book: str, at: str) -> DataFrame:
    """A book that is queued already is not queued again; one worker takes them in order."""
    return queue.groupBy(book).agg(F.min(at).alias(at)).orderBy(at, book)


def windowed_counts(df: DataFrame, ts: str, window: str, late: str) -> DataFrame:
    """An extension: events by tumbling window with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def rate_limited(items: list, seconds: float, clock, sleep) -> Iterator:
    """Items no closer together than `seconds`; for driver-side readers of outside catalogues."""
    last = None
    for x in items:
        if last is not None and (wait := last + seconds - clock()) > 0:
            sleep(wait)
        last = clock()
        yield x


def fresh(cache: DataFrame, now, ttl: str = "24 hours", failed_ttl: str = "10 minutes") -> DataFrame:
    """Cache rows (at, ok) that still hold; failures are kept for less long."""
    age = F.lit(now) - F.expr(f"interval {ttl}"), F.lit(now) - F.expr(f"interval {failed_ttl}")
    return cache.where(F.when(F.col("ok"), F.col("at") > age[0]).otherwise(F.col("at") > age[1]))
