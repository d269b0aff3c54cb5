import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quirelake.functions import keys
from quirelake.operators import documents, graph, library, positions, resolve, sections, series
from quirelake.streaming import sync


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_keys(spark):
    assert col(spark, ["Herbert, Frank", "Frank  HERBERT", "Ærø", None], keys.author_key) == ["frank herbert", "frank herbert", "ærø", None]
    assert col(spark, ["Pokémon & Co.", "ﬁn"], keys.title_key) == ["pokemon co", "fin"]
    assert col(spark, ["The  Expanse ", "Expanse series", "‘Salem’"], keys.loose_key) == ["expanse", "expanse", "'salem'"]


def test_positions_and_ranges(spark):
    assert col(spark, ["3", " 03 ", "2,5", "2.567", "100000", "x", "", "1e3"], keys.parse_position) == [3, 3, 2.5, 2.57, None, None, None, None]
    got = col(spark, ["1-3", "1 – 3", "3-1", "2-2", "4", "a"], keys.parse_place)
    assert [g and (g.position, g.position_end) for g in got] == [(1, 3), (1, 3), None, (2, None), (4, None), None]


def test_isbn(spark):
    assert col(spark, ["978-0-316-12908-4", "urn:isbn:0316129089", "0316129089", "ISBN 0 316 12908 9", "9780316129085", None], keys.read_isbn) == ["9780316129084", "9780316129084", None, "9780316129084", None, None]


def test_authors_and_surnames(spark):
    assert col(spark, ["Terry Pratchett, Neil Gaiman", "Herbert, Frank", "Le Guin, Ursula K.", "Ann Bo; Cy Day & Eve Fox; Bo, Ann; Bo Ann", None], keys.author_names) == [["Terry Pratchett", "Neil Gaiman"], ["Herbert, Frank"], ["Le Guin, Ursula K."], ["Ann Bo", "Cy Day", "Eve Fox"], []]
    assert col(spark, ["Frank Herbert", "Herbert, Frank", "Sammy Davis Jr.", "Davis, Jr.", ""], keys.surname) == ["Herbert", "Herbert", "Davis", "Davis", ""]


def test_marks_and_lines(spark):
    assert col(spark, ["* * *", "***", "•", "• • •", "a"], keys.is_scene_break) == [True, True, False, True, False]
    assert col(spark, ["Scanned & proofed by X", "Translated by Y", "Formatted by Z"], keys.is_credit_line) == [True, False, True]
    assert col(spark, ["Page 12 of 40 — “Dune”"], keys.line_key) == ["page # of # dune"]
    assert col(spark, ["Chapter XI", "11", "CHAPTER 2 9", "Prologue", "Hello"], keys.is_chapter_title) == [True, True, False, True, False]
    assert col(spark, ["see https://www.site.example/ now"], lambda c: keys.strip_site_marks(c, "site.example")) == ["see now"]
    df = spark.createDataFrame([("well-", "known"), ("exam-", "ple"), ("A-", "Z"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(keys.join_hyphenated(F.col("a"), F.col("b"))).collect()] == ["well-known", "example", "A-Z", None]


def test_dates(spark):
    at = [dt.datetime(2025, 7, 1, 22, 30), dt.datetime(2025, 1, 2, 3, 4), dt.datetime(2024, 9, 27, 1, 1)]
    assert col(spark, at, lambda c: keys.date_label(c, F.lit(dt.datetime(2025, 7, 1, 22, 59))), "timestamp") == ["00:30", "2 Jan", "27 Sep 2024"]


def test_series(spark):
    p = spark.createDataFrame([("a", 1.0, 3.0), ("a", 5.0, None), ("a", 2.5, None), ("b", 1.0, None), ("b", 100.0, None), ("c", None, None)], "s string, position double, position_end double")
    assert sorted(tuple(r) for r in series.gaps(p, "s").collect()) == [("a", 4.0)]
    assert {r.number for r in series.held(p, "s").where("s = 'a'").collect()} == {1, 2, 3, 5, 2.5}


def test_components_of_a_long_chain(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:]), (500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(200)} | {500: 500, 501: 500}


def test_merge_and_rank(spark):
    rows = [("x", "a", 1, 0.0, True), ("x", "b", 2, 0.5, False), ("x", "b", 3, 0.9, False), ("y", "c", 1, 0.0, True), ("y", "d", 2, 0.0, False)]
    m = spark.createDataFrame(rows, "l string, key string, ord int, score double, by_author boolean")
    assert sorted((r.l, r.key, r.place) for r in resolve.rank_matches(m, "l").collect()) == [("x", "b", 1), ("y", "c", 1)]


def test_catalogues_with_different_keys_merge(spark):
    cols = "key string, title string, author string, series string, rank int"
    a = spark.createDataFrame([("h1", "The Dune", "Frank Herbert", "", 1), ("h2", "Dune", "Brian Herbert", "", 5), ("h3", "Emma", "Jane Austen", "", 1), ("x", "It", "S. King", "", 1)], cols)
    b = spark.createDataFrame([("o1", "Dune", "Herbert, Frank", "Dune", 2), ("o2", "DUNE!", "F. Herbert", "Other", 3), ("o3", "Emma", "J. Other", "No", 1), ("o4", "Dune Messiah", "Frank Herbert", "Dune", 1), ("x", "It", "", "Key", 2)], cols)
    got = resolve.merge_catalogues(a, b, "key", ["title", "author", "series"], title="title", author="author", rank="rank")
    want = {"h1": ("Dune", "both"), "h2": (None, "preferred"), "h3": (None, "preferred"), "x": ("Key", "both"), "o3": ("No", "other"), "o4": ("Dune", "other")}
    assert {r.key: (r.series, r.source) for r in got.collect()} == want


def test_books_held_under_another_number_are_not_missing(spark):
    places = spark.createDataFrame([("s", 1.0, None, "One"), ("s", 5.0, None, "Five"), ("s", None, None, "The Second Tale"), ("t", 9.0, None, "Third")], "series string, position double, position_end double, title string")
    listed = spark.createDataFrame([("s", 2.0, "Second Tale"), ("s", 3.0, "Third"), ("s", 4.0, None), ("s", 1.0, "Uno")], "series string, number double, title string")
    removed = spark.createDataFrame([], "series string, number double")
    assert sorted(r.number for r in series.missing(places, listed, "series", removed).collect()) == [3.0, 4.0]


@pytest.mark.parametrize("seed", range(20))
def test_diff_turns_one_text_into_the_other(seed):
    r = random.Random(seed)
    make = lambda: " ".join(r.choice(["a", "b", "c", "dd", "é."]) for _ in range(r.randint(0, 30)))
    a, b = make(), make()
    out, at = "", 0
    for start, end, text in positions.diff_text(a, b):
        assert start >= at
        out += a[at:start] + text
        at = end
    assert out + a[at:] == b


def test_places_follow_the_text():
    old, new = "one two three four", "one two NEW three four"
    shift = positions.position_shift(old, new)
    assert positions.moved(old.index("four"), old, new, shift) == new.index("four")
    assert positions.moved(2, old, new, shift) == 2
    assert positions.shift_offset(3, (1, 5, 4)) == 1 and positions.shift_offset(9, (1, 5, 4)) == 13


def test_fixes_replay(spark):
    p = spark.createDataFrame([("b", 0, 0, "x"), ("b", 0, 1, "y"), ("b", 0, 2, "x"), ("b", 1, 0, "x")], "book string, section int, ord int, text string")
    rows = [("b", 1, 0, 2, ["x"], ["z"], "y", ""), ("b", 2, 0, 0, ["z"], ["w"], "q", "q"), ("b", 3, 0, 0, ["q"], ["w"], "", ""), ("b", 4, 1, 0, ["x"], ["v"], "", "")]
    f = spark.createDataFrame(rows, "book string, fix_id int, section int, at int, old_text array<string>, new_text array<string>, before string, after string")
    got = [(r.applied, r.to_section, r.place) for r in positions.replay_fixes(p, f).orderBy("fix_id").collect()]
    assert got == [(True, 0, 2), (True, 0, 2), (False, -1, -1), (True, 1, 0)]


def test_cuts():
    assert sections.cuts([(10, 1), (48, 1), (52, 0), (90, 1)], 100, 60) == [2]
    assert sections.cuts([(10, 1)], 50, 60) == []


def test_html_blocks(spark):
    df = spark.createDataFrame([(1, "<p>a <b>b</b><script>x</script><div>c<br>d</div><embed src=x><p>e"), (2, None)], "k int, h string")
    assert [tuple(r) for r in documents.html_blocks(df, "k", "h").orderBy("ord").collect()] == [(1, 0, "p", "a b"), (1, 1, "div", "c d"), (1, 2, "p", "e")]


def test_progress_batch_and_stream_agree(spark, tmp_path):
    t = lambda d: dt.datetime(2025, 1, d)
    rows = [(1, "b", 1, t(1), None, False), (1, "b", 2, t(3), t(1), False), (1, "b", 3, t(4), t(2), False), (1, "b", 4, t(5), t(2), True), (2, "b", 5, t(1), None, False)]
    df = spark.createDataFrame(rows, "user_id long, book_id string, event_id long, updated_at timestamp, known_updated_at timestamp, force boolean")
    want = {1: True, 2: True, 3: False, 4: True, 5: True}
    assert {r.event_id: r.accepted for r in sync.accept_progress(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sync.accept_progress_stream(stream).writeStream.format("memory").queryName("progress").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {r.event_id: r.accepted for r in spark.table("progress").collect()} == want


def test_session_expiry(spark):
    h = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)
    df = spark.createDataFrame([("t", h(0)), ("t", h(0.5)), ("t", h(23.9)), ("t", h(47)), ("t", h(80))], "token string, ts timestamp")
    got = [r.valid for r in sync.session_expiry(df, "token", "ts", "24 hours").orderBy("ts").collect()]
    assert got == [True, True, True, True, False]


def test_library(spark):
    d = library.snapshot_delta(spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int"))
    assert sorted((r.x, r.change) for r in d.collect()) == [(1, "removed"), (2, "removed"), (3, "added")]


def test_rate_limit():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    assert list(sync.rate_limited([1, 2, 3], 1.0, lambda: now[0], sleep)) == [1, 2, 3] and slept == [1.0, 1.0]
