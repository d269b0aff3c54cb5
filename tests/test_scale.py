"""Cases that only show on more rows than the smallest tables have."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelake.operators import edits, markup, membership, resolve, staging
from quirelake.plans import registry


def test_numbers_go_up_by_one_over_many_ranges(spark):
    n = 400_000
    df = spark.range(n).select("id", (F.col("id") * 7919 % n).alias("rank"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    got = membership._numbered(df.withColumn("at", F.struct("rank", "id")), "at")
    assert got.count() == n and got.where("n <> rank + 1").count() == 0


def test_a_genre_is_set_for_more_than_ten_thousand_books(spark):
    books = spark.range(10_500).select(F.col("id").alias("book"), F.lit("Old").alias("genre"))
    got = edits.set_genre(books, books.select("book"), F.col("book") >= 0, "Crime")
    assert got.where("genre = 'Crime'").count() == 10_500
    assert edits.set_genre(books, books.select("book"), F.col("book") > 0, "Crime").where("genre = 'Old'").count() == 10_500


def _books(spark, n, seed):
    """Few keys, so that groups are large, and many pairs declared different, also of one book from most others."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", "f1"]), rng.choice(["", "i1", "i2", None]), rng.choice(["t1", "t2", "untitled", ""]), rng.choice(["", "x", "y", None] if seed % 2 else ["x", "y", "z"])) for i in range(n)]
    away = {tuple(rng.sample(range(n), 2)) for _ in range(n * n // 3)} | {(0, i) for i in range(1, n - 1)}
    books = spark.createDataFrame(rows, "id long, file string, isbn string, title string, author string")
    return rows, away, books, spark.createDataFrame(sorted(away), "a long, b long")


def _wanted(rows, away):
    out = {}
    for a, af, ai, at, aa in rows:
        for b, bf, bi, bt, ba in rows:
            if a >= b or (a, b) in away or (b, a) in away:
                continue
            agree = aa == "" or ba == "" or (aa is not None and aa == ba)
            reason = "file" if af and af == bf else "isbn" if ai and ai == bi else "title" if at not in ("", "untitled") and at == bt and agree else None
            if reason:
                out[a, b] = reason
    return out


@pytest.mark.parametrize("block", [2, 2_000])
def test_pairs_of_blocks_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(resolve, "BLOCK", block)
    for seed in (1, 2):
        rows, away, books, different = _books(spark, 14, seed)
        got = [tuple(r) for r in resolve.duplicate_pairs(books, "id", "file", "isbn", "title", "author", different).collect()]
        assert len(got) == len(set(got)) and {(a, b): r for a, b, r in got} == _wanted(rows, away)


def test_few_links_connect_what_all_pairs_connect(spark):
    def smallest(pairs):
        at = {x: x for p in pairs for x in p}
        for _ in at:
            for a, b in pairs:
                at[a] = at[b] = min(at[a], at[b])
        return at

    for seed in (3, 4, 5, 6):
        rows, away, books, different = _books(spark, 9, seed)
        for key, author in (("file", None), ("isbn", None), ("title", "author")):
            only = [(i, f if key == "file" else "", s if key == "isbn" else "", t if key == "title" else "", a) for i, f, s, t, a in rows]
            got = [tuple(r) for r in resolve.component_edges(books, key, "id", key, different, author).collect()]
            want = _wanted(only, away)
            assert set(got) <= set(want) and smallest(got) == smallest(want)


def test_links_of_a_hot_title_are_as_many_as_its_books(spark):
    books = spark.range(3_000).select("id", F.lit("same").alias("title"), F.when(F.col("id") % 4 == 0, "").otherwise("x").alias("author"))
    different = books.where("id % 5 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert resolve.component_edges(books, "title", "id", "title", different, "author").count() < 7_000


def test_pairs_are_not_sent_once_they_are_found(spark, sf_dir):
    plan = registry.QUERIES["duplicate_pairs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") == 0


def test_tasks_of_genre_beside_grow_with_the_input(spark, sf_dir):
    assert staging.tasks_for(spark.range(5_000_000)) == 40 and staging.tasks_for(spark.range(10)) == 4
    plan = registry.QUERIES["genre_beside"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)


def test_genre_beside_is_empty_when_two_lead(spark):
    members = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, None), (2, 1, 1.0), (2, 2, 1.0), (2, 4, None)], "series long, book long, position double")
    books = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "")], "book long, genre string")
    assert {r.book: r.genre for r in membership.genre_beside(members, books).collect()} == {1: "", 2: ""}
    assert {r.book: r.genre for r in membership.genre_beside(members, books.where("book <> 3")).collect()} == {1: "A", 2: "A"}


def test_cleaned_pages_leave_in_pieces(monkeypatch):
    monkeypatch.setattr(markup, "PIECE", 30)
    pages = ["<p>" + "word " * 4 + "</p>", None, "<p><a href='https://x.example/'>a</a></p><p>***</p>", "<script>x</script>", "<p>last</p>"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(15), pa.int64()), pa.array(pages, pa.string())], ["page_id", "html"])
    got = list(markup.cleaned_pieces(iter([batch, batch.slice(0, 0), batch.slice(3, 2)]), "page_id"))
    assert len(got) > 5 and all(sum(map(len, b.column("html").to_pylist()[:-1])) < 30 for b in got)
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == [*range(15), 3, 4]
    assert [(r["chars"], r["elements"], r["links"], r["breaks"]) for r in rows[:5]] == [(20, 1, 0, 0), (0, 0, 0, 0), (1, 3, 1, 1), (0, 0, 0, 0), (4, 1, 0, 0)]


def test_of_tied_matches_the_first_in_the_input_counts(spark):
    rows = [(1, 7, 1, 0.1, False, 2), (1, 7, 1, 0.9, False, 1), (1, 7, 1, 0.5, True, 3), (1, 6, 1, 0.9, False, 0), (2, 7, 1, 0.0, True, 4), (2, 7, 1, 0.0, False, 5)]
    for some in (rows, rows[::-1]):
        m = spark.createDataFrame(some, "lookup long, key long, ord long, score double, by_author boolean, at long").coalesce(1)
        assert {(r.lookup, r.key, r.score, r.place) for r in resolve.rank_matches(m, "lookup", at=("at",)).collect()} == {(1, 6, 0.9, 1), (1, 7, 0.9, 2), (2, 7, 0.0, 1)}
