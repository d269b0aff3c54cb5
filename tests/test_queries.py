import re

import pytest

from quirelake.functions import keys
from quirelake.plans import registry as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, same, name):
    same(q.QUERIES[name](spark, sf_dir), duck, q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_query_without_sql_returns_rows(spark, sf_dir, name):
    assert q.QUERIES[name](spark, sf_dir).count() > 0


def test_text_jaccard_match_reads_whole_texts(spark, sf_dir, duck):
    items = {}
    for i, text in duck.sql("select item_id, text from benchmark").fetchall():
        words = {w for w in re.split(r"[\W_]+", (text or "").lower()) if w}
        items[i] = {w for w in words if w not in keys.COMMON} or words
    score = lambda x, y: len(x & y) / len(x | y) if x & y else 0.0
    want = {(a, b): score(items[a], items[b]) for a in items for b in items if a < b}
    got = {(r.left_id, r.right_id): r.score for r in q.QUERIES["text_jaccard_match"](spark, sf_dir).collect()}
    assert got == {p: pytest.approx(s, abs=1e-6) for p, s in want.items() if s >= 0.05}
