"""Printed pages made of runs, read as books."""

import pytest

from quirelake.operators import pages
from quirelake.operators.markup import Node, text_of, written
from quirelake.operators.pages import Line, Run, across, blocks_of, joined, line_key, link_notes, page_lines, page_numbers, running_lines

WORDS = "the long line of the printed page goes on and on to here"


def line(text, y, x=50.0, size=10.0, **kw):
    return Run(text, x, y, len(text) * size * 0.5, size, **kw)


def page(texts, top=700.0, size=10.0, x=50.0):
    return [line(t, top - 14 * i, x, size) for i, t in enumerate(texts)]


def test_runs_become_lines_with_raised_marks():
    runs = [Run("A", 50, 700, 5, 10), Run("word", 60, 700.5, 20, 10, bold=True), Run("3", 80.5, 704, 3, 6), Run("below", 50, 686, 25, 10)]
    got = page_lines(runs, 800, 10)
    assert [(at.text, at.html) for at in got] == [("A word3", "A <b>word</b><sup>3</sup>"), ("below", "below")]
    assert joined([Run("a", 0, 0, 5, 10), Run("b", 5, 0, 5, 10), Run("c", 20, 0, 5, 10)])[0] == "ab c"


def test_paragraphs_headings_and_leaders():
    runs = [line("A Title", 760, size=18), *page([WORDS, WORDS, "short end."], 700), *page([f"  {WORDS}"[2:]], 658, x=70), line("Chapter ........ 12", 600), line("* * *", 560, 250)]
    got = blocks_of(page_lines(runs, 900, 10), 10, set())
    assert [b.kind for b in got] == ["h", "p", "p", "leader", "break"] and got[0].level == 1 and "…" in got[3].text


def test_hyphens_and_page_turns():
    lines = page_lines(page(["this is a line that ends with a hyphen-", "ated word and more of the same text here"]), 900, 10)
    assert "hyphenated word" in blocks_of(lines, 10, set())[0].text
    a, b = blocks_of(page_lines(page([WORDS + " and well-"]), 900, 10), 10, set())[0], blocks_of(page_lines(page(["known things"]), 900, 10), 10, set())[0]
    assert across(a, b, "|").html.endswith("well-|known things")


def test_notes_link_both_ways():
    runs = [*page([WORDS, WORDS]), Run("1", 400, 704, 3, 6), Run("1", 50, 120, 3, 5), Run("The note itself.", 56, 118, 60, 8)]
    blocks = blocks_of(page_lines(runs, 900, 10), 10, set())
    link_notes([(4, blocks)])
    assert 'href="#fn-4-1"' in blocks[0].html and blocks[-1].kind == "fn" and 'href="#fnref-4-1-1"' in blocks[-1].html


def test_running_lines_and_page_numbers():
    made = {p: [Line(850, 10, [line("x", 850)], f"THE BOOK {p}", height=900.0), Line(400, 10, [line("x", 400)], f"Text of page {p}", height=900.0), Line(40, 10, [line("x", 40)], str(p + 10), height=900.0)] for p in range(1, 8)}
    found = running_lines(made)
    assert all([id(at) in found for at in lines] == [True, False, True] for lines in made.values())
    assert line_key("12 The “Garden” — 3") == "# the garden #" and page_numbers(Line(850, 10, [], "IT HAS COME! 3 247", height=900.0)) == {3247, 247}


def test_book_of_pages():
    texts = [f"{w} {WORDS}" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten") * 3]
    made = {}
    for p in range(1, 7):
        head = [line(f"Chapter {p // 2}", 760, size=16)] if p % 2 == 0 else []
        made[p] = ([line("MY BOOK", 860), *head, *page(texts, 720), line(str(p), 30, 300)], 900.0)
    facts, sections, contents = pages.book(made, [("First", 1, 0), ("Part", 2, 0), ("Deep", 4, 1)])
    whole = " ".join(text_of(Node("x", {}, s.nodes)) for s in sections)
    assert facts["pages"] == facts["text_pages"] == 6 and "MY BOOK" not in whole and whole.count("seven the long line") == 18
    assert [s.title for s in sections] == ["First", "Part", "Deep", "Chapter 3"] and [(c["title"], c["section"], c["depth"]) for c in contents] == [("First", 0, 0), ("Part", 1, 0), ("Deep", 2, 1)]
    assert all(f'id="pg{p}"' in "".join(written(Node("#root", {}, s.nodes)) for s in sections) for p in made)


@pytest.mark.parametrize("a, b, want", [("self-", "made", ("self-made", False)), ("num1-", "x", ("num1-x", False)), ("exam-", "ple", ("example", True)), ("no", "x", None), ("Anglo-", "Saxon", ("Anglo-Saxon", False))])
def test_hyphen_rules(a, b, want):
    assert pages.join_hyphenated(a, b) == want


def test_over_a_table(spark):
    rows = [("b", p, 900.0, f"{w} {WORDS}", 50.0, 700.0 - 14 * i, 300.0, 10.0, False, False) for p in (1, 2) for i, w in enumerate(("one", "two"))]
    df = spark.createDataFrame(rows, "book string, page int, height double, str string, x double, y double, w double, size double, bold boolean, italic boolean")
    got = pages.books(df).collect()
    assert len(got) == 1 and got[0].title == "Pages 1-2" and got[0].html.count("span") == 4
