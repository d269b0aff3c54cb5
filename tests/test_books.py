"""Cleaning, cutting and assembling books, on small made-up ones."""

import pandas as pd
import pytest

from quirelake.functions import titles
from quirelake.operators import assembly, markup, positions, styles
from quirelake.operators.assembly import Chapter, Entry, assemble, chunked
from quirelake.operators.markup import Context, Node, normalised, paragraphs, read, text_of, written
from quirelake.sources import plain


def html(text, ctx=None):
    return written(Node("#root", {}, normalised(text, ctx).children))


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p>a</p><embed src=x><p>b</p>", "<p>a</p><p>b</p>"),
        ("<nav><p>kept</p></nav><video>fallback</video><math>x</math><canvas>y</canvas>", "<nav><p>kept</p></nav>"),
        ("<center>C</center><font>f</font><tt>t</tt>", '<div style="text-align:center">C</div><span>f</span><code>t</code>'),
        ("<unknown><p>in</p></unknown><em></em><a name=x></a>", '<p>in</p><a id="x"></a>'),
        ('<p id="a">1</p><p id="a">2</p>', '<p id="a">1</p><p>2</p>'),
        ("<p>* * *</p><p>•</p><p>• • •</p><p><a>*</a></p>", '<hr class="scene-break"/><p>•</p><hr class="scene-break"/><p><a>*</a></p>'),
        ("<p>Text www.OceanofPDF.com</p><div><p>O c e a n o f P D F . c o m</p></div><p>end</p>", "<p>Text</p><p>end</p>"),
        ('<svg><image xlink:href="i.png"/></svg><svg><text>Art</text></svg>', "<p>Art</p>"),
        ("<epub:switch><epub:case>x</epub:case><epub:default><p>d</p></epub:default></epub:switch><p>e</p>", "<p>d</p><p>e</p>"),
        ('<a href="https://x.org">o</a><a href="#in">i</a>', '<a href="https://x.org" target="_blank" rel="noopener">o</a><a>i</a>'),
        ("<p>one<p>two<ul><li>a<li>b</ul>", "<p>one</p><p>two</p><ul><li>a</li><li>b</li></ul>"),
        ("<html><head><title>t</title></head><body> <p></p><p>x &amp; y</p><p> </p></body></html>", "<p>x &amp; y</p>"),
        ("", ""),
        (None, ""),
    ],
)
def test_cleaning(source, want):
    assert html(source) == want


def test_images_and_links_resolve():
    ctx = Context(image=lambda s: f"images/{s}" if s.endswith("png") else None, link=lambda s: f"ch{s}")
    assert html('<img src="a.png"><img src="b.gif"><a href="#n">n</a>', ctx) == '<img data-src="images/a.png" loading="lazy" alt=""/><a data-link="ch#n">n</a>'
    assert ctx.images == ["images/a.png"]


def test_paragraphs_and_positions():
    root = normalised("<div><p>a<br>b</p><pre>\nx</pre><blockquote>q <em>r</em></blockquote></div><img src=i>", Context(image=lambda s: s))
    assert paragraphs(root) == [("p", "a b"), ("blockquote", "q r")]
    assert markup.position_text(root) == "abxq r￼"


def test_credits_go_from_the_start_only():
    roots = [read("<p>Scanned &amp; proofed by X</p><p>Title</p>"), read("<div><p>Get it at demonoid</p></div>" + "<p>t</p>" * 30 + "<p>Scanned by Y</p>")]
    markup.remove_credits(roots)
    assert text_of(roots[0]) == "Title" and text_of(roots[1]) == "t" * 30 + "Scanned by Y"


@pytest.mark.parametrize(
    "css, want",
    [
        ("margin-top:32px;color:red;display:block", "margin-top:2em"),
        ("text-indent:18pt;display:none", "text-indent:1.5em;display:none"),
        ("margin-left:999px;white-space:odd;border-top:1px solid #fff", "margin-left:4em;border-top:1px solid currentColor"),
    ],
)
def test_styles(css, want):
    assert styles.inline(css) == want


def test_stylesheet():
    css = "/* c */ body{margin-top:1em} p,h1{font-style:italic;color:red} @media print{p{text-align:left}} @media screen{q{text-align:right}} @font-face{x:y} *{text-align:left}"
    assert styles.stylesheet(css, ".s") == ".s p,.s h1{font-style:italic}\n.s q{text-align:right}"


TITLES = "Chapter One|CHAPTER XI|Part Two|Kapitel elleve|Bog enogtyve|Prologue|11|XI.|Chapter 3: The End"
NO_TITLES = "Chapter One 1|Chapters|11 men|Booked|A Part|Prologuex|"


def test_chapter_titles(spark):
    from pyspark.sql import functions as F

    from quirelake.functions import keys

    df = spark.createDataFrame([(t,) for t in [*TITLES.split("|"), *NO_TITLES.split("|")]], "t string")
    for r in df.select("t", keys.is_chapter_title(F.col("t")).alias("title"), keys.is_chapter_line(F.col("t")).alias("line")).collect():
        assert r.title == assembly.is_chapter_title(r.t) == (r.t in TITLES.split("|"))
        assert r.line == assembly.is_chapter_line(r.t) == (r.title and r.t not in ("11", "XI."))


def body(word, n):
    return "".join(f"<p>{(word + ' ') * 20}</p>" for _ in range(n))


def test_chunks_are_near_equal_and_never_end_with_a_heading():
    root = read("".join(f"<h2>H{i}</h2>" + body("word", 4) for i in range(10)))
    total = len(text_of(root))
    parts = chunked(root, 1000)
    sizes = [sum(len(text_of(n)) for n in p) for p in parts]
    assert sum(sizes) == total and len(parts) == -(-total // 1000) and max(sizes) <= 1000
    assert all(p[0].tag == "h2" for p in parts) and all(p[-1].tag != "h2" for p in parts)


def test_large_wrappers_are_opened_and_keep_their_id():
    parts = chunked(read(f'<div id="w" style="text-align:center">{body("a", 30)}</div>'), 500)
    assert len(parts) > 1 and parts[0][0].id == "w" and parts[1][0].attrs["style"] == "text-align:center"


def test_sections_links_and_contents():
    one = normalised("<h1>One</h1><p id=x>text</p>" + body("a", 60) + '<p><a href="b#y">to b</a></p>', Context(link=lambda h: h))
    two = normalised('<p id=y>Two starts</p><p><a href="a">back</a><a href="none">no</a></p>', Context(link=lambda h: h))
    made, contents = assemble([Chapter(one, "a"), Chapter(two, "b")], [Entry("First", "a"), Entry("Deep", "a#x", 1, 0), Entry("Nowhere", "q"), Entry("Second", "b#y")], 3000)
    links = [(n.attrs.get("href"), text_of(n)) for s in made for n in Node("#root", {}, s.nodes).nodes() if n.tag == "a"]
    last = len(made) - 1
    assert links == [(f"#sec={last}&id=y", "to b"), ("#sec=0", "back"), (None, "no")]
    assert [(r["title"], r["section"], r["id"], r["parent"]) for r in contents] == [("First", 0, None, None), ("Deep", 0, "x", 0), ("Second", last, "y", None)]
    assert made[0].title == "First" and made[last].title == "Second"


def test_chapters_found_in_the_text_start_sections():
    root = normalised("".join(f"<p>Chapter {w}</p>" + body(w, 20) for w in ("One", "Two", "Three")))
    made, contents = assemble([Chapter(root, "f")], [])
    assert [s.title for s in made] == ["Chapter One", "Chapter Two", "Chapter Three"] and [r["title"] for r in contents] == ["Chapter One", "Chapter Two", "Chapter Three"]


def test_contents_pages_and_running_heads_start_nothing():
    listing = "".join(f"<p>Chapter {w}</p>" for w in ("One", "Two", "Three"))
    root = normalised(listing + "".join(f"<h2>Chapter {w}</h2>" + body(w, 20) for w in ("One", "Two", "Three")))
    made, _ = assemble([Chapter(root, "f")], [])
    assert [s.title for s in made][1:] == ["Chapter One", "Chapter Two", "Chapter Three"] or len(made) == 3
    assert assembly.chosen_titles([(0, 10, "a"), (10, 20, "b"), (20, 30, "c"), (30, 2000, "a"), (2000, 4000, "b"), (4000, 6000, "c")]) == {3, 4, 5}
    assert assembly.chosen_titles([(0, 2000, "r"), (2000, 4000, "r"), (4000, 6000, "r")]) == {0}


def test_joined_chapters_keep_their_links():
    a = Chapter(read('<p id="n">one</p>'), "a")
    b = Chapter(read('<p id="n">two</p>'), "b", continues=True)
    c = Chapter(read("<p>three</p>"), "c")
    c.root.children[0].children.append(Node("a", {"data-link": "b#n"}, ["x"]))
    made, contents = assemble([a, b, c], [Entry("B", "b")])
    assert len(made) == 2 and "n-2" in written(Node("#root", {}, made[0].nodes))
    assert contents[0]["section"] == 0 and contents[0]["id"].startswith("rr-join")
    assert 'data-id="n-2"' in written(Node("#root", {}, made[1].nodes))


def test_extents():
    assert assembly.extents([(0, 0), (10, 1), (20, 1), (50, 0)], 80) == [50, 10, 30, 30]


def test_assembled_over_a_table(spark):
    rows = [("b1", 1, "k2", "<h1>Two</h1><p>x</p>", "", False), ("b1", 0, "k1", "<h1>One</h1><p>y <a href='#q'>z</a></p><p id=q>w</p>", "", False), ("b2", 0, "k", None, "T", False)]
    df = spark.createDataFrame(rows, "book string, ord int, key string, html string, title string, continues boolean")
    got = assembly.section_table(assembly.assembled(df)).orderBy("book", "section").collect()
    assert [(r.book, r.section, r.title, r.start) for r in got] == [("b1", 0, "One", 0), ("b1", 1, "Two", 7), ("b2", 0, "T", 0)]
    assert "#sec=0&amp;id=q" in got[0].html


def test_plain_text_and_markdown():
    wrapped = "\n".join(["A line that is longer than fifty characters but not by so much."] * 30)
    assert plain.text_to_html(wrapped).count("<p>") == 1 and plain.is_hard_wrapped(wrapped.split("\n"))
    assert plain.text_to_html("CHAPTER ONE\r\nHello & bye.\n  * * *\n     code") == '<h2>CHAPTER ONE</h2>\n<p>Hello &amp; bye.</p>\n<hr class="scene-break"/>\n<pre>     code</pre>'
    md = plain.markdown_to_html("# A *b*\n\ntext `x<y` **s**\n\n***\n\n---\n\n- i\n- j\n  - k\n\n# A b\n\n> q\n")
    assert md == '<h1 id="a-b">A <em>b</em></h1>\n<p>text <code>x&lt;y</code> <strong>s</strong></p>\n<hr class="scene-break"/>\n<hr/>\n<ul><li>i</li><li><p>j</p>\n<ul><li>k</li></ul></li></ul>\n<h1 id="a-b-1">A b</h1>\n<blockquote><p>q</p></blockquote>'


FILES = [
    ("01 - The Belgariad - Pawn Of Prophecy.epub", "Pawn of Prophecy", "The Belgariad", 1),
    ("03 - Dune.epub", "Dune", None, None),
    ("_OceanofPDF.com_Caliban_s_War (v1.2).epub", "Caliban's War", None, None),
    ("1984 - Orwell.txt", "1984 - Orwell", None, None),
    ("x/Leviathan Wakes (The Expanse Book 1).epub", "Leviathan Wakes", "The Expanse", 1),
    (".epub", "Untitled", None, None),
]


@pytest.mark.parametrize("case", FILES)
def test_file_names(case):
    assert titles.details_from_filename(case[0])[:3] == case[1:]


def test_series_of_details():
    assert titles.with_title_series("Leviathan Wakes (The Expanse Book 1)", [("Expanse", None, None)]) == ("Leviathan Wakes", [("Expanse", 1.0, None)])
    assert titles.with_title_series("A (B Book 1)", [("C", None, None)]) == ("A (B Book 1)", [("C", None, None)])
    assert titles.with_filename_details("", [], "02 - S - T.epub") == ("T", [("S", 2.0, None)])
    assert titles.with_filename_details("Own", [], "02 - S - T.epub") == ("Own", [])
    assert titles.unique_series([("The Expanse", None, None), ("the expanse", "1-3", None), ("", 1, None)]) == [("The Expanse", 1.0, 3.0)]
    assert titles.series_from_front_matter({"series": "[Dune, Other]", "volume": "2"}) == [("Dune", 2.0, None)]
    xmp = '<x xmlns:c="http://calibre-ebook.com/xmp-namespace" xmlns:r="r"><c:series><r:value>S</r:value><c:series_index>3</c:series_index></c:series></x>'
    assert titles.series_from_xmp(xmp) == [("S", 3.0, None)] and titles.series_from_xmp("<") == []


def test_export_names():
    assert titles.epub_file_name("A/B: c", "Æ. Ø") == "Æ. Ø-A B c.epub" and titles.epub_file_name("", None) == "Untitled.epub"
    assert len(titles.epub_file_name("word " * 60, "")) <= 155 and titles.ascii_file_name("Blåbær／x") == "Blaabaer_x"


# -- versions ------------------------------------------------------------------------------------------------------


def apply(a, changes):
    for start, end, text in reversed(changes):
        a = a[:start] + text + a[end:]
    return a


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("the cat sat", "the dog sat", [(4, 7, "dog")]),
        ("don't stop", "don't go", [(6, 10, "go")]),
        ("a b c d", "a x c y d", None),
        ("same", "same", []),
        ("", "new", [(0, 0, "new")]),
        ("one two three four", "five six three nine", None),
    ],
)
def test_differences(a, b, want):
    got = positions.diff_text(a, b)
    assert apply(a, got) == b and (want is None or got == want)


def test_changes_with_little_between_them_are_one():
    assert len(positions.diff_text("alpha beta, gamma delta", "omega sigma, kappa theta")) == 1


def test_paragraph_pairs():
    before = ["The first one here is long", "Second paragraph", "Third of all"]
    after = ["New start", "The first one here is changed", "Second paragraph!", "More"]
    assert positions.pair_paragraphs(before, after) == ([-1, 0, 1, 2], [])
    assert positions.pair_paragraphs(["a", "b"], []) == ([], [0, 1])


def test_moved_places():
    go = positions.Mover(["aaaa", "bbbb"], ["aaaa bb", "bb"]).place
    assert go(0, 0) == (0, 0) and go(1, 4) == (1, 2)
    same = positions.Mover(["ab", "cd"], ["a", "bcd"]).place
    assert [same(0, 1), same(1, 1), same(9, 9)] == [(1, 0), (1, 2), (1, 3)]
    text = "The quick brown fox jumps over the lazy dog. "
    x, y = "0 " + text * 3 + "z", "1 new words " + text * 3 + "y"
    assert positions.Mover([x], [y]).place(0, 20) == (0, 30)


def test_runs_are_found_by_their_neighbours():
    texts = {0: ["a", "x", "b"], 1: ["c", "x", "d", "x"]}
    find = lambda *a: positions.find_run(texts, ["x"], *a)
    assert find(0, 0, "c", "d") == (1, 1) and find(0, 1, "q", "q") == (0, 1) and find(1, 9, "d", "") == (1, 3)
    assert positions.find_run(texts, ["q"], 0, 0) is None


def test_undo():
    assert positions.undo(["a", "b"], [(1, ["a"], ["x"]), (2, ["b"], ["y"])], 1) == ["a", "y"]
    assert positions.undo(["a"], [(1, ["a"], ["x"]), (2, ["x"], ["y"])], 1) is None


def test_outline_pieces(spark):
    from quirelake.operators import outline

    df = spark.createDataFrame([(1, i, 900) for i in range(7)], "b int, o int, c long")
    assert [r.run for r in outline.pieces_of(df, "b", "o", "c").orderBy("o").collect()] == [0, 0, 0, 1, 1, 1, 2]
    assert isinstance(pd.DataFrame(), pd.DataFrame)
