import struct

from pyspark.sql import functions as F

from quirelake.sources import formats

CONTAINER = b'<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
OPF = b"""<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>A  Book</dc:title>
<dc:creator>Ann Bo</dc:creator><dc:creator>Cy Day</dc:creator><dc:language>en</dc:language><dc:identifier>urn:isbn:0316129089</dc:identifier>
<meta property="belongs-to-collection" id="c1">Saga</meta><meta refines="#c1" property="group-position">2</meta></metadata>
<manifest><item id="a" href="one.xhtml"/><item id="b" href="two%20x.xhtml"/><item id="n" href="nav.xhtml" properties="nav"/></manifest>
<spine><itemref idref="b"/><itemref idref="a"/></spine></package>"""
NAV = b'<html xmlns:epub="e"><body><nav epub:type="toc"><ol><li><a href="two%20x.xhtml#s">Part</a><ol><li><a href="one.xhtml">Chapter</a></li></ol></li></ol></nav></body></html>'


def epub():
    files = [("mimetype", b"application/epub+zip", True), ("META-INF/container.xml", CONTAINER, False), ("OEBPS/book.opf", OPF, False), ("OEBPS/nav.xhtml", NAV, False)]
    return formats.write_zip([*files, ("OEBPS/one.xhtml", b"<p>One</p>", False), ("OEBPS/two x.xhtml", "<p>Zwei ä</p>".encode(), False)])


def test_epub():
    b = formats.read_epub(epub())
    assert (b["title"], b["author"], b["language"], b["series"], b["isbns"]) == ("A Book", "Ann Bo, Cy Day", "en", [{"name": "Saga", "position": 2.0, "position_end": None}], ["9780316129084"])
    assert [c["path"] for c in b["chapters"]] == ["OEBPS/two x.xhtml", "OEBPS/one.xhtml"] and "ä" in b["chapters"][0]["html"]
    assert [(c["title"], c["depth"], c["parent"], c["target"]) for c in b["contents"]] == [("Part", 0, None, "OEBPS/two x.xhtml"), ("Chapter", 1, 0, "OEBPS/one.xhtml")]


def test_text_files():
    assert formats.decode_text("é".encode("utf-16")) == "é"
    assert formats.decode_text(b"caf\xe9 caf\xe9 caf\xe9") == "café café café"
    assert formats.front_matter('---\ntitle: "X"\nauthor: Y\n---\nbody') == ({"title": "X", "author": "Y"}, "body")
    assert formats.front_matter("no matter") == ({}, "no matter")


def test_image_sizes():
    assert formats.image_size(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 9)) == (7, 9)
    assert formats.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert formats.image_size(b"") is None


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.epub").write_bytes(epub())
    (tmp_path / "bad.epub").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "note.md").write_bytes(b"---\ntitle: T\n---\n# Hi")
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "x.zip").write_bytes(b"PK\x03\x04zip")
    files = formats.book_files(spark, str(tmp_path))
    kinds = {r["name"]: r.kind for r in files.select("name", formats.detect_format(F.col("content"), F.col("name")).alias("kind")).collect()}
    assert kinds == {"b.epub": "epub", "bad.epub": "epub", "note.md": "md", "x.pdf": "pdf", "x.zip": None}
    from quirelake.sources import books

    assert all(books.format_of(bytes(r["content"]), r["name"]) == kinds[r["name"]] for r in files.select("name", "content").collect())
    found = {r.path.rsplit("/", 1)[1]: r for r in formats.epubs(files.where("ext = 'epub'")).collect()}
    assert found["b.epub"].title == "A Book" and found["b.epub"].error is None and found["bad.epub"].error
    assert formats.texts(files.where("ext = 'md'")).first().details == {"title": "T"}
    assert [r.ext for r in formats.skipped(files, ["epub", "md", "pdf"]).collect()] == ["zip"]


def test_convert_and_export(spark, tmp_path):
    from quirelake.sources import books

    meta, sections, contents = books.convert(epub(), "x.epub")
    assert (meta["title"], meta["series"], meta["isbns"], meta["format"]) == ("A Book", [("Saga", 2.0, None)], ["9780316129084"], "epub")
    assert [(c["title"], c["section"], c["depth"]) for c in contents] == [("Part", 0, 0), ("Chapter", 1, 1)]
    assert books.read_metadata(epub(), "x.epub")["author"] == "Ann Bo, Cy Day"
    written = books.build_epub(meta | {"id": "b1"}, [(s.title, books.markup.written(books.Node("#root", {}, s.nodes))) for s in sections], contents)
    again, same, more = books.convert(written, "y.epub")
    assert again["title"] == "A Book" and again["series"] == meta["series"] and [books.text_of(books.Node("x", {}, s.nodes)) for s in same] == [books.text_of(books.Node("x", {}, s.nodes)) for s in sections]
    assert [(c["title"], c["section"], c["depth"]) for c in more] == [(c["title"], c["section"], c["depth"]) for c in contents]
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "02 - Saga - Other.txt").write_bytes(b"CHAPTER ONE\nText & more.")
    (tmp_path / "bad.epub").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "m.md").write_bytes(b"---\nseries: S\nvolume: 3\n---\n# Hi\n\ntext")
    built = books.converted(formats.book_files(spark, str(tmp_path))).cache()
    found = {r.path.rsplit("/", 1)[1]: r for r in built.where("kind = 'book'").collect()}
    assert found["02%20-%20Saga%20-%20Other.txt" if "02%20-%20Saga%20-%20Other.txt" in found else "02 - Saga - Other.txt"].series == ["Saga #2"] and found["m.md"].series == ["S #3"] and found["bad.epub"].error
    out = {r.name: bytes(r.content) for r in books.exported(built.where("error is null")).where("content is not null").collect()}
    assert "Ann Bo, Cy Day-A Book.epub" in out and all(books.convert(x, n)[1] for n, x in out.items())


def test_sidecars(spark):
    from quirelake.sources import books

    names = ["l/Dune.epub", "l/Dune.opf", "l/Dune.jpg", "l/Dune.png", "one/b.epub", "one/b.pdf", "one/metadata.opf", "one/cover.png", "two/x.epub", "two/y.epub", "two/cover.jpg"]
    files = spark.createDataFrame([(n, n.split("/")[1], n.rpartition(".")[2]) for n in names], "path string, name string, ext string")
    got = {r.path: (r.opf, r.cover) for r in books.with_sidecars(files).collect()}
    assert got == {"l/Dune.epub": ("l/Dune.opf", "l/Dune.jpg"), "one/b.epub": ("one/metadata.opf", "one/cover.png"), "one/b.pdf": ("one/metadata.opf", "one/cover.png"), "two/x.epub": (None, None), "two/y.epub": (None, None)}


def test_prose_and_files_carried_on():
    from quirelake.operators.assembly import Chapter
    from quirelake.operators.markup import read
    from quirelake.sources import books

    assert books.opens_with_text(read("<p>went on, and so it was.</p>")) and not books.opens_with_text(read("<h1>One</h1>")) and not books.opens_with_text(read("<p>THE MERCHANT</p>")) and not books.opens_with_text(read("<img src=x><p>a b.</p>"))
    made = [Chapter(read("<p>" + "word " * 300 + "</p>"), "a"), Chapter(read("<p>and so on.</p>"), "b"), Chapter(read("<p>more.</p>"), "c", "Other")]
    books.mark_carried_on(made, [True] * 3, [])
    assert [c.continues for c in made] == [False, True, False]


def test_catalogue_answers(spark):
    import json

    from quirelake.sources import catalogues as c

    doc = {"key": "/works/OL1W", "title": "Caliban's War (The Expanse, #2)", "author_name": ["James Corey", "James Corey"], "first_publish_year": 2012, "cover_i": 7}
    other = {"key": "/works/OL2W", "title": "Arcade Games", "author_name": ["Xan Yu"]}
    book = {"id": 5, "title": "Caliban's War", "contributions": [{"author": {"name": "James Corey"}}, {"author": {"name": "Z"}, "contribution": "Narrator"}], "book_series": [{"position": 2, "series": {"id": 9, "canonical_id": 3, "name": "The Expanse"}}], "image": {"id": 1, "url": "https://x.org/a.jpg"}}
    rows = [(1, "openlibrary", 1, json.dumps({"docs": [doc, other, {"key": "bad"}]})), (1, "hardcover", 1, json.dumps({"data": {"books": [book]}})), (2, "openlibrary", 1, "oops"), (2, "hardcover", 1, json.dumps({"errors": [{"message": "no"}]})), (3, "openlibrary", 1, json.dumps({"docs": []})), (3, "openlibrary", 2, json.dumps({"docs": [other]}))]
    answers = spark.createDataFrame([(i, s, st, "Calibans War", "James Corey", b) for i, s, st, b in rows], "lookup long, source string, stage int, title string, author string, body string")
    got = c.matches(answers).collect()
    assert {(r.lookup, r.problem) for r in got if r.problem} == {(2, "the catalogue could not search just now"), (2, "could not look it up: no")}
    assert {(r.key, r.title, tuple(r.series), r.author, r.cover_id) for r in got if r.lookup == 1} == {("/works/OL1W", "Caliban's War", ("The Expanse #2",), "James Corey", 7), ("/works/OL2W", "Arcade Games", (), "Xan Yu", None), ("hardcover:5", "Caliban's War", ("The Expanse #2",), "James Corey", 1)}
    typed = spark.createDataFrame([(1, "Caliban's War", "James Corey"), (3, "Nothing", "Xan Yu")], "lookup long, want_title string, want_author string")
    assert [(r.lookup, r.key) for r in c.lookup_results(answers, typed).orderBy("lookup", "place").collect()] == [(1, "hardcover:5"), (1, "/works/OL1W"), (3, "/works/OL2W")]
    assert c.series_ids([book], "Caliban's War", "J. Corey") == [3] and c.fitting_edition(book | {"editions": [{"title": "Krieg"}]}, "Krieg", "") == {"title": "Krieg"}
    assert c.listed_series({"name": "S", "book_series": [{"position": "1", "book": {"id": 1, "title": "A (S #1)", "release_date": "2030-01-01"}}, {"position": None, "book": {"id": 2, "title": "B"}}]}, "2026-01-01") == [{"number": 1.0, "title": "A", "author": "", "upcoming": True, "url": "https://hardcover.app/id/book/1"}]
    assert c.public_url("https://10.0.0.1/x") is None and c.public_url("http://x.org") is None and c.public_url("https://a.x.org/y") and c.public_url("https://q.internal/") is None
