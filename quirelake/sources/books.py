"""Book files end to end: any supported file as sections, contents and details, and converted books as EPUB files again.

Files come from `formats.book_files`; a file is one unit of work, and one that can't be read has an error in its row.
"""

from __future__ import annotations

import html as entities
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from quirelake.functions import titles
from quirelake.operators import assembly, markup, styles
from quirelake.operators.assembly import Chapter, Entry, Section
from quirelake.operators.markup import BLOCKS, HEADINGS, Context, Node, text_of
from quirelake.sources import formats, mobi, plain

# Fixed values.
EXTENSIONS = "epub mobi prc azw azw3 kf8 pdf md markdown txt text".split()
CARRIED_ON_MIN, TITLE_MAX = 1000, 80


# -- reading -------------------------------------------------------------------------------------------------------


def opens_with_text(root: Node) -> bool:
    """A chapter begins with prose: no picture, no heading, and not a short line without an end mark."""

    def first(node: Node, block: Node | None) -> tuple[Node | str, Node | None] | None:
        for c in node.children:
            if isinstance(c, str):
                if c.strip():
                    return c, block
            elif c.tag in ("img", "svg", "image"):
                return c, block
            elif c.tag != "hr" and (found := first(c, c if c.tag in BLOCKS else block)):
                return found
        return None

    found = first(root, None)
    if not found or not isinstance(found[0], str):
        return False
    text, block = found
    if block is not None and (block.tag in HEADINGS or any(n.tag in HEADINGS and text in text_of(n) for n in root.nodes() if block in list(n.nodes()))):
        return False
    words = markup.collapsed(text_of(block) if block is not None else text)
    return not (len(words) < TITLE_MAX and re.search(r"[^\W_]$", words))


def mark_carried_on(chapters: list[Chapter], linear: list[bool], contents: list[Entry]) -> None:
    """A file carries on the one before if nothing leads to it, titles agree, it begins with prose, and the run so far
    holds enough text. Each answer changes the run, so this is one fold."""
    goals = {e.key.split("#")[0] for e in contents}
    goals |= {n.attrs["data-link"] for c in chapters for n in c.root.nodes() if n.tag == "a" and "#" not in n.attrs.get("data-link", "#")}
    size = 0
    for i, c in enumerate(chapters):
        before = chapters[i - 1] if i else None
        c.continues = bool(before and linear[i - 1] and linear[i] and c.key not in goals and (before.title or "") == (c.title or "") and size >= CARRIED_ON_MIN and opens_with_text(c.root))
        size = (size if c.continues else 0) + len(text_of(c.root))


Book = tuple[dict, list[Section], list[dict]]


def _details(**more: object) -> dict:
    return {"title": "", "author": "", "language": "", "series": [], "isbns": [], "css": "", "cover": None} | more


def from_epub(data: bytes) -> Book:
    """A08."""
    found = formats.read_epub(data)
    named = [re.search(r"<title[^>]*>([^<]*)</title>", c["html"], re.I) for c in found["chapters"]]
    names = [entities.unescape(m[1]).strip() if m else "" for m in named]
    useful = len({n for n in names if n}) > 1  # D21
    images = set(found["images"])
    chapters = []
    for c, name in zip(found["chapters"], names, strict=True):
        at = c["path"]

        def image(src: str, at: str = at) -> str | None:
            path = formats.resolve_path(at, src)
            return None if re.match(r"(data:|https?:)", src, re.I) or path not in images else "images/" + re.sub(r"[^A-Za-z0-9_.-]+", "_", path)

        def link(href: str, at: str = at) -> str | None:
            file, _, part = href.partition("#")
            return None if re.match(r"[a-z]+:", href, re.I) else (formats.resolve_path(at, file) if file else at) + (f"#{part}" if part else "")

        chapters.append(Chapter(markup.normalised(c["html"], Context(image, link)), at, (name or None) if useful else None))
    contents = [Entry(r["title"], (r["target"] + (f"#{r['href'].partition('#')[2]}" if "#" in r["href"] else "")), r["depth"], r["parent"]) for r in found["contents"]]
    mark_carried_on(chapters, [c["linear"] for c in found["chapters"]], contents)
    sections, rows = assembly.assemble(chapters, contents)
    meta = _details(**{k: found[k] for k in ("title", "author", "language", "isbns", "cover")}, css=styles.stylesheet(found["css"], ".book-content"))
    return meta | {"series": [(s["name"], s["position"], s["position_end"]) for s in found["series"]]}, sections, rows


def from_text(data: bytes) -> Book:
    """Plain text names no title of its own."""
    root = markup.normalised(f"<body>{plain.text_to_html(formats.decode_text(data))}</body>")
    return (_details(), *assembly.assemble([Chapter(root, "text")], []))


def from_markdown(data: bytes) -> Book:
    """A17."""
    meta, body = formats.front_matter(formats.decode_text(data))
    heading = re.search(r"^#\s+(.+)$", body, re.M)
    root = markup.normalised(f"<body>{plain.markdown_to_html(body)}</body>", Context(link=lambda h: f"md{h}" if h.startswith("#") else None))
    said = _details(title=meta.get("title") or (heading[1].strip() if heading else ""), author=meta.get("author", ""), language=meta.get("lang") or meta.get("language", ""), series=titles.series_from_front_matter(meta))
    return (said, *assembly.assemble([Chapter(root, "md")], []))


def format_of(data: bytes, name: str) -> str | None:
    """A03 for one file."""
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if data[:4] == b"%PDF":
        return "pdf"
    if data[:2] == b"PK" and (ext == "epub" or b"META-INF/container.xml" in data or b"mimetypeapplication/epub+zip" in data):
        return "epub"
    if data[60:68] in (b"BOOKMOBI", b"TEXtREAd"):
        return "mobi"
    known = {"mobi": "prc azw azw3 kf8", "md": "markdown", "txt": "text"}
    return next((k for k in ("epub", "mobi", "pdf", "md", "txt") if ext == k or ext in known.get(k, "").split()), "txt" if not ext else None)


READERS: dict[str, Callable[[bytes], Book]] = {"epub": from_epub, "mobi": mobi.from_mobi, "txt": from_text, "md": from_markdown}


def convert(data: bytes, name: str) -> Book:
    """A file by its kind, its details filled in from its name and from a series in its title."""
    kind = format_of(data, name)
    if kind not in READERS:
        raise ValueError(f"unsupported file type: {kind or name}")
    meta, sections, rows = READERS[kind](data)
    title, series = titles.with_filename_details(meta["title"], meta["series"], name)
    title, series = titles.with_title_series(title, titles.unique_series(series))
    return meta | {"title": title, "series": series, "format": kind}, sections, rows


def read_metadata(data: bytes, name: str) -> dict:
    """Details alone, without converting the book."""
    kind = format_of(data, name)
    if kind == "epub":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            opf = next(n for n in z.namelist() if n.lower().endswith(".opf"))
            found = formats.package_details(z.read(opf))
        meta = _details(**{k: found[k] for k in ("title", "author", "language", "isbns")}, series=[(s["name"], s["position"], s["position_end"]) for s in found["series"]])
    elif kind == "mobi":
        meta = _details() | mobi.read_metadata(data)
    elif kind == "md":
        matter, body = formats.front_matter(formats.decode_text(data))
        heading = re.search(r"^#\s+(.+)$", body, re.M)
        meta = _details(title=matter.get("title") or (heading[1].strip() if heading else ""), author=matter.get("author", ""), language=matter.get("lang") or matter.get("language", ""), series=titles.series_from_front_matter(matter))
    else:
        meta = _details()
    title, series = titles.with_filename_details(meta["title"], meta["series"], name)
    return meta | {"title": title, "series": series, "format": kind}


_ROWS = "path string, kind string, ord int, title string, html string, chars int, section int, id string, depth int, parent int, author string, language string, format string, series array<string>, isbns array<string>, error string"


def converted(files: DataFrame) -> DataFrame:
    """Rows of kind `book`, `section` and `contents` of each file (path, name, content), or its error."""
    names = [p.split()[0] for p in _ROWS.split(", ")]

    def rows_of(path: str, name: str, data: bytes) -> list[dict]:
        try:
            meta, sections, contents = convert(data, name)
        except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, UnicodeError) as e:
            return [{"path": path, "kind": "book", "error": str(e)[:1000]}]
        series = [f"{n} #{a:g}" + (f"-{b:g}" if b else "") if a is not None else n for n, a, b in meta["series"]]
        out = [{"path": path, "kind": "book", "title": meta["title"], "author": meta["author"], "language": meta["language"], "format": meta["format"], "series": series, "isbns": meta["isbns"], "chars": sum(s.chars for s in sections)}]
        out += [{"path": path, "kind": "section", "ord": i, "title": s.title, "html": markup.written(Node("#root", {}, s.nodes)), "chars": s.chars, "section": i} for i, s in enumerate(sections)]
        return out + [{"path": path, "kind": "contents", "ord": i} | r for i, r in enumerate(contents)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, name, data in zip(b["path"], b["name"], b["content"], strict=True):
                t = pd.DataFrame(rows_of(path, name, bytes(data))).reindex(columns=names)
                yield t.astype({n: "Int32" for n in ("ord", "chars", "section", "depth", "parent")}).astype(object).where(lambda x: x.notna(), None)

    return files.select("path", "name", "content").mapInPandas(run, _ROWS)


def with_sidecars(files: DataFrame) -> DataFrame:
    """Books among files (path, name, ext) with the package file and the cover that go with them: named alike, or
    `metadata.opf` and `cover.*` in a folder that holds one book."""
    from pyspark.sql import functions as F

    base = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    f = files.withColumns({"folder": F.regexp_extract("path", r"^(.*/)", 1), "base": base})
    books = f.where(F.col("ext").isin(EXTENSIONS))
    alone = books.groupBy("folder").agg((F.countDistinct("base") == 1).alias("alone"))
    covers = f.where(F.col("ext").isin("jpg", "jpeg", "png", "gif", "webp")).withColumn("_rank", F.array_position(F.array(*map(F.lit, ("jpg", "jpeg", "png", "gif", "webp"))), F.col("ext")))
    found = books.join(alone, "folder")
    for name, side, generic in (("opf", f.where("ext = 'opf'").withColumn("_rank", F.lit(1)), "metadata"), ("cover", covers, "cover")):
        best = side.groupBy("folder", "base").agg(F.min_by("path", "_rank").alias("_at"))
        own = best.select("folder", "base", F.col("_at").alias("_own"))
        any_ = best.where(F.col("base") == generic).select("folder", F.col("_at").alias("_any"))
        found = found.join(own, ["folder", "base"], "left").join(any_, "folder", "left")
        found = found.withColumn(name, F.coalesce("_own", F.when(F.col("alone"), F.col("_any")))).drop("_own", "_any")
    return found.drop("folder", "base", "alone")


# -- writing -------------------------------------------------------------------------------------------------------

_XML_UNSAFE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f￾￿\ud800-\udfff]")
_CONTAINER = '<?xml version="1.0" encoding="utf-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
_CSS = ".book-content p.scene-break { text-align: center; text-indent: 0; margin: 0.9em 0 }\n.book-content img { max-width: 100%; height: auto }\n.book-content .anchor { display: inline }\n"


def _xml(text: object) -> str:
    return entities.escape(_XML_UNSAFE.sub("", str(text or "")))


def part_name(section: int) -> str:
    return f"part-{section + 1}.xhtml"


def export_node(node: Node | str, ids: list[set[str]], images: set[str], used: set[str], in_sup: bool = False, notes: frozenset[str] = frozenset()) -> str:
    """A section's node as XHTML: links lead to parts, pictures to files, a scene break is three asterisks again."""
    if isinstance(node, str):
        return _xml(node)
    a, name = dict(node.attrs), node.tag
    inner = lambda: "".join(export_node(c, ids, images, used, in_sup or name == "sup", notes) for c in node.children)
    body = None
    if name == "img":
        if a.get("data-src") not in images:
            return ""
        used.add(a["data-src"])
        a = {"src": "../" + quote(a["data-src"]), "alt": a.get("alt", "")} | {k: v for k, v in a.items() if k not in ("loading", "alt")}
    elif name == "a":
        to = a.get("data-sec", "")
        if to.isdigit() and int(to) < len(ids):
            goal = a.get("data-id", "") if a.get("data-id") in ids[int(to)] else ""
            a["href"] = part_name(int(to)) + (f"#{goal}" if goal else "")
            if goal in notes and in_sup:
                a["epub:type"] = "noteref"
        elif not re.match(r"(https?:|mailto:)", a.get("href", ""), re.I):
            a.pop("href", None)
    elif name == "hr" and "scene-break" in a.get("class", "").split():
        name, body = "p", "* * *"
    types = " ".join(t for t in a.get("data-type", "").split() if ":" not in t)
    if types:
        a.setdefault("epub:type", types)
    attrs = "".join(f' {k}="{_xml(v)}"' for k, v in a.items() if not k.startswith("data-"))
    body = inner() if body is None else body
    return f"<{name}{attrs}/>" if name in markup.VOID else f"<{name}{attrs}>{body}</{name}>"


def _document(title: str, language: str, body: str) -> str:
    lang = f' lang="{_xml(language)}" xml:lang="{_xml(language)}"' if language else ""
    return f'<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"{lang}><head><meta charset="utf-8"/><title>{_xml(title)}</title><link rel="stylesheet" type="text/css" href="../styles/book.css"/></head><body>\n{body}\n</body></html>'


def metadata(book: dict, made: datetime) -> str:
    """A book's details as a package has them: a row an author, and series as collections."""
    import hashlib

    h = bytearray(hashlib.sha1(f"ereader:{book['id']}".encode()).digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x50, h[8] & 0x3F | 0x80
    hexed = h.hex()
    lines = [f'<dc:identifier id="book-id">urn:uuid:{hexed[:8]}-{hexed[8:12]}-{hexed[12:16]}-{hexed[16:20]}-{hexed[20:]}</dc:identifier>']
    lines += [f"<dc:identifier>urn:isbn:{i}</dc:identifier>" for i in book.get("isbns") or [] if re.fullmatch(r"\d{13}", i)]
    lines.append(f"<dc:title>{_xml(book.get('title') or 'Untitled')}</dc:title>")
    for i, name in enumerate(filter(None, (a.strip() for a in (book.get("author") or "").split(";"))), 1):
        lines += [f'<dc:creator id="author-{i}">{_xml(name)}</dc:creator>', f'<meta refines="#author-{i}" property="role" scheme="marc:relators">aut</meta>']
    lines.append(f"<dc:language>{_xml(book.get('language') or 'und')}</dc:language>")
    if book.get("genre"):
        lines.append(f"<dc:subject>{_xml(book['genre'])}</dc:subject>")
    lines.append(f'<meta property="dcterms:modified">{made:%Y-%m-%dT%H:%M:%SZ}</meta>')
    for i, (name, at, _) in enumerate(book.get("series") or [], 1):
        lines += [f'<meta property="belongs-to-collection" id="c{i}">{_xml(name)}</meta>', f'<meta refines="#c{i}" property="collection-type">{"set" if at is None else "series"}</meta>']
        lines += [] if at is None else [f'<meta refines="#c{i}" property="group-position">{at:g}</meta>']
    numbered = next((s for s in book.get("series") or [] if s[1] is not None), None)
    if numbered:
        lines += [f'<meta name="calibre:series" content="{_xml(numbered[0])}"/>', f'<meta name="calibre:series_index" content="{numbered[1]:g}"/>']
    return "\n".join(lines)


def _tree(rows: list[dict], ids: list[set[str]]) -> list[tuple[int, str, str]]:
    """(depth, title, href) of the contents; entries below one that leads nowhere take its place."""
    depth: dict[int, int] = {}
    out = []
    for i, r in enumerate(rows):
        up = depth.get(r["parent"], -1) if r.get("parent") is not None else -1
        if r.get("section") is None or r["section"] >= len(ids):
            depth[i] = up
            continue
        depth[i] = up + 1
        goal = r["id"] if r.get("id") in ids[r["section"]] else ""
        out.append((up + 1, r["title"] or "Untitled", f"text/{part_name(r['section'])}" + (f"#{goal}" if goal else "")))
    return out


def _nested(entries: list[tuple[int, str, str]], open_: str, shut: str, item: Callable[[int, str, str], str], end: str) -> str:
    out, depth = [open_], 0
    for k, (d, title, href) in enumerate(entries):
        if k:
            out += [open_] * (d - depth) if d > depth else [end + (shut + end) * (depth - d)]
        out.append(item(k, title, href))
        depth = d
    return "".join(out) + (end + shut) * (depth + 1)


def build_epub(book: dict, sections: list[tuple[str, str]], contents: list[dict], images: dict[str, bytes] | None = None, cover: tuple[str, bytes] | None = None, made: datetime | None = None) -> bytes:
    """A converted book (details; sections as title and HTML; contents) as an EPUB 3 with NCX."""
    images, used = images or {}, set()
    roots = [markup.read(h) for _, h in sections]
    ids = [{n.id for n in r.nodes() if n.id} for r in roots]
    notes = frozenset(n.id for r in roots for s in r.nodes() if s.tag == "section" and "endnotes" in s.attrs.get("class", "") for n in s.nodes() if n.id and "footnote" in n.attrs.get("class", ""))
    title, language = book.get("title") or "Untitled", book.get("language") or ""
    parts = [_document(t or title, language, '<div class="book-content">' + "".join(export_node(c, ids, set(images), used, notes=notes) for c in r.children) + "</div>") for (t, _), r in zip(sections, roots, strict=True)]
    entries = _tree(contents, ids) or [(0, title, f"text/{part_name(0)}")]
    nav = _nested(entries, "<ol>", "</ol>", lambda _, t, h: f'<li><a href="{_xml(h)}">{_xml(t)}</a>', "</li>")
    ncx = _nested(entries, "", "", lambda k, t, h: f'<navPoint id="np-{k + 1}" playOrder="{k + 1}"><navLabel><text>{_xml(t)}</text></navLabel><content src="{_xml(h)}"/>', "</navPoint>")
    kind = lambda n: {"jpg": "image/jpeg", "svg": "image/svg+xml"}.get(n.rpartition(".")[2], f"image/{n.rpartition('.')[2]}")
    items = ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>', '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', '<item id="css" href="styles/book.css" media-type="text/css"/>']
    items += [f'<item id="part-{i + 1}" href="text/{part_name(i)}" media-type="application/xhtml+xml"/>' for i in range(len(parts))]
    items += [f'<item id="img-{i}" href="{_xml(quote(n))}" media-type="{kind(n)}"/>' for i, n in enumerate(sorted(used), 1)]
    items += [f'<item id="cover-image" href="cover.{cover[0]}" media-type="{kind("." + cover[0])}" properties="cover-image"/>'] if cover else []
    spine = "".join(f'<itemref idref="part-{i + 1}"/>' for i in range(len(parts)))
    shown = metadata(book, made or datetime.now()) + ('\n<meta name="cover" content="cover-image"/>' if cover else "")
    opf = f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="book-id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n{shown}\n</metadata><manifest>{"".join(items)}</manifest><spine toc="ncx">{spine}</spine></package>'
    files = [("mimetype", b"application/epub+zip", True), ("META-INF/container.xml", _CONTAINER.encode(), False), ("OEBPS/content.opf", opf.encode(), False)]
    files.append(("OEBPS/nav.xhtml", _document("Contents", language, f'<nav epub:type="toc" id="toc"><h1>Contents</h1>{nav}</nav>').encode(), False))
    files.append(("OEBPS/toc.ncx", f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{_xml(title)}</text></docTitle><navMap>{ncx}</navMap></ncx>'.encode(), False))
    files.append(("OEBPS/styles/book.css", (_CSS + (book.get("css") or "")).encode(), False))
    files += [(f"OEBPS/text/{part_name(i)}", p.encode(), False) for i, p in enumerate(parts)]
    files += [(f"OEBPS/{n}", images[n], True) for n in sorted(used)]
    files += [(f"OEBPS/cover.{cover[0]}", cover[1], True)] if cover else []
    return formats.write_zip(files)


def exported(built: DataFrame) -> DataFrame:
    """A21 over converted books (rows of `converted`): (path, name, content), an EPUB file a book."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        book = t[t["kind"] == "book"].iloc[0]
        s, c = (t[t["kind"] == k].sort_values("ord") for k in ("section", "contents"))
        clean = lambda v: None if pd.isna(v) else int(v)
        rows = [{"title": r.title, "section": clean(r.section), "id": r.id, "parent": clean(r.parent)} for r in c.itertuples()]
        meta = {"id": book["path"], "title": book["title"], "author": book["author"], "language": book["language"], "isbns": list(book["isbns"] if book["isbns"] is not None else []), "series": []}
        made = build_epub(meta, list(zip(s["title"], s["html"], strict=True)), rows, made=datetime(2000, 1, 1)) if len(s) else None
        return pd.DataFrame([(book["path"], titles.epub_file_name(book["title"], book["author"]), made)], columns=["path", "name", "content"])

    return built.groupBy("path").applyInPandas(run, "path string, name string, content binary")
