"""Book files as tables: format detection, archives, EPUB packages, text and Markdown.

Files come from Spark's `binaryFile` source, so listing, splitting and retries are Spark's. Parsing is Python over
Arrow batches, a file at a time; everything after it is DataFrame work.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import titles

# What files begin with.
IMAGE_HEADS = {"jpg": "FFD8", "png": "8950", "gif": "4749", "bmp": "424D"}


def book_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder, hidden ones aside, with name, extension and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "length", "content").where(~F.col("name").startswith("."))


def skipped(files: DataFrame, kept: list[str]) -> DataFrame:
    """How many files of other kinds there are, the most first."""
    return files.where(~F.col("ext").isin(kept)).groupBy("ext").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext")


def detect_format(content: Column, name: Column) -> Column:
    """By first bytes, then by extension; without one it is text; null if unknown."""
    has = lambda text: F.instr(F.hex(content), F.hex(F.lit(text))) > 0
    head = lambda a, n: F.substring(content, a, n)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = F.when(ext.isin("epub", "pdf", "mobi"), ext).when(ext.isin("azw", "azw3", "prc", "kf8"), "mobi").when(ext.isin("md", "markdown"), "md").when(ext.isin("txt", "text", ""), "txt")
    kind = F.hex(head(61, 8))
    return (
        F.when(F.hex(head(1, 4)) == "25504446", "pdf")
        .when((F.hex(head(1, 2)) == "504B") & ((ext == "epub") | has("META-INF/container.xml") | has("mimetypeapplication/epub+zip")), "epub")
        .when((kind == F.hex(F.lit("BOOKMOBI"))) | (kind == F.hex(F.lit("TEXtREAd"))), "mobi")
        .otherwise(known)
    )


def sniff_image(content: Column, name: Column) -> Column:
    """An image's kind by first bytes, then by name."""
    out = None
    for kind, head in IMAGE_HEADS.items():
        hit = F.hex(F.substring(content, 1, len(head) // 2)) == head
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    out = out.when((F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp")
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return out.otherwise(F.when(ext == "jpeg", "jpg").when(ext != "", ext))


def image_size(data: bytes) -> tuple[int, int] | None:
    """Pixels of a PNG, GIF, WebP (extended) or JPEG header."""
    if data[:4] == b"\x89PNG" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:3] == b"GIF" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[12:16] == b"VP8 " and len(data) >= 30:
        return int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
    if data[:4] == b"RIFF" and data[12:16] == b"VP8L" and len(data) >= 25:
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if data[:4] == b"RIFF" and data[12:16] == b"VP8X" and len(data) >= 30:
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def decode_text(data: bytes) -> str:
    """UTF-16 by its mark, else UTF-8; Latin-1 if more than a few bytes of it can't be UTF-8."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    text = data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    bad = text.count("�")
    return data.decode("latin-1") if bad > 2 and bad > 0.0005 * len(text) else text


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Flat key: value lines between --- lines at the top, and the text behind them."""
    m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", text, re.S)
    if not m:
        return {}, text
    pairs = (re.match(r"([A-Za-z_][\w-]*)\s*:\s*(.*)$", line) for line in m[1].splitlines())
    return {p[1].lower(): p[2].strip().strip("\"'") for p in pairs if p and p[2].strip()}, text[m.end() :]


def resolve_path(base: str, href: str) -> str:
    """A link inside an archive, from the file it stands in; without fragment and query."""
    path = unquote(re.split("[?#]", href, maxsplit=1)[0])
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), path)).lstrip("/") if path else base


def _local(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    """All elements of a name, whatever their namespace."""
    return [e for e in node.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == name]


def _text(e: ElementTree.Element) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def isbn13(value: str, marked: bool = False) -> str | None:
    """J18 for one value: 13 digits with a right check digit, or 10 that are marked as an ISBN."""
    m = re.match(r"(?:urn:)?isbn(?:[-\s]?1[03])?(?:\s*:\s*|\s+)", value.strip(), re.I)
    d = re.sub(r"[\s-]", "", re.match(r"(?:[0-9X][0-9X\s-]*)?", value.strip()[m.end() if m else 0 :], re.I)[0]).upper()
    if re.fullmatch(r"97[89]\d{10}", d) and sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(d)) % 10 == 0:
        return d
    if (m or marked) and re.fullmatch(r"\d{9}[\dX]", d) and sum((10 - i) * (10 if c == "X" else int(c)) for i, c in enumerate(d)) % 11 == 0:
        body = "978" + d[:9]
        return body + str(-sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(body)) % 10)
    return None


def package_details(opf: bytes | ElementTree.Element) -> dict:
    """Title, creators joined by ", ", language, ISBNs and series of a package, "" where it names none.

    The title is the main one by its type. Series are collections and the library program's own; sets come last.
    """
    root = ElementTree.fromstring(opf) if isinstance(opf, bytes) else opf
    meta = next(iter(_local(root, "metadata")), root)
    metas, names = _local(meta, "meta"), _local(meta, "title")
    refined: dict[str, dict[str, str]] = {}
    for m in metas:
        if m.get("refines") and m.get("property"):
            refined.setdefault(m.get("refines").lstrip("#"), {}).setdefault(m.get("property").lower(), _text(m))
    kind = lambda e: refined.get(e.get("id", ""), {}).get("title-type", "").lower()
    main = next((t for t in names if kind(t) == "main"), None) or next((t for t in names if kind(t) not in titles.NOT_MAIN_TITLES), None)
    main = names[0] if main is None and names else main
    series, sets = [], []
    for m in metas:
        if (m.get("property") or "").lower() == "belongs-to-collection" and not m.get("refines"):
            more = refined.get(m.get("id", ""), {})
            (sets if more.get("collection-type", "").lower() == "set" else series).append((_text(m), more.get("group-position"), None))
    named = {(m.get("name") or "").lower(): m.get("content", "") for m in reversed(metas) if m.get("name")}
    if named.get("calibre:series"):
        series.append((named["calibre:series"], named.get("calibre:series_index"), None))
    sets += [(_text(t), None, None) for t in names if kind(t) == "collection"]
    scheme = lambda e: any(k.rpartition("}")[2] == "scheme" and v.lower() == "isbn" for k, v in e.attrib.items())
    found = [isbn13(_text(e), scheme(e)) for n in ("identifier", "source") for e in _local(meta, n)]
    return {
        "title": _text(main) if main is not None else "", "author": ", ".join(filter(None, map(_text, _local(meta, "creator")))), "language": next((t for e in _local(meta, "language") if (t := _text(e))), ""),
        "isbns": list(dict.fromkeys(filter(None, found))), "series": [{"name": n, "position": a, "position_end": b} for n, a, b in titles.unique_series([*series, *sets])],
    }


def _contents_nav(html: bytes, path: str) -> list[dict]:
    rows: list[dict] = []

    def walk(ol: ElementTree.Element, depth: int, parent: int | None) -> None:
        for li in (e for e in ol if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "li"):
            link = next((e for e in li if e.tag.rpartition("}")[2] in ("a", "span")), None)
            here = parent
            if link is not None:
                here = len(rows)
                rows.append({"title": _text(link), "href": link.get("href", ""), "depth": depth, "parent": parent})
            for sub in (e for e in li if e.tag.rpartition("}")[2] == "ol"):
                walk(sub, depth + 1, here)

    root = ElementTree.fromstring(html)
    navs = [n for n in _local(root, "nav") if any(k.endswith("type") and "toc" in v.split() for k, v in n.attrib.items())] or _local(root, "nav")
    for ol in (e for n in navs[:1] for e in n if e.tag.rpartition("}")[2] == "ol"):
        walk(ol, 0, None)
    return [r | {"target": resolve_path(path, r["href"]) if r["href"] else ""} for r in rows]


def _contents_ncx(xml: bytes, path: str) -> list[dict]:
    rows: list[dict] = []

    def walk(node: ElementTree.Element, depth: int, parent: int | None) -> None:
        for point in (e for e in node if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "navPoint"):
            label, src = _local(point, "text"), _local(point, "content")
            rows.append({"title": _text(label[0]) if label else "", "href": src[0].get("src", "") if src else "", "depth": depth, "parent": parent})
            walk(point, depth + 1, len(rows) - 1)

    for m in _local(ElementTree.fromstring(xml), "navMap")[:1]:
        walk(m, 0, None)
    return [r | {"target": resolve_path(path, r["href"]) if r["href"] else ""} for r in rows]


def _is_html(path: str) -> bool:
    return bool(re.search(r"\.x?html?$", path, re.I))


def read_epub(data: bytes) -> dict:
    """Details, files in reading order, flat contents (nav first, then NCX), styles and the cover's path.

    Without a container the first package in the archive counts, and without a spine all HTML files by name.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        there = set(z.namelist())
        opf_path = ""
        if "META-INF/container.xml" in there:
            opf_path = next((r.get("full-path", "") for r in _local(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")), "")
        if opf_path not in there:
            opf_path = next((n for n in z.namelist() if n.lower().endswith(".opf")), "")
        if not opf_path:
            raise KeyError("no package document")
        root = ElementTree.fromstring(z.read(opf_path))
        items = {e.get("id"): e for e in _local(root, "item") if e.get("href")}
        href = lambda e: resolve_path(opf_path, e.get("href", ""))
        has = lambda e, word: word in (e.get("properties") or "").split()
        spine = [(href(items[r.get("idref")]), (r.get("linear") or "yes") != "no") for r in _local(root, "itemref") if r.get("idref") in items]
        spine = [(p, linear) for p, linear in spine if p in there and _is_html(p)] or [(n, True) for n in sorted(there) if _is_html(n)]
        if not spine:
            raise KeyError("no readable chapters")
        chapters = [{"path": p, "html": decode_text(z.read(p)), "linear": linear} for p, linear in spine]
        nav = next((href(e) for e in items.values() if has(e, "nav")), None)
        ncx = next((href(e) for e in items.values() if e.get("media-type") == "application/x-dtbncx+xml" or href(e).lower().endswith(".ncx")), None)
        contents = _contents_nav(z.read(nav), nav) if nav in there else []
        if not contents and ncx in there:
            contents = _contents_ncx(z.read(ncx), ncx)
        css = [decode_text(z.read(href(e))) for e in items.values() if e.get("media-type") == "text/css" and href(e) in there]
        css += [m for c in chapters for m in re.findall(r"<style[^>]*>(.*?)</style>", c["html"], re.S | re.I)]
        pictures = [n for n in there if re.search(r"\.(jpe?g|png|gif|webp|svg|bmp)$", n, re.I)]
        meant = next((m.get("content") for m in _local(root, "meta") if (m.get("name") or "").lower() == "cover"), None)
        cover = next((href(e) for e in [items.get(meant), *(e for e in items.values() if has(e, "cover-image")), *(e for e in items.values() if "image/" in (e.get("media-type") or "") and "cover" in (e.get("id", "") + e.get("href", "")).lower())] if e is not None and href(e) in there), None)
        if cover is None:
            guide = next((href(r) for r in _local(root, "reference") if "cover" in (r.get("type") or "").lower()), spine[0][0])
            shown = re.search(r"(?:src|xlink:href|href)=[\"']([^\"']+\.(?:jpe?g|png|gif|webp))[\"']", decode_text(z.read(guide)) if guide in there else "", re.I)
            cover = resolve_path(guide, shown[1]) if shown and resolve_path(guide, shown[1]) in there else None
        return package_details(root) | {"chapters": chapters, "contents": contents, "css": "\n".join(css), "cover": cover, "images": sorted(pictures)}


_EPUB = """title string, author string, language string, isbns array<string>, series array<struct<name:string,position:double,position_end:double>>,
chapters array<struct<path:string,html:string,linear:boolean>>, contents array<struct<title:string,href:string,depth:int,parent:int,target:string>>, css string, cover string, images array<string>, error string"""


def epubs(files: DataFrame) -> DataFrame:
    """One row an EPUB with its details, chapters and contents; a file that can't be read has an error instead."""
    names = [part.split()[0] for part in re.split(r",\s*(?![^<]*>)", _EPUB)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                try:
                    found = read_epub(bytes(data)) | {"error": None}
                except (KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    found = dict.fromkeys(names) | {"error": str(e)[:1000]}
                rows.append({"path": path} | found)
            yield pd.DataFrame(rows, columns=["path", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, {_EPUB}")


def write_zip(entries: list[tuple[str, bytes, bool]]) -> bytes:
    """An archive of (name, data, whether it is stored as it is)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, plain in entries:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if plain else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def texts(files: DataFrame) -> DataFrame:
    """Text and Markdown files, decoded, with their front matter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [front_matter(decode_text(bytes(c))) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "details": [f[0] for f in found], "text": [f[1] for f in found]})

    return files.select("path", "content").mapInPandas(run, "path string, details map<string,string>, text string")
