"""Books from chapters: joined files, chapter starts, sections of a size, links, contents and titles.

A book is the unit: its chapters are one group, cut and numbered together. Everything here works on lists of one book's
chapters; `assembled` runs it over a table and gives sections, contents and link targets as rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions.keys import CHAPTER_NAMES, NUMBER_WORDS, ROMAN, UNNUMBERED
from quirelake.operators import markup
from quirelake.operators.markup import HEADINGS, Node, collapsed, text_of
from quirelake.operators.sections import CHAPTER_MIN, cuts

# Fixed values.
SECTION_BUDGET, MAX_CONTENTS, MAX_DEPTH = 150_000, 2000, 4

_LETTER = r"[^\W\d_]"
_NUMBER = rf"(?:\d+|{ROMAN}|(?:{'|'.join(NUMBER_WORDS)})(?:-{_LETTER}+)?|(?:en|to|tre|fire|fem|seks|syv|otte|ni)og{_LETTER}+)(?![^\W_])"
_NAMED = rf"(?:(?:{'|'.join(CHAPTER_NAMES)})\s+{_NUMBER}|(?:{'|'.join(UNNUMBERED)})(?!{_LETTER}))\D*"
_LINE = re.compile(_NAMED, re.I)
_TITLE = re.compile(rf"{_NAMED}|(?:\d+|{ROMAN})\.?", re.I)


def is_chapter_line(text: str) -> bool:
    """A paragraph that names a chapter by its words."""
    return bool(_LINE.fullmatch(text))


def is_chapter_title(text: str) -> bool:
    """A heading that names a chapter, by its words or by a bare number."""
    return bool(_TITLE.fullmatch(text))


@dataclass
class Chapter:
    root: Node
    key: str = ""
    title: str | None = None
    continues: bool = False
    keys: dict[str, str] = field(default_factory=dict)  # id -> the key of the file it came from
    joined: list[str] = field(default_factory=list)  # keys of files read as part of this chapter


@dataclass
class Entry:
    """A line of the contents; `parent` is a place in the list."""

    title: str
    key: str = ""
    depth: int = 0
    parent: int | None = None


@dataclass
class Section:
    nodes: list[Node | str]
    key: str
    title: str | None
    several: bool
    headings: list[tuple[int, str, str]]

    @property
    def chars(self) -> int:
        return sum(len(text_of(n)) for n in self.nodes)


def anchor(name: str) -> Node:
    return Node("span", {"id": name, "class": "anchor"})


# -- joining and finding -------------------------------------------------------------------------------------------


def join_continued(chapters: list[Chapter]) -> tuple[list[Chapter], dict[str, str], dict[str, str]]:
    """Chapters with those that carry them on; each joined one's anchor by its key, and ids that had to change."""
    groups: list[Chapter] = []
    anchors: dict[str, str] = {}
    renamed: dict[str, str] = {}
    used = {n.id for c in chapters for n in c.root.nodes() if n.id}
    met: set[str] = set()

    def fresh(stem: str, n: int) -> str:
        while f"{stem}{n}" in used:
            n += 1
        used.add(f"{stem}{n}")
        return f"{stem}{n}"

    for c in chapters:
        own = c.key not in met
        met.add(c.key)
        if not c.continues or not groups:
            c.keys = {n.id: c.key for n in c.root.nodes() if n.id}
            groups.append(c)
            continue
        g = groups[-1]
        for n in c.root.nodes():
            if not n.id:
                continue
            if n.id in g.keys:
                was, n.attrs["id"] = n.id, fresh(f"{n.id}-", 2)
                renamed[f"{c.key}#{was}"] = n.attrs["id"]
            g.keys[n.id] = c.key
        if own:
            name = anchors[c.key] = fresh("rr-join", 1)
            g.keys[name] = c.key
            g.joined.append(c.key)
            g.root.children.append(anchor(name))
        g.root.children += c.root.children
    return groups, anchors, renamed


class Places:
    """Where keys such as `file`, `file#id` and `#id` lead."""

    def __init__(self, groups: list[Chapter], renamed: dict[str, str]):
        self.renamed = renamed
        self.files: dict[str, int] = {}
        self.by_key: dict[str, tuple[int, Node]] = {}
        self.by_id: dict[str, tuple[int, Node]] = {}
        for i, g in enumerate(groups):
            self.files.setdefault(g.key, i)
            for n in g.root.nodes():
                if n.id:
                    self.by_key[f"{g.keys.get(n.id, g.key)}#{n.id}"] = (i, n)
                    self.by_id.setdefault(n.id, (i, n))

    def of(self, key: str) -> tuple[int, Node | None] | None:
        file, _, part = (key or "").partition("#")
        if part:
            part = self.renamed.get(f"{file}#{part}", part)
            hit = self.by_key.get(f"{file}#{part}") or (None if file else self.by_id.get(part))
            if hit:
                return hit
        return (self.files[file], None) if key and file in self.files else None


def _words(node: Node) -> str:
    spaced = lambda n: n if isinstance(n, str) else (" " if n.tag == "br" else "") + "".join(map(spaced, n.children))
    return collapsed("".join(map(spaced, node.children)))


def _names_chapter(node: Node) -> str | None:
    """The words of an element that is a chapter's title, if it is one and not a link on a contents page."""
    heading = node.tag in HEADINGS
    if not heading and (node.tag not in ("p", "div") or any(isinstance(c, Node) and c.tag in markup.BLOCKS for c in node.children)):
        return None
    words = _words(node)
    if not words or len(words) > 80 or any(n.tag == "a" and ("href" in n.attrs or "data-link" in n.attrs) for n in node.nodes()):
        return None
    marked = "chapter" in node.attrs.get("class", "").lower().split()
    return words if marked or (is_chapter_title if heading else is_chapter_line)(words) else None


def contents_of_headings(heads: list[tuple[int, str, int, str]]) -> list[Entry]:
    """Contents of the two most significant levels of headings (level, text, section, id)."""
    levels = sorted({h[0] for h in heads})[:2]
    out: list[Entry] = []
    top = None
    for level, text, section, name in heads:
        if level == levels[0]:
            top = len(out)
            out.append(Entry(text, f"{section}#{name}"))
        elif level in levels:
            out.append(Entry(text, f"{section}#{name}", 0 if top is None else 1, top))
    tops = [i for i, e in enumerate(out) if not e.depth][:MAX_CONTENTS]
    return [e for i, e in enumerate(out) if (i if not e.depth else e.parent) in set(tops)]


def extents(places: list[tuple[int, int]], total: int) -> list[int]:
    """How much text each entry (position, depth), in order of positions, holds: up to the next no deeper than it.

    One pass with a stack of open entries.
    """
    out, open_ = [0] * len(places), []
    for i, (at, depth) in enumerate(places):
        while open_ and places[open_[-1]][1] >= depth:
            j = open_.pop()
            out[j] = at - places[j][0]
        open_.append(i)
    for j in open_:
        out[j] = total - places[j][0]
    return out


def chosen_titles(titles: list[tuple[int, int, str]]) -> set[int]:
    """E03 over one book's titles (at, end, key): see sections.choose_titles for the same over a table."""
    cluster, size, last = [], {}, {}
    for j, (at, _, key) in enumerate(titles):
        near = j and titles[j - 1][1] == at and at - titles[j - 1][0] < CHAPTER_MIN
        cluster.append(cluster[-1] if near else j)
        size[cluster[-1]] = size.get(cluster[-1], 0) + 1
        last[key] = j
    good = [j for j, (at, end, key) in enumerate(titles) if end - at >= CHAPTER_MIN and (size[cluster[j]] < 3 or last[key] == j)]
    times: dict[str, list[int]] = {}
    for j in good:
        times.setdefault(titles[j][2], []).append(j)
    return {j for js in times.values() for j in (js if len(js) < 3 else js[:1])}


def chapter_starts(groups: list[Chapter], contents: list[Entry], budget: int, renamed: dict[str, str]) -> dict[int, dict[int, tuple[Node, str]]]:
    """For each group the elements where a chapter starts, by identity, with the title found in the text or ''."""
    places = Places(groups, renamed)
    entries = [(e.depth, e.parent, places.of(e.key)) for e in contents]
    if not any(at for _, _, at in entries):
        heads = [(i, n) for i, g in enumerate(groups) for n in g.root.nodes() if n.tag in HEADINGS]
        levels, entries, top = sorted({n.tag for _, n in heads})[:2], [], None
        for i, n in heads:
            if n.tag == levels[0]:
                top = len(entries)
                entries.append((0, None, (i, n)))
            elif n.tag in levels:
                entries.append((0 if top is None else 1, top, (i, n)))
    titled = [(i, n, w) for i, g in enumerate(groups) for n in g.root.nodes() if (w := _names_chapter(n))]

    offsets: dict[int, int] = {}
    bases: list[int] = []
    total = 0

    def measure(node: Node) -> None:
        nonlocal total
        for c in node.children:
            if isinstance(c, str):
                total += len(c)
            else:
                offsets[id(c)] = total
                measure(c)

    for g in groups:
        bases.append(total)
        measure(g.root)
    placed = sorted(((bases[at[0]] if at[1] is None else offsets[id(at[1])], k) for k, (_, _, at) in enumerate(entries) if at), key=lambda x: x[0])
    holds = dict(zip((k for _, k in placed), extents([(p, entries[k][0]) for p, k in placed], total), strict=True))

    def counts(k: int) -> bool:
        parent = entries[k][1]
        return parent is None or ((parent not in holds or holds[parent] > budget) and counts(parent))

    starts: dict[int, dict[int, tuple[Node, str]]] = {}

    def add(group: int, node: Node, title: str) -> None:
        found = starts.setdefault(group, {})
        if not found.get(id(node), (node, ""))[1]:
            found[id(node)] = (node, title)

    for _, k in placed:
        group, node = entries[k][2]
        if node is not None and counts(k):
            add(group, node, "")
    ends = []
    for j, (i, _, _) in enumerate(titled):
        stop = bases[i + 1] if i + 1 < len(bases) else total
        ends.append(min(stop, offsets[id(titled[j + 1][1])]) if j + 1 < len(titled) and titled[j + 1][0] == i else stop)
    for j in sorted(chosen_titles([(offsets[id(n)], ends[j], w.lower()) for j, (_, n, w) in enumerate(titled)])):
        add(titled[j][0], titled[j][1], titled[j][2])
    return starts


# -- cutting -------------------------------------------------------------------------------------------------------


def _blank(n: Node | str) -> bool:
    return isinstance(n, str) and not n.strip()


def _is_anchor(n: Node | str) -> bool:
    return isinstance(n, Node) and n.tag in markup.INLINE and bool(n.id) and not text_of(n).strip() and not any(c.tag == "img" for c in n.nodes())


def _first_content(n: Node | str) -> Node | str | None:
    """What a reader sees of a node first: a text or a picture."""
    if isinstance(n, str):
        return n if n.strip() else None
    return n if n.tag == "img" else next((f for c in n.children if (f := _first_content(c)) is not None), None)


def _edge(n: Node | str, last: bool) -> Iterator[str]:
    """Tags along the first or the last thing in a node, down through wrappers."""
    while isinstance(n, Node):
        yield n.tag
        kids = [c for c in n.children if not _blank(c) and not _is_anchor(c)] if n.tag in markup.WRAPPERS else []
        n = kids[-1 if last else 0] if kids else ""


class _Leaf(str):
    """A text that is told apart from equal ones."""


def _own_texts(node: Node) -> None:
    node.children = [_Leaf(c) if isinstance(c, str) else c for c in node.children]
    for c in node.children:
        if isinstance(c, Node):
            _own_texts(c)


def _leaves(root: Node, starts: dict[int, tuple[Node, str]]) -> dict[int, list[Node]]:
    """By identity, the first text or picture at or after each start, with the starts it begins."""
    out: dict[int, list[Node]] = {}
    waiting: list[Node] = []

    def visit(node: Node) -> None:
        nonlocal waiting
        for c in node.children:
            if isinstance(c, Node) and id(c) in starts:
                waiting.append(c)
            if waiting and (isinstance(c, str) and c.strip() or isinstance(c, Node) and c.tag == "img"):
                out[id(c)] = waiting
                waiting = []
            if isinstance(c, Node):
                visit(c)

    visit(root)
    return out


def _flat(nodes: list[Node | str], budget: int, open_: set[int]) -> list[Node | str]:
    """Nodes with large wrappers opened, and those that a chapter starts inside of; ids stay as anchors."""
    out: list[Node | str] = []
    for n in nodes:
        wraps = isinstance(n, Node) and n.tag in markup.WRAPPERS and (len(text_of(n)) > budget or id(n) in open_)
        if not wraps or not any(isinstance(c, Node) and c.tag in markup.BLOCKS for c in n.children):
            out.append(n)
            continue
        if n.id:
            out.append(anchor(n.id))
        if "text-align" in n.attrs.get("style", ""):
            for c in n.children:
                if isinstance(c, Node):
                    c.attrs.setdefault("style", n.attrs["style"])
        out += _flat(n.children, budget, open_)
    return out


def _without(nodes: list[Node | str], gone: Node) -> None:
    for n in nodes:
        if isinstance(n, Node):
            n.children = [c for c in n.children if c is not gone]
            _without(n.children, gone)


def chunked(root: Node, budget: int, starts: dict[int, tuple[Node, str]] | None = None) -> list[list[Node | str]]:
    """A chapter's nodes in chunks of at most `budget` characters where that can be.

    Each start begins a chunk with the headings in front of it. A longer run is cut in near-equal parts: before a
    heading, behind a rule, or between blocks, and never right behind a heading.
    """
    _own_texts(root)
    leaves = _leaves(root, starts or {})
    if not leaves and len(text_of(root)) <= budget:
        return [list(root.children)]
    open_: set[int] = set()

    def mark(node: Node, above: list[Node]) -> None:
        for c in node.children:
            if id(c) in leaves:
                open_.update(id(a) for a in above if _first_content(a) is not c)
            if isinstance(c, Node):
                mark(c, [*above, c])

    mark(root, [])
    nodes = _flat(root.children, budget, open_)
    placed: list[Node | str] = []
    for n in nodes:  # an empty anchor at the end of the block before goes to where its chapter begins
        inside = {id(x) for x in n.nodes()} | {id(n)} if isinstance(n, Node) else set()
        for s in leaves.get(id(_first_content(n)), []):
            if _is_anchor(s) and id(s) not in inside and not any(x is s for x in nodes):
                _without(nodes, s)
                placed.append(s)
        placed.append(n)
    nodes = placed

    at, before, places, last, first_anchor = 0, [], [], None, None
    for i, n in enumerate(nodes):
        before.append(at)
        if _blank(n) or _is_anchor(n):
            if first_anchor is None and _is_anchor(n):
                first_anchor = (i, at)
        else:
            if last is not None and isinstance(n, Node) and n.tag not in markup.INLINE and not HEADINGS & set(_edge(last, True)):
                rank = 1 if HEADINGS & set(_edge(n, False)) else 2 if "hr" in set(_edge(last, True)) else 3
                places.append((*(first_anchor or (i, at)), rank))
            last, first_anchor = n, None
        at += len(text_of(n))
    before.append(at)

    heads = lambda n: _first_content(n) is None or (isinstance(n, Node) and n.tag in HEADINGS)
    bounds, full = [0], False
    for i, n in enumerate(nodes):
        if full and id(_first_content(n)) in leaves:
            cut = i
            while cut > bounds[-1] and heads(nodes[cut - 1]):
                cut -= 1
            bounds.append(cut)
            full = False
        full = full or not heads(n)
    all_cuts = list(bounds[1:])
    for a, b in zip(bounds, [*bounds[1:], len(nodes)], strict=True):
        inside = [(i, pos - before[a], rank) for i, pos, rank in places if a < i < b]
        all_cuts += [inside[k][0] for k in cuts([(pos, rank) for _, pos, rank in inside], before[b] - before[a], budget)]
    edges = [0, *sorted(all_cuts), len(nodes)]
    return [nodes[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def leading_title(nodes: list[Node | str], starts: dict[int, tuple[Node, str]]) -> str | None:
    """The chapter title in a section's first 200 characters."""
    seen = 0
    found = None

    def visit(list_: list[Node | str]) -> None:
        nonlocal seen, found
        for n in list_:
            if found or seen > 200:
                return
            if isinstance(n, str):
                seen += len(n.strip())
            elif starts.get(id(n), (n, ""))[1]:
                found = starts[id(n)][1]
            else:
                visit(n.children)

    visit(nodes)
    return found


# -- books ---------------------------------------------------------------------------------------------------------


def assemble(chapters: list[Chapter], contents: list[Entry], budget: int = SECTION_BUDGET) -> tuple[list[Section], list[dict]]:
    """A book's sections with links and titles, and its contents as rows (title, section, id, depth, parent)."""
    markup.remove_credits([c.root for c in chapters])
    groups, anchors, renamed = join_continued(chapters)
    starts = chapter_starts(groups, contents, budget, renamed) if math.isfinite(budget) else {}
    sections: list[Section] = []
    files: dict[str, int] = {}
    ids: dict[str, int] = {}
    any_id: dict[str, int] = {}
    for i, g in enumerate(groups):
        parts = chunked(g.root, budget, starts.get(i))
        names = [leading_title(p, starts.get(i, {})) for p in parts]
        several = sum(map(bool, names)) > 1
        for k, part in enumerate(parts):
            at = len(sections)
            if not k:
                files.setdefault(g.key, at)
            heads = markup.headings(part, f"rr{at}")
            for n in Node("#root", {}, part).nodes():
                if n.id:
                    ids[f"{g.keys.get(n.id, g.key)}#{n.id}"] = at
                    any_id.setdefault(n.id, at)
            title = g.title if not k and not several and g.title else names[k]
            sections.append(Section(part, g.key, title, several and bool(names[k]), heads))
        for key in g.joined:
            files.setdefault(key, ids[f"{key}#{anchors[key]}"])

    def resolve(key: str) -> tuple[int, str | None] | None:
        """(section, id) of a link; a changed id by its new name, a joined file by its anchor."""
        file, _, part = (key or "").partition("#")
        if part:
            part = renamed.get(f"{file}#{part}", part)
            hit = ids.get(f"{file}#{part}", None if file else any_id.get(part))
            if hit is not None:
                return hit, part
        return (files[file], part or anchors.get(file)) if key and file in files else None

    for s in sections:
        for a in Node("#root", {}, s.nodes).nodes():
            key = a.attrs.pop("data-link", None) if a.tag == "a" else None
            if key and (to := resolve(key)):
                a.attrs |= {"href": f"#sec={to[0]}" + (f"&id={quote(to[1], safe='')}" if to[1] else ""), "data-sec": str(to[0])} | ({"data-id": to[1]} if to[1] else {})

    rows = _contents([(e, resolve(e.key)) for e in contents])
    if not rows:
        found = [(level, text, i, name) for i, s in enumerate(sections) for level, text, name in s.headings]
        rows = _contents([(e, (int(e.key.split("#")[0]), e.key.split("#", 1)[1])) for e in contents_of_headings(found)])
    if not rows and len(sections) > 1:
        rows = [{"title": s.title or f"Section {i + 1}", "section": i, "id": None, "depth": 0, "parent": None} for i, s in enumerate(sections)]
    title = ""
    for i, s in enumerate(sections):  # E02
        entry = next((r for r in rows if r["section"] == i), None)
        if entry and not (s.several and not entry["id"]):
            title = entry["title"]
        else:
            title = s.title or (s.headings[0][1] if s.headings else title)
        s.title = title
    return sections, rows


def _contents(entries: list[tuple[Entry, tuple[int, str | None] | None]]) -> list[dict]:
    """Flat contents without entries that lead nowhere and have nothing below them (E20: order is reading order)."""
    alive = [to is not None for _, to in entries]
    for i in range(len(entries) - 1, -1, -1):
        if alive[i] and entries[i][0].parent is not None:
            alive[entries[i][0].parent] = True
    place: dict[int, int] = {}
    out = []
    for i, (e, to) in enumerate(entries):
        if alive[i] and e.depth <= MAX_DEPTH and (e.parent is None or e.parent in place):
            place[i] = len(out)
            out.append({"title": e.title.strip() or "Untitled", "section": to[0] if to else None, "id": to[1] if to else None, "depth": e.depth, "parent": place.get(e.parent)})
    return out


def assembled(chapters: DataFrame, contents: DataFrame | None = None, budget: int = SECTION_BUDGET) -> DataFrame:
    """Sections and contents of books: chapters (book, ord, key, html, title, continues), contents (book, ord, title, key,
    depth, parent). Rows (book, kind, ord, title, html, chars, section, id, depth, parent), kind `section` or `contents`.

    A book is one group, as chapters are cut and linked together; books are what the work is spread by.
    """
    kind = chapters.schema["book"].dataType.simpleString()
    out = f"book {kind}, kind string, ord int, title string, html string, chars int, section int, id string, depth int, parent int"
    names = [part.split()[0] for part in out.split(", ")]

    def build(book: object, c: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r in c.sort_values("ord").itertuples():
            link = lambda href, key=r.key: href if not href.startswith("#") else f"{key}{href}"
            parts.append(Chapter(markup.normalised(r.html, markup.Context(link=link)), r.key, r.title or None, bool(r.continues)))
        lines = [Entry(r.title or "", r.key or "", int(r.depth), None if pd.isna(r.parent) else int(r.parent)) for r in t.sort_values("ord").itertuples()] if len(t) else []
        sections, rows = assemble(parts, lines, budget)
        found = [(book, "section", i, s.title, markup.written(Node("#root", {}, s.nodes)), s.chars, i, None, None, None) for i, s in enumerate(sections)]
        found += [(book, "contents", i, r["title"], None, None, r["section"], r["id"], r["depth"], r["parent"]) for i, r in enumerate(rows)]
        frame = pd.DataFrame(found, columns=names)
        return frame.astype({n: "Int32" for n in ("ord", "chars", "section", "depth", "parent")})

    if contents is None:
        contents = chapters.sparkSession.createDataFrame([], f"book {kind}, ord int, title string, key string, depth int, parent int")

    def run(c: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        return build(c["book"].iloc[0], c, t) if len(c) else pd.DataFrame(columns=names)

    return chapters.groupBy("book").cogroup(contents.groupBy("book")).applyInPandas(run, out)


def section_table(built: DataFrame) -> DataFrame:
    """The sections of books with where each starts, as they are written."""
    from pyspark.sql import Window

    before = Window.partitionBy("book").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    rows = built.where("kind = 'section'").select("book", F.col("ord").alias("section"), "title", "html", "chars")
    return rows.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)))
