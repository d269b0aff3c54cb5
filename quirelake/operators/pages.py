"""Printed pages as books: text runs to lines, lines to blocks, pages to sections with notes.

Runs come as rows (page, str, x, y, w, size, bold, italic), y upwards, as a PDF library gives them. A page's lines need
only the book's usual size of text; running lines, notes and sections need the book, which is one group.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from html import escape

import pandas as pd
from pyspark.sql import DataFrame

from quirelake.functions.keys import COMPOUND_PREFIXES
from quirelake.operators import assembly, markup
from quirelake.operators.assembly import Chapter, Entry, chosen_titles, is_chapter_line, is_chapter_title
from quirelake.operators.markup import is_scene_break
from quirelake.operators.sections import cuts

# Fixed values.
BULLET = r"([•·▪◦‣■□●○◆◇➢➤►▸-]|[-–—*]|\(?\d{1,3}[.)]|[a-zA-Z][.)]|[ivxIVX]{1,5}[.)])\s+\S|([•·▪◦‣■□●○◆◇➢➤►▸]|[-–—])$"
LEADER = r"(\.\s?){4,}\s*[\divxlc]{1,5}\s*$"
NOTE_MARK = r"\d{1,3}|[*†‡§]"
TOP, BOTTOM, SMALL, NOTE, HEADING, LARGE = 0.86, 0.1, 0.78, 0.92, 1.15, 1.6
REACH, MAX_RUNNING = 8, 120

_SEAMS = re.compile(r"</(b|i)>( ?)<\1>")


@dataclass
class Run:
    str: str
    x: float
    y: float
    w: float
    size: float
    bold: bool = False
    italic: bool = False
    raised: bool = False


@dataclass(eq=False)
class Line:
    y: float
    size: float
    runs: list[Run]
    text: str = ""
    html: str = ""
    x: float = 0.0
    right: float = 0.0
    height: float = 0.0

    @property
    def starts_raised(self) -> bool:
        return self.runs[0].raised

    @property
    def band(self) -> str | None:
        return "top" if self.y > self.height * TOP else "bottom" if self.y < self.height * BOTTOM else None


@dataclass
class Block:
    kind: str  # h, p, fn, leader or break
    text: str = ""
    html: str = ""
    level: int = 0
    size: float = 0.0
    first_x: float = 0.0
    body_x: float | None = None
    lines: int = 1
    bullet: bool = False
    goes_on: bool = False
    id: str = ""
    refs: int = 0
    back: str = ""


def upper_median(values: Iterable[float]) -> float:
    """D14."""
    v = sorted(x for x in values if math.isfinite(x))
    return v[len(v) // 2] if v else math.nan


def body_size(runs: list[Run]) -> float:
    """The usual size of a page's text."""
    long = upper_median(r.size for r in runs if len(r.str.strip()) > 3)
    return upper_median(r.size for r in runs) if math.isnan(long) else long


def join_hyphenated(a: str, b: str) -> tuple[str, bool] | None:
    """The joined text and whether the hyphen went; None if a has none at its end."""
    m = re.search(r"(\S+?)-$", a)
    if not m:
        return None
    stem = re.sub(r"^.*[^A-Za-z]", "", m[1]).lower()
    stays = m[1][-1].isdigit() or not re.match("[a-z]", b) or stem in COMPOUND_PREFIXES or re.search("[A-Za-z]-[A-Za-z]", m[1])
    return (a + b, False) if stays else (a[:-1] + b, True)


# -- lines ---------------------------------------------------------------------------------------------------------


def joined(runs: list[Run]) -> tuple[str, str]:
    """I16: text and markup of runs from left to right, with a space where they stand apart."""
    text, html = "", ""
    for before, r in zip([None, *runs], runs):  # noqa: B905
        if before and r.x - before.x - before.w > min(before.size, r.size) * 0.15 and not text.endswith(" ") and not r.str.startswith(" "):
            text, html = text + " ", html + " "
        plain = re.sub(r"\s+", " ", r.str)
        shown = escape(plain, quote=False)
        if plain.strip() and r.raised:
            shown = f"<sup>{shown.strip()}</sup>"
        elif plain.strip():
            shown = f"<b>{shown}</b>" if r.bold else shown
            shown = f"<i>{shown}</i>" if r.italic else shown
        text, html = text + plain, html + shown
    return markup.collapsed(text), _SEAMS.sub(r"\2", markup.collapsed(html))


def page_lines(runs: list[Run], height: float, usual: float) -> list[Line]:
    """Runs of about one height are a line; small short ones belong to the nearest line, raised ones as its marks."""
    small = lambda r: r.size < usual * SMALL and len(r.str.strip()) <= 4
    lines: list[Line] = []
    for r in sorted((r for r in runs if not small(r)), key=lambda r: -r.y):
        if lines and abs(lines[-1].y - r.y) <= max(2, min(lines[-1].size, r.size) * 0.4):
            lines[-1].runs.append(r)
        else:
            lines.append(Line(r.y, r.size, [r]))
    for r in filter(small, runs):
        near = [(abs(r.y - at.y), i) for i, at in enumerate(lines) if -1.5 <= r.y - at.y <= at.size * 0.75]
        if near:
            at = lines[min(near)[1]]
            at.runs.append(replace(r, raised=r.y - at.y > at.size * 0.15))
        else:
            lines.append(Line(r.y, r.size, [r]))
    for at in lines:
        at.runs.sort(key=lambda r: r.x)
        at.text, at.html = joined(at.runs)
        full = [r for r in at.runs if not r.raised] or at.runs
        at.x, at.right, at.height = full[0].x, max(r.x + r.w for r in at.runs), height
        at.size = upper_median(r.size for r in full)
    return sorted((at for at in lines if at.text), key=lambda at: -at.y)


def line_key(text: str) -> str:
    """I22."""
    plain = re.sub("[\"'`“”‘’„«»]", "", re.sub(r"\d+(\s\d+)*", "#", text))
    return re.sub(r"[\s|·•—–-]+", " ", plain).strip().lower()


def number_variants(key: str) -> set[str]:
    """The key with its page number read right: short words at an end for a number, or a number that was missed."""
    words = key.split(" ")
    out = {f"# {key}", f"{key} #"}
    for n in range(1, min(3, len(words))):
        if max(map(len, words[:n])) <= 3:
            out.add(" ".join(["#", *words[n:]]))
        if max(map(len, words[-n:])) <= 3:
            out.add(" ".join([*words[:-n], "#"]))
    return out


def page_numbers(at: Line) -> set[int]:
    """The numbers that a line may carry as its page's."""
    plain = lambda s: int(re.sub(r"\s", "", s))
    if re.fullmatch(r"\d(\s?\d){0,3}", at.text):
        return {plain(at.text)}
    found: set[int] = set()
    for m, word in ((re.match(r"(\d(?:\s?\d){0,3})\s+\S", at.text), r"^\d+"), (re.search(r"\S\s((?:\d\s?){0,3}\d)[.,]?$", at.text), r"\d+$")) if at.band else ():
        if m:
            found |= {plain(m[1]), int(re.search(word, m[1])[0])}
    return found


def running_lines(pages: dict[int, list[Line]]) -> set[int]:
    """Identities of heads and feet: lines that return at a page's edge, that carry the page's number, or that
    would be one of these with their number read right."""
    counts = Counter((at.band, line_key(at.text)) for lines in pages.values() for at in lines if at.band)
    keys = {k for k, n in counts.items() if n >= max(3, math.ceil(len(pages) * 0.02))}
    edges = {id(at): (p, at) for p, lines in pages.items() for at in (lines[:1] + lines[-1:])}
    shifts: dict[int, set[int]] = defaultdict(set)
    for p, at in edges.values():
        for n in page_numbers(at) if len(at.text) <= 100 else ():
            shifts[p - n].add(p)
    numbered = {i for i, (p, at) in edges.items() if len(at.text) <= 100 and any(sum(q != p and abs(q - p) <= REACH for q in shifts[p - n]) >= 2 for n in page_numbers(at))}
    keys |= {(edges[i][1].band, line_key(edges[i][1].text)) for i in numbered}
    out = set(numbered)
    for lines in pages.values():
        for at in lines:
            key = line_key(at.text)
            near = id(at) in edges and any((at.band, k) in keys for k in number_variants(key))
            if len(at.text) < MAX_RUNNING and ((at.band, key) in keys or near):
                out.add(id(at))
    return out


# -- blocks --------------------------------------------------------------------------------------------------------


def _starts_note(at: Line) -> bool:
    return at.starts_raised or bool(re.match(rf"\d{{1,3}}\s|[*†‡§]|(?:{NOTE_MARK})$", at.text))


def _kept(lines: list[Line], usual: float, running: set[int]) -> list[Line]:
    """Lines without heads, feet and page numbers; a note's number on a line of its own stays."""
    out = []
    for at, below in zip(lines, [*lines[1:], None]):  # noqa: B905
        mark = re.fullmatch(NOTE_MARK, at.text) and at.size < usual * SMALL and below and below.size < usual * NOTE and at.y - below.y < below.size * 2.2 and abs(below.x - at.x) < usual
        number = at.band and re.fullmatch(r"[\divxlc]+", re.sub(r"[\s|·•—–-]", "", at.text), re.I)
        site = re.search(markup.SITE_MARK, at.text, re.I) and not re.sub(markup.SITE_MARK, "", at.text, flags=re.I).strip()
        if not site and (mark or not (number or id(at) in running)):
            out.append(at)
    return out


def _first_note(lines: list[Line], usual: float) -> int:
    """Where a page's notes begin: small lines down to its foot, from the first that starts a note."""
    start = len(lines)
    for i in range(len(lines) - 1, -1, -1):
        if lines[i].size >= usual * NOTE:
            break
        if _starts_note(lines[i]):
            start = i
    return start


def _appended(b: Block, at: Line) -> None:
    got = join_hyphenated(b.text, at.text)
    if got:
        b.html = (re.sub(r"-((?:</(?:b|i)>)*)$", r"\1", b.html) if got[1] else b.html) + at.html
        b.text = got[0]
    else:
        b.text, b.html = f"{b.text} {at.text}", f"{b.html} {at.html}"
    b.html = _SEAMS.sub(lambda m: m[2] and " ", b.html)
    b.body_x = at.x if b.lines == 1 else b.body_x
    b.lines += 1


def _new_paragraph(para: Block, at: Line, before: Line, em: float, right: float, usual: float) -> bool:
    """Whether a line starts a paragraph: by a bullet, its indent, or a short line before it that ended a sentence."""
    if re.match(BULLET, at.text):
        return True
    short = math.isfinite(right) and before.right < right - usual * 3
    ended = bool(re.search(r"[.!?\"'”’)\]:;]$", before.text))
    if para.lines >= 2:
        return abs(at.x - para.body_x) > em or (short and ended and at.x > para.body_x + em)
    if at.x > para.first_x + em:
        return not para.bullet
    return at.x >= para.first_x - em and short and ended


def blocks_of(lines: list[Line], usual: float, running: set[int]) -> list[Block]:
    """Headings, paragraphs, contents lines, notes and scene breaks of a page."""
    kept = _kept(lines, usual, running)
    notes = _first_note(kept, usual)
    long = [at for at in lines if len(at.text) > 40]
    lefts, right, em = sorted(at.x for at in long), upper_median(at.right for at in long), usual * 0.6
    left = lefts[int(len(lefts) * 0.2)] if lefts else math.nan
    out: list[Block] = []
    para: Block | None = None

    def begin(at: Line, kind: str, html: str | None = None) -> Block:
        out.append(Block(kind, at.text, html or at.html, first_x=at.x, bullet=bool(re.match(BULLET, at.text))))
        return out[-1]

    for i, at in enumerate(kept):
        before = kept[i - 1] if i else None
        apart = before is None or before.y - at.y > max(before.size, at.size) * 1.7
        if i < notes and is_scene_break(at.text):
            out.append(Block("break"))
            para = None
        elif i < notes and at.size > usual * HEADING and len(at.text) < 120:
            if out and out[-1].kind == "h" and abs(out[-1].size - at.size) < 0.5 and not apart:
                out[-1].text, out[-1].html = f"{out[-1].text} {at.text}", f"{out[-1].html} {at.html}"
            else:
                out.append(Block("h", at.text, at.html, 1 if at.size > usual * LARGE else 2, at.size))
            para = None
        elif re.search(LEADER, at.text, re.I):
            text, html = (re.sub(r"(\.\s?){4,}", " … ", s) for s in (at.text, at.html))
            if para and para.kind == "p" and para.lines == 1 and not apart and not re.search(r"[.!?]$", para.text):
                out[-1] = Block("leader", f"{para.text} {text}", f"{para.html} {html}")
            else:
                out.append(Block("leader", text, html))
            para = None
        elif i >= notes:
            mark, number = _starts_note(at), re.match(r"(\d{1,3})\s", at.text)
            last = re.match(r"(\d{1,3})(?!\d)", para.text) if para and para.kind == "fn" else None
            if number and not at.starts_raised and last and int(number[1]) != int(last[1]) + 1:
                mark = False
            if re.fullmatch(NOTE_MARK, at.text):
                para = begin(at, "fn", f"<sup>{escape(at.text)}</sup>")
            elif not para or para.kind != "fn" or apart or (mark and not (para.lines == 1 and re.fullmatch(NOTE_MARK, para.text))):
                para = begin(at, "fn")
            else:
                _appended(para, at)
        elif not para or para.kind != "p" or apart or before.size > usual * HEADING or _new_paragraph(para, at, before, em, right, usual):
            para = begin(at, "p")
        else:
            _appended(para, at)
    if out and out[0].kind == "p":
        out[0].goes_on = not out[0].bullet and out[0].first_x <= left + em and bool(re.match("[a-z]", out[0].text))
    return out


def shown(b: Block) -> str:
    if b.kind == "break":
        return '<hr class="scene-break"/>'
    if b.kind == "h":
        return f"<h{b.level}>{b.html}</h{b.level}>"
    kind = {"fn": "footnote", "leader": "leader"}.get(b.kind) or " ".join(n for n, on in (("cont", b.goes_on), ("list-item", b.bullet)) if on)
    return f"<p{f' class={chr(34)}{kind}{chr(34)}' if kind else ''}{f' id={chr(34)}{b.id}{chr(34)}' if b.id else ''}>{b.html}</p>"


# -- notes ---------------------------------------------------------------------------------------------------------


def link_notes(pages: list[tuple[int, list[Block]]]) -> None:
    """Marks link to their notes: on the page, the two after it or the one before, the first that no mark has
    yet; else to the page's own. A mark takes its note, so marks are served in reading order."""
    notes: dict[int, dict[str, Block]] = defaultdict(dict)
    for p, blocks in pages:
        for b in blocks:
            if b.kind == "fn" and (m := re.match(rf"({NOTE_MARK})\s", b.text)) and m[1] not in notes[p]:
                b.id = f"fn-{p}-" + re.sub(r"\W", lambda c: str(ord(c[0])), m[1])
                notes[p][m[1]] = b
    for p, blocks in pages:

        def link(m: re.Match, p: int = p) -> str:
            near = [n for q in (p, p + 1, p + 2, p - 1) if (n := notes[q].get(m[1])) and not n.refs]
            note = near[0] if near else notes[p].get(m[1])
            if note is None:
                return m[0]
            note.refs += 1
            name = f"{note.id.replace('fn-', 'fnref-', 1)}-{note.refs}"
            note.back = note.back or name
            return f'<sup><a id="{name}" href="#{note.id}">{m[1]}</a></sup>'

        for b in blocks:
            if b.kind != "fn":
                b.html = re.sub(rf"<sup>({NOTE_MARK})</sup>", link, b.html)
    for _, blocks in pages:
        for b in blocks:
            if b.kind == "fn" and b.back:
                b.html = re.sub(rf"^<sup>({NOTE_MARK})</sup>", rf'<sup><a href="#{b.back}">\1</a></sup>', b.html)


# -- pages to sections ---------------------------------------------------------------------------------------------


def continues(before: list[Block], body: list[Block]) -> bool:
    """A page's first paragraph goes on with the one that the page before left open."""
    last, first = next((b for b in reversed(before) if b.kind != "fn"), None), body[0] if body else None
    if not last or not first or last.kind != "p" or first.kind != "p" or first.bullet:
        return False
    return bool(re.search(r"[-–—]$", last.text) or (not re.search(r"[.!?:;\"”’)\]]$", last.text) and re.match(r"[a-z0-9(“\"]", first.text)))


def across(last: Block, first: Block, mark: str) -> Block:
    """A paragraph over a page's end, with the page's mark where it turns."""
    got = join_hyphenated(last.text, first.text)
    if got:
        text, html = got[0], (re.sub(r"-((?:</(?:b|i)>)*)$", r"\1", last.html) if got[1] else last.html) + mark + first.html
    else:
        gap = "" if re.search("[–—]$", last.text) else " "
        text, html = last.text + gap + first.text, last.html + gap + mark + first.html
    return replace(last, text=text, html=_SEAMS.sub(lambda m: m[2] and " ", html))


def chapter_titles(bodies: list[list[Block]]) -> list[tuple[int, int, str]]:
    """(page, block, title) of the chapter titles that count; headings right in front of one go with it."""
    found, at = [], 0
    for i, body in enumerate(bodies):
        for k, b in enumerate(body):
            text = markup.collapsed(b.text)
            if (b.kind == "h" and is_chapter_title(text)) or (b.kind == "p" and not b.bullet and is_chapter_line(text)):
                found.append((i, k, at, text))
            at += len(b.text)
    ends = [f[2] for f in found[1:]] + [at]
    out = []
    for j in sorted(chosen_titles([(a, e, t.lower()) for (_, _, a, t), e in zip(found, ends)])):  # noqa: B905
        i, k, _, text = found[j]
        while k and bodies[i][k - 1].kind == "h":
            k -= 1
        out.append((i, k, text))
    return out


@dataclass
class Part:
    """A section in the making."""

    first: int
    last: int
    title: str | None
    html: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def written(self) -> str:
        return "\n".join([*self.html, *([f'<section class="endnotes">{chr(10).join(self.notes)}</section>'] if self.notes else [])])


def merged(pages: list[tuple[int, list[Block]]], chapters: set[int], budget: int = assembly.SECTION_BUDGET) -> list[Part]:
    """Pages as sections, begun at chapters, longer runs cut in near-equal parts between pages."""
    link_notes(pages)
    bodies = [[b for b in blocks if b.kind != "fn"] for _, blocks in pages]
    opens, splits = {}, defaultdict(dict)
    for i, k, title in chapter_titles(bodies):
        if k == 0:
            opens[i] = title
        else:
            splits[i][k] = title
    size = [sum(len(b.text) for b in blocks) for _, blocks in pages]
    follows = [i > 0 and continues(pages[i - 1][1], body) for i, body in enumerate(bodies)]
    heading = lambda i: i > 0 and bodies[i - 1] and bodies[i - 1][-1].kind == "h"
    rank = [3 if follows[i] or heading(i) else 1 if body and body[0].kind in ("h", "break") else 2 for i, body in enumerate(bodies)]
    begins = {i for i, (p, _) in enumerate(pages) if i in opens or p in chapters or (bodies[i] and bodies[i][0].kind == "h" and bodies[i][0].level == 1)}
    starts, runs = set(), [0]
    for i in range(1, len(pages)):
        if (i in begins or i in splits) and sum(size[runs[-1] : i]):
            starts |= {i} & begins
            runs.append(i)
    for a, b in zip(runs, [*runs[1:], len(pages)], strict=True):
        places = [(sum(size[a:i]), rank[i]) for i in range(a + 1, b)]
        starts |= {a + 1 + k for k in cuts(places, sum(size[a:b]), budget)}

    out: list[Part] = []
    open_: Block | None = None
    for i, (p, blocks) in enumerate(pages):
        if not out or i in starts:
            out.append(Part(p, p, opens.get(i)))
            open_ = None
        part, mark = out[-1], f'<span class="pg" id="pg{p}"></span>'
        part.last = p
        due = [b for b in blocks if b.kind == "fn"]
        for k, b in enumerate(bodies[i]):
            if k in splits[i]:
                above = "".join(out[-1].html)
                out[-1].notes += [shown(n) for n in due if f'#{n.id}"' in above and n.id]
                due = [n for n in due if not (n.id and f'#{n.id}"' in above)]
                out.append(Part(p, p, splits[i][k]))
            if k == 0 and open_ is not None and follows[i]:
                out[-1].html.pop()
                b = across(open_, b, mark)
            elif k == 0:
                out[-1].html.append(mark)
            out[-1].html.append(shown(b))
            open_ = b
        if not bodies[i]:
            out[-1].html.append(mark)
        out[-1].notes += map(shown, due)
    return out


def book(pages: dict[int, tuple[list[Run], float]], outline: list[tuple[str, int, int]] = (), budget: int = assembly.SECTION_BUDGET) -> tuple[dict, list, list]:
    """Facts, sections and contents of a book's pages (runs, height); outline: (title, page, depth)."""
    usual = upper_median(body_size(runs) for runs, _ in pages.values() if runs)
    usual = 10.0 if math.isnan(usual) else usual
    lines = {p: page_lines(runs, height, usual) for p, (runs, height) in sorted(pages.items())}
    running = running_lines(lines)
    blocks = [(p, blocks_of(at, usual, running)) for p, at in lines.items()]
    facts = {"pages": len(pages), "text_pages": sum(bool(b) for _, b in blocks), "size": usual}
    chapters = []
    for s in merged(blocks, {p for _, p, d in outline if d == 0}, budget):
        key = f"pages{s.first}"
        root = markup.normalised(f"<body>{s.written()}</body>", markup.Context(link=lambda h, key=key: f"{key}{h}" if h.startswith("#") else None))
        chapters.append(Chapter(root, key, s.title or (f"Page {s.first}" if s.first == s.last else f"Pages {s.first}-{s.last}")))
    stack: list[int] = []
    entries = []
    for i, (title, page, depth) in enumerate(outline):
        stack = stack[:depth]
        entries.append(Entry(title, f"#pg{page}", depth, stack[-1] if stack else None))
        stack.append(i)
    return (facts, *assembly.assemble(chapters, entries, math.inf))


def books(runs: DataFrame) -> DataFrame:
    """A15 over a table of runs (book, page, height, str, x, y, w, size, bold, italic): rows (book, section, title, html, chars)."""
    kind = runs.schema["book"].dataType.simpleString()
    names = ["book", "section", "title", "html", "chars"]

    def run(t: pd.DataFrame) -> pd.DataFrame:
        pages = {int(p): ([Run(str(r.str or ""), r.x, r.y, r.w, r.size, bool(r.bold), bool(r.italic)) for r in g.itertuples()], float(g["height"].iloc[0])) for p, g in t.groupby("page")}
        _, made, _ = book(pages)
        return pd.DataFrame([(t["book"].iloc[0], i, s.title, markup.written(markup.Node("#root", {}, s.nodes)), s.chars) for i, s in enumerate(made)], columns=names)

    return runs.groupBy("book").applyInPandas(run, f"book {kind}, section int, title string, html string, chars int")
