"""HTML as a small tree: read, cleaned by allow-lists, written again, and read as paragraphs and positions.

Trees live inside Arrow-batched Python only; what leaves it are rows. A document is cleaned by itself, so nothing
is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from quirelake.operators import styles

# Fixed values.
BLOCKS = """p div section article aside header footer main nav h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd
table thead tbody tfoot tr th td caption colgroup col figure figcaption hr br img address details summary hgroup""".split()
INLINE = """a em strong i b u s small sub sup span code kbd samp var cite q abbr dfn mark time del ins ruby rt rp bdi bdo wbr""".split()
DROPPED = """script style head title meta link iframe object embed video audio form input button select textarea canvas noscript
template math base""".split()
RENAMED = {"center": "div", "font": "span", "big": "span", "tt": "code", "strike": "s", "acronym": "abbr", "blink": "span", "nobr": "span"}
WRAPPERS = "div section article main body blockquote aside header footer nav hgroup".split()
KEPT_ATTRIBUTES = "id class alt title colspan rowspan lang dir start reversed type value role span headers scope datetime cite".split()
PARAGRAPHS = """p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote div section article aside header footer address summary""".split()
CREDIT_SITES = r"demonoid|\bz-lib(?:rary)?\b|\blibgen\b|\blibrary genesis\b"
CREDIT_VERBS = "(?:scanned|proofed|proof-?read|(?:re-?)?formatted|converted|uploaded)"
SITE_MARK = r"(?:https?://)?(?:www\.)?o\s*c\s*e\s*a\s*n\s*o\s*f\s*p\s*d\s*f\s*\.\s*c\s*o\s*m\b/?"
SITE_LINK = r"https?://(?:www\.)?oceanofpdf\.com(?:[/?#:]|$)"
SCENE_BREAK = r"(?:[*#~⁂]\s*)+|(?:[•·]\s*){3,}"
CREDIT_REACH, CREDIT_MAX = 20, 200
#: Characters of cleaned pages that leave a worker at once.
PIECE = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
_SIMPLE = HEADINGS | {"p", "div"}  # blocks that may be a mark or a credit line
_FLAT = frozenset(("br", "hr", "img"))
_CREDIT = re.compile(rf"[\W_]*{CREDIT_VERBS}(?:\s*(?:,|&|\+|/|\band\b)\s*(?:and\s+)?{CREDIT_VERBS})*\s+by\b", re.I)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    @property
    def id(self) -> str | None:
        return self.attrs.get("id") or None

    def nodes(self) -> Iterator[Node]:
        """All elements below this one, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.nodes()


def text_of(node: Node | str) -> str:
    return node if isinstance(node, str) else "".join(map(text_of, node.children))


def collapsed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


# -- reading -------------------------------------------------------------------------------------------------------

#: An open element of the values is closed by one of the key that starts.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSES |= {t: ("p",) for t in BLOCKS if t not in ("li", "dt", "dd", "tr", "td", "th", "br", "img", "col", "colgroup", "caption", "thead", "tbody", "tfoot")}


class _Reader(HTMLParser):
    def __init__(self, xml: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.root, self.xml = Node("#root"), xml
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while len(self.open) > 1 and self.open[-1].tag in _CLOSES.get(tag, ()):
            self.open.pop()
        node = Node(tag, {k.lower(): v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.xml and tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        above = self.open[-1].children
        if above and isinstance(above[-1], str):
            above[-1] += data
        else:
            above.append(data)


def read(html: str | None) -> Node:
    """The content of a document's body, or of the whole text without one."""
    html = html or ""
    xml = bool(re.match(r"\s*<\?xml", html, re.I) or re.search(r"xmlns=[\"']http://www\.w3\.org/1999/xhtml", html, re.I))
    reader = _Reader(xml)
    reader.feed(html)
    reader.close()
    body = next((n for n in reader.root.nodes() if n.tag == "body"), reader.root)
    return Node("div", {}, body.children)


# -- cleaning ------------------------------------------------------------------------------------------------------


@dataclass
class Context:
    """How references resolve (None drops them), and what has been met."""

    image: Callable[[str], str | None] = lambda _: None
    link: Callable[[str], str | None] = lambda _: None
    ids: set[str] = field(default_factory=set)
    images: list[str] = field(default_factory=list)


def _attributes(node: Node, name: str, ctx: Context) -> dict[str, str]:
    """Attributes that stay; an id met before goes, and an old anchor's name becomes its id."""
    out: dict[str, str] = {}
    for key, value in node.attrs.items():
        if key in KEPT_ATTRIBUTES:
            if (key != "type" or name in ("ol", "ul")) and (key != "value" or name == "li"):
                out[key] = value
        elif key == "style":
            if kept := styles.inline(value):
                out["style"] = out.get("style", "") + kept
        elif key in ("src", "href", "xlink:href"):
            out[key.removeprefix("xlink:")] = value
        elif key == "epub:type":
            out["data-type"] = value
        elif key == "align" and value.lower() in ("left", "right", "center", "justify"):
            out["style"] = f"text-align:{value.lower()};" + out.get("style", "")
    if not out.get("id") and name == "a" and node.attrs.get("name"):
        out["id"] = node.attrs["name"]
    if out.get("id"):
        if out["id"] in ctx.ids:
            del out["id"]
        else:
            ctx.ids.add(out["id"])
    return out


def _image(src: str | None, attrs: dict[str, str], ctx: Context) -> list[Node]:
    found = ctx.image(src) if src else None
    if not found:
        return []
    ctx.images.append(found)
    rest = {k: v for k, v in attrs.items() if k not in ("src", "href")}
    return [Node("img", rest | {"data-src": found, "loading": "lazy", "alt": attrs.get("alt", "")})]


def _drawing(node: Node, ctx: Context) -> list[Node | str]:
    """Vector art stands for the picture in it, else for its text."""
    inner = next((n for n in node.nodes() if n.tag == "image"), None)
    if inner:
        shown = {"alt": inner.attrs.get("alt", "")} | ({"id": node.id} if node.id else {})
        if found := _image(inner.attrs.get("xlink:href") or inner.attrs.get("href"), shown, ctx):
            return found
    text = text_of(node).strip()
    return [Node("p", {}, [text])] if text else []


def cleaned(nodes: list[Node | str], ctx: Context) -> list[Node | str]:
    """The nodes by the allow-lists; unknown elements leave what they hold."""
    out: list[Node | str] = []
    for node in nodes:
        if isinstance(node, str):
            out.append(node)
            continue
        if node.tag == "mbp:pagebreak":
            out.append(Node("hr", {"class": "pagebreak"}))
            out += cleaned(node.children, ctx)
            continue
        if node.tag == "epub:switch":
            usual = next((n for n in node.nodes() if n.tag == "epub:default"), None)
            out += cleaned(usual.children if usual else [], ctx)
            continue
        name, attrs = node.tag.rpartition(":")[2], dict(node.attrs)
        if name in DROPPED:
            continue
        if name == "svg":
            out += _drawing(node, ctx)
            continue
        if name == "image":
            name, attrs = "img", {"src": attrs.get("xlink:href") or attrs.get("href") or ""}
        if name == "center":
            attrs["style"] = "text-align:center;" + attrs.get("style", "")
        name = RENAMED.get(name, name)
        if name not in BLOCKS and name not in INLINE:
            out += cleaned(node.children, ctx)
            continue
        kept = _attributes(Node(name, attrs), name, ctx)
        if name == "img":
            out += _image(kept.get("src"), kept, ctx)
            continue
        kept.pop("src", None)
        if name == "a":
            href = kept.pop("href", "")
            if re.match(r"(https?:|mailto:)", href, re.I):
                kept |= {"href": href, "target": "_blank", "rel": "noopener"}
            elif href and (key := ctx.link(href)):
                kept["data-link"] = key
        inside = cleaned(node.children, ctx)
        if inside or name in BLOCKS or name in ("a", "wbr") or "id" in kept:
            out.append(Node(name, kept, inside))
    return out


def is_empty(node: Node | str) -> bool:
    """Nothing to see and no place to link to."""
    if isinstance(node, str):
        return not node.strip()
    if node.id or node.tag in ("img", "br", "hr", "td", "th"):
        return False
    return all(map(is_empty, node.children))


def without_marks(nodes: list[Node | str]) -> list[Node | str]:
    """No mentions of the site that stamps books, no links to it, and no elements that only held them."""
    out: list[Node | str] = []
    for node in nodes:
        if isinstance(node, str):
            left = re.sub(rf"(?<!\s)\s*{SITE_MARK}", "", node, flags=re.I) if re.search(SITE_MARK, node, re.I) else node
            out += [left] if left else []
            continue
        before, link = text_of(node), node.tag == "a" and re.match(SITE_LINK, node.attrs.get("href", ""), re.I)
        if link:
            node.tag = "span"
            node.attrs = {k: v for k, v in node.attrs.items() if k not in ("href", "target", "rel")}
        node.children = without_marks(node.children)
        if not ((link or text_of(node) != before) and is_empty(node)):
            out.append(node)
    return out


def is_scene_break(text: str) -> bool:
    return bool(re.fullmatch(SCENE_BREAK, text.strip()))


def _holds_blocks(node: Node) -> bool:
    return any(isinstance(c, Node) and c.tag in BLOCKS and c.tag not in _FLAT for c in node.children)


def mark_scene_breaks(node: Node) -> None:
    """Paragraphs that are only a mark become a rule, with their id; links, notes, pictures and ids keep them."""
    for child in node.children:
        if isinstance(child, str):
            continue
        plain = child.tag in _SIMPLE and not _holds_blocks(child) and is_scene_break(text_of(child))
        if plain and not any(n.tag in ("a", "sup", "img") or n.id for n in child.nodes()):
            child.tag, child.children = "hr", []
            child.attrs = {"class": "scene-break"} | ({"id": child.id} if child.id else {})
        else:
            mark_scene_breaks(child)


def normalised(html: str | None, ctx: Context | None = None) -> Node:
    """A document cleaned, without site marks, with scene breaks, and without empty ends."""
    root = read(html)
    root.children = without_marks(cleaned(root.children, ctx or Context()))
    mark_scene_breaks(root)
    kids = root.children
    while kids and is_empty(kids[0]):
        kids.pop(0)
    while kids and is_empty(kids[-1]):
        kids.pop()
    return root


def is_credit(text: str) -> bool:
    """J25."""
    t = collapsed(text)
    return 0 < len(t) < CREDIT_MAX and bool(_CREDIT.match(t) or re.search(CREDIT_SITES, t, re.I))


def remove_credits(roots: list[Node]) -> None:
    """Credit lines go from the first paragraphs of a book, over its chapters; one with an id or a picture stays."""
    seen = 0

    def visit(node: Node) -> None:
        nonlocal seen
        for child in list(node.children):
            if seen >= CREDIT_REACH:
                return
            if isinstance(child, str) or child.tag not in BLOCKS or child.tag in _FLAT:
                continue
            if _holds_blocks(child):
                visit(child)
                if is_empty(child):
                    node.children.remove(child)
                continue
            text = text_of(child)
            if text.strip():
                seen += 1
                if child.tag in _SIMPLE and is_credit(text) and not child.id and not any(n.id or n.tag == "img" for n in child.nodes()):
                    node.children = [c for c in node.children if c is not child]

    for root in roots:
        visit(root)


# -- writing and reading ------------------------------------------------------------------------------------------


def written(node: Node | str) -> str:
    if isinstance(node, str):
        return escape(node, quote=False)
    inner = "".join(map(written, node.children))
    if node.tag == "#root":
        return inner
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}/>" if node.tag in VOID else f"<{node.tag}{attrs}>{inner}</{node.tag}>"


def headings(nodes: list[Node | str], prefix: str) -> list[tuple[int, str, str]]:
    """(level, text, id) of headings with text; those without an id get one, numbered."""
    out, n = [], 0
    for node in Node("#root", {}, nodes).nodes():
        if node.tag in HEADINGS and (text := collapsed(text_of(node))):
            if not node.id:
                n += 1
                node.attrs["id"] = f"{prefix}-h{n}"
            out.append((int(node.tag[1]), text[:200], node.attrs["id"]))
    return out


def _pieces(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else _pieces(c) for c in node.children)


def paragraphs(root: Node) -> list[tuple[str, str]]:
    """(element, collapsed text) of every element that holds text and no block; a line break is a space."""
    out = []
    for c in root.children:
        if isinstance(c, str) or c.tag == "pre":
            continue
        if c.tag in PARAGRAPHS and not any(n.tag in BLOCKS and n.tag not in ("br", "img") for n in c.nodes()):
            if text := collapsed(_pieces(c)):
                out.append((c.tag, text))
        else:
            out += paragraphs(c)
    return out


def position_text(node: Node | str, first_in_pre: bool = False) -> str:
    """A character for each place that is counted: texts by their characters, a picture as one.

    Line ends are single characters, and the one right after a <pre> isn't counted.
    """
    if isinstance(node, str):
        plain = re.sub(r"\r\n?", "\n", node)
        return plain.removeprefix("\n") if first_in_pre else plain
    if node.tag == "img":
        return "￼"
    return "".join(position_text(c, node.tag == "pre" and i == 0) for i, c in enumerate(node.children))


_CLEANED = {"html": pa.string()} | dict.fromkeys(("chars", "elements", "links", "breaks"), pa.int32())


def cleaned_pieces(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of (key, html) page by page, leaving in pieces of about PIECE characters.

    So a worker holds, beside the batch that it was sent, a page's tree and a piece, however large batches are.
    """
    for b in batches:
        start, held, rows = 0, 0, []
        for i, h in enumerate(b.column(1), 1):
            root = normalised(h.as_py())
            every = list(root.nodes())
            rows.append((written(Node("#root", {}, root.children)), len(text_of(root)), len(every), sum(n.tag == "a" and "href" in n.attrs for n in every), sum(n.attrs.get("class") == "scene-break" for n in every)))
            held += len(rows[-1][0])
            if held >= PIECE or i == b.num_rows:
                values = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CLEANED.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, i - start), *values], [key, *_CLEANED])
                start, held, rows = i, 0, []


def normalised_pages(df: DataFrame, key: str, html: str) -> DataFrame:
    """I01-I06 over a table: (key, html, chars, elements, links, breaks)."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInArrow(lambda batches: cleaned_pieces(batches, key), f"{key} {kind}, html string, chars int, elements int, links int, breaks int")
