"""Plain text and Markdown as HTML, ready to be cleaned and cut like any other document.

Markdown is read as far as books use it: headings, paragraphs, quotes, lists, rules, code, tables, emphasis, links.
"""

from __future__ import annotations

import re
from html import escape as _escape

from quirelake.operators.markup import is_scene_break

SCENE_BREAK = '<hr class="scene-break"/>'
_NAMED = re.compile(r"(chapter|part|book|prologue|epilogue|section)\b", re.I)


def escape(text: str) -> str:
    return _escape(text, quote=False)


# -- plain text ----------------------------------------------------------------------------------------------------


def is_hard_wrapped(lines: list[str]) -> bool:
    """More than 20 lines with text, over half of them as long as a wrapped line is."""
    full = [x for x in lines if x.strip()]
    return len(full) > 20 and 2 * sum(50 < len(x) < 100 for x in full) > len(full)


def paragraphs(lines: list[str], wrapped: bool) -> list[str]:
    """Lines as blocks: a line each, or, wrapped, all up to an empty line; a scene break stands alone."""
    out: list[list[str]] = [[]]
    for line in lines:
        if not line.strip():
            out.append([])
        elif is_scene_break(line) or not wrapped:
            out += [[line], []]
        else:
            out[-1].append(line)
    return [" ".join(x.strip() for x in block) if wrapped else block[0] for block in out if block]


def is_heading(text: str) -> bool:
    """A short line without an end mark that names a part of a book or is in capitals."""
    if len(text) >= 80 or text[-1] in ".,;:":
        return False
    return bool(_NAMED.match(text) or (re.fullmatch(r"[A-Z0-9 .,'\"!?:;-]+", text) and re.search("[A-Z]{2}", text)))


def text_to_html(text: str) -> str:
    lines = re.sub(r"\r\n?", "\n", text).replace("\t", "    ").split("\n")
    out = []
    for block in paragraphs(lines, is_hard_wrapped(lines)):
        plain = block.strip()
        if is_scene_break(plain):
            out.append(SCENE_BREAK)
        elif is_heading(plain):
            out.append(f"<h2>{escape(plain)}</h2>")
        elif re.match(r"\s{4}", block):
            out.append(f"<pre>{escape(block)}</pre>")
        else:
            out.append(f"<p>{escape(plain)}</p>")
    return "\n".join(out)


# -- Markdown ------------------------------------------------------------------------------------------------------


def slug(text: str) -> str:
    """Lower-cased letters, digits and hyphens, without tags."""
    plain = re.sub(r"<[^>]+>", "", text.lower().strip())
    return re.sub(r"\s+", "-", re.sub(r"[^\w\s-]|_", "", plain))


def inline(text: str) -> str:
    """Code, pictures, links and emphasis of a line of Markdown."""
    kept: list[str] = []

    def keep(html: str) -> str:
        kept.append(html)
        return f"\0{len(kept) - 1}\0"

    text = re.sub(r"(`+)(.+?)\1", lambda m: keep(f"<code>{escape(m[2].strip())}</code>"), text)
    text = re.sub(r"\\([\\`*_{}\[\]()#+.!|-])", lambda m: keep(escape(m[1])), text)
    text = escape(text)
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", lambda m: keep(f'<img src="{m[2]}" alt="{m[1]}"/>'), text)
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)", r'<a href="\2">\1</a>', text)
    text = re.sub(r"&lt;(https?://[^&\s]+)&gt;", r'<a href="\1">\1</a>', text)
    for mark, tag in ((r"\*\*", "strong"), ("__", "strong"), (r"\*", "em"), ("~~", "del")):
        text = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", rf"<{tag}>\1</{tag}>", text)
    text = re.sub(r"(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)", r"<em>\1</em>", text)
    text = re.sub(r"(?: {2,}|\\)\n", "<br/>\n", text)
    while "\0" in text:
        text = re.sub(r"\0(\d+)\0", lambda m: kept[int(m[1])], text)
    return text


_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])[ \t]+(.*)")


class Markdown:
    """Blocks of Markdown as HTML; headings get ids of their own."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def heading(self, level: int, text: str) -> str:
        inner = inline(text)
        name = slug(inner) or "section"
        n = self.seen.get(name, 0)
        self.seen[name] = n + 1
        return f'<h{level} id="{name}{f"-{n}" if n else ""}">{inner}</h{level}>'

    def html(self, text: str) -> str:
        return "\n".join(self.blocks(re.sub(r"\r\n?", "\n", text).replace("\t", "    ").split("\n")))

    def blocks(self, lines: list[str]) -> list[str]:
        out: list[str] = []
        i = 0
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                i += 1
            elif m := re.match(r" {0,3}(```+|~~~+)", line):
                end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(m[1])), len(lines))
                out.append("<pre><code>" + escape("\n".join(lines[i + 1 : end])) + "</code></pre>")
                i = end + 1
            elif m := re.fullmatch(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*", line):
                out.append(self.heading(len(m[1]), m[2] or ""))
                i += 1
            elif _RULE.fullmatch(line):
                out.append(SCENE_BREAK if line.strip().startswith("*") else "<hr/>")
                i += 1
            elif line.lstrip().startswith(">"):
                end = i
                while end < len(lines) and lines[end].strip():
                    end += 1
                out.append("<blockquote>" + "\n".join(self.blocks([re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:end]])) + "</blockquote>")
                i = end
            elif _ITEM.fullmatch(line):
                html, i = self.items(lines, i)
                out.append(html)
            elif line.startswith("    "):
                end = i
                while end < len(lines) and (lines[end].startswith("    ") or not lines[end].strip()):
                    end += 1
                out.append("<pre><code>" + escape("\n".join(x[4:] for x in lines[i:end]).rstrip()) + "</code></pre>")
                i = end
            elif "|" in line and i + 1 < len(lines) and re.fullmatch(r"[ |:-]*-[ |:-]*", lines[i + 1]):
                end = i + 2
                while end < len(lines) and "|" in lines[end]:
                    end += 1
                cells = lambda x, tag: "<tr>" + "".join(f"<{tag}>{inline(c.strip())}</{tag}>" for c in x.strip().strip("|").split("|")) + "</tr>"
                out.append("<table>" + cells(line, "th") + "".join(cells(x, "td") for x in lines[i + 2 : end]) + "</table>")
                i = end
            else:
                end = i + 1
                while end < len(lines) and lines[end].strip() and not re.match(r" {0,3}(#{1,6}\s|>|```|~~~)", lines[end]) and not _ITEM.fullmatch(lines[end]) and not _RULE.fullmatch(lines[end]) and not re.fullmatch(r" {0,3}(=+|-+)\s*", lines[end]):
                    end += 1
                under = end < len(lines) and re.fullmatch(r" {0,3}(=+|-+)\s*", lines[end])
                text = "\n".join(x.lstrip() for x in lines[i:end]).rstrip()
                out.append(self.heading(1 if under[1][0] == "=" else 2, text) if under else f"<p>{inline(text)}</p>")
                i = end + 1 if under else end
        return out

    def items(self, lines: list[str], i: int) -> tuple[str, int]:
        """A list and the line behind it; what is indented below an item belongs to it."""
        first = _ITEM.fullmatch(lines[i])
        tag = "ol" if first[2][0].isdigit() else "ul"
        start = f' start="{int(first[2][:-1])}"' if tag == "ol" and int(first[2][:-1]) != 1 else ""
        out = []
        while i < len(lines) and (m := _ITEM.fullmatch(lines[i])) and (m[2][0].isdigit() == (tag == "ol")):
            deep, own = len(m[1]) + len(m[2]) + 1, [m[3]]
            i += 1
            while i < len(lines) and (lines[i].startswith(" " * min(deep, 2)) or (not lines[i].strip() and i + 1 < len(lines) and lines[i + 1].startswith(" " * min(deep, 2)))):
                own.append(re.sub(rf"^ {{0,{deep}}}", "", lines[i]))
                i += 1
            inner = self.blocks(own)
            out.append("<li>" + ("\n".join(inner) if len(inner) > 1 or not inner or not inner[0].startswith("<p>") else inner[0][3:-4]) + "</li>")
            while i < len(lines) and not lines[i].strip() and i + 1 < len(lines) and _ITEM.fullmatch(lines[i + 1]):
                i += 1
        return f"<{tag}{start}>" + "".join(out) + f"</{tag}>", i


def markdown_to_html(text: str) -> str:
    return Markdown().html(text)
