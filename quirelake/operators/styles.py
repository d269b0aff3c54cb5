"""publishers' styles cut down to typography, as text functions and columns.

Only declarations that a reader honours stay; sizes in px and pt become em, at most 4 of them either way.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# Fixed values.
KEPT = """text-align text-indent font-style font-weight font-variant text-decoration text-transform letter-spacing white-space
list-style-type list-style margin-top margin-bottom margin-left margin-right padding-left padding-right vertical-align display
page-break-before page-break-after break-before break-after border-bottom border-top text-decoration-line""".split()
SPACES = "normal pre pre-wrap nowrap pre-line".split()

_LENGTH = re.compile(r"-?\d*\.?\d+(em|rem|%|px|pt|ex|ch)?")
_COLOUR = re.compile(r"#[0-9a-f]{3,8}|rgba?\([^)]*\)|[a-z]+$", re.I)
_PER_EM = {"px": 16, "pt": 12}


def _em(part: str) -> str:
    m = re.fullmatch(r"(-?\d*\.?\d+)(px|pt)", part)
    if not m:
        return part
    return f"{max(-4.0, min(4.0, round(float(m[1]) / _PER_EM[m[2]], 3))):g}em"


def _lengths(value: str, words: tuple[str, ...] = ()) -> str | None:
    parts = value.split()
    return " ".join(map(_em, parts)) if all(p in words or _LENGTH.fullmatch(p) for p in parts) else None


def _value(name: str, value: str) -> str | None:
    """A declaration's value as it stays, or None."""
    if name == "display":
        return value if value == "none" else None
    if name.startswith(("margin", "padding")):
        return _lengths(value, ("auto",))
    if name == "text-indent":
        return _lengths(value) if " " not in value else None
    if name == "letter-spacing":
        return value if value == "normal" or _LENGTH.fullmatch(value) else None
    if name == "white-space":
        return value if value in SPACES else None
    return _COLOUR.sub("currentColor", value, count=1) if name.startswith("border-") else value


def declarations(text: str) -> list[str]:
    pairs = (d.partition(":") for d in text.split(";"))
    named = ((n.strip().lower(), re.sub(r"!important", "", v, flags=re.I).strip()) for n, colon, v in pairs if colon)
    kept = ((n, _value(n, v)) for n, v in named if v and n in KEPT)
    return [f"{n}:{v}" for n, v in kept if v is not None]


def inline(style: str) -> str:
    """A style attribute's declarations that stay."""
    return ";".join(declarations(style))


def _rules(css: str) -> list[tuple[str, str]]:
    """(selector, declarations) of a stylesheet; screen @media blocks are opened, other at-rules go."""
    out, at = [], 0
    while (brace := css.find("{", at)) >= 0:
        head = css[at:brace].strip()
        if head.startswith("@"):
            depth, end = 1, brace + 1
            while end < len(css) and depth:
                depth += {"{": 1, "}": -1}.get(css[end], 0)
                end += 1
            if re.match(r"@media\b", head, re.I) and not re.search(r"\b(print|speech|aural)\b", head, re.I):
                out += _rules(css[brace + 1 : end - 1 if not depth else end])
        else:
            end = css.find("}", brace) + 1
            if not end:
                break
            out.append((head, css[brace + 1 : end - 1]))
        at = end
    return out


def _selectors(head: str, scope: str) -> list[str]:
    """Selectors inside the scope; those of the whole page and most attribute selectors go."""
    names = [s.strip() for s in head.split(",")]
    names = [s for s in names if s and (re.match(r"\w+\[", s) or not (re.match(r"(html|body|@|:root)", s, re.I) or re.search(r"[\[\]]", s)))]
    names = [re.sub(r"^(html|body)\s*", "", s, flags=re.I) for s in names]
    return [f"{scope} {s}" for s in names if s and s != "*"]


def stylesheet(css: str | None, scope: str) -> str:
    """A stylesheet for one section, every selector below `scope`."""
    out = []
    for head, body in _rules(re.sub(r"/\*.*?\*/", "", css or "", flags=re.S)):
        kept, where = declarations(body), _selectors(head, scope)
        if kept and where:
            out.append(f"{','.join(where)}{{{';'.join(kept)}}}")
    return "\n".join(out)


def scoped(css: Column, scope: str = ".sec") -> Column:
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: stylesheet(x, scope))

    return run(css)
