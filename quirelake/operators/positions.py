"""Versioned text: word differences, shifted and moved places, fixes that are found again and replayed.

A book's versions, places and fixes meet in one cogroup a book, so no row carries a book's text but the book's own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Cells of a difference table; what would need more is one change.
MAX_CELLS = 2_000_000
PROBES = (64, 32, 16, 8)

Change = tuple[int, int, str]
#: A word with marks and inner apostrophes, a run of white space, or one other character.
_MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯"
_WORD = rf"(?:[^\W_]|[{_MARKS}])+"
_TOKEN = re.compile(rf"{_WORD}(?:['’]{_WORD})*|\s+|.", re.S)


def common_ends(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common beginning and of the common end behind it."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    return head, tail


def _trimmed(a: str, c: Change) -> Change:
    """A change without what it begins and ends with in both texts."""
    start, end, text = c
    head, tail = common_ends(a[start:end], text)
    return start + head, end - tail, text[head : len(text) - tail]


def _joined(a: str, changes: list[Change]) -> list[Change]:
    """Changes with those made one that have less of the same text between them than either of them changes."""
    out: list[Change] = []
    size = lambda c: max(c[1] - c[0], len(c[2]))
    for c in changes:
        same = a[out[-1][1] : c[0]] if out else ""
        if out and len(same) <= min(size(out[-1]), size(c)):
            out[-1] = _trimmed(a, (out[-1][0], c[1], out[-1][2] + same + c[2]))
        else:
            out.append(c)
    return out


def diff_text(a: str, b: str) -> list[Change]:
    """The changes (start, end, new text) that turn a into b, by longest common subsequence of words."""
    x, y = _TOKEN.findall(a), _TOKEN.findall(b)
    head, tail = common_ends(x, y)
    if head == len(x) == len(y):
        return []
    at = sum(map(len, x[:head]))
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if len(x) * len(y) > MAX_CELLS:
        return [_trimmed(a, (0, len(a), b))]
    names = {w: i for i, w in enumerate(dict.fromkeys(x + y))}
    u, v = np.array([names[w] for w in x], np.int32), np.array([names[w] for w in y], np.int32)
    best = np.zeros((len(u) + 1, len(v) + 1), np.int32)
    for i in range(len(u) - 1, -1, -1):
        take = np.where(v == u[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(take[::-1])[::-1]
    out: list[Change] = []
    i = j = 0
    while i < len(x) or j < len(y):
        start, new = at, []
        while (i < len(x) or j < len(y)) and not (i < len(x) and j < len(y) and u[i] == v[j]):
            if j == len(y) or (i < len(x) and best[i + 1, j] >= best[i, j + 1]):
                at += len(x[i])
                i += 1
            else:
                new.append(y[j])
                j += 1
        if at > start or new:
            out.append(_trimmed(a, (start, at, "".join(new))))
        if i < len(x):
            at += len(x[i])
            i, j = i + 1, j + 1
    return [c for c in _joined(a, out) if c[1] > c[0] or c[2]]


def five_words(text: str) -> str:
    """J28."""
    return " ".join(re.findall(r"[^\W_]+", text)[:5]).lower()


def pair_paragraphs(before: list[str], after: list[str]) -> tuple[list[int], list[int]]:
    """For each new paragraph the old one it continues, or -1, and old ones that are left over.

    Paragraphs that start alike pair first, as many as can in order; what lies between them pairs by place.
    """
    a, b = [five_words(t) for t in before], [five_words(t) for t in after]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] and a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    old, gone = [-1] * len(b), []
    last = (-1, -1)
    for p in [*pairs, (len(a), len(b))]:
        free, open_ = list(range(last[0] + 1, p[0])), list(range(last[1] + 1, p[1]))
        for x, y in zip(free, open_):  # noqa: B905
            old[y] = x
        gone += free[len(open_) :]
        if p[1] < len(b):
            old[p[1]] = p[0]
        last = p
    return old, gone


def position_shift(a: str, b: str) -> tuple[int, int, int]:
    """(start, end, delta): text from end on moves by delta, places inside go to the start."""
    head, tail = common_ends(a, b)
    return head, len(a) - tail, len(b) - len(a)


def shift_offset(offset: int, shift: tuple[int, int, int]) -> int:
    start, end, delta = shift
    return max(0, offset + delta) if offset >= end else min(offset, start)


def diff_columns(df: DataFrame, before: str, after: str) -> DataFrame:
    """J29, J31 as columns `changes` and `shift`."""
    changes = T.ArrayType(T._parse_datatype_string("start int, end int, text string"))

    @pandas_udf(changes)
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "text": t} for s, e, t in diff_text(x or "", y or "")] for x, y in zip(a, b, strict=True)])

    @pandas_udf("start int, end int, delta int")
    def shift(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([position_shift(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["start", "end", "delta"])

    return df.withColumn("changes", diff(before, after)).withColumn("shift", shift(before, after))


def _nearest(text: str, piece: str, guess: float) -> int | None:
    """Where a piece stands nearest to a guess; of two as near, the first."""
    at = max(0, int(guess))
    before, after = text.rfind(piece, 0, at + len(piece)), text.find(piece, at)
    found = [p for p in (before, after) if p >= 0]
    return min(found, key=lambda p: (abs(p - guess), p)) if found else None


def moved(place: int, old: str, new: str, shift: tuple[int, int, int]) -> int:
    """Where a place goes: by the shift up to the changed part and behind it; inside it to where the text around it
    stands nearest to the proportional guess, else to that guess."""
    start, end, _ = shift
    if old == new:
        return place
    if place <= start or place >= end:
        return shift_offset(place, shift)
    guess = place * len(new) / len(old)
    for n in PROBES:
        for piece, back in ((old[place : place + n], 0), (old[max(0, place - n) : place], n)):
            if len(piece) == n and (hit := _nearest(new, piece, guess - back)) is not None:
                return hit + back
    return min(max(int(guess + 0.5), 0), len(new))


class Mover:
    """Places of one version's sections in another version's."""

    def __init__(self, before: list[str], after: list[str]):
        self.before, self.after = before, after
        self.old, self.new = "".join(before), "".join(after)
        self.starts = [0, *accumulate(map(len, before))][:-1]
        self.ends = list(accumulate(map(len, after)))
        self.shift = position_shift(self.old, self.new)

    def place(self, section: int, offset: int) -> tuple[int, int]:
        s = min(max(0, section), len(self.before) - 1)
        x = moved(self.starts[s] + min(max(0, offset), len(self.before[s])), self.old, self.new, self.shift)
        i = min(bisect_right(self.ends, x), len(self.after) - 1)
        return i, min(max(0, x - (self.ends[i] - len(self.after[i]))), len(self.after[i]))


def _texts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("section", "text"))).alias(name))


def move_places(places: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(book, section, offset) in the old version -> to_section, to_offset in the new one; progress and
    bookmarks alike. A book without a new version keeps its places."""
    texts = _texts(old, "old").join(_texts(new, "new"), "book", "left")
    kind = places.schema["book"].dataType.simpleString()
    names = ["book", "section", "offset", "to_section", "to_offset"]

    def run(t: pd.DataFrame, books: pd.DataFrame) -> pd.DataFrame:
        if not len(t) or not len(books):
            return pd.DataFrame(columns=names)
        a = [x["text"] or "" for x in books["old"].iloc[0]]
        b = books["new"].iloc[0]
        go = Mover(a, [x["text"] or "" for x in b]).place if b is not None and len(b) else lambda s, o: (s, o)
        return pd.DataFrame([(k, s, o, *go(int(s), int(o))) for k, s, o in zip(t["book"], t["section"], t["offset"], strict=True)], columns=names)

    return places.groupBy("book").cogroup(texts.groupBy("book")).applyInPandas(run, f"book {kind}, section long, offset long, to_section long, to_offset long")


def find_run(sections: dict[int, list[str]], wanted: list[str], section: int, near: int, before: str = "", after: str = "") -> tuple[int, int] | None:
    """(section, place) where the wanted paragraphs follow one another: the run with most of the same neighbours, then
    in the same section, then nearest; the first of equals. Past the ends of a section the neighbour is empty."""
    n, best = len(wanted), None
    for s, texts in sections.items():
        for i in range(len(texts) - n + 1):
            if texts[i : i + n] == wanted:
                around = (texts[i - 1] if i else "", texts[i + n] if i + n < len(texts) else "")
                score = ((around[0] == before) + (around[1] == after), s == section, -abs(i - near))
                if best is None or score > best[0]:
                    best = (score, (s, i))
    return best[1] if best else None


def replay_fixes(paragraphs: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fixes (book, fix_id, section, at, old_text, new_text, before, after) in order on paragraphs (book, section,
    ord, text); `applied` tells which were found, `to_section` and `place` where.

    Each fix sees the text the ones before it left, so a book's fixes are one fold.
    """
    kind = fixes.schema["book"].dataType.simpleString()
    texts = paragraphs.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("section", "ord", "text"))).alias("p"))
    names = ["book", "fix_id", "applied", "to_section", "place"]

    def run(t: pd.DataFrame, books: pd.DataFrame) -> pd.DataFrame:
        now: dict[int, list[str]] = {}
        for x in books["p"].iloc[0] if len(books) else []:
            now.setdefault(int(x["section"]), []).append(x["text"] or "")
        out = []
        for r in t.sort_values("fix_id").itertuples():
            hit = find_run(now, list(r.old_text), int(r.section), int(r.at), r.before or "", r.after or "")
            if hit:
                now[hit[0]][hit[1] : hit[1] + len(r.old_text)] = list(r.new_text)
            out.append((r.book, r.fix_id, hit is not None, *(hit or (-1, -1))))
        return pd.DataFrame(out, columns=names)

    return fixes.groupBy("book").cogroup(texts.groupBy("book")).applyInPandas(run, f"book {kind}, fix_id long, applied boolean, to_section long, place long")


def undo(original: list[str], fixes: list[tuple[int, list[str], list[str]]], gone: int) -> list[str] | None:
    """A section without one of its fixes (id, old, new): the others again, in order, on the text as converted; None
    where one of them needs what the undone one wrote."""
    now = list(original)
    for fix, old, new in sorted(fixes):
        if fix != gone:
            hit = find_run({0: now}, old, 0, 0)
            if hit is None:
                return None
            now[hit[1] : hit[1] + len(old)] = new
    return now
