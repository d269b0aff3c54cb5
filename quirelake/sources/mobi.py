"""Mobipocket files: the record container, text codecs, headers, index tables, and both kinds of book in them.

The formats are public: PalmDOC and HUFF/CDIC compression, EXTH metadata, INDX tables with tag maps, and for newer books
(version 8) skeletons with fragments. A file with both kinds is read as the newer one, or as the older one if that fails.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

from quirelake.operators import assembly, markup, styles
from quirelake.operators.assembly import Chapter, Entry
from quirelake.operators.markup import Context
from quirelake.sources import plain

NONE = 0xFFFFFFFF
#: Text characters that a chapter holds before a page break ends it.
CHAPTER_CHARS = 2000
_IMAGES = {b"\xff\xd8": "jpg", b"\x89P": "png", b"GI": "gif", b"BM": "bmp"}


class MobiError(ValueError):
    pass


def _u32(b: bytes, at: int, default: int = NONE) -> int:
    return struct.unpack_from(">I", b, at)[0] if at + 4 <= len(b) else default


def _u16(b: bytes, at: int) -> int:
    return struct.unpack_from(">H", b, at)[0] if at + 2 <= len(b) else 0


# -- container and codecs ------------------------------------------------------------------------------------------


def records_of(data: bytes) -> tuple[str, str, list[bytes]]:
    """Name, type and records of a record database."""
    if len(data) < 78:
        raise MobiError("not a record database")
    n = _u16(data, 76)
    at = [_u32(data, 78 + 8 * i, len(data)) for i in range(n)] + [len(data)]
    return data[:32].split(b"\0")[0].decode("latin-1"), data[60:64].decode("latin-1"), [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def palmdoc(data: bytes) -> bytes:
    """Bytes as they are, runs of them, spaces with a letter, and copies from up to 2,047 bytes back."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(data):
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            back, n = pair >> 3, (pair & 7) + 3
            for _ in range(n if 0 < back <= len(out) else 0):
                out.append(out[-back])
    return bytes(out)


class Huff:
    """HUFF/CDIC: a canonical code whose symbols are phrases, which may be compressed themselves."""

    def __init__(self, huff: bytes, dictionaries: list[bytes]):
        if huff[:8] != b"HUFF\0\0\0\x18":
            raise MobiError("not a HUFF record")
        quick, slow = _u32(huff, 8), _u32(huff, 12)
        self.quick = []
        for i in range(256):
            v = _u32(huff, quick + 4 * i)
            bits = v & 0x1F
            self.quick.append((bits, bool(v & 0x80), ((v >> 8) + 1 << 32 - bits) - 1 if bits else 0))
        pairs = struct.unpack_from(">64I", huff, slow)
        self.least = [0, *(x << 32 - i for i, x in enumerate(pairs[::2], 1))]
        self.most = [0, *((x + 1 << 32 - i) - 1 for i, x in enumerate(pairs[1::2], 1))]
        self.phrases: list[tuple[bytes, bool] | None] = []
        for d in dictionaries:
            if d[:8] != b"CDIC\0\0\0\x10":
                raise MobiError("not a CDIC record")
            total, bits = _u32(d, 8), _u32(d, 12)
            for i in range(min(1 << bits, total - len(self.phrases))):
                at = 16 + _u16(d, 16 + 2 * i)
                size = _u16(d, at)
                self.phrases.append((d[at + 2 : at + 2 + (size & 0x7FFF)], bool(size & 0x8000)))

    def unpack(self, data: bytes, depth: int = 0) -> bytes:
        if depth > 32:
            raise MobiError("a phrase holds itself")
        out, left, at = bytearray(), len(data) * 8, 0
        padded = data + b"\0" * 8
        while True:
            code = int.from_bytes(padded[at >> 3 : (at >> 3) + 8], "big") >> 32 - (at & 7) & 0xFFFFFFFF
            bits, done, most = self.quick[code >> 24]
            if not done:
                while bits < 32 and code < self.least[bits]:
                    bits += 1
                most = self.most[bits]
            left -= bits
            at += bits
            if left < 0 or not bits:
                return bytes(out)
            i = most - code >> 32 - bits
            phrase = self.phrases[i]
            if phrase is None:
                raise MobiError("a phrase holds itself")
            if not phrase[1]:
                self.phrases[i] = None
                phrase = self.phrases[i] = (self.unpack(phrase[0], depth + 1), True)
            out += phrase[0]


def trailing(data: bytes, flags: int) -> int:
    """Bytes of the entries behind a text record: one a flag, with its size in its last bytes."""
    n = 0
    for _ in range(bin(flags >> 1).count("1")):
        size, shift, end = 0, 0, len(data) - n
        while end > 0 and shift < 28:
            end -= 1
            size |= (data[end] & 0x7F) << shift
            shift += 7
            if data[end] & 0x80:
                break
        n += size
    return n + ((data[len(data) - n - 1] & 3) + 1 if flags & 1 and len(data) > n else 0)


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A number of 7 bits a byte, the last one marked; and where it ends."""
    value = 0
    while at < len(data):
        value = value << 7 | data[at] & 0x7F
        at += 1
        if data[at - 1] & 0x80:
            break
    return value, at


def _tags(table: list[tuple[int, int, int, int]], controls: int, data: bytes, at: int) -> dict[int, list[int]]:
    """An index entry's values by tag, by the masks of its control bytes."""
    control, at, due = at, at + controls, []
    for tag, each, mask, end in table:
        if end == 1:
            control += 1
            continue
        value = data[control] & mask
        if not value:
            continue
        if value == mask and bin(mask).count("1") > 1:
            size, at = varint(data, at)
            due.append((tag, None, size))
        else:
            due.append((tag, (1 if value == mask else value >> (mask & -mask).bit_length() - 1) * each, None))
    out = {}
    for tag, count, size in due:
        values, stop = [], at + size if size is not None else None
        while (at < stop) if stop is not None else (len(values) < count):
            v, at = varint(data, at)
            values.append(v)
        out[tag] = values
    return out


def index_of(records: list[bytes], at: int) -> tuple[list[tuple[bytes, dict[int, list[int]]]], dict[int, bytes]]:
    """Entries (label, values by tag) and texts by place of the index table that starts at a record."""
    main = records[at]
    length, count, texts = _u32(main, 4), _u32(main, 24), _u32(main, 52)
    names: dict[int, bytes] = {}
    for k, r in enumerate(records[at + count + 1 : at + count + 1 + texts]):
        p = 0
        while p < len(r) and r[p]:
            size, q = varint(r, p)
            names[p + k * 0x10000] = r[q : q + size]
            p = q + size
    table = []
    if main[length : length + 4] == b"TAGX":
        table = [tuple(main[p : p + 4]) for p in range(length + 12, length + _u32(main, length + 4), 4)]
    controls, entries = _u32(main, length + 8), []
    for r in records[at + 1 : at + 1 + count]:
        if r[:4] != b"INDX":
            raise MobiError("not an INDX record")
        places, wide = _u32(r, 20), None
        if len(r) >= 0xB8 and (order := _u32(r, 0xB0)) + 4 <= len(r) and r[order : order + 4] == b"ORDT":
            wide = struct.unpack_from(f">{_u32(r, 0xA8)}H", r, order + 4)
        for j in range(_u32(r, 24)):
            p = _u16(r, places + 4 + 2 * j)
            label = r[p + 1 : p + 1 + r[p]]
            entries.append((bytes(wide[b] & 0xFF for b in label) if wide else label, _tags(table, controls, r, p + 1 + r[p])))
    return entries, names


# -- headers -------------------------------------------------------------------------------------------------------


@dataclass
class Header:
    """What the first record of a book says."""

    start: int
    compression: int
    texts: int
    encryption: int
    is_mobi: bool = False
    encoding: int = 1252
    version: int = 0
    name: str = ""
    image: int = NONE
    huff: tuple[int, int] = (NONE, 0)
    extra: int = 0
    contents: int = NONE
    flows: int = NONE
    fragments: int = NONE
    skeletons: int = NONE
    exth: dict[int, list[bytes]] = field(default_factory=dict)

    def decode(self, b: bytes) -> str:
        return b.decode("utf-8" if self.encoding == 65001 else "cp1252", "replace")

    def strings(self, kind: int) -> list[str]:
        return [t for b in self.exth.get(kind, []) if (t := self.decode(b).rstrip("\0").strip())]


def header_of(records: list[bytes], start: int) -> Header:
    r = records[start] if start < len(records) else b""
    if len(r) < 16:
        raise MobiError("no header record")
    h = Header(start, _u16(r, 0), _u16(r, 8), _u16(r, 12), r[16:20] == b"MOBI")
    if not h.is_mobi:
        return h
    end = 16 + _u32(r, 20)
    at = lambda p, default=NONE: _u32(r, p) if p + 4 <= min(end, len(r)) else default
    h.encoding, h.version = _u32(r, 28), at(36, 0)
    place, size = at(84, 0), at(88, 0)
    h.name = h.decode(r[place : place + size]).rstrip("\0") if place + size <= len(r) else ""
    h.image, h.huff = at(108), (at(112), at(116, 0))
    h.extra = _u16(r, 0xF2) if h.version >= 5 and 0xF4 <= end else 0
    h.contents = at(0xF4)
    if h.version >= 8:
        h.flows = at(0xC0) if at(0xC4, 0) > 1 else NONE
        h.fragments, h.skeletons = at(0xF8), at(0xFC)
    if at(128, 0) & 0x40 and r[end : end + 4] == b"EXTH":
        p = end + 12
        for _ in range(_u32(r, end + 8, 0)):
            size = _u32(r, p + 4, 0)
            if size < 8:
                break
            h.exth.setdefault(_u32(r, p), []).append(r[p + 8 : p + size])
            p += size
    return h


def _find(records: list[bytes], h: Header, i: int, mark: bytes) -> int | None:
    """A record by its number in a header: counted from the header, else from the start."""
    return next((k for k in (h.start + i, i) if i != NONE and k < len(records) and records[k].startswith(mark)), None)


def text_of(records: list[bytes], h: Header) -> bytes:
    """A book's text; protected books are refused."""
    if h.encryption:
        raise MobiError("the book is protected and can't be read")
    unpack: Callable[[bytes], bytes]
    if h.compression in (1, 2):
        unpack = palmdoc if h.compression == 2 else bytes
    elif h.compression == 17480:
        at = _find(records, h, h.huff[0], b"HUFF")
        if at is None:
            raise MobiError("no HUFF record")
        unpack = Huff(records[at], records[at + 1 : at + h.huff[1]]).unpack
    else:
        raise MobiError(f"unknown compression {h.compression}")
    return b"".join(unpack(r[: max(0, len(r) - (trailing(r, h.extra) if h.extra else 0))]) for r in records[h.start + 1 : h.start + 1 + h.texts])


def details_of(h: Header) -> dict:
    """Title, authors, language and ISBNs; the title "" if the book names none."""
    from quirelake.sources.formats import isbn13

    found = [isbn13(v, True) for v in h.strings(104)] + [isbn13(v) for v in h.strings(112)]
    return {"title": next(iter(h.strings(503)), h.name), "author": ", ".join(h.strings(100)), "language": next(iter(h.strings(524)), ""), "isbns": list(dict.fromkeys(filter(None, found))), "series": [], "css": "", "cover": None}


# -- books ---------------------------------------------------------------------------------------------------------


def image_kind(r: bytes) -> str | None:
    return _IMAGES.get(r[:2]) or ("webp" if r[:4] == b"RIFF" and r[8:12] == b"WEBP" else None)


def _pictures(records: list[bytes], h: Header) -> tuple[Callable[[int], str | None], int | None]:
    """A resolver of picture numbers, from 1, and the record of the cover."""
    first = next((k for k in (h.start + h.image, h.image) if h.image != NONE and k < len(records) and image_kind(records[k])), None)
    first = next((i for i, r in enumerate(records) if len(r) > 8 and image_kind(r)), None) if first is None else first
    shown = lambda k: first is not None and 0 <= k < len(records) and len(records[k]) > 8 and image_kind(records[k])
    name = lambda n: f"images/{first + n - 1}.{image_kind(records[first + n - 1])}" if n > 0 and shown(first + n - 1) else None
    offered = [first + int.from_bytes(v[0][:4], "big") for kind in (201, 202) if first is not None and len((v := h.exth.get(kind, [b""]))[0]) >= 4] + ([first] if first is not None else [])
    return name, next((k for k in offered if shown(k)), None)


def with_anchors(data: bytes, places: set[int], prefix: str) -> bytes:
    """Anchors at byte places, moved behind a tag that they fall inside of, and into the body."""
    body = re.search(rb"<body[^>]*>", data, re.I)
    start = body.end() if body else 0
    goals: dict[int, list[int]] = {}
    for p in sorted(x for x in places if 0 <= x <= len(data)):
        at = max(p, start)
        if data.rfind(b"<", 0, at) > data.rfind(b">", 0, at):
            at = (data.find(b">", at) + 1) or at
        goals.setdefault(at, []).append(p)
    out, last = [], 0
    for at in sorted(goals):
        out += [data[last:at], *(f'<a id="{prefix}{p}"></a>'.encode() for p in goals[at])]
        last = at
    return b"".join([*out, data[last:]])


def contents_of(entries: list[tuple[bytes, dict]], names: dict[int, bytes], h: Header, place: Callable[[dict], int | None], prefix: str) -> list[Entry]:
    """Contents of an index: parents where it names them, else by depth."""
    kept = [(i, t, p) for i, (_, t) in enumerate(entries) if (p := place(t)) is not None]
    at = {i: k for k, (i, _, _) in enumerate(kept)}
    named = any(t.get(21) for _, t, _ in kept)
    parents: list[int | None] = []
    for k, (_, t, _) in enumerate(kept):
        depth = (t.get(4) or [0])[0]
        if named:
            parents.append(at.get((t.get(21) or [None])[0]))
        else:
            parents.append(next((j for j in range(k - 1, -1, -1) if (kept[j][1].get(4) or [0])[0] < depth), None))
    made: list[Entry] = []
    for k, (_, t, p) in enumerate(kept):
        title = h.decode(names.get((t.get(3) or [-1])[0], b"")).strip()
        up = parents[k]
        made.append(Entry(title or f"Section {k + 1}", f"mobi#{prefix}{p}", made[up].depth + 1 if up is not None and up < k else 0, up if up is not None and up < k else None))
    return made


def _indexed(records: list[bytes], h: Header) -> tuple[list, dict]:
    at = _find(records, h, h.contents, b"INDX")
    return index_of(records, at) if at is not None else ([], {})


def _link(href: str) -> str | None:
    return f"mobi{href}" if href.startswith("#") else None


def older(records: list[bytes], h: Header) -> tuple[dict, list, list]:
    """A book of byte positions; page breaks end chapters that hold enough text."""
    raw = text_of(records, h)
    entries, names = _indexed(records, h)
    contents = contents_of(entries, names, h, lambda t: (t.get(1) or [None])[0], "filepos")
    goals = {int(p) for p in re.findall(rb"filepos=[\"']?(\d+)", raw, re.I)} | {int(e.key.partition("filepos")[2]) for e in contents}
    html = h.decode(with_anchors(raw, goals, "filepos"))
    html = re.sub(r"<a([^>]*?)\sfilepos=[\"']?(\d+)[\"']?", lambda m: f'<a{m[1]} href="#filepos{int(m[2])}"', html, flags=re.I)
    html = re.sub(r"<img([^>]*?)\s(?:hi|lo)?recindex=[\"']?(\d+)[\"']?", r'<img\1 src="rec:\2"', html, flags=re.I)
    name, cover = _pictures(records, h)
    pieces, run = [], ""
    for piece in re.split(r"<mbp:pagebreak\s*/?>", html, flags=re.I):
        run += piece
        if len(re.sub(r"<[^>]+>", "", run)) > CHAPTER_CHARS:
            pieces.append(run)
            run = ""
    pieces += [run] if run.strip() else []
    picture = lambda src: name(int(src[4:])) if re.fullmatch(r"rec:\d+", src) else None
    chapters = [Chapter(markup.normalised(p, Context(picture, _link)), "mobi") for p in pieces]
    return (details_of(h) | {"cover": cover}, *assembly.assemble(chapters, contents))


def newer(records: list[bytes], h: Header) -> tuple[dict, list, list]:
    """A book of skeletons, into which fragments are put at their places, and further flows with styles."""
    raw = text_of(records, h)
    flows = [raw]
    if (at := _find(records, h, h.flows, b"FDST")) is not None:
        r = records[at]
        flows = [raw[_u32(r, 12 + 8 * i, 0) : _u32(r, 16 + 8 * i, 0)] for i in range(_u32(r, 8, 0))]
    skeletons, fragments = (_find(records, h, i, b"INDX") for i in (h.skeletons, h.fragments))
    parts, table = [], []
    if skeletons is not None and fragments is not None:
        two = lambda t: [*(t.get(6) or []), 0, 0][:2]
        table = [(int(label.decode("latin-1") or 0), *two(t)) for label, t in index_of(records, fragments)[0]]
        k = 0
        for _, t in index_of(records, skeletons)[0]:
            start, size = two(t)
            body, end = flows[0][start : start + size], start + size
            for place, _, n in table[k : k + (t.get(1) or [0])[0]]:
                cut = max(0, min(place - start, len(body)))
                body = body[:cut] + flows[0][end : end + n] + body[cut:]
                end += n
                k += 1
            parts.append((start, end, body))
    parts = parts or [(0, len(flows[0]), flows[0])]
    place_of = lambda fid, off: (table[fid][0] if fid < len(table) else 0) + off
    entries, names = _indexed(records, h)
    contents = contents_of(entries, names, h, lambda t: place_of(t[6][0], [*t[6], 0][1]) if t.get(6) else (t.get(1) or [None])[0], "kpos")
    link = re.compile(rb"kindle:pos:fid:([0-9A-V]+):off:([0-9A-V]+)", re.I)
    goals = {place_of(int(a, 32), int(b, 32)) for _, _, body in parts for a, b in link.findall(body)} | {int(e.key.partition("kpos")[2]) for e in contents}
    name, cover = _pictures(records, h)
    picture = lambda src: name(int(src[4:])) if re.fullmatch(r"res:\d+", src) else None
    css, chapters = [f.decode("utf-8", "replace") for f in flows[1:] if not f.lstrip().startswith(b"<")], []
    for start, end, body in parts:
        here = {p - start: p for p in goals if start <= p < end}
        html = h.decode(with_anchors(body, set(here), "at"))
        html = re.sub(r'<a id="at(\d+)"></a>', lambda m, here=here: f'<a id="kpos{here[int(m[1])]}"></a>', html)
        html = re.sub(link.pattern.decode(), lambda m: f"#kpos{place_of(int(m[1], 32), int(m[2], 32))}", html, flags=re.I)
        html = re.sub(r"kindle:embed:([0-9A-V]+)(\?mime=[^\"'\s]*)?", lambda m: f"res:{int(m[1], 32)}", html, flags=re.I)
        css += re.findall(r"<style[^>]*>(.*?)</style>", html, re.S | re.I)
        chapters.append(Chapter(markup.normalised(html, Context(picture, _link)), "mobi"))
    return (details_of(h) | {"cover": cover, "css": styles.stylesheet("\n".join(css), ".book-content")}, *assembly.assemble(chapters, contents))


def read_metadata(data: bytes) -> dict:
    name, _, records = records_of(data)
    h = header_of(records, 0)
    return details_of(h) if h.is_mobi else details_of(Header(0, 1, 0, 0, name=name))


def from_mobi(data: bytes) -> tuple[dict, list, list]:
    """Plain PalmDOC text, an older book, a newer one, or both in a file."""
    name, kind, records = records_of(data)
    if kind not in ("BOOK", "TEXt"):
        raise MobiError("not a Mobipocket file")
    h = header_of(records, 0)
    if not h.is_mobi:
        from quirelake.sources.formats import decode_text

        root = markup.normalised(f"<body>{plain.text_to_html(decode_text(text_of(records, h)))}</body>")
        return (details_of(Header(0, 1, 0, 0, name=name)), *assembly.assemble([Chapter(root, "text")], []))
    border = next((i for i, r in enumerate(records) if i and r == b"BOUNDARY"), None)
    later = h if h.version >= 8 else None
    if later is None and border is not None and border + 1 < len(records):
        try:
            other = header_of(records, border + 1)
            later = other if other.is_mobi and other.version >= 8 else None
        except MobiError:
            later = None
    if later is not None:
        try:
            made = newer(records, later)
            if any(s.chars for s in made[1]):
                return made
        except (MobiError, IndexError, ValueError, struct.error):
            if h.version >= 8:
                raise
    return older(records, h)
