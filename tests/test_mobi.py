"""Mobipocket files made here, read again."""

import struct

import pytest

from quirelake.operators.assembly import Node
from quirelake.operators.markup import written
from quirelake.sources import books, mobi

PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 20


def pack(data):
    """PalmDOC compression: copies where there are some, spaces with a letter, runs of other bytes."""
    out, i = bytearray(), 0
    while i < len(data):
        best = max(((n, d) for d in range(1, min(2047, i) + 1) for n in [next((k for k in range(10) if i + k >= len(data) or data[i + k - d] != data[i + k]), 10)]), default=(0, 0))
        if best[0] >= 3:
            out += struct.pack(">H", 0x8000 | best[1] << 3 | best[0] - 3)
            i += best[0]
        elif data[i] == 0x20 and i + 1 < len(data) and 0x40 <= data[i + 1] <= 0x7F:
            out.append(data[i + 1] ^ 0x80)
            i += 2
        elif data[i] == 0 or 9 <= data[i] < 0x80:
            out.append(data[i])
            i += 1
        else:
            out += bytes((1, data[i]))
            i += 1
    return bytes(out)


def database(records, name=b"Name"):
    at, places = 78 + 8 * len(records) + 2, b""
    for i, r in enumerate(records):
        places += struct.pack(">II", at, i)
        at += len(r)
    return name.ljust(60, b"\0") + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", len(records)) + places + b"\0\0" + b"".join(records)


def header(texts, size, version=6, exth=(), image=None, extra=0, name=b"Full Name", compression=2, **more):
    body = b"".join(struct.pack(">II", k, 8 + len(v)) + v for k, v in exth)
    body = b"EXTH" + struct.pack(">II", 12 + len(body), len(exth)) + body
    r = bytearray(16 + 0xF0)
    struct.pack_into(">HHIHHHH", r, 0, compression, 0, size, texts, 4096, 0, 0)
    fields = {20: 0xF0, 24: 2, 28: 65001, 36: version, 84: len(r) + len(body), 88: len(name), 108: mobi.NONE if image is None else image, 112: mobi.NONE, 128: 0x40, 0xC0: mobi.NONE, 0xF4: mobi.NONE, 0xF8: mobi.NONE, 0xFC: mobi.NONE} | {int(k[1:], 16): v for k, v in more.items()}
    r[16:20] = b"MOBI"
    for at, v in fields.items():
        struct.pack_into(">I", r, at, v)
    struct.pack_into(">H", r, 0xF2, extra)
    return bytes(r) + body + name


def vint(n):
    out = [n & 0x7F | 0x80]
    while n := n >> 7:
        out.insert(0, n & 0x7F)
    return bytes(out)


def index(entries, tags, names=b""):
    """An index of entries (label, [(tag, values)]), one control byte with a bit a tag."""
    table = b"".join(bytes((t, n, 1 << i, 0)) for i, (t, n) in enumerate(tags)) + b"\0\0\0\1"
    main = b"INDX" + struct.pack(">13I", 192, 0, 0, 0, 0, 1, 65001, 0, len(entries), 0, 0, 0, 1 if names else 0)
    main = main.ljust(192, b"\0") + b"TAGX" + struct.pack(">II", 12 + len(table), 1) + table
    data, places = b"", []
    for label, values in entries:
        places.append(192 + len(data))
        have = dict(values)
        data += bytes((len(label),)) + label + bytes((sum(1 << i for i, (t, _) in enumerate(tags) if t in have),)) + b"".join(vint(v) for t, _ in tags for v in have.get(t, []))
    rec = (b"INDX" + struct.pack(">13I", 192, 0, 1, 0, 192 + len(data), len(entries), 0, 0, 0, 0, 0, 0, 0)).ljust(192, b"\0") + data + b"IDXT" + b"".join(struct.pack(">H", p) for p in places)
    return [main, rec, *([names] if names else [])]


HEAD, FILLER = b"<html><body>", ("<p>Filler that repeats, repeats and repeats. Ünïcödé ✓.</p>" * 60).encode()


def old_book(extra=1, toc=True):
    one, two = b"<h1>One</h1><p>See <a filepos=%010d>two</a>.</p>" + FILLER + b"<mbp:pagebreak/>", b'<h1>Two</h1><p>Image <img recindex="00001"/></p><p><a filepos=0000000000>start</a></p></body></html>'
    place = len(HEAD) + len(one % 0)
    text = HEAD + one % place + two
    parts = [text[i : i + 4096] for i in range(0, len(text), 4096)]
    records = [pack(p) + (b"\0" if extra else b"") for p in parts]
    n = len(records)
    names = vint(3) + b"One" + vint(3) + b"Two" + b"\0"
    table = index([(b"a", [(1, [len(HEAD)]), (3, [0]), (4, [0])]), (b"b", [(1, [place]), (3, [4]), (4, [0])])], [(1, 1), (3, 1), (4, 1)], names)
    exth = [(100, b"Ann"), (100, b"Bo"), (503, "Tïtle".encode()), (104, b"9780316129084"), (201, b"\0\0\0\0"), (524, b"en")]
    more = {"xF4": n + 2} if toc else {}
    return database([header(n, len(text), exth=exth, image=n + 1, extra=extra, **more), *records, PNG, *(table if toc else [])])


@pytest.mark.parametrize("extra", [0, 1])
@pytest.mark.parametrize("toc", [False, True])
def test_older_books(extra, toc):
    meta, sections, contents = books.convert(old_book(extra, toc), "x.mobi")
    assert (meta["title"], meta["author"], meta["language"], meta["isbns"], meta["format"]) == ("Tïtle", "Ann, Bo", "en", ["9780316129084"], "mobi")
    assert [(c["title"], c["section"]) for c in contents] == [("One", 0), ("Two", 1)]
    html = [written(Node("#root", {}, s.nodes)) for s in sections]
    assert 'data-sec="1"' in html[0] and "Ünïcödé ✓" in html[0] and 'data-src="images/' in html[1] and 'data-sec="0"' in html[1]
    assert books.read_metadata(old_book(extra, toc), "x.mobi")["author"] == "Ann, Bo"


def test_newer_books():
    skeleton, body = b"<html><body></body></html>", b"<h1>Part</h1><p>Hi <a href='kindle:pos:fid:0000:off:0000000D'>x</a> <img src='kindle:embed:0001?mime=image/png'/></p>"
    css = b"p{text-align:center;color:red}"
    text = skeleton + body + css
    frag = index([(b"0000000012", [(6, [0, len(body)])])], [(6, 2)])
    skel = index([(b"SKEL", [(1, [1]), (6, [0, len(skeleton)])])], [(1, 1), (6, 2)])
    flows = b"FDST" + struct.pack(">II", 12, 2) + struct.pack(">4I", 0, len(skeleton + body), len(skeleton + body), len(text))
    head = header(1, len(text), version=8, exth=[(503, b"New")], image=2, compression=1, xF8=3, xFC=5, xC0=7, xC4=2)
    meta, sections, contents = books.convert(database([head, text, PNG, *frag, *skel, flows]), "x.azw3")
    html = written(Node("#root", {}, sections[0].nodes))
    assert meta["title"] == "New" and meta["css"] == ".book-content p{text-align:center}" and contents[0]["title"] == "Part"
    assert 'data-src="images/2.png"' in html and 'id="kpos25"' in html and 'data-id="kpos25"' in html


def test_codecs_and_refusals():
    data = b"repeat repeat repeat " + bytes(range(256))
    assert mobi.palmdoc(pack(data)) == data
    assert mobi.varint(vint(300), 0) == (300, 2) and mobi.trailing(b"xxxx\x83", 2) == 3 and mobi.trailing(b"xx\x01", 1) == 2
    locked = bytearray(old_book())
    at = struct.unpack_from(">I", locked, 78)[0]
    struct.pack_into(">H", locked, at + 12, 2)
    with pytest.raises(mobi.MobiError):
        mobi.from_mobi(bytes(locked))
    with pytest.raises(mobi.MobiError):
        mobi.from_mobi(b"short")
    text = database([struct.pack(">HHIHHHH", 1, 0, 5, 1, 4096, 0, 0), b"Hello."], b"Plain")
    assert mobi.from_mobi(text)[0]["title"] == "Plain"


def test_huff():
    # codes of one bit, the largest first: 1 is the phrase "ab", 0 is "c"
    quick = struct.pack(">I", 1 << 8 | 0x80 | 1) * 256
    huff = b"HUFF\0\0\0\x18" + struct.pack(">II", 24, 24 + 1024) + b"\0" * 8 + quick + b"\0" * 256
    words = [b"ab", b"c"]
    body = b"".join(struct.pack(">H", 0x8000 | len(w)) + w for w in words)
    cdic = b"CDIC\0\0\0\x10" + struct.pack(">II", 2, 1) + struct.pack(">HH", 4, 8) + body
    assert mobi.Huff(huff, [cdic]).unpack(bytes([0b10110000])) == b"abcababcccc"
