"""Keys and small parsers over names, titles, numbers and identifiers, as Column expressions.

Only Unicode normalisation needs Python (Spark has no function for it); it is an Arrow-batched UDF. Nulls stay
null unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: White space as the web's regular expressions have it; Java's \s is ASCII only.
SPACES = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# Fixed values.
#: Words too common to tell two titles apart.
COMMON = ["a", "an", "and", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with", "af", "de", "den", "det", "en", "et", "i", "med", "og", "på", "til"]
#: Articles that may lead a series name.
ARTICLES = ["the", "a", "an", "den", "det", "de", "der", "die", "das", "le", "la", "les", "el", "il"]
QUOTES, DOUBLE_QUOTES, DASHES = "‘’‛´`", "“”„", "‐‑‒–—―"
MAX_NAME, MAX_POSITION, SAME_TITLE = 200, 99999, 0.8


@pandas_udf(StringType())
def fold_marks(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c)[0] != "M"), na_action="ignore")


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")


def utf16_len(s: Column) -> Column:
    """Length in UTF-16 code units: astral characters count twice."""
    return F.length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def collapse(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, SPACES + "+", " "))


def word_list(s: Column) -> Column:
    """Runs of letters and digits of a folded, lower-cased name."""
    return F.regexp_extract_all(F.lower(fold_marks(s)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def title_key(s: Column) -> Column:
    """Case, accents and punctuation aside."""
    return F.array_join(word_list(s), " ")


def author_key(s: Column) -> Column:
    """The words of a name in order, so that both ways to write it agree."""
    return F.array_join(F.array_sort(word_list(s)), " ")


def clean_series_name(s: Column) -> Column:
    """Single spaces, no separators around it, 200 characters at most."""
    edge = r"[\t-\r \x{00a0},:;\-–—]+"
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, SPACES + "+", " "), "^" + edge, ""), edge + "$", "")
    return F.btrim(F.substring(flat, 1, MAX_NAME))


def series_key(s: Column) -> Column:
    """Case, quotes and dashes do not matter."""
    return F.translate(F.lower(nfkc(clean_series_name(s))), QUOTES + DOUBLE_QUOTES + DASHES, "'" * len(QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES))


def loose_key(s: Column) -> Column:
    """No leading article, no trailing "series"."""
    return F.regexp_replace(F.regexp_replace(series_key(s), f"^({'|'.join(ARTICLES)}) ", ""), r"[ -]seri(es|en)$", "")


def same_series_name(a: Column, b: Column) -> Column:
    """An empty key never matches."""
    x = loose_key(a)
    return (x != "") & (x == loose_key(b))


def parse_position(s: Column) -> Column:
    """J08: "3", "03", "2.5" or "2,5" up to 99999 with two decimals, else null."""
    n = F.regexp_extract(s, rf"^{SPACES}*(\d{{1,5}}([.,]\d+)?){SPACES}*$", 1)
    return F.when(n != "", F.round(F.translate(n, ",", ".").try_cast("double"), 2))


def parse_place(s: Column) -> Column:
    """A number or an ascending range, as struct<position, position_end>; equal ends are one number."""
    shape = rf"^{SPACES}*(\d{{1,5}}(?:[.,]\d+)?)(?:{SPACES}*[-–—]{SPACES}*(\d{{1,5}}(?:[.,]\d+)?))?{SPACES}*$"
    a, b = parse_position(F.regexp_extract(s, shape, 1)), parse_position(F.regexp_extract(s, shape, 2))
    place = F.struct(a.alias("position"), F.when(b > a, b).alias("position_end"))
    return F.when(a.isNotNull() & (b.isNull() | (b >= a)), place)


def telling_words(s: Column) -> Column:
    """The distinct words that tell a title apart; all of them if there are no others."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    telling = F.array_except(words, F.array(*map(F.lit, COMMON)))
    return F.when(F.size(telling) > 0, telling).otherwise(words)


def jaccard(x: Column, y: Column) -> Column:
    """Shared over all words, 0 if none is shared."""
    both = F.size(F.array_intersect(x, y))
    return F.when(both > 0, both / (F.size(x) + F.size(y) - both)).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    return jaccard(telling_words(a), telling_words(b))


def same_author(a: Column, b: Column) -> Column:
    """A telling word longer than a letter in common."""
    return F.exists(F.array_intersect(telling_words(a), telling_words(b)), lambda w: F.length(w) > 1)


def surname(name: Column) -> Column:
    """What an author is sorted by, for both ways to write a name; jr., sr. and numerals aside."""
    suffix = r"(?i)^(jr|sr|ii|iii|iv)\.?$"
    head, tail = F.btrim(F.substring_index(name, ",", 1)), F.btrim(F.regexp_extract(name, r"(?s)^[^,]*,(.*)$", 1))
    parts = F.split(head, SPACES + "+")
    kept = F.reverse(F.filter(F.reverse(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i")))), lambda x: (x["i"] == 0) | ~x["p"].rlike(suffix)))
    inverted = (F.instr(name, ",") > 1) & (tail != "") & ~tail.rlike(suffix)
    return F.when(inverted, head).otherwise(F.coalesce(F.element_at(kept, -1)["p"], F.lit("")))


def author_names(line: Column) -> Column:
    """J21: ";" parts authors; "&", "and" and "," do if every part is a whole name. Repeats (by key) go."""
    whole = lambda p: p.contains(" ") & ~p.rlike(r"(^|\s)\p{L}\.?$")
    names = F.filter(F.transform(F.split(F.coalesce(line, F.lit("")), ";"), collapse), lambda n: n != "")
    def parted_at(separator: str):
        def part(n: Column) -> Column:
            parts = F.filter(F.split(n, separator), lambda p: p != "")
            return F.when((F.size(parts) > 1) & F.forall(parts, whole), parts).otherwise(F.array(n))

        return part

    for separator in (r"\s*&\s*|(?i)\s+and\s+", r"\s*,\s*"):
        names = F.flatten(F.transform(names, parted_at(separator)))
    plain = lambda n: F.array_join(F.array_sort(F.regexp_extract_all(F.lower(n), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), " ")
    return F.filter(names, lambda n, i: F.array_position(F.transform(names, plain), plain(n)) == i + 1)


def _digit_sum(digits: Column, weights: list[int]) -> Column:
    out = F.lit(0)
    for i, w in enumerate(weights, 1):
        d = F.substring(digits, i, 1)
        out = out + F.when(d == "X", 10).otherwise(F.coalesce(d.try_cast("int"), F.lit(0))) * w
    return out


def read_isbn(value: Column, marked: Column | None = None) -> Column:
    """An ISBN as 13 digits, or null. Ten digits count only with a marker such as `urn:isbn:`."""
    marker = r"(?i)^(?:urn:)?isbn(?:[-\s]?1[03])?(?:\s*:\s*|\s+)"
    s = F.btrim(F.coalesce(value, F.lit("")))
    is_marked = s.rlike(marker) if marked is None else s.rlike(marker) | marked
    d = F.upper(F.regexp_replace(F.regexp_extract(F.regexp_replace(s, marker, ""), r"^[0-9Xx][0-9Xx\s-]*", 0), r"[\s-]", ""))
    thirteen = d.rlike(r"^97[89][0-9]{10}$") & (_digit_sum(d, [1, 3] * 6 + [1]) % 10 == 0)
    ten = is_marked & d.rlike(r"^[0-9]{9}[0-9X]$") & (_digit_sum(d, list(range(10, 0, -1))) % 11 == 0)
    body = F.concat(F.lit("978"), F.substring(d, 1, 9))
    return F.when(thirteen, d).when(ten, F.concat(body, ((10 - _digit_sum(body, [1, 3] * 6) % 10) % 10).cast("string")))


def slugify(s: Column) -> Column:
    """Lower-cased letters, digits and hyphens, without tags."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.btrim(s)), "<[^>]+>", ""), r"[^\p{L}\p{N}\s-]", ""), r"\s+", "-")


def reading_status(percent: Column) -> Column:
    """Unread without progress, finished from 98 %, else reading."""
    return F.when(percent.isNull(), "unread").when(percent >= 0.98, "finished").otherwise("reading")


def date_label(ts: Column, now: Column, zone: str = "Europe/Copenhagen") -> Column:
    """The time today, `d MMM` this year, else `d MMM yyyy`; timestamps are UTC."""
    t, n = F.from_utc_timestamp(ts, zone), F.from_utc_timestamp(now, zone)
    return F.when(F.to_date(t) == F.to_date(n), F.date_format(t, "HH:mm")).when(F.year(t) == F.year(n), F.date_format(t, "d MMM")).otherwise(F.date_format(t, "d MMM yyyy"))


def is_scene_break(text: Column) -> Column:
    """Only marks, or three dots or bullets and more."""
    t = F.btrim(text)
    return t.rlike(r"^(?:[*#~⁂]\s*)+$") | t.rlike(r"^(?:[•·]\s*){3,}$")


# Who made a scan, and sites that sign the books they hand out.
_CREDIT = "(?:scanned|proofed|proof-?read|(?:re-?)?formatted|converted|uploaded)"
CREDIT_SITES = r"demonoid|\bz-lib(?:rary)?\b|\blibgen\b|\blibrary genesis\b"


def is_credit_line(text: Column, sites: str = CREDIT_SITES) -> Column:
    """A short paragraph that credits who scanned or uploaded a book, or names a download site."""
    t = collapse(text)
    credit = rf"(?i)^[\p{{P}}\p{{S}}\s]*{_CREDIT}(?:\s*(?:,|&|\+|/|\band\b)\s*(?:and\s+)?{_CREDIT})*\s+by\b"
    return (F.length(t) > 0) & (F.length(t) < 200) & (t.rlike(credit) | t.rlike(f"(?i){sites}"))


def strip_site_marks(text: Column, site: str) -> Column:
    """Every mention of a site goes, with its scheme and the white space in front of it."""
    spaced = r"\s*".join(c if c.isalnum() else "\\" + c for c in site)
    return F.regexp_replace(text, rf"(?i)(?<!\s)\s*(?:https?://)?(?:www\.)?{spaced}\b/?", "")


#: Stems that keep their hyphen at a line end.
COMPOUND_PREFIXES = """self well non anti multi semi half quasi pseudo cross high low long short full part real free open first second
third one two three four five six seven eight nine ten single double triple large small old new left right hand hard soft wide deep
best worst vice so ever ill""".split()


def join_hyphenated(before: Column, after: Column) -> Column:
    """A word parted by a line end; the hyphen stays after digits, before capitals and in compounds."""
    word = F.regexp_extract(before, r"(\S+?)-$", 1)
    stem = F.lower(F.regexp_extract(word, r"([A-Za-z]*)$", 1))
    keep = word.rlike(r"\d$") | ~after.rlike("^[a-z]") | stem.isin(COMPOUND_PREFIXES) | word.rlike("[A-Za-z]-[A-Za-z]")
    return F.when(word != "", F.when(keep, F.concat(before, after)).otherwise(F.concat(F.substring(before, F.lit(1), F.length(before) - 1), after)))


def line_key(text: Column) -> Column:
    """What a running line has in common over pages: numbers as #, no quotes, one kind of separator."""
    t = F.regexp_replace(text, r"[0-9]+(\s[0-9]+)*", "#")
    return F.lower(F.btrim(F.regexp_replace(F.translate(t, "\"'`“”‘’„«»", ""), r"[\s|·•—–-]+", " ")))


def is_noise(text: Column) -> Column:
    """No word of two letters, no chapter number and no scene break."""
    t = F.btrim(text)
    return ~t.rlike(r"[\p{L}\p{N}]{2}") & ~t.rlike(r"^([0-9]{1,3}|[IVXLC]{1,6})\.?$") & ~t.rlike(r"^([*•·.–—-]\s*){3,}$")


# Fixed values.
ROMAN = "(?=[ivxlcdm])m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
NUMBER_WORDS = """one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred first second third fourth fifth sixth seventh eighth ninth tenth last
en et to tre fire fem seks syv otte ni ti elleve tolv tretten fjorten femten seksten sytten atten nitten tyve tredive fyrre halvtreds
tres halvfjerds firs halvfems hundrede første anden andet tredje fjerde femte sjette syvende ottende niende tiende sidste""".split()
CHAPTER_NAMES = "chapter part book kapitel del bog".split()
UNNUMBERED = "prologue prolog epilogue epilog interlude efterskrift".split()


def _chapter_words() -> str:
    number = rf"(?:[0-9]+|{ROMAN}|(?:{'|'.join(NUMBER_WORDS)})(?:-\p{{L}}+)?|(?:en|to|tre|fire|fem|seks|syv|otte|ni)og\p{{L}}+)(?![\p{{L}}0-9])"
    return rf"(?:(?:{'|'.join(CHAPTER_NAMES)})\s+{number}|(?:{'|'.join(UNNUMBERED)})(?!\p{{L}}))[^0-9]*"


def is_chapter_line(text: Column) -> Column:
    """A paragraph that names a chapter by its words; no further number may follow."""
    return text.rlike(f"(?iu)^{_chapter_words()}$")


def is_chapter_title(text: Column) -> Column:
    """A heading: a chapter's words, or a bare number in digits or Roman numerals."""
    return text.rlike(rf"(?iu)^(?:{_chapter_words()}|(?:[0-9]+|{ROMAN})\.?)$")


def guess_device(agent: Column, touch_points: Column | None = None) -> Column:
    """What kind of device a user agent names; a Macintosh that is touched is an iPad."""
    has = agent.rlike
    touched = F.coalesce(touch_points if touch_points is not None else F.lit(0), F.lit(0)) > 1
    return (
        F.when(has("iPhone"), "iPhone")
        .when(has("iPad") | (has("Macintosh") & touched), "iPad")
        .when(has("(?i)Boox|Onyx"), "Boox")
        .when(has("Android") & has("Mobile"), "Android phone")
        .when(has("Android"), "Android tablet")
        .when(has("Macintosh"), "Mac")
        .when(has("Windows"), "Windows PC")
        .when(has("Linux"), "Linux")
        .otherwise("Browser")
    )


def five_words(text: Column) -> Column:
    """A paragraph's first five words, lower-cased: how it is known again when it changed further on."""
    return F.lower(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, 5), " "))


def clean_genre(name: Column) -> Column:
    """Single spaces, none around it, 100 characters at most; "" for none."""
    return F.btrim(F.substring(collapse(F.coalesce(name, F.lit(""))), 1, 100))


def genre_key(name: Column) -> Column:
    """Case, quotes and dashes do not matter."""
    return F.translate(F.lower(nfkc(clean_genre(name))), QUOTES + DASHES, "'" * len(QUOTES) + "-" * len(DASHES))


def path_key(path: Column) -> Column:
    """A path as it sorts, with every number by its value."""
    parts = F.regexp_extract_all(F.lower(path), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    padded = lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), 20, "0")).otherwise(p)
    return F.array_join(F.transform(parts, padded), "")


def language_tag(value: Column) -> Column:
    """A tag as browsers write it: language in lower case, region in capitals; "" for none or `und`.

    Three-letter codes with a two-letter one become it.
    """
    v = F.btrim(F.coalesce(value, F.lit("")))
    lang, rest = F.lower(F.regexp_extract(v, r"^([A-Za-z]{2,3})(?:-|$)", 1)), F.regexp_extract(v, r"^[A-Za-z]{2,3}(-.*)?$", 1)
    short = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), lang), lang)
    ok = v.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*$") & (lang != "und")
    part = lambda p: F.when(p.rlike("^[A-Za-z]{2}$"), F.upper(p)).when(p.rlike("^[A-Za-z]{4}$"), F.initcap(p)).otherwise(F.lower(p))
    return F.when(ok, F.array_join(F.concat(F.array(short), F.transform(F.filter(F.split(rest, "-"), lambda p: p != ""), part)), "-")).otherwise("")


def language_code(value: Column) -> Column:
    """The language of a tag alone."""
    return F.substring_index(language_tag(value), "-", 1)


#: Three-letter codes of languages that have a two-letter one (ISO 639).
LANGUAGES = dict(x.split("=") for x in "eng=en dan=da deu=de ger=de fra=fr fre=fr spa=es ita=it nor=no swe=sv nld=nl dut=nl fin=fi por=pt rus=ru pol=pl isl=is ice=is jpn=ja zho=zh chi=zh lat=la".split())


def search_text(text: Column) -> Column:
    """A search without characters that the catalogue's query language reads."""
    return collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r'[+\-&|!(){}\[\]^"~*?:\\/]', " "))


def search_for(text: Column) -> Column:
    """A leading "by" in quotes, so that it is a word of the title and not an author's mark."""
    return F.regexp_replace(text, r"(?i)^(by)(?=\s)", '"$1"')


def public_image_url(url: Column) -> Column:
    """An https address outside of internal networks, else null."""
    host = F.lower(F.regexp_extract(url, r"^https://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    inside = host.rlike(r"^[0-9.]+$") | host.contains(":") | host.contains("[") | host.rlike(r"(^|\.)(localhost|local|internal)$")
    return F.when((host != "") & ~inside, url)


def book_uuid(book: Column, space: str = "ereader:") -> Column:
    """A book's identifier, made from its id as a name-based UUID (version 5) is."""
    h = F.sha1(F.concat(F.lit(space), book.cast("string")))
    nibble = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), nibble, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def xml_safe(text: Column) -> Column:
    """Text without the characters that XML can't hold."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFE}\x{FFFF}]", "")


def base32(text: Column) -> Column:
    """A number in the digits 0-9 and A-V."""
    return F.conv(text, 32, 10).cast("long")


def valid_username(name: Column) -> Column:
    """J43."""
    return F.coalesce(name.rlike(r"^[a-zA-Z0-9._-]{2,32}$"), F.lit(False))


def valid_password(word: Column) -> Column:
    """J43."""
    return F.coalesce(utf16_len(word).between(4, 256), F.lit(False))
