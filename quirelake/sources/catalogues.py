"""Answers of outside catalogues as tables: JSON that was fetched before, read into matches and series.

There is no network here: an answer is a row (lookup, catalogue, stage, body). A body that isn't an answer is a row with a
problem, so that one catalogue's failure leaves the other's matches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import keys, titles
from quirelake.operators import resolve

# Fixed values.
WORK_KEY = r"/(works|books)/OL\d+[WM]"
COVERS, BOOKS = "https://covers.openlibrary.org/b/id/{}-L.jpg?default=false", "https://hardcover.app/id/book/{}"
SEARCH_ROWS, ISBNS, MAX_SERIES, MAX_TITLE = 8, 2, 5, 500


class Problem(ValueError):
    """An answer that can't be used, with what to tell the user."""


# -- words (the same rules as columns are in functions.keys) -------------------------------------------------------


def words(text: str | None) -> set[str]:
    """J19."""
    found = set(re.findall(r"[^\W_]+", (text or "").lower()))
    return found - set(keys.COMMON) or found


def likeness(a: str | None, b: str | None) -> float:
    x, y = words(a), words(b)
    return len(x & y) / len(x | y) if x & y else 0.0


def same_title(a: str | None, b: str | None) -> bool:
    return likeness(a, b) >= keys.SAME_TITLE


def same_author(a: str | None, b: str | None) -> bool:
    return any(len(w) > 1 for w in words(a) & words(b))


def language(value: object) -> str:
    """J37."""
    code = value.get("code2") or value.get("code3") if isinstance(value, dict) else value
    short = str(code or "").split("-")[0].lower()
    return keys.LANGUAGES.get(short, short) if re.fullmatch(r"[a-z]{2,3}", short) else ""


def public_url(url: object) -> str | None:
    """An https address outside of internal networks."""
    m = re.match(r"https://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", str(url or ""), re.I)
    host = m[1].lower() if m else ""
    return None if not host or re.fullmatch(r"[\d.]+", host) or host[0] == "[" or re.search(r"(^|\.)(localhost|local|internal)$", host) else str(url)


def _id(value: object) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and value > 0 else None


def _rows(value: object) -> list:
    return value if isinstance(value, list) else []


# -- the open catalogue --------------------------------------------------------------------------------------------


def open_answer(body: str | None) -> list[dict]:
    """The works of a search answer that have a key and a title, 8 at most."""
    try:
        docs = json.loads(body or "").get("docs")
    except (ValueError, AttributeError):
        docs = None
    if not isinstance(docs, list):
        raise Problem("the catalogue could not search just now")
    return [d for d in docs if isinstance(d, dict) and re.fullmatch(WORK_KEY, str(d.get("key"))) and str(d.get("title") or "").strip()][:SEARCH_ROWS]


def open_match(doc: dict, title: str, by_isbn: bool) -> dict:
    """A work, under its best edition's title where that is closer to what was looked for."""
    edition = next(iter(_rows((doc.get("editions") or {}).get("docs"))), {})
    goal = (edition.get("title") or title) if by_isbn else title
    own = isinstance(edition.get("title"), str) and likeness(edition["title"], goal) > likeness(doc["title"], goal)
    on_edition = (own or by_isbn) and re.fullmatch(WORK_KEY, str(edition.get("key")))
    cover = next(filter(None, (_id(edition.get("cover_i")) if on_edition else None, _id(doc.get("cover_i")), _id(edition.get("cover_i")))), None)
    places = _rows(doc.get("series_position"))
    series = titles.unique_series([(n, places[i] if i < len(places) else None, None) for i, n in enumerate(_rows(doc.get("series_name")))])
    shown, series = titles.with_title_series((edition["title"] if own else doc["title"]).strip(), series)
    authors = dict.fromkeys(a for a in _rows(doc.get("author_name")) if isinstance(a, str))
    return {
        "key": doc["key"], "title": shown[:MAX_TITLE], "author": ", ".join(authors)[:MAX_TITLE], "year": doc.get("first_publish_year") if isinstance(doc.get("first_publish_year"), int) else None,
        "series": series, "cover": COVERS.format(cover) if cover else None, "cover_id": cover, "url": "https://openlibrary.org" + (edition["key"] if on_edition else doc["key"]), "by_isbn": by_isbn,
    }


# -- the series catalogue ------------------------------------------------------------------------------------------


def graph_answer(body: str | None, status: int = 200) -> dict:
    """The data of an answer, or what went wrong: 401, 403, 429, or errors in an answer of status 200."""
    told = {401: "the token was not accepted", 403: "the token may not look up books", 429: "too many requests, try again later"}
    if status in told:
        raise Problem(told[status])
    try:
        answer = json.loads(body or "")
    except ValueError:
        answer = None
    errors = _rows(answer.get("errors")) if isinstance(answer, dict) else []
    if status != 200 or errors or not isinstance(answer, dict) or not answer.get("data"):
        raise Problem("could not look it up" + (f": {str(errors[0].get('message'))[:200]}" if errors else ""))
    return answer["data"]


def authors_of(contributions: object) -> str:
    """The authors among contributors, each once."""
    named = (c.get("author") or {} for c in _rows(contributions) if isinstance(c, dict) and (not c.get("contribution") or str(c["contribution"]).lower() == "author"))
    return ", ".join(dict.fromkeys(a["name"].strip() for a in named if isinstance(a.get("name"), str) and a["name"].strip()))


def is_audio(edition: dict | None) -> bool:
    return bool(edition) and edition.get("reading_format_id") == 2


def fitting_edition(book: dict, title: str, author: str) -> dict | None:
    """The edition that fits what was typed better than the book itself."""
    own = authors_of(book.get("contributions"))
    fit = lambda t, a: likeness(t, title) + bool(author and same_author(a, author))
    scored = [(fit(e["title"], authors_of(e.get("contributions")) or own), e) for e in _rows(book.get("editions")) if isinstance(e, dict) and str(e.get("title") or "").strip() and not is_audio(e)]
    best = max(scored, key=lambda x: x[0], default=(0, None))
    return best[1] if best[0] > fit(book["title"], own) else None


def _picture(image: object) -> tuple[int, str] | None:
    url, name = (public_url(image.get("url")), _id(image.get("id"))) if isinstance(image, dict) else (None, None)
    return (name, url) if url and name else None


def graph_match(book: dict, edition: dict | None = None, by_isbn: bool = False, lang: str = "") -> dict:
    """A book as it is listed or as one of its editions, its featured series first."""
    listed = sorted((s for s in _rows(book.get("book_series")) if isinstance((s.get("series") or {}).get("name"), str)), key=lambda s: s.get("featured") is not True)
    shown = str((edition or {}).get("title") or "").strip() or book["title"].strip()
    shown, series = titles.with_title_series(shown, titles.unique_series([(s["series"]["name"], s.get("position"), None) for s in listed]))
    usual = book.get("default_cover_edition") or {}
    lang = lang or language((edition or {}).get("language")) or language(usual.get("language"))
    fits = lambda e: not is_audio(e) and (not lang or language(e.get("language")) in (lang, ""))
    pictures = [p for e in [edition, *(e for e in (usual, *_rows(book.get("inLanguage")), *_rows(book.get("mostRead"))) if e and fits(e))] if e and (p := _picture(e.get("image")))]
    cover = next(iter(pictures), None) or (None if is_audio(usual) else _picture(usual.get("image"))) or _picture(book.get("image"))
    year = next((y for y in ((edition or {}).get("release_year"), book.get("release_year")) if isinstance(y, int)), None)
    author = authors_of((edition or {}).get("contributions")) or authors_of(book.get("contributions"))
    return {"key": f"hardcover:{book['id']}", "title": shown[:MAX_TITLE], "author": author[:MAX_TITLE], "year": year, "series": series, "cover": cover and cover[1], "cover_id": cover and cover[0], "url": BOOKS.format(book["id"]), "by_isbn": by_isbn}


def is_the_book(book: dict, title: str, author: str) -> bool:
    """The title, tidied, is the one looked for, and so is one of the authors where one is known."""
    listed = titles.unique_series([((s.get("series") or {}).get("name"), s.get("position"), None) for s in _rows(book.get("book_series"))])
    return same_title(titles.with_title_series(book["title"].strip(), listed)[0], title) and (not author or same_author(authors_of(book.get("contributions")), author))


def series_ids(books: list[dict], title: str, author: str) -> list[int]:
    """The series of the books that are the one looked for; a merged series by what it went into; 5 at most."""
    found = [_id((s.get("series") or {}).get("canonical_id")) or _id((s.get("series") or {}).get("id")) for b in books if is_the_book(b, title, author) for s in _rows(b.get("book_series"))]
    return list(dict.fromkeys(filter(None, found)))[:MAX_SERIES]


def listed_series(series: dict, today: str) -> list[dict]:
    """A series' numbered books in order; those not published by `today` are upcoming."""
    out = []
    for e in _rows(series.get("book_series")):
        at, book = titles.position(e.get("position")), e.get("book") or {}
        if at is not None and _id(book.get("id")) and str(book.get("title") or "").strip():
            shown = titles.with_title_series(book["title"].strip(), [(series["name"], at, None)])[0]
            out.append({"number": at, "title": shown[:MAX_TITLE], "author": authors_of(book.get("contributions"))[:MAX_TITLE], "upcoming": str(book.get("release_date") or "") > today, "url": BOOKS.format(book["id"])})
    return out


# -- tables --------------------------------------------------------------------------------------------------------

_MATCH = "lookup long, source string, stage int, ord int, key string, title string, author string, year int, series array<string>, cover string, cover_id long, url string, by_isbn boolean, problem string"


def _read(source: str, stage: int, body: str, typed: tuple[str, str]) -> list[dict]:
    title, author = typed
    if source == "openlibrary":
        return [open_match(d, title, stage == 0) for d in open_answer(body)]
    data = graph_answer(body)
    lang = language(data.get("language"))
    found = [graph_match(e["book"], None if is_audio(e) else e, True, lang) for e in _rows(data.get("editions")) if _id((e.get("book") or {}).get("id")) and str(e["book"].get("title") or "").strip()]
    return found + [graph_match(b, fitting_edition(b, title, author), lang=lang) for b in _rows(data.get("books")) if _id(b.get("id")) and str(b.get("title") or "").strip()]


def matches(answers: DataFrame) -> DataFrame:
    """Answers (lookup, source, stage, title, author, body) as matches, or rows with a problem.

    Stage 0 is a search by ISBN, 1 by title and author, 2 by title alone.
    """
    names = [p.split()[0] for p in _MATCH.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                head = {"lookup": r.lookup, "source": r.source, "stage": r.stage}
                try:
                    for i, m in enumerate(_read(r.source, r.stage, r.body, (r.title or "", r.author or ""))):
                        shown = [f"{n} #{a:g}" if a is not None else n for n, a, _ in m["series"]]
                        out.append(head | {"ord": i} | m | {"series": shown})
                except (Problem, TypeError, KeyError, AttributeError) as e:
                    out.append(head | {"problem": str(e) if isinstance(e, Problem) else "an answer that can't be read"})
            yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in ("ord", "year", "cover_id")}).astype(object).where(lambda x: x.notna(), None)

    return answers.select("lookup", "source", "stage", "title", "author", "body").mapInPandas(run, _MATCH)


def lookup_results(answers: DataFrame, typed: DataFrame, top: int = 5) -> DataFrame:
    """The best matches of each lookup (lookup, want_title, want_author), over all catalogues that answered.

    A search by title alone counts only where the one before found nothing.
    """
    m = matches(answers).where("problem is null")
    first = m.groupBy(F.col("lookup").alias("_l"), F.col("source").alias("_s")).agg(F.min(F.when(F.col("stage") > 0, F.col("stage"))).alias("_first"))
    m = m.join(first, (F.col("lookup") == F.col("_l")) & (F.col("source") == F.col("_s"))).where("stage = 0 or stage = _first").drop("_l", "_s", "_first")
    m = m.join(typed, "lookup")
    score = F.when(F.col("by_isbn"), 2.0).otherwise(keys.likeness(F.col("title"), F.col("want_title")))
    order = F.col("stage") * 1000 + F.col("ord") + F.when(F.col("source") == "openlibrary", 100_000).otherwise(0)
    ranked = m.withColumns({"score": score, "by_author": keys.same_author(F.col("author"), F.col("want_author")), "ord": order})
    return resolve.rank_matches(ranked, "lookup", top)


def fetch(url: str, send: Callable[[str], tuple[int, bytes]]) -> bytes:
    """A cover by whatever sends requests; only public addresses are asked."""
    if not public_url(url):
        raise Problem("not a public address")
    status, data = send(url)
    if status == 404:
        raise Problem("the catalogue no longer has this cover")
    if status != 200:
        raise Problem(f"the cover was not sent (error {status})")
    return data
