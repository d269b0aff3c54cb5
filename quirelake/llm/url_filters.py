"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

Rules decide what they cover: a rule (host, path) fits its host and all subdomains if the url's path starts with
the rule's; the longest fitting rule wins. Everything else gets the verdict of a logistic regression on hashed
character n-grams of host and path. It is trained in numpy, on the driver, from a small labelled URL table (a
parameter, SEEDS by default: real and made-up sites of the kinds to keep and to block); the model is 2**buckets_log2 floats and rides along with the task closure. No row
is shuffled: hot hosts cost nothing.

Null urls, and urls without `://`, have an empty host and an empty path and no rule, score 0 and are allowed:
there is nothing to judge. Of rules of equal length, which can't both fit one url but by repetition, the last in their
order wins. Urls are read whole, whatever their length. An empty table gives an empty result; repeated rows get equal verdicts; extra columns
are carried along and columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._kernel import U, mix
from ._shared import appended, ascii_lower, table, without

#: (host, path, verdict) of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: A small labelled URL table: one url a word, without its scheme, of public sites and of made-up ones of their kinds.
CLEAN = """
wikipedia.org/wiki/Main_Page en.wikipedia.org/wiki/History_of_Rome github.com/python/cpython docs.python.org/3/library/os.html stackoverflow.com/questions/11227809
bbc.co.uk/news/world-europe nytimes.com/2023/05/01/science/space.html theguardian.com/books/reviews lemonde.fr/economie/article/2022 spiegel.de/wissenschaft/mensch
elpais.com/cultura/2021-03-02 nature.com/articles/s41586 arxiv.org/abs/1706.03762 mit.edu/courses/physics stanford.edu/class/notes ox.ac.uk/admissions/graduate
harvard.edu/library/catalog nasa.gov/missions/mars who.int/health-topics/malaria cdc.gov/vaccines/schedules nih.gov/research/grants europa.eu/policies/energy
gov.uk/guidance/driving-licence loc.gov/collections/maps britishmuseum.org/collection/search louvre.fr/en/explore metmuseum.org/art/collection gutenberg.org/ebooks/1342
archive.org/details/texts openlibrary.org/authors/books goodreads.com/book/show imdb.com/title/cast allrecipes.com/recipe/lemon-cake seriouseats.com/how-to-roast
nationalgeographic.com/animals/birds weather.com/forecast/today openstreetmap.org/way/map tripadvisor.com/restaurants lonelyplanet.com/italy/rome rei.com/learn/expert-advice
etsy.com/shop/handmade ikea.com/gb/en/cat/chairs ebay.com/itm/camera linkedin.com/in/profile medium.com/engineering/design dev.to/posts/testing mozilla.org/en-US/firefox
debian.org/doc/manuals kernel.org/doc/html postgresql.org/docs/current apache.org/licenses spark.apache.org/docs/latest numpy.org/doc/stable pytorch.org/tutorials
rust-lang.org/learn golang.org/doc/effective w3.org/TR/html ietf.org/rfc/rfc2616 unicode.org/charts coursera.org/learn/statistics khanacademy.org/math/algebra
ted.com/talks/education npr.org/sections/music classicfm.com/composers/bach poetryfoundation.org/poems rspb.org.uk/birds-and-wildlife kew.org/plants/garden
berlin.de/museum/programm zeit.de/kultur/literatur dradio.de/sendung/forschung radiofrance.fr/emissions univ-paris.fr/bibliotheque cnrs.fr/recherche uam.es/facultad/ciencias
rtve.es/noticias/tiempo museodelprado.es/coleccion biblioteca-nacional.es/catalogo dmi.dk/vejr dr.dk/nyheder/indland yr.no/sted/norge villagebakery.net/menu
riverside-school.org/term-dates town-library.org/opening-hours hilltop-farm.co.uk/visit greenhouse-blog.net/tomatoes oldmaps.info/county/survey smallchoir.org/concerts
family-letters.net/archive/1911 chess-club.org/results steamrailway.org/timetable stamp-collector.net/forum/topic astronomy-notes.org/planets knitting-circle.com/patterns
"""
BLOCKED = """
bet365.com/sports pokerstars.com/casino 888casino.com/slots williamhill.com/betting betway.com/bonus unibet.com/live-betting partypoker.com/freeroll
casino-royal-bonus.org/free-spins luckyslots777.com/jackpot megawin-casino.org/register best-online-casinos.info/no-deposit sportsbetting-tips.biz/odds lotto-winner-claim.com/prize
free-bet-offers.net/signup roulette-strategy-win.com/system pornhub.com/view_video xvideos.com/tags xnxx.com/search redtube.com/hot youporn.com/watch
adult-friend-dating.com/hot-girls sexcams-live.com/webcam free-xxx-movies.org/milf nude-teens-pics.biz/gallery escort-service-vip.com/girls hotsex-chat.com/join
sexy-singles-nearby.com/meet adultvideo-club.com/hd erotic-stories-xxx.org/read hentai-tube.org/uncensored cheap-viagra-pills.com/order buy-cialis-online.net/no-prescription
pills-discount-pharmacy.biz/cheap generic-viagra-store.com/buy weight-loss-pills-now.com/trial cheap-meds-overnight.com/xanax steroids-for-sale.biz/cart
male-enhancement-pills.com/free-trial thepiratebay.org/search/movie torrentz2.eu/download 1337x.to/torrent rarbg.to/torrents warez-bb.org/forum crackedsoftware.org/keygen
serial-keys-free.com/crack full-movie-download-torrent.net/hd free-games-cracked.org/setup.exe nulled-scripts.biz/download mp3-free-downloads.ru/track
replica-watches-sale.com/rolex fake-designer-bags.com/cheap luxury-replica-outlet.biz/gucci payday-loans-fast.com/apply instant-cash-loan.com/bad-credit
make-money-fast-online.biz/join bitcoin-doubler-win.com/invest forex-profit-robot.org/signals crypto-giveaway-bonus.org/claim get-rich-quick-system.com/vsl
free-iphone-winner.net/claim you-won-prize-click.com/survey clickbank-promo-ads.biz/track doubleclick.com/adclick ads-popunder-network.com/click popads-traffic.com/serve
adserver-tracker.com/banner track-clicks-affiliate.org/redirect spam-mailer-bulk.com/lists bulk-email-blaster.net/spam link-farm-backlinks.com/seo cheap-backlinks-spam.com/buy
phishing-login-verify.ru/account secure-paypal-verify-login.com/update bank-account-suspended-alert.com/confirm malware-driver-update.com/setup.exe free-antivirus-scan-now.biz/alert
flashplayer-update-download.org/install ransomware-decrypt-tool.biz/pay botnet-stresser.net/attack hot-deals-cheap-pills.ru/viagra win-free-cash-casino.ru/bonus
"""
SEEDS = [(u, blocked) for block, blocked in ((CLEAN, False), (BLOCKED, True)) for u in block.split()]

NEW = ["host", "path", "rule", "rule_verdict", "score", "verdict"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first :// up to /, ? or # (lower-cased A-Z), then up to ? or #; both empty without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _fitting(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict as one CASE, longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def grams(parts: list[tuple[str, str]], log2: int, sizes: tuple[int, ...] = (3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of `^host$` and `^path$`, and the row each belongs to."""
    texts = [f"^{s}$" for p in parts for s in p]
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    data = np.concatenate([*raw, np.zeros(max(sizes), U)])
    which = np.repeat(np.arange(len(raw)), np.diff(offs))
    ends = np.repeat(offs[1:], np.diff(offs))
    at, buckets, rows = np.arange(offs[-1]), [], []
    with np.errstate(over="ignore"):
        for n in sizes:
            h = (which % 2).astype(U) + U(n * 7919)  # host and path grams differ
            for i in range(n):
                h = (h * U(0x100000001B3)) ^ data[at + i]
            ok = at + n <= ends
            buckets.append((mix(h) >> U(64 - log2)).astype(np.int64)[ok])
            rows.append((which // 2)[ok])
    return np.concatenate(buckets), np.concatenate(rows)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    rarity: np.ndarray  # of each bucket in the labelled table; what it has none of is rarest, and says nothing
    bias: float
    log2: int

    def scores(self, parts: list[tuple[str, str]]) -> np.ndarray:
        """Probability that each (host, path) is to be blocked."""
        b, r = grams(parts, self.log2)
        rare = self.rarity[b]
        total = np.bincount(r, self.weights[b] * rare, len(parts))
        norm = np.sqrt(np.bincount(r, rare**2, len(parts)))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(norm, 1e-9) + self.bias, -60, 60)))


def split_url(url: str) -> tuple[str, str]:
    host, slash, path = url.split("?")[0].split("#")[0].partition("/")
    return host.lower(), slash + path


def fit(labelled: list[tuple[str, bool]] = SEEDS, log2: int = 16, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> UrlModel:
    """Stochastic gradient descent over the labelled table; deterministic for a seed."""
    w, bias, rng = np.zeros(1 << log2), 0.0, np.random.default_rng(seed)
    feats = [np.unique(grams([split_url(u)], log2)[0], return_counts=True) for u, _ in labelled]
    y = np.array([b for _, b in labelled], float)
    seen = np.bincount(np.concatenate([b for b, _ in feats]), minlength=1 << log2)
    rarity = np.log((len(labelled) + 1) / (seen + 0.5))
    for epoch in range(epochs):
        for i in rng.permutation(len(labelled)):
            b, c = feats[i]
            x = c * rarity[b]
            x = x / np.sqrt(c @ rarity[b] ** 2)
            p = 1 / (1 + np.exp(-np.clip(w[b] @ x + bias, -60, 60)))
            step = rate / (1 + 0.1 * epoch)
            w[b] -= step * ((p - y[i]) * x + decay * w[b])
            bias -= step * 0.1 * (p - y[i])
    return UrlModel(w, rarity, float(bias), log2)


def apply_filters(df: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """df with host, path, rule, rule_verdict, score (probability of block) and verdict."""
    rules, model = RULES if rules is None else rules, model or fit()
    source = F.col(f"`{url}`")
    df = df.select(*[F.col(f"`{c}`") for c in without(df, NEW).columns], *[e.alias(n) for e, n in zip(host_and_path(source), ("host", "path"), strict=True)])
    rule, verdict = _fitting(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "rule_verdict": verdict})
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("verdict", T.StringType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()  # noqa: B023, E731
            parts = list(zip(get("host"), get("path"), strict=True))
            p = np.where([bool(h or q) for h, q in parts], model.scores(parts), 0.0) if parts else np.zeros(0)
            said = [r if r is not None else "block" if x >= threshold else "allow" for r, x in zip(get("rule_verdict"), p, strict=True)]
            yield appended(batch, {"score": pa.array(p, pa.float64()), "verdict": pa.array(said, pa.string())})

    return df.mapInArrow(score, schema)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return apply_filters(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
