"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

The trees are fitted to labelled URLs: a table of the caller's, or by default the small one below.
Features: length, depth, digit ratio, entropy, parameters and hyphens, and the block rates of the host's
suffixes and of the words before them among the labelled URLs. A labelled URL's own rates come from the folds that its host is not
in, so that the trees learn how far rates tell of hosts that were never seen.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by the
trees; rows that repeat are judged each; an empty table gives no rows; without labelled URLs of both
verdicts, the more frequent verdict (allow, if none) is given.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): host, then path, of the contract.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: At most so many of the caller's labelled URLs are fitted, the first by hash.
SAMPLE = 20_000

# The labelled table, by hand: a line is a host and paths on it, first hosts of ordinary sites (news,
# shops, schools, offices, projects, people), then hosts of unwanted ones (gambling, pills, adult, fake
# goods, malware, link farms, redirectors).
ORDINARY = """
www.riverdale-gazette.com /2019/03/14/council-votes-on-bridge /sport/
stadtbibliothek-kassel.de /oeffnungszeiten /suche?q=atlas
bakehouse.co.uk /recipes/sourdough-loaf.html /about-us
physics.uni-tartu.ee /courses/1204/notes.pdf
maps.harbour.gov /tiles?layer=roads&zoom=4
docs.pipelinekit.io /en/stable/install.html /api/v2/reference#errors
lib.readthedocs.io /en/latest/index.html
forum.sailing.net /viewtopic.php?t=4821&start=20
www.lycee-pasteur.fr /actualites/2021/rentree
museo-del-prado.es /coleccion/obras/las-meninas
gardening.stackboard.com /questions/5512/how-to-prune-roses
www.townhall-bergen.no /skjema/byggesak
weather.met.ie /forecast/cork
blog.annasworld.net /2014/06/walking-in-the-alps /feed
kinderarzt-mueller.de / /kontakt
old.cinema-review.org /films/1954/seven-samurai
journal.oceanography.edu /vol12/issue3/p441
www.fahrrad-berlin.de /touren/spreeradweg?seite=2
shop.tealeaf.jp /item/203948 /cart
encyclopedia.lexi.org /wiki/Photosynthesis /wiki/History_of_paper
press.parliament.uk /releases/2020/11/statement-on-fisheries
dictionary.wordnook.com /define/serendipity
choir.stmartin.org.uk /events/carols
m.dailypost.in /city/pune/water-supply-restored-1284771
static.newsroom.com /img/2018/09/flood_1200.jpg
www.gob.mx /tramites/ficha/pasaporte
recetas.abuela.es /postres/flan-casero
hiking.trails.ca /ontario/bruce-peninsula?map=1
code.forge.dev /team/parser/issues/91 /team/parser/commit/4fe1a09b7c
radio.klassik.at /programm/2022-05-01
podcast.historyhour.com /episodes/87-the-printing-press
www.zoo-wroclaw.pl /bilety
school.district12.us /calendar/2023/april
archive.netpreserve.org /web/20110214/page
tourisme-bretagne.fr /itineraires/sentier-des-douaniers
chess.club-lyon.fr /tournois/resultats-2017.php
astronomy.nightsky.info /constellations/orion
www.hospital-santjoan.cat /ca/serveis/urgencies
news.local12.tv /story/road-works-begin
translate.langtools.app /text?from=de&to=en
jobs.cityworks.org /posting/3391
univ-lab.ac.jp /~tanaka/papers/2003.html
cooking.homestead.tv /soups/leek-and-potato
bahn-auskunft.de /fahrplan?von=ulm&nach=bonn
www.knitting-patterns.com /free/baby-hat
vereine.musik.ch /orchester/luzern
legal.codex.gov.au /acts/1987/12
bank.savingsunion.com /branches/leeds
"""
UNWANTED = """
best-casino-bonus777.com /free-spins/?ref=aff88291
hotsingles-near-you.xyz /join?src=pop&cid=918273645
cheap-viagra-online.biz /buy-now/no-prescription
win-iphone-today.click /claim/9f8a7b6c?utm=x&sub1=ab&sub2=cd
x9k2j7q4.top /l/aGVsbG8gd29ybGQ9PQ/r?u=77123
replica-rolex-outlet.shop /sale-90-off/luxury-watches
crackedsoft-keygen.ru /download/full-version-crack-serial.exe
pokerstars-mirror24.info /go/deposit?bonus=500
adult-webcams-live.net /tours/gallery7/index.php?id=88231&aff=12
fast-cash-loans-usa.co /apply?lead=88213&click=ff91
bet365-mirror88.cc /play/slots/mega-win
free-movies-hd-stream.to /watch/9981273/full-hd-no-signup
weight-loss-miracle-pills.com /order/keto-burn-fat-fast/
secure-login-paypa1.tk /verify/account/update.php?session=8f7e6d5c4b3a
seo-backlinks-5000.pw /buy/dofollow-links
sexy-girls-chat18.com /profiles/lola22?promo=99
crypto-doubler-btc.ml /invest?wallet=1A2b3C4d5E6f
123movies-unblocked.gq /embed.php?k=zz81hh2
torrent-pirate-proxy.cf /get/1080p/x264/7712.torrent
megaslots-jackpot.bet /bonus/200-free-spins-no-deposit
online-pharmacy-24h.su /cart/add?sku=tramadol&qty=180
viral-prank-videos.buzz /you-wont-believe/?fbclid=IwAR0x8s7d6f
get-rich-quick-system.biz /squeeze/vip.html?hop=affid1
a1b2c3d4e5.ga /e/f/g/h/?d=0101010101
xxx-tube-free.sex /video/8837162/hot-amateur
ads.trk-clicks99.com /redirect?c=1823&z=99&u=http%3A%2F%2Fx.co
push-notify-allow.icu /lp7/?clickid=w8e7r6t5&zone=441
discount-handbags-gucci4u.store /outlet/cheap-gucci-bags-online
casino.lucky-spins7.net /en/roulette?btag=12983
m.escort-service24.com /city/list?page=3&aff=77
payday-loans-no-credit.loan /instant/approval?src=em9
lottery-winner-claim.win /notice/ref-88231-uk
kamagra-shop-eu.com /kamagra-100mg-kaufen
steroids-buy-legal.to /shop/anabolic?coupon=XX20
spin-palace-slots.casino /register?tracker=88172&var=1
hackforums-botnet.onion.ws /ddos/stresser/buy
gratis-geld-verdienen.xyz /start.php?partner=4482
gambling-tips-betting1x2.com /fixed-matches/vip-odds-100
cheap-nike-jordans99.top /air-max-90-wholesale
dating-flirt-milf.club /signup?sid=12&tid=881
antivirus-alert-warning.site /scan/infected.html?os=win10&ip=1.2.3.4
bit-trade-robot.online /signals/profit?ref=zx81&lang=en
penny-auction-deals4u.us /bid/ipad-for-1-dollar?x=1&y=2
links-farm-directory.pw /cat77/page991.html
essay-writing-cheap24.com /order-now?disc=30
minecraft-free-coins-hack.ml /generator/human-verify
stream-live-sports-hd4k.tk /match/7733221/player?ad=1
vip-escort-models69.com /gallery/0912/
casino-online.com
www.slots-win.net
bet-win-casino.com
free-casino-slots.org
cheap-pills.net
blog.pills-meds-online.com
adult-sex-cams.net
m.free-adult-video.org
ads-click-track.net
track-ads.com
spam-links.net
www.link-farm-spam.org
bets-odds.net
m.poker-bets.com
free-win.com
cheap-loans.net
cheap-replica.org
sexy-adult.com
casino-poker.co.uk
win-free-prize.net
pills-cheap-meds.org
adult-dating-free.de
track-click-ads.fr
online-bets-casino.it
blog.spam-bulk-mail.ru
"""
#: Paths that say nothing: each host of either table is met with each of them.
PLAIN_PATHS = ("", "/", "/en/", "/index.html", "/about", "/2024/01/news", "/p/8125")


def labelled_urls() -> list[tuple[str, bool]]:
    """(url, blocked) of the labelled table; half of the ordinary sites are met by http, like the others."""
    out = []
    for table, blocked in ((ORDINARY, False), (UNWANTED, True)):
        for i, line in enumerate(table.strip().splitlines()):
            host, *paths = line.split()
            out += [(f"{'https' if i % 2 else 'http'}://{host}{path}", blocked) for path in [*PLAIN_PATHS, *paths]]
    return out


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule); null if none does."""
    found: list[Column] = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<verdict:string,rule:string>")


def suffixes(host: str) -> tuple[str, str]:
    """The last label, and the last two."""
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def tokens(host: str) -> list[str]:
    """The words of a host's labels but the last."""
    return [t for t in re.split(r"[^a-z]+", host.rpartition(".")[0]) if len(t) > 1]


FOLDS = 5


def fold_of(host: str) -> int:
    """All URLs of a registered name (the last two labels) are in one fold."""
    return zlib.crc32(suffixes(host)[1].encode()) % FOLDS


def suffix_rates(rows: Sequence[tuple[str, bool]], prior: float) -> dict[str, float]:
    """Block rates of suffixes, and of words in front of them (as ``word-``), over rows (host, blocked);
    drawn towards ``prior`` by ten URLs for a suffix and by one for a word."""
    seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for host, blocked in rows:
        for s in {*suffixes(host), *(f"{t}-" for t in tokens(host))}:
            seen[s][0] += blocked
            seen[s][1] += 1
    return {s: (b + w * prior) / (n + w) for s, (b, n) in seen.items() for w in (1 if s.endswith("-") else 10,)}


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """Length, depth, ratios, entropy and counts of one URL."""
    u = url or ""
    n = max(len(u), 1)
    counts = Counter(u).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    query = u.partition("#")[0].partition("?")[2]
    return [
        len(u),
        len(host),
        len(path),
        path.count("/"),
        sum(c.isdigit() for c in u) / n,
        sum(c.isdigit() for c in path) / max(len(path), 1),
        entropy,
        len([p for p in query.split("&") if p]),
        host.count("."),
        host.count("-"),
        path.count("-") + path.count("_"),
        sum(c.isdigit() for c in host),
        float("#" in u),
        max(map(len, path.split("/"))),
        float("." in path.rpartition("/")[2]),
        max(map(len, host.split("."))),
        max((len(v) for v in re.split(r"[^0-9A-Za-z]+", query)), default=0),
    ]


@dataclass(frozen=True)
class Boosted:
    """Gradient-boosted regression trees for log-odds; ``rates`` are the suffixes' block rates."""

    base: float
    trees: tuple
    rates: dict
    prior: float

    def row(self, url: str | None, host: str, path: str) -> list[float]:
        of_words = [self.rates.get(f"{t}-", self.prior) for t in tokens(host)] or [self.prior]
        return lexical(url, host, path) + [self.rates.get(s, self.prior) for s in suffixes(host)] + [max(of_words), min(of_words)]

    def odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        for tree in self.trees:
            _add(tree, rows, np.arange(len(rows)), total)
        return total


def _add(tree: tuple, x: np.ndarray, at: np.ndarray, total: np.ndarray) -> None:
    if len(tree) == 1:
        total[at] += tree[0]
        return
    low = x[at, tree[0]] < tree[1]
    _add(tree[2], x, at[low], total)
    _add(tree[3], x, at[~low], total)


def _tree(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: int = 8) -> tuple:
    """One regression tree on gradients and Hessians, by histograms of binned features."""
    leaf = (rate * float(-g.sum() / (h.sum() + 1.0)),)
    if depth == 0 or len(g) < 2 * least:
        return leaf
    score = lambda a, b: a * a / (b + 1.0)
    best = (1e-6, None, None)
    for f, cuts in enumerate(edges):
        if not len(cuts):
            continue
        k = len(cuts) + 1
        gs, hs, ns = (np.bincount(bins[:, f], w, k).cumsum()[:-1] for w in (g, h, np.ones(len(g))))
        gain = score(gs, hs) + score(g.sum() - gs, h.sum() - hs) - score(g.sum(), h.sum())
        gain[(ns < least) | (len(g) - ns < least)] = 0
        if gain.max() > best[0]:
            best = (float(gain.max()), f, int(gain.argmax()))
    if best[1] is None:
        return leaf
    f, k = best[1], best[2]
    low = bins[:, f] <= k
    return (f, float(edges[f][k]), _tree(x[low], bins[low], edges, g[low], h[low], depth - 1, rate, least), _tree(x[~low], bins[~low], edges, g[~low], h[~low], depth - 1, rate, least))


def fit(labelled: Sequence[tuple[str | None, str, str, bool]], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32) -> Boosted:
    """Boosted trees from rows (url, host, path, blocked)."""
    y = np.array([b for *_, b in labelled], dtype=float)
    prior = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Boosted(1.0 if prior >= 0.5 else -1.0, (), {}, prior)
    hosts = [(host, blocked) for _, host, _, blocked in labelled]
    model = Boosted(math.log(prior / (1 - prior)), (), suffix_rates(hosts, prior), prior)
    folds = np.array([fold_of(host) for host, _ in hosts])
    others = [Boosted(0.0, (), suffix_rates([r for r, f in zip(hosts, folds, strict=True) if f != k], prior), prior) for k in range(FOLDS)]
    x = np.array([others[k].row(u, h, p) for (u, h, p, _), k in zip(labelled, folds, strict=True)])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(np.unique(c)) > bins else (lambda v: (v[1:] + v[:-1]) / 2)(np.unique(c)) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)], axis=1)
    odds, trees = np.full(len(y), model.base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        trees.append(_tree(x, binned, edges, p - y, p * (1 - p), depth, rate))
        _add(trees[-1], x, np.arange(len(y)), odds)
    return Boosted(model.base, tuple(trees), model.rates, prior)


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked_odds), one row per page.

    ``labelled``: rows (url, blocked). The fit sees at most ``sample`` of them, the first by hash, so
    the driver's work does not grow with the table."""
    parsed = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.select("*", rule_column(F.col("host"), F.col("path"), rules).alias("by"))
    known = pages.sparkSession.createDataFrame(labelled_urls(), "url string, blocked boolean") if labelled is None else labelled.where("url is not null and blocked is not null")
    drawn = known.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "blocked").orderBy(F.xxhash64("url"), "url", "blocked").limit(sample)
    model = fit([(r["url"], r["host"], r["path"], bool(r["blocked"])) for r in drawn.collect()])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            open_ = [i for i, r in enumerate(c["rule"]) if r is None]
            odds: list[float | None] = [None] * b.num_rows
            if open_:
                x = np.array([model.row(c["url"][i], c["host"][i], c["path"][i]) for i in open_])
                for i, o in zip(open_, model.odds(x).tolist(), strict=True):
                    odds[i] = o
                    c["verdict"][i] = "block" if o > 0 else "allow"
            yield pa.RecordBatch.from_arrays([pa.array(c["page_id"], pa.int64()), *(pa.array(c[k], pa.string()) for k in ("host", "path", "rule", "verdict")), pa.array(odds, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "blocked_odds"])

    return ruled.select("page_id", "url", "host", "path", "by.rule", "by.verdict").mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, blocked_odds double")
