"""URL filters: allow and block rules, then a naive Bayes verdict on the words in a host and path.

Hosts concatenate words ("cheappillsonline"). A unigram Viterbi splits every label into the likeliest words: known words cost
their negative log probability, other stretches a base and so much a letter. Known are the words of the labelled addresses, their
probabilities the shares of the hosts that have them, counted over all rows; and those of a lexicon, if the caller gives one. A multinomial naive Bayes
model, fitted to the labelled addresses, then scores the words of host and path. Words outside its vocabulary say nothing.

The addresses below are a small default, written by hand: a verdict is no better than they are. Give a table of labelled addresses instead (labelled()), and a table of
words with their counts, such as a public unigram list of the languages that the hosts are in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import ship

#: (verdict, rule). A rule's host is what stands before its first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled addresses, their words set apart by hyphens: what a corpus shall not have, and ordinary sites. Words may be on both sides.
ADDRESSES = {
    "block": "cheap-pills-online buy-cheap-viagra viagra-cialis-store online-pharmacy-meds discount-meds-no-prescription generic-cialis-pills slim-diet-pills weight-loss-miracle"
    " casino-win online-casino-bonus live-casino-jackpot vegas-slots-free free-spins-casino poker-bonus-free play-poker-win online-slots-jackpot roulette-win-money lotto-zone"
    " lottery-winner-claim lucky-lotto-win free-bets sports-betting-odds bet-bonus-betting play-pokies-online bingo-jackpot-bonus gamble-online-win"
    " adult-xxx-cams live-sex-cams free-porn-tube hot-singles-dating meet-hot-girls adult-dating-hookup xxx-video-porn adult-x-movies"
    " payday-loans-fast instant-cash-loans easy-loan-approval bad-credit-loans debt-relief-fast make-money-fast get-rich-quick earn-cash-online work-from-home-cash crypto-profit-bot"
    " forex-signals-profit free-crypto-coins replica-watches-cheap fake-designer-bags spam-farm link-farm-seo buy-backlinks-seo"
    " cheap-followers-likes ads-track ad-track-click click-tracker-ads popup-ads-banner banner-ads-network affiliate-promo-deals claim-free-prize free-gift-card-winner free-iphone-prize"
    " survey-prize-winner warez-crack-download crack-keygen-serial serial-keygen-free torrent-movies-free free-movies-stream-hd pirate-torrent-warez game-cheats-hack"
    " free-coins-generator malware-download-update fake-antivirus-download verify-account-login-secure secure-bank-verify-account password-reset-claim"
    " miracle-cure-pills hair-loss-cure enlarge-pills-male steroids-buy-online weed-shop-online fake-id-buy essay-writing-cheap",
    "allow": "daily-news world-news local-news-weather city-times morning-herald sports-news-live football-club health-news public-health-service national-library"
    " city-library-catalog university-library state-university college-of-art school-district primary-school science-journal journal-of-medicine"
    " history-museum art-museum science-museum music-school book-review book-store travel-guide city-guide travel-blog my-blog food-blog"
    " family-recipes home-garden garden-club photo-blog photo-gallery video-lessons open-source-software free-software-foundation free-software free-press-journal software-docs developer-docs api-docs"
    " code-review programming-forum linux-forum help-forum support-center help-desk web-mail mail-list winner-list contact-us about-us company-home home-page"
    " online-shop book-shop shoe-store online-store car-dealer real-estate-homes hotel-booking flight-search train-times city-map road-map weather-map credit-union"
    " savings-bank national-bank debt-advice money-advice consumer-advice legal-advice law-review law-firm tax-office city-council local-government public-records parliament-archive"
    " news-archive web-archive data-archive open-data statistics-office research-institute cancer-research medical-center pharmacy-school dental-clinic sex-education health-education"
    " drug-policy-institute charity-trust animal-rescue dog-training chess-club game-reviews board-games video-games-wiki film-reviews music-archive radio-live"
    " theatre-tickets concert-tickets jobs-board career-center events-calendar community-center wedding-photos",
}
#: Laplace's constant.
ALPHA = 1.0
#: Cost of an unknown stretch of letters: a base, and so much a letter.
UNKNOWN_BASE, UNKNOWN_LETTER = 3.0, 1.5
#: Half of a labelled word's probability is the same for all, half its share of the table's words.
EVEN_SHARE = 0.5
#: Letters of a word that the segmenter takes out of a label, at least.
TABLE_LETTERS = 3
#: Rows of a lexicon and of a table of labelled addresses, at most: both are parameters and are held by every worker. More are an error.
LEXICON_ROWS, LABELLED_ROWS = 500_000, 100_000
#: Letters of a label whose split is remembered.
REMEMBERED_LETTERS = 64
_SPLIT = re.compile(r"[^a-z]+")


def address(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and where there is no `://`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    u = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, pattern, 1), upper, lower), F.regexp_extract(u, pattern, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it, and whose path the url's starts with. Ties: the first."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


class Model:
    """Word costs for the Viterbi and log odds for the verdict; `counts` has how many of the table's hosts have each word, or a lexicon's counts."""

    def __init__(self, counts: dict[str, int], addresses: dict[str, str | Sequence[str]] = ADDRESSES):
        listed = {k: v.split() if isinstance(v, str) else list(v) for k, v in addresses.items()}
        words = {k: Counter(w for a in listed[k] for w in a.split("-")) for k in ("block", "allow")}
        vocabulary = sorted(words["block"] | words["allow"])
        self.lexicon = frozenset(vocabulary)
        # a word of the table that labelled words spell out is no word of its own
        table = {w: c for w, c in counts.items() if w in self.lexicon or len(w) >= TABLE_LETTERS and not self._spelled(w)}
        total = sum(table.values())
        even = EVEN_SHARE if total else 1.0
        share = lambda w: (1 - even) * table.get(w, 0) / total if total else 0.0
        self.cost = {w: -math.log(share(w)) for w in table if table[w] and w not in self.lexicon}
        self.cost |= {w: -math.log(even / len(vocabulary) + share(w)) for w in vocabulary if len(w) >= TABLE_LETTERS}
        self.longest = max(map(len, self.cost))
        n = {k: ws.total() + ALPHA * len(vocabulary) for k, ws in words.items()}
        self.odds = {w: math.log((words["block"][w] + ALPHA) / n["block"]) - math.log((words["allow"][w] + ALPHA) / n["allow"]) for w in vocabulary}
        self.prior = math.log(max(len(listed["block"]), 1)) - math.log(max(len(listed["allow"]), 1))
        self._remembered = lru_cache(1 << 16)(self._split)

    def split(self, label: str) -> tuple[str, ...]:
        return (self._remembered if len(label) <= REMEMBERED_LETTERS else self._split)(label)

    def _spelled(self, word: str) -> bool:
        ends = [0]
        for i in range(1, len(word) + 1):
            if any(word[j:i] in self.lexicon and i - j >= TABLE_LETTERS for j in ends):
                ends.append(i)
        return ends[-1] == len(word)

    def _split(self, label: str) -> tuple[str, ...]:
        """The cheapest split into known words and unknown stretches. Ties: the split whose last part is longest."""
        if label in self.lexicon:  # what stands alone is not taken apart
            return (label,)
        known = [0.0] + [math.inf] * len(label)  # the cheapest split of the first i letters that ends in a known word
        inside = [math.inf] * (len(label) + 1)  # ... that ends in an unknown stretch
        from_known, from_inside = [0] * (len(label) + 1), [0] * (len(label) + 1)
        for i in range(1, len(label) + 1):
            inside[i], from_inside[i] = inside[i - 1] + UNKNOWN_LETTER, from_inside[i - 1]
            if (opened := known[i - 1] + UNKNOWN_BASE + UNKNOWN_LETTER) < inside[i]:
                inside[i], from_inside[i] = opened, i - 1
            for j in range(max(0, i - self.longest), i):
                word = self.cost.get(label[j:i])
                if word is not None and (c := min(known[j], inside[j]) + word) < known[i]:
                    known[i], from_known[i] = c, j
        parts, i = [], len(label)
        ends_known = known[i] <= inside[i]
        while i > 0:
            j = from_known[i] if ends_known else from_inside[i]
            parts.append(label[j:i])
            # an unknown stretch follows a known word, or begins the label
            ends_known = known[j] <= inside[j] if ends_known else True
            i = j
        return tuple(reversed(parts))

    def log_odds(self, host: str, path: str) -> tuple[float, list[str]]:
        words = [w for label in _SPLIT.split(f"{host} {path.lower()}") if label for w in self.split(label)]
        return self.prior + sum(self.odds.get(w, 0.0) for w in words), words


def _held(rows: DataFrame, most: int, what: str) -> list:
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return found


def labelled(rows: DataFrame, most: int = LABELLED_ROWS) -> dict[str, list[str]]:
    """Labelled addresses of a table (address, its words set apart by hyphens, and verdict: block or allow) for filter_urls(). Other verdicts and null addresses are
    left out; ValueError for more than `most` rows."""
    kept = _held(rows.where("verdict IN ('block', 'allow') AND address IS NOT NULL").select("verdict", F.lower("address").alias("address")), most, "the labelled table")
    return {k: [r["address"] for r in kept if r["verdict"] == k] for k in ("block", "allow")}


def word_counts(pages: DataFrame, addresses: dict[str, str | Sequence[str]] = ADDRESSES, lexicon: DataFrame | None = None) -> dict[str, int]:
    """How many hosts of the whole table have each labelled word alone in their urls, a host counted once however many rows it has; and the counts of a lexicon
    (word, count) for its other words. Other words of the table are not known: they cost by their letters."""
    host, path = address(F.col("url"))
    listed = sorted({w for v in addresses.values() for a in (v.split() if isinstance(v, str) else v) for w in a.split("-")})
    words = pages.select(host.alias("host"), F.explode(F.array_distinct(F.split(F.concat_ws(" ", host, F.lower(path)), "[^a-z]+"))).alias("w"))
    known = F.broadcast(pages.sparkSession.createDataFrame([(w,) for w in listed], "w string"))
    counted = words.join(known, "w", "left_semi").distinct().groupBy("w").agg(F.count("*").alias("hosts"))
    found = {r["w"]: r["hosts"] for r in counted.collect()}
    if lexicon is not None:
        own = set(listed)
        rows = _held(lexicon.where("word IS NOT NULL AND count > 0").groupBy(F.lower("word").alias("word")).agg(F.sum("count").alias("count")), LEXICON_ROWS, "the lexicon")
        found |= {r["word"]: r["count"] for r in rows if r["word"] not in own}
    return found


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, addresses: dict[str, str | Sequence[str]] = ADDRESSES, lexicon: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds and the segmented words of each row. addresses: block and allow, see labelled(); lexicon: word, count.

    A null url, or one without `://`, has empty host and path: no rule fits and the prior allows it. Of rules of equal length that fit the
    first counts; log odds of 0 allow. Repeated rows are judged one by one, urls of any length as a whole; an empty table gives an empty one; other columns are ignored.
    """
    ship(pages.sparkSession)
    counts = word_counts(pages, addresses, lexicon)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counts, addresses)
        for batch in batches:
            scored = [model.log_odds(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s for s, _ in scored], pa.float64()), pa.array([w for _, w in scored], pa.list_(pa.string()))],
                [*batch.schema.names, "log_odds", "words"],
            )

    host, path = address(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    kind = dict(named.dtypes)["page_id"]
    scored = named.mapInArrow(judge, f"page_id {kind}, host string, path string, log_odds double, words array<string>")
    verdicts = reduce(lambda c, r: F.when(F.col("rule") == r[1], r[0]).otherwise(c), reversed(rules), F.lit(None).cast("string"))
    return scored.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "verdict", F.coalesce(verdicts, F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
