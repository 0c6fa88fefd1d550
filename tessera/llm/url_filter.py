"""URL filter: unigram Viterbi segments names into words, multinomial naive Bayes scores the words.

Unigram counts come from the visible text of all pages, not from URLs, where a name stands as one word as often as it occurs. A name
without separators ("cheappills") falls into the most probable sequence of words; runs of digits are one word each, ``#``.
Each distinct name is joined with the counts of all words that it can contain, so none is too rare or too long to count.

Naive Bayes counts the words of every labelled URL. Labels are an argument. Where there are none, a URL whose words include a seed
term has that term's category and any other is taken as clean; what the counts add is every word that goes with
those. All statistics are sums over the whole table, and URLs are joined with the weights of their words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, with_row_id

CLEAN = "clean"
SEEDS: dict[str, tuple[str, ...]] = {
    "adult": ("adult", "porn", "sex", "xxx", "nude", "escort"),
    "gambling": ("casino", "bet", "bets", "betting", "poker", "slots", "jackpot"),
    "pharmacy": ("pills", "viagra", "cialis", "pharmacy"),
    "spam": ("spam", "malware", "phishing", "warez", "keygen"),
    "ads": ("ads", "adserver", "tracker", "doubleclick", "popunder"),
}
#: Log odds of the best category over clean from which a URL is blocked.
BLOCK_ODDS = 0.0
#: Starts in a name whose pieces are made at once, and pieces that are handed on at once.
STARTS_AT_ONCE = 4_096
PIECES_AT_ONCE = 100_000

_PARTS = re.compile(r"[^\W\d_]+|\d+")
_URL = re.compile(r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::\d*)?([^?#]*)", re.IGNORECASE)


def split_url(url: str) -> tuple[str, str]:
    """(host, path) in lower case; a URL without ``//`` is host and path as it stands."""
    match = _URL.match(url)
    host, path = match.groups() if match else re.match(r"\s*([^/?#]*)([^?#]*)", url).groups()
    return host.strip().lower(), path.strip().lower()


def names(url: str) -> list[str]:
    """Names of host and path in order, each run of digits as ``#``."""
    return ["#" if part[0].isdigit() else part for part in _PARTS.findall(" ".join(split_url(url)))]


class Segmenter:
    """Unigram model of words; an unknown word's chance falls tenfold with each character."""

    def __init__(self, counts: Mapping[str, int], total: int) -> None:
        self.log = {w: math.log(c / total) for w, c in counts.items()}
        self.sizes = sorted({len(w) for w in counts})
        self.rare = -math.log(max(2, total))

    def cost(self, word: str) -> float:
        return self.log.get(word, self.rare - len(word) * math.log(10))

    def segment(self, name: str) -> list[str]:
        """The most probable words that make up a name; among equals the one whose last words are longer."""
        best, back = [0.0], [0]
        # An unknown word's cost is linear in its length, so its best start is a running maximum.
        unknown, since = -math.inf, 0
        for end in range(1, len(name) + 1):
            held = best[end - 1] + (end - 1) * math.log(10)
            if held > unknown:
                unknown, since = held, end - 1
            score, start = unknown + self.rare - end * math.log(10), since
            for size in self.sizes:
                if size > end:
                    break
                known = self.log.get(name[end - size : end])
                if known is not None and (best[end - size] + known, size - end) > (score, -start):
                    score, start = best[end - size] + known, end - size
            best.append(score)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]

    def words(self, url: str) -> list[str]:
        """Words of host and path in order."""
        found: list[str] = []
        for name in names(url):
            found.extend([name] if name == "#" else self.segment(name))
        return found


@dataclass
class Bayes:
    """Multinomial naive Bayes with add-one smoothing over words of URLs."""

    categories: list[str]
    prior: dict[str, float]
    weights: dict[str, list[float]]
    unseen: list[float]

    def score(self, words: Iterable[str]) -> tuple[str, float]:
        """(category, log odds over clean of the best other category)."""
        sums = [self.prior[c] for c in self.categories]
        for w in words:
            for k, x in enumerate(self.weights.get(w, self.unseen)):
                sums[k] += x
        others = [k for k in range(len(sums)) if self.categories[k] != CLEAN]
        best = max(others, key=lambda k: (sums[k], -k), default=None)
        if best is None:
            return CLEAN, -math.inf
        odds = sums[best] - sums[self.categories.index(CLEAN)]
        return (self.categories[best] if odds > BLOCK_ODDS else CLEAN), odds


def bayes(rows: Iterable[tuple[str, str, int]], urls: Mapping[str, int]) -> Bayes:
    """A model from (word, category, count) rows and the number of URLs of each category."""
    categories = sorted({*urls, CLEAN})
    counts: dict[str, list[int]] = {}
    totals = [0] * len(categories)
    for word, category, count in rows:
        counts.setdefault(word, [0] * len(categories))[categories.index(category)] += count
        totals[categories.index(category)] += count
    size, n = len(counts) + 1, sum(urls.values())
    return Bayes(
        categories,
        {c: math.log((urls.get(c, 0) + 1) / (n + len(categories))) for c in categories},
        {w: [math.log((c + 1) / (t + size)) for c, t in zip(own, totals)] for w, own in counts.items()},
        [math.log(1 / (t + size)) for t in totals],
    )


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, count) over the visible text of all pages."""
    visible = F.regexp_replace(F.col(html_col).cast("string"), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&[a-z]+;", " ")
    word = F.explode(F.split(F.lower(visible), r"[^\p{L}]+"))
    return pages.select(word.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("count"))


def _pieces(sizes: list[int]):  # noqa: ANN202
    """(key, word) of every piece of a name that has the length of some word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[dict] = []
        words: list[str] = []
        for batch in batches:
            for key, name in zip(batch["key"], batch["name"]):
                for first in range(0, len(name), STARTS_AT_ONCE):
                    last = min(len(name), first + STARTS_AT_ONCE)
                    for size in sizes:
                        if first + size > len(name):
                            break
                        found = {name[start : start + size] for start in range(first, min(last, len(name) - size + 1))}
                        keys.extend([key] * len(found))
                        words.extend(found)
                        if len(words) >= PIECES_AT_ONCE:
                            yield pd.DataFrame({"key": keys, "word": words})
                            keys, words = [], []
        if words:
            yield pd.DataFrame({"key": keys, "word": words})

    return run


def segmented(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of a checkpoint of distinct names, by the counts of all words and their sum."""
    total = max(1, counts.agg(F.sum("count")).first()[0] or 0)
    sizes = sorted(r["size"] for r in counts.select(F.length("word").alias("size")).distinct().collect())
    # ``distinct`` is a checkpoint, whose partitions are files, so this number stays with its row.
    keyed = distinct.withColumn("key", F.monotonically_increasing_id())
    known = keyed.where("name <> '#'").mapInPandas(_pieces(sizes), "key long, word string").join(counts, "word")
    known = known.groupBy("key").agg(F.collect_list("word").alias("own"), F.collect_list("count").alias("times"))

    @F.pandas_udf("string")
    def segment(names: pd.Series, own: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series([n if n == "#" else " ".join(Segmenter({} if o is None else dict(zip(o, map(int, t))), total).segment(n)) for n, o, t in zip(names, own, times)], dtype=object)

    return keyed.join(known, "key", "left").select("name", segment("name", "own", "times").alias("words"))


def _split():  # noqa: ANN202
    @F.pandas_udf("host string, names array<string>")
    def split(urls: pd.Series) -> pd.DataFrame:
        out = [(None, None) if u is None or not u.strip() else (split_url(u)[0] or None, names(u)) for u in urls]
        return pd.DataFrame(out, columns=["host", "names"], dtype=object)

    return split


def url_words(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(row, page_id, host, words) with the words of each URL in order; null words where a URL is null or blank."""
    urls = with_row_id(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")), "row")
    urls = urls.select("row", "page_id", _split()("url").alias("found")).select("row", "page_id", "found.host", "found.names")
    placed = urls.select("row", F.posexplode("names").alias("place", "name"))
    counts = checkpoint(word_counts(pages, html_col))
    known = segmented(checkpoint(placed.select("name").distinct()), counts)
    words = placed.join(known, "name").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("found"))
    words = words.select("row", F.array_join("found.words", " ").alias("words"))
    blank = F.col("names").isNull()
    return urls.join(words, "row", "left").select("row", "page_id", "host", F.when(~blank, F.coalesce("words", F.lit(""))).alias("words"))


def _category(words: Column, seeds: Mapping[str, Iterable[str]]) -> Column:
    """The first category, in the order of ``seeds``, one of whose terms is a word of the URL."""
    found = F.lit(CLEAN)
    for category in reversed(list(seeds)):
        found = F.when(F.arrays_overlap(words, F.array(*map(F.lit, seeds[category]))), F.lit(category)).otherwise(found)
    return found


def _weighted(urls: DataFrame, categories: list[str]) -> tuple[DataFrame, list[float]]:
    """(word, weights) of every word of the URLs, whose ``found`` words and ``label`` are given, and the weights of any other: one for each of ``categories``."""
    own = F.array(*(F.count(F.when(F.col("label") == c, 1)) for c in categories))
    counted = checkpoint(urls.select("label", F.explode("found").alias("word")).groupBy("word").agg(own.alias("own")))
    sums = counted.agg(F.count("*").alias("words"), *(F.sum(F.col("own")[k]).alias(f"t{k}") for k in range(len(categories)))).first()
    smoothed = [(sums[f"t{k}"] or 0) + sums["words"] + 1 for k in range(len(categories))]
    weights = F.array(*(F.log((F.col("own")[k] + 1) / F.lit(float(t))) for k, t in enumerate(smoothed)))
    return counted.select("word", weights.alias("weights")), [math.log(1 / t) for t in smoothed]


def filter_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seeds: Mapping[str, Iterable[str]] = SEEDS, labels: DataFrame | None = None
) -> DataFrame:
    """Rows (page_id, host, words, category, odds, blocked): the words of each URL and what naive Bayes makes of them.

    ``labels`` (page_id, category) says what naive Bayes learns from; without it, seed terms do. Both models are fitted on ``pages``.

    Defined cases: a null or blank URL has no host, no words and no odds, the category ``clean`` and isn't blocked;
    one that isn't well formed is read as host and path; repeated rows and null ids stay as they are; long URLs and names are
    segmented whole; of several labels of a page the first in the alphabet counts; among categories of equal odds the first in
    the alphabet does; where no category but ``clean`` is known odds are null; an empty table gives no rows; other
    columns are ignored.
    """
    found = F.coalesce(F.array_remove(F.split("words", " "), ""), F.array().cast("array<string>"))
    urls = checkpoint(url_words(pages, id_col, url_col, html_col)).withColumn("found", found)
    if labels is None:
        urls = urls.withColumn("label", _category(F.col("found"), seeds))
    else:
        one = labels.groupBy(F.col(labels.columns[0]).alias("page_id")).agg(F.min(labels.columns[1]).alias("label"))
        urls = checkpoint(urls.join(one, "page_id", "left"))
    taught = urls.where("label IS NOT NULL")
    sizes = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    categories, n = sorted({*sizes, CLEAN}), sum(sizes.values())
    weights, unseen = _weighted(taught, categories)
    weighted = urls.select("row", F.posexplode("found").alias("place", "word")).join(weights, "word", "left")
    weighted = weighted.withColumn("weights", F.coalesce("weights", F.array(*map(F.lit, unseen))))
    # Weights are added in the order of the words, so that a URL's sums are the same each time.
    placed = weighted.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "weights"))).alias("placed"))
    prior = F.array(*(F.lit(math.log((sizes.get(c, 0) + 1) / (n + len(categories)))) for c in categories))
    sums = F.coalesce(F.aggregate("placed", prior, lambda held, x: F.zip_with(held, x["weights"], lambda a, b: a + b)), prior)
    scored = urls.join(placed, "row", "left").withColumn("sums", sums)
    clean = F.col("sums")[categories.index(CLEAN)]
    others = [(F.col("sums")[k] - clean, c) for k, c in enumerate(categories) if c != CLEAN]
    odds = F.when(F.col("words").isNotNull(), F.greatest(*(x for x, _ in others), F.lit(-math.inf))) if others else F.lit(None).cast("double")
    scored = scored.withColumn("odds", odds)
    category = F.lit(CLEAN)
    for x, c in reversed(others):
        category = F.when((F.col("odds") > BLOCK_ODDS) & (x == F.col("odds")), c).otherwise(category)
    scored = scored.withColumn("category", category)
    return scored.select("page_id", "host", F.coalesce("words", F.lit("")).alias("words"), "category", "odds", (F.col("category") != CLEAN).alias("blocked"))
