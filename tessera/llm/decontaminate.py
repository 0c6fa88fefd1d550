"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items, questions and answers alike, are normalised (words of letters and digits, lower case) and every
window of ``window`` words becomes a pattern of one automaton, shorter items as a whole. The automaton's letters are
the numbers of the benchmark's words, so it has one node for a word rather than for each character. A text is normalised alike
and scanned once, whatever the number of patterns; hits are places of words, mapped back to offsets in the original text.

A short item ("yes") stands in many texts by chance. A hit of fewer than ``ALONE`` words counts where the text has a longer
passage of the same item too, or is nothing but that item.

The automaton is built on the driver and broadcast; its size is checked. A benchmark of more than ``max_pattern_words``
words in patterns is cut into slices of items, each with its own automaton, and what one slice leaves is written to the
shared folder before the next one is loaded, so that a worker never holds more than one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stored

WINDOW = 13
#: Words from which a hit counts by itself.
ALONE = 5
#: Words in all patterns of one automaton: some 50 bytes each.
MAX_PATTERN_WORDS = 10_000_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-case words of ``text``."""
    lowered = text.lower()
    # Letters that grow or follow their neighbours in lower case would change where words end: there words come first.
    return WORD.findall(lowered) if len(lowered) == len(text) and "Σ" not in text else [w.lower() for w in WORD.findall(text)]


def windows(text: str, window: int) -> list[tuple[str, ...]]:
    """Patterns of one item."""
    words = words_of(text)
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


class Patterns:
    """One automaton over (item, text) rows."""

    def __init__(self, rows: Iterable[tuple], window: int = WINDOW) -> None:
        self.numbers: dict[str, int] = {}
        found: dict[tuple[int, ...], list] = {}
        for item, text in rows:
            for pattern in windows(text, window):
                key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in pattern)
                if item not in found.setdefault(key, []):
                    found[key].append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, items in found.items():
            self.automaton.add_word(key, (len(key), items))
        if found:
            self.automaton.make_automaton()

    def hits(self, text: str) -> tuple[int, Iterator[tuple[int, tuple[int, list]]]]:
        """(number of words, hits as (last word, (words, items))) of a text."""
        places = tuple(map(self.numbers.get, words_of(text), repeat(0)))
        return len(places), self.automaton.iter(places) if len(self.automaton) and places else iter(())

    def found_in(self, text: str) -> bool:
        """Whether ``spans`` finds anything."""
        count, hits = self.hits(text)
        return any(size >= ALONE or size == count for _, (size, _) in hits)

    def spans(self, text: str) -> list[tuple]:
        """(item, start, end, words) of maximal runs of overlapping or adjacent hits of one item; offsets into ``text``."""
        count, hits = self.hits(text)
        own: dict = {}
        for end, (size, items) in hits:
            for item in items:
                own.setdefault(item, []).append((end - size + 1, end))
        runs = []
        for item, found in own.items():
            sizes = [last - first + 1 for first, last in found]
            if max(sizes) < ALONE and max(sizes) < count:
                continue
            found.sort()
            merged = [list(found[0])]
            for first, last in found[1:]:
                if first <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], last)
                else:
                    merged.append([first, last])
            runs += [(item, first, last) for first, last in merged]
        if not runs:
            return []
        places = [m.span() for m in WORD.finditer(text)]
        return [(item, places[first][0], places[last][1], last - first + 1) for item, first, last in runs]


def _slices(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_pattern_words: int) -> Iterator[Broadcast]:
    """Broadcast patterns of slices of the benchmark, each of about a bounded size; all rows of an item are in one."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null and item is not null")
    # A window starts at each word, and a word has two characters at least with what separates it.
    words = (items.agg(F.sum(F.length("text"))).first()[0] or 0) * window // 2
    parts = 1 + int(words // max_pattern_words)
    for k in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k) if parts > 1 else items
        yield spark.sparkContext.broadcast(Patterns(((r["item"], r["text"]) for r in chosen.orderBy("item", "text").toLocalIterator()), window))


def contaminated_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_pattern_words: int = MAX_PATTERN_WORDS,
) -> DataFrame:
    """Rows (doc_id, item_id, start, end, n_words): passages of ``docs`` that are in a benchmark item.

    A passage is a maximal run of overlapping or adjacent windows of one item; ``start`` and ``end``
    are character offsets (end exclusive) into the text as it stands. Whole texts are scanned.

    Defined cases: a null or empty text has no passages; a null id stays null in the result; repeated rows
    give their rows each; null items aren't searched for; items of a few words count as the module says; equal
    items are all reported; an empty table or benchmark gives no rows; other columns are ignored.
    """
    kinds = docs.select(F.col(id_col).alias("doc_id")).schema.fields + benchmark.select(F.col(item_col).alias("item_id")).schema.fields
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kinds), *(T.StructField(c, T.IntegerType()) for c in ("start", "end", "n_words"))])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def scan(patterns: Broadcast):  # noqa: ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            columns = [f.name for f in schema.fields]
            for batch in batches:
                ids = batch["id"].astype(object).where(batch["id"].notna(), None)
                yield pd.DataFrame([(i, *s) for i, t in zip(ids, batch["text"]) for s in patterns.value.spans(t)], columns=columns)

        return run

    found = [rows.mapInPandas(scan(patterns), schema) for patterns in _slices(benchmark, item_col, item_text_col, window, max_pattern_words)]
    return reduce(DataFrame.unionByName, found)


def _clean(patterns: Broadcast):  # noqa: ANN202
    @F.pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([t is None or not patterns.value.found_in(t) for t in texts], dtype=bool)

    return clean


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_pattern_words: int = MAX_PATTERN_WORDS
) -> DataFrame:
    """``docs`` without the rows in which ``contaminated_spans`` finds a passage; columns and rows else stay.

    Cases as there: a null or empty text is clean.
    """
    for k, patterns in enumerate(_slices(benchmark, item_col, item_text_col, window, max_pattern_words)):
        docs = (stored(docs) if k else docs).where(_clean(patterns)(F.col(text_col).cast("string")))
    return docs
