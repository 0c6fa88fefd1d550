"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it.

Features of a text are counts of its hashed byte n-grams (one to four bytes of the lower-case text). Every decision
is linear in them, and a text of any length is counted whole into one vector of fixed size.

Models are fitted on the driver from at most ``per_language`` labelled rows of each language, taken by a hash over the
whole table. Workers get a fixed number of weights per decision, whatever the size of the corpus.

Rejected are texts without a letter and texts most of whose byte pairs never occurred in training (other scripts).
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of a language that the fit may use: the bound of the sample.
PER_LANGUAGE = 300
BITS = 14
ORDERS = (1, 2, 3, 4)
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance"}
#: Share of a text's byte pairs that must be known from training.
FAMILIAR = 0.5
EPOCHS = 20
#: Weight of a training error against the margin.
COST = 10.0
#: Bytes counted at once, which bounds what a worker holds beside the text.
BYTES_AT_ONCE = 2_000_000
LETTER = re.compile(r"[^\W\d_]")
RESULT = "lang string, family string, margin float, accepted boolean"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def _slots(data: np.ndarray, order: int) -> np.ndarray:
    """Slot of each n-gram of ``order`` bytes, one per start."""
    n = len(data) - order + 1
    mixed = np.full(n, 0x165667B1 * order & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        mixed ^= data[k : k + n]
        mixed *= _MULTIPLIERS[k]
        mixed ^= mixed >> np.uint32(13)
    return (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a text's slots, and of its byte pairs: case and kinds of white space don't matter."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    slots, pairs = np.zeros(1 << BITS, np.float32), np.zeros(1 << 16, np.int64)
    for at in range(0, len(data), BYTES_AT_ONCE):
        for order in ORDERS:
            part = data[at : at + BYTES_AT_ONCE + order - 1]
            if len(part) >= order:
                slots += np.bincount(_slots(part, order), minlength=1 << BITS)
        part = data[at : at + BYTES_AT_ONCE + 1]
        if len(part) > 1:
            pairs += np.bincount((part[:-1] << np.uint32(8)) | part[1:], minlength=1 << 16)
    return slots, pairs


def _svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear SVM (hinge loss) by coordinate descent on its dual, in a fixed order."""
    alike = (x @ x.T).astype(np.float64)
    share, output = np.zeros(len(x)), np.zeros(len(x))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            new = min(COST, max(0.0, share[i] - (y[i] * output[i] - 1.0) / max(alike[i, i], 1e-9)))
            if new != share[i]:
                output += (new - share[i]) * y[i] * alike[i]
                share[i] = new
    return (x.T @ (share * y).astype(np.float32)).astype(np.float32)


@dataclass
class Decider:
    """One-versus-one linear decisions among ``classes``: votes count first, then summed scores, then order."""

    classes: list[str]
    first: int
    pairs: list[tuple[int, int]]

    def decide(self, scores: np.ndarray) -> tuple[str, float]:
        """The winner, and its least margin over another class."""
        votes, sums = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        least = np.full(len(self.classes), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            s = float(scores[self.first + k])
            votes[a if s >= 0 else b] += 1
            sums[a] += s
            sums[b] -= s
            least[a], least[b] = min(least[a], s), min(least[b], -s)
        winner = max(range(len(self.classes)), key=lambda c: (votes[c], sums[c], -c))
        return self.classes[winner], float(least[winner]) if self.pairs else 0.0


@dataclass
class Model:
    """All weights, a column for each decision: families among each other, then languages within each family."""

    weights: np.ndarray
    seen: np.ndarray
    families: Decider
    languages: dict[str, Decider]
    familiar: float = FAMILIAR

    def predict(self, text: str | None) -> tuple[str | None, str | None, float | None, bool]:
        """(language, family, margin, accepted)."""
        if text is None or not LETTER.search(text):
            return None, None, None, False
        slots, pairs = counts(text)
        scores = slots @ self.weights / float(np.linalg.norm(slots))
        family, far = self.families.decide(scores)
        language, near = self.languages[family].decide(scores)
        single = not self.languages[family].pairs
        margin = far if single else near if not self.families.pairs else min(far, near)
        return language, family, margin, bool(pairs[self.seen].sum() >= self.familiar * pairs.sum())


def train(rows: list[tuple[str, str]], families: Mapping[str, str] = FAMILIES, familiar: float = FAMILIAR) -> Model:
    """A model from (text, language) rows; a language without a family in ``families`` is one of its own."""
    rows = [(t, lang) for t, lang in rows if LETTER.search(t)]
    if not rows:
        raise ValueError("no labelled text with a letter to train on")
    languages = sorted({lang for _, lang in rows})
    of = {lang: families.get(lang, lang) for lang in languages}
    x, seen = np.empty((len(rows), 1 << BITS), np.float32), np.zeros(1 << 16, bool)
    for k, (text, _) in enumerate(rows):
        slots, pairs = counts(text)
        x[k] = slots / np.linalg.norm(slots)
        seen |= pairs > 0
    columns: list[np.ndarray] = []

    def decider(classes: list[str], label: list[str]) -> Decider:
        first, pairs = len(columns), list(combinations(range(len(classes)), 2))
        for a, b in pairs:
            own = [k for k, c in enumerate(label) if c in (classes[a], classes[b])]
            columns.append(_svm(x[own], np.where(np.array([label[k] for k in own]) == classes[a], 1.0, -1.0)))
        return Decider(classes, first, pairs)

    named = [lang for _, lang in rows]
    top = decider(sorted(set(of.values())), [of[lang] for lang in named])
    within = {f: decider([lang for lang in languages if of[lang] == f], named) for f in top.classes}
    weights = np.stack(columns, axis=1) if columns else np.zeros((1 << BITS, 1), np.float32)
    return Model(weights, seen, top, within, familiar)


def sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each language: those of the least hashes in the whole table.

    Every text has its chance: the hash range is set from the count of each language's distinct texts, and the texts in
    it are cut to the bound after they are collected.
    """
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["texts"] for r in labelled.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("texts")).collect()}
    if not sizes:
        return []
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    chance = F.lit(0)
    for lang, size in sizes.items():
        chance = F.when(F.col("lang") == lang, int(min(1.0, (1.3 * per_language + 20) / size) * (1 << 30))).otherwise(chance)
    drawn = sorted((r["lang"], r["draw"], r["text"]) for r in labelled.withColumn("draw", draw).where(F.col("draw") < chance).dropDuplicates(["lang", "text"]).collect())
    taken: dict[str, int] = {}
    out = []
    for lang, _, text in drawn:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= per_language:
            out.append((text, lang))
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, families: Mapping[str, str] = FAMILIES) -> Model | None:
    """A model of the languages in ``docs``; None where no row has both a language and a text with a letter."""
    rows = [r for r in sample(docs, text_col, lang_col, per_language) if LETTER.search(r[0])]
    return train(rows, families) if rows else None


def _predictor(model: Model | None):  # noqa: ANN202
    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [(None, None, None, False) if model is None else model.predict(t) for t in texts]
        return pd.DataFrame(found, columns=["lang", "family", "margin", "accepted"]).astype({"margin": "float32", "accepted": bool})

    return predict


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang, family, margin, accepted) with the language of each text of ``docs``.

    Defined cases: a null text, an empty one and one without a letter have no language and aren't accepted, nor is
    any text if there is no model; a text in a script never seen in training gets the nearest language but isn't
    accepted; ties go to the language first in the alphabet; repeated rows and null ids stay as they are; texts of
    any length count whole; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _predictor(model)(F.col(text_col).cast("string")).alias("found"))
    return rows.select("doc_id", "found.lang", "found.family", "found.margin", "found.accepted")


def keep_accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is rejected; all columns stay. Cases as in ``identify``.

    Without a model (nothing is labelled) only rows whose text has no letter go.
    """
    if model is None:
        return docs.where(F.col(text_col).cast("string").rlike(r"\p{L}"))
    return docs.where(_predictor(model)(F.col(text_col).cast("string"))["accepted"])
