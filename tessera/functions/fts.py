"""English full-text search: Porter2 stems with positions, and the web search grammar.

Texts are analysed once, into an array of (stem, pos) that is stored; a query becomes a predicate on that array built from
built-in functions. Stop words have no stem but keep their place, so phrases stay exact.
"""

from __future__ import annotations

import re
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOP = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing
    don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just
    me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that
    the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while
    who whom why will with you your yours yourself yourselves""".split()
)
_TOKEN = re.compile(r"[^\W_]+")
_VOWEL = "[aeiouy]"
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _region(word: str, start: int = 0) -> int:
    m = re.compile(f"{_VOWEL}[^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word)) or bool(re.fullmatch(r"[aeiouy][^aeiouy]", word))


@cache
def _stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii():
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    prefix = re.match(r"gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _region(w)
    r2 = _region(w, r1)
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search(r"ie[ds]$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not re.search(r"[us]s$", w) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    # Past and progressive forms.
    if m := re.search(r"eed(ly)?$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ed|ing)(ly)?$", w)) and re.search(_VOWEL, w[: m.start()]):
        w = w[: m.start()]
        if re.search(r"(at|bl|iz)$", w):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # Suffixes that become others.
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in set("cdeghkmnrt"):
            w = w[:-2]
    for end, new in [*_STEP3, ("ative", "")]:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + new
            break
    # Suffixes that go.
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if re.search(r"[st]ion$", w) and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def stem(word: str) -> str:
    return _stem(word.lower())


def tokens(text: str) -> list[tuple[str, int]]:
    """(stem, pos) of a text's words that aren't stop words; places count from 1."""
    return [(stem(w), i) for i, w in enumerate(_TOKEN.findall(text.lower()), 1) if w not in STOP]


_TOKENS = T.ArrayType(T.StructType([T.StructField("stem", T.StringType()), T.StructField("pos", T.IntegerType())]))


@F.pandas_udf(_TOKENS)
def analyse(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{"stem": s, "pos": p} for s, p in tokens(t)])


def parse(query: str) -> list[list[tuple[bool, list[tuple[str, int]]]]]:
    """A web search: alternatives of terms, each (negated, stems with places). Quotes make phrases, - negates, "or" separates."""
    branches: list[list[tuple[bool, list[tuple[str, int]]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            if branches[-1]:
                branches.append([])
            continue
        found = tokens(phrase or word)
        if found:
            branches[-1].append((bool(minus), found))
    return [b for b in branches if b]


def may_match(text: Column, query: str) -> Column:
    """A test of the plain text that every text passes which ``matches`` can accept: cheap, and before any analysis.

    A word differs from its stem in the last two letters of the stem at most, so it holds all letters before them.
    """
    lowered = F.lower(text)
    either = [reduce(Column.__and__, [F.contains(lowered, F.lit(s[: max(1, len(s) - 2)])) for no, stems in branch if not no for s, _ in stems] or [F.lit(True)]) for branch in parse(query)]
    return F.coalesce(reduce(Column.__or__, either), F.lit(False)) if either else F.lit(False)


def _term(document: Column, stems: list[tuple[str, int]]) -> Column:
    (first, start), *rest = stems
    if not rest:
        return F.exists(document, lambda t: t["stem"] == first)
    follows = lambda t: reduce(
        Column.__and__, [F.array_contains(document, F.struct(F.lit(s).alias("stem"), (t["pos"] + (p - start)).cast("int").alias("pos"))) for s, p in rest]
    )
    return F.exists(document, lambda t: (t["stem"] == first) & follows(t))


def matches(document: Column, query: str) -> Column:
    """Whether an analysed text matches a web search; one of stop words alone matches nothing."""
    either = [reduce(Column.__and__, [~_term(document, s) if no else _term(document, s) for no, s in branch]) for branch in parse(query)]
    return F.coalesce(reduce(Column.__or__, either), F.lit(False)) if either else F.lit(False)
