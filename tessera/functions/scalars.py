"""Scalar functions as Column builders: every one is an expression Catalyst can push and compile, but for Unicode folding."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vocab


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The value as a string, null as the empty one."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def squeeze(c: Column | str) -> Column:
    """Runs of white space, no-break blanks too, as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def literal_map(entries: Mapping[str, object]) -> Column:
    pairs = []
    for k, v in entries.items():
        pairs += [F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)]
    return F.create_map(*pairs)


def distinct_filled(c: Column) -> Column:
    """Members in order of first appearance without nulls and empty strings; null becomes an empty array."""
    return F.coalesce(F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def sorted_distinct(c: Column | str) -> Column:
    """Members that aren't null or empty, each once, sorted."""
    return F.array_sort(F.array_distinct(F.filter(_col(c), lambda x: x.isNotNull() & (x != ""))))


def flat_map(c: Column | str, f) -> Column:  # noqa: ANN001
    """``f`` over an array's members, results joined, first appearances kept."""
    return distinct_filled(F.flatten(F.transform(F.coalesce(_col(c), F.array().cast("array<string>")), f)))


# --- keys ---------------------------------------------------------------------------------------------------------


def slug(c: Column | str) -> Column:
    """Lower-case words of letters and digits joined by hyphens; ``&`` is the word "and"."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "&", " and "), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def canonical(c: Column | str) -> Column:
    """As ``slug``, with blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "&", " and "), "[^a-z0-9]+", " "))


def provider_key(c: Column | str) -> Column:
    """Provider for grouping: here ``&`` is "and" without blanks around it, so AT&T is "atandt"."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "&", "and"), "[^a-z0-9]+", " "))


_TITLE_NOISE = (
    r"\b(?:19|20)[0-9]{2}\b",
    r"\b(?:winter|autumn|fall|summer|spring)\b",
    r"\b(?:application|fund|funds|program|programs|grant|grants|award|awards|scholarship|scholarships)\b",
    r"\b(?:number|no\.?)\s*[0-9]+\b",
    r"\b[0-9]+(?:th|rd|nd|st)\b",
    r"\b[0-9]+\b",
)


def title_key(c: Column | str) -> Column:
    """Title for grouping, without years, seasons, generic words and numbering, unless under two words are left."""
    lowered = F.lower(text(c))
    bare = F.regexp_replace(lowered, "&", "and")
    for noise in _TITLE_NOISE:
        bare = F.regexp_replace(bare, noise, " ")
    bare = F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))
    return F.when(F.contains(bare, F.lit(" ")), bare).otherwise(F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " ")))


def group_key(provider: Column | str, title: Column | str) -> Column:
    return F.concat_ws("|", provider_key(provider), title_key(title))


def plain_fingerprint(title: Column | str, provider: Column | str, application: Column | str, source: Column | str) -> Column:
    address = F.coalesce(F.nullif(text(application), F.lit("")), text(source))
    return F.concat_ws("|", F.lower(text(title)), F.lower(text(provider)), address)


def fingerprint(title: Column | str, provider: Column | str, application: Column | str) -> Column:
    """SHA-256 of the canonical title and provider and the application address."""
    return F.sha2(F.concat_ws("|", canonical(title), canonical(provider), text(application)), 256)


# --- closed vocabularies ------------------------------------------------------------------------------------------


def tag(c: Column | str) -> Column:
    """Slug with its alias resolved once; null where nothing is left."""
    key = slug(c)
    return F.coalesce(F.try_element_at(literal_map(vocab.TAG_ALIASES), key), F.nullif(key, F.lit("")))


def states(c: Column | str) -> Column:
    """Codes of the states a value names: a code by itself, else every full name in it, longest name first."""
    raw = F.trim(text(c))
    lowered = F.regexp_replace(F.lower(raw), "[._-]+", " ")
    district = lowered.rlike(r"\bdistrict of columbia\b|\bwashington\s+d\.?\s*c\.?\b")
    names, codes = (F.array(*map(F.lit, x)) for x in zip(*vocab.STATES_LONGEST_FIRST, strict=True))
    # No name begins with another and a blank, so one look-ahead finds all, also those within others.
    found = F.regexp_extract_all(lowered, F.lit(rf"\b(?=({'|'.join(n for n, _ in vocab.STATES_LONGEST_FIRST)})\b)"), 1)
    places = F.sort_array(F.array_distinct(F.transform(found, lambda n: F.array_position(names, n).cast("int"))))
    named = F.transform(places, lambda k: F.element_at(codes, k))
    return F.when(district, F.array().cast("array<string>")).when(F.upper(raw).isin(*vocab.STATES.values()), F.array(F.upper(raw))).otherwise(named)


def _school(n: Column) -> Column:
    return F.get(F.array(*map(F.lit, vocab.SCHOOL)), n - 1)


def grades(c: Column | str) -> Column:
    """Canonical grades a value stands for: an alias, a range, one number, or a list of numbers; else none."""
    key = slug(c)
    number = lambda pattern, group: F.regexp_extract(key, pattern, group).try_cast("int")
    low, high = (number(r"^(?:grades?-?)?([0-9]{1,2})-([0-9]{1,2})$", k) for k in (1, 2))
    single = number(r"^(?:grade-)?([0-9]{1,2})(?:st|nd|rd|th)?(?:-grade)?$", 1)
    listed = F.transform(F.split(F.regexp_extract(key, r"^grades?-([0-9]{1,2}(?:-[0-9]{1,2})+)$", 1), "-"), lambda x: x.try_cast("int"))
    is_range = (low >= 1) & (high <= 12) & (low <= high)
    return (
        F.when(F.map_contains_key(literal_map(vocab.GRADE_ALIASES), key), F.try_element_at(literal_map(vocab.GRADE_ALIASES), key))
        .when(is_range, F.transform(F.sequence(F.when(is_range, low).otherwise(1), F.when(is_range, high).otherwise(1)), _school))
        .when(single.between(1, 12), F.array(_school(single)))
        .otherwise(F.array_distinct(F.transform(F.filter(listed, lambda x: x.between(1, 12)), _school)))
    )


def institution_type(c: Column | str) -> Column:
    return F.coalesce(F.try_element_at(literal_map(vocab.INSTITUTION_TYPES), slug(c)), F.trim(text(c)))


def country(c: Column | str) -> Column:
    upper = F.upper(F.trim(text(c)))
    return F.coalesce(F.try_element_at(literal_map(vocab.COUNTRY_ALIASES), upper), upper)


# --- words and titles ---------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def fold(values: pd.Series) -> pd.Series:
    """Compatibility decomposition without diacritics: the one scalar the JVM has no function for."""

    def one(value: str | None) -> str | None:
        if value is None or (value.isascii() and "^" not in value and "`" not in value):
            return value
        return "".join(c for c in unicodedata.normalize("NFKD", value) if unicodedata.category(c) not in ("Mn", "Mc", "Me", "Sk", "Lm"))

    return values.map(one)


def words(c: Column | str, folded: bool = True) -> Column:
    """Words of a title or provider without years and seasons; ``folded=False`` for text known to be without accents."""
    flat = F.lower(fold(text(c)) if folded else text(c))
    flat = F.regexp_replace(flat, "&", " and ")
    flat = F.regexp_replace(flat, _TITLE_NOISE[0], " ")
    flat = F.regexp_replace(flat, _TITLE_NOISE[1], " ")
    return F.filter(F.split(flat, "[^a-z0-9]+"), lambda w: w != "")


def without(c: Column, others: Column | Iterable[str]) -> Column:
    """Members of ``c`` that aren't in ``others``, repeats and order kept."""
    drop = others if isinstance(others, Column) else F.array(*map(F.lit, others))
    return F.filter(c, lambda w: ~F.array_contains(drop, w))


def duplicate_key(provider_words: Column, title_words: Column) -> Column:
    """Provider and what its title says besides provider and generic words; null if either is empty."""
    title = without(without(title_words, provider_words), vocab.GENERIC_TITLE_WORDS)
    return F.when((F.size(provider_words) > 0) & (F.size(title) > 0), F.concat(F.array_join(provider_words, " "), F.lit("|"), F.array_join(title, " ")))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the smaller set of words that the larger has; 0 where one is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def compatible_titles(url_a: Column, words_a: Column, url_b: Column, words_b: Column, least: float = 0.75) -> Column:
    """Same application address, or titles that share ``least`` of the smaller one's words beyond generic ones."""
    same = (url_a != "") & (url_a == url_b)
    ratio = overlap_ratio(without(words_a, vocab.GENERIC_TITLE_WORDS), without(words_b, vocab.GENERIC_TITLE_WORDS))
    return F.coalesce(same | (ratio >= least), F.lit(False))


# --- addresses ----------------------------------------------------------------------------------------------------


def host(c: Column | str) -> Column:
    return F.lower(F.try_parse_url(F.regexp_replace(_col(c), " ", "%20"), F.lit("HOST")))


def url_key(c: Column | str) -> Column:
    """Host and path in lower case without the closing slashes, query or fragment; the empty string for a bad address."""
    path = F.coalesce(F.try_parse_url(F.regexp_replace(_col(c), " ", "%20"), F.lit("PATH")), F.lit(""))
    return F.coalesce(F.concat(host(c), F.regexp_replace(F.lower(path), "/+$", "")), F.lit(""))


def direct_application(application: Column | str, source: Column | str) -> Column:
    return F.coalesce(host(application) != host(source), F.lit(False))


def is_http(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"^https?://"), F.lit(False))


def private_host(c: Column | str) -> Column:
    """Whether an address points into a private network or at the machine itself."""
    h = F.regexp_replace(F.coalesce(host(c), F.lit("")), r"^\[|\]$", "")
    return h.rlike(r"^(?:.*\.)?localhost$|^::1$|^(?:127|10)\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.")


# --- scores and display -------------------------------------------------------------------------------------------


def confidence(c: Column | str) -> Column:
    """A number from 0 to 1, else null; null and the empty string count as 0."""
    number = F.when(F.trim(text(c)) == "", 0.0).otherwise(_col(c).cast("string").try_cast("double"))
    return F.when(number.between(0, 1), number)


def closed(deadline: Column | str, as_of: Column | str, status: Column | str | None = None) -> Column:
    """Whether the deadline is past; with ``status`` also whether the program is inactive."""
    past = F.coalesce(F.left(_col(deadline).cast("string"), F.lit(10)) < F.left(F.lit(as_of) if isinstance(as_of, str) else as_of, F.lit(10)), F.lit(False))
    return past if status is None else past | F.coalesce(_col(status) == "inactive", F.lit(False))


def deadline_key(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("date"), F.lit(vocab.NO_DEADLINE).cast("date"))


def vetting_score(status: Column | str) -> Column:
    return F.when(_col(status) == "human", 2).when(_col(status) == "ai", 1).otherwise(0)


def deadline_score(deadline: Column | str, today: Column) -> Column:
    return F.when(_col(deadline).isNull(), 0).when(_col(deadline).cast("date") >= today.cast("date"), 2).otherwise(1)


def money(amount: Column | str, varies: Column | str | None = None) -> Column:
    known = F.concat(F.lit("Up to $"), F.call_function("format_number", _col(amount).cast("double"), F.lit("#,##0.###")))
    shown = F.when(_col(amount).isNull(), "Amount not published").otherwise(known)
    return shown if varies is None else F.when(F.coalesce(_col(varies), F.lit(False)), "Varies").otherwise(shown)


def date_label(c: Column | str) -> Column:
    value = F.nullif(_col(c).cast("string"), F.lit(""))
    day = F.try_to_date(F.left(value, F.lit(10)), "yyyy-MM-dd")
    return F.when(value.isNull(), "No deadline published").otherwise(F.coalesce(F.date_format(day, "MMM d, yyyy"), F.lit("Date unavailable")))


def yes_no(c: Column | str) -> Column:
    return F.when(_col(c).isNull(), "Not published").when(_col(c), "Yes").otherwise("No")


def completeness(deadline: Column, description: Column, award: Mapping[str, Column], flags: Iterable[Column], arrays: Iterable[Column], scalars: Iterable[Column]) -> Column:
    """How much of a record is filled in: two points each for deadline, long description and maximum award, one for the rest."""
    point = lambda test, n=1: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    parts = [
        point(deadline.isNotNull(), 2),
        point(F.length(F.trim(description)) >= 80, 2),
        point(award["maximum"].isNotNull(), 2),
        point(award["minimum"].isNotNull()),
        *(point(f.isNotNull()) for f in flags),
        *(point(F.size(a) > 0) for a in arrays),
        *(point(s.isNotNull() & (s.cast("string") != "unknown")) for s in scalars),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total
