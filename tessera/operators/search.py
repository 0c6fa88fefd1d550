"""Directory search, both ways the catalog is read: grouped snapshot with offsets, and published table with a cursor."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fts, vocab
from tessera.functions import scalars as S
from tessera.operators.dedupe import group_similar, representative_order
from tessera.operators.normalize import row_json, summary_columns

SCOPES = ("all", "general", "institution")
SNAPSHOT_LIMIT, FULL_LIMIT, SUMMARY_LIMIT = 500, 200, 100


@dataclass(frozen=True)
class SearchQuery:
    """Parameters of a search. ``as_of`` is always given; ``include_closed`` None keeps closed records in snapshots only."""

    as_of: str
    q: str | None = None
    grade: str | None = None
    tag: str | None = None
    state: str | None = None
    minimum_award: float | None = None
    scope: str = "all"
    include_closed: bool | None = None
    vetted_only: bool = False
    page: int = 1
    limit: int | None = None
    cursor: str | None = None


def bounded(value: Any, least: int, most: int) -> int | None:
    """A whole number within bounds; nothing counts as 0 and so as the least; None for what isn't a finite number."""
    try:
        number = float(value or 0)
    except (TypeError, ValueError):
        return None
    return min(most, max(least, math.floor(number))) if math.isfinite(number) else None


def _clean(value: str | None, most: int) -> str | None:
    return re.sub(r"\s+", " ", value or "").strip()[:most] or None


def _slug(value: str) -> str:
    return re.sub("[^a-z0-9]+", "-", value.lower().replace("&", " and ")).strip("-")


def parse_query(parameters: Mapping[str, str], as_of: str) -> SearchQuery:
    """Request parameters, cleaned and bounded. An absent limit becomes 1, as ``bounded`` makes it the least."""
    get = parameters.get
    tag = _slug(get("tag") or "")
    given = get("asOfDate") or ""
    return SearchQuery(
        as_of=given if re.fullmatch(r"\d{4}-\d{2}-\d{2}", given) else as_of,
        q=_clean(get("q"), 160),
        grade=_clean(get("grade"), 80),
        tag=vocab.TAG_ALIASES.get(tag, tag) or None,
        state=(_clean(get("state"), 2) or "").upper() or None,
        minimum_award=bounded(get("minimumAward"), 0, 1_000_000),
        scope=get("institutionScope") if get("institutionScope") in SCOPES else "all",
        include_closed=get("includeClosed") == "true",
        vetted_only=get("vettedOnly") == "true",
        page=bounded(get("page"), 1, 10_000) or 1,
        limit=bounded(get("limit"), 1, FULL_LIMIT) or 30,
        cursor=get("cursor") or None,
    )


def refuse_bulk(parameters: Mapping[str, str], configured: bool = True) -> int | None:
    """Status of requests that aren't served: everything at once (410), or no backend (503)."""
    if parameters.get("all") == "true":
        return 410
    return None if configured else 503


def encode_cursor(deadline: date | str | None, key: str) -> str:
    text = json.dumps({"deadline": None if deadline is None else str(deadline), "id": key}, separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> tuple[str | None, str] | None:
    """(deadline, id), or None for no cursor and for a broken one."""
    if not cursor:
        return None
    try:
        value = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return (value.get("deadline"), value["id"]) if isinstance(value["id"], str) else None
    except (binascii.Error, ValueError, KeyError, TypeError, AttributeError):
        return None


def _and(*conditions: Column | None) -> Column:
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def _has(array: str, value: str) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def expand_grades(value: str) -> list[str]:
    """Grades a filter value stands for; itself if it is canonical."""
    if value in vocab.GRADES:
        return [value]
    if value.upper() == "K-8":
        return list(vocab.ELEMENTARY)
    key = _slug(value)
    if key in vocab.GRADE_ALIASES:
        return vocab.GRADE_ALIASES[key]
    if (m := re.fullmatch(r"(?:grades?-?)?(\d{1,2})-(\d{1,2})", key)) and 1 <= int(m[1]) <= int(m[2]) <= 12:
        return vocab.SCHOOL[int(m[1]) - 1 : int(m[2])]
    if (m := re.fullmatch(r"(?:grade-)?(\d{1,2})(?:st|nd|rd|th)?(?:-grade)?", key)) and 1 <= int(m[1]) <= 12:
        return [vocab.SCHOOL[int(m[1]) - 1]]
    return []


def has_terms(text: Column | str, q: str | None) -> Column:
    """Whether a text in lower case holds every term of a search, anywhere."""
    return _and(*(F.contains(S.text(text), F.lit(t)) for t in (q or "").lower().split()))


def with_total(rows: DataFrame, total: DataFrame, name: str) -> DataFrame:
    """``rows`` with the number of rows of ``total`` in each: one aggregate instead of a window over everything."""
    return rows.crossJoin(F.broadcast(total.agg(F.count("*").alias(name))))


def offset_page(rows: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit)


def snapshot_filter(query: SearchQuery) -> Column:
    """Predicate on catalog records: every term a substring, grades by what they stand for, a null award counts as 0."""
    status = F.coalesce(F.col("vetting.status"), F.lit("unvetted"))
    specific = F.coalesce(F.col("institutionSpecific"), F.lit(False))
    return _and(
        ~S.closed("deadline", query.as_of) if query.include_closed is False else None,
        has_terms("searchText", query.q),
        F.coalesce(F.arrays_overlap("eligibility.grades", F.array(*map(F.lit, expand_grades(query.grade))).cast("array<string>")), F.lit(False)) if query.grade else None,
        _has("eligibility.tags", query.tag) if query.tag else None,
        _has("eligibility.states", query.state) if query.state else None,
        F.coalesce(F.col("award.maximum"), F.lit(0.0)) >= query.minimum_award if query.minimum_award else None,
        {"general": ~specific, "institution": specific}.get(query.scope),
        status != "unvetted" if query.vetted_only else None,
    )


def search_snapshot(catalog: DataFrame, query: SearchQuery, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(page of grouped records in order, one row with total and rawTotal)."""
    matches = catalog.where(snapshot_filter(query))
    grouped = group_similar(matches, query.as_of, None, seq)
    limit = min(SNAPSHOT_LIMIT, max(1, query.limit or 100))
    page = max(1, query.page)
    rows = offset_page(grouped, representative_order(query.as_of, None, seq), page, limit)
    totals = grouped.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.coalesce("variantCount", F.lit(1))), F.lit(0)).alias("rawTotal"))
    return rows, totals.withColumns({"page": F.lit(page), "limit": F.lit(limit), "hasMore": F.col("total") > page * limit})


def published_filter(query: SearchQuery, summaries: bool, document: Column | None = None) -> Column:
    """Predicate on published rows: full-text match, exact members; with a minimum, 0 too, summaries leave out null awards and full rows count them as 0.

    Null parameters add nothing, so what is left reaches the scan.
    """
    maximum = F.col("award.maximum")
    return _and(
        F.col("publication_status") == "published",
        F.col("deadline").isNull() | (F.col("deadline") >= F.lit(query.as_of).cast("date")) if query.include_closed is not True else None,
        F.coalesce(F.col("vetting.status"), F.lit("unvetted")) != "unvetted" if query.vetted_only else None,
        fts.matches(F.col("search_document") if document is None else document, query.q) if query.q else None,
        _has("eligibility.grades", query.grade) if query.grade else None,
        _has("eligibility.tags", query.tag) if query.tag else None,
        _has("eligibility.states", query.state) if query.state else None,
        (maximum if summaries else F.coalesce(maximum, F.lit(0.0))) >= query.minimum_award if query.minimum_award is not None else None,
        {"general": ~F.col("institution_specific"), "institution": F.col("institution_specific")}.get(query.scope),
    )


def after(key: Column, last_key: Column, tie: Column, last_tie: Column) -> Column:
    """Rows beyond a cursor in (key, tie) order, written out so that both comparisons reach the scan."""
    return (key > last_key) | ((key == last_key) & (tie > last_tie))


def search_published(table: DataFrame, query: SearchQuery, summaries: bool = True, include_total: bool = True) -> DataFrame:
    """One page of published rows in (deadline, id) order as (record columns | record JSON, total_count).

    Only ids and deadlines are filtered and sorted; the page's full rows are joined to it afterwards. The total is
    counted only if asked for, else it is null.
    """
    most = SUMMARY_LIMIT if summaries else FULL_LIMIT
    limit = min(most, max(1, query.limit if query.limit is not None else (30 if summaries else 100)))
    key = S.deadline_key("deadline")
    matched = table.where(published_filter(query, summaries)).select("id", key.alias("deadline_key"))
    cursor = decode_cursor(query.cursor)
    page = matched
    if cursor:
        page = page.where(after(F.col("deadline_key"), F.lit(cursor[0] or vocab.NO_DEADLINE).cast("date"), F.col("id"), F.lit(cursor[1])))
    page = page.orderBy("deadline_key", "id").limit(limit)
    totals = matched.agg(F.count("*").alias("total_count")) if include_total else table.sparkSession.sql("SELECT CAST(NULL AS BIGINT) AS total_count")
    # A page has at most 200 rows, whatever the table's size.
    joined = table.join(F.broadcast(page), "id").crossJoin(F.broadcast(totals))
    if summaries:
        return joined.orderBy("deadline_key", "id").select(*summary_columns("institution_specific", "institution_name", True), "total_count")
    record = row_json(table, ("search_document",)).alias("record")
    return joined.orderBy("deadline_key", "id").select("id", "deadline", record, "total_count")


def response(table: DataFrame, query: SearchQuery, summaries: bool = True) -> dict:
    """A page as the interface answers it: one row more than the page tells whether there is more."""
    most = SUMMARY_LIMIT if summaries else FULL_LIMIT
    limit = min(most, max(1, query.limit or (30 if summaries else 100)))
    first = decode_cursor(query.cursor) is None
    rows = search_published(table, replace(query, limit=limit + 1), summaries, first).collect()
    more, records = len(rows) > limit, rows[:limit]
    total = (rows[0]["total_count"] or 0) if rows else 0
    return {
        "records": [r.asDict(recursive=True) for r in records],
        "total": total,
        "rawTotal": total,
        "page": max(1, query.page),
        "limit": limit,
        "hasMore": more,
        "nextCursor": encode_cursor(records[-1]["deadline"], records[-1]["id"]) if more else None,
    }


def search_category(grouped: DataFrame, tag: str, secondary: tuple[str, ...] = (), degree_levels: tuple[str, ...] = ()) -> DataFrame:
    """Records with a tag, all secondary tags and, if any are given, a degree level that contains one of these."""
    level = None
    if degree_levels:
        level = F.coalesce(F.exists("eligibility.degreeLevels", lambda x: F.lower(x).rlike("|".join(map(re.escape, degree_levels)))), F.lit(False))
    return grouped.where(_and(*(_has("eligibility.tags", t) for t in (tag, *secondary)), level))
