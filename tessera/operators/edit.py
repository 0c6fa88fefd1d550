"""Editing one record: path assignments typed by what they replace, validation, and the keyed update."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocab
from tessera.schema import PUBLISHED_DDL

_COLUMNS = {part.strip().split(" ")[0] for part in re.split(r",(?![^<]*>)", PUBLISHED_DDL)}
EDITABLE = _COLUMNS - {"id", "updated_at", "created_at"}
BLOCKED = {"__proto__", "constructor", "prototype"}
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def parse_value(raw: str, current: Any) -> Any:
    """A value of the kind it replaces: arrays as JSON or separated by ``|``, true or false, numbers, else text."""
    if raw == "null":
        return None
    if isinstance(current, list):
        if raw.startswith("["):
            value = json.loads(raw)
            if not isinstance(value, list):
                raise ValueError("an array is needed")
            return value
        return [part.strip() for part in raw.split("|") if part.strip()]
    if isinstance(current, bool):
        if raw not in ("true", "false"):
            raise ValueError(f"true or false is needed, not {raw}")
        return raw == "true"
    if isinstance(current, int | float):
        return float(raw) if "." in raw or "e" in raw.lower() else int(raw)
    if isinstance(current, str):
        return raw
    if raw in ("true", "false"):
        return raw == "true"
    if re.fullmatch(r"-?\d+(?:\.\d+)?", raw):
        return float(raw) if "." in raw else int(raw)
    return json.loads(raw) if raw[:1] in ("{", "[") else raw


def apply_assignment(record: dict, assignment: str) -> str:
    """Sets ``a.b=value`` in a record and returns the column it belongs to."""
    path, equals, raw = assignment.partition("=")
    parts = path.strip().split(".")
    if not equals or not path.strip():
        raise ValueError(f"not of the form path=value: {assignment}")
    if parts[0] not in EDITABLE or any(not p or p in BLOCKED for p in parts):
        raise ValueError(f"not editable: {path.strip()}")
    target = record
    for part in parts[:-1]:
        if target.get(part) is None:
            target[part] = {}
        if not isinstance(target[part], dict):
            raise ValueError(f"{part} has no fields")
        target = target[part]
    target[parts[-1]] = parse_value(raw, target.get(parts[-1]))
    return parts[0]


def search_text(record: Mapping[str, Any]) -> str:
    """Names, description and every array of eligibility, in lower case with single blanks."""
    own = record.get("eligibility") or {}
    parts = [record.get(c) for c in ("title", "provider", "description")] + [x for a in vocab.SEARCHED_ARRAYS for x in own.get(a) or []]
    return " ".join(" ".join(str(p) for p in parts if p).split()).lower()


def check_record(record: Mapping[str, Any]) -> None:
    """Raises ValueError at the first rule that a record to be stored breaks."""
    for c in ("source_url", "application_url"):
        if not re.match("https?://", record.get(c) or ""):
            raise ValueError(f"{c} isn't a web address")
    for c in ("source_checked_at", "opens", "deadline"):
        if record.get(c) is not None and not _DATE.fullmatch(str(record[c])):
            raise ValueError(f"{c} isn't a date or null")
    own = record.get("eligibility") or {}
    for name, value in (record.get("requirements") or {}).items():
        if value is not None and not isinstance(value, bool):
            raise ValueError(f"requirements.{name} isn't true, false or null")
    for a in vocab.SEARCHED_ARRAYS:
        if a in own and not isinstance(own[a], list):
            raise ValueError(f"eligibility.{a} isn't an array")
    for n in ("minimumGpa", "maximumGpa", "minimumAge", "maximumAge"):
        if own.get(n) is not None and (isinstance(own[n], bool) or not isinstance(own[n], int | float)):
            raise ValueError(f"eligibility.{n} isn't a number or null")
    if (record.get("vetting") or {}).get("status") not in vocab.VETTING:
        raise ValueError("vetting.status isn't known")
    if record.get("publication_status") not in vocab.PUBLICATION:
        raise ValueError("publication_status isn't known")


def edited(record: dict, assignments: Sequence[str], vetter: str | None = None, method: str = "manual-review", now: str = "") -> tuple[dict, dict]:
    """(record, changed columns only) after assignments, and a person's stamp if ``vetter`` is given."""
    after = json.loads(json.dumps(record, default=str))
    changed = {apply_assignment(after, a) for a in assignments}
    if vetter:
        stamp = {"status": "human", "confidence": 1.0, "vettedAt": now, "vettedBy": vetter, "method": method, "checkedUrl": after.get("source_url"), "missingFields": []}
        after["vetting"] = {**(after.get("vetting") or {}), **stamp}
        after["source_checked_at"], after["source_missing_fields"] = now[:10], []
        changed |= {"vetting", "source_checked_at", "source_missing_fields"}
    if "source_url" in changed:
        after["source_urls"] = list(dict.fromkeys([after["source_url"], *(after.get("source_urls") or [])]))
        changed.add("source_urls")
    if changed & {"title", "provider", "description", "eligibility"}:
        after["search_text"] = search_text(after)
        changed.add("search_text")
    check_record(after)
    return after, {c: after.get(c) for c in sorted(changed)}


def vet_stamp(vetter: str, at: Column, method: str = "manual-review") -> dict[str, Column]:
    """Columns of a vetting by a person at a time, for updates of many records."""
    none = F.array().cast("array<string>")
    stamp = {"status": F.lit("human"), "vettedAt": at.cast("string"), "vettedBy": F.lit(vetter), "confidence": F.lit(1.0), "method": F.lit(method), "checkedUrl": F.col("source_url"), "missingFields": none}
    return {"vetting": F.struct(*(v.alias(k) for k, v in stamp.items())), "source_checked_at": at.cast("date"), "source_missing_fields": none}


def update_one(table: DataFrame, key: str, changes: Mapping[str, Column], yes: bool = False) -> DataFrame:
    """``table`` with columns of one record changed; only the changed record unless ``yes``. Fails unless exactly one has the key."""
    found = table.where(F.col("id") == key).limit(2).count()
    if found != 1:
        raise ValueError(f"{found} records have the id {key}")
    hit = F.col("id") == key
    after = table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})
    return after if yes else after.where(hit)
