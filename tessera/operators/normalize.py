"""Record normalisation and projections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import vocab
from tessera.schema import ELIGIBILITY_ARRAYS, REQUIREMENTS

STRINGS = "array<string>"


def _array(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(STRINGS))


def unknown_essay(df: DataFrame) -> DataFrame:
    """Old imports wrote false where an essay wasn't mentioned: false becomes unknown."""
    return df.withColumn("requirements", F.col("requirements").withField("essay", F.when(F.col("requirements.essay"), True)))


def normalize(df: DataFrame, only: Column | None = None) -> DataFrame:
    """Grades, states, countries, tags and institution types in their closed vocabularies, and the search text.

    ``only`` says which records; the others, normalised before, stay as they are.
    """
    eligibility = F.coalesce("eligibility", _empty_eligibility())
    changed = {
        "grades": S.flat_map("eligibility.grades", S.grades),
        "states": S.flat_map("eligibility.states", S.states),
        "countries": S.distinct_filled(F.transform(_array("eligibility.countries"), lambda c: F.upper(F.trim(S.text(c))))),
        "tags": S.distinct_filled(F.transform(F.coalesce(F.col("eligibility.tags"), _array("tags")), S.tag)),
    }
    for name, value in changed.items():
        eligibility = eligibility.withField(name, value)
    which = (lambda value, name: value) if only is None else (lambda value, name: F.when(only, value).otherwise(F.col(name)))
    normal = df.withColumns(
        {
            "tags": which(F.when(F.col("tags").isNotNull(), S.distinct_filled(F.transform("tags", S.tag))), "tags"),
            "eligibility": which(eligibility, "eligibility"),
            "institutionTypes": which(S.distinct_filled(F.transform(_array("institutionTypes"), S.institution_type)), "institutionTypes"),
        }
    )
    return normal.withColumn("searchText", which(normalized_search_text(), "searchText"))


def _empty_eligibility() -> Column:
    arrays = [F.array().cast(STRINGS).alias(a) for a in ELIGIBILITY_ARRAYS]
    return F.struct(*arrays, F.lit(None).cast("double").alias("minimumGpa"), F.lit(None).cast("double").alias("minimumAge"))


def _joined(parts: Iterable[Column]) -> Column:
    """Non-empty parts in lower case with blanks between."""
    return F.lower(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " "))


def normalized_search_text() -> Column:
    """The text of the normaliser: names, texts, and the arrays it normalises."""
    arrays = ("eligibility.grades", "eligibility.states", "eligibility.tags", "institutionTypes")
    return _joined([*map(F.col, ("title", "provider", "summary", "description")), *(F.array_join(_array(a), " ") for a in arrays)])


def index_search_text() -> Column:
    """The text of the index: all arrays and a phrase for the scope."""
    arrays = ("countries", "states", "grades", "degreeLevels", "fields", "tags", "other")
    scope = F.when(F.coalesce(F.col("institutionSpecific"), F.lit(False)), "college-specific institution-specific").otherwise("general scholarship")
    parts = [S.text(c) for c in ("title", "provider", "description")] + [F.array_join(_array(f"eligibility.{a}"), " ") for a in arrays]
    return S.squeeze(F.lower(F.concat_ws(" ", *parts, scope, S.text("institutionName"), F.array_join(_array("institutionTypes"), " "))))


def facet_search_text() -> Column:
    """The text of the facet normaliser: all arrays, without a phrase for the scope."""
    arrays = ("countries", "states", "grades", "degreeLevels", "fields", "tags", "other")
    parts = [S.text(c) for c in ("title", "provider", "description")] + [F.array_join(_array(f"eligibility.{a}"), " ") for a in arrays]
    return S.squeeze(F.lower(F.concat_ws(" ", *parts, S.text("institutionName"), F.array_join(_array("institutionTypes"), " "))))


def edited_search_text(arrays: Iterable[str] = vocab.SEARCHED_ARRAYS) -> Column:
    """The text of the record editor, over whichever of its array fields the schema has."""
    return S.squeeze(_joined([*map(F.col, ("title", "provider", "description")), *(F.array_join(_array(f"eligibility.{a}"), " ") for a in arrays if a in ELIGIBILITY_ARRAYS)]))


def facet_normalize(df: DataFrame) -> DataFrame:
    """As ``normalize``, but states count by code only and tags of the record come before those of eligibility."""
    code = F.filter(F.transform(_array("eligibility.states"), lambda s: F.upper(F.trim(s))), lambda s: s.isin(*vocab.STATES.values()))
    tags = S.distinct_filled(F.transform(F.coalesce(F.col("tags"), _array("eligibility.tags")), S.tag))
    eligibility = F.col("eligibility").withField("states", S.distinct_filled(code)).withField("tags", tags).withField("grades", S.flat_map("eligibility.grades", S.grades))
    return df.withColumns({"tags": tags, "eligibility": eligibility}).withColumn("searchText", facet_search_text())


def restrict_tags(df: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """Tags limited to the taxonomy, mirrored at the top, with the index's search text."""
    known = F.array(*map(F.lit, allowed)).cast(STRINGS)
    tags = F.filter(_array("eligibility.tags"), lambda t: F.array_contains(known, t))
    return df.withColumn("eligibility", F.col("eligibility").withField("tags", tags)).withColumn("tags", tags).withColumn("searchText", index_search_text())


def summary_columns(institution_specific: str = "institutionSpecific", institution_name: str = "institutionName", default_vetting: bool = False) -> list[Column]:
    """Summary projection: 240 characters of description, two tags, few fields. ``default_vetting`` fills in "unvetted"."""
    status = F.coalesce(F.col("vetting.status"), F.lit("unvetted")) if default_vetting else F.col("vetting.status")
    vetting = F.struct(status.alias("status"), F.col("vetting.vettedAt").alias("vettedAt"))
    return [
        F.col("id"),
        F.col("title"),
        F.col("provider"),
        F.col("deadline"),
        F.left("description", F.lit(240)).alias("description"),
        F.struct(F.col("award.maximum").alias("maximum"), F.coalesce(F.col("award.varies"), F.lit(False)).alias("varies")).alias("award"),
        F.struct(F.col("requirements.essay").alias("essay")).alias("requirements"),
        F.struct(F.col("eligibility.minimumGpa").alias("minimumGpa"), F.slice(_array("eligibility.tags"), 1, 2).alias("tags")).alias("eligibility"),
        F.col(institution_specific).alias("institutionSpecific"),
        F.col(institution_name).alias("institutionName"),
        (vetting if default_vetting else F.when(F.col("vetting").isNotNull(), vetting)).alias("vetting"),
    ]


def published(df: DataFrame, now: Column) -> DataFrame:
    """Catalog records as rows of the published table, defaults filled in."""
    return df.select(
        "id",
        "title",
        "provider",
        F.col("sourceName").alias("source_name"),
        F.col("sourceUrl").alias("source_url"),
        F.coalesce("sourceUrls", F.array("sourceUrl")).alias("source_urls"),
        F.to_date("sourceCheckedAt").alias("source_checked_at"),
        F.coalesce("sourceMissingFields", "vetting.missingFields", F.array().cast(STRINGS)).alias("source_missing_fields"),
        F.col("applicationUrl").alias("application_url"),
        F.nullif("opens", F.lit("")).try_cast("date").alias("opens"),
        F.nullif("deadline", F.lit("")).try_cast("date").alias("deadline"),
        S.text("description").alias("description"),
        "award",
        "requirements",
        "eligibility",
        F.coalesce("institutionSpecific", F.lit(False)).alias("institution_specific"),
        F.nullif("institutionName", F.lit("")).alias("institution_name"),
        F.coalesce("institutionTypes", F.array().cast(STRINGS)).alias("institution_types"),
        S.text("searchText").alias("search_text"),
        "vetting",
        F.lit("published").alias("publication_status"),
        F.nullif(F.col("vetting.vettedAt"), F.lit("")).try_cast("timestamp").alias("published_at"),
        now.cast("timestamp").alias("updated_at"),
    )


def from_published(df: DataFrame) -> DataFrame:
    """Published rows back as catalog records, facets normalised again."""
    names = {"source_name": "sourceName", "source_url": "sourceUrl", "source_urls": "sourceUrls", "application_url": "applicationUrl", "institution_name": "institutionName"}
    renamed = df.withColumnsRenamed(names).withColumns(
        {
            "sourceCheckedAt": F.col("source_checked_at").cast("string"),
            "opens": F.col("opens").cast("string"),
            "deadline": F.col("deadline").cast("string"),
            "sourceMissingFields": F.coalesce("source_missing_fields", F.array().cast(STRINGS)),
            "institutionSpecific": F.coalesce("institution_specific", F.lit(False)),
            "institutionTypes": F.coalesce("institution_types", F.array().cast(STRINGS)),
            "tags": F.lit(None).cast(STRINGS),
        }
    )
    return facet_normalize(renamed.drop("source_checked_at", "source_missing_fields", "institution_specific", "institution_types", "search_text"))


def row_json(df: DataFrame, without: Iterable[str] = ("search_text",)) -> Column:
    """The whole row as JSON but for some keys."""
    return F.to_json(F.struct(*(c for c in df.columns if c not in set(without))))


def display_missing_fields() -> Column:
    """What a detail page lists as not published, after what the source itself lacks."""
    empty = lambda a: F.size(_array(a)) == 0
    rules = [
        (F.col("award.maximum").isNull() & ~F.coalesce(F.col("award.varies"), F.lit(False)), "award amount"),
        (F.nullif(F.col("deadline").cast("string"), F.lit("")).isNull(), "deadline"),
        (empty("eligibility.grades"), "eligible grade levels"),
        (empty("eligibility.fields"), "eligible fields of study"),
        (F.col("eligibility.minimumGpa").isNull(), "minimum GPA"),
        (F.col("requirements.essay").isNull(), "essay requirement"),
        (F.col("requirements.needBased").isNull(), "need-based status"),
        (F.col("requirements.meritBased").isNull(), "merit-based status"),
    ]
    return F.array_distinct(F.concat(_array("sourceMissingFields"), F.array_compact(F.array(*(F.when(test, name) for test, name in rules)))))


def pipeline_missing_fields() -> Column:
    """What the candidate pipeline records as missing; its names are its own."""
    empty = lambda a: F.size(_array(a)) == 0
    rules = [
        (F.nullif("deadline", F.lit("")).isNull(), "deadline"),
        (F.col("award.maximum").isNull() & ~F.coalesce(F.col("award.varies"), F.lit(False)), "award"),
        (empty("eligibility.grades"), "grades"),
        (empty("eligibility.degreeLevels"), "degree_levels"),
        (empty("eligibility.countries") & empty("eligibility.states"), "location"),
        (S.text("description") == "", "description"),
    ]
    return S.distinct_filled(F.concat(_array("sourceMissingFields"), F.array_compact(F.array(*(F.when(test, name) for test, name in rules)))))


def effective_vetting() -> Column:
    """Status and time of the vetting, "unvetted" where there is none."""
    return F.struct(F.coalesce("vetting.status", F.lit("unvetted")).alias("status"), F.col("vetting.vettedAt").alias("vettedAt"))


def sitemap_columns() -> list[Column]:
    return [F.col("id"), F.col("sourceCheckedAt").alias("lastModified")]


def prepare_candidates(df: DataFrame, inferred: Column | None = None, evidence: Column | None = None, method: str = "source_adapter") -> DataFrame:
    """Candidate envelope: normalised record, fingerprint, flags, errors and evidence.

    ``evidence`` is an array of structs (fieldPath, evidenceText, extractionMethod, confidence as a string);
    members without a path or a text go, texts are cut at 2,000 characters.
    """
    from tessera.operators.validate import candidate_errors

    award = F.coalesce(F.col("award"), F.struct(*(F.lit(None).cast("double").alias(n) for n in ("minimum", "maximum")), F.lit(False).alias("varies")))
    required = F.coalesce(F.col("requirements"), F.struct(*(F.lit(None).cast("boolean").alias(r) for r in REQUIREMENTS)))
    normal = normalize(df.withColumns({"award": award, "requirements": required, "eligibility": F.coalesce(F.col("eligibility"), _empty_eligibility())}))
    countries = S.distinct_filled(F.transform("eligibility.countries", S.country))
    normal = normal.withColumns({"eligibility": F.col("eligibility").withField("countries", countries), "sourceUrls": S.distinct_filled(F.concat(F.array("sourceUrl"), _array("sourceUrls")))})
    normal = normal.withColumn("sourceMissingFields", pipeline_missing_fields()).withColumn("errors", candidate_errors())
    found = F.lit(None).cast("array<struct<fieldPath:string,evidenceText:string,extractionMethod:string,confidence:string>>") if evidence is None else evidence
    kept = F.transform(
        F.coalesce(found, F.array().cast("array<struct<fieldPath:string,evidenceText:string,extractionMethod:string,confidence:string>>")),
        lambda e: F.struct(
            S.text(e["fieldPath"]).alias("fieldPath"),
            F.left(S.text(e["evidenceText"]), F.lit(2000)).alias("evidenceText"),
            F.coalesce(F.nullif(e["extractionMethod"], F.lit("")), F.lit(method)).alias("extractionMethod"),
            S.confidence(e["confidence"]).alias("confidence"),
        ),
    )
    guessed = F.lit(False) if inferred is None else F.coalesce(F.size(inferred) > 0, F.lit(False))
    flags = F.concat(
        F.transform("errors", lambda e: F.concat(F.lit("invalid:"), e)),
        F.transform("sourceMissingFields", lambda f: F.concat(F.lit("missing:"), f)),
        F.array_compact(F.array(F.when(guessed, "contains_inferred_fields"), F.lit("human_review_required"))),
    )
    return normal.withColumns(
        {
            "normalizedFingerprint": S.fingerprint("title", "provider", "applicationUrl"),
            "qualityFlags": S.distinct_filled(flags),
            "evidence": F.filter(kept, lambda e: (e["fieldPath"] != "") & (e["evidenceText"] != "")),
        }
    )
