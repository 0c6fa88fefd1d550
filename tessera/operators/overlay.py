"""Overlays: verified enrichments folded into records in file order, and the last valid tag overlay."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.normalize import STRINGS, normalize, normalized_search_text
from tessera.schema import REQUIREMENTS

FILLED_ARRAYS = ("countries", "states", "grades", "degreeLevels", "fields", "citizenship")


def filled(current: Column, new: Column, verified: Column, replace: Column, is_array: bool = False) -> Column:
    """The new value where it is verified and either replaces or fills a gap; else the current one."""
    given = new.isNotNull() if is_array else new.isNotNull() & (new.cast("string") != "")
    gap = current.isNull() | (F.size(current) == 0) & (F.size(new) > 0) if is_array else current.isNull() | (current.cast("string") == "")
    return F.when(F.coalesce(verified & given & (replace | gap), F.lit(False)), new).otherwise(current)


def _ordered_union(a: Column, b: Column) -> Column:
    empty = F.array().cast(STRINGS)
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def _allowed(tags: Column, known: Column) -> Column:
    return F.filter(F.coalesce(tags, F.array().cast(STRINGS)), lambda t: F.array_contains(known, t))


def _merged(record: Column, e: Column, known: Column) -> Column:
    """One enrichment applied to the changeable part of a record, which is normalised after it. A merged award has no minimum."""
    has = lambda field: F.coalesce(F.array_contains(e["verifiedFields"], field), F.lit(False))
    replace = F.coalesce(e["mode"] == "replace", F.lit(False))
    own, new = record["eligibility"], e["eligibility"]
    gain = lambda field, value: F.when(has(field), value)
    varies = (
        F.when(replace & has("award.varies"), e["award"]["varies"])
        .when(record["award"]["maximum"].isNull(), F.coalesce(gain("award.varies", e["award"]["varies"]), record["award"]["varies"]))
        .otherwise(record["award"]["varies"])
    )
    award = F.struct(
        F.lit(None).cast("double").alias("minimum"),
        filled(record["award"]["maximum"], e["award"]["maximum"], has("award.maximum"), replace).alias("maximum"),
        varies.alias("varies"),
    )
    needs = F.struct(*(filled(record["requirements"][r], e["requirements"][r], has(f"requirements.{r}"), replace).alias(r) for r in REQUIREMENTS))
    arrays = {a: filled(own[a], new[a], has(f"eligibility.{a}"), replace, True) for a in FILLED_ARRAYS}
    # The taxonomy comes before aliases here, so other spellings of a tag are dropped.
    arrays["tags"] = F.when(replace & has("eligibility.tags"), _allowed(new["tags"], known)).otherwise(
        _allowed(_ordered_union(own["tags"], gain("eligibility.tags", new["tags"])), known)
    )
    arrays["other"] = F.when(replace & has("eligibility.other"), new["other"]).otherwise(_ordered_union(own["other"], gain("eligibility.other", new["other"])))
    normal = {
        "grades": S.flat_map(arrays["grades"], S.grades),
        "states": S.flat_map(arrays["states"], S.states),
        "countries": S.distinct_filled(F.transform(arrays["countries"], lambda c: F.upper(F.trim(S.text(c))))),
        "tags": S.distinct_filled(F.transform(arrays["tags"], S.tag)),
    }
    eligibility = F.struct(
        *((normal.get(a, arrays[a])).alias(a) for a in ("countries", "states", "grades", "degreeLevels", "fields", "citizenship", "tags", "other")),
        *(filled(own[n], new[n], has(f"eligibility.{n}"), replace).alias(n) for n in ("minimumGpa", "minimumAge")),
    )
    return F.struct(
        filled(record["description"], e["description"], has("description"), replace).alias("description"),
        award.alias("award"),
        needs.alias("requirements"),
        eligibility.alias("eligibility"),
        F.when(record["tags"].isNotNull(), S.distinct_filled(F.transform(record["tags"], S.tag))).alias("tags"),
        S.distinct_filled(F.transform(F.coalesce(record["institutionTypes"], F.array().cast(STRINGS)), S.institution_type)).alias("institutionTypes"),
        F.coalesce(F.nullif(e["enrichedFromUrl"], F.lit("")), record["enrichedFromUrl"]).alias("enrichedFromUrl"),
        F.coalesce(F.nullif(e["enrichedAt"], F.lit("")), record["enrichedAt"]).alias("enrichedAt"),
        _ordered_union(record["enrichedCanonicalTags"], gain("eligibility.tags", _allowed(new["tags"], known))).alias("enrichedCanonicalTags"),
    )


def enrich(records: DataFrame, enrichments: DataFrame, allowed: Iterable[str], seq: str = "seq") -> DataFrame:
    """Records with their enrichments of pipeline version 2 or 3 applied in file order; all other records stay as they are.

    Enrichments of one record are gathered and folded by ``aggregate``: one join, whatever their number.
    """
    known = F.array(*map(F.lit, allowed)).cast(STRINGS)
    valid = enrichments.where(F.col("pipelineVersion").isin(2, 3) & F.col("verifiedFields").isNotNull())
    fields = [c for c in valid.columns if c not in ("id", seq)]
    listed = valid.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(seq, F.struct(*fields).alias("e")))).alias("steps"))
    start = F.struct(
        *("description", "award", "requirements", "eligibility", "tags", "institutionTypes"),
        F.lit(None).cast("string").alias("enrichedFromUrl"),
        F.lit(None).cast("string").alias("enrichedAt"),
        F.array().cast(STRINGS).alias("enrichedCanonicalTags"),
    )
    folded = F.aggregate(F.coalesce("steps", F.array().cast(listed.schema["steps"].dataType)), start, lambda acc, step: _merged(acc, step["e"], known))
    hit = F.col("steps").isNotNull()
    joined = records.join(listed, "id", "left").withColumn("folded", folded)
    added = ("enrichedFromUrl", "enrichedAt", "enrichedCanonicalTags")
    merged = joined.withColumns({f.name: F.col(f"folded.{f.name}") if f.name in added else F.when(hit, F.col(f"folded.{f.name}")).otherwise(F.col(f.name)) for f in joined.schema["folded"].dataType.fields})
    return merged.withColumn("searchText", F.when(hit, normalized_search_text()).otherwise(F.col("searchText"))).drop("folded", "steps")


def overlay_tags(records: DataFrame, overlays: DataFrame, allowed: Iterable[str], taxonomy_version: int, seq: str = "seq") -> DataFrame:
    """Records with the tags of their last valid overlay (mode replace, pipeline 6, this taxonomy) and verified ones, and where these come from.

    Only records that have an overlay are normalised again.
    """
    known = F.array(*map(F.lit, allowed)).cast(STRINGS)
    valid = overlays.where((F.col("mode") == "replace") & (F.col("pipelineVersion") == 6) & (F.col("taxonomyVersion") == taxonomy_version) & F.col("tags").isNotNull())
    evidence = F.coalesce("evidence", F.array().cast(STRINGS))
    last = valid.groupBy("id").agg(F.max_by(F.struct(F.col("tags").alias("overlay"), evidence.alias("tagEvidence"), "taggedAt", F.col("model").alias("taggedByModel")), seq).alias("o"))
    joined = records.join(last.select("id", "o.*"), "id", "left")
    hit = F.col("overlay").isNotNull()
    tags = _ordered_union(_allowed(F.col("overlay"), known), F.col("enrichedCanonicalTags"))
    eligibility = F.when(hit, F.col("eligibility").withField("tags", tags)).otherwise(F.col("eligibility"))
    return normalize(joined.withColumn("eligibility", eligibility), hit).drop("overlay")
