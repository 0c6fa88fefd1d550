"""The catalog build from end to end: one lazy plan up to the indexed records, then outputs over what was written."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dedupe, facets, normalize, overlay, validate
from tessera.sources import catalog, sinks


@dataclass(frozen=True)
class Inputs:
    base: str
    imports: str
    enrichments: str
    tagging: str
    taxonomy: str
    queue: str = ""


def indexed(base: DataFrame, enrichments: DataFrame, overlays: DataFrame, allowed: Iterable[str], version: int) -> DataFrame:
    """Normalised, checked, deduplicated, enriched and tagged records (with ``seq``)."""
    allowed = list(allowed)
    clean = validate.required(normalize.normalize(normalize.unknown_essay(base)), validate.catalog_errors())
    kept = dedupe.greedy_dedupe(clean)
    tagged = overlay.overlay_tags(overlay.enrich(kept, enrichments, allowed), overlays, allowed, version)
    return normalize.restrict_tags(tagged, allowed)


def build(spark: SparkSession, inputs: Inputs, output: str, as_of: str) -> dict:
    """Writes catalog, shards, pages, facets, related records, category counts and sitemap; returns the metadata."""
    version, allowed = catalog.allowed_tags(spark, inputs.taxonomy)
    base = catalog.base_and_imports(catalog.json_array(spark, inputs.base), catalog.imported_lines(spark, inputs.imports))
    rows = indexed(base, catalog.enrichments(spark, inputs.enrichments), catalog.tag_overlays(spark, inputs.tagging), allowed, version)
    sinks.replace_table(rows, f"{output}/catalog")
    written = sinks.read_table(spark, f"{output}/catalog")
    sinks.replace_table(dedupe.group_similar(written, as_of), f"{output}/directory")
    grouped = sinks.read_table(spark, f"{output}/directory")
    day = F.coalesce(F.nullif(F.col("deadline"), F.lit("")), F.lit("9999-12-31"))
    sinks.write_chunks(written, f"{output}/search", [day, F.col("seq")], facets.SHARD, "shard")
    sinks.write_chunks(grouped, f"{output}/pages", dedupe.representative_order(as_of), facets.PAGE, "page")
    sinks.write_chunks(written, f"{output}/sitemap", [day, F.col("seq")], facets.SITEMAP, "file", *normalize.sitemap_columns())
    tags = facets.distinct_values(written, "eligibility.tags")
    sinks.replace_table(facets.top_per_tag(grouped, tags, as_of), f"{output}/related")
    counts = facets.category_counts(grouped, as_of).cache()
    sinks.replace_table(counts, f"{output}/category-counts")
    listed = [r["category"] for r in facets.emitted(counts).orderBy("category").collect()]
    found = catalog.line_count(spark, inputs.queue) if inputs.queue else 0
    figures = facets.totals(written, grouped, as_of, found).first().asDict()
    (first, one), (brief, two) = facets.first_pages(grouped, as_of, figures["count"], figures["activeDirectoryCount"], figures["directoryCount"])
    sinks.replace_table(first, f"{output}/directory-initial")
    sinks.replace_table(brief, f"{output}/directory-summary")
    grades = [r["value"] for r in facets.grade_facet(written).collect()]
    return figures | {"sitemapCategories": listed, "facets": {"grades": grades, "tags": [r["value"] for r in tags.collect()], **facets.static_facets(allowed)}, "initial": one, "summary": two}


def publish(spark: SparkSession, output: str, table: str, now: str) -> None:
    """Merges the built catalog into the published table."""
    rows = normalize.published(sinks.read_table(spark, f"{output}/catalog"), F.lit(now))
    sinks.upsert_table(rows, table)

