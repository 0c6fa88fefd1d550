"""Queries over catalog records: the build from files, overlays, editing, validation, submissions, and the searches' other paths.

Like ``catalogue``, with records made from ``part``; files of the build's inputs are written to the shared folder first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalogue import AS_OF, CATALOG, STRINGS, catalog_records, records, register
from tessera.functions import scalars as S
from tessera.functions import vocab
from tessera.operators import dedupe, edit, facets, lookup, normalize, overlay, projection, prune, search, validate
from tessera.plans import build as plan
from tessera.schema import ELIGIBILITY_ARRAYS, REPORT_DDL, REQUIREMENTS
from tessera.sources import catalog, sinks
from tessera.sources.catalog import table
from tessera.sources.shared import shared_folder

ALLOWED = ("promo", "economy", "small", "red", "stem")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a source writes them, made from ``part``."""
    key = F.col("seq")
    rows = catalog_records(spark, sf_dir).drop("vetting")
    essay = F.when(key % 4 == 0, False).when(key % 4 == 1, True)
    return rows.select(
        "seq", "id", "title", "provider", "sourceName", "sourceUrl", "sourceUrls", "applicationUrl", "deadline", "programStatus", "award", "institutionSpecific",
        F.lit("2025-01-01").alias("sourceCheckedAt"), F.lit(None).cast(STRINGS).alias("sourceMissingFields"), F.lit(None).cast("string").alias("opens"),
        F.lit(None).cast("string").alias("summary"), F.when(key % 6 != 0, F.concat_ws(" ", "title", "provider")).alias("description"),
        F.struct(essay.alias("essay"), *(F.lit(None).cast("boolean").alias(r) for r in REQUIREMENTS if r != "essay")).alias("requirements"),
        F.col("eligibility").withField("countries", F.array(F.lit(" us "), F.lit(""))).withField("states", F.array(F.lit("Texas"), F.lit("ny"))).alias("eligibility"),
        F.lit(None).cast(STRINGS).alias("tags"), F.lit(None).cast("string").alias("institutionName"), F.array(F.lit("two year"), F.lit("")).alias("institutionTypes"),
    )


def _clerk() -> Column:
    return F.concat(F.lit("Clerk number "), "o_orderkey")


def enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, fields = F.col("o_orderkey"), [("description",), ("award.maximum", "eligibility.tags"), ("description", "eligibility.tags")]
    verified = F.get(F.array(*(F.array(*map(F.lit, f)) for f in fields)), (key % 3).cast("int"))
    tags = F.array(F.lit("stem"), F.lit("nope"), F.lower("o_orderstatus"))
    eligibility = F.struct(*((tags if a == "tags" else F.lit(None).cast(STRINGS)).alias(a) for a in ELIGIBILITY_ARRAYS), *(F.lit(None).cast("double").alias(n) for n in ("minimumGpa", "minimumAge")))
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"), F.concat(F.lit("p"), "o_custkey").alias("id"), (key % 4).cast("int").alias("pipelineVersion"), F.when(key % 5 == 0, "replace").otherwise("fill").alias("mode"),
        F.when(key % 11 != 0, verified).alias("verifiedFields"), F.col("o_orderpriority").alias("description"),
        F.struct(F.lit(1.0).alias("minimum"), F.col("o_totalprice").alias("maximum"), F.lit(None).cast("boolean").alias("varies")).alias("award"),
        F.struct(*(F.lit(None).cast("boolean").alias(r) for r in REQUIREMENTS)).alias("requirements"), eligibility.alias("eligibility"),
        F.lit("").alias("enrichedFromUrl"), _clerk().alias("enrichedAt"),
    )


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    tag = F.get(F.array(*map(F.lit, ("red", "small", "economy", "nope"))), (key % 4).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"), F.concat(F.lit("p"), F.col("o_custkey") + 1).alias("id"), F.when(key % 7 == 0, "add").otherwise("replace").alias("mode"),
        F.when(key % 5 == 0, 5).otherwise(6).alias("pipelineVersion"), F.when(key % 3 == 0, 3).otherwise(4).alias("taxonomyVersion"),
        F.when(key % 13 != 0, F.array(tag)).alias("tags"), F.array(_clerk()).alias("evidence"), F.lit("2025-02-02").alias("taggedAt"), F.lit("m1").alias("model"),
    )


_OWN_TAGS = f"concat_ws(',', CASE WHEN kind IN {ALLOWED} THEN kind END, CASE WHEN word IN {ALLOWED} AND word <> kind THEN word END"
_OVERLAID = f"""{CATALOG},
    enr AS (SELECT 'p' || o_custkey AS id, o_orderkey AS k, o_orderkey % 3 AS f, o_orderpriority AS d, o_totalprice AS a, o_orderkey % 5 = 0 AS rep FROM orders WHERE o_orderkey % 4 IN (2, 3) AND o_orderkey % 11 <> 0),
    e AS (SELECT id, arg_max(d, k) FILTER (rep AND f <> 1) AS last_d, arg_min(d, k) FILTER (NOT rep AND f <> 1) AS first_d, arg_max(a, k) FILTER (rep AND f = 1) AS last_a,
                 arg_min(a, k) FILTER (NOT rep AND f = 1) AS first_a, bool_or(f > 0) AS stem, bool_or(rep AND f > 0) AS only_stem FROM enr GROUP BY id),
    ov AS (SELECT 'p' || (o_custkey + 1) AS id, arg_max(['red', 'small', 'economy', ''][CAST(o_orderkey % 4 + 1 AS INTEGER)], o_orderkey) AS t, 'Clerk number ' || max(o_orderkey) AS ev
           FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 13 <> 0 GROUP BY 1),
    built AS (SELECT c.*, row_number() OVER (ORDER BY seq % 2 = 0, seq) AS place, t AS overlaid, row_number() OVER (PARTITION BY title, provider, application_url ORDER BY seq % 2 = 0, seq) AS fold,
                count(*) OVER (PARTITION BY title, provider, application_url) + count(*) FILTER (seq % 50 = 1) OVER (PARTITION BY title, provider, application_url) AS n_urls, coalesce(last_d, CASE WHEN seq % 6 <> 0 THEN title || ' ' || provider END, first_d, '') AS description,
                CAST(round(coalesce(last_a, award_maximum, first_a, 0) * 100) AS BIGINT) AS cents, e.id IS NOT NULL AS enriched, ev, ov.id IS NOT NULL AS tagged,
                CASE WHEN only_stem THEN 'stem' WHEN stem THEN {_OWN_TAGS}, 'stem') ELSE {_OWN_TAGS}) END AS enriched_tags,
                CASE WHEN ov.id IS NULL THEN CASE WHEN only_stem THEN 'stem' WHEN stem THEN {_OWN_TAGS}, 'stem') ELSE {_OWN_TAGS}) END
                     ELSE concat_ws(',', nullif(t, ''), CASE WHEN stem THEN 'stem' END) END AS tag_list
              FROM catalog c LEFT JOIN e USING (id) LEFT JOIN ov USING (id)),
    kept AS (SELECT * FROM built WHERE fold = 1)"""


def _cents(c: str) -> Column:
    return F.round(F.coalesce(F.col(c), F.lit(0.0)) * 100).cast("long")


@register("fill_missing_fold", f"WITH {_OVERLAID} SELECT id, description, cents, CASE WHEN enriched THEN enriched_tags ELSE kind || ',' || word END AS tags, enriched FROM built")
def fill_missing_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several enrichments of a record in file order; only records that have one are normalised again."""
    rows = raw(spark, sf_dir).withColumn("searchText", F.lit("as it was"))
    done = overlay.enrich(rows, enrichments(spark, sf_dir), ALLOWED)
    return done.select("id", S.text("description").alias("description"), _cents("award.maximum").alias("cents"), F.array_join("eligibility.tags", ",").alias("tags"), (F.col("searchText") != "as it was").alias("enriched"))


@register(
    "tag_replace_overlay",
    f"""WITH {_OVERLAID} SELECT id, CASE WHEN tagged THEN concat_ws(',', nullif(overlaid, ''), 'stem') ELSE kind || ',' || word END AS tags, coalesce(ev, '') AS evidence, CASE WHEN tagged THEN 'TX,NY' ELSE 'Texas,ny' END AS states FROM built""",
)
def tag_replace_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last valid overlay replaces the tags, but for verified ones; other records stay as they are."""
    rows = raw(spark, sf_dir).withColumn("searchText", F.lit("")).withColumn("enrichedCanonicalTags", F.array(F.lit("stem")))
    done = overlay.overlay_tags(rows, overlays(spark, sf_dir), ALLOWED, 4)
    return done.select("id", F.array_join("eligibility.tags", ",").alias("tags"), F.coalesce(F.array_join("tagEvidence", ","), F.lit("")).alias("evidence"), F.array_join("eligibility.states", ",").alias("states"))


# --- the build ----------------------------------------------------------------------------------------------------


def _write_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines of one file, in the order of ``seq``."""
    spark = df.sparkSession
    lines = df.orderBy("seq").select(F.to_json(F.struct(*(c for c in df.columns if c != "seq"))).alias("value"))
    lines.coalesce(1).write.text(f"{path}.folder")
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(make(path).getParent())
    (one,) = [f.getPath() for f in files.listStatus(make(f"{path}.folder")) if f.getPath().getName().startswith("part-")]
    files.rename(one, make(path))
    files.delete(make(f"{path}.folder"), True)


def _write_array(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    least = df.agg(F.min("seq").alias("least"))
    json = F.to_json(F.struct(*(c for c in df.columns if c != "seq")))
    rows = df.crossJoin(F.broadcast(least)).select(F.lit(1).alias("rank"), "seq", F.concat(F.when(F.col("seq") == F.col("least"), "").otherwise(","), json).alias("value"))
    ends = spark.createDataFrame([(0, 0, "["), (2, 0, "]")], "rank int, seq long, value string")
    whole = rows.unionAll(ends).orderBy("rank", "seq").select("value")
    whole.coalesce(1).write.text(f"{path}.folder")
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (one,) = [f.getPath() for f in files.listStatus(make(f"{path}.folder")) if f.getPath().getName().startswith("part-")]
    files.rename(one, make(path))
    files.delete(make(f"{path}.folder"), True)


def build_inputs(spark: SparkSession, sf_dir: str, folder: str) -> plan.Inputs:
    """Files of a build in ``folder``: odd parts as the base, even ones and some repeats as an import, and all overlays."""
    rows = raw(spark, sf_dir)
    _write_array(rows.where("seq % 2 = 1"), f"{folder}/base.json")
    again = rows.where("seq % 50 = 1").withColumns({"seq": F.col("seq") + (1 << 40), "sourceUrl": F.concat("sourceUrl", F.lit("&again"))})
    _write_lines(rows.where("seq % 2 = 0").unionByName(again), f"{folder}/imports/one/records.jsonl")
    _write_lines(enrichments(spark, sf_dir), f"{folder}/enrichments.jsonl")
    _write_lines(overlays(spark, sf_dir), f"{folder}/tags.jsonl")
    _write_lines(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seq"), "n_name"), f"{folder}/queue.jsonl")
    taxonomy = spark.range(1).select(F.lit(0).alias("seq"), F.lit(4).alias("version"), F.array(*(F.struct(F.lit(t).alias("id")) for t in ALLOWED)).alias("tags"))
    _write_lines(taxonomy, f"{folder}/taxonomy.json")
    return plan.Inputs(*(f"{folder}/{n}" for n in ("base.json", "imports", "enrichments.jsonl", "tags.jsonl", "taxonomy.json", "queue.jsonl")))


_DIRECTORY = f"""ranked AS (SELECT *, provider || '|' || title AS k, row_number() OVER (PARTITION BY provider, title ORDER BY coalesce(deadline < DATE '{AS_OF}', FALSE), coalesce(deadline, DATE '9999-12-31'), title, place) AS rank FROM kept),
    directory AS (SELECT *, row_number() OVER (ORDER BY coalesce(deadline < DATE '{AS_OF}', FALSE), coalesce(deadline, DATE '9999-12-31'), title, place) AS n, coalesce(deadline < DATE '{AS_OF}', FALSE) AS closed FROM ranked WHERE rank = 1)"""


@register(
    "catalog_build",
    f"""WITH {_OVERLAID}, {_DIRECTORY}
        SELECT 'catalog' AS output, id AS key, concat_ws('|', tag_list, description, cents, n_urls, coalesce(ev, ''), CASE WHEN seq % 4 = 1 THEN 'essay' ELSE '' END) AS value FROM kept
        UNION ALL SELECT 'shard', id, CAST(1 + CAST(floor((row_number() OVER (ORDER BY coalesce(deadline, DATE '9999-12-31'), place) - 1) / 500) AS INTEGER) AS VARCHAR) FROM kept
        UNION ALL SELECT 'file', id, CAST(1 + CAST(floor((row_number() OVER (ORDER BY coalesce(deadline, DATE '9999-12-31'), place) - 1) / 10000) AS INTEGER) AS VARCHAR) || ' 2025-01-01' FROM kept
        UNION ALL SELECT 'page', id, CAST(1 + CAST(floor((n - 1) / 100) AS INTEGER) AS VARCHAR) FROM directory
        UNION ALL SELECT 'initial', id, '' FROM directory WHERE n <= 200
        UNION ALL SELECT 'summary', id, '' FROM (SELECT * FROM directory WHERE NOT closed ORDER BY n LIMIT 30)
        UNION ALL SELECT 'tag', tag, '' FROM (SELECT DISTINCT unnest(string_split(tag_list, ',')) AS tag FROM kept) WHERE tag <> ''
        UNION ALL SELECT 'category', unnest(['international-students', 'international-students/no-essay', 'international-students/stem', 'international-students/women', 'international-students/graduate']), '0'
        UNION ALL SELECT 'figure', unnest(['activeDirectoryCount', 'count', 'directoryCount', 'directoryPageCount', 'discoveredCount', 'searchShardCount', 'sourceCount', 'queue', 'sitemapCategories', 'hasMore']),
                  unnest([CAST(x AS VARCHAR) FOR x IN [(SELECT count(*) FROM directory WHERE NOT closed), (SELECT count(*) FROM kept), (SELECT count(*) FROM directory), (SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) FROM directory),
                          (SELECT greatest(count(*), 25) FROM kept), (SELECT CAST(ceil(count(*) / 500.0) AS BIGINT) FROM kept), (SELECT count(DISTINCT seq % 7) FROM kept), 25, 0, (SELECT CAST(count(*) > 200 AS BIGINT) FROM directory)]])""",
)
def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build from files, and every row of its outputs as (output, key, value)."""
    folder = f"{shared_folder(spark)}/build-{uuid.uuid4().hex}"
    inputs = build_inputs(spark, sf_dir, folder)
    figures = plan.build(spark, inputs, f"{folder}/out", AS_OF)
    read = lambda name: sinks.read_table(spark, f"{folder}/out/{name}")
    row = lambda name, df, key, value: df.select(F.lit(name).alias("output"), F.col(key).cast("string").alias("key"), value.cast("string").alias("value"))
    shown = F.concat_ws("|", F.array_join("tags", ","), S.text("description"), _cents("award.maximum"), F.size("sourceUrls"), F.coalesce(F.array_join("tagEvidence", ","), F.lit("")), F.when(F.col("requirements.essay"), "essay").otherwise(""))
    named = {**{k: figures[k] for k in ("activeDirectoryCount", "count", "directoryCount", "directoryPageCount", "discoveredCount", "searchShardCount", "sourceCount")}, "queue": catalog.line_count(spark, inputs.queue)}
    named |= {"sitemapCategories": len(figures["sitemapCategories"]), "hasMore": int(figures["initial"]["hasMore"])}
    parts = [
        row("catalog", read("catalog"), "id", shown),
        row("shard", read("search"), "id", F.col("shard")),
        row("file", read("sitemap"), "id", F.concat_ws(" ", "file", "lastModified")),
        row("page", read("pages"), "id", F.col("page")),
        row("initial", read("directory-initial"), "id", F.lit("")),
        row("summary", read("directory-summary"), "id", F.lit("")),
        row("category", read("category-counts"), "category", F.col("count")),
        spark.createDataFrame([("tag", t, "") for t in figures["facets"]["tags"]] + [("figure", k, str(v)) for k, v in named.items()], "output string, key string, value string"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@register("union_all_order", "SELECT row_number() OVER (ORDER BY rank, id) AS seq, name FROM (SELECT 0 AS rank, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 1, c_custkey, c_name FROM customer)")
def union_all_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base records before imported ones, with one ordinal."""
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"))
    imports = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.lit("a/records.jsonl").alias("file"), F.col("c_name").alias("name"))
    return catalog.base_and_imports(base, imports).select("seq", "name")


@register(
    "static_facets",
    f"SELECT 'tag' AS facet, unnest({list(ALLOWED)!r}) AS value UNION ALL SELECT 'state', unnest(string_split('AK AL AR AZ CA CO CT DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY', ' '))",
)
def static_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facets.static_facets(ALLOWED)
    return spark.createDataFrame([("tag", t) for t in found["tagOptions"]] + [("state", s) for s in found["states"]], "facet string, value string")


# --- normalising --------------------------------------------------------------------------------------------------

_GRADE_SQL = f"CASE WHEN size BETWEEN 1 AND 12 THEN ({list(vocab.SCHOOL)!r})[size] ELSE '' END"


@register(
    "record_normalise",
    f"""WITH {CATALOG} SELECT id, 'US' AS countries, 'TX,NY' AS states, {_GRADE_SQL} AS grades, kind || CASE WHEN word <> kind THEN ',' || word ELSE '' END AS tags, 'Two-year' AS types,
        lower(concat_ws(' ', title, provider, CASE WHEN seq % 6 <> 0 THEN title || ' ' || provider END, nullif({_GRADE_SQL}, ''), 'TX NY', kind || CASE WHEN word <> kind THEN ' ' || word ELSE '' END, 'Two-year')) AS search_text,
        CASE WHEN seq % 4 = 1 THEN 'yes' ELSE '' END AS essay FROM catalog""",
)
def record_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.normalize(normalize.unknown_essay(raw(spark, sf_dir)))
    joined = [F.array_join(f"eligibility.{a}", ",").alias(a) for a in ("countries", "states", "grades", "tags")]
    return rows.select("id", *joined, F.array_join("institutionTypes", ",").alias("types"), F.col("searchText").alias("search_text"), F.when(F.col("requirements.essay"), "yes").otherwise("").alias("essay"))


@register(
    "other_search_texts",
    f"""WITH {CATALOG} SELECT id, lower(concat_ws(' ', title, provider, title, provider, upper(kind), nullif({_GRADE_SQL}, ''), thing, kind, word)) AS facet_text,
        lower(concat_ws(' ', title, provider, title, provider, upper(kind), nullif({_GRADE_SQL}, ''), thing, kind, word)) AS edited_text FROM catalog""",
)
def other_search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the facet normaliser and of the record editor; without other arrays they agree."""
    rows = catalog_records(spark, sf_dir).withColumns({"institutionName": F.lit(None).cast("string"), "institutionTypes": F.lit(None).cast(STRINGS)})
    return rows.select("id", normalize.facet_search_text().alias("facet_text"), normalize.edited_search_text().alias("edited_text"))


@register("row_json", f"WITH {CATALOG} SELECT id, title, CAST(seq AS VARCHAR) AS seq, FALSE AS has_text FROM catalog")
def row_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    read = rows.select("id", normalize.row_json(rows).alias("record"))
    return read.select("id", F.get_json_object("record", "$.title").alias("title"), F.get_json_object("record", "$.seq").alias("seq"), F.contains("record", F.lit('"search_text"')).alias("has_text"))


@register(
    "published_back",
    f"""WITH {CATALOG} SELECT id, provider, coalesce(CAST(deadline AS VARCHAR), '') AS deadline, CASE WHEN seq % 2 = 0 THEN 'TX' ELSE '' END AS states, kind || CASE WHEN word <> kind THEN ',' || word ELSE '' END AS tags,
        '2025-01-01' AS checked, 0 AS missing FROM catalog""",
)
def published_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rows as catalog records again: states count by code only."""
    states = F.array(F.lit("Texas"), F.when(F.col("seq") % 2 == 0, " tx ").otherwise("zz"))
    rows = records(spark, sf_dir).withColumns(
        {"eligibility": F.col("eligibility").withField("states", states), "opens": F.lit(None).cast("date"), "source_missing_fields": F.lit(None).cast(STRINGS), "institution_types": F.lit(None).cast(STRINGS)}
    )
    back = normalize.from_published(rows)
    return back.select("id", "provider", S.text("deadline").alias("deadline"), F.array_join("eligibility.states", ",").alias("states"), F.array_join("tags", ",").alias("tags"), F.col("sourceCheckedAt").alias("checked"), F.size("sourceMissingFields").alias("missing"))


@register(
    "candidate_envelope",
    f"""WITH {CATALOG} SELECT id, 'US' AS countries, concat_ws(',', CASE WHEN deadline IS NULL THEN 'missing:deadline' END, CASE WHEN award_maximum IS NULL AND NOT varies THEN 'missing:award' END,
            CASE WHEN size NOT BETWEEN 1 AND 12 THEN 'missing:grades' END, 'missing:degree_levels', CASE WHEN seq % 6 = 0 THEN 'missing:description' END, CASE WHEN seq % 3 = 0 THEN 'contains_inferred_fields' END, 'human_review_required') AS flags,
        sha256(title || '|' || trim(regexp_replace(lower(provider), '[^a-z0-9]+', ' ', 'g')) || '|' || application_url) AS fingerprint, CASE WHEN seq % 5 > 0 THEN 1 ELSE 0 END AS evidence FROM catalog""",
)
def candidate_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir)
    rows = rows.withColumn("eligibility", F.col("eligibility").withField("countries", F.array(F.lit("United States"))))
    given = F.array(F.struct(F.when(F.col("seq") % 5 > 0, "title").otherwise("").alias("fieldPath"), F.col("title").alias("evidenceText"), F.lit("").alias("extractionMethod"), F.lit("0.5").alias("confidence")))
    done = normalize.prepare_candidates(rows, F.when(F.col("seq") % 3 == 0, F.array(F.lit("x"))), given)
    return done.select("id", F.array_join("eligibility.countries", ",").alias("countries"), F.array_join("qualityFlags", ",").alias("flags"), F.col("normalizedFingerprint").alias("fingerprint"), F.size("evidence").alias("evidence"))


@register(
    "pipeline_missing_fields",
    f"""WITH {CATALOG} SELECT id, concat_ws(',', 'own', CASE WHEN deadline IS NULL THEN 'deadline' END, CASE WHEN award_maximum IS NULL AND NOT varies THEN 'award' END, CASE WHEN size NOT BETWEEN 1 AND 12 THEN 'grades' END,
        'degree_levels', 'location') AS missing, coalesce(vetting_status, 'unvetted') AS vetting FROM catalog""",
)
def pipeline_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the candidate pipeline finds missing, and the vetting that counts."""
    rows = catalog_records(spark, sf_dir).withColumn("sourceMissingFields", F.array(F.lit("own"), F.lit("")))
    return rows.select("id", F.array_join(normalize.pipeline_missing_fields(), ",").alias("missing"), normalize.effective_vetting()["status"].alias("vetting"))


@register("plain_fingerprint", f"WITH {CATALOG} SELECT id, title || '|' || lower(provider) || '|' || CASE WHEN seq % 2 = 0 THEN application_url ELSE source_url END AS print FROM catalog")
def plain_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    application = F.when(F.col("seq") % 2 == 0, F.col("application_url")).when(F.col("seq") % 4 == 1, "")
    return records(spark, sf_dir).select("id", S.plain_fingerprint("title", "provider", application, F.col("source_url")).alias("print"))


# --- searching ----------------------------------------------------------------------------------------------------


@register(
    "snapshot_filters",
    f"""WITH {CATALOG} SELECT id, (deadline IS NULL OR deadline >= DATE '{AS_OF}') AS is_open, size BETWEEN 1 AND 8 AS elementary, size BETWEEN 9 AND 10 AS by_range, kind = 'promo' OR word = 'promo' AS tagged,
        FALSE AS in_state, coalesce(award_maximum, 0) >= 950 AS award, institution_specific AS specific FROM catalog""",
)
def snapshot_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filter of a snapshot by itself: whether a record passes it."""
    passes = lambda **q: search.snapshot_filter(search.SearchQuery(AS_OF, **q))
    found = {
        "is_open": passes(include_closed=False), "elementary": passes(grade="K-8"), "by_range": passes(grade="Grades 9-10"), "tagged": passes(tag="promo"), "in_state": passes(state="TX"),
        "award": passes(minimum_award=950), "specific": passes(scope="institution"),
    }
    return catalog_records(spark, sf_dir).select("id", *(c.alias(n) for n, c in found.items()))


@register("category_levels", f"WITH {CATALOG} SELECT id FROM catalog WHERE (kind = 'promo' OR word = 'promo') AND seq % 3 > 0")
def category_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category limited to degree levels that contain one of two words, in any case."""
    levels = F.array(F.get(F.array(*map(F.lit, ("Doctoral Degree", "GRADUATE Degree", "Associate degree"))), (F.col("seq") % 3).cast("int")), F.lit("x"))
    rows = records(spark, sf_dir).withColumn("eligibility", F.col("eligibility").withField("degreeLevels", levels))
    return search.search_category(rows, "promo", degree_levels=("graduate", "associate")).select("id")


@register(
    "folded_words",
    "SELECT doc_id, array_to_string(list_filter(string_split_regex(strip_accents(lower(left(text, 80))), '[^a-z0-9]+'), lambda w: w <> ''), ' ') AS words FROM documents WHERE lang IN ('fr', 'es') AND NOT regexp_matches(left(text, 80), '[0-9&]')",
)
def folded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the beginnings of French and Spanish texts, without their accents."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin("fr", "es") & ~F.left("text", F.lit(80)).rlike("[0-9&]"))
    return docs.select("doc_id", F.array_join(S.words(F.left("text", F.lit(80))), " ").alias("words"))


@register("minimum_of_zero", f"WITH {CATALOG} SELECT count(*) FILTER (award_maximum IS NOT NULL) AS summaries, count(*) AS full_rows FROM catalog WHERE publication_status = 'published'")
def minimum_of_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A minimum of 0 leaves out null awards in summaries, but not in full rows."""
    query = search.SearchQuery(AS_OF, minimum_award=0, include_closed=True)
    return records(spark, sf_dir).agg(F.count_if(search.published_filter(query, True)).alias("summaries"), F.count_if(search.published_filter(query, False)).alias("full_rows"))


@register("clamped_limits", f"WITH {CATALOG} SELECT unnest(['summaries', 'full', 'least']) AS page, unnest([least(100, n), least(200, n), 1]) AS rows FROM (SELECT count(*) AS n FROM catalog WHERE publication_status = 'published')")
def clamped_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    page = lambda name, limit, brief: search.search_published(rows, search.SearchQuery(AS_OF, include_closed=True, limit=limit), brief, False).agg(F.lit(name).alias("page"), F.count("*").alias("rows"))
    return page("summaries", 5000, True).unionAll(page("full", 5000, False)).unionAll(page("least", -3, True))


@register(
    "page_probe",
    f"""WITH {CATALOG}, m AS (SELECT id, row_number() OVER (ORDER BY coalesce(deadline, DATE '9999-12-31'), id) AS n, count(*) OVER () AS total FROM catalog WHERE publication_status = 'published' AND (deadline IS NULL OR deadline >= DATE '{AS_OF}'))
        SELECT id, CASE WHEN n <= 30 THEN 1 ELSE 2 END AS page, CASE WHEN n <= 30 THEN total ELSE 0 END AS total, total > CASE WHEN n <= 30 THEN 30 ELSE 60 END AS has_more FROM m WHERE n <= 60""",
)
def page_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages, the second by the first one's cursor; a row more than the page tells whether there is another."""
    rows, out, cursor = records(spark, sf_dir), [], None
    for k in (1, 2):
        page = search.response(rows, search.SearchQuery(AS_OF, limit=30, cursor=cursor))
        out += [(r["id"], k, page["total"], page["hasMore"]) for r in page["records"]]
        cursor = page["nextCursor"]
        if cursor is None:
            break
    return spark.createDataFrame(out, "id string, page int, total long, has_more boolean")


@register(
    "request_parameters",
    f"""SELECT n_nationkey, 'a b' || n_nationkey AS q, CASE WHEN n_nationkey % 2 = 0 THEN 'financial-need' ELSE '' END AS tag, upper(left(n_name, 2)) AS state, CAST(least(200, greatest(1, n_nationkey * 20 - 100)) AS INTEGER) AS limit_,
        CAST(greatest(1, n_nationkey) AS INTEGER) AS page, CAST(least(1000000, n_nationkey * 100000) AS INTEGER) AS award, CASE WHEN n_nationkey % 3 = 0 THEN '2025-03-04' ELSE '{AS_OF}' END AS as_of,
        CASE n_nationkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'general' WHEN 2 THEN 'institution' ELSE 'all' END AS scope, CASE WHEN n_nationkey % 5 = 0 THEN 410 WHEN n_nationkey % 5 = 1 THEN 503 ELSE 200 END AS status FROM nation""",
)
def request_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of requests, cleaned and bounded, and requests that are refused; all on the driver, as their number is small."""
    out = []
    for k, name in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        given = {"q": f"  a \n b{k} ", "tag": "Low Income" if k % 2 == 0 else " ", "state": name, "limit": str(k * 20 - 100), "page": str(k), "minimumAward": f"{k * 100_000}.7" if k < 10 else str(k * 100_000)}
        given |= {"asOfDate": "2025-03-04" if k % 3 == 0 else "soon", "institutionScope": ("all", "general", "institution", "x")[k % 4], "all": "true" if k % 5 == 0 else "false"}
        p = search.parse_query(given, AS_OF)
        out.append((k, p.q, p.tag or "", p.state, p.limit, p.page, p.minimum_award, p.as_of, p.scope, search.refuse_bulk(given, k % 5 != 1) or 200))
    return spark.createDataFrame(out, "n_nationkey long, q string, tag string, state string, limit_ int, page int, award int, as_of string, scope string, status int")


@register("positive_count", "SELECT 'F' AS status, CAST(nullif(count(*), 0) AS VARCHAR) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT '-', coalesce(CAST(nullif(count(*), 0) AS VARCHAR), 'none') FROM orders WHERE o_orderstatus = '-'")
def positive_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    one = lambda status: lookup.counted(orders.where(F.col("o_orderstatus") == status)).select(F.lit(status).alias("status"), F.coalesce(F.col("n").cast("string"), F.lit("none")).alias("n"))
    return one("F").unionAll(one("-"))


@register("substring_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'version')")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(search.has_terms(F.lower("text"), "License version")).select("doc_id")


@register(
    "offset_page_total",
    """SELECT o_orderkey AS order_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total
       FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100""",
)
def offset_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select("o_orderdate", "o_orderkey")
    page = search.offset_page(matched, [F.col("o_orderdate"), F.col("o_orderkey")], 3, 50)
    return search.with_total(page.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").cast("string").alias("order_date")), matched, "total")


@register("window_total", "SELECT n_nationkey, n_name, count(*) OVER () AS matched_count FROM nation WHERE n_regionkey < 3")
def window_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").where("n_regionkey < 3").select("n_nationkey", "n_name")
    return search.with_total(rows, rows, "matched_count")


# --- submissions, sinks and sets ----------------------------------------------------------------------------------


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports made from ``orders``."""
    status = F.when(F.col("o_orderstatus") == "F", "open").when(F.col("o_orderstatus") == "O", "resolved").otherwise("new")
    issue = F.when(F.col("o_orderkey") % 9 == 0, " short ").otherwise(_clerk())
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 8 > 0, F.concat(F.lit("p"), "o_custkey")).alias("scholarship_id"), issue.alias("issue"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )


_GOOD_REPORT = "o_orderkey % 8 > 0 AND o_orderkey % 9 > 0 AND o_orderstatus IN ('F', 'O')"


@register("semi_published", f"SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE {_GOOD_REPORT} AND EXISTS (SELECT 1 FROM part WHERE p_partkey = o_custkey AND p_partkey % 17 > 0)")
def semi_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid reports on published records, appended to a table and read back."""
    path = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    sinks.append_reports(reports(spark, sf_dir), records(spark, sf_dir), path)
    return spark.read.schema(REPORT_DDL).parquet(path).select("id")


@register("report_errors", "SELECT CAST(o_orderkey AS VARCHAR) AS id, concat_ws(',', CASE WHEN o_orderkey % 8 = 0 THEN 'scholarship_id' END, CASE WHEN o_orderkey % 9 = 0 THEN 'issue' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END) AS errors FROM orders")
def report_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("id", F.array_join(validate.report_errors(), ",").alias("errors"))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions made from ``orders``: one in four names no record, some break a rule."""
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    optional = ("contributor_name", "degree_level", "field_of_study", "application_requirements", "application_url", "notes", "review_notes")
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"), F.when(key % 4 > 0, F.concat(F.lit("p"), "o_custkey")).alias("scholarship_id"), _clerk().alias("scholarship_title"), F.lit("P").alias("provider"),
        F.lit("winner").alias("relationship"), F.lit("L").alias("location"), F.when(key % 10 == 0, "Grade 99").otherwise("Grade 1").alias("grade"), F.lit("DACA recipient").alias("citizenship"), F.lit("S").alias("source_name"),
        F.when(key % 7 > 0, "https://a.org/x").alias("source_url"), F.when(F.col("o_orderstatus") == "P", "applied").otherwise("pending").alias("status"),
        F.lit(None).cast("decimal(12,2)").alias("award_amount"), F.lit(None).cast("decimal(12,2)").alias("maximum_income"), (key % 60 / 10).cast("decimal(3,2)").alias("minimum_gpa"), *(none.alias(c) for c in optional),
    )


_GOOD_CONTRIBUTION = "o_orderkey % 10 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 60 <= 50"


@register(
    "existence_or",
    f"SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE {_GOOD_CONTRIBUTION} AND o_orderstatus <> 'P' AND (o_orderkey % 4 = 0 OR EXISTS (SELECT 1 FROM part WHERE p_partkey = o_custkey AND p_partkey % 17 > 0))",
)
def existence_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid pending contributions that name no record or a published one, appended to a table and read back."""
    path = f"{shared_folder(spark)}/contributions-{uuid.uuid4().hex}"
    sinks.append_contributions(contributions(spark, sf_dir), records(spark, sf_dir), path)
    return spark.read.parquet(path).select("id")


@register(
    "contribution_errors",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, concat_ws(',', CASE WHEN o_orderkey % 60 > 50 THEN 'minimum_gpa' END, CASE WHEN o_orderkey % 10 = 0 THEN 'grade' END, CASE WHEN o_orderkey % 7 = 0 THEN 'no_url' END) AS errors FROM orders",
)
def contribution_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributions(spark, sf_dir).select("id", F.array_join(validate.contribution_errors(), ",").alias("errors"))


@register(
    "catalog_rejects",
    f"WITH {CATALOG} SELECT id, concat_ws(',', CASE WHEN seq % 6 = 0 THEN 'missing_title' END, CASE WHEN seq % 10 = 0 THEN 'missing_sourceUrl' END, CASE WHEN seq % 10 < 2 THEN 'invalid_sourceUrl' END) AS errors FROM catalog WHERE seq % 6 = 0 OR seq % 10 < 2",
)
def catalog_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that would stop a build, with what is wrong."""
    bad = F.when(F.col("seq") % 10 == 0, "").when(F.col("seq") % 10 == 1, "ftp://a.org").otherwise(F.col("sourceUrl"))
    rows = raw(spark, sf_dir).withColumns({"title": F.when(F.col("seq") % 6 != 0, F.col("title")), "sourceUrl": bad})
    return validate.split(rows, validate.catalog_errors())[1].select("id", F.array_join("errors", ",").alias("errors"))


@register("review_queue", f"WITH {CATALOG} SELECT CAST(o_orderkey AS VARCHAR) AS report, title, o_custkey AS part FROM orders JOIN catalog ON seq = o_custkey WHERE o_orderkey % 8 > 0 AND o_orderstatus = 'F'")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = lookup.review_queue(reports(spark, sf_dir).where("status = 'open'"), records(spark, sf_dir))
    return queue.select(F.col("id").alias("report"), "title", F.substring("scholarship_id", 2, 20).cast("long").alias("part"))


@register("membership_join", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT unnest([3, 5, 8, 13, 21, 9999]))")
def membership_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.range(2).select(F.array(*(F.lit(k).cast("long") for k in (3, 5, 8, 13, 21, 9999))).alias("ids"))
    return lookup.by_ids(table(spark, sf_dir, "supplier"), ids, "s_suppkey").select("s_suppkey", "s_name")


@register("anti_cleanup", "SELECT 'c' || c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    parents = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "published").otherwise("draft").alias("publication_status"))
    return projection.orphans(projected, parents)


@register("facet_counts", "SELECT lang, source, count(*) AS count, count(DISTINCT text) AS texts FROM documents GROUP BY lang, source HAVING count(*) >= 5")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("count"), F.count_distinct("text").alias("texts"))
    return facets.emitted(grouped)


@register("sorted_distinct_strings", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def sorted_distinct_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(S.sorted_distinct(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@register("upsert_batches", f"WITH {CATALOG} SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 100) + 1 AS INTEGER) AS batch FROM catalog")
def upsert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.batches_of(records(spark, sf_dir).select("id"))


@register(
    "published_table",
    f"WITH {CATALOG} SELECT id, CASE WHEN seq % 3 = 0 THEN 'Renamed' ELSE title END AS title, provider FROM catalog UNION ALL SELECT 'new' || seq, 'Renamed', NULL FROM catalog WHERE seq % 100 = 0",
)
def published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in its second version: rows merged by id, columns that the new rows lack unchanged."""
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    rows = records(spark, sf_dir).select("id", "title", "provider", "seq")
    sinks.upsert_table(rows.drop("seq"), path)
    changed = rows.where("seq % 3 = 0").select("id", F.lit("Renamed").alias("title")).unionAll(rows.where("seq % 100 = 0").select(F.concat(F.lit("new"), "seq"), F.lit("Renamed")))
    sinks.upsert_table(changed, path)
    return sinks.read_table(spark, path)


# --- editing and pruning ------------------------------------------------------------------------------------------


@register(
    "record_edit",
    f"""WITH {CATALOG} SELECT id, CASE WHEN id = 'p42' THEN 'New title' ELSE title END AS title, CASE WHEN id = 'p42' THEN 'a,b' ELSE kind || ',' || word END AS tags,
        CASE WHEN id = 'p42' THEN 'https://new.example.org/x ' || source_url ELSE '' END AS urls, CASE WHEN id = 'p42' THEN 'human Kim https://new.example.org/x' ELSE coalesce(vetting_status, '') END AS vetting FROM catalog""",
)
def record_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record edited by assignments and vetted by a person; all others stay."""
    rows = records(spark, sf_dir).withColumn("source_missing_fields", F.lit(None).cast(STRINGS))
    now = lookup.by_id(rows, "p42", False).first().asDict(recursive=True)
    now["source_urls"] = [now["source_url"]]
    _, changed = edit.edited(now, ["title=New title", "eligibility.tags=a | b", "source_url=https://new.example.org/x"], "Kim", now="2025-05-05T00:00:00")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    stamp = edit.vet_stamp("Kim", F.lit("2025-05-05").cast("timestamp"))
    named = changed["vetting"]
    values = {
        "title": F.lit(changed["title"]),
        "source_url": F.lit(changed["source_url"]),
        "source_urls": F.array(*map(F.lit, changed["source_urls"])),
        "search_text": F.lit(changed["search_text"]),
        "eligibility": F.col("eligibility").withField("tags", F.array(*map(F.lit, changed["eligibility"]["tags"]))),
        "vetting": F.struct(*(F.lit(named.get(f.name)).cast(f.dataType).alias(f.name) if not isinstance(named.get(f.name), list) else F.array().cast(f.dataType).alias(f.name) for f in kinds["vetting"].fields)),
        "source_checked_at": stamp["source_checked_at"],
    }
    after = edit.update_one(rows, "p42", values, yes=True)
    by = F.when(F.col("id") == "p42", F.lit(f" {named['vettedBy']} {named['checkedUrl']}")).otherwise("")
    return after.select("id", "title", F.array_join("eligibility.tags", ",").alias("tags"), F.coalesce(F.array_join("source_urls", " "), F.lit("")).alias("urls"), F.concat(S.text("vetting.status"), by).alias("vetting"))


@register("vet_stamp", f"WITH {CATALOG} SELECT id, CASE WHEN kind = 'promo' THEN 'human|Kim|' || source_url || '|2025-05-05|0' ELSE coalesce(vetting_status, '') || '||||' END AS stamp FROM catalog")
def vet_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many records vetted at once."""
    stamp = edit.vet_stamp("Kim", F.lit("2025-05-05 10:00:00").cast("timestamp"))
    rows, hit = records(spark, sf_dir), F.array_contains("eligibility.tags", "promo") & (F.element_at("eligibility.tags", 1) == "promo")
    vetting = stamp["vetting"]
    shown = F.concat_ws("|", vetting["status"], vetting["vettedBy"], vetting["checkedUrl"], stamp["source_checked_at"].cast("string"), F.size(stamp["source_missing_fields"]).cast("string"))
    return rows.select("id", F.when(hit, shown).otherwise(F.concat(S.text("vetting.status"), F.lit("||||"))).alias("stamp"))


@register(
    "completeness_rank",
    f"""WITH {CATALOG} SELECT id, CAST(row_number() OVER (PARTITION BY kind ORDER BY CASE vetting_status WHEN 'human' THEN 2 WHEN 'ai' THEN 1 ELSE 0 END DESC, CASE WHEN deadline IS NULL THEN 0 WHEN deadline >= DATE '{AS_OF}' THEN 2 ELSE 1 END DESC,
            CASE WHEN deadline IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN award_maximum IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN size BETWEEN 1 AND 12 THEN 1 ELSE 0 END DESC, CASE WHEN seq % 4 = 0 THEN 0 ELSE 1 END DESC, id) AS INTEGER) AS rank FROM catalog""",
)
def completeness_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a kind, the best one first."""
    order = Window.partitionBy(F.get("eligibility.tags", F.lit(0))).orderBy(*prune.survivor_order(F.lit(AS_OF)))
    return records(spark, sf_dir).select("id", F.row_number().over(order).alias("rank"))


_SAME = "provider || '|' || title"


@register(
    "prune_title",
    f"""WITH {CATALOG}, g AS (SELECT lower(replace(provider, '#', ' ')) || '|' || title AS key, count(*) AS n, count(*) FILTER (vetting_status = 'human') AS humans FROM catalog
        WHERE list_contains(string_split(title, ' '), 'ring') GROUP BY 1) SELECT key FROM g WHERE n >= 2 AND humans <= 1""",
)
def prune_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of the groups that a title chooses: every word of the query is in it."""
    plans, _ = prune.plan(records(spark, sf_dir), AS_OF, title="RING 2024")
    return plans.select("key")


@register(
    "prune_summary",
    f"""WITH {CATALOG}, s AS (SELECT *, count(*) OVER (PARTITION BY {_SAME}) AS n, count(*) FILTER (vetting_status = 'human') OVER (PARTITION BY {_SAME}) AS humans FROM catalog)
        SELECT CAST(count(DISTINCT {_SAME}) AS BIGINT) AS plans, CAST(count(*) - count(DISTINCT {_SAME}) AS BIGINT) AS deleted, CAST(count(*) AS BIGINT) AS urls FROM s WHERE n >= 2 AND humans <= 1""",
)
def prune_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer gets of all plans, counted."""
    rows = records(spark, sf_dir, dealt=True)
    brief = prune.summarize(prune.plan(rows, AS_OF)[0], rows)
    of = lambda array: F.coalesce(F.sum(F.size(array)), F.lit(0))
    return brief.agg(F.count("survivor.title").alias("plans"), of("delete").alias("deleted"), of("preservedSourceUrls").alias("urls"))


@register(
    "greedy_order",
    """WITH RECURSIVE rows AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) || ':' || hour(ts) AS a, event_type || ':' || CAST(floor(value / 5) AS INTEGER) AS b, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type = 'error'),
       fold AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS ids, []::VARCHAR[] AS prints, NULL::BIGINT AS seq, FALSE AS kept
                UNION ALL SELECT r.n, CASE WHEN list_contains(f.ids, r.a) OR list_contains(f.prints, r.b) THEN f.ids ELSE list_append(f.ids, r.a) END,
                          CASE WHEN list_contains(f.ids, r.a) OR list_contains(f.prints, r.b) THEN f.prints ELSE list_append(f.prints, r.b) END, r.seq, NOT (list_contains(f.ids, r.a) OR list_contains(f.prints, r.b))
                FROM fold f JOIN rows r ON r.n = f.n + 1)
       SELECT seq FROM fold WHERE kept""",
)
def greedy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which error events stay when each goes that shares a key with one before it that stayed."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    a = F.concat_ws(":", F.col("user_id").cast("string"), F.hour("ts").cast("string"))
    return dedupe.first_come(rows.select(F.col("event_id").alias("seq"), a.alias("a"), F.concat_ws(":", "event_type", F.floor(F.col("value") / 5).cast("int").cast("string")).alias("b"))).select("seq")
