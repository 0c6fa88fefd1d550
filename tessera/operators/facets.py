"""Facets, counts and small published outputs of a catalog."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import vocab
from tessera.operators.dedupe import representative_order
from tessera.sources.shared import cut

CATEGORIES: dict[str, tuple[tuple[str, ...], str | None]] = {
    "international-students": (("international-students",), None),
    **{f"international-students/{t}": (("international-students", t), None) for t in ("no-essay", "stem", "women")},
    "international-students/graduate": (("international-students",), "graduate"),
}
PAGE, FIRST_PAGE, FIRST_SUMMARIES, SHARD, SITEMAP = 100, 200, 30, 500, 10_000


def distinct_values(df: DataFrame, array: str) -> DataFrame:
    """(value) of all arrays, once each, in dictionary order."""
    return df.select(F.explode(array).alias("value")).distinct().orderBy(F.collate("value", "UNICODE"))


def grade_facet(df: DataFrame, array: str = "eligibility.grades") -> DataFrame:
    """(value, place) of the canonical grades that occur, in canonical order; those of elementary school as one, K-8."""
    order = df.sparkSession.createDataFrame([(g, "K-8" if g in vocab.ELEMENTARY else g, i) for i, g in enumerate(vocab.GRADES)], "grade string, value string, place int")
    found = df.select(F.explode(array).alias("grade")).distinct()
    return found.join(F.broadcast(order), "grade").groupBy("value").agg(F.min("place").alias("place")).orderBy("place")


def static_facets(tag_ids: Iterable[str]) -> dict[str, list[str]]:
    return {"tagOptions": list(tag_ids), "states": sorted(vocab.STATES.values())}


def category_predicate(tags: Iterable[str], level: str | None) -> Column:
    tests = [F.coalesce(F.array_contains("eligibility.tags", t), F.lit(False)) for t in tags]
    if level:
        tests.append(F.coalesce(F.exists("eligibility.degreeLevels", lambda x: F.contains(F.lower(x), F.lit(level))), F.lit(False)))
    return reduce(Column.__and__, tests)


def category_counts(grouped: DataFrame, as_of: str, categories: Mapping[str, tuple[tuple[str, ...], str | None]] = CATEGORIES) -> DataFrame:
    """(category, count) over open groups, all categories in one pass."""
    counts = [F.count_if(category_predicate(*c)).alias(f"c{i}") for i, c in enumerate(categories.values())]
    one = grouped.where(~S.closed("deadline", as_of, "programStatus")).agg(*counts)
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("category"), F.col(f"c{i}").alias("count")) for i, name in enumerate(categories)))).alias("x")).select("x.*")


def emitted(counts: DataFrame, least: int = 5) -> DataFrame:
    """Categories with enough records to be listed."""
    return counts.where(F.col("count") >= least)


def totals(catalog: DataFrame, grouped: DataFrame, as_of: str, discovered: int = 0) -> DataFrame:
    """One row of catalog metadata: counts, pages, shards, sources (a missing source counts as one)."""
    rows = catalog.agg(F.count("*").alias("count"), (F.count_distinct("sourceName") + F.coalesce(F.max(F.col("sourceName").isNull().cast("int")), F.lit(0))).alias("sourceCount"))
    groups = grouped.agg(F.count("*").alias("directoryCount"), F.count_if(~S.closed("deadline", as_of, "programStatus")).alias("activeDirectoryCount"))
    return rows.crossJoin(groups).withColumns(
        {
            "directoryPageSize": F.lit(PAGE),
            "directoryPageCount": F.ceil(F.col("directoryCount") / PAGE),
            "searchShardSize": F.lit(SHARD),
            "searchShardCount": F.ceil(F.col("count") / SHARD),
            "discoveredCount": F.greatest("count", F.lit(discovered)),
            "generatedOn": F.lit(as_of),
        }
    )


def top_per_tag(grouped: DataFrame, tags: DataFrame, as_of: str, k: int = 4, seq: str = "seq") -> DataFrame:
    """(tag, place, id) of the first ``k`` open groups of each tag of ``tags`` (value); a tag without any has a null id."""
    open_ = grouped.where(~S.closed("deadline", as_of, "programStatus"))
    order = representative_order(as_of, "programStatus", seq)
    narrow = open_.select("id", F.explode(F.array_distinct("eligibility.tags")).alias("tag"), *(o.alias(f"o{i}") for i, o in enumerate(order)))
    place = F.row_number().over(Window.partitionBy("tag").orderBy(*(f"o{i}" for i in range(len(order)))))
    best = narrow.withColumn("place", place).where(F.col("place") <= k).select("tag", "place", "id")
    return tags.select(F.col("value").alias("tag")).join(best, "tag", "left")


def related(record_tags: DataFrame, top: DataFrame, k: int = 3) -> DataFrame:
    """(source_id, place, id): for rows (source_id, tags) the lists of their tags in order, themselves left out, each once, ``k`` at most."""
    lists = top.where("id IS NOT NULL").groupBy("tag").agg(F.collect_list(F.struct("place", "id")).alias("listed"))
    # Dealt out by record first: a list for each tag is all that is joined, and a record's tags are gathered where they are, in parts of bounded size.
    tags = record_tags.repartition("source_id").select("source_id", F.posexplode("tags").alias("tag_pos", "tag"))
    whole = tags.join(F.broadcast(lists), "tag").groupBy("source_id").agg(F.collect_list(F.struct("tag_pos", "listed")).alias("all"))
    one = F.flatten(F.transform("all", lambda t: F.transform(t["listed"], lambda x: F.struct(t["tag_pos"], x["place"], x["id"]))))
    first = F.array_distinct(F.transform(F.sort_array(one), lambda x: x["id"]))
    others = F.slice(F.filter(first, lambda i: i != F.col("source_id")), 1, k)
    return whole.select("source_id", F.posexplode(others).alias("place", "id")).select("source_id", (F.col("place") + 1).alias("place"), "id")


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """``df`` with places from 1 in a global order, without a window over everything in one task.

    The rows are range-partitioned and sorted; a partition's start is the number of rows before it, from one count
    per partition.
    """
    keys = {f"_o{i}": o for i, o in enumerate(order)}
    spread = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranked = cut(spread.withColumn("_id", F.monotonically_increasing_id()))
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    starts = sizes.withColumn("_start", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    joined = ranked.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, within + F.coalesce("_start", F.lit(0)) + 1).select(*df.columns, name)


def in_chunks(df: DataFrame, order: list[Column], size: int, name: str) -> DataFrame:
    """``df`` with the number of its chunk of ``size`` rows, from 1, in a global order: shards, pages, sitemap files."""
    return numbered(df, order, "_n").withColumn(name, (F.floor((F.col("_n") - 1) / size) + 1).cast("int")).drop("_n")


def first_pages(grouped: DataFrame, as_of: str, raw_total: int, active_total: int, total: int, seq: str = "seq") -> tuple[tuple[DataFrame, dict], tuple[DataFrame, dict]]:
    """The two prepared first pages with their figures: 200 groups, and 30 open summaries."""
    from tessera.operators.normalize import summary_columns

    order = representative_order(as_of, "programStatus", seq)
    full = grouped.orderBy(*order).limit(FIRST_PAGE)
    brief = grouped.where(~S.closed("deadline", as_of, "programStatus")).orderBy(*order).limit(FIRST_SUMMARIES).select(*summary_columns())
    figures = {"total": active_total, "rawTotal": raw_total}
    return (
        (full, {**figures, "page": -(-FIRST_PAGE // PAGE), "limit": PAGE, "hasMore": total > FIRST_PAGE}),
        (brief, {**figures, "page": 1, "limit": FIRST_SUMMARIES, "hasMore": active_total > FIRST_SUMMARIES}),
    )


def status_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("publication_status").agg(F.count("*").alias("count"))
