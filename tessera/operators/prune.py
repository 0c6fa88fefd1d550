"""Duplicate pruning as two pure functions: ``plan`` chooses survivors, ``apply`` rewrites the tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.sources.shared import cut
from tessera.schema import ELIGIBILITY_ARRAYS, REQUIREMENTS


@dataclass(frozen=True)
class PruneOptions:
    title: str | None = None
    keep: str | None = None
    yes: bool = False
    all: bool = False


def parse_options(arguments: Sequence[str]) -> PruneOptions:
    """Command-line options with their guard rails."""
    values: dict = {}
    rest = iter(arguments)
    for a in rest:
        if a in ("--yes", "--all"):
            values[a[2:]] = True
        elif a in ("--title", "--keep"):
            values[a[2:]] = next(rest, None)
            if values[a[2:]] is None:
                raise ValueError(f"{a} needs a value")
        else:
            raise ValueError(f"unknown option {a}")
    options = PruneOptions(**values)
    if options.keep and not options.title:
        raise ValueError("--keep goes with --title")
    if options.yes and not (options.title or options.all):
        raise ValueError("--yes on everything needs --all too")
    return options


def _completeness() -> Column:
    return S.completeness(
        F.col("deadline"),
        S.text("description"),
        {"maximum": F.col("award.maximum"), "minimum": F.col("award.minimum")},
        [F.col(f"requirements.{r}") for r in REQUIREMENTS],
        [F.col(f"eligibility.{a}") for a in ELIGIBILITY_ARRAYS],
        [F.col("eligibility.minimumGpa"), F.col("eligibility.minimumAge")],
    )


def survivor_order(today: Column, ascending: bool = False) -> list[Column]:
    """Best record first: vetting, deadline, completeness, a direct application address, last checked, last updated, id; or values that are least for the best."""
    scores = [
        S.vetting_score("vetting.status"),
        S.deadline_score("deadline", today),
        _completeness(),
        S.direct_application("application_url", "source_url").cast("int"),
        F.coalesce(F.unix_date(F.col("source_checked_at").cast("date")), F.lit(0)),
        F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(0)),
    ]
    return [*(-s if ascending else s.desc() for s in scores), F.collate("id", "UNICODE"), F.col("id")]


def plan(records: DataFrame, today: str, title: str | None = None, keep: str | None = None, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(plans, skipped).

    Plans: key, survivor_id, duplicate_ids and source_urls sorted. Skipped: key, reason, ids in input order. Records of
    one duplicate key form a group; all must be compatible with its first record, and at most one vetted by a person.
    """
    keyed = records.withColumn("_pw", S.words("provider")).withColumn("_tw", S.words("title")).withColumn("key", S.duplicate_key(F.col("_pw"), F.col("_tw")))
    chosen = F.lit(True)
    if title:
        query = [w for w in _query_words(title)]
        chosen = (F.col("id") == title) | (F.size(F.array_except(F.array(*map(F.lit, query)).cast("array<string>"), F.col("_tw"))) == 0)
    # Scores count downwards, so that the best record is the least.
    *scores, name, own = survivor_order(F.lit(today), ascending=True)
    first = [(F.col("id") != keep).cast("int").alias("other")] if keep else []
    best = F.struct(*first, *(x.alias(f"s{k}") for k, x in enumerate(scores)), name.alias("name"), own.alias("id"))
    title_of = F.struct(S.url_key("application_url").alias("url"), F.col("_tw").alias("words"))
    urls = F.concat(F.array("source_url"), F.coalesce("source_urls", F.array().cast("array<string>")))
    # Records without a key list nothing, so their group goes below: a filter on the key would be pushed down and fold all words twice.
    of_key = lambda c: F.when(F.col("key").isNotNull(), c)
    # What is compared is in columns of its own: an expression over the sorted list would be sorted again for each member.
    groups = keyed.groupBy("key").agg(
        F.max(chosen.cast("int")).alias("chosen"),
        F.count_if(F.coalesce(F.col("vetting.status") == "human", F.lit(False))).alias("humans"),
        (F.max((F.col("id") == keep).cast("int")) == 1 if keep else F.lit(True)).alias("kept"),
        F.min(best)["id"].alias("survivor_id"),
        F.min_by(title_of, F.struct(F.col(seq).alias("seq"), "id")).alias("head"),
        F.collect_set(of_key(title_of)).alias("titles"),
        F.collect_list(of_key(F.struct(F.col(seq).alias("seq"), "id"))).alias("listed"),
        F.collect_list(of_key(urls)).alias("urls"),
    )
    groups = groups.where((F.size("listed") >= 2) & (F.col("chosen") == 1))
    head = F.col("head")
    fits = F.forall("titles", lambda t: S.compatible_titles(head["url"], head["words"], t["url"], t["words"]))
    groups = groups.withColumns({"compatible": fits, "source_urls": S.sorted_distinct(F.flatten("urls"))})
    ids = F.transform(F.sort_array("listed"), lambda x: x["id"])
    reason = F.when(~F.col("compatible"), "titles are too different to delete any without review").when(F.col("humans") > 1, "more than one record was vetted by a person")
    groups = groups.withColumn("ids", ids).withColumn("reason", reason)
    plans = groups.where("reason IS NULL AND kept").select("key", "survivor_id", F.filter("ids", lambda i: i != F.col("survivor_id")).alias("duplicate_ids"), "source_urls")
    return plans, groups.where("reason IS NOT NULL").select("key", "reason", "ids")


def _query_words(title: str) -> list[str]:
    import re
    import unicodedata

    flat = "".join(c for c in unicodedata.normalize("NFKD", title) if not unicodedata.category(c).startswith("M")).lower().replace("&", " and ")
    flat = re.sub(r"\b(?:19|20)\d{2}\b|\b(?:winter|autumn|fall|summer|spring)\b", " ", flat, flags=re.ASCII)
    return re.findall("[a-z0-9]+", flat)


def summarize(plans: DataFrame, records: DataFrame) -> DataFrame:
    """Plans with what a reviewer needs of each record."""
    brief = records.select("id", F.struct("id", "title", F.col("source_name").alias("source"), "deadline", F.coalesce("vetting.status", F.lit("unvetted")).alias("vetting")).alias("brief"))
    dropped = plans.select("key", F.posexplode("duplicate_ids").alias("pos", "id")).join(brief, "id")
    listed = dropped.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "brief"))), lambda x: x["brief"]).alias("delete"))
    survivor = brief.select(F.col("id").alias("survivor_id"), F.col("brief").alias("survivor"))
    return plans.join(survivor, "survivor_id").join(listed, "key").select("key", "survivor", "delete", F.col("source_urls").alias("preservedSourceUrls"))


def plan_totals(records: DataFrame, plans: DataFrame) -> DataFrame:
    """(scanned, duplicateGroups, recordsToDelete)."""
    deleted = F.coalesce(F.sum(F.size("duplicate_ids")), F.lit(0))
    return records.agg(F.count("*").alias("scanned")).crossJoin(plans.agg(F.count("*").alias("duplicateGroups"), deleted.alias("recordsToDelete")))


def checked(plans: DataFrame, records: DataFrame) -> DataFrame:
    """Plans as they can be applied; the query fails on one that names no duplicate or a record that isn't there."""
    clean = plans.withColumn("duplicate_ids", F.array_distinct(F.filter("duplicate_ids", lambda i: i != F.col("survivor_id"))))
    named = clean.select("survivor_id", F.explode(F.concat(F.array("survivor_id"), F.col("duplicate_ids"))).alias("id"))
    there = named.join(records.select("id", F.lit(1).alias("there")), "id", "left").groupBy("survivor_id").agg(F.count_if(F.col("there").isNull()).alias("lost"))
    joined = clean.join(there, "survivor_id")
    bad = F.when(F.size("duplicate_ids") == 0, "a plan names no duplicate").when(F.col("lost") > 0, "a plan names a record that doesn't exist")
    return joined.where(F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(": "), F.col("survivor_id"))).cast("boolean")).otherwise(True)).drop("lost")


def apply(records: DataFrame, reports: DataFrame, contributions: DataFrame, plans: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records, reports, contributions, result) after all plans: survivors have all addresses, references point to them, duplicates are gone."""
    # Plans are few against records and read four times below.
    plans = cut(checked(plans, records))
    mapping = plans.select(F.explode("duplicate_ids").alias("id"), "survivor_id")
    members = plans.select("survivor_id", "source_urls", F.explode(F.concat(F.array("survivor_id"), F.col("duplicate_ids"))).alias("id"))
    empty = F.array().cast("array<string>")
    own = members.join(records.select("id", F.concat(F.array("source_url"), F.coalesce(F.col("source_urls"), empty)).alias("own")), "id")
    union = own.groupBy("survivor_id").agg(F.array_union(F.flatten(F.collect_list("own")), F.coalesce(F.first("source_urls"), empty)).alias("urls"))
    merged = union.select(F.col("survivor_id").alias("id"), S.sorted_distinct("urls").alias("merged"))
    left = records.join(mapping.select("id"), "id", "left_anti").join(merged, "id", "left")
    updated = left.withColumns({"source_urls": F.coalesce("merged", "source_urls"), "updated_at": F.when(F.col("merged").isNotNull(), now).otherwise(F.col("updated_at"))})
    point = mapping.select(F.col("id").alias("scholarship_id"), "survivor_id")
    again = lambda df: df.join(point, "scholarship_id", "left").withColumn("scholarship_id", F.coalesce("survivor_id", "scholarship_id")).select(*df.columns)
    result = plans.join(merged.withColumnRenamed("id", "survivor_id"), "survivor_id").select(
        F.col("survivor_id").alias("survivorId"), F.size("duplicate_ids").alias("deleted"), F.col("duplicate_ids").alias("deletedIds"), F.col("merged").alias("sourceUrls")
    )
    return updated.select(*records.columns), again(reports), again(contributions), result
