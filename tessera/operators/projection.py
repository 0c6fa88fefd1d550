"""The narrow search projection of published records, recomputed or kept up to date by change batches; upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fts
from tessera.functions import scalars as S

PROJECTED = "id deadline deadline_key search_document eligibility award_maximum institution_specific vetting_status".split()


def project(records: DataFrame) -> DataFrame:
    """What a search filters on, of published records."""
    return records.where(F.col("publication_status") == "published").select(
        "id",
        "deadline",
        S.deadline_key("deadline").alias("deadline_key"),
        fts.analyse(S.text("search_text")).alias("search_document"),
        "eligibility",
        F.col("award.maximum").alias("award_maximum"),
        "institution_specific",
        F.coalesce("vetting.status", F.lit("unvetted")).alias("vetting_status"),
    )


def latest(changes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last change of each key."""
    return changes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(table: DataFrame, rows: DataFrame, key: str = "id", order: list[Column] | None = None) -> DataFrame:
    """``table`` with ``rows`` merged in by key; columns that ``rows`` doesn't have keep their values."""
    new = latest(rows, key, order) if order else rows
    brought = [c for c in new.columns if c != key and c in table.columns]
    there = new.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in brought))
    joined = table.join(there, key, "full_outer")
    keep = [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in brought else F.col(c) for c in table.columns]
    return joined.select(*keep)


def synchronise(projection: DataFrame, changes: DataFrame, order: list[Column]) -> DataFrame:
    """``projection`` after changes (op I, U or D, and the record): deleted and no longer published records leave, others replace."""
    last = latest(changes, "id", order)
    fresh = project(last.where("op <> 'D'"))
    return projection.join(last.select("id"), "id", "left_anti").select(*PROJECTED).unionByName(fresh.select(*PROJECTED))


def orphans(projection: DataFrame, records: DataFrame) -> DataFrame:
    """Projected ids without a published record, which a clean-up removes."""
    return projection.join(records.where(F.col("publication_status") == "published").select("id"), "id", "left_anti").select("id")


def visible(records: DataFrame) -> DataFrame:
    """What the public may read."""
    return records.where(F.col("publication_status") == "published")
