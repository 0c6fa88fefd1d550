"""Finding single records."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_id(table: DataFrame, key: str, published_only: bool = True) -> DataFrame:
    rows = table.where(F.col("id") == key)
    return (rows.where(F.col("publication_status") == "published") if published_only else rows).limit(1)


def cascade(table: DataFrame, query: str, most: int = 20) -> DataFrame:
    """Records by id, else by title without case, else with the query in the title: only the first tier that has any."""
    cleaned = re.sub(r"\s+", " ", re.sub(r"[%*_,()]", " ", query)).strip().lower()
    title = F.lower("title")
    tier = F.when(F.col("id") == query, 1).when(title == query.lower(), 2).when(F.contains(title, F.lit(cleaned)), 3)
    tiered = table.withColumn("tier", tier).where("tier IS NOT NULL")
    best = tiered.agg(F.min("tier").alias("tier"))
    return tiered.join(F.broadcast(best), "tier").orderBy("id").limit(most)


def find_one(table: DataFrame, query: str):  # noqa: ANN201
    """The one record a query finds; ValueError for none or several."""
    rows = cascade(table, query).collect()
    if len(rows) != 1:
        raise ValueError(f"no record matches {query}" if not rows else "several records match:\n" + "\n".join(f"{r['id']}: {r['title']}" for r in rows))
    return rows[0]


def counted(table: DataFrame) -> DataFrame:
    """(n) the number of rows, null instead of 0."""
    return table.agg(F.nullif(F.count("*"), F.lit(0)).alias("n"))


def positive_count(table: DataFrame) -> int | None:
    return counted(table).first()["n"]


def by_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose ``key`` is in one of the arrays of ``ids``' only column, each once."""
    wanted = ids.select(F.explode(ids.columns[0]).alias(key)).distinct()
    return table.join(wanted, key, "left_semi")


def review_queue(reports: DataFrame, records: DataFrame) -> DataFrame:
    """Reports with what they are about, oldest first."""
    about = records.select(F.col("id").alias("scholarship_id"), "title", "provider")
    return reports.join(about, "scholarship_id").orderBy("created_at", "id")
