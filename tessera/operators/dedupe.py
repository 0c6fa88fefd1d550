"""Duplicates: the greedy two-key fold of an import, and grouping of near-identical titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.sources.shared import cut


def first_come(keys: DataFrame) -> DataFrame:
    """The rows (seq, a, b) that stay when each, in order, goes if one that stayed has its ``a`` or its ``b``.

    A row that is the first of all undecided ones with its ``a`` and with its ``b`` stays, and all others with either go. That decides
    a share of the rows at once, over again until none is left; a round is two partial aggregations and joins, whatever the groups' sizes.
    """
    left = cut(keys.select("seq", "a", "b"))
    kept: list[DataFrame] = []
    while not left.isEmpty():
        low = lambda c: left.groupBy(c).agg(F.min("seq").alias(f"first_{c}"))  # noqa: B023, E731
        stay = cut(left.join(low("a"), "a").where("seq = first_a").join(low("b"), "b").where("seq = first_b").select("seq", "a", "b"))
        kept.append(stay)
        left = cut(left.join(stay.select("a"), "a", "left_anti").join(stay.select("b"), "b", "left_anti").select("seq", "a", "b"))
    return reduce(DataFrame.unionAll, kept, keys.select("seq", "a", "b").limit(0))


def greedy_dedupe(df: DataFrame, id_col: str = "id", fingerprint: Column | None = None, seq: str = "seq") -> DataFrame:
    """``df`` with one row per kept record, whose ``sourceUrls`` has those of the rows folded into it, in input order.

    A row folds into the kept row of its id, else into that of its fingerprint. Order decides, see ``first_come``; rows
    without any shared key, the bulk, skip that.
    """
    key = S.plain_fingerprint("title", "provider", "applicationUrl", "sourceUrl") if fingerprint is None else fingerprint
    # Keys are texts; nulls are one value, as they are in a map.
    keys = cut(df.select(F.col(seq).alias("seq"), F.struct(F.col(id_col).alias("v")).alias("a"), F.struct(key.alias("v")).alias("b")))
    often = lambda c: keys.groupBy(c).agg(F.count("*").alias(f"n_{c}"))
    marked = cut(keys.join(often("a"), "a").join(often("b"), "b").select("seq", "a", "b", ((F.col("n_a") > 1) | (F.col("n_b") > 1)).alias("shared")))
    shared = marked.where("shared").select("seq", "a", "b")
    stay = cut(first_come(shared))
    by = lambda c: stay.select(c, F.col("seq").alias(f"kept_{c}"))
    found = shared.join(by("a"), "a", "left").join(by("b"), "b", "left")
    into = found.select("seq", F.when(F.col("kept_a") <= F.col("seq"), F.col("kept_a")).otherwise(F.col("kept_b")).alias("kept")).unionAll(marked.where("not shared").select("seq", F.col("seq").alias("kept")))
    own = df.select(F.col(seq).alias("seq"), F.coalesce("sourceUrls", F.array("sourceUrl")).alias("all"), F.array("sourceUrl").alias("one")).join(into, "seq")
    urls = F.when(F.col("seq") == F.col("kept"), F.col("all")).otherwise(F.col("one"))
    folded = own.groupBy("kept").agg(F.array_sort(F.collect_list(F.struct("seq", urls.alias("urls")))).alias("parts"))
    merged = folded.select(F.col("kept").alias(seq), F.array_distinct(F.flatten(F.transform("parts", lambda p: p["urls"]))).alias("merged"))
    return df.join(merged, seq).withColumn("sourceUrls", F.col("merged")).drop("merged").select(*df.columns, *([] if "sourceUrls" in df.columns else ["sourceUrls"]))


def representative_order(as_of: str, status: str | None = "programStatus", seq: str = "seq") -> list[Column]:
    """Open before closed, then by deadline, then by title in the order of a dictionary."""
    day = F.coalesce(F.nullif(F.col("deadline").cast("string"), F.lit("")), F.lit("9999-12-31"))
    return [S.closed("deadline", as_of, status), day, F.collate("title", "UNICODE"), F.col(seq)]


def group_similar(df: DataFrame, as_of: str, status: str | None = "programStatus", seq: str = "seq") -> DataFrame:
    """One row per provider and title key: its representative, with the addresses, count, ids and titles of all variants.

    A record without variants has null variant columns. One shuffle on the key; variants are narrow until the end.
    """
    keyed = df.withColumn("group_key", S.group_key("provider", "title"))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("group_key").orderBy(*representative_order(as_of, status, seq))))
    variant = F.struct("rank", "id", "title", F.coalesce("sourceUrls", F.array("sourceUrl")).alias("urls"))
    whole = Window.partitionBy("group_key")
    listed = ranked.withColumn("variants", F.array_sort(F.collect_list(variant).over(whole))).where("rank = 1")
    many = F.size("variants") > 1
    return listed.withColumns(
        {
            "sourceUrls": F.when(many, F.array_distinct(F.flatten(F.transform("variants", lambda v: v["urls"])))).otherwise(F.coalesce("sourceUrls", F.array("sourceUrl"))),
            "variantCount": F.when(many, F.size("variants")),
            "variantIds": F.when(many, F.transform("variants", lambda v: v["id"])),
            "variantTitles": F.when(many, F.transform("variants", lambda v: v["title"])),
        }
    ).drop("group_key", "rank", "variants")
