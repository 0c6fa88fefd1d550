"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of ``block_bytes`` bytes. The distinct blocks are sorted within buckets and ranked, so a name is
(bucket, rank) packed into one long; unlike a hash it can't collide. Names of adjacent blocks are then paired and the
distinct pairs named in the same way, halving the number of names a document has, until one is left. ``(blocks, name)``
is the identity.

Only distinct keys are named: copies of a block or a pair are folded where they lie, before they cross the network, so
a text with millions of copies is no burden to any one task. Blocks are sorted by their digest of 128 bits and find
their names by it, so their bytes cross the network once; that no two distinct blocks share a digest is
checked each time, and if any did, blocks would be sorted and matched by their bytes. All later rounds move longs only.
A document of b blocks takes ceil(log2 b) rounds and leaves as soon as it has one name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, fresh, with_row_id

BLOCK_BYTES = 4096
#: Buckets in which names are ranked: a rank has the other bits of a positive long.
BUCKET_BITS = 24


def digest(block: str) -> list[Column]:
    return [F.xxhash64(block), F.xxhash64(F.lit(1), block)]


def _names(distinct: DataFrame, *key: str) -> DataFrame:
    """(key, name) of distinct keys: their ranks within buckets of their hash."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*key))
    ranked = distinct.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(1 << BUCKET_BITS))).withColumn("rank", rank)
    return ranked.select(*key, F.shiftleft("bucket", 63 - BUCKET_BITS).bitwiseOR(F.col("rank").cast("long")).alias("name"))


def _block_names(pieces: DataFrame, of: Callable[[str], list[Column]]) -> DataFrame:
    """``pieces`` (row, id, blocks, left, pos, block) with the name of each block instead of its bytes."""
    hashes = [h.alias(f"d{k}") for k, h in enumerate(of("block"))]
    key = [f"d{k}" for k in range(len(hashes))]
    names = checkpoint(_names(pieces.select("block").distinct().select(*hashes), *key))
    rest = ("row", "id", "blocks", "left", "pos")
    if names.groupBy(*key).count().where("count > 1").isEmpty():
        return pieces.select(*rest, *hashes).join(names, key).select(*rest, "name")
    return pieces.join(_names(pieces.select("block").distinct(), "block"), "block").select(*rest, "name")


def identities(rows: DataFrame, block_bytes: int = BLOCK_BYTES, of: Callable[[str], list[Column]] = digest) -> DataFrame:
    """(row, id, blocks, name) for rows of (row, id, body): two bodies are equal exactly if (blocks, name) are.

    ``body`` is binary; a null body has no blocks and the name 0, an empty one has one empty block. ``of`` gives the
    columns of a block's digest.
    """
    count = F.when(F.col("body").isNull(), 0).otherwise(F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(block_bytes)))).cast("int")
    counted = rows.withColumn("blocks", count)
    absent = counted.where("blocks = 0").select("row", "id", "blocks", F.lit(0).cast("long").alias("name"))
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.substring("body", i * F.lit(block_bytes) + 1, F.lit(block_bytes)))
    pieces = counted.where("blocks > 0").select("row", "id", "blocks", F.col("blocks").alias("left"), F.posexplode(cut).alias("pos", "block"))
    named = checkpoint(_block_names(pieces, of))
    ended = [absent, named.where("left = 1").select("row", "id", "blocks", "name")]
    while not (open_ := named.where("left > 1")).isEmpty():
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = (
            open_.groupBy("row", "id", "blocks", "left", F.shiftright("pos", 1).alias("half"))
            .agg(side(0).alias("first"), F.coalesce(side(1), F.lit(-1)).alias("second"))
            .select("row", "id", "blocks", F.shiftright(F.col("left") + 1, 1).alias("left"), F.col("half").alias("pos"), "first", "second")
        )
        pairs = checkpoint(pairs)
        names = _names(pairs.select("first", "second").distinct(), "first", "second")
        named = checkpoint(pairs.join(names, ["first", "second"]).select("row", "id", "blocks", "left", "pos", "name"))
        ended.append(named.where("left = 1").select("row", "id", "blocks", "name"))
    return reduce(DataFrame.unionByName, ended)


def _copies(numbered: DataFrame, block_bytes: int, of: Callable[[str], list[Column]] = digest) -> DataFrame:
    """As ``copies``, for rows (row, id, body) with their identity."""
    found = identities(numbered, block_bytes, of)
    groups = found.groupBy("blocks", "name").agg(
        F.min("id").alias("keep_id"), F.count("*").alias("n_copies"), F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
    )
    return found.join(groups, ["blocks", "name"]).select("row", "id", "blocks", "name", "keep_id", "n_copies", (F.col("first.row") == F.col("row")).alias("is_kept"))


def _bodies(docs: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("body"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: (row, id, blocks, name, keep_id, n_copies, is_kept).

    Rows with equal texts form a group; ``keep_id`` is its least id and ``is_kept`` marks exactly one row,
    the first by (id, row), nulls last. Defined cases: null texts are a group of their own, apart from the
    empty text; repeated rows and repeated ids are rows like any other, so one of them is kept; long texts
    are cut into more blocks; an empty table gives an empty result; other columns of ``docs`` are ignored,
    whatever their names.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _copies(_bodies(with_row_id(narrow, "row"), "row", "id", "text"), block_bytes)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without all but one row of each group of equal texts; columns and their order stay.

    Cases as in ``copies``.
    """
    row = fresh(docs, "row")
    numbered = with_row_id(docs, row)
    dropped = _copies(_bodies(numbered, row, id_col, text_col), block_bytes).where("not is_kept").select(F.col("row").alias(row))
    return numbered.join(dropped, row, "left_anti").drop(row)
