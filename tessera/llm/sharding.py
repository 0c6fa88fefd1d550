"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Differencing keeps partial partitions: for each of k parts a sum and the groups in it. The two of largest spread are
combined, the heaviest part of one with the lightest of the other, until one partition is left.

That is a heap algorithm over all groups; here it runs as a tree. Groups are spread over nodes of at most about
``NODE_GROUPS`` groups by hash and each node is differenced by itself. What leaves a node is again a partial partition,
k sums, and up to ``NODE_FAN`` of them are differenced in one task into one, and so on up to a single one. A partition
into very many shards is reached in levels of at most ``FAN_OUT`` parts, each part of a level divided by itself.
No task holds more than its node; the driver holds counts only.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint

SHARD_BYTES = 128 * 1024 * 1024
MIN_SHARDS = 8
FAN_OUT = 256
NODE_GROUPS = 20_000
NODE_FAN = 64


def difference(partitions: list[list[int]]) -> list[list[int]]:
    """Differencing of partial partitions, each a list of k sums: for each of k parts the places of what it got.

    Place i * k + j stands for the j-th sum of the i-th partition. Ties go to the earlier partition.
    """
    if not partitions:
        return []
    k = len(partitions[0])
    trees: list[tuple[int, int]] = []
    heap: list[tuple[int, int, list[int], list[int]]] = []
    leaves = len(partitions) * k
    for i, sums in enumerate(partitions):
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        held = [sums[j] for j in order]
        heap.append((held[-1] - held[0], i, held, [i * k + j if sums[j] else ~(i * k + j) for j in order]))
    heapq.heapify(heap)
    fresh = len(partitions)
    while len(heap) > 1:
        _, _, one, own = heapq.heappop(heap)
        _, _, two, others = heapq.heappop(heap)
        merged = []
        for a, b, x, y in zip(one, reversed(two), own, reversed(others)):
            trees.append((x, y))
            merged.append((a + b, leaves + len(trees) - 1))
        merged.sort(key=lambda m: -m[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], fresh, [m[0] for m in merged], [m[1] for m in merged]))
        fresh += 1
    found = []
    for root in heap[0][3]:
        stack, places = [root], []
        while stack:
            x = stack.pop()
            if x >= leaves:
                stack.extend(trees[x - leaves])
            else:
                places.append(x if x >= 0 else ~x)
        found.append(places)
    return found


def _nodes(groups: DataFrame, parts: int) -> DataFrame:
    """(part, node, group, slot) of groups (part, node, group, bytes), every node differenced into ``parts`` slots."""
    kind = dict(groups.dtypes)["group"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True], kind="stable", ignore_index=True)
        slots = [0] * len(pdf)
        for slot, places in enumerate(difference([[int(b)] + [0] * (parts - 1) for b in pdf["bytes"]])):
            for place in places:
                if place % parts == 0:
                    slots[place // parts] = slot
        return pdf[["part", "node", "group"]].assign(slot=slots)

    return groups.groupBy("part", "node").applyInPandas(run, f"part long, node long, group {kind}, slot int")


def _combined(sums: DataFrame, parts: int) -> DataFrame:
    """(part, node, slot, above, next) of sums (part, node, slot, bytes): nodes under one above become one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="node", columns="slot", values="bytes").reindex(columns=range(parts)).fillna(0).astype("int64").sort_index()
        rows = []
        for slot, places in enumerate(difference(wide.to_numpy().tolist())):
            rows.extend((int(wide.index[p // parts]), p % parts, slot) for p in places)
        out = pd.DataFrame(rows, columns=["node", "slot", "next"])
        return out.assign(part=pdf["part"].iloc[0], above=pdf["above"].iloc[0])[["part", "node", "slot", "above", "next"]]

    above = sums.withColumn("above", F.floor(F.col("node") / NODE_FAN).cast("long"))
    return above.groupBy("part", "above").applyInPandas(run, "part long, node long, slot int, above long, next int")


def _divided(groups: DataFrame, parts: int, level: int, node_groups: int) -> DataFrame:
    """``groups`` (part, group, bytes) with each part divided into ``parts``, so that part p becomes p * parts + slot."""
    most = groups.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    nodes = max(1, math.ceil(most / node_groups))
    spread = groups.withColumn("node", F.pmod(F.xxhash64("group", F.lit(level)), F.lit(nodes)))
    placed = checkpoint(_nodes(spread, parts).join(groups.select("group", "bytes"), "group"))
    way = placed.groupBy("part", "node", "slot").agg(F.sum("bytes").alias("bytes")).withColumn("last", F.col("node")).withColumn("next", F.col("slot"))
    while nodes > 1:
        sums = way.groupBy("part", F.col("last").alias("node"), F.col("next").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        step = _combined(sums, parts).select("part", F.col("node").alias("last"), F.col("slot").alias("next"), F.col("above"), F.col("next").alias("then"))
        way = checkpoint(way.join(step, ["part", "last", "next"]).select("part", "node", "slot", "bytes", F.col("above").alias("last"), F.col("then").alias("next")))
        nodes = math.ceil(nodes / NODE_FAN)
    found = placed.drop("bytes").join(way.select("part", "node", "slot", "next"), ["part", "node", "slot"])
    return found.join(groups.select("group", "bytes"), "group").select((F.col("part") * parts + F.col("next")).alias("part"), "group", "bytes")


def assign_groups(groups: DataFrame, shards: int, fan_out: int = FAN_OUT, node_groups: int = NODE_GROUPS) -> DataFrame:
    """(group, bytes, shard) for distinct groups (group, bytes): at least ``shards`` shards, numbered from 0.

    Beyond ``fan_out`` shards their number is rounded up to a product of equal factors.
    """
    levels = 1
    while fan_out**levels < shards:
        levels += 1
    parts = math.ceil(round(shards ** (1 / levels), 9))
    current = groups.select(F.lit(0).cast("long").alias("part"), "group", F.coalesce(F.col("bytes"), F.lit(0)).cast("long").alias("bytes"))
    for level in range(levels):
        current = checkpoint(_divided(current, parts, level, node_groups))
    return current.select("group", "bytes", F.col("part").alias("shard"))


def shard(
    docs: DataFrame, group: Column | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, min_shards: int = MIN_SHARDS
) -> DataFrame:
    """Rows (doc_id, group, bytes, shard): all rows of one group share a shard and shards have nearly equal bytes.

    ``group`` defaults to the 64-bit hash of the text, which keeps copies of a document together (two texts of one
    hash would merely stay together too). ``bytes`` is the UTF-8 length of a row's text.

    Defined cases: a null or empty text weighs 0 bytes; null groups form one group; repeated rows stay rows of their
    group; a group heavier than a shard has the shard it leads to itself; ties in weight go by group; an empty table gives
    no rows; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.xxhash64(text) if group is None else group).alias("group"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    hashed = rows.select("doc_id", F.xxhash64("group", F.col("group").isNull()).alias("key"), "group", "bytes")
    groups = checkpoint(hashed.groupBy("key").agg(F.sum("bytes").alias("bytes")).withColumnRenamed("key", "group"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    found = assign_groups(groups, max(min_shards, math.ceil(total / shard_bytes)))
    return hashed.join(found.select(F.col("group").alias("key"), "shard"), "key").select("doc_id", "group", "bytes", "shard")
