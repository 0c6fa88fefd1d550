"""The search projection as a stream: each batch of changes rewrites only the parts of the stored projection that it touches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import projection
from tessera.sources import sinks

#: Parts of a stored projection, by hash of the id; a table keeps the number it was made with.
PARTS = 64


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")


def apply_batch(changes: DataFrame, path: str, parts: int = PARTS) -> None:
    """Merges one batch (op, seq and the record's columns). Doing it twice gives the same table, so a replay is harmless.

    Rows lie in parts by hash of their id. The parts of the batch's ids are read, merged and written anew; all others stay
    in the folders they are in, and the list of folders is replaced at once.
    """
    spark = changes.sparkSession
    order = [F.col("seq").desc()]
    current = sinks.parts_of(spark, path) or {}
    parts = int(current.get("parts", parts))
    changes = changes.persist()
    try:
        touched = sorted(r["part"] for r in changes.select(_part(parts).alias("part")).distinct().collect())
        folders = [f"{path}/{current[str(k)]}" for k in touched if str(k) in current]
        if folders:
            after = projection.synchronise(spark.read.parquet(*folders), changes, order)
        else:
            after = projection.project(projection.latest(changes, "id", order).where("op <> 'D'"))
        version = f"v-{uuid.uuid4().hex}"
        after.withColumn("part", _part(parts)).repartition("part").write.partitionBy("part").parquet(f"{path}/{version}")
    finally:
        changes.unpersist()
    fs, _, make = sinks._files(spark, path)
    left = {k: v for k, v in current.items() if k != "parts" and int(k) not in touched}
    written = {str(k): f"{version}/part={k}" for k in touched if fs.exists(make(f"{path}/{version}/part={k}"))}
    sinks.point_to(spark, path, {"parts": str(parts), **left, **written})


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored projection; empty before the first batch."""
    folders = [f"{path}/{v}" for k, v in sorted((sinks.parts_of(spark, path) or {}).items()) if k != "parts"]
    if folders:
        return spark.read.parquet(*folders)
    from tessera.schema import PUBLISHED_DDL

    return projection.project(spark.createDataFrame([], PUBLISHED_DDL))


def start(spark: SparkSession, changes: str, schema: str, path: str, checkpoint: str) -> StreamingQuery:
    """Reads change files as they arrive and keeps the projection at ``path`` up to date; ends when all there are done."""
    stream = spark.readStream.schema(schema).json(changes)
    writer = stream.writeStream.foreachBatch(lambda batch, _: apply_batch(batch, path)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
