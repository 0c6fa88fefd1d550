"""Shared pieces of the corpus operators: row identity, lineage cuts, names that never clash."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logical nodes above a Parquet scan through which its rows keep their places.
_PLAIN = {"Project", "Filter", "SubqueryAlias"}


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (column names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, which ``spark.checkpoint.dir`` names.

    Where neither that setting nor a folder of the context exists, a session without other machines (tests, a laptop)
    gets a temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    if (own := context._jsc.sc().getCheckpointDir()).isDefined():
        return own.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint, which survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Seconds that ``drop_unused`` waits at most for the JVM to hear of what Python has let go.
TOLD_S = 10


def drop_unused(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that nothing holds any more, which otherwise stay until the driver happens to collect its garbage."""
    gc.collect()
    # A thread of Py4J tells the JVM one by one, and rests for a second where there was nothing to tell.
    told, until = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ()), time.monotonic() + TOLD_S
    while told and time.monotonic() < until:
        time.sleep(0.05)
    spark.range(1).count()  # the context still holds the last job
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a Parquet table and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    numbered = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    numbered.write.parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path).toDF(*df.columns)


def _places(node) -> bool:
    """Whether a plan is one Parquet scan under projections and filters."""
    name = node.getClass().getSimpleName()
    if name in _PLAIN:
        return _places(node.children().apply(0))
    return name == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation" and node.relation().fileFormat().toString() == "Parquet"


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` with an identity per row, a struct (file, place) that is the same in every plan over the frame.

    ``file`` is the hash of a file's path and ``place`` the number of the row in that file, which Parquet itself knows; neither
    follows from file splits, so executors may come and go between plans. A frame that isn't a plain Parquet
    scan is written to the shared folder as a table first.
    """
    if not _places(df._jdf.queryExecution().analyzed()):
        df = stored(df)
    found = df.metadataColumn("_metadata")
    return df.withColumn(name, F.struct(F.xxhash64(found["file_path"]).alias("file"), found["row_index"].alias("place")))


#: Files whose numbers are sent to every worker.
BROADCAST_FILES = 1_000_000


def with_row_number(df: DataFrame, name: str) -> DataFrame:
    """As ``with_row_id``, with one long per row: the number of the row's file, then its place in 40 bits."""
    row = fresh(df, f"{name}_id")
    numbered = with_row_id(df, row)
    files = sorted(r["file"] for r in numbered.select(F.col(row)["file"].alias("file")).distinct().toLocalIterator())
    known = df.sparkSession.createDataFrame([(k, f) for k, f in enumerate(files)], "number long, file long")
    known = known.select(F.shiftleft("number", 40).alias(name), F.col("file").alias(f"{row}_file"))
    joined = numbered.join(F.broadcast(known) if len(files) <= BROADCAST_FILES else known, F.col(row)["file"] == F.col(f"{row}_file"))
    return joined.select(*(joined[c] for c in df.columns), (F.col(name) + F.col(row)["place"]).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
