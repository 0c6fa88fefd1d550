"""Sinks: tables that change from one whole version to the next, append-only tables, and upserts.

A table is a folder of versions and a small file that lists the parts of the current one. A new version is complete before
the file is replaced, in one rename over it, so readers see the old table or the new one at every moment; nothing is copied on stores
where renaming a folder means copying it. The version before stays for readers that have just begun.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import facets, projection, validate

POINTER = "current.json"
ATTEMPTS = 8


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm.org.apache.hadoop.fs.Path


def parts_of(spark: SparkSession, path: str) -> dict[str, str] | None:
    """Folders of the current version by the name of the part; a table written as a whole has one part. None if there is no table."""
    fs, _, make = _files(spark, path)
    if not fs.exists(make(f"{path}/{POINTER}")):
        return None
    stream = fs.open(make(f"{path}/{POINTER}"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def table_exists(spark: SparkSession, path: str) -> bool:
    return parts_of(spark, path) is not None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table of this module."""
    parts = parts_of(spark, path)
    if parts is None:
        raise FileNotFoundError(f"{path} holds no table")
    return spark.read.parquet(*(f"{path}/{folder}" for folder in sorted(set(parts.values()))))


def _replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file beside ``path`` and renames it over it; a store that is busy is asked again, each time after a longer pause."""
    jvm = spark.sparkContext._jvm
    fs, target, make = _files(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fresh = make(f"{path}.{uuid.uuid4().hex}")
    for attempt in range(ATTEMPTS):
        try:
            out = fs.create(fresh, True)
            out.write(bytearray(text.encode()))
            out.close()
            context.rename(fresh, target, over)
            return
        except Exception:
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(0.1 * (attempt + 1))


def point_to(spark: SparkSession, path: str, parts: dict[str, str]) -> None:
    """Makes ``parts`` the table at ``path``, and removes versions that neither it nor the table before it has."""
    before = parts_of(spark, path) or {}
    _replace_file(spark, f"{path}/{POINTER}", json.dumps(parts))
    fs, target, _ = _files(spark, path)
    used = {folder.split("/")[0] for folder in (*before.values(), *parts.values())}
    for status in fs.listStatus(target):
        if status.isDirectory() and status.getPath().getName().startswith("v-") and status.getPath().getName() not in used:
            fs.delete(status.getPath(), True)


def replace_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Makes ``df``, which may read the table itself, the whole table at ``path``."""
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{version}")
    point_to(df.sparkSession, path, {"all": version})


def write_chunks(df: DataFrame, path: str, order: list[Column], size: int, name: str, *keep: str | Column) -> None:
    """One folder per chunk of ``size`` rows in order: search shards, directory pages, sitemap files. ``keep``: columns that are written."""
    chunks = facets.in_chunks(df, order, size, name)
    replace_table((chunks.select(name, *keep) if keep else chunks).repartition(name), path, name)


def append_reports(reports: DataFrame, published: DataFrame, path: str) -> None:
    validate.submission(reports, published).write.mode("append").parquet(path)


def append_contributions(contributions: DataFrame, published: DataFrame, path: str) -> None:
    validate.contribution_submission(contributions, published).write.mode("append").parquet(path)


def upsert_table(rows: DataFrame, path: str, key: str = "id") -> None:
    """Merges rows into the table at ``path`` by key, columns that rows lack unchanged."""
    spark = rows.sparkSession
    replace_table(projection.upsert(read_table(spark, path), rows, key) if table_exists(spark, path) else rows, path)


def merge_statement(table: str, source: str, columns: list[str], key: str = "id") -> str:
    """The same upsert for a table format with MERGE."""
    sets = ", ".join(f"t.{c} = s.{c}" for c in columns if c != key)
    return f"MERGE INTO {table} t USING {source} s ON t.{key} = s.{key} WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({', '.join('s.' + c for c in columns)})"


def batches_of(df: DataFrame, size: int = 100, name: str = "batch") -> DataFrame:
    """Rows with the number of their batch by id, for receivers that take ``size`` rows at a time."""
    return facets.in_chunks(df, [F.col("id")], size, name)
