"""Scans: catalog files with explicit schemas, optional line files, tables read in parts, and driver tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import ENRICHMENT_DDL, OVERLAY_DDL, RAW_DDL


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by a unique key: a small file of many rows is one or two splits, which would leave most cores idle in what follows."""
    return df.repartition(key)


def _piece(value: str, inside: int) -> tuple[int, int]:
    """(whether the end of a piece lies in a text, braces opened outside texts), given whether its start does."""
    runs = re.sub(r"\\.", "", value, flags=re.DOTALL).split('"')
    return (inside + len(runs) - 1) & 1, sum(r.count("{") for r in runs[inside::2])


def _summaries(frames):  # noqa: ANN001, ANN202
    """For each part of a file and each state of its start: the state of its end, its change of depth and its least depth."""
    found: dict = {}
    for frame in frames:
        for part, value in zip(frame["part"], frame["value"], strict=True):
            for state in found.setdefault(part, [[0, 0, 0], [1, 0, 0]]):
                state[0], opened = _piece(value, state[0])
                state[1] += opened - (state[0] == 0)
                state[2] = min(state[2], state[1])
    yield pd.DataFrame([(p, i, *s) for p, both in found.items() for i, s in enumerate(both)], columns=["part", "inside", "after", "change", "least"])


def _texts(starts: dict, path: str):  # noqa: ANN202
    """Texts of records by the part they begin in and their number there (-1 in later parts); those that go on in another part come in pieces."""

    def run(frames):  # noqa: ANN001, ANN202
        part, held, rows = None, [], []
        inside = depth = head = number = 0
        row = lambda whole: (head, number if head == part else -1, part, whole and head == part, "".join(held))
        for frame in frames:
            for at, value in zip(frame["part"], frame["value"], strict=True):
                if at != part:
                    if held:
                        rows.append(row(False))
                    part, held, number = at, [], 0
                    inside, depth, head = starts[at]
                inside, opened = _piece(value, inside)
                depth += opened - (inside == 0)
                held += (value, "}")
                if depth < 0:
                    if not re.fullmatch(r"\s*\]\s*" if at or number else r"\s*(\[\s*)?\]\s*", value):
                        raise ValueError(f"{path} is no JSON array")
                    held = []
                elif depth == 0 and inside == 0:
                    rows.append(row(True))
                    number = number + 1 if head == at else 0
                    head, held = at, []
            yield pd.DataFrame(rows, columns=["head", "no", "part", "whole", "text"])
            rows = []
        if held:
            yield pd.DataFrame([row(False)], columns=["head", "no", "part", "whole", "text"])

    return run


def json_array(spark: SparkSession, path: str, ddl: str = RAW_DDL) -> DataFrame:
    """A file that is one JSON array of records; anything else fails the query. No task holds more than a batch of its part of the file.

    The file is cut at closing braces, which no escape holds. Quotes tell whether a cut lies in a text, braces outside texts how deep it lies; a record
    ends where the depth is 0 again. One pass sums both for each part of the file, another takes records apart by the sums of the parts before.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_block_start").alias("part"), "value")
    sums = {(r["part"], r["inside"]): r for r in pieces.mapInPandas(_summaries, "part long, inside int, after int, change long, least long").collect()}
    starts, inside, depth, head = {}, 0, 0, 0
    for part in sorted({p for p, _ in sums}):
        head = head if depth > 0 else part
        starts[part] = (inside, depth, head)
        r = sums[part, inside]
        head = part if depth + r["least"] <= 0 else head
        inside, depth = r["after"], depth + r["change"]
    # The piece after the last record isn't closed.
    if (inside, depth) != (0, -1):
        raise ValueError(f"{path} is no JSON array")
    texts = pieces.mapInPandas(_texts(starts, path), "head long, no long, part long, whole boolean, text string")
    joined = texts.where("NOT whole").groupBy("head").agg(F.max("no").alias("no"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"))
    # A part has fewer records than bytes, so places grow from part to part.
    rows = texts.where("whole").select("head", "no", "text").unionAll(joined).select((F.col("head") + F.col("no")).alias("seq"), "text")
    lead = F.regexp_extract("text", r"^\s*[\[,]\s*(?=\{)", 0)
    good = F.trim(F.regexp_replace(lead, r"\s", "")) == F.when(F.col("seq") == 0, "[").otherwise(",")
    checked = rows.where(F.when(good, True).otherwise(F.raise_error(F.lit(f"{path} is no JSON array")).cast("boolean")))
    body = F.substr("text", F.length(lead) + 1)
    return checked.select("seq", F.from_json(body, f"struct<{_struct(ddl)}>", {"mode": "FAILFAST"}).alias("r")).select("seq", "r.*")


def _struct(ddl: str) -> str:
    """``a t, b u`` as the inside of a struct type."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            parts.append(f"{name}:{kind.strip()}")
            start = i + 1
    return ",".join(parts)


def json_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A JSON-lines file in its own order; a missing one is empty, blank lines are skipped, bad ones fail the query."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"seq long, {ddl}")
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path).select(F.monotonically_increasing_id().alias("seq"), "*")


def imported_lines(spark: SparkSession, root: str, ddl: str = RAW_DDL) -> DataFrame:
    """All ``records.jsonl`` in folders below ``root`` (not in ``root`` itself) with ``file`` and ``seq``; a missing root is empty."""
    if not _exists(spark, root):
        return spark.createDataFrame([], f"seq long, file string, {ddl}")
    reader = spark.read.schema(ddl).option("recursiveFileLookup", True).option("pathGlobFilter", "records.jsonl").option("mode", "FAILFAST")
    direct = f"{root.rstrip('/')}/records.jsonl"
    rows = reader.json(root).select(F.monotonically_increasing_id().alias("seq"), F.col("_metadata.file_path").alias("file"), "*")
    return rows.where(~F.endswith("file", F.lit(direct)))


def enrichments(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, ENRICHMENT_DDL)


def tag_overlays(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, OVERLAY_DDL)


def line_count(spark: SparkSession, path: str) -> int:
    """Lines that aren't empty; 0 for a missing file."""
    return spark.read.text(path).where("value <> ''").count() if _exists(spark, path) else 0


def base_and_imports(base: DataFrame, imports: DataFrame) -> DataFrame:
    """Both inputs with one ordinal, base records first, imports by file and line."""
    first = base.withColumn("file", F.lit("")).withColumn("rank", F.lit(0))
    second = imports.withColumn("rank", F.lit(1))
    both = first.unionByName(second)
    from tessera.operators.facets import numbered

    return numbered(both, [F.col("rank"), F.col("file"), F.col("seq")], "place").withColumn("seq", F.col("place")).drop("place", "rank", "file")


def allowed_tags(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(version, tag ids) of a taxonomy file: a dimension of a few dozen rows."""
    row = spark.read.schema("version int, tags array<struct<id:string>>").option("multiLine", True).json(path).first()
    return row["version"], [t["id"] for t in row["tags"]]


def paged_jdbc(spark: SparkSession, url: str, table_name: str, column: str, low: int, high: int, parts: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table read in parallel ranges of a numeric column, instead of page by page."""
    return spark.read.jdbc(url, table_name, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties or {})


class Memoised:
    """A catalog scanned once and kept for later queries; a failed scan isn't remembered."""

    def __init__(self, load) -> None:  # noqa: ANN001
        self._load, self._kept = load, None

    def get(self) -> DataFrame:
        if self._kept is None:
            frame = self._load().persist()
            try:
                frame.count()
            except Exception:
                frame.unpersist()
                raise
            self._kept = frame
        return self._kept
