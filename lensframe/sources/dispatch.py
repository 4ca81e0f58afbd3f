"""A path as a table: by extension, by trial, or a whole directory."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lensframe.sources import binary_formats, text_formats, xml_formats
from lensframe.sources.rows import Parser, UnreadableFile, parsed_rows, typed

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": lambda s, p: text_formats.read_delimited(s, p, ","),
    "tsv": lambda s, p: text_formats.read_delimited(s, p, "\t"),
    "json": text_formats.read_json,
    "jsonl": text_formats.read_json_lines,
    "ndjson": text_formats.read_json_lines,
    "las": text_formats.read_las,
    "xml": xml_formats.read_xml,
    "xlsx": binary_formats.read_workbook,
    "pb": binary_formats.read_datapoints,
    "pdf": binary_formats.read_document,
    "md": binary_formats.read_document,
    "parquet": lambda s, p: s.read.parquet(p),
}

PARSERS: dict[str, Parser] = {
    "csv": text_formats.delimited_rows, "tsv": lambda b, p: text_formats.delimited_rows(b, p, "\t"), "json": text_formats.json_rows, "jsonl": text_formats.json_rows, "ndjson": text_formats.json_rows,
    "las": text_formats.las, "xml": xml_formats.xml_rows, "xlsx": binary_formats.workbook,
}


def extension(path: str) -> str:
    return os.path.splitext(path)[1].lstrip(".").lower()


def any_rows(content: bytes, path: str) -> Iterator[dict]:
    """The rows of a file by its extension, else as JSON, fixed width or comma-separated, whichever fits first."""
    own = PARSERS.get(extension(path))
    tries = [own] if own else [text_formats.json_rows, text_formats.fixed_width, text_formats.delimited_rows]
    for t in tries:
        try:
            rows = list(t(content, path))
            if rows:
                yield from rows
                return
        except (UnreadableFile, ValueError):
            if own:
                raise
    raise UnreadableFile(f"{path}: of no known format")


def read_path(spark: SparkSession, path: str) -> DataFrame:
    if os.path.isdir(path) and not path.rstrip("/").endswith(".parquet"):
        return read_directory(spark, path)
    reader = READERS.get(extension(path))
    return reader(spark, path) if reader else typed(parsed_rows(spark, path, any_rows))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """All files below a directory as one table, with ``kind`` (the nearest folder that is no number) and ``file`` (the path below).

    Files that cannot be read are passed over; if none can it is an error.
    """
    rows = parsed_rows(spark, path, any_rows, recursive=True, skip_bad=True)
    root = os.path.abspath(path).rstrip("/")
    below = F.regexp_replace(F.regexp_replace("file", "^file:/*", "/"), "^" + _quoted(root) + "/", "")
    folders = F.filter(F.slice(F.split(below, "/"), 1, F.size(F.split(below, "/")) - 1), lambda x: ~x.rlike(r"^\d+$"))
    kind = F.when(F.size(folders) > 0, F.element_at(folders, -1)).otherwise(F.lit(os.path.basename(root)))
    named = rows.withColumn("kind", kind).withColumn("__below", below)
    df = typed(named, ["kind", "__below"]).withColumnRenamed("__below", "file")
    return df.select(*(c for c in df.columns if c not in ("kind", "file")), "kind", "file")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in text)


def available(spark: SparkSession, roots: list[str], mounted: tuple[str, ...] = (), depth: int = 5, most: int = 12, skipped: tuple[str, ...] = ("models", "projects", "docs")) -> DataFrame:
    """``path, files``: the shallowest directories that hold data files and are not mounted yet."""
    found: list[tuple[str, int]] = []
    for root in roots:
        level = [root]
        for _ in range(depth + 1):
            below: list[str] = []
            for d in sorted(level):
                if any(d == m or d.startswith(m + "/") for m in mounted) or os.path.basename(d) in skipped:
                    continue
                entries = sorted(os.scandir(d), key=lambda e: e.name)
                data = [e for e in entries if e.is_file() and extension(e.name) in READERS and extension(e.name) not in ("md", "pdf")]
                if data:
                    found.append((d, len(data)))
                else:
                    below += [e.path for e in entries if e.is_dir()]
            level = below
    return spark.createDataFrame(found[:most], "path string, files int")


def read_journal(spark: SparkSession, path: str, local: str = "local") -> DataFrame:
    """``k, p, o, s, line``: a journal's lines in order (``line``); those without an origin are ``local`` ones, numbered by their place among such.

    A line that is no event (no JSON, no kind or payload, an origin without a number) is passed over and takes no number. Places are counted by partition of the
    files as they are read, so no task holds a journal: lines are numbered within it, and partitions by what those before them have.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    j = lines.select(F.from_json("value", "k string, p string, o string, s bigint").alias("j"), "file", "at").select("j.*", "file", "at")
    kept = j.where("k is not null and p is not null and (o is null or s is not null)").withColumn("part", F.shiftright("at", 33))
    own = kept.groupBy("part").agg(F.min("file").alias("file"), F.min("at").alias("first"), F.count("*").alias("n"), F.count_if(F.col("o").isNull()).alias("locals"))
    order = W.orderBy("file", "first").rowsBetween(W.unboundedPreceding, -1)  # a row per partition of the scan
    ahead = own.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("lines_ahead"), F.coalesce(F.sum("locals").over(order), F.lit(0)).alias("locals_ahead"))
    within = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    placed = kept.withColumn("line", F.count("*").over(within)).withColumn("local_no", F.count_if(F.col("o").isNull()).over(within)).join(F.broadcast(ahead), "part")
    seq = F.when(F.col("o").isNull(), F.col("locals_ahead") + F.col("local_no") - 1).otherwise(F.col("s"))
    return placed.select("k", "p", F.coalesce("o", F.lit(local)).alias("o"), seq.alias("s"), (F.col("lines_ahead") + F.col("line") - 1).alias("line"))


def append_journal(events: DataFrame, path: str) -> None:
    events.select(F.to_json(F.struct("k", "p", "o", "s")).alias("value")).write.mode("append").text(path)
