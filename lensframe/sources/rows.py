"""Files of any format as rows: parsers run on the executors, one file per task row, and their ragged rows become one typed table."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.functions.scalars import infer_types
from lensframe.session import cut

Parser = Callable[[bytes, str], Iterator[dict]]


class UnreadableFile(ValueError):
    """A file is not of its format, or has no rows."""


def parsed_rows(spark: SparkSession, path: str | list[str], parser: Parser, recursive: bool = False, skip_bad: bool = False) -> DataFrame:
    """``file, row_no, row``: the rows of each file as JSON objects of texts; each file is read in one piece by one task.

    A file that cannot be read fails the job, or is passed over with ``skip_bad``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                try:
                    rows = [json.dumps({k: _text(v) for k, v in r.items()}, ensure_ascii=False) for r in parser(bytes(content), p)]
                except Exception:
                    if skip_bad:
                        continue
                    raise
                for a in range(0, len(rows), 10_000):
                    part = rows[a : a + 10_000]
                    yield pd.DataFrame({"file": [p] * len(part), "row_no": range(a + 1, a + 1 + len(part)), "row": part})

    return files.mapInPandas(run, "file string, row_no bigint, row string")


def _text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return str(int(v))
    return json.dumps(v, ensure_ascii=False)


def typed(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The JSON rows as columns, in the order in which they appear, each of the type that all its cells have. No rows is an error."""
    rows = cut(rows)  # files are parsed once; columns, types and cells are read from what is written
    keys = rows.select("file", "row_no", F.posexplode(F.json_object_keys("row")).alias("i", "key")).groupBy("key").agg(F.min(F.struct("file", "row_no", "i")).alias("first"))
    order = [r["key"] for r in keys.orderBy("first").select("key").collect()]  # a row per column
    if not order:
        raise UnreadableFile("no rows")
    cells = F.from_json("row", "map<string,string>")
    wide = rows.select(*(keep or []), cells.alias("m")).select(*(keep or []), *(F.col("m")[k].alias(k) for k in order if k not in (keep or [])))
    return infer_types(wide, order)
