"""Delimited, JSON and fixed-width files, and well logs: parsers of whole files, and Spark's own readers where they fit."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.functions.scalars import infer_types
from lensframe.sources.rows import UnreadableFile, parsed_rows, typed


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV or TSV file with a header: quotes, doubled quotes, delimiters and line ends in quotes; short rows are filled up, blank lines passed over."""
    # a file is read in one piece only where a quoted field goes over a line's end
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    pieces = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    raw = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=pieces, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=False)
    df = raw.select(*(F.col(f"`{c}`").cast("string").alias(c.strip().rstrip("\r")) for c in raw.columns))
    last = df.columns[-1]
    df = df.withColumn(last, F.regexp_replace(F.col(f"`{last}`"), "\r$", "")).dropna("all")
    if df.isEmpty():
        raise UnreadableFile(f"{path}: no rows")
    return infer_types(df)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or one object as one row."""
    df = spark.read.json(path, multiLine=True, mode="FAILFAST")
    if df.isEmpty():
        raise UnreadableFile(f"{path}: no rows")
    return df


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """An object per line; blank lines are passed over, and a line that is none fails the file."""
    df = spark.read.json(path, mode="FAILFAST")
    if df.isEmpty():
        raise UnreadableFile(f"{path}: no rows")
    return df


def fixed_width(content: bytes, path: str) -> Iterator[dict]:
    """Rows of a listing whose columns stand under each other.

    Lines that begin with # are comments. Columns are parted by two or more places that are blank in every line (or one at a heading's
    right edge); the first line has the names, and a column without one is an error.
    """
    lines = [x.rstrip("\r").expandtabs(8).rstrip() for x in content.decode("utf-8", "replace").split("\n")]
    lines = [x for x in lines if x.strip() and not x.lstrip().startswith("#")]
    if len(lines) < 2:
        raise UnreadableFile(f"{path}: no rows")
    width = max(map(len, lines))
    filled = [any(i < len(x) and x[i] != " " for x in lines) for i in range(width)]
    bounds: list[tuple[int, int]] = []
    at = 0
    while at < width:
        if not filled[at]:
            at += 1
            continue
        end = at
        while end < width and (filled[end] or (end + 1 < width and filled[end + 1])):
            end += 1
        bounds.append((at, end))
        at = end
    if len(bounds) < 2:
        raise UnreadableFile(f"{path}: no columns")
    names = [lines[0][a:b].strip() for a, b in bounds]
    if not all(names):
        raise UnreadableFile(f"{path}: a column has no name")
    for x in lines[1:]:
        yield {n: x[a:b].strip() or None for n, (a, b) in zip(names, bounds)}


def read_fixed_width(spark: SparkSession, path: str) -> DataFrame:
    return typed(parsed_rows(spark, path, fixed_width))


def las(content: bytes, path: str) -> Iterator[dict]:
    """A row per station of a well log (LAS 1.2 or 2.0): ``well`` and the curves; the null value gives none; wrapped logs are put together."""
    section, curves, values = "", [], []
    wrap, null, well = False, -999.25, None
    for line in content.decode("utf-8", "replace").splitlines():
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        if s.startswith("~"):
            section = s[1:2].upper()
            continue
        if section == "A":
            values.append(s.split())
            continue
        m = re.match(r"([^.]+?)\s*\.(\S*)\s*(.*?)(?:\s*:\s*([^:]*))?$", s)
        if not m:
            continue
        name, body, after = m.group(1).strip(), m.group(3).strip(), (m.group(4) or "").strip()
        if section == "V" and name.upper() == "WRAP":
            wrap = body.upper().startswith("Y")
        elif section == "W" and name.upper() == "NULL":
            null = float(body)
        elif section == "W" and name.upper() == "WELL":
            well = body or after
        elif section == "C":
            curves.append(name)
    if not curves:
        raise UnreadableFile(f"{path}: no curves")
    if wrap:
        flat = [v for row in values for v in row]
        if len(flat) % len(curves):
            raise UnreadableFile(f"{path}: the values do not fill the curves")
        values = [flat[i : i + len(curves)] for i in range(0, len(flat), len(curves))]
    for row in values:
        if len(row) != len(curves):
            raise UnreadableFile(f"{path}: {len(row)} values for {len(curves)} curves")
        out: dict = {"well": well}
        for c, v in zip(curves, row):
            try:
                x: float | str | None = float(v)
                x = None if abs(x - null) < 1e-9 else x
            except ValueError:
                x = v
            out[c] = x
        yield out


def read_las(spark: SparkSession, path: str) -> DataFrame:
    return typed(parsed_rows(spark, path, las))


def json_rows(content: bytes, path: str) -> Iterator[dict]:
    """The rows of a JSON file, or of one with an object per line."""
    text = content.decode("utf-8", "replace").strip()
    try:
        value = json.loads(text)
    except ValueError:
        value = []
        for n, line in enumerate(text.splitlines(), 1):
            if line.strip():
                try:
                    value.append(json.loads(line))
                except ValueError as e:
                    raise UnreadableFile(f"{path}: line {n} is no JSON") from e
    for r in value if isinstance(value, list) else [value]:
        yield r if isinstance(r, dict) else {"value": r}


def delimited_rows(content: bytes, path: str, sep: str = ",") -> Iterator[dict]:
    import csv
    import io

    rows = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""), delimiter=sep)
    names: list[str] | None = None
    for r in rows:
        if not any(c.strip() for c in r):
            continue
        if names is None:
            names = [c.strip() for c in r]
            continue
        yield {n: (r[i] if i < len(r) and r[i] != "" else None) for i, n in enumerate(names)}
    if names is None:
        raise UnreadableFile(f"{path}: no rows")
