"""Shape detectors: which columns are dates, lanes, axes, prose, titles, spans, depth. One aggregation per table feeds them all."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensframe.functions.scalars import as_when, is_empty
from lensframe.operators.zset import support_of

#: What the name of a lane may contain, and names that say what a column is, in order of preference.
LANES = r"status|state|phase|stage|type|kind|severity|priority|category"
TITLES = ("title", "name", "label", "summary", "subject", "externalid", "well", "id")
DEPTHS = ("DEPT", "dept", "md", "MD", "depth", "Depth", "tvd", "TVD")
#: What the names of a span's ends contain, and those of three axes, the first that fits.
START_NAMES, END_NAMES = r"start|begin|from|opened|created", r"end|finish|to|until|closed|done"
AXES = ((r"^(x|east)", r"lon"), (r"^(y|north)", r"lat"), (r"^(z|tvd|depth|elev|alt)",))
#: Fixed value: a text shorter than this may be a title.
TITLE_SHORTER = 80


@dataclass(frozen=True)
class ColumnShape:
    name: str
    kind: T.DataType
    rows: int
    filled: int
    distinct: int
    dates: int
    first_is_date: bool
    lo: float | None
    hi: float | None
    mean_length: float
    shortest: int

    @property
    def numeric(self) -> bool:
        return isinstance(self.kind, T.NumericType)

    @property
    def text(self) -> bool:
        return isinstance(self.kind, T.StringType)


def shapes(df: DataFrame, limit: int | None = None) -> list[ColumnShape]:
    """What the detectors need of each column; over the set of all rows, or of a sample if a limit is given."""
    rows = support_of(df)
    if limit is not None:
        rows = rows.limit(limit)
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        col, kind = F.col(f"`{c}`"), df.schema[c].dataType
        filled = ~is_empty(col, kind)
        plain = not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
        when = as_when(col, kind)
        number = col.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
        aggs += [
            F.count_if(filled).alias(f"f{i}"),
            (F.countDistinct(F.when(filled, col)) if plain else F.lit(0)).alias(f"d{i}"),
            F.count(F.when(filled, when)).alias(f"w{i}"),
            F.min(number).alias(f"lo{i}"),
            F.max(number).alias(f"hi{i}"),
            (F.avg(F.when(filled, F.length(col.cast("string")))) if plain else F.lit(0.0)).alias(f"len{i}"),
            (F.min(F.when(filled, F.length(col.cast("string")))) if plain else F.lit(None).cast("int")).alias(f"short{i}"),
        ]
    r = rows.agg(*aggs).first()
    return [
        ColumnShape(c, df.schema[c].dataType, r["n"], r[f"f{i}"], r[f"d{i}"], r[f"w{i}"], r[f"w{i}"] > 0, r[f"lo{i}"], r[f"hi{i}"], float(r[f"len{i}"] or 0), int(r[f"short{i}"] or 0)) for i, c in enumerate(df.columns)
    ]


def date_fields(s: list[ColumnShape]) -> list[str]:
    return [c.name for c in s if c.filled >= 3 and c.dates >= 0.6 * c.filled]


def date_field(s: list[ColumnShape]) -> str | None:
    return next(iter(date_fields(s)), None)


def lane_field(s: list[ColumnShape]) -> str | None:
    """Few values that repeat; names that hold a known word first, then the fewest values."""
    fit = [c for c in s if c.rows >= 4 and 2 * c.filled >= c.rows and 2 <= c.distinct <= 12 and c.filled >= 3 * c.distinct]
    return min(fit, key=lambda c: (not re.search(LANES, c.name, re.I), c.distinct)).name if fit else None


def numeric_fields(s: list[ColumnShape]) -> list[str]:
    """Columns of numbers that are no times, with two values at least."""
    return [c.name for c in s if c.numeric and c.filled and c.dates < c.filled and c.distinct >= 2]


def geo_pair(s: list[ColumnShape]) -> tuple[str, str] | None:
    """(longitude, latitude) by name and range."""
    within = lambda c, most: c.numeric and (c.lo is None or -most <= c.lo and c.hi <= most)
    lat = next((c.name for c in s if re.match("lat", c.name, re.I) and within(c, 90)), None)
    lon = next((c.name for c in s if re.match("lon|lng", c.name, re.I) and within(c, 180)), None)
    return (lon, lat) if lat and lon else None


def prose_field(s: list[ColumnShape]) -> str | None:
    fit = [c for c in s if c.text and c.filled >= max(2, 0.3 * c.rows) and c.mean_length > 120]
    return max(fit, key=lambda c: c.mean_length).name if fit else None


def title_field(s: list[ColumnShape]) -> str | None:
    """Known names first, if they have a value; else the first column with a short text; else the first column."""
    by = {c.name.lower(): c.name for c in reversed(s) if c.filled}
    named = next((by[t] for t in TITLES if t in by), None)
    return named or next((c.name for c in s if c.text and 0 < c.shortest < TITLE_SHORTER), s[0].name if s else None)


def span_fields(s: list[ColumnShape], df: DataFrame) -> tuple[str, str] | None:
    """(start, end): two columns with dates, by their names or else the first ones, where three rows have both and none ends before it starts."""
    dates = [c.name for c in s if c.dates]
    if len(dates) < 2:
        return None
    start = next((c for c in dates if re.search(START_NAMES, c, re.I)), dates[0])
    others = [c for c in dates if c != start]
    end = next((c for c in others if re.search(END_NAMES, c, re.I)), others[0])
    a, b = as_when(F.col(f"`{start}`"), df.schema[start].dataType), as_when(F.col(f"`{end}`"), df.schema[end].dataType)
    r = support_of(df).agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("both"), F.count_if(b < a).alias("bad")).first()
    return (start, end) if r["both"] >= 3 and r["bad"] == 0 else None


def axes(s: list[ColumnShape]) -> tuple[str, str, str] | None:
    """Three columns of numbers: by their names, else the first that no axis before has."""
    nums = numeric_fields(s)
    chosen: list[str] = []
    for names in AXES:
        named = next((c for p in names for c in nums if re.search(p, c, re.I)), None)
        rest = [c for c in nums if c not in chosen]
        if not named and not rest:
            return None
        chosen.append(named or rest[0])
    return tuple(chosen)  # type: ignore[return-value]


def depth_field(s: list[ColumnShape]) -> str | None:
    by = {c.name: c for c in s}
    return next((d for d in DEPTHS if d in by and by[d].numeric and by[d].filled), None)


def available_views(df: DataFrame, name: str = "") -> list[str]:
    """The views that a table offers, in order; assets have their tree, and events their timeline."""
    s = shapes(df)
    nums = numeric_fields(s)
    offers = (
        ("table", True), ("tree", name == "assets"), ("timeline", name == "events"), ("calendar", date_field(s)), ("heatmap", date_field(s)), ("kanban", lane_field(s)), ("gantt", span_fields(s, df)),
        ("histogram", len(nums) >= 1), ("scatter", len(nums) >= 2), ("3d", len(nums) >= 3), ("map", geo_pair(s)), ("reading", prose_field(s)), ("depth", depth_field(s)), ("schema", True),
    )
    return [view for view, offered in offers if offered]


def shape_report(df: DataFrame) -> DataFrame:
    """``detector, field`` of a table, one row for each that finds something."""
    s = shapes(df)
    found: list[tuple[str, str]] = []
    for name, v in (("date", date_field(s)), ("lane", lane_field(s)), ("prose", prose_field(s)), ("title", title_field(s)), ("depth", depth_field(s))):
        if v:
            found.append((name, v))
    found += [("numeric", c) for c in numeric_fields(s)]
    span = span_fields(s, df)
    found += [("start", span[0]), ("end", span[1])] if span else []
    geo = geo_pair(s)
    found += [("longitude", geo[0]), ("latitude", geo[1])] if geo else []
    three = axes(s)
    found += list(zip(("axis x", "axis y", "axis z"), three)) if three else []
    return df.sparkSession.createDataFrame(found, "detector string, field string")
