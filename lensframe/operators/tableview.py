"""An ordered table: windows of it, what changed between two windows, and edits of its cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lensframe.operators import zset


def window(df: DataFrame, sort: str, key: str, offset: int, limit: int, descending: bool = False) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order by (sort, key); descending turns the whole order round."""
    order = [F.col(sort).desc(), F.col(key).desc()] if descending else [F.col(sort).asc(), F.col(key).asc()]
    return df.orderBy(*order).offset(offset).limit(limit)


def with_place(df: DataFrame, sort: str, key: str, descending: bool = False) -> DataFrame:
    """A window's rows with their place in it, from 0; the window is small, so one task numbers it."""
    order = [F.col(sort).desc(), F.col(key).desc()] if descending else [F.col(sort).asc(), F.col(key).asc()]
    return df.withColumn("place", F.row_number().over(W.orderBy(*order)) - 1)


def clamp(first: int, count: int, total: int) -> tuple[int, int]:
    """A viewport's first row and size within bounds."""
    count = min(120, max(10, count))
    return min(max(0, first), max(0, total - count)), count


def viewport(df: DataFrame, arrival: str, first: int, count: int) -> DataFrame:
    """The rows of a table in order of arrival that a viewport shows, within its bounds."""
    at, size = clamp(first, count, df.count())
    return df.orderBy(arrival).offset(at).limit(size)


def upsert(df: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """``df`` after ordered ``changes`` (its columns, ``seq`` and ``deleted``): by key the last one holds."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*(c for c in changes.columns if c != key)), seq).alias("x"))
    rows = [c for c in df.columns if c != key]
    joined = df.select(key, F.struct(*rows).alias("old")).join(last, key, "full")
    keep = joined.where(~F.coalesce(F.col("x.deleted"), F.lit(False)))
    return keep.select(key, *(F.when(F.col("x").isNotNull(), F.col(f"x.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in rows))


def window_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``op, key, place, column, value``: the least changes from one window (with ``place``) to another.

    ``remove`` rows that left, ``create`` those that came, ``move`` those whose place changed, and ``set`` each cell whose text changed.
    """
    a = old.select(F.col(key).alias("key"), F.col("place").alias("a_place"), *(F.col(c).cast("string").alias(f"a_{c}") for c in columns))
    b = new.select(F.col(key).alias("key"), F.col("place").alias("b_place"), *(F.col(c).cast("string").alias(f"b_{c}") for c in columns))
    j = a.join(b, "key", "full")
    came, left = F.col("a_place").isNull(), F.col("b_place").isNull()

    def op(name: str, when: Column, column: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("op"), F.coalesce("b_place", "a_place").alias("place"), column.alias("column"), value.alias("value")))

    none = F.lit(None).cast("string")
    ops = [op("remove", left, none, none), op("create", came, none, none), op("move", ~came & ~left & (F.col("a_place") != F.col("b_place")), none, none)]
    ops += [op("set", ~left & (came | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))), F.lit(c), F.coalesce(F.col(f"b_{c}"), F.lit(""))) for c in columns]
    return j.select("key", F.explode(F.array_compact(F.array(*ops))).alias("x")).select("x.op", "key", F.col("x.place").cast("int").alias("place"), "x.column", "x.value")


def cell_edit(df: DataFrame, key: str, value: object, column: str, new: object) -> DataFrame:
    """The change that an edit of one cell stands for."""
    old = df.where(F.col(key).eqNullSafe(F.lit(value)))
    return zset.update(old, old.withColumn(column, F.lit(new).cast(df.schema[column].dataType)))


def render(df: DataFrame, columns: list[str]) -> DataFrame:
    """One ``line`` per row: cells as text, nothing for null, joined by " | "."""
    return df.select(F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line"))


def show(df: DataFrame, columns: list[str] | None = None, contains: str | None = None, limit: int = 10) -> DataFrame:
    """The first rows that hold a text in any column (case ignored), with the chosen columns; 1 to 200 rows.

    Columns are found by ``resolve_field``; unknown ones are left out, and with none left all are shown.
    """
    from lensframe.plans.catalog import resolve_field

    rows = df
    if contains:
        hit = [F.lower(F.col(f"`{c}`").cast("string")).contains(contains.lower()) for c in df.columns]
        rows = rows.where(F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(h, F.lit(False)) for h in hit)), F.lit(False)))
    chosen = list(dict.fromkeys(f for f in (resolve_field(df, c) for c in columns or ()) if f))
    return rows.select(*(F.col(f"`{c}`") for c in chosen or df.columns)).limit(min(200, max(1, limit)))
