"""Z-sets: multisets with signed weights, as DataFrames with a weight column.

A consolidated Z-set has one row per distinct row and no zero weights, so what nets to nothing is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "_w"


def fields(z: DataFrame) -> list[str]:
    return [c for c in z.columns if c != WEIGHT]


def from_rows(df: DataFrame, weight: int = 1) -> DataFrame:
    """Every row with a weight; repeated rows add up."""
    return consolidate(df.withColumn(WEIGHT, F.lit(weight).cast("bigint")))


def consolidate(z: DataFrame) -> DataFrame:
    """One row per distinct row with the sum of its weights; zero sums vanish. Null cells are equal to each other."""
    return z.groupBy(*(F.col(f"`{c}`") for c in fields(z))).agg(F.sum(WEIGHT).cast("bigint").alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def plus(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of weights, row by row."""
    return consolidate(a.unionByName(b))


def neg(z: DataFrame) -> DataFrame:
    return z.withColumn(WEIGHT, -F.col(WEIGHT))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """The difference of weights; it may be negative."""
    return plus(a, neg(b))


def insert(df: DataFrame) -> DataFrame:
    return from_rows(df, 1)


def remove(df: DataFrame) -> DataFrame:
    return from_rows(df, -1)


def update(old: DataFrame, new: DataFrame) -> DataFrame:
    """The delta from old rows to new ones; equal rows net to nothing."""
    return plus(remove(old), insert(new))


def where(z: DataFrame, predicate: Column) -> DataFrame:
    """Rows that hold, with their weights."""
    return z.where(predicate)


def select(z: DataFrame, *columns: Column | str) -> DataFrame:
    """Transformed rows; those that become equal add up."""
    return consolidate(z.select(*columns, WEIGHT))


def distinct(z: DataFrame) -> DataFrame:
    """Weight 1 for every row with a positive weight; others vanish."""
    return z.where(F.col(WEIGHT) > 0).withColumn(WEIGHT, F.lit(1).cast("bigint"))


def support(z: DataFrame) -> DataFrame:
    """The rows with a positive weight, once each and without weight."""
    return z.where(F.col(WEIGHT) > 0).drop(WEIGHT)


def support_of(df: DataFrame) -> DataFrame:
    """A plain table as the set of its rows: what views, profiles and lenses read."""
    return df.distinct()


def weight(z: DataFrame, row: dict) -> int:
    """The weight of one row, 0 if absent."""
    held = z
    for k, v in row.items():
        held = held.where(F.col(f"`{k}`").eqNullSafe(F.lit(v)))
    return int(held.agg(F.coalesce(F.sum(WEIGHT), F.lit(0))).first()[0])


def size(z: DataFrame) -> int:
    """The number of distinct rows, those with negative weights too."""
    return z.count()


def is_empty(z: DataFrame) -> bool:
    return z.isEmpty()


def equals(a: DataFrame, b: DataFrame) -> bool:
    """Whether both have the same rows with the same weights."""
    return minus(a, b).isEmpty()


def with_fields(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.withColumns(changes)


def without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def get(df: DataFrame, name: str, default: Column) -> Column:
    """A field, or a default where the table has no such field; a null stays null."""
    return F.col(f"`{name}`") if name in df.columns else default


def to_wire(z: DataFrame) -> DataFrame:
    """One ``wire`` text per row: ``[row object, weight]``."""
    return z.select(F.concat(F.lit("["), F.to_json(F.struct(*(F.col(f"`{c}`") for c in fields(z))), {"ignoreNullFields": "false"}), F.lit(","), F.col(WEIGHT).cast("string"), F.lit("]")).alias("wire"))


def from_wire(wire: DataFrame, schema: str) -> DataFrame:
    """The Z-set of ``to_wire`` texts, given the DDL schema of its rows."""
    cut_ = F.regexp_extract(F.col("wire"), r",(-?\d+)\]$", 1)
    body = F.regexp_replace(F.regexp_replace(F.col("wire"), r"^\[", ""), r",-?\d+\]$", "")
    return consolidate(wire.select(F.from_json(body, schema).alias("r"), cut_.cast("bigint").alias(WEIGHT)).select("r.*", WEIGHT))


def apply_rows(z: DataFrame, fn: Callable[[DataFrame], DataFrame], keys: Sequence[str] | None = None) -> DataFrame:
    """An arbitrary row-wise transformation that keeps the weight column, consolidated again."""
    return consolidate(fn(z) if keys is None else fn(z.select(*keys, WEIGHT)))
