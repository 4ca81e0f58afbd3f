"""The joins that lenses use: by membership, by interval, and by normalized names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensframe.functions.scalars import normalize_well


def semi_join(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``other``."""
    return df.join(other.select(F.col(right).alias(left)).distinct(), left, "left_semi")


def interval_join(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, width: float, key: tuple[str, str] | None = None) -> DataFrame:
    """Points with each interval (closed) that holds them; the columns of both.

    Intervals and points meet by buckets of ``width`` (and by an equal key, if given), so this is an equi-join with a residual: choose about
    a usual interval's length. Points that are null or no number, and intervals without an end, meet nothing.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    p = points.withColumn("__b", F.floor(number(point) / width))
    i = intervals.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) <= F.col(hi))).withColumn("__b", F.explode(F.sequence(F.floor(number(lo) / width), F.floor(number(hi) / width))))
    on = [p["__b"] == i["__b"]] + ([p[key[0]] == i[key[1]]] if key else [])
    inside = (p[point].cast("double") >= i[lo].cast("double")) & (p[point].cast("double") <= i[hi].cast("double"))
    both = p.join(i, [*on, inside])
    return both.drop("__b")


def normalized_join(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose names are equal as wells' names are written alike."""
    x, y = a.withColumn("__n", normalize_well(F.col(left))), b.withColumn("__n", normalize_well(F.col(right)))
    return x.join(y, "__n").drop("__n")
