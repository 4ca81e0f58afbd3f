"""Time and depth series: downsampling that keeps extremes, windows anchored at the latest point, series files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lensframe.session import cut


def numbered(df: DataFrame, series: str | None, order: list[str]) -> DataFrame:
    """``df`` with ``i`` (from 0) and ``n``: a row's place in its series by ``order`` (nulls first), and the series' length.

    Rows are spread by ranges of (series, order) that a sample of them balances, whatever their type, and written; a place is that in its range with
    what earlier ranges have of the series. So a long series is many tasks' work, and outliers or texts change nothing.
    """
    names = [series] if series else []
    by = [F.col(c).asc_nulls_first() for c in (*names, *order)]
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__m", 33)).withColumn("__w", F.col("__m").bitwiseAND(F.lit(2**33 - 1)))
    sizes = placed.groupBy(*names, "__part").agg(F.min("__w").alias("__first"), F.count("*").alias("__c"))
    whole = W.partitionBy(*names)  # a row per series and range
    sizes = sizes.withColumn("__ahead", F.coalesce(F.sum("__c").over(whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("__c").over(whole)).drop("__c")
    same = F.col("a.__part") == F.col("b.__part")
    if series:
        same = same & F.col(f"a.{series}").eqNullSafe(F.col(f"b.{series}"))
    joined = placed.alias("a").join(sizes.alias("b"), same)
    return joined.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("b.__ahead") + F.col("a.__w") - F.col("b.__first")).cast("bigint").alias("i"), F.col("b.n"))


def downsample(df: DataFrame, series: str, ts: str, value: str, target: int, tie: str | None = None) -> DataFrame:
    """At most ``target`` points per series, the first lowest and the first highest of each of ``target / 2`` buckets, in time order.

    A series of ``target`` points or fewer stays as it is.
    """
    order = [ts] + ([tie] if tie else [])
    buckets = max(1, target // 2)
    placed = numbered(df.select(series, *order, value), series, order)
    small = placed.where(F.col("n") <= target).select(series, ts, value)
    large = placed.where(F.col("n") > target).withColumn("b", F.floor(((F.col("i") + 1) * buckets - 1) / F.col("n")))
    ends = large.groupBy(series, "b").agg(
        F.min_by(F.struct("i", ts, value), F.struct(F.col(value), F.col("i"))).alias("lo"), F.max_by(F.struct("i", ts, value), F.struct(F.col(value), -F.col("i"))).alias("hi")
    )
    both = ends.select(series, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("p")).select(series, f"p.{ts}", f"p.{value}")
    return small.unionByName(both)


def latest_window(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the latest one (``ts`` in epoch milliseconds)."""
    last = df.agg(F.max(ts).alias("__last"))
    return df.crossJoin(F.broadcast(last)).where(F.col(ts) >= F.col("__last") - F.lit(days * 86_400_000)).drop("__last")


def chart(df: DataFrame, series: str, ts: str, value: str) -> DataFrame:
    """Points and range of each series."""
    return df.groupBy(series).agg(F.count(value).alias("points"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.min(ts).alias("from_ts"), F.max(ts).alias("to_ts"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """``ts, value`` of a series file; the header and lines that do not parse are left out."""
    raw = spark.read.csv(path, schema="a string, b string", mode="PERMISSIVE")
    return raw.select(F.trim("a").try_cast("bigint").alias("ts"), F.trim("b").try_cast("double").alias("value")).where("ts is not null and value is not null")


def write_series(df: DataFrame, path: str, ts: str = "ts", value: str = "value") -> None:
    df.select(F.col(ts).alias("timestamp"), F.col(value).alias("value")).write.mode("overwrite").csv(path, header=True)
