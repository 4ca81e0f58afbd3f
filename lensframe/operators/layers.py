"""Layered state: ephemeral over branch over user over shared, with tombstones; branches share what lies below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The layers from the top.
EPHEMERAL, BRANCH, USER, SHARED = 0, 1, 2, 3


def resolve(entries: DataFrame) -> DataFrame:
    """``key, value, layer``: what is visible of ``entries`` (``layer, key, value, deleted, seq``): the last entry of the topmost layer that has the key, if it is no tombstone."""
    first = entries.groupBy("key").agg(F.min_by(F.struct("value", "layer", "deleted"), F.struct(F.col("layer"), -F.col("seq"))).alias("x"))
    return first.where(~F.col("x.deleted")).select("key", "x.value", "x.layer")


def get(entries: DataFrame, key: object) -> DataFrame:
    return resolve(entries.where(F.col("key") == key))


def write(entries: DataFrame, rows: DataFrame, layer: int, seq: int) -> DataFrame:
    """``entries`` with ``rows`` (``key, value``) put in a layer."""
    return entries.unionByName(rows.select(F.lit(layer).alias("layer"), "key", "value", F.lit(False).alias("deleted"), F.lit(seq).cast("bigint").alias("seq")))


def delete(entries: DataFrame, keys: DataFrame, layer: int, seq: int) -> DataFrame:
    value = entries.schema["value"].dataType
    return entries.unionByName(keys.select(F.lit(layer).alias("layer"), "key", F.lit(None).cast(value).alias("value"), F.lit(True).alias("deleted"), F.lit(seq).cast("bigint").alias("seq")))


def fork(entries: DataFrame) -> DataFrame:
    """A branch: the layers below shared, the ephemeral one fresh."""
    return entries.where(F.col("layer") != EPHEMERAL)


drop_ephemeral = fork


def diff(base: DataFrame, branch: DataFrame) -> DataFrame:
    """``key, base, branch``: keys whose visible values differ."""
    a, b = resolve(base).select("key", F.col("value").alias("base")), resolve(branch).select("key", F.col("value").alias("branch"))
    j = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), "key", "full")
    return j.where(~(F.col("base").eqNullSafe(F.col("branch")) & F.col("__a").eqNullSafe(F.col("__b")))).select("key", "base", "branch")


def promote(entries: DataFrame, keys: DataFrame, seq: int) -> DataFrame:
    """``entries`` with the visible value of ``keys`` in the shared layer; what is not visible is gone from it."""
    seen = resolve(entries)
    up = keys.join(seen, "key", "left_semi").join(seen, "key").select("key", "value")
    gone = keys.join(seen, "key", "left_anti")
    return delete(write(entries, up, SHARED, seq), gone, SHARED, seq)


def upper_most(entries: DataFrame) -> DataFrame:
    """Every key with its topmost entry, tombstones too."""
    w = W.partitionBy("key").orderBy("layer", F.desc("seq"))
    return entries.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
