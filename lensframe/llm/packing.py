"""Filling fixed-capacity containers with items by minimum bin slack.

What can be packed depends only on how many items of each length there are, so the packing is planned on the histogram of lengths: it
has a row per length up to the capacity, whatever the number of items. A plan is a list of patterns, each with how often it is
used; items then find their container by their place among the items of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensframe.session import cut

#: Items of one length that are ranked in one task, about.
SHARD_ROWS = 50_000


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths, with the largest one in it, that fills ``capacity`` most.

    A bitset of reachable sums is carried over the lengths from the largest down, each taken in powers of two of its count; the
    walk back from the fullest sum gives the combination. Stops as soon as the capacity is reached exactly.
    """
    anchor = next(x for x in lengths if counts[x])
    room = capacity - anchor
    limit = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # (length, how many at once, sums before)
    goal = 1 << room
    for x in lengths:
        n = counts[x] - (x == anchor)
        if not n or x > room:
            continue
        n = min(n, room // x)
        batch = 1
        while n and not reach & goal:
            take = min(batch, n)
            steps.append((x, take, reach))
            reach |= (reach << (x * take)) & limit
            n -= take
            batch *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    chosen = {anchor: 1}
    for x, take, before in reversed(steps):
        if not before >> at & 1:
            at -= x * take
            chosen[x] = chosen.get(x, 0) + take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns with how often each is used; together they hold every item of the histogram exactly once.

    Each bin is the fullest feasible one; since what is feasible stays so until a length runs out, a pattern is used as often as
    the counts allow, and there are at most about as many patterns as lengths.
    """
    counts = {x: n for x, n in histogram.items() if n > 0}
    if any(x < 1 or x > capacity for x in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths = sorted(counts, reverse=True)
    out: list[tuple[dict[int, int], int]] = []
    while counts:
        pattern = fullest(lengths, counts, capacity)
        times = min(counts[x] // n for x, n in pattern.items())
        out.append((pattern, times))
        for x, n in pattern.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        lengths = [x for x in lengths if x in counts]
    return out


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``key, piece_no, tok_from, tok_to, container_no, fill``: every item of ``sizes`` in a container of ``capacity``.

    An item is cut only if it alone exceeds the capacity: into pieces that fill a container each, and a rest that is packed like an item. Positions
    count from 1. ``fill`` is the container's total. Items of size 0 or null take no room: one row with no container. Items are told apart by ``key``.
    """
    spark = sizes.sparkSession
    items = sizes.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    whole = F.floor(F.col("size") / capacity).cast("bigint")
    split = cut(items.withColumn("full", F.when(F.col("size") > capacity, whole).otherwise(F.lit(0))).withColumn("rest", F.col("size") - F.col("full") * capacity))
    # the histogram: a row per length up to the capacity
    counted = split.where("rest > 0").groupBy("rest").count().collect()
    shards = max(1, -(-split.count() // SHARD_ROWS))
    patterns = plan({r[0]: r[1] for r in counted}, capacity)

    # slots of each length: from which rank on a pattern takes them, how many per container, the pattern's first container
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 1
    taken: dict[int, int] = {}
    for pattern, times in patterns:
        fill = sum(x * n for x, n in pattern.items())
        for x, n in pattern.items():
            slots.setdefault(x, []).append((taken.get(x, 0), n, base, fill))
            taken[x] = taken.get(x, 0) + n * times
        base += times
    table = spark.sparkContext.broadcast({x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in slots.items()})

    # the place of each item among those of its length, without a task per length: by shard, then from the shards' counts
    sharded = split.where("rest > 0").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    per = sharded.groupBy("rest", "shard").count()
    before = per.withColumn("ahead", F.coalesce(F.sum("count").over(W.partitionBy("rest").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = (
        sharded.withColumn("within", F.row_number().over(W.partitionBy("rest", "shard").orderBy("key")) - 1)
        .join(before, ["rest", "shard"])
        .select("key", "full", "rest", (F.col("ahead") + F.col("within")).cast("bigint").alias("rank"))
    )
    kind = sizes.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("full", T.LongType()), T.StructField("rest", T.LongType()), T.StructField("container_no", T.LongType()), T.StructField("fill", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest, rank = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            container, fill = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
            order = np.argsort(rest, kind="stable")
            starts = np.flatnonzero(np.diff(rest[order], prepend=-1))
            for a, z in zip(starts, [*starts[1:], len(order)]):
                at = order[a:z]
                first, per_bin, base_no, total = table.value[int(rest[at[0]])]
                p = np.searchsorted(first, rank[at], side="right") - 1
                container[at] = base_no[p] + (rank[at] - first[p]) // per_bin[p]
                fill[at] = total[p]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(container), pa.array(fill)], names=schema.names)

    rests = ranked.mapInArrow(assign, schema).select(
        "key", (F.col("full") + 1).alias("piece_no"), (F.col("full") * capacity + 1).alias("tok_from"), (F.col("full") * capacity + F.col("rest")).alias("tok_to"), "container_no", "fill"
    )
    # pieces of long items fill containers of their own, numbered after the rest: by shard again
    long = split.where("full > 0").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    ahead = long.groupBy("shard").agg(F.sum("full").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("shard", "ahead")
    pieces = (
        long.withColumn("within", F.coalesce(F.sum("full").over(W.partitionBy("shard").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(ahead, "shard")
        .select("key", (F.lit(base - 1) + F.col("ahead") + F.col("within")).alias("start"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("full"))).alias("piece_no"))
        .select("key", "piece_no", ((F.col("piece_no") - 1) * capacity + 1).alias("tok_from"), (F.col("piece_no") * capacity).alias("tok_to"), (F.col("start") + F.col("piece_no")).alias("container_no"), F.lit(capacity).cast("bigint").alias("fill"))
    )
    nothing = split.where("size = 0").select("key", F.lit(1).cast("bigint").alias("piece_no"), *(F.lit(None).cast("bigint").alias(c) for c in ("tok_from", "tok_to", "container_no", "fill")))
    return rests.unionByName(pieces).unionByName(nothing).withColumnRenamed("key", key)
