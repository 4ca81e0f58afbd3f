"""Overlapping and gapped time intervals: continuous periods per entity, and the gaps between them.

Spark's own ``session_window`` with a duration per row merges spans that overlap. So that an entity
with any share of the rows is never one task's work, spans are first merged within (entity, time
chunk); what crosses a chunk's end is settled over one small row per (entity, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lensframe.session import cut

DAY_MS = 86_400_000


def merge_intervals(
    df: DataFrame,
    entity: str,
    start: str,
    end: str,
    chunk_ms: int = DAY_MS,
) -> DataFrame:
    """Longest covered stretches per entity: ``entity, from_ms, to_ms, next_ms``.

    ``start`` and ``end`` are epoch milliseconds. Spans that overlap or touch belong together; ``next_ms`` is
    the start of the entity's next period, null for its last. Spans with a null time, or whose start is not
    before their end, are left out; so are rows with a null entity. Repeated rows and extra columns change
    nothing. ``chunk_ms`` only sets the unit of parallel work, never the result: an entity's spans are spread over
    (latest start - earliest start) / chunk_ms tasks, and its chunk rows are as many at most. Within a chunk overlapping spans merge where they are read, before the shuffle.
    """
    spans = df.where(F.col(entity).isNotNull() & (F.col(start) < F.col(end))).select(
        F.col(entity).alias("entity"),
        F.floor(F.col(start) / F.lit(chunk_ms)).cast("bigint").alias("chunk"),
        F.timestamp_millis(F.col(start)).alias("ts"),
        F.make_interval(secs=((F.col(end) - F.col(start)) / F.lit(1000)).cast("decimal(18,6)")).alias("held"),
    )
    local = (
        spans.groupBy("entity", "chunk", F.session_window("ts", F.col("held")).alias("w"))
        .agg(F.lit(1).alias("one"))
        .select("entity", "chunk", F.unix_millis("w.start").alias("s"), F.unix_millis("w.end").alias("e"))
    )
    # read by three passes below; its session windows and what they come from are computed once
    return _stitch(_merged_early(local)).select(F.col("entity").alias(entity), "from_ms", "to_ms", "next_ms")


#: Spark merges sessions before the shuffle too if this is set: of an entity with any share of the rows only its sessions travel.
_EARLY = "spark.sql.sessionWindow.merge.sessions.in.local.partition"


def _merged_early(local: DataFrame) -> DataFrame:
    conf = local.sparkSession.conf
    before = conf.get(_EARLY, "false")
    conf.set(_EARLY, "true")
    try:
        return cut(local)
    finally:
        conf.set(_EARLY, before)


def _stitch(local: DataFrame) -> DataFrame:
    """Periods from the spans merged within (entity, chunk): touching ones and those across chunks are joined."""
    in_chunk = W.partitionBy("entity", "chunk")
    before = in_chunk.orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    along = in_chunk.orderBy("s", "e").rowsBetween(W.unboundedPreceding, 0)
    marked = local.withColumn("reach", F.max("e").over(before))
    # touching periods of one chunk become one
    marked = marked.withColumn("n", F.sum((F.col("reach").isNull() | (F.col("s") > F.col("reach"))).cast("int")).over(along))
    joined = marked.groupBy("entity", "chunk", "n").agg(F.min("s").alias("s"), F.max("e").alias("e"))

    # one row per (entity, chunk): how far all earlier chunks reach
    chunks = joined.groupBy("entity", "chunk").agg(F.max("e").alias("last_e"))
    by_chunk = W.partitionBy("entity").orderBy("chunk")
    carried = chunks.withColumn("carry", F.max("last_e").over(by_chunk.rowsBetween(W.unboundedPreceding, -1))).select("entity", "chunk", "carry")
    parts = joined.join(carried, ["entity", "chunk"]).withColumn("head", F.col("carry").isNull() | (F.col("s") > F.col("carry")))

    # of each chunk: its first period, the reach of what only continues, and the reach of all of it
    edges = parts.groupBy("entity", "chunk").agg(
        F.min(F.when(F.col("head"), F.col("s"))).alias("first_head"),
        F.max(F.when(F.col("head"), F.col("s"))).alias("last_head"),
        F.max(F.when(~F.col("head"), F.col("e"))).alias("tail_e"),
        F.max("e").alias("all_e"),
    )
    # a chunk that begins a period and the chunks after it that begin none
    edges = (
        edges.withColumn("g", F.count("first_head").over(by_chunk))
        .groupBy("entity", "g")
        .agg(
            F.min("chunk").alias("chunk"),
            F.max("first_head").alias("first_head"),
            F.max("last_head").alias("last_head"),
            F.min_by("tail_e", "chunk").alias("tail_e"),
            F.max("all_e").alias("group_e"),
        )
    )
    by_group = W.partitionBy("entity").orderBy("g")
    # of the next chunk that begins a period, the first part may still belong to this one
    edges = edges.withColumn("next_head", F.lead("first_head").over(by_group)).select(
        "entity", "chunk", "last_head", "next_head", F.greatest("group_e", F.lead("tail_e").over(by_group)).alias("end_e")
    )
    last = F.col("s") == F.col("last_head")
    return (
        parts.where("head")
        .withColumn("following", F.lead("s").over(in_chunk.orderBy("s")))
        .join(edges, ["entity", "chunk"])
        .select(
            "entity",
            F.col("s").alias("from_ms"),
            F.when(last, F.col("end_e")).otherwise(F.col("e")).alias("to_ms"),
            F.when(last, F.col("next_head")).otherwise(F.col("following")).alias("next_ms"),
        )
    )


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, longest_gap_ms: int | None = None, chunk_ms: int = DAY_MS) -> DataFrame:
    """``entity, kind, from_ms, to_ms``: each period, and each gap to the entity's next period.

    A gap longer than ``longest_gap_ms`` is left out (None keeps all). Otherwise as ``merge_intervals``.
    """
    merged = merge_intervals(df, entity, start, end, chunk_ms)
    gap: Column = F.col("next_ms").isNotNull()
    if longest_gap_ms is not None:
        gap &= F.col("next_ms") - F.col("to_ms") <= F.lit(longest_gap_ms)
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("from_ms"), F.col("to_ms")),
        F.when(gap, F.struct(F.lit("gap").alias("kind"), F.col("to_ms").alias("from_ms"), F.col("next_ms").alias("to_ms"))),
    )
    return merged.select(entity, F.explode(F.array_compact(both)).alias("x")).select(entity, "x.kind", "x.from_ms", "x.to_ms")
