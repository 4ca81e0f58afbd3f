"""Live sources on Structured Streaming: rows appended to a folder, counts and tops maintained per batch, refresh policies as triggers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensframe.operators import zset


def trigger(policy: str) -> dict[str, Any]:
    """How a refresh policy starts batches: ``snapshot`` once, ``interval N`` every N seconds, anything else as fast as it can."""
    if policy == "snapshot":
        return {"availableNow": True}
    digits = "".join(c for c in policy if c.isdigit())
    if policy.startswith("interval") and digits:
        return {"processingTime": f"{digits} seconds"}
    return {"processingTime": "0 seconds"}


class Refresh:
    """When the views of sources are made again: at once with each change (``live``), when their interval is over (``interval N``), or never (``snapshot``).

    A view depends on sources, each with its own policy. ``change`` and ``tick`` give the views that are due; a view that waits is due at the earliest of its times.
    """

    def __init__(self) -> None:
        self.views: dict[str, dict[str, float]] = {}
        self.last: dict[str, float] = {}
        self.dirty_at: dict[str, float] = {}

    def watch(self, view: str, policies: dict[str, str], now: float = 0.0) -> None:
        self.views[view] = {source: _seconds(p) for source, p in policies.items()}
        self.last[view] = now

    def change(self, source: str, now: float) -> list[str]:
        due = []
        for view, every in self.views.items():
            wait = every.get(source)
            if wait == 0:
                due.append(view)
            elif wait is not None and wait != float("inf"):
                self.dirty_at[view] = min(self.dirty_at.get(view, float("inf")), self.last[view] + wait)
        return self._made(due, now)

    def tick(self, now: float) -> list[str]:
        return self._made([v for v, at in self.dirty_at.items() if now >= at], now)

    def _made(self, due: list[str], now: float) -> list[str]:
        for v in due:
            self.last[v] = now
            self.dirty_at.pop(v, None)
        return due


def _seconds(policy: str) -> float:
    """How long a policy waits; what is unknown is live."""
    if policy == "snapshot":
        return float("inf")
    digits = "".join(c for c in policy if c.isdigit())
    return float(digits) if policy.startswith("interval") and digits else 0.0


def follow(spark: SparkSession, path: str, schema: T.StructType, form: str = "json") -> DataFrame:
    """The files that are added to a folder, as a stream."""
    return spark.readStream.schema(schema).format(form).load(path)


class GrowingTable:
    """A table that grows by streamed batches; ``on_delta`` is told each batch as a Z-set of inserts.

    A batch is written under its number, so one that is run again after a failure replaces itself.
    """

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")
        self.watchers: list[Callable[[DataFrame, int], None]] = []

    def watch(self, fn: Callable[[DataFrame, int], None]) -> None:
        self.watchers.append(fn)

    def _take(self, batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        at = f"{self.where}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        delta = zset.from_rows(batch.sparkSession.read.parquet(at))
        for fn in self.watchers:
            fn(delta, number)

    def run(self, stream: DataFrame, policy: str = "snapshot"):
        """Starts the stream; with ``snapshot`` it ends when all that is there is taken."""
        return stream.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.where}/progress").trigger(**trigger(policy)).start()

    def rows(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.where}/rows").parquet(f"{self.where}/rows").drop("batch")


def windowed_counts(stream: DataFrame, ts: str, group: str, width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Rows per group and window of event time; what comes later than ``lateness`` behind the latest is left out."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, lateness).groupBy(win, group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("from_ts"), F.col("window.end").alias("to_ts"), group, "n")
