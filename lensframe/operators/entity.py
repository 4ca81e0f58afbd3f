"""Entity pages, search, and what needs watching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def references(df: DataFrame, key: str, refs: str, sep: str = ";") -> DataFrame:
    """``key, ref``: one row per distinct reference in a joined field."""
    return df.select(key, F.explode(F.array_distinct(F.split(F.col(refs), sep))).alias("ref")).select(key, F.trim("ref").alias("ref")).where("ref <> ''")


def asset_page(asset_id: int, assets: DataFrame, timeseries: DataFrame, events: DataFrame, documents: DataFrame | None = None, most: int = 60) -> dict[str, DataFrame]:
    """The parts of an asset's page: itself, its sensors, its latest events, its documents."""
    key = str(asset_id)
    out = {
        "asset": assets.where(F.col("id") == asset_id),
        "sensors": timeseries.where(F.col("assetid") == asset_id),
        "events": events.where(F.array_contains(F.transform(F.split("assetids", ";"), lambda x: F.trim(x)), key)).orderBy(F.desc("starttime"), F.asc("id")).limit(most),
    }
    if documents is not None:
        out["documents"] = documents.where(F.array_contains("assetids", asset_id))
    return out


def _hit(columns: list[str], q: str) -> Column:
    out: Column = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).contains(q.lower()), F.lit(False))
    return out


def search(q: str, sections: dict[str, tuple[DataFrame, str, list[str], int]]) -> DataFrame:
    """``section, key``: rows that hold a text, case ignored; per section (table, key, columns, most) the first by key."""
    found = None
    for name, (df, key, columns, most) in sections.items():
        part = df.where(_hit(columns, q)).select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key")).distinct().orderBy("key").limit(most)
        found = part if found is None else found.unionByName(part)
    return found


def with_totals(found: DataFrame) -> DataFrame:
    """``section, key, in_section, total``: what ``search`` found, with how many rows its section and all sections have."""
    counts = found.groupBy("section").agg(F.count("*").alias("in_section"))
    return found.join(counts, "section").crossJoin(F.broadcast(counts.agg(F.sum("in_section").alias("total"))))


def event_counts(event_refs: DataFrame) -> DataFrame:
    """``ref, events``: how many events name each asset."""
    return event_refs.groupBy("ref").agg(F.count("*").alias("events"))


def blind_spots(counts: DataFrame, sensors: DataFrame, least: int = 2, most: int = 15) -> DataFrame:
    """Assets (``ref, events``) with events and no sensor (``ref``), the most events first."""
    return counts.where(F.col("events") >= least).join(sensors.select("ref").distinct(), "ref", "left_anti").orderBy(F.desc("events"), "ref").limit(most)


def hotspots(counts: DataFrame, sensors: DataFrame, most: int = 10) -> DataFrame:
    """``ref, events, sensors``: the assets with the most events, and how many sensors they have."""
    top = counts.orderBy(F.desc("events"), "ref").limit(most)
    return top.join(sensors.groupBy("ref").agg(F.count("*").alias("sensors")), "ref", "left").select("ref", "events", F.coalesce("sensors", F.lit(0)).alias("sensors"))
