"""Mixing sources to target weights by pivotal dependent rounding.

Every record of a source has the same expected number of copies. Whole copies are certain; the fractions are rounded by pairs: a
pair moves mass, weighted by size so that the source's total stays, until one of the two is whole. Pairs meet within buckets, and what
one bucket cannot settle moves up a tree of buckets until a single fraction per source is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensframe.session import cut

#: Records of a bucket, and buckets that meet in one of the next level.
BUCKET, FAN_IN = 20_000, 64


def pivot(sizes: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int | None, float]:
    """Rounds ``share`` (0..1) so that the sum of ``sizes * share`` stays: ``(rounded, which is left, its fraction)``.

    The expected value of each entry is its share. At most one entry is left with a fraction.
    """
    out = np.zeros(len(sizes))
    held, p = None, 0.0
    draws = rng.random(len(sizes))
    for i in range(len(sizes)):
        q = float(share[i])
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[i] = round(q)
            continue
        if held is None:
            held, p = i, q
            continue
        a, b = float(sizes[held]), float(sizes[i])
        # move size from one to the other until one is whole; both ways in proportion, so nothing is favoured
        up = min((1 - p) * a, q * b)  # the held one gains
        down = min(p * a, (1 - q) * b)
        if up + down <= 0:
            continue
        if draws[i] * (up + down) < down:
            p, q = p + up / a, q - up / b
        else:
            p, q = p - down / a, q + down / b
        if p <= 1e-9 or p >= 1 - 1e-9:
            out[held] = round(p)
            if q <= 1e-9 or q >= 1 - 1e-9:
                out[i] = round(q)
                held = None
            else:
                held, p = i, q
        else:
            out[i] = round(q)
    return out, held, p


def by_classes(sizes: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int | None, float]:
    """``pivot`` by classes of size, the large ones first: what rounding a class's last fraction adds or takes is made up for by the classes below.

    So the fraction that is left belongs to a small record, however large others are. Expected values stay, but for what no share has room for.
    """
    out = np.zeros(len(sizes))
    open_ = (share > 1e-12) & (share < 1 - 1e-12)
    out[~open_] = np.round(share[~open_])
    classes = np.where(open_, np.floor(np.log2(np.maximum(sizes, 1))), -1)
    kinds = sorted(set(classes[open_].tolist()), reverse=True)
    owed = float((sizes * share)[open_].sum())
    for n, kind in enumerate(kinds):
        rest = open_ & (classes <= kind) & (classes >= 0)
        shift = (owed - float((sizes * share)[rest].sum())) / float(sizes[rest].sum())
        at = np.flatnonzero(classes == kind)
        at = at[rng.permutation(len(at))]
        rounded, held, p = pivot(sizes[at], np.clip(share[at] + shift, 0, 1), rng)
        if held is not None:
            if n + 1 == len(kinds):
                out[at] = rounded
                return out, int(at[held]), p
            rounded[held] = float(rng.random() < p)
        out[at] = rounded
        owed -= float((sizes[at] * rounded).sum())
    return out, None, 0.0


def budgets(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Expected tokens of each source.

    Shares are taken relative to the sources that have anything. Without ``total`` it is the largest for which every source reaches its share
    within its repeats; with one, a source that cannot reach its share gives all it may and the others share the rest.
    """
    open_ = {s: t for s, (t, r) in targets.items() if t > 0 and r > 0 and sizes.get(s, 0) > 0}
    if not open_:
        return {}
    most = {s: float(targets[s][1]) * sizes[s] for s in open_}
    if total is None:
        whole = sum(open_.values())
        total = min(most[s] / (t / whole) for s, t in open_.items())
    out: dict[str, float] = {}
    left = float(total)
    while open_:
        whole = sum(open_.values())
        tight = [s for s, t in open_.items() if left * t / whole > most[s] * (1 + 1e-12)]
        if not tight:
            out |= {s: min(most[s], left * t / whole) for s, t in open_.items()}
            break
        for s in tight:
            out[s] = most[s]
            left -= most[s]
            del open_[s]
    return out


def mix(records: DataFrame, key: str, source: str, size: str, targets: DataFrame, total: int | None = None, seed: int = 17) -> DataFrame:
    """``key, source, size, copies``: how often each record is used (records used not at all are left out).

    ``targets`` has ``source, target_share, max_repeats``, one row per source. Each source's total comes within one record of its share of the total (see
    ``budgets``). Records without source, of a source without target, or of size 0 are not used. The draw depends on ``seed`` and the keys only, so a lost
    task draws the same again.
    """
    spark = records.sparkSession
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where(F.col("source").isNotNull() & F.col("target_share").isNotNull() & F.col("max_repeats").isNotNull()).select("source", "target_share", "max_repeats").collect()}
    used = records.where(F.col(source).isin(*wanted) & (F.col(size) > 0)).select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size"))
    sums = {r["source"]: (int(r["n"]), int(r["rows"])) for r in used.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()}
    budget = budgets({s: n for s, (n, _) in sums.items()}, wanted, total)
    rates = {s: min(b / sums[s][0], float(wanted[s][1])) for s, b in budget.items()}
    kind, kind_source = records.schema[key].dataType, records.schema[source].dataType
    if not rates:
        return spark.createDataFrame([], T.StructType([T.StructField(key, kind), T.StructField(source, kind_source), T.StructField(size, T.LongType()), T.StructField("copies", T.LongType())]))
    rate = F.create_map(*(x for s, r in rates.items() for x in (F.lit(s), F.lit(float(r)))))[F.col("source")]
    base = F.floor(rate + F.lit(1e-12))
    rows = max(n for _, n in sums.values())
    buckets = max(1, math.ceil(rows / BUCKET))
    level = used.where(F.col("source").isin(*rates)).select(
        "key", "source", "size", base.cast("bigint").alias("base"), F.greatest(F.lit(0.0), rate - base).alias("share"), F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("bigint").alias("bucket")
    )
    schema = T.StructType([T.StructField("key", kind), T.StructField("source", kind_source), T.StructField("size", T.LongType()), T.StructField("base", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("bucket", T.LongType()), T.StructField("extra", T.LongType())])

    def settle(depth: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            t = table.sort_by("key")
            bucket, src = t.column("bucket")[0].as_py(), t.column("source")[0].as_py()
            rng = np.random.default_rng([seed, depth, bucket, *src.encode()])
            rounded, held, p = by_classes(t.column("size").to_numpy(), t.column("share").to_numpy(), rng)
            extra = pa.array([None if i == held else int(x) for i, x in enumerate(rounded)], pa.int64())
            share = t.column("share").to_numpy().copy()
            if held is not None:
                share[held] = p
                if last:
                    extra = pa.array([int(rng.random() < p) if i == held else int(x) for i, x in enumerate(rounded)], pa.int64())
            return pa.Table.from_arrays([t.column("key"), t.column("source"), t.column("size"), t.column("base"), pa.array(share), t.column("bucket"), extra], names=schema.names)

        return run

    settled: DataFrame | None = None
    depth = 0
    while True:
        last = buckets == 1
        step = cut(level.groupBy("source", "bucket").applyInArrow(settle(depth, last), schema))
        done = step.where(F.col("extra").isNotNull()).select("key", "source", "size", (F.col("base") + F.col("extra")).alias("copies"))
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        buckets = math.ceil(buckets / FAN_IN)
        level = step.where(F.col("extra").isNull()).select("key", "source", "size", "base", "share", F.floor(F.col("bucket") / FAN_IN).cast("bigint").alias("bucket"))
        depth += 1
    return settled.where("copies > 0").select(F.col("key").alias(key), F.col("source").alias(source), F.col("size").alias(size), "copies")


def shares(mixed: DataFrame, source: str, size: str, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, used_tokens, records, most_copies``: what each source of the targets has of the mix."""
    got = mixed.groupBy(F.col(source).alias("source")).agg(F.sum(F.col(size) * F.col("copies")).alias("used_tokens"), F.count("*").alias("records"), F.max("copies").alias("most_copies"))
    all_ = targets.select("source", "target_share").join(got, "source", "left").na.fill(0, ["used_tokens", "records", "most_copies"])
    total = got.agg(F.sum("used_tokens").alias("total"))
    return all_.crossJoin(F.broadcast(total)).select("source", "target_share", (F.col("used_tokens") / F.col("total")).alias("actual_share"), "used_tokens", "records", "most_copies")
