"""The most similar vectors for every vector, by an adaptive dimension scan of an inverted index.

Vectors are collapsed to distinct ones, clustered into lists, and lists that are near each other into groups. A vector travels once to each group that has
a list it probes, and there meets the lists' vectors in blocks of bounded size. Within a block a random rotation makes every prefix of the dimensions a fair sample of the distance, so a hypothesis test can abandon most
candidates after the first columns; what survives gets its exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensframe.session import written

#: Bounds of what is fitted on a sample: vectors of the sample, and lists of the index.
SAMPLE_MOST, LISTS_MOST = 60_000, 4_096
#: Lists probed per vector, vectors per block of a group, columns per step of the scan, and the scan's tolerance (a larger one abandons later).
PROBES, BLOCK, COLUMNS, TOLERANCE = 12, 8_192, 16, 2.1
#: Pairs of a query and a candidate that are looked at in one piece, and parts that copies of one vector are spread over.
PIECE, SALTS = 4_000_000, 64


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors; empty clusters are moved to the vectors farthest from theirs."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        best = np.empty(len(x), np.int64)
        like = np.empty(len(x))
        for a in range(0, len(x), 8192):
            s = x[a : a + 8192] @ c.T
            best[a : a + 8192] = s.argmax(1)
            like[a : a + 8192] = s.max(1)
        order = np.argsort(best, kind="stable")
        counts = np.bincount(best, minlength=len(c))
        sums = np.zeros_like(c)
        filled = np.flatnonzero(counts)
        sums[filled] = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(counts)))[filled], axis=0)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            sums[empty] = x[np.argsort(like)[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm == 0, 1, norm), c)
    return c


def scan_block(q: np.ndarray, c: np.ndarray, k: int, least: float, rot: np.ndarray, tolerance: float = TOLERANCE, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``q``, row of ``c``) of unit vectors that may be among the ``k`` most similar and at least ``least`` alike.

    The radius of a query is set by ``least`` and by the k-th best of the candidates that look nearest after the first columns. Candidates
    whose distance, estimated from the columns so far, is beyond the radius by more than chance allows are abandoned; the rest see the next columns.
    """
    dim = q.shape[1]
    qr, cr = q @ rot, c @ rot
    d = min(columns, dim)
    part = _squares(qr[:, :d], cr[:, :d])
    radius = np.full(len(q), 2 - 2 * least + 1e-6)
    if len(c) > k:
        seed = np.argpartition(part, k, axis=1)[:, : k + 1]
        full = 2 - 2 * np.einsum("ij,ikj->ik", q, c[seed])
        radius = np.minimum(radius, np.sort(full, axis=1)[:, k] + 2e-6)
    keep = part * (dim / d) <= (radius * (1 + tolerance / np.sqrt(d)) ** 2)[:, None]
    rows, cols = np.nonzero(keep)
    sums = part[rows, cols]
    while d < dim and len(rows):
        e = min(d + columns, dim)
        sums = sums + ((qr[rows, d:e] - cr[cols, d:e]) ** 2).sum(1)
        d = e
        slack = (1 + tolerance / np.sqrt(d)) ** 2 if d < dim else 1.0
        ok = sums * (dim / d) <= radius[rows] * slack + (0 if d < dim else 1e-6)
        rows, cols, sums = rows[ok], cols[ok], sums[ok]
    return rows, cols


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def _units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def nearest(df: DataFrame, item: str, vec: str, dim: int, k: int = 5, least: float = -1.0, probes: int = PROBES, block: int = BLOCK, sample_most: int = SAMPLE_MOST, lists_most: int = LISTS_MOST) -> DataFrame:
    """``item, other, cosine``: for every vector its ``k`` most similar other vectors with a cosine of at least ``least``.

    The cosine is rounded to 6 decimals, equal ones rank by the smaller item. Vectors that are null, of another length than ``dim``, all zero, or
    hold a null or a number that is not finite take no part. Rows with the same item and vector count once. Equal vectors (told by 128 bits of hash) are scanned as one, with
    their k + 1 smallest items as candidates, so copies cost nothing but their own rows of the result. The index is fitted on a sample of ``sample_most`` vectors at most and
    holds every vector. With ``probes`` of as many as there are lists every vector meets every list, and the result is exact up to the scan's tolerance; so it is
    with fewer vectors than ``probes`` lists hold.
    """
    spark = df.sparkSession
    usable = df.where((F.size(vec) == dim) & F.col(item).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0))
    rows = usable.select(F.col(item).alias("item"), F.col(vec).cast("array<float>").alias("vec")).select("item", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int").alias("salt"))
    # equal vectors are one representative, the smallest item, with the k + 1 smallest items; partial aggregation keeps a hot one small
    small = lambda c: F.expr(f"slice(array_sort(array_distinct({c})), 1, {k + 1})")
    salted = rows.groupBy("h1", "h2", "salt").agg(small("collect_set(item)").alias("items"), F.first("vec").alias("vec"))
    merged = salted.groupBy("h1", "h2").agg(small("flatten(collect_list(items))").alias("items"), F.first("vec").alias("vec"), F.collect_set("salt").alias("salts"))
    reps = written(merged.select(F.col("items")[0].alias("rep"), "vec", "items", "h1", "h2", "salts"))
    members = rows.select("item", "h1", "h2", "salt").join(reps.select("h1", "h2", F.explode("salts").alias("salt"), "rep"), ["h1", "h2", "salt"]).select("item", "rep").distinct()

    total = reps.count()
    if not total:
        return spark.createDataFrame([], T.StructType([T.StructField("item", df.schema[item].dataType), T.StructField("other", df.schema[item].dataType), T.StructField("cosine", T.DoubleType())]))
    lists = int(max(1, min(lists_most, round(total**0.5))))
    # a fixed draw by hash: the same rows whatever the partitions
    share = min(1.0, 0.97 * sample_most / total)
    drawn = reps.where(F.pmod("h1", F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("rep").select("vec").limit(sample_most).toPandas()
    sample = _units(np.array(drawn["vec"].tolist(), np.float64)) if len(drawn) else np.zeros((0, dim))
    if not len(sample):
        sample = _units(np.array([reps.first()["vec"]], np.float64))
    centres = kmeans(sample, lists)
    # near lists are one group, of about a block of vectors
    hubs = kmeans(centres, max(1, -(-total // block)))
    group_of = (centres @ hubs.T).argmax(1).astype(np.int32)
    index = spark.sparkContext.broadcast((centres.astype(np.float32), group_of))
    n_probe = min(probes, len(centres))

    # every vector in its list, and as a query in the lists that it probes, by group
    kind = reps.schema["rep"].dataType
    ask_type = T.ArrayType(T.StructType([T.StructField("grp", T.IntegerType()), T.StructField("lists", T.ArrayType(T.IntegerType()))]))
    placed_schema = T.StructType([T.StructField("rep", kind), T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("list", T.IntegerType()), T.StructField("grp", T.IntegerType()), T.StructField("ask", ask_type)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, groups = index.value
        for whole in batches:
            for a in range(0, whole.num_rows, 4_096):
                b = whole.slice(a, 4_096)
                s = _units(_matrix(b.column(1), dim)).astype(np.float32) @ c.T
                own = s.argmax(1)
                top = np.argpartition(-s, n_probe - 1, axis=1)[:, :n_probe] if n_probe < s.shape[1] else np.tile(np.arange(s.shape[1]), (b.num_rows, 1))
                # a vector's own list is always among those it probes; its lists are put together by group
                missing = ~(top == own[:, None]).any(1)
                top[missing, -1] = own[missing]
                top = np.take_along_axis(top, groups[top].argsort(1, kind="stable"), 1)
                g = groups[top]
                starts = np.ones(g.shape, bool)
                starts[:, 1:] = g[:, 1:] != g[:, :-1]
                first = np.append(np.flatnonzero(starts.ravel()), g.size).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(g.ravel()[first[:-1]]), pa.ListArray.from_arrays(pa.array(first), pa.array(top.ravel().astype(np.int32)))], names=["grp", "lists"])
                ask = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], starts.sum(1).cumsum())), pa.int32()), parts)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(groups[own]), ask], names=placed_schema.names)

    placed = written(reps.select("rep", "vec").mapInArrow(place, placed_schema))
    # blocks of a group: as many as keep each below the bound, both of what it holds and of what asks it; a row per group
    holding = placed.select(F.col("rep").alias("c_rep"), F.col("vec").alias("c_vec"), F.col("list").alias("c_list"), "grp")
    asking = placed.select(F.col("rep").alias("q_rep"), F.col("vec").alias("q_vec"), F.inline("ask")).withColumnRenamed("lists", "q_lists")
    parts = lambda n: F.ceil(F.col(n) / F.lit(2 * block)).cast("int")
    held_n, ask_n = placed.groupBy("grp").agg(F.count("*").alias("h")), placed.select(F.explode("ask.grp").alias("grp")).groupBy("grp").agg(F.count("*").alias("a"))
    sizes = F.broadcast(held_n.join(ask_n, "grp").select("grp", parts("h").alias("c_parts"), parts("a").alias("q_parts")))
    own = lambda name: F.pmod(F.xxhash64(f"{name}_rep", F.lit(name)), F.col(f"{name}_parts")).cast("int").alias(f"{name}_part")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}_parts") - 1)).alias(f"{name}_part")
    keys = ["grp", "c_part", "q_part"]
    held = holding.join(sizes, "grp").select("grp", own("c"), every("q"), "c_rep", "c_vec", "c_list").groupBy(*keys)
    asked = asking.join(sizes, "grp").select("grp", own("q"), every("c"), "q_rep", "q_vec", "q_lists").groupBy(*keys)
    pair_schema = T.StructType([T.StructField("q", kind), T.StructField("c", kind), T.StructField("cosine", T.DoubleType())])
    rot = spark.sparkContext.broadcast(rotation(dim))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            none = [left.column("q_rep").slice(0, 0), right.column("c_rep").slice(0, 0), pa.array([], pa.float64())]
            return pa.Table.from_arrays(none, names=pair_schema.names)
        q, c = (_units(_matrix(t.combine_chunks(), dim)) for t in (left.column("q_vec"), right.column("c_vec")))
        asks = left.column("q_lists").combine_chunks()
        wanted, who = asks.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(asks.offsets.to_numpy()))
        lists_ = right.column("c_list").to_numpy()
        by_list, by_ask = np.argsort(lists_, kind="stable"), np.argsort(wanted, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for one in np.unique(lists_):
            cs = by_list[slice(*np.searchsorted(lists_[by_list], [one, one + 1]))]
            qs = who[by_ask[slice(*np.searchsorted(wanted[by_ask], [one, one + 1]))]]
            step = max(1, PIECE // len(cs))
            for a in range(0, len(qs), step):
                r, t = scan_block(q[qs[a : a + step]], c[cs], k, least, rot.value)
                found.append((qs[a : a + step][r], cs[t]))
        r, t = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
        cos = np.round(np.einsum("ij,ij->i", q[r], c[t]), 6)
        # the best of this block: more than k + 1 only where the last ones are equal
        order = np.lexsort((-cos, r))
        r, t, cos = r[order], t[order], cos[order]
        first = np.searchsorted(r, np.arange(len(q) + 1))
        rank = np.arange(len(r)) - first[r]
        at = np.minimum(first[r] + k, first[r + 1] - 1)
        ok = ((rank <= k) | (cos >= cos[at])) & (cos >= least)
        return pa.Table.from_arrays([left.column("q_rep").take(pa.array(r[ok])), right.column("c_rep").take(pa.array(t[ok])), pa.array(cos[ok])], names=pair_schema.names)

    pairs = asked.cogroup(held).applyInArrow(scan, pair_schema)
    # representatives back to items: each stands for its k + 1 smallest items, all that can be among someone's k
    near = pairs.join(reps.select(F.col("rep").alias("c"), "items"), "c").select("q", "cosine", F.explode("items").alias("other"))
    best = W.partitionBy("q").orderBy(F.desc("cosine"), F.asc("other"))
    top = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    # an item does not count itself: who is among its own k + 1 takes the others, who is not takes the first k
    own_rows = members.join(top.withColumnRenamed("q", "rep"), "rep").where(F.col("item") != F.col("other"))
    again = W.partitionBy("item").orderBy(F.desc("cosine"), F.asc("other"))
    return own_rows.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k).select("item", "other", "cosine")


def similar_pairs(df: DataFrame, item: str, vec: str, dim: int, k: int = 5, least: float = 0.85, **options: int) -> DataFrame:
    """``item_lo, item_hi``: unordered pairs of which at least one is among the other's ``k`` most similar, with a cosine of at least ``least``."""
    near = nearest(df, item, vec, dim, k, least, **options)
    return near.select(F.least("item", "other").alias("item_lo"), F.greatest("item", "other").alias("item_hi")).distinct()
