"""Text chunks and search among vectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a chunk, and from how many on a piece that no longer fits begins the next.
CHUNK, CHUNK_LEAST = 700, 100


def chunks_of(text: str) -> list[str]:
    """A text in chunks of at most ``CHUNK`` bytes, at the ends of sentences, lines and clauses where it can be."""
    whole = text.strip()
    if not whole:
        return []
    if len(whole.encode()) <= CHUNK:
        return [whole]
    out: list[str] = []
    held = ""
    for piece in re.findall(r"[^.\n;]*[.\n;]|[^.\n;]+$", whole):
        if len((held + piece).encode()) > CHUNK and len(held.encode()) > CHUNK_LEAST:
            out.append(held)
            held = ""
        held += piece
        while len(held.encode()) > CHUNK:
            head = held.encode()[:CHUNK].decode(errors="ignore")
            out.append(head)
            held = held[len(head) :]
    out.append(held)
    return [c.strip() for c in out if c.strip()]


def chunk(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, chunk_no, chunk``; null and blank texts give none."""
    schema = T.StructType([df.schema[key], T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, out = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for n, c in enumerate(chunks_of(t or ""), 1):
                    at.append(i)
                    no.append(n)
                    out.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(out, pa.string())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where one is all zero, null where their lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def cosine_topk(query: list[float], store: DataFrame, vec: str, key: str, k: int = 6) -> DataFrame:
    """``key, similarity``: the ``k`` vectors most like a query, ties by key; the query is a literal, so nothing is shuffled but the tops of the partitions."""
    q = F.array(*(F.lit(float(x)) for x in query))
    like = F.round(cosine(F.col(vec), q), 5)
    return store.select(key, like.alias("similarity")).where("similarity is not null").orderBy(F.desc("similarity"), key).limit(k)


def _top_of_block(k: int, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def top(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """Each query's ``k`` best rows of the block; vectors meet those of their own length only."""
        order = np.argsort(np.array(rows.column(names[1]).to_pylist(), object), kind="stable")  # equal ones rank by key
        by_size: dict[int, tuple[list, list]] = {}
        for side, table, at in ((0, queries, range(queries.num_rows)), (1, rows, order)):
            vectors = table.column("__v").to_pylist()
            for i in at:
                by_size.setdefault(len(vectors[i]), ([], []))[side].append((i, vectors[i]))
        ask, found, likes = [], [], []
        for q, r in by_size.values():
            if not q or not r:
                continue
            a, b = (np.array([v for _, v in x], np.float64).reshape(len(x), -1) for x in (q, r))
            norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
            like = np.round(np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm != 0), 5)
            rank = np.where(np.isnan(like), np.inf, like)
            least = np.partition(rank, len(r) - k, axis=1)[:, len(r) - k] if len(r) > k else np.full(len(q), -np.inf)
            i, j = np.nonzero(rank >= least[:, None])
            best = np.lexsort((j, -rank[i, j], i))
            i, j = i[best], j[best]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            ask += [q[x][0] for x in i[keep]]
            found += [r[x][0] for x in j[keep]]
            likes.append(like[i[keep], j[keep]])
        columns = [queries.column(names[0]).take(pa.array(ask, pa.int64())), rows.column(names[1]).take(pa.array(found, pa.int64())), pa.array(np.concatenate(likes) if likes else [], pa.float64())]
        return pa.table(columns, names=names)

    return top


def cosine_topk_each(queries: DataFrame, store: DataFrame, vec: str, key: str, k: int = 6, block: int = 2_048) -> DataFrame:
    """``query, key, similarity``: for every row of ``queries`` (``key``, ``vec``) the ``k`` rows of ``store`` most like it, as in ``cosine_topk``.

    Every query meets every row: both sides are cut into blocks of about ``block`` vectors, each pair of blocks gives its best, and of those the ``k`` best are
    kept. A row that is a query too is among its own. Missing vectors and such with missing numbers take part on neither side.
    """
    whole = F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())
    q, s = queries.where(whole).select(F.col(key).alias("query"), F.col(vec).alias("__v")), store.where(whole).select(key, F.col(vec).alias("__v"))
    parts = [max(1, -(-df.count() // block)) for df in (q, s)]
    grid = [
        df.withColumn(own, F.pmod(F.xxhash64(name), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint"))))
        for df, name, own, other, n, m in ((q, "query", "__a", "__b", *parts), (s, key, "__b", "__a", *parts[::-1]))
    ]
    names = ["query", key, "similarity"]
    schema = T.StructType([q.schema["query"], s.schema[key], T.StructField("similarity", T.DoubleType())])
    tops = grid[0].groupBy("__a", "__b").cogroup(grid[1].groupBy("__a", "__b")).applyInArrow(_top_of_block(k, names), schema)
    best = W.partitionBy("query").orderBy(F.desc("similarity"), key)
    return tops.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k).drop("__n")


def not_yet_embedded(docs: DataFrame, store: DataFrame, key: str, source: str = "source") -> DataFrame:
    """Documents that the store has no chunk of."""
    return docs.join(store.select(F.col(source).alias(key)).distinct(), key, "left_anti")


STORE = "source string, text string, vec array<float>"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``source, text, vec`` of a store of chunks; one that is not there yet is empty."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(STORE).json(path) if there else spark.createDataFrame([], STORE)


def append_store(chunks: DataFrame, path: str) -> None:
    """Adds chunks (``source, text, vec``) of sources that the store has not yet; such without a vector are left out."""
    new = not_yet_embedded(chunks, read_store(chunks.sparkSession, path), "source")
    new.where(F.size("vec") > 0).select("source", "text", "vec").write.mode("append").json(path)
