"""Lenses: small transformations over Z-sets with a forward direction, over states or deltas, and a backward one.

``forward(*states)`` maps whole inputs. ``delta(deltas, states)`` maps changes, with the inputs' states after the change.
``backward(edit, states)`` gives the changes of the inputs that an edit of the output stands for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lensframe.operators import zset
from lensframe.operators.zset import WEIGHT


class NotInvertible(ValueError):
    """The lens has no backward direction."""


class Lens:
    arity = 1
    backward_kind = "k4"
    #: Whether a change's output is made row by row, so that nothing is gained by writing it; and whether it always has as many rows.
    rowwise, same_size = False, False
    #: Whether a change is made with the output before, and whether all inputs must have rows for the output to have any.
    uses_own, needs_all = False, False

    def forward(self, *states: DataFrame) -> DataFrame:
        raise NotImplementedError

    def memory(self, z: DataFrame) -> DataFrame | None:
        """What the lens keeps of its input, as a Z-set made of the input's; None if it needs the input itself."""
        return None

    def delta(self, deltas: Sequence[DataFrame | None], states: Sequence[DataFrame], own: DataFrame | None = None) -> DataFrame:
        """The output's change. ``states`` are the inputs' (or the lens's memory) after the change, as sums of changes that need not be consolidated; a delta that
        is None changes nothing; ``own`` is the output before. Row-wise lenses map a change like a state."""
        return self.forward(*deltas)

    def backward(self, edit: DataFrame, states: Sequence[DataFrame]) -> list[DataFrame]:
        raise NotInvertible(type(self).__name__)


@dataclass
class Calibrate(Lens):
    """A numeric field plus an offset; a null counts as 0."""

    field: str
    offset: float
    backward_kind = "k1"
    rowwise = same_size = True

    def _moved(self, z: DataFrame, by: float) -> DataFrame:
        base = F.coalesce(zset.get(z, self.field, F.lit(0.0)), F.lit(0.0))
        return z.withColumn(self.field, base + F.lit(by))

    def _shift(self, z: DataFrame, by: float) -> DataFrame:
        return zset.consolidate(self._moved(z, by))

    def delta(self, deltas: Sequence[DataFrame | None], states: Sequence[DataFrame], own: DataFrame | None = None) -> DataFrame:
        """Row by row; only a null and a 0 become equal, and their weights add up where the change is summed."""
        return self._moved(deltas[0], self.offset)

    def forward(self, *states: DataFrame) -> DataFrame:
        return self._shift(states[0], self.offset)

    def backward(self, edit: DataFrame, states: Sequence[DataFrame]) -> list[DataFrame]:
        return [self._shift(edit, -self.offset)]


@dataclass
class Filter(Lens):
    """Rows for which a predicate is true; an edit passes back as it is."""

    predicate: Column
    backward_kind = "k1"
    rowwise = True

    def forward(self, *states: DataFrame) -> DataFrame:
        return states[0].where(self.predicate)

    def backward(self, edit: DataFrame, states: Sequence[DataFrame]) -> list[DataFrame]:
        return [edit]


@dataclass
class Map(Lens):
    """A row-wise transformation of a table without weight, given as a function on DataFrames that keeps other columns."""

    name: str
    fn: Callable[[DataFrame], DataFrame]
    inverse: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self) -> None:
        self.backward_kind = "k1" if self.inverse else "k4"

    def forward(self, *states: DataFrame) -> DataFrame:
        return zset.consolidate(self.fn(states[0]))

    def backward(self, edit: DataFrame, states: Sequence[DataFrame]) -> list[DataFrame]:
        if self.inverse is None:
            raise NotInvertible(self.name)
        return [zset.consolidate(self.inverse(edit))]


@dataclass
class Join(Lens):
    """Inner equi-join; a null key meets a null key. Output: left fields, the key, the right fields with a prefix (the later wins a clash)."""

    left_key: str
    right_key: str
    left_fields: Sequence[str]
    right_fields: Sequence[str]
    prefix: str = ""
    arity = 2
    backward_kind = "k3"
    needs_all = True

    def forward(self, *states: DataFrame) -> DataFrame:
        a, b = states
        right = {self.prefix + f: f"__r_{f}" for f in self.right_fields}
        left_side = a.select(*(F.col(f"`{f}`").alias(f"__l_{f}") for f in dict.fromkeys([*self.left_fields, self.left_key])), F.col(WEIGHT).alias("__lw"))
        right_side = b.select(F.col(f"`{self.right_key}`").alias("__rk"), *(F.col(f"`{f}`").alias(f"__r_{f}") for f in dict.fromkeys(self.right_fields)), F.col(WEIGHT).alias("__rw"))
        joined = left_side.join(right_side, F.col(f"__l_{self.left_key}").eqNullSafe(F.col("__rk")))
        out = {f: F.col(f"`__l_{f}`") for f in self.left_fields} | {self.left_key: F.col(f"`__l_{self.left_key}`")} | {n: F.col(f"`{c}`") for n, c in right.items()}
        return zset.consolidate(joined.select(*(c.alias(n) for n, c in out.items()), (F.col("__lw") * F.col("__rw")).alias(WEIGHT)))

    def delta(self, deltas: Sequence[DataFrame | None], states: Sequence[DataFrame], own: DataFrame | None = None) -> DataFrame:
        """Both states are after the change, so what both sides changed is counted twice and taken off once. A side without change is not joined from."""
        da, db = deltas
        a, b = states
        if da is None or db is None:
            return self.forward(da, b) if db is None else self.forward(a, db)
        twice = self.forward(da, b).unionByName(self.forward(a, db))
        return zset.minus(twice, self.forward(da, db))

    def backward(self, edit: DataFrame, states: Sequence[DataFrame]) -> list[DataFrame]:
        """The edited row as each side sees it; a side whose old and new rows are equal nets to nothing."""
        left = zset.select(edit, *(F.col(f"`{f}`") for f in dict.fromkeys([self.left_key, *self.left_fields])))
        cols = {self.right_key: F.col(f"`{self.left_key}`")} | {f: F.col(f"`{self.prefix}{f}`") for f in self.right_fields}
        return [left, zset.select(edit, *(c.alias(n) for n, c in cols.items()))]


@dataclass
class Count(Lens):
    """The signed number of rows per value of a field; values with none are left out."""

    group: str
    name: str = "count"

    def forward(self, *states: DataFrame) -> DataFrame:
        counted = states[0].groupBy(F.col(f"`{self.group}`")).agg(F.sum(WEIGHT).cast("bigint").alias(self.name))
        return counted.where(F.col(f"`{self.name}`") > 0).withColumn(WEIGHT, F.lit(1).cast("bigint"))

    def memory(self, z: DataFrame) -> DataFrame:
        """The signed number of rows per group, as weights."""
        return zset.select(z, F.col(f"`{self.group}`"))

    def delta(self, deltas: Sequence[DataFrame | None], states: Sequence[DataFrame], own: DataFrame | None = None) -> DataFrame:
        """Only groups that the change touches: the old count retracted, the new one asserted."""
        moved = deltas[0].groupBy(F.col(f"`{self.group}`").alias("__g")).agg(F.sum(WEIGHT).alias("__d")).where(F.col("__d") != 0)
        kept = states[0].select(F.col(f"`{self.group}`").alias("__key"), F.col(WEIGHT).alias("__w"))
        now = kept.join(moved.select("__g"), F.col("__key").eqNullSafe(F.col("__g"))).groupBy(F.col("__g").alias("__k")).agg(F.sum("__w").alias("__s"))
        found = moved.join(now, F.col("__k").eqNullSafe(F.col("__g")), "left").withColumn("__n", F.coalesce("__s", F.lit(0)))
        both = found.select(
            F.col("__g").alias(self.group),
            F.explode(F.array(F.struct((F.col("__n") - F.col("__d")).alias("n"), F.lit(-1).alias("w")), F.struct(F.col("__n").alias("n"), F.lit(1).alias("w")))).alias("x"),
        )
        return both.where(F.col("x.n") > 0).select(self.group, F.col("x.n").cast("bigint").alias(self.name), F.col("x.w").cast("bigint").alias(WEIGHT))


@dataclass
class TopK(Lens):
    """The first ``k`` distinct rows by a field (null counts as 0), whatever their weights; ties by the ``tie`` fields."""

    field: str
    k: int
    descending: bool = True
    tie: Sequence[str] = ()
    uses_own = True

    def forward(self, *states: DataFrame) -> DataFrame:
        by = F.coalesce(F.col(f"`{self.field}`"), F.lit(0))
        order = [by.desc() if self.descending else by.asc(), *(F.col(f"`{t}`").asc() for t in self.tie)]
        return zset.support(states[0]).orderBy(*order).limit(self.k).withColumn(WEIGHT, F.lit(1).cast("bigint"))

    def delta(self, deltas: Sequence[DataFrame | None], states: Sequence[DataFrame], own: DataFrame | None = None) -> DataFrame:
        """With its own output before, rows that only come are ranked with those at the top; only a row that goes may bring up one from below."""
        if own is None:
            own = self.forward(zset.consolidate(zset.minus(states[0], deltas[0])))
        elif deltas[0].where(F.col(WEIGHT) < 0).isEmpty():
            rows = zset.fields(states[0])
            same = [states[0][c].eqNullSafe(F.col(f"__d_{c}")) for c in rows]
            came = states[0].join(deltas[0].select(*(F.col(f"`{c}`").alias(f"__d_{c}") for c in rows)), reduce(lambda x, y: x & y, same), "left_semi")
            return zset.minus(self.forward(zset.consolidate(zset.distinct(zset.consolidate(came)).unionByName(own))), own)
        return zset.minus(self.forward(zset.consolidate(states[0])), own)


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; the limit is applied before the shuffle as well."""
    w = W.partitionBy(F.col(f"`{group}`")).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")
