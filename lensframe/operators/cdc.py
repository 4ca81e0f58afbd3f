"""Change capture at a boundary: compare snapshots by key and content, and write edits through."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensframe.functions.scalars import row_hash
from lensframe.operators import zset
from lensframe.operators.zset import WEIGHT
from lensframe.session import cut


def poll_diff(known: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """The change from one snapshot to the next: new rows asserted, missing ones retracted, changed ones both. One shuffle per side, on the key."""
    cols = [c for c in snapshot.columns]
    a = known.select(F.col(key).alias("__ka"), F.struct(*cols).alias("old"), row_hash(known, cols).alias("ha"))
    b = snapshot.select(F.col(key).alias("__kb"), F.struct(*cols).alias("new"), row_hash(snapshot, cols).alias("hb"))
    moved = a.join(b, F.col("__ka").eqNullSafe(F.col("__kb")), "full").where(~F.col("ha").eqNullSafe(F.col("hb")))
    both = F.array(F.struct(F.col("old").alias("row"), F.lit(-1).alias("w")), F.struct(F.col("new").alias("row"), F.lit(1).alias("w")))
    return moved.select(F.explode(both).alias("x")).where(F.col("x.row").isNotNull()).select("x.row.*", F.col("x.w").cast("bigint").alias(WEIGHT))


def write_through(table: DataFrame, edit: DataFrame, key: str) -> DataFrame:
    """The table after an edit: asserted rows replace those of their key; a key that is only retracted goes."""
    asserted = edit.where(F.col(WEIGHT) > 0).drop(WEIGHT)
    return _without_keys(table, edit, key).unionByName(asserted.select(*table.columns))


def _without_keys(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key is not among those of ``rows``; a null key is a key."""
    touched = rows.select(F.col(key).alias("__touched")).distinct()
    return table.join(touched, F.col(key).eqNullSafe(F.col("__touched")), "left_anti").select(*table.columns)


@dataclass
class KeyedTable:
    """An external table by key, with what the engine last knew of it.

    A poll after an own write finds nothing new: the write advances what is known.
    """

    rows: DataFrame
    key: str

    def __post_init__(self) -> None:
        self.known = self.rows.limit(0)

    def poll(self) -> DataFrame:
        delta = cut(poll_diff(self.known, self.rows, self.key))
        self.known = self.rows
        return delta

    def write(self, edit: DataFrame) -> DataFrame:
        """Applies an edit; the change to submit at once."""
        edit = cut(edit)
        self.rows = cut(write_through(self.rows, edit, self.key))
        self.known = cut(write_through(self.known, edit, self.key))
        return edit

    def upsert(self, rows: DataFrame) -> None:
        self.rows = cut(_without_keys(self.rows, rows, self.key).unionByName(rows.select(*self.rows.columns)))

    def delete(self, keys: DataFrame) -> None:
        self.rows = cut(_without_keys(self.rows, keys, self.key))

    def get(self, value: object) -> DataFrame:
        return self.rows.where(F.col(self.key).eqNullSafe(F.lit(value)))


def delta_size(delta: DataFrame) -> int:
    return zset.size(delta)
