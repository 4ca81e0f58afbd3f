"""Schemas that drift between files: one steady table per series of files, and each change reported.

File headers are read in parallel as rows, folded through a type-promotion lattice to one union schema
per series, and compared with the file before. The order of a series is found without putting a long series into
one task: files are ordered within time slices, and a slice's first file takes its forerunner from a table
with one row per slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensframe.session import cut

#: The lattice. A type is a set of bits, a join of types is the union; each union has one promoted type.
TYPE_BITS = {"long": 1, "double": 2, "date time": 4, "string": 8}
#: Words that qualify a description without naming another curve.
QUALIFIERS = ("corrected", "curve", "smoothed", "avg", "average", "raw", "filtered", "memory", "real", "time", "mem", "rt")
#: How files say that a reading is absent.
ABSENT = ("", "-999.25", "-999.2500", "-999", "-9999", "-999.0", "n/a", "na", "nan", "null", "none", "--")


def type_bits(kind: Column) -> Column:
    """The lattice element of a type name; null for a missing or unknown one, which promotes nothing."""
    k = F.lower(F.trim(kind))
    out = F.lit(None).cast("int")
    for name, bit in TYPE_BITS.items():
        out = F.when(k == name, F.lit(bit)).otherwise(out)
    return out


def promoted(bits: Column) -> Column:
    """The least type that holds all types of a union: long < double < string, date time < string; all missing is string."""
    return (
        F.when(bits.isNull(), "string")
        .when(bits == 1, "long")
        .when(bits.isin(2, 3), "double")
        .when(bits == 4, "date time")
        .otherwise("string")
    )


def with_previous(files: DataFrame, series: str, at: str, file: str, slice_days: int = 1, slice_files: int = 4_096) -> DataFrame:
    """``files`` (one row per file) with ``prev_file``: the file before in the same series by (``at``, ``file``), null for its first.

    Slices of ``slice_days`` days bound the rows of a task; a series has one row per slice that holds any of its files.
    A file whose time is null comes before all others; such are sliced by their numbers, ``slice_files`` at a time, where files have numbers.
    """
    timeless = F.lit(-(2**40))
    if isinstance(files.schema[file].dataType, T.IntegralType):
        timeless = timeless - F.lit(2**50) + F.floor(F.col(file) / slice_files)
    sliced = files.withColumn("__slice", F.coalesce(F.floor(F.unix_seconds(F.col(at)) / (86_400 * slice_days)), timeless))
    order = [F.col(at).asc_nulls_first(), F.col(file).asc()]
    w = W.partitionBy(series, "__slice").orderBy(*order)
    inner = sliced.withColumn("__prev", F.lag(file).over(w))
    key = F.struct(F.coalesce(F.col(at), F.timestamp_seconds(F.lit(-(2**40)))), F.col(file))
    edges = (
        sliced.groupBy(series, "__slice")
        .agg(F.max_by(file, key).alias("__last"))
        .withColumn("__before", F.lag("__last").over(W.partitionBy(series).orderBy("__slice")))
        .select(series, "__slice", "__before")
    )
    return (
        inner.join(edges, [series, "__slice"])
        .withColumn("prev_file", F.coalesce("__prev", "__before"))
        .drop("__slice", "__prev", "__before")
    )


def _core(text: str | None) -> frozenset[str]:
    return frozenset(w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if w not in QUALIFIERS)


def match_columns(old: list[tuple], new: list[tuple], steady_uid: bool, meaning: dict[str, str]) -> list[tuple[tuple | None, tuple | None]]:
    """Pairs of the same column in two headers; one side is None for what was added or removed.

    A column is ``(uid, name, description, unit, kind, position)`` with cleaned texts. With ``steady_uid`` the uid alone tells. Otherwise
    equal names are the same column, and what is left on both sides is paired when it measures the same: the descriptions have the same core
    (of a missing one, the core that ``meaning`` gives the name), most alike first: equal unit, kind, place.
    """
    if steady_uid:
        by = {c[0]: c for c in new}
        old_ids = {c[0] for c in old}
        return [(c, by.get(c[0])) for c in old] + [(None, c) for c in new if c[0] not in old_ids]
    by = {c[1]: c for c in new}
    pairs: list[tuple[tuple | None, tuple | None]] = [(c, by[c[1]]) for c in old if c[1] in by]
    names = {c[1] for c in old}
    gone, come = [c for c in old if c[1] not in by], [c for c in new if c[1] not in names]
    if gone and come:
        cores = {c[1]: _core(c[2]) or _core(meaning.get(c[1])) for c in (*gone, *come)}
        usual = {c[1]: _core(meaning.get(c[1])) for c in (*gone, *come)}
        ranked = []
        for i, a in enumerate(gone):
            for j, b in enumerate(come):
                x, y = cores[a[1]], cores[b[1]]
                if not x or not y:
                    continue
                if x == y or usual[a[1]] and usual[a[1]] == usual[b[1]]:
                    ranked.append((-(2 * (x == y) + (a[3] == b[3]) + (a[4] == b[4])), abs(a[5] - b[5]), i, j))
        used_a: set[int] = set()
        used_b: set[int] = set()
        for _, _, i, j in sorted(ranked):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                pairs.append((gone[i], come[j]))
        gone = [c for i, c in enumerate(gone) if i not in used_a]
        come = [c for j, c in enumerate(come) if j not in used_b]
    return pairs + [(c, None) for c in gone] + [(None, c) for c in come]


def _clean(c: str) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.col(c), r"[\s ]+", " ")))


def headers(curves: DataFrame) -> DataFrame:
    """One row per file: ``uidlog, file_id, dtimcreation, cols`` with its header as an array in order of position; repeated rows count once.

    A header's width bounds the array. A column without a name is left out.
    """
    clean = curves.where(F.col("uidlog").isNotNull() & F.col("file_id").isNotNull() & (F.trim("mnemonic") != "")).select(
        "uidlog",
        "file_id",
        "dtimcreation",
        F.struct(
            F.coalesce(F.col("curve_no"), F.lit(0)).alias("position"),
            _clean("uid").alias("uid"),
            _clean("mnemonic").alias("name"),
            F.lower(F.trim("curvedescription")).alias("description"),
            F.lower(F.trim("unit")).alias("unit"),
            F.nullif(F.lower(F.trim("typelogdata")), F.lit("")).alias("kind"),
        ).alias("c"),
    )
    return clean.groupBy("uidlog", "file_id").agg(F.min(F.col("dtimcreation").cast("timestamp")).alias("dtimcreation"), F.array_sort(F.collect_set("c")).alias("cols"))


def series_facts(files: DataFrame) -> DataFrame:
    """``uidlog, steady_uid``: whether the uid names a curve for good in that series.

    It does not where it only repeats the name or counts the position in the header, or is missing or used twice in a file.
    """
    cols = files.select(
        "uidlog",
        F.exists("cols", lambda c: c["uid"].isNull() | (c["uid"] == "")).alias("missing"),
        (F.size(F.array_distinct(F.transform("cols", lambda c: c["uid"]))) < F.size("cols")).alias("twice"),
        F.size(F.filter("cols", lambda c: c["uid"] == c["name"])).alias("as_name"),
        F.size(F.filter("cols", lambda c: F.regexp_extract(c["uid"], r"^\D*?0*(\d+)$", 1) == c["position"].cast("string"))).alias("as_place"),
        F.size("cols").alias("n"),
    )
    total = cols.groupBy("uidlog").agg(
        F.max("missing").alias("missing"), F.max("twice").alias("twice"), F.sum("as_name").alias("as_name"), F.sum("as_place").alias("as_place"), F.sum("n").alias("n")
    )
    return total.select(
        "uidlog", (~F.col("missing") & ~F.col("twice") & (F.col("as_name") < 0.9 * F.col("n")) & (F.col("as_place") < 0.9 * F.col("n"))).alias("steady_uid")
    )


def meanings(files: DataFrame) -> DataFrame:
    """``name, meaning``: the most frequent description of each column name over all files (ties: the smaller one)."""
    seen = files.select(F.explode("cols").alias("c")).where(F.col("c.description") != "").groupBy(F.col("c.name").alias("name"), F.col("c.description").alias("d")).count()
    return seen.groupBy("name").agg(F.max_by("d", F.struct("count", F.expr("-length(d)"), "d")).alias("meaning"))


def changes(curves: DataFrame) -> DataFrame:
    """``uidlog, file_id, change, mnemonic``: each difference between a file's header and the header of the file before in its series.

    ``change`` is added, removed, renamed or retyped. Case, outer blanks, order, unit and description alone are no change; a missing type
    says nothing. A series with one file, an empty table and rows without series, file or name give nothing.
    """
    files = headers(curves)
    ordered = with_previous(files.select("uidlog", "file_id", "dtimcreation"), "uidlog", "dtimcreation", "file_id")
    bare = files.select("uidlog", "file_id", "cols")
    pairs = (
        ordered.where(F.col("prev_file").isNotNull())
        .select("uidlog", "file_id", "prev_file")
        .join(bare, ["uidlog", "file_id"])
        .join(bare.select("uidlog", F.col("file_id").alias("prev_file"), F.col("cols").alias("prev_cols")), ["uidlog", "prev_file"])
        .join(_handy(series_facts(files)), "uidlog")
    )
    # headers that are equal in all that counts need no comparing
    sig = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(x["uid"], x["name"], x["kind"])))
    pairs = pairs.where(sig("cols") != sig("prev_cols"))
    # the meanings of the few names that only one of the two headers has
    both = pairs.withColumn(
        "loose", F.array_union(F.array_except(F.transform("cols", lambda c: c["name"]), F.transform("prev_cols", lambda c: c["name"])), F.array_except(F.transform("prev_cols", lambda c: c["name"]), F.transform("cols", lambda c: c["name"])))
    )
    loose = both.where(~F.col("steady_uid")).select("uidlog", "file_id", F.explode("loose").alias("name"))
    meant = loose.join(meanings(files), "name").groupBy("uidlog", "file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "meaning"))).alias("meant"))
    return _compare(both.drop("loose", "prev_file").join(meant, ["uidlog", "file_id"], "left"))


#: Rows of a small table up to which it is handed to all tasks.
SMALL = 200_000


def _handy(df: DataFrame) -> DataFrame:
    """A table of one row per series, written and counted: handed to all tasks if it is small, so that a long series is not one task's work in a join."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def _compare(pairs: DataFrame) -> DataFrame:
    schema = T.StructType([pairs.schema["uidlog"], pairs.schema["file_id"], T.StructField("change", T.StringType()), T.StructField("mnemonic", T.StringType())])
    order = ("uid", "name", "description", "unit", "kind", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.select(["uidlog", "file_id", "cols", "prev_cols", "steady_uid", "meant"]).to_pylist():
                old = [tuple(c[k] for k in order) for c in r["prev_cols"]]
                new = [tuple(c[k] for k in order) for c in r["cols"]]
                for a, b in match_columns(old, new, r["steady_uid"], dict(r["meant"] or ())):
                    if a is None:
                        out.append((r["uidlog"], r["file_id"], "added", b[1]))
                    elif b is None:
                        out.append((r["uidlog"], r["file_id"], "removed", a[1]))
                    else:
                        if a[1] != b[1]:
                            out.append((r["uidlog"], r["file_id"], "renamed", b[1]))
                        # elements of the lattice, so that spellings of one type are no change; types that it does not know by name
                        if a[4] and b[4] and TYPE_BITS.get(a[4], a[4]) != TYPE_BITS.get(b[4], b[4]):
                            out.append((r["uidlog"], r["file_id"], "retyped", b[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field(n).type if n in ("uidlog", "file_id") else pa.string()) for x, n in zip(zip(*out), schema.names)], names=schema.names)

    return pairs.mapInArrow(run, schema)


def union_schema(curves: DataFrame) -> DataFrame:
    """``uidlog, mnemonic, kind, files``: the names in a series' headers, each with the type that all its types promote to (by curve: ``steady_schema``)."""
    cols = headers(curves).select("uidlog", F.explode("cols").alias("c"))
    return cols.groupBy("uidlog", F.col("c.name").alias("mnemonic")).agg(promoted(F.bit_or(type_bits(F.col("c.kind")))).alias("kind"), F.count("*").alias("files"))


#: Marks what tells apart several columns of one name in one header, and several curves that began under one name.
_AGAIN = "#"


def _told_apart(names: Iterable[str], taken: set[str]) -> list[str]:
    """The names, each made unlike all others and those taken by a number."""
    out = []
    for name in names:
        n, label = 1, name
        while label in taken:
            n += 1
            label = f"{name}{_AGAIN}{n}"
        taken.add(label)
        out.append(label)
    return out


class _Curves:
    """The curves of one series while its headers are read in order: each column goes on with a curve or begins one.

    A column that is not in the header before goes on with the curve that was last seen under its name and is in no header since, if there is one.
    """

    def __init__(self, steady_uid: bool, meaning: dict[str, str]):
        self.steady_uid, self.meaning = steady_uid, meaning
        self.labels: set[str] = set()
        self.by_uid: dict[str, str] = {}
        self.last: list[tuple] = []
        self.now: dict[str, str] = {}  # name in the last header -> curve
        self.gone: dict[str, list[str]] = {}  # last name -> curves that ended, the latest last

    def read(self, header: list[tuple]) -> list[str]:
        """The curve of each column; columns as in ``match_columns``."""
        if self.steady_uid:
            fresh = [c for c in header if c[0] not in self.by_uid]
            self.by_uid |= dict(zip((c[0] for c in fresh), _told_apart((c[1] for c in fresh), self.labels)))
            return [self.by_uid[c[0]] for c in header]
        header = [(c[0], n, *c[2:]) for c, n in zip(header, _told_apart((c[1] for c in header), set()))]
        if header != self.last:
            now: dict[str, str] = {}
            born = []
            for a, b in match_columns(self.last, header, False, self.meaning):
                if b is None:
                    self.gone.setdefault(a[1], []).append(self.now[a[1]])
                elif a is None:
                    born.append(b)
                else:
                    now[b[1]] = self.now[a[1]]
            for c in born:
                ended = self.gone.get(c[1])
                now[c[1]] = ended.pop() if ended else _told_apart([c[1]], self.labels)[0]
            self.last, self.now = header, now
        return [self.now[c[1]] for c in header]


def curve_columns(curves: DataFrame) -> DataFrame:
    """``uidlog, file_id, cell_no, mnemonic, type, curve``: each column of each file with the curve it holds, the same in all files of a series.

    ``curve`` is the name under which the curve began, with a number if another one of the series did so before. Columns are the same curve as in ``changes``;
    besides, one that was away goes on under its name. A series is read in order by one task, which holds no more than its latest header and its curves.
    """
    files = headers(curves)
    names = files.select("uidlog", F.explode("cols").alias("c")).select("uidlog", F.col("c.name").alias("name")).distinct()
    meant = names.join(meanings(files), "name").groupBy("uidlog").agg(F.map_from_entries(F.collect_list(F.struct("name", "meaning"))).alias("meant"))
    facts = series_facts(files).join(meant, "uidlog", "left")
    rows = files.withColumn("rank", F.lit(1)).unionByName(facts.withColumn("rank", F.lit(0)), allowMissingColumns=True)
    ordered = rows.repartition("uidlog").sortWithinPartitions("uidlog", "rank", F.asc_nulls_first("dtimcreation"), "file_id")
    schema = T.StructType([files.schema["uidlog"], files.schema["file_id"], *(T.StructField(n, T.IntegerType() if n == "cell_no" else T.StringType()) for n in ("cell_no", "mnemonic", "type", "curve"))])
    order = ("uid", "name", "description", "unit", "kind", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Curves(False, {})
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["rank"] == 0:
                    state = _Curves(r["steady_uid"], dict(r["meant"] or ()))
                    continue
                header = [tuple(c[k] for k in order) for c in r["cols"]]
                out.extend((r["uidlog"], r["file_id"], c[5], c[1], c[4], curve) for c, curve in zip(header, state.read(header)))
            if out:
                kinds = [batch.schema.field("uidlog").type, batch.schema.field("file_id").type, pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=schema.names)

    return ordered.mapInArrow(run, schema)


def steady_schema(columns: DataFrame) -> DataFrame:
    """``uidlog, curve, mnemonics, kind, files`` of ``curve_columns``: one row per curve of a series, all names it has, the type that all its types promote to."""
    return columns.groupBy("uidlog", "curve").agg(
        F.array_sort(F.collect_set("mnemonic")).alias("mnemonics"), promoted(F.bit_or(type_bits(F.col("type")))).alias("kind"), F.countDistinct("file_id").alias("files")
    )


def unified_rows(curves: DataFrame, lines: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """The data lines of all files under the steady schema: ``uidlog, file_id, line_no, curve, mnemonic, kind, as_long, as_double, as_time, as_text``.

    ``curve`` is the same in all files of a series, ``mnemonic`` is the file's name for it. The values are cast to the curve's promoted type: long fills ``as_long``
    (exactly) and ``as_double``, double ``as_double``, date time ``as_time``, and string ``as_text``. A reading marked as absent, blank, or not of the type gives no value (a row with nulls). Cells
    beyond the header are left out. Repeated lines count once. ``columns`` is ``curve_columns`` of the same curves, if it is there already.
    """
    columns = cut(curve_columns(curves)) if columns is None else columns
    names = columns.drop("type").join(steady_schema(columns).select("uidlog", "curve", "kind"), ["uidlog", "curve"])
    cells = lines.where(F.col("cells").isNotNull()).select("file_id", "line_no", "cells").dropDuplicates().select("file_id", "line_no", F.posexplode(F.split("cells", ",")).alias("p", "cell"))
    joined = cells.withColumn("cell_no", F.col("p") + 1).join(names, ["file_id", "cell_no"])
    bare = F.trim("cell")
    value = F.when(~F.lower(bare).isin(*ABSENT), bare)
    number = F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value).try_cast("double")
    return joined.select(
        "uidlog", "file_id", "line_no", "curve", "mnemonic", "kind",
        F.when(F.col("kind") == "long", F.coalesce(value.try_cast("bigint"), F.when(number == F.floor(number), number.cast("bigint")))).alias("as_long"),
        F.when(F.col("kind").isin("long", "double"), number).alias("as_double"),
        F.when(F.col("kind") == "date time", F.try_to_timestamp(value)).alias("as_time"),
        F.when(F.col("kind") == "string", value).alias("as_text"),
    )


def wide(rows: DataFrame, columns: Iterable[tuple[str, str]]) -> DataFrame:
    """``unified_rows`` with one typed column per (curve, kind) of ``columns``, in their order: the steady table of one or several series."""
    field = {"long": "as_long", "double": "as_double", "date time": "as_time", "string": "coalesce(as_text, cast(as_long as string), cast(as_double as string), cast(as_time as string))"}
    keys = ("uidlog", "file_id", "line_no")
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col("curve") == n, F.expr(field[k]))).alias(f"curve_{n.lower()}" if n.lower() in keys else n.lower()) for n, k in columns))


def steady_table(curves: DataFrame, lines: DataFrame) -> DataFrame:
    """The one table of all series: ``uidlog, file_id, line_no`` and a typed column per curve name, the same in all files.

    A column's type is what the types of all curves of that name promote to, over all series; its name is in lower case. One row per name is collected. A curve
    without a reading has its column too; with no curves at all only the keys are left.
    """
    columns = cut(curve_columns(curves))
    bits = F.bit_or(type_bits(F.col("kind")))
    names = [(r["curve"], r["kind"]) for r in steady_schema(columns).groupBy("curve").agg(promoted(bits).alias("kind")).orderBy("curve").collect()]
    rows = unified_rows(curves, lines, columns)
    return wide(rows, names) if names else rows.select("uidlog", "file_id", "line_no").limit(0)
