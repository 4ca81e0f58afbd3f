"""Schema profiling: what each column is, as claims (source, field, fact, value) that fold to the last one.

Profiles read the set of a table's rows. All columns are judged in one aggregation; nothing is sampled unless a limit is asked for.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensframe.functions.scalars import code_mask, digit_mask, half_up, is_empty
from lensframe.operators.zset import support_of

#: The facts of a field's claims, in the order in which they are shown.
FACTS = ("type", "role", "title", "description", "unit", "values", "pattern", "empty", "ref", "refs", "value", "overlap")
#: Bounds of the rules.
ENUM_LEAST, ENUM_MOST, ENUM_REPEAT, ENUM_SHOWN = 2, 12, 3, 8
PATTERN_LEAST, PATTERN_SHARE, PREFIX_SHARE, PREFIX_LENGTH, PREFIX_CLUSTER = 5, 0.6, 0.5, 4, 6
REDUNDANT, NEARLY_SAME, CONTAINED, REF_LEAST = 0.6, 0.98, 0.95, 3

CLAIMS = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "field", "fact", "value")])


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "string"
    return "object"


def column_facts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``field, rows, filled, distinct, any_value`` per column, in one pass: a row per (column, value) count would be shuffled once for all."""
    names = columns or df.columns
    parts = []
    for n in names:
        c, kind = F.col(f"`{n}`"), df.schema[n].dataType
        text = c.cast("string") if not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(c)
        parts.append(F.struct(F.lit(n).alias("field"), F.when(~is_empty(c, kind), text).alias("v")))
    long = df.select(F.explode(F.array(*parts)).alias("x")).groupBy("x.field", "x.v").agg(F.count("*").alias("n"))
    return long.groupBy("field").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.count("v").alias("distinct"), F.min("v").alias("any_value")
    )


def empty_percent(rows: Column, filled: Column) -> Column:
    """Whole percent of empty cells, at least 1 if there are any."""
    missing = rows - filled
    return F.when(missing == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), half_up(F.lit(100.0) * missing / rows))).cast("int")


def columns_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``field, type, rows, filled, distinct, empty_pct, role``: role is key, constant, enum or null."""
    kinds = F.create_map(*(x for n in (columns or df.columns) for x in (F.lit(n), F.lit(type_name(df.schema[n].dataType)))))
    f = column_facts(support_of(df), columns).withColumn("type", kinds[F.col("field")])
    key = (F.col("filled") == F.col("rows")) & (F.col("distinct") == F.col("rows"))
    enum = (F.col("type") == "string") & F.col("distinct").between(ENUM_LEAST, ENUM_MOST) & (F.col("filled") >= ENUM_REPEAT * F.col("distinct"))
    role = F.when(key, "key").when(F.col("distinct") == 1, "constant").when(enum, "enum")
    shown_type = F.when(F.col("filled") == 0, "empty").otherwise(F.col("type"))
    return f.select("field", shown_type.alias("type"), "rows", "filled", "distinct", empty_percent(F.col("rows"), F.col("filled")).alias("empty_pct"), role.alias("role"), "any_value")


def enum_values(df: DataFrame, field: str, arrival: str | None = None) -> DataFrame:
    """``value, n, first_seen``: the values of a column, by first arrival (or by value where there is no arrival column)."""
    c = F.col(f"`{field}`").cast("string")
    by = F.min(arrival) if arrival else F.min(c)
    return df.where(c.isNotNull() & (c != "")).groupBy(c.alias("value")).agg(F.count("*").alias("n"), by.alias("first_seen"))


def patterns(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, pattern, coverage``: the form that most values of a text column have.

    First with digits masked, then with capitals masked too: the most frequent form holds if it has a mask and covers 60 %. Else a prefix of the
    digit-masked values, as long as all of the largest group of equal six-character prefixes share it, covers half.
    """
    one = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").cast("string").alias("v")) for n in fields))).alias("x")).select("x.*").where("v <> ''")
    masked = one.select("field", digit_mask(F.col("v")).alias("m1"), code_mask(F.col("v")).alias("m2"))
    counts = masked.groupBy("field", "m1", "m2").agg(F.count("*").alias("n"))
    total = counts.groupBy("field").agg(F.sum("n").alias("total")).where(F.col("total") >= PATTERN_LEAST)

    def best(form: str, tier: int) -> DataFrame:
        g = counts.groupBy("field", F.col(form).alias("form")).agg(F.sum("n").alias("n"))
        top = g.groupBy("field").agg(F.max_by(F.struct("form", "n"), F.struct("n", "form")).alias("t"))
        return top.select("field", F.lit(tier).alias("tier"), F.col("t.form").alias("pattern"), F.col("t.n").alias("n")).where(F.col("pattern").contains("#"))

    head = counts.where(F.length("m1") >= PREFIX_LENGTH).withColumn("head", F.left("m1", F.lit(PREFIX_CLUSTER)))
    clusters = head.groupBy("field", "head").agg(F.sum("n").alias("n"), F.min("m1").alias("lo"), F.max("m1").alias("hi"))
    largest = clusters.groupBy("field").agg(F.max_by(F.struct("n", "lo", "hi"), F.struct("n", "head")).alias("c")).select("field", "c.*")
    # what the least and the greatest of a group share is shared by all of it
    shared = F.aggregate(F.sequence(F.lit(1), F.length("lo")), F.lit(0), lambda a, i: F.when((a == i - 1) & (F.substr("lo", F.lit(1), i) == F.substr("hi", F.lit(1), i)), i).otherwise(a))
    prefix = largest.withColumn("len", shared).where(F.col("len") >= PREFIX_LENGTH).select("field", F.lit(3).alias("tier"), F.concat(F.lit("starts "), F.substr("lo", F.lit(1), F.col("len")), F.lit("…")).alias("pattern"), "n")
    least = F.when(F.col("tier") == 3, PREFIX_SHARE).otherwise(PATTERN_SHARE)
    found = best("m1", 1).unionByName(best("m2", 2)).unionByName(prefix).join(total, "field").where(F.col("n") >= least * F.col("total"))
    first = found.groupBy("field").agg(F.min_by(F.struct("pattern", "n", "total"), "tier").alias("x"))
    return first.select("field", "x.pattern", half_up(F.lit(100.0) * F.col("x.n") / F.col("x.total")).cast("int").alias("coverage"))


def redundant(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``field, of, overlap``: columns that mostly repeat an earlier one; ``overlap`` in percent only where not nearly all. One aggregation for all pairs."""
    names = columns or df.columns
    text = {n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names}
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "field string, of string, overlap int")
    row = support_of(df.select(*(F.col(f"`{n}`") for n in names))).agg(
        *(F.avg((text[a] == text[b]).cast("int")).alias(f"s{i}") for i, (a, b) in enumerate(pairs)), *(F.max((text[a] != "").cast("int")).alias(f"f{i}") for i, (a, _) in enumerate(pairs))
    )
    cells = F.array(*(F.struct(F.lit(b).alias("field"), F.lit(a).alias("of"), F.col(f"s{i}").alias("s"), F.col(f"f{i}").alias("f")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(cells).alias("x")).select("x.*").where((F.col("s") >= REDUNDANT) & (F.col("f") == 1)).select("field", "of", F.when(F.col("s") < NEARLY_SAME, half_up(100.0 * F.col("s"))).cast("int").alias("overlap"))


def links(tables: dict[str, DataFrame]) -> DataFrame:
    """``source, field, kind, target, target_field, hits, total``: columns whose values are contained in a unique column elsewhere (or of the same table).

    ``kind`` is ``ref``, or ``refs`` for columns with several references per cell, joined by ";". A column with three or more distinct parts, of which 95 % are values of a key, refers to
    it; each column is claimed once, by the best hit. Values meet in one shuffle over all columns of all tables.
    """
    parts, keys = [], []
    for name, df in tables.items():
        rows = support_of(df)
        cols = [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType, T.BooleanType))]
        unique = {r["field"] for r in columns_report(df, cols).where("role = 'key'").collect()}
        cells = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols))).alias("x")).select(F.lit(name).alias("source"), "x.*").where("v <> ''")
        several = cells.groupBy("field").agg(F.max(F.col("v").contains(";").cast("int")).alias("several"))
        long = cells.join(several, "field").select(
            "source", "field", F.when(F.col("several") == 1, "refs").otherwise("ref").alias("kind"), F.explode(F.when(F.col("several") == 1, F.split("v", r"\s*;\s*")).otherwise(F.array("v"))).alias("part")
        )
        parts.append(long.where((F.trim("part") != "") & ((F.col("kind") == "refs") | ~F.col("field").isin(*unique, ""))).select("source", "field", "kind", F.trim("part").alias("part")).distinct())
        keys.append(cells.where(F.col("field").isin(*unique, "")).select(F.col("source").alias("target"), F.col("field").alias("target_field"), F.col("v").alias("part")))
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    all_keys = keys[0]
    for k in keys[1:]:
        all_keys = all_keys.unionByName(k)
    totals = all_parts.groupBy("source", "field", "kind").agg(F.count("*").alias("total")).where(F.col("total") >= REF_LEAST)
    hit = all_parts.join(all_keys, "part").where((F.col("source") != F.col("target")) | (F.col("field") != F.col("target_field"))).groupBy("source", "field", "kind", "target", "target_field").agg(F.count("*").alias("hits"))
    good = hit.join(totals, ["source", "field", "kind"]).where(F.col("hits") >= CONTAINED * F.col("total"))
    w = W.partitionBy("source", "field").orderBy(F.desc("hits"), "target", "target_field")
    return good.withColumn("r", F.row_number().over(w)).where("r = 1").select("source", "field", "kind", "target", "target_field", "hits", "total")


def claims(name: str, df: DataFrame) -> DataFrame:
    """The claims of one table in order (``source, field, fact, value, seq``): types, roles, empties, values, patterns, and what repeats what."""
    report = columns_report(df)
    spark = df.sparkSession
    rows: list[tuple[str, str, str, str]] = []
    info = {r["field"]: r for r in report.collect()}  # one row per column
    text = [c for c in df.columns if info[c]["type"] == "string" and info[c]["role"] not in ("enum", "constant") and not isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    forms = {r["field"]: r for r in patterns(support_of(df), text).collect()} if text else {}
    for c in df.columns:
        r = info[c]
        rows.append((name, c, "type", r["type"]))
        if r["empty_pct"]:
            rows.append((name, c, "empty", f"{r['empty_pct']}%"))
        if r["role"]:
            rows.append((name, c, "role", r["role"]))
        if r["role"] == "constant":
            rows.append((name, c, "value", r["any_value"]))
        if r["role"] == "enum":
            seen = [x["value"] for x in enum_values(support_of(df), c).orderBy("first_seen").limit(ENUM_MOST + 1).collect()]
            more = f" +{len(seen) - ENUM_SHOWN} more" if len(seen) > ENUM_SHOWN else ""
            rows.append((name, c, "values", ", ".join(seen[:ENUM_SHOWN]) + more))
        if c in forms:
            rows.append((name, c, "pattern", f"{forms[c]['pattern']} ({forms[c]['coverage']}%)"))
    for r in redundant(df).collect():
        rows.append((name, r["field"], "role", f"redundant of {r['of']}"))
        if r["overlap"] is not None:
            rows.append((name, r["field"], "overlap", f"{r['overlap']}%"))
    return spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "source string, field string, fact string, value string, seq bigint")


def fold_claims(claimed: DataFrame) -> DataFrame:
    """``source, field, fact, value``: per fact the last value that says anything."""
    said = claimed.where(F.col("value").isNotNull() & (F.col("value") != "") & F.col("fact").isin(*FACTS))
    return said.groupBy("source", "field", "fact").agg(F.max_by("value", "seq").alias("value"))


def schema_page(folded: DataFrame) -> DataFrame:
    """One row per field: ``source, field, title, type, structure, description``."""
    p = folded.groupBy("source", "field").pivot("fact", list(FACTS)).agg(F.first("value"))
    structure = F.concat_ws(" · ", "role", "values", "pattern", F.concat(F.lit("empty "), F.col("empty")), F.concat(F.lit("→ "), F.coalesce("ref", "refs")))
    return p.select("source", "field", "title", "type", structure.alias("structure"), "description")


def field_lines(folded: DataFrame) -> DataFrame:
    """``source, field, line``: the facts of a field on a line."""
    order = F.array_position(F.array(*(F.lit(f) for f in FACTS)), F.col("fact"))
    return folded.groupBy("source", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat("fact", F.lit(" "), "value").alias("t")))), lambda x: x["t"]), " · ").alias("line"))


def schema_gaps(columns: DataFrame, folded: DataFrame) -> DataFrame:
    """``source, field``: columns (``source, field``) without a title of their own."""
    return columns.join(folded.where("fact = 'title'"), ["source", "field"], "left_anti").select("source", "field")


def gap_backlog(columns: DataFrame, folded: DataFrame, most: int = 5) -> DataFrame:
    """``source, gaps``: how many untitled columns each source has, the most first."""
    return schema_gaps(columns, folded).groupBy("source").agg(F.count("*").alias("gaps")).orderBy(F.desc("gaps"), "source").limit(most)


def schema_map(counts: DataFrame, refs: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``source, rows, depth``) and edges (``a, b, kind``): references and derivations, one edge per pair, derivations first."""
    depth = derived.select(F.col("source"), F.lit(1).alias("depth"))
    nodes = counts.join(depth.groupBy("source").agg(F.max("depth").alias("depth")), "source", "left").select("source", "rows", F.coalesce("depth", F.lit(0)).alias("depth"))
    edges = derived.select(F.col("parent").alias("a"), F.col("source").alias("b"), F.lit("derived").alias("kind"), F.lit(0).alias("o")).unionByName(refs.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("ref").alias("kind"), F.lit(1).alias("o")))
    one = edges.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min_by(F.struct("a", "b", "kind"), F.struct("o", "a")).alias("e"))
    return nodes, one.select("e.*")


# ------------------------------------------------------------------------------------------------------------ inspection


def _numeric_share(df: DataFrame, c: str) -> Column:
    n = F.col(f"`{c}`").try_cast("double") if isinstance(df.schema[c].dataType, (T.StringType, T.NumericType)) else F.lit(None).cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), n)


def inspect_ranges(df: DataFrame) -> DataFrame:
    """``field, lo, hi, is_date``: ranges of the columns that are mostly numbers; columns named like ids and constants are left out.

    A column is of dates if its name ends in time or date, or its numbers are 0 or large; then the range is of the positive ones.
    """
    names = [c for c in df.columns if not c.lower().endswith(("id", "ids")) and isinstance(df.schema[c].dataType, (T.StringType, T.NumericType))]
    if not names:
        return df.sparkSession.createDataFrame([], "field string, lo double, hi double, is_date boolean")
    cells = F.array(*(F.struct(F.lit(c).alias("field"), _numeric_share(df, c).alias("v"), F.lit(c.lower().endswith(("time", "date"))).alias("named")) for c in names))
    long = support_of(df).select(F.explode(cells).alias("x")).select("x.*")
    g = long.groupBy("field", "named").agg(
        F.count("*").alias("n"), F.count("v").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min(F.when(F.col("v") > 0, F.col("v"))).alias("plo"), F.min(F.coalesce((F.col("v") == 0) | (F.col("v") > 3e10), F.lit(True)).cast("int")).alias("large")
    )
    date = F.col("named") | (F.col("large") == 1)
    return g.where((F.col("k") * 2 > F.col("n")) & (F.col("lo") != F.col("hi"))).select("field", F.when(date, F.col("plo")).otherwise(F.col("lo")).alias("lo"), "hi", date.alias("is_date"))


def inspect_gaps(df: DataFrame) -> DataFrame:
    """``field, empty``: share of empty cells of the columns that have any: "always", "<1%", or whole percent."""
    f = column_facts(support_of(df)).where("filled < rows")
    pct = half_up(F.lit(100.0) * (F.col("rows") - F.col("filled")) / F.col("rows"))
    return f.select("field", F.when(F.col("filled") == 0, "always").when(pct < 1, "<1%").otherwise(F.concat(pct.cast("string"), F.lit("%"))).alias("empty"))


def inspect_duplicates(df: DataFrame, first: str | None = None) -> DataFrame:
    """``field, repeats``: how many rows repeat a value of the first column."""
    c = first or df.columns[0]
    return support_of(df).agg((F.count("*") - F.countDistinct(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))).alias("repeats")).select(F.lit(c).alias("field"), "repeats")


def inspect_documents(df: DataFrame, name: str = "name") -> DataFrame:
    """``extension, files``: documents per extension, in lower case."""
    return df.groupBy(F.lower(F.element_at(F.split(name, "[.]"), -1)).alias("extension")).agg(F.count("*").alias("files"))
