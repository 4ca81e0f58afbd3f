"""Queries of the general data problems: p1, p3, p5, p6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.operators import drift, intervals, packed, shred
from lensframe.session import table

#: A time counts when it lies strictly between them (epoch ms), and the longest gap listed.
EARLIEST_MS, LATEST_MS, LONGEST_GAP_MS = 946_684_800_000, 4_102_444_800_000, 864_000_000


def _xml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.shred(table(spark, sf_dir, "xml_docs"), "tree", ["file_id"])


def _bare(name: str) -> Column:
    return F.regexp_replace(F.col(name), "^[^:]*:", "")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of every complete tree with its number, its parent's number and its name without prefix."""
    found = shred.shred_entities(table(spark, sf_dir, "xml_docs"), "tree", ["file_id"], {"name": "elem_name"})
    return found.select("file_id", F.col("node_no").alias("elem_no"), "parent_no", _bare("elem_name").alias("elem_name"))


def p1_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attribute of every element, under the element's number."""
    found = shred.attributes(_xml_nodes(spark, sf_dir), ["file_id"])
    return found.select("file_id", F.col("node_no").alias("elem_no"), "attr_no", "attr_name", "attr_value")


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that is not blank, under the number of the element that holds it, with its place among the children."""
    found = shred.texts(_xml_nodes(spark, sf_dir), ["file_id"])
    return found.select("file_id", F.col("node_no").alias("elem_no"), "child_no", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change between a file's curves and those of the file before in the same log."""
    return drift.changes(table(spark, sf_dir, "log_curves"))


def p3_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names in all headers of each log, with the type that every name's types promote to."""
    return drift.union_schema(table(spark, sf_dir, "log_curves"))


def p3_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steady columns of each log: a row per curve, with all its names and the type that its types promote to."""
    return drift.steady_schema(drift.curve_columns(table(spark, sf_dir, "log_curves")))


def p3_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one table of all logs: a row per data line and a typed column per curve, steady through all files."""
    return drift.steady_table(table(spark, sf_dir, "log_curves"), table(spark, sf_dir, "log_data"))


def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of each file the steady columns hold, by the file's own name for the column; no cell comes twice under one curve."""
    rows = drift.unified_rows(table(spark, sf_dir, "log_curves"), table(spark, sf_dir, "log_data"))
    once = rows.groupBy("file_id", "line_no", "curve").agg(F.count("*").alias("n"), F.first("mnemonic").alias("mnemonic"))
    return once.groupBy("file_id", "mnemonic").agg(F.sum("n").alias("cells"), F.max("n").alias("most"))


def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By file: what was added less what was removed is how many columns it has more than the file before."""
    found = drift.changes(table(spark, sf_dir, "log_curves"))
    net = found.groupBy("uidlog", "file_id").agg(F.sum(F.when(F.col("change") == "added", 1).when(F.col("change") == "removed", -1).otherwise(0)).alias("more"))
    return net.where("more <> 0")


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All data lines of all files under the steady columns of their log."""
    return drift.unified_rows(table(spark, sf_dir, "log_curves"), table(spark, sf_dir, "log_data"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asset reference of every event with its place; exact duplicate events count once."""
    events = table(spark, sf_dir, "asset_events").select(F.col("id").alias("event_id"), "assetids").dropDuplicates()
    return packed.split_packed(events, "assetids", ["event_id"], value="asset_ref")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of each asset's events and the gaps of at most ten days between them."""
    events = table(spark, sf_dir, "asset_events").where(
        (F.col("starttime") > EARLIEST_MS)
        & (F.col("starttime") < LATEST_MS)
        & (F.col("endtime") > EARLIEST_MS)
        & (F.col("endtime") < LATEST_MS)
        & (F.col("starttime") < F.col("endtime"))
    )
    spans = packed.split_packed(events, "assetids", ["starttime", "endtime"], value="asset_ref")
    return intervals.periods_and_gaps(spans, "asset_ref", "starttime", "endtime", LONGEST_GAP_MS)


QUERIES = {"p1_found": p1_found, "p1_attributes": p1_attributes, "p1_texts": p1_texts, "p3_found": p3_found, "p3_schema": p3_schema, "p3_curves": p3_curves, "p3_rows": p3_rows, "p3_wide": p3_wide, "p3_cells": p3_cells, "p3_balance": p3_balance, "p5_found": p5_found, "p6_found": p6_found}

_REFERENCES = """m AS (SELECT id, assetids, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT id, assetids, regexp_extract_all(assetids, '"(?:[^"]|"")*"|[0-9]+') AS t FROM (SELECT DISTINCT id, assetids FROM asset_events))),
    e AS (SELECT id, assetids, i, CASE WHEN tok LIKE '"%' AND regexp_matches(regexp_replace(tok, '\\b(and|n/a|N/A|none|null|NULL)\\b', '', 'g'), '[A-Za-z]') THEN [trim(replace(substr(tok, 2, length(tok) - 2), '""', '"'))] ELSE regexp_extract_all(tok, '[0-9]+') END AS v FROM m),
    r AS (SELECT id, assetids, i, unnest(v) AS asset_ref, generate_subscripts(v, 1) AS j FROM e)"""

_ELEMENTS = """d AS (SELECT DISTINCT file_id, tree FROM xml_docs WHERE tree IS NOT NULL AND json_valid(tree)), t AS (SELECT file_id, CASE WHEN json_type(tree) = 'VARCHAR' THEN json_extract_string(tree, '$') ELSE tree END AS tree FROM d),
    a AS (SELECT t.file_id, x.id, x.parent, x.key, x.value, x.type, x.fullkey FROM t, json_tree(t.tree) AS x), n AS (SELECT * FROM a WHERE type = 'OBJECT' AND regexp_full_match(fullkey, '\\$(\\.children(\\[[0-9]+\\])?|\\.Elem)*') AND json_extract(value, '$.name') IS NOT NULL),
    e AS (SELECT file_id, id, replace(fullkey, '.Elem', '') AS place, CAST(row_number() OVER (PARTITION BY file_id ORDER BY id) AS INTEGER) AS no, regexp_replace(json_extract_string(value, '$.name'), '^[^:]*:', '') AS name FROM n)"""

ORACLES = {
    "p1_found": f"""WITH {_ELEMENTS}
    SELECT e.file_id, e.no AS elem_no, coalesce(p.no, 0) AS parent_no, e.name AS elem_name FROM e LEFT JOIN e p ON p.file_id = e.file_id AND e.place <> '$' AND p.place = regexp_replace(e.place, '\\.children(\\[[0-9]+\\])?$', '')""",
    "p1_attributes": f"""WITH {_ELEMENTS}, h AS (SELECT a.file_id, a.id, a.type, e.no FROM a JOIN e ON e.file_id = a.file_id AND e.id = a.parent WHERE a.key = 'attrs')
    SELECT h.file_id, h.no AS elem_no, CAST(row_number() OVER (PARTITION BY h.file_id, h.id ORDER BY a.id) AS INTEGER) AS attr_no, CASE WHEN h.type = 'OBJECT' THEN a.key ELSE json_extract_string(a.value, '$[0]') END AS attr_name,
    CASE WHEN h.type = 'OBJECT' THEN json_extract_string(a.value, '$') ELSE json_extract_string(a.value, '$[1]') END AS attr_value FROM h JOIN a ON a.file_id = h.file_id AND a.parent = h.id""",
    "p1_texts": f"""WITH {_ELEMENTS}, h AS (SELECT a.file_id, a.id, a.type, a.value, e.no FROM a JOIN e ON e.file_id = a.file_id AND e.id = a.parent WHERE a.key = 'children'),
    c AS (SELECT h.file_id, h.no, CAST(row_number() OVER (PARTITION BY h.file_id, h.id ORDER BY a.id) AS INTEGER) AS child_no, a.value, a.type FROM h JOIN a ON a.file_id = h.file_id AND a.parent = h.id WHERE h.type = 'ARRAY' UNION ALL SELECT file_id, no, 1, value, type FROM h WHERE type <> 'ARRAY'),
    v AS (SELECT file_id, no AS elem_no, child_no, CASE WHEN type = 'VARCHAR' THEN json_extract_string(value, '$') WHEN type = 'OBJECT' THEN json_extract_string(value, '$.Text') END AS text FROM c) SELECT * FROM v WHERE regexp_matches(text, '\\S')""",
    "p3_schema": """WITH c AS (SELECT DISTINCT uidlog, file_id, upper(trim(mnemonic)) AS mnemonic, lower(trim(typelogdata)) AS k, coalesce(curve_no, 0) AS no FROM log_curves WHERE trim(mnemonic) <> ''),
    b AS (SELECT uidlog, mnemonic, bit_or(CASE k WHEN 'long' THEN 1 WHEN 'double' THEN 2 WHEN 'date time' THEN 4 WHEN 'string' THEN 8 END) AS bits, count(*) AS files FROM c GROUP BY ALL)
    SELECT uidlog, mnemonic, CASE WHEN bits = 1 THEN 'long' WHEN bits IN (2, 3) THEN 'double' WHEN bits = 4 THEN 'date time' ELSE 'string' END AS kind, files FROM b""",
    "p3_cells": """WITH c AS (SELECT DISTINCT uidlog, file_id, upper(trim(regexp_replace(mnemonic, '\\s+', ' ', 'g'))) AS mnemonic, coalesce(curve_no, 0) AS no FROM log_curves WHERE trim(mnemonic) <> '' AND uidlog IS NOT NULL AND file_id IS NOT NULL),
    l AS (SELECT DISTINCT file_id, line_no, cells FROM log_data WHERE cells IS NOT NULL), x AS (SELECT file_id, line_no, generate_subscripts(s, 1) AS no FROM (SELECT file_id, line_no, string_split(cells, ',') AS s FROM l))
    SELECT file_id, mnemonic, count(*) AS cells, 1 AS most FROM x JOIN c USING (file_id, no) GROUP BY ALL""",
    "p3_balance": """WITH c AS (SELECT uidlog, file_id, min(dtimcreation) AS created, count(DISTINCT upper(trim(regexp_replace(mnemonic, '\\s+', ' ', 'g'))) || '|' || coalesce(curve_no, 0)) AS n FROM log_curves WHERE trim(mnemonic) <> '' AND uidlog IS NOT NULL AND file_id IS NOT NULL GROUP BY ALL)
    SELECT uidlog, file_id, more FROM (SELECT uidlog, file_id, n - lag(n) OVER (PARTITION BY uidlog ORDER BY created NULLS FIRST, file_id) AS more FROM c) WHERE more <> 0""",
    "p5_found": f"WITH {_REFERENCES} SELECT id AS event_id, CAST(row_number() OVER (PARTITION BY id, assetids ORDER BY i, j) AS INTEGER) AS pos, asset_ref FROM r",
    "p6_found": f"""WITH {_REFERENCES}, s AS (SELECT DISTINCT asset_ref, starttime AS a, endtime AS b FROM asset_events JOIN r USING (id, assetids)
        WHERE starttime > {EARLIEST_MS} AND starttime < {LATEST_MS} AND endtime > {EARLIEST_MS} AND endtime < {LATEST_MS} AND starttime < endtime),
    h AS (SELECT *, max(b) OVER (PARTITION BY asset_ref ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY asset_ref ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM h),
    p AS (SELECT asset_ref, n, min(a) AS a, max(b) AS b FROM g GROUP BY ALL), l AS (SELECT *, lead(a) OVER (PARTITION BY asset_ref ORDER BY a) AS nx FROM p)
    SELECT asset_ref, 'period' AS kind, a AS from_ms, b AS to_ms FROM p UNION ALL SELECT asset_ref, 'gap', b, nx FROM l WHERE nx - b <= {LONGEST_GAP_MS}""",
}
