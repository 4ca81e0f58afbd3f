"""Queries of detectors, profiles, the graph's edges, authored state and folds, each with the SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.functions import scalars
from lensframe.operators import detect, entity, folds, profile, semantic, tableview, views, zset
from lensframe.operators.lenses import Calibrate, Count, Filter, Join, Map, TopK
from lensframe.operators.zset import WEIGHT
from lensframe.plans.catalog import Catalog, Definitions, dashboard
from lensframe.plans.graph import Graph
from lensframe.plans.memo import Memo, governed_random
from lensframe.plans.queries import _event_refs, _report_sql, registry
from lensframe.plans.workspace import SCHEMA, Workspace
from lensframe.session import cut, table

QUERIES, ORACLES, query = registry()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------------------------------------ Z-sets and rows


@query("SELECT 'rows' AS what, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 'weight', count(*) FROM lineitem WHERE l_partkey = 1 AND l_suppkey = 1 UNION ALL SELECT 'absent', 0 UNION ALL SELECT 'equal', 1 UNION ALL SELECT 'empty', 1 UNION ALL SELECT 'fields', 2")
def zset_measures(spark: SparkSession, d: str) -> DataFrame:
    """Size, the weight of a row, equality and emptiness."""
    z = cut(zset.from_rows(table(spark, d, "lineitem").select("l_partkey", "l_suppkey")))
    found = [("rows", zset.size(z)), ("weight", zset.weight(z, {"l_partkey": 1, "l_suppkey": 1})), ("absent", zset.weight(z, {"l_partkey": -1, "l_suppkey": 1})), ("fields", len(zset.fields(z)))]
    found += [("equal", int(zset.equals(z, zset.plus(z, z.limit(0))) and not zset.equals(z, zset.neg(z)))), ("empty", int(zset.is_empty(zset.minus(z, z))))]
    return spark.createDataFrame(found, "what string, n bigint")


@query("SELECT p_partkey, p_size * 2 AS twice, CASE WHEN p_brand IS NULL THEN NULL ELSE p_brand END AS brand, 'none' AS extra FROM part")
def record_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields added, replaced and dropped; a default stands only for a field that is not there, not for a null."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    p = zset.with_fields(p, {"twice": F.col("p_size") * 2, "brand": zset.get(p, "p_brand", F.lit("none")), "extra": zset.get(p, "no_such", F.lit("none"))})
    return zset.without(p, "p_size", "p_brand")


@query("SELECT s_suppkey, s_acctbal, CAST(sum(w) AS BIGINT) AS _w FROM (SELECT s_suppkey, s_acctbal, -1 AS w FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT s_suppkey, 1.5, 1 FROM supplier WHERE s_suppkey = 3) GROUP BY ALL HAVING sum(w) <> 0")
def table_cell_edit(spark: SparkSession, d: str) -> DataFrame:
    """An edited cell as a change."""
    return tableview.cell_edit(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", 3, "s_acctbal", 1.5)


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 120 OFFSET (SELECT greatest(0, count(*) - 120) FROM events)")
def table_viewport(spark: SparkSession, d: str) -> DataFrame:
    """The end of a table in order of arrival: a viewport beyond it is moved back, and a large one is made smaller."""
    return tableview.viewport(table(spark, d, "events").select("event_id", "event_type"), "event_id", 10**9, 500)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE o_orderstatus END AS status FROM orders WHERE o_orderpriority <> '5-LOW'")
def table_upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a table that has rows: urgent orders are replaced, low ones go, all others stay."""
    o = table(spark, d, "orders")
    base = o.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    hit = o.where("o_orderpriority in ('1-URGENT', '5-LOW')").select("o_orderkey", F.lit("urgent").alias("status"), F.lit(2).alias("seq"), (F.col("o_orderpriority") == "5-LOW").alias("deleted"))
    return tableview.upsert(base, hit.unionByName(hit.withColumn("status", F.lit("earlier")).withColumn("seq", F.lit(1))), "o_orderkey", "seq")


@query("SELECT c_custkey, CAST(900000 + abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, x: ((a * 31 + x + 2147483648) & 4294967295) - 2147483648)) % 100000 AS BIGINT) AS h FROM customer")
def scalar_string_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", scalars.string_hash(F.col("c_name")).cast("bigint").alias("h"))


@query("SELECT doc_id, coalesce(n_chars BETWEEN 100 AND 1000, false) AS inside, sha1(source) AS sha1, decode(from_base64(base64(encode(source)))) AS there_and_back, replace(source, '_', '''') AS plain FROM documents")
def scalar_codecs(spark: SparkSession, d: str) -> DataFrame:
    """An interval over numbers as text, hashes, base 64 and entities."""
    docs = table(spark, d, "documents")
    coded = F.replace("source", F.lit("_"), F.lit("&#39;"))
    return docs.select("doc_id", scalars.in_interval(F.col("n_chars").cast("string"), F.lit(100), F.lit("1000")).alias("inside"), F.sha1("source").alias("sha1"), F.unbase64(F.base64(F.encode("source", "utf-8"))).cast("string").alias("there_and_back"), scalars.decode_entities(coded).alias("plain"))


# ------------------------------------------------------------------------------------------------ detectors

#: A table of wells, made of orders, that has something for each detector.
_WELLS = """SELECT o_orderkey AS id, o_orderstatus AS work_status, o_orderpriority AS klass, o_totalprice / 10 AS md, o_custkey % 90 * 1.0 AS lat, o_custkey % 180 * -1.0 AS longitude, {day} AS opened, {later} AS done_at,
    {prose} AS remark FROM orders"""
_WELLS_SQL = _WELLS.format(day="o_orderdate", later="o_orderdate + INTERVAL 3 DAY", prose="repeat(o_orderpriority || ' ', 20)")
_WELLS_SPARK = _WELLS.format(day="o_orderdate", later="o_orderdate + INTERVAL 3 DAYS", prose="repeat(concat(o_orderpriority, ' '), 20)")


def _wells(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "orders").createOrReplaceTempView("wells_orders")
    return s.sql(_WELLS_SPARK.replace("FROM orders", "FROM wells_orders"))


def _shapes_sql(rel: str, columns: list[tuple[str, str]], views_of: bool = False) -> str:
    """The detectors in SQL over a relation's columns (name, kind: number, string, time or other)."""
    filled = lambda c, k: f"({c} IS NOT NULL AND {c} <> '')" if k == "string" else f"{c} IS NOT NULL"
    ms = {"number": "CASE WHEN {0} > 946684800000 AND {0} < 4102444800000 THEN CAST({0} AS BIGINT) END", "string": "CASE WHEN regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN epoch_ms(TRY_CAST(left({0}, 10) AS TIMESTAMP)) END", "time": "epoch_ms({0})", "other": "NULL"}
    stats = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS name, '{k}' AS kind, count(*) AS rows, count(*) FILTER (WHERE {filled(c, k)}) AS filled, count(DISTINCT {c}) FILTER (WHERE {filled(c, k)}) AS d, count({ms[k].format(c)}) AS dates, "
        f"{f'CAST(min({c}) AS DOUBLE)' if k == 'number' else 'NULL::DOUBLE'} AS lo, {f'CAST(max({c}) AS DOUBLE)' if k == 'number' else 'NULL::DOUBLE'} AS hi, "
        f"{f'avg(length({c})) FILTER (WHERE {filled(c, k)})' if k == 'string' else 'NULL::DOUBLE'} AS len, {f'min(length({c})) FILTER (WHERE {filled(c, k)})' if k == 'string' else 'NULL::BIGINT'} AS short FROM t"
        for i, (c, k) in enumerate(columns)
    )
    at = lambda name: "CASE " + name + " " + " ".join(f"WHEN '{c}' THEN {ms[k].format(c)}" for c, k in columns if k != "other") + " END"
    first = lambda cond, order="pos": f"(SELECT name FROM s WHERE {cond} ORDER BY {order} LIMIT 1)"
    num = "kind = 'number' AND filled > 0 AND dates < filled AND d >= 2"
    titles = ", ".join(f"'{t}'" for t in ("title", "name", "label", "summary", "subject", "externalid", "well", "id"))
    depths = ", ".join(f"'{t}'" for t in ("DEPT", "dept", "md", "MD", "depth", "Depth", "tvd", "TVD"))
    axis = lambda *ps: "coalesce(" + ", ".join(first(f"{num} AND regexp_matches(lower(name), '{p}')") for p in ps)
    body = f"""WITH t AS (SELECT DISTINCT * FROM ({rel})), s AS ({stats}),
    st AS (SELECT coalesce({first("dates > 0 AND regexp_matches(lower(name), 'start|begin|from|opened|created')")}, {first("dates > 0")}) AS a),
    en AS (SELECT a, coalesce((SELECT name FROM s WHERE dates > 0 AND name <> a AND regexp_matches(lower(name), 'end|finish|to|until|closed|done') ORDER BY pos LIMIT 1), (SELECT name FROM s WHERE dates > 0 AND name <> a ORDER BY pos LIMIT 1)) AS b FROM st),
    sp AS (SELECT a, b, x AS ok, y AS bad FROM (SELECT a, b, count(*) FILTER (WHERE ({at('a')}) IS NOT NULL AND ({at('b')}) IS NOT NULL) AS x, count(*) FILTER (WHERE ({at('b')}) < ({at('a')})) AS y FROM t, en GROUP BY a, b)),
    span AS (SELECT a, b FROM sp WHERE a IS NOT NULL AND b IS NOT NULL AND ok >= 3 AND bad = 0),
    g AS (SELECT {first("kind = 'number' AND lower(name) LIKE 'lat%' AND (lo IS NULL OR lo >= -90 AND hi <= 90)")} AS lat, {first("kind = 'number' AND regexp_matches(lower(name), '^(lon|lng)') AND (lo IS NULL OR lo >= -180 AND hi <= 180)")} AS lon),
    ax AS (SELECT {axis('^(x|east)', 'lon')}, {first(num)}) AS x), ay AS (SELECT x, {axis('^(y|north)', 'lat')}, (SELECT name FROM s WHERE {num} AND name <> x ORDER BY pos LIMIT 1)) AS y FROM ax),
    az AS (SELECT x, y, {axis('^(z|tvd|depth|elev|alt)')}, (SELECT name FROM s WHERE {num} AND name <> x AND name <> y ORDER BY pos LIMIT 1)) AS z FROM ay),
    found AS (SELECT 'date' AS detector, {first("filled >= 3 AND dates >= 0.6 * filled")} AS field
    UNION ALL SELECT 'lane', {first("rows >= 4 AND 2 * filled >= rows AND d BETWEEN 2 AND 12 AND filled >= 3 * d", "NOT regexp_matches(lower(name), 'status|state|phase|stage|type|kind|severity|priority|category'), d, pos")}
    UNION ALL SELECT 'prose', {first("kind = 'string' AND filled >= greatest(2, 0.3 * rows) AND len > 120", "len DESC, pos")}
    UNION ALL SELECT 'title', coalesce({first(f"filled > 0 AND list_contains([{titles}], lower(name))", f"list_position([{titles}], lower(name)), pos")}, {first("short > 0 AND short < 80")}, {first("true")})
    UNION ALL SELECT 'depth', {first(f"kind = 'number' AND filled > 0 AND list_contains([{depths}], name)", f"list_position([{depths}], name)")}
    UNION ALL SELECT 'numeric', name FROM s WHERE {num}
    UNION ALL SELECT 'start', a FROM span UNION ALL SELECT 'end', b FROM span
    UNION ALL SELECT 'longitude', lon FROM g WHERE lat IS NOT NULL UNION ALL SELECT 'latitude', lat FROM g WHERE lon IS NOT NULL
    UNION ALL SELECT unnest(['axis x', 'axis y', 'axis z']), unnest([x, y, z]) FROM az WHERE z IS NOT NULL)"""
    if not views_of:
        return body + " SELECT detector, field FROM found WHERE field IS NOT NULL"
    has = lambda *names: f"(SELECT count(*) FROM found WHERE field IS NOT NULL AND detector IN ({', '.join(repr(n) for n in names)}))"
    offers = [("table", "1"), ("calendar", has("date")), ("heatmap", has("date")), ("kanban", has("lane")), ("gantt", has("start")), ("histogram", has("numeric")), ("scatter", has("numeric") + " - 1"), ("3d", has("numeric") + " - 2"), ("map", has("latitude")), ("reading", has("prose")), ("depth", has("depth")), ("schema", "1")]
    return body + " " + " UNION ALL ".join(f"SELECT '{v}' AS view WHERE {n} >= 1" for v, n in offers)


_DETECTED = {
    "wells": (_wells, _WELLS_SQL, [("id", "number"), ("work_status", "string"), ("klass", "string"), ("md", "number"), ("lat", "number"), ("longitude", "number"), ("opened", "time"), ("done_at", "time"), ("remark", "string")]),
    "asset_events": (
        lambda s, d: table(s, d, "asset_events").select("id", "type", "subtype", "starttime", "endtime", "description", "assetids"), "SELECT id, type, subtype, starttime, endtime, description, assetids FROM asset_events",
        [("id", "number"), ("type", "string"), ("subtype", "string"), ("starttime", "number"), ("endtime", "number"), ("description", "string"), ("assetids", "string")],
    ),
    "documents": (
        lambda s, d: table(s, d, "documents").select("doc_id", "text", "lang", "source", "written_at", "received_at"), "SELECT doc_id, text, lang, source, written_at, received_at FROM documents",
        [("doc_id", "number"), ("text", "string"), ("lang", "string"), ("source", "string"), ("written_at", "time"), ("received_at", "time")],
    ),
    "parts": (lambda s, d: table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), "SELECT p_partkey, p_size, p_retailprice FROM part", [("p_partkey", "number"), ("p_size", "number"), ("p_retailprice", "number")]),
}


def _detectors(name: str) -> None:
    read, rel, columns = _DETECTED[name]

    def found(spark: SparkSession, d: str) -> DataFrame:
        return detect.shape_report(read(spark, d))

    def offered(spark: SparkSession, d: str) -> DataFrame:
        return spark.createDataFrame([(v,) for v in detect.available_views(read(spark, d))], "view string")

    found.__name__, offered.__name__ = f"detect_{name}", f"views_of_{name}"
    query(_shapes_sql(rel, columns))(found)
    query(_shapes_sql(rel, columns, True))(offered)


for _name in _DETECTED:
    _detectors(_name)

_EVENT_COLUMNS = [("id", "number"), ("type", "string"), ("subtype", "string"), ("starttime", "number"), ("endtime", "number"), ("description", "string"), ("assetids", "string"), ("received_at", "time")]


@query(_shapes_sql("SELECT * FROM asset_events", _EVENT_COLUMNS))
def shape_detect(spark: SparkSession, d: str) -> DataFrame:
    """What the detectors find in the asset events."""
    return detect.shape_report(table(spark, d, "asset_events"))


# ------------------------------------------------------------------------------------------------ profiles


@query("SELECT * FROM (VALUES ('again', 'o_orderkey', NULL::INTEGER)) t(field, \"of\", overlap) UNION ALL SELECT 'mostly', 'o_orderpriority', CAST(floor(100.0 * avg((o_orderpriority <> '5-LOW')::INT) + 0.5) AS INTEGER) FROM (SELECT DISTINCT o_orderkey, o_orderpriority FROM orders)")
def profile_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Columns that repeat another, wholly or mostly."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderkey").cast("string").alias("again"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("mostly"))
    return profile.redundant(o)


@query("SELECT 'orders' AS source, 'both' AS field, 'refs' AS kind, 'customer' AS target, 'c_custkey' AS target_field, count(*) AS hits, count(*) AS total FROM (SELECT o_custkey FROM orders UNION SELECT o_custkey % 10 + 1 FROM orders)")
def profile_multi_links(spark: SparkSession, d: str) -> DataFrame:
    """Several references in one cell."""
    o = table(spark, d, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit(" ; "), (F.col("o_custkey") % 10 + 1).cast("string")).alias("both"))
    return profile.links({"orders": o, "customer": table(spark, d, "customer").select("c_custkey", "c_name")})


_DATES = "SELECT '{0}' AS field, CAST(min({0}) FILTER (WHERE {0} > 0) AS DOUBLE) AS lo, CAST(max({0}) AS DOUBLE) AS hi, true AS is_date FROM asset_events"


@query(f"{_DATES.format('starttime')} UNION ALL {_DATES.format('endtime')}")
def inspect_dates(spark: SparkSession, d: str) -> DataFrame:
    """The ranges of columns of times, without what is no time."""
    return profile.inspect_ranges(table(spark, d, "asset_events").select("id", "starttime", "endtime"))


_ORDERS_REPORT = _report_sql("orders", {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "number", "o_orderpriority": "string"}).replace("SELECT DISTINCT * FROM orders", "SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
_ENUMS = "(SELECT 'o_orderstatus' AS field, string_agg(v, ', ' ORDER BY v) AS vals FROM (SELECT DISTINCT o_orderstatus AS v FROM orders) UNION ALL SELECT 'o_orderpriority', string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))"


def _orders_claims(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return profile.fold_claims(profile.claims("orders", o))


@query(f"SELECT 'orders' AS source, field, concat_ws(' · ', 'type ' || type, 'role ' || role, 'values ' || vals) AS line FROM ({_ORDERS_REPORT}) LEFT JOIN {_ENUMS} USING (field)")
def profile_lines(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each column on a line."""
    return profile.field_lines(_orders_claims(spark, d))


@query(f"SELECT 'orders' AS source, field, NULL::VARCHAR AS title, type, concat_ws(' · ', role, vals) AS structure, NULL::VARCHAR AS description FROM ({_ORDERS_REPORT}) LEFT JOIN {_ENUMS} USING (field)")
def profile_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of a table's schema, a row per column."""
    return profile.schema_page(_orders_claims(spark, d))


def _catalog(s: SparkSession, d: str) -> Catalog:
    cat = Catalog(s)
    cat.register("region", table(s, d, "region"))
    cat.register("nation", table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    cat.register("customer", table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"))
    return cat


@query(
    """SELECT 'node' AS part, 'region' AS a, CAST(count(*) AS VARCHAR) AS b, '0' AS kind FROM region UNION ALL SELECT 'node', 'nation', CAST(count(*) AS VARCHAR), '0' FROM nation UNION ALL SELECT 'node', 'customer', CAST(count(*) AS VARCHAR), '0' FROM customer
    UNION ALL SELECT 'node', 'lens:first', CAST(count(*) AS VARCHAR), '1' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'edge', 'nation', 'lens:first', 'derived'
    UNION ALL SELECT 'edge', 'nation', 'region', 'ref' WHERE (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)) = 0
    UNION ALL SELECT 'edge', 'customer', 'nation', 'ref' WHERE (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) = 0"""
)
def schema_map(spark: SparkSession, d: str) -> DataFrame:
    """All sources with what refers to and derives from what."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    named = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    cat = Catalog(spark)
    cat.register("region", region.select("r_name"))
    cat.register("nation", named.select("n_name", F.col("r_name").alias("region"), "n_regionkey"))
    cat.register("customer", table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_name", F.col("n_name").alias("nation")))
    cat.link()
    cat.make_lens("first", "nation", lambda rows, other: rows.where("n_regionkey = 1"))
    nodes, edges = cat.map()
    return nodes.select(F.lit("node").alias("part"), F.col("source").alias("a"), F.col("rows").cast("string").alias("b"), F.col("depth").cast("string").alias("kind")).unionByName(edges.select(F.lit("edge").alias("part"), "a", "b", "kind"))


@query("SELECT 'lens:second' AS source, 'n_name' AS field, (SELECT r_name FROM region WHERE r_regionkey = 1) AS title, 'lens:second,lens:first,nation' AS chain, (SELECT count(*) FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2) || ' rows · 3 columns · derived' AS line")
def catalog_semantics(spark: SparkSession, d: str) -> DataFrame:
    """A column of a lens over a lens means what its source says; the way back, and the lens on a line."""
    cat = _catalog(spark, d)
    cat.annotate("nation", "N NAME", title=table(spark, d, "region").where("r_regionkey = 1").first()["r_name"])
    cat.make_lens("first", "nation", lambda rows, other: rows.where("n_regionkey = 1"))
    cat.make_lens("second", "the lens: first", "SELECT * FROM rows WHERE n_nationkey > 2")
    name = cat.resolve("second") or ""
    return spark.createDataFrame([(name, "n_name", cat.semantics(name, "n_name")["title"], ",".join(cat.chain(name)), cat.line(name))], "source string, field string, title string, chain string, line string")


@query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def catalog_rebind(spark: SparkSession, d: str) -> DataFrame:
    """A lens made again under its name: who reads the name reads the new one."""
    cat = _catalog(spark, d)
    cat.make_lens("of a region", "nation", lambda rows, other: rows.where("n_regionkey = 1"))
    cat.make_lens("of a region", "nation", lambda rows, other: rows.where("n_regionkey = 2"))
    return spark.sql(f"SELECT n_name FROM {cat.view_name('lens:of-a-region')}")


@query("SELECT 'region' AS source, 'r_name' AS field, 1 AS bare WHERE (SELECT count(*) FROM region) > 0")
def catalog_first_gap(spark: SparkSession, d: str) -> DataFrame:
    """The first source with columns that have no title."""
    cat = Catalog(spark)
    cat.register("nation", table(spark, d, "nation").select("n_name"))
    cat.register("region", table(spark, d, "region").select("r_regionkey", "r_name"))
    cat.annotate("nation", "n_name", title="Nation")
    cat.annotate("region", "r_regionkey", title="Region")
    source, fields, n = cat.first_gap() or ("", [], 0)
    return spark.createDataFrame([(source, f, n) for f in fields], "source string, field string, bare int")


@query("SELECT r_name AS name, left(sha256('4:lens' || octet_length(encode('read ' || r_name)) || ':read ' || r_name), 16) AS hash, 'lens' AS kind, 'read ' || r_name AS source FROM region UNION ALL SELECT 'alias', left(sha256('4:lens' || octet_length(encode('read ' || max(r_name))) || ':read ' || max(r_name)), 16), 'lens', 'read ' || max(r_name) FROM region")
def definition_names(spark: SparkSession, d: str) -> DataFrame:
    """Names bound to definitions by content; what is written otherwise is the same one, and a name bound again means the new one."""
    defs = Definitions(spark)
    names = sorted(r["r_name"] for r in table(spark, d, "region").collect())  # 5 rows at any scale
    for n in names:
        defs.publish(n, "lens", f"read\n  {n}")
        defs.bind_name("alias", defs.define("lens", f" read {n}"))
    assert defs.get(defs.resolve("alias") or "") == ("lens", f"read {names[-1]}", ())
    return defs.table()


@query("SELECT count(*) AS rows, count(*) AS same, count(*) AS inside, 0 AS as_other_seed FROM orders")
def governed_effects(spark: SparkSession, d: str) -> DataFrame:
    """Random numbers of a seed are the same however the rows are spread, within 0 and 1, and others for another seed."""
    o = table(spark, d, "orders").select("o_orderkey")
    a, b = o.select("o_orderkey", governed_random(42, F.col("o_orderkey")).alias("a")), o.repartition(7).select("o_orderkey", governed_random(42, F.col("o_orderkey")).alias("b"), governed_random(43, F.col("o_orderkey")).alias("c"))
    j = a.join(b, "o_orderkey")
    return j.agg(F.count("*").alias("rows"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if((F.col("a") >= 0) & (F.col("a") < 1)).alias("inside"), F.count_if(F.col("a") == F.col("c")).cast("int").alias("as_other_seed"))


@query("SELECT o_orderstatus AS status, count(*) AS n, 2 AS runs_of_count, 1 AS runs_of_top FROM orders GROUP BY 1")
def memo_cells(spark: SparkSession, d: str) -> DataFrame:
    """A cell made again because its input changed gives the same as before, so what depends on it stays."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    m = Memo()
    m.input("orders", o)
    m.derived("count", lambda x: x.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), "orders")
    m.derived("top", lambda x: x.where("n > 0"), "count")
    m.get("top")
    m.input("orders", o.select((F.col("o_orderkey") + 1).alias("o_orderkey"), "o_orderstatus"))
    out = m.get("top")
    m.get("top")
    return out.select("status", "n", F.lit(m.runs["count"]).alias("runs_of_count"), F.lit(m.runs["top"]).alias("runs_of_top"))


# ------------------------------------------------------------------------------------------------ views


@query(
    """WITH t AS (SELECT DISTINCT p_partkey, p_brand AS x, CAST(p_size AS VARCHAR) AS y FROM part), xs AS (SELECT DISTINCT x FROM t ORDER BY x LIMIT 20), ys AS (SELECT DISTINCT y FROM t ORDER BY y LIMIT 20)
    SELECT x, y, count(*) AS n FROM t WHERE x IN (SELECT x FROM xs) AND y IN (SELECT y FROM ys) GROUP BY ALL"""
)
def view_heatmap_first(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the first twenty values of two columns that have more."""
    return views.heatmap(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_size")


@query("SELECT CAST(p_size AS DOUBLE) AS depth, p_retailprice, CAST(p_partkey AS DOUBLE) AS p_partkey FROM (SELECT DISTINCT * FROM part)")
def view_depth_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a depth log."""
    return views.depth_log(table(spark, d, "part").withColumnRenamed("p_size", "md"), "md", ["p_retailprice", "p_partkey"])[0]


@query("SELECT coalesce(source, '?') || doc_id AS name, CAST(floor(octet_length(encode(coalesce(text, ''))) / 1024.0 + 0.5) AS BIGINT) AS kb FROM documents")
def view_gallery(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return views.gallery(docs.select(F.concat(F.coalesce("source", F.lit("?")), F.col("doc_id").cast("string")).alias("name"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes")))


@query(
    """WITH t AS (SELECT DISTINCT * FROM orders) SELECT 'total' AS label, sum(o_totalprice) > 0 AS big, count(*) AS n FROM t
    UNION ALL SELECT o_orderstatus, true, count(*) FROM t GROUP BY 1"""
)
def view_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of a dashboard: a metric, and a donut of a field named loosely."""
    cat = Catalog(spark)
    cat.register("orders", table(spark, d, "orders"))
    body = '# Orders\n```view\n{"view": "metric", "source": "orders"}\n```\ntext\n```view\n{"view": "donut", "source": "Orders", "field": "O orderStatus"}\n```\n'
    (_, total), (_, slices) = dashboard(cat, body)
    return total.select(F.lit("total").alias("label"), (F.col("value") > 0).alias("big"), F.col("value").cast("bigint").alias("n")).unionByName(slices.select("label", F.lit(True).alias("big"), "n"))


# ------------------------------------------------------------------------------------------------ graph


def _small_graph(s: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    cust = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("reading"), F.col("o_custkey").alias("asset"), F.col("o_totalprice").alias("temp"))
    g = Graph()
    g.source("assets", cust)
    g.source("readings", orders, external=True)
    g.apply("calibrated", Calibrate("temp", 2.0), "readings")
    g.apply("joined", Join("id", "asset", ["name"], ["reading", "temp"]), "assets", "calibrated")
    g.submit("assets", zset.from_rows(cust))
    g.submit("readings", zset.from_rows(orders))
    return g, g.state_of("joined")


@query("SELECT 'readings' AS stream, o_custkey AS asset, o_orderkey AS reading, round(temp, 2) AS temp, CAST(w AS BIGINT) AS _w FROM (SELECT o_custkey, o_orderkey, o_totalprice AS temp, -1 AS w FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_custkey, o_orderkey, o_totalprice + 10, 1 FROM orders WHERE o_totalprice > 200000) JOIN customer ON c_custkey = o_custkey")
def graph_outbox(spark: SparkSession, d: str) -> DataFrame:
    """An edit of joined readings travels back through the join and the calibration to the owner's outbox; customers get nothing."""
    g, joined = _small_graph(spark, d)
    old = joined.where("temp > 200002")
    g.push_backward("joined", zset.plus(zset.neg(old), old.withColumn("temp", F.col("temp") + 10)), author="me", note="warmer")
    out = _union([x.select(F.lit(n).alias("stream"), "asset", "reading", F.round("temp", 2).alias("temp"), WEIGHT) for n, x, _ in g.drain_outbox()])
    assert not g.drain_outbox() and {e["author"] for e in g.blame("assets")} == {""}
    return out


@query("SELECT 'warm' AS node, 2 AS computed, 1 AS told UNION ALL SELECT 'per_asset', 1, 1")
def graph_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """A change that a filter lets nothing through of stops there; an echo and an own write that comes back do nothing."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("reading"), F.col("o_custkey").alias("asset"), F.col("o_totalprice").alias("temp"))
    g = Graph()
    g.source("readings", orders)
    g.apply("warm", Filter(F.col("temp") >= 0), "readings")
    g.apply("per_asset", Count("asset"), "warm")
    told = {"warm": 0, "per_asset": 0}
    for n in told:
        g.observe(n, lambda delta, n=n: told.update({n: told[n] + 1}))
    change = zset.from_rows(orders)
    g.submit("readings", change, key="a")
    g.submit("readings", change.withColumn("temp", -F.col("temp") - 1))
    g.submit("readings", change, origin="echo")
    g.expect_echo("b")
    g.submit("readings", change, key="b")
    return spark.createDataFrame([(n, g.computed[n], told[n]) for n in told], "node string, computed int, told int")


@query("SELECT p_partkey, p_size, CAST(1 AS BIGINT) AS _w FROM part")
def lens_map_backward(spark: SparkSession, d: str) -> DataFrame:
    """A transformation with its inverse: back from what it gave."""
    lens = Map("twice", lambda z: z.withColumn("p_size", F.col("p_size") * 2), lambda z: z.withColumn("p_size", (F.col("p_size") / 2).cast("int")))
    return lens.backward(lens.forward(zset.from_rows(table(spark, d, "part").select("p_partkey", "p_size"))), [])[0]


@query("SELECT o_orderkey, o_totalprice FROM (SELECT DISTINCT o_orderkey, o_totalprice FROM orders) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def graph_topk(spark: SparkSession, d: str) -> DataFrame:
    """A top maintained by changes: rows that come are ranked with it, and rows that go bring up those below."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    g = Graph()
    g.source("orders", o.drop("o_orderstatus"))
    g.apply("top", TopK("o_totalprice", 20, tie=["o_orderkey"]), "orders")
    for status in ("F", "O", "P"):
        g.submit("orders", zset.from_rows(o.where(F.col("o_orderstatus") == status).drop("o_orderstatus")))
    more = zset.from_rows(o.drop("o_orderstatus").orderBy(F.desc("o_totalprice")).limit(5).withColumn("o_totalprice", F.col("o_totalprice") * 2))
    g.submit("orders", more)
    g.submit("orders", zset.neg(more))
    return zset.support(g.state_of("top"))


# ------------------------------------------------------------------------------------------------ workspace and folds

_KINDS = "CASE event_type WHEN 'error' THEN 'finding' WHEN 'purchase' THEN 'agenda' WHEN 'view' THEN 'activity' WHEN 'click' THEN 'star' ELSE 'talk' END"
_STATUS = "CASE event_type WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'open' END WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'active' ELSE 'open' END WHEN 'view' THEN CASE event_id % 2 WHEN 0 THEN 'failed' ELSE 'built' END ELSE '' END"
_J = f"j AS (SELECT event_id AS seq, {_KINDS} AS kind, CAST(user_id AS VARCHAR) AS key, {_STATUS} AS status, props AS text FROM events)"


def _workspace(s: SparkSession, d: str) -> Workspace:
    e = table(s, d, "events")
    j = e.select(F.col("event_id").alias("seq"), F.expr(_KINDS).alias("kind"), F.col("user_id").cast("string").alias("key"), F.expr(_STATUS).alias("status"), F.col("props").alias("text"), F.lit("").alias("detail"), F.lit("feed").alias("author"))
    return Workspace(s, j.select(*(f.split()[0] for f in SCHEMA.split(", "))))


@query(f"WITH {_J}, l AS (SELECT key, max_by(status, seq) AS status FROM j WHERE kind = 'finding' GROUP BY 1) SELECT count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'resolved') AS resolved FROM l")
def workspace_findings(spark: SparkSession, d: str) -> DataFrame:
    return _workspace(spark, d).finding_counts()


@query("WITH f AS (SELECT props AS text, min(event_id) AS seq, min_by(event_type, event_id) AS s FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT text, seq, CASE WHEN s = 'error' THEN 'error' ELSE 'info' END AS severity FROM f WHERE text NOT IN (SELECT props FROM events WHERE event_type = 'view')")
def new_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings that are not known yet, each text once; a severity that is none is the mildest."""
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("text"), F.col("event_type").alias("severity"))
    return folds.new_findings(e.where("severity = 'view'"), e.where("severity <> 'view'"))


_AGENDA = f"WITH {_J}, a AS (SELECT key, max_by(status, seq) AS status, min(seq) AS arrived, max_by(text, seq) FILTER (WHERE text <> '') AS text FROM j WHERE kind = 'agenda' GROUP BY 1)"


@query(f"{_AGENDA} SELECT key, status, CAST(row_number() OVER (ORDER BY CASE status WHEN 'active' THEN 0 WHEN 'open' THEN 1 ELSE 2 END, arrived) AS INTEGER) AS place FROM a")
def workspace_plan(spark: SparkSession, d: str) -> DataFrame:
    """The agenda in order: active, open, done."""
    ordered = _workspace(spark, d).ordered_agenda().select("key", "status").collect()  # a row per task, as it is shown
    return spark.createDataFrame([(r["key"], r["status"], i) for i, r in enumerate(ordered, 1)], "key string, status string, place int")


@query(f"{_AGENDA} SELECT 'head' AS what, key FROM (SELECT key FROM a WHERE status <> 'done' ORDER BY arrived LIMIT 1) UNION ALL SELECT 'said', key FROM (SELECT key FROM a WHERE status <> 'done' AND text LIKE '%{{%' ORDER BY arrived LIMIT 1) UNION ALL SELECT 'key', max(key) FROM a")
def workspace_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The first open task, one found by what its text says, and one by its key."""
    w = _workspace(spark, d)
    last = w.agenda().agg(F.max("key")).first()[0]
    return spark.createDataFrame([("head", w.agenda_head().first()["key"]), ("said", w.find_task("{")), ("key", w.find_task(last))], "what string, key string")


@query(
    f"""{_AGENDA} SELECT 'talk' AS part, CAST(seq AS VARCHAR) AS what FROM (SELECT seq FROM j WHERE kind = 'talk' ORDER BY seq DESC LIMIT 40) UNION ALL SELECT 'agenda', key FROM (SELECT key FROM a WHERE status <> 'done' ORDER BY arrived LIMIT 12)
    UNION ALL SELECT 'actions', CAST(seq AS VARCHAR) FROM (SELECT seq FROM j WHERE kind = 'activity' ORDER BY seq DESC LIMIT 10)
    UNION ALL SELECT 'activity', CAST(seq AS VARCHAR) FROM (SELECT seq FROM (SELECT *, lag(status) OVER (ORDER BY seq) AS ps, lag(text) OVER (ORDER BY seq) AS pt FROM j WHERE kind = 'activity') WHERE ps IS DISTINCT FROM status OR pt IS DISTINCT FROM text ORDER BY seq DESC LIMIT 8)
    UNION ALL SELECT 'findings', key FROM (SELECT key FROM (SELECT key, max_by(status, seq) AS status, min(seq) AS arrived FROM j WHERE kind = 'finding' GROUP BY 1) WHERE status = 'open' ORDER BY arrived DESC LIMIT 8)"""
)
def workspace_perception(spark: SparkSession, d: str) -> DataFrame:
    """What there is to know at a glance."""
    p = _workspace(spark, d).perception()
    return _union([p[n].select(F.lit(n).alias("part"), F.col("key" if n in ("agenda", "findings") else "seq").cast("string").alias("what")) for n in ("talk", "agenda", "actions", "activity", "findings")])


@query(f"WITH {_J}, a AS (SELECT *, lag(status) OVER (ORDER BY seq) AS ps, lag(text) OVER (ORDER BY seq) AS pt FROM j WHERE kind = 'activity') SELECT seq, status, text FROM a WHERE ps IS DISTINCT FROM status OR pt IS DISTINCT FROM text ORDER BY seq DESC LIMIT 60")
def activity_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last sixty activities, without those that repeat the one before."""
    return _workspace(spark, d).activity().select("seq", "status", "text")


#: Steps of which each task has only failures of one subject and what is built at last, so that SQL can say how the story goes.
_STEPS = "SELECT o_custkey AS task, o_orderkey AS seq, CASE WHEN o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AND o_custkey % 2 = 0 THEN 'built' ELSE 'failed' END AS kind FROM orders"


def _steps(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "orders").createOrReplaceTempView("steps_orders")
    told = s.sql(_STEPS.replace("FROM orders", "FROM steps_orders")).select("task", "seq", "kind", F.lit("it").alias("subject"), F.col("seq").cast("string").alias("detail"))
    return folds.story(told, "task", "seq")


@query(f"SELECT task, max(seq) AS seq, CASE WHEN task % 2 = 0 THEN 'built' ELSE 'failed' END AS kind, CAST(max(seq) AS VARCHAR) AS detail, CAST(count(*) AS INTEGER) AS tries FROM ({_STEPS}) GROUP BY task")
def story_tries(spark: SparkSession, d: str) -> DataFrame:
    """Failures become one with their number, and what is built in the end takes them in."""
    return _steps(spark, d).select("task", "seq", "kind", "detail", "tries")


@query(
    f"""WITH s AS (SELECT task, count(*) AS n FROM ({_STEPS}) GROUP BY task) SELECT task, CASE WHEN n = 1 THEN NULL WHEN task % 2 = 0 THEN 'succeeded after ' || (n - 1) || CASE WHEN n = 2 THEN ' failed attempt' ELSE ' failed attempts' END ELSE 'tried ' || n || ' times; the latest error:' END AS note,
    c_name AS part_of FROM s LEFT JOIN customer ON c_custkey = task"""
)
def step_pages(spark: SparkSession, d: str) -> DataFrame:
    """The page of each step: how many tries it took, and what it is part of."""
    tasks = table(spark, d, "customer").select(F.col("c_custkey").alias("task"), F.col("c_name").alias("text"))
    return folds.step_page(_steps(spark, d), tasks).select("task", "note", "part_of")


@query(
    """WITH c AS (SELECT event_id, user_id AS turn, CASE event_type WHEN 'view' THEN 'show:' || value || ':' || CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END || ':' WHEN 'click' THEN 'search:pump' WHEN 'error' THEN 'record_profile:' || CAST(event_id % 5 AS VARCHAR) ELSE 'other ' || CAST(event_id % 7 AS VARCHAR) END AS k
    FROM (SELECT event_id, user_id, event_type, CAST(event_id % 3 AS VARCHAR) AS value FROM events)) SELECT turn, min(event_id) AS event_id FROM c GROUP BY turn, k"""
)
def tool_calls_once(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls that ask the same again within a turn are made once."""
    e = table(spark, d, "events")
    args = F.when(F.col("event_type") == "view", F.to_json(F.struct((F.col("event_id") % 3).cast("string").alias("view"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("").alias("source"), F.lit("b").alias("name"))))
    args = args.when(F.col("event_type") == "click", F.concat(F.lit('{"query":"'), F.when(F.col("event_id") % 2 == 0, "Pump").otherwise("pUMP"), F.lit('"}')))
    args = args.when(F.col("event_type") == "error", F.to_json(F.struct((F.col("event_id") % 5).cast("string").alias("field"), F.col("event_id").cast("string").alias("value"))))
    tool = F.when(F.col("event_type") == "view", "show").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "error", "record_profile")
    call = F.when(tool.isNotNull(), F.concat(F.lit('{"tool":"'), tool, F.lit('","args":'), args, F.lit("}"))).otherwise(F.concat(F.lit("other "), (F.col("event_id") % 7).cast("string")))
    return folds.once_per_turn(e.select(F.col("user_id").alias("turn"), "event_id", call.alias("call")), "turn", "event_id", "call").select("turn", "event_id")


# ------------------------------------------------------------------------------------------------ entities and texts


@query(
    """WITH b AS (SELECT assetid AS id FROM timeseries WHERE assetid IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), t AS (SELECT DISTINCT id, starttime, assetids FROM asset_events)
    SELECT 'asset' AS part, id AS key FROM (SELECT DISTINCT * FROM assets) WHERE id IN (FROM b) UNION ALL SELECT 'sensors', id FROM (SELECT DISTINCT * FROM timeseries) WHERE assetid IN (FROM b)
    UNION ALL SELECT 'events', id FROM (SELECT t.id FROM t, b WHERE list_contains(list_transform(string_split(assetids, ';'), lambda x: trim(x)), CAST(b.id AS VARCHAR)) ORDER BY starttime DESC NULLS LAST, t.id LIMIT 60)
    UNION ALL SELECT 'documents', doc_id FROM documents WHERE doc_id % 7 = 0"""
)
def asset_page_busiest(spark: SparkSession, d: str) -> DataFrame:
    """The page of the asset with the most sensors: itself, its sensors, its latest events, and the documents that name it."""
    series_ = table(spark, d, "timeseries")
    busiest = series_.where("assetid is not null").groupBy("assetid").count().orderBy(F.desc("count"), "assetid").first()["assetid"]
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(busiest), F.lit(1))).otherwise(F.array(F.lit(2))).alias("assetids"))
    ev = table(spark, d, "asset_events").select("id", "starttime", "assetids").distinct()
    parts = entity.asset_page(busiest, zset.support_of(table(spark, d, "assets")), zset.support_of(series_), ev, docs)
    return _union([df.select(F.lit(n).alias("part"), F.col("id").alias("key")) for n, df in parts.items()])


_SPACES = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}\\x{0b}]+"


@query(f"SELECT doc_id, md5(regexp_replace(text, '{_SPACES}', '', 'g')) AS content, true AS fits FROM documents WHERE regexp_replace(text, '{_SPACES}', '', 'g') <> ''")
def chunks_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each document hold all of its text in order, and none is too large."""
    c = semantic.chunk(table(spark, d, "documents"), "doc_id", "text")
    whole = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x["chunk"]), "").alias("t"), F.max(F.octet_length("chunk")).alias("most"))
    return whole.select("doc_id", F.md5(F.regexp_replace("t", _SPACES, "")).alias("content"), (F.col("most") <= semantic.CHUNK).alias("fits"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def top_of_each(spark: SparkSession, d: str) -> DataFrame:
    """The first three of each user's events by value."""
    from lensframe.operators.lenses import top_per_group

    return top_per_group(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", [F.desc("value"), F.asc("event_id")], 3)


@query(f"SELECT ref, count(*) AS events FROM (SELECT DISTINCT id, trim(unnest(string_split(assetids, ';'))) AS ref FROM asset_events WHERE assetids IS NOT NULL) WHERE ref <> '' GROUP BY 1")
def events_per_reference(spark: SparkSession, d: str) -> DataFrame:
    return entity.event_counts(_event_refs(spark, d))
