"""Queries over the engine's own operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.functions import scalars
from lensframe.operators import cdc, entity, folds, joins, layers, profile, semantic, series, tableview, views, zset
from lensframe.operators.lenses import Calibrate, Count, Filter, Join, Map, TopK
from lensframe.operators.zset import WEIGHT
from lensframe.plans.catalog import Catalog
from lensframe.plans.graph import Graph
from lensframe.session import table

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[[str | None], Callable[[Query], Query]]]:
    """Queries and their SQL by name, and the decorator that adds to both."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            queries[fn.__name__] = fn
            if sql:
                oracles[fn.__name__] = sql
            return fn

        return add

    return queries, oracles, query


QUERIES, ORACLES, query = registry()


def _ms(c: str) -> F.Column:  # type: ignore[name-defined]
    return F.unix_millis(F.col(c).cast("timestamp")).alias(c)


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


# ------------------------------------------------------------------------------------------------ the first loop


@query(
    """SELECT c_name AS name, o_custkey AS custkey, o_orderkey AS orderkey, round(o_totalprice + 2.0, 2) AS price
    FROM (SELECT DISTINCT c_custkey, c_name FROM customer) JOIN (SELECT DISTINCT o_custkey, o_orderkey, o_totalprice FROM orders) ON c_custkey = o_custkey
    WHERE o_totalprice + 2.0 >= 40000 ORDER BY price DESC, orderkey DESC LIMIT 10"""
)
def milestone_join_table(spark: SparkSession, d: str) -> DataFrame:
    """Calibrate, filter, join, and the first window of the ordered table."""
    cust = zset.from_rows(table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name")))
    orders = zset.from_rows(table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price")))
    warm = Filter(F.col("price") >= 40000).forward(Calibrate("price", 2.0).forward(orders))
    joined = zset.support(Join("custkey", "custkey", ["name"], ["orderkey", "price"]).forward(cust, warm))
    rounded = joined.withColumn("price", F.round("price", 2))
    return tableview.window(rounded, "price", "orderkey", 0, 10, descending=True).select("name", "custkey", "orderkey", "price")


# ------------------------------------------------------------------------------------------------ Z-sets

_KEYS = "SELECT k, CAST(sum(w) AS BIGINT) AS _w FROM ({}) GROUP BY k HAVING sum(w) <> 0"


def _custkeys(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return zset.from_rows(table(s, d, "customer").select(F.col("c_custkey").alias("k"))), zset.from_rows(table(s, d, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def zset_support(spark: SparkSession, d: str) -> DataFrame:
    return zset.support(zset.from_rows(table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")))


@query(_KEYS.format("SELECT c_custkey AS k, 1 AS w FROM customer UNION ALL SELECT o_custkey, 1 FROM orders"))
def zset_plus(spark: SparkSession, d: str) -> DataFrame:
    return zset.plus(*_custkeys(spark, d))


@query(_KEYS.format("SELECT c_custkey AS k, 1 AS w FROM customer UNION ALL SELECT o_custkey, -1 FROM orders"))
def zset_minus(spark: SparkSession, d: str) -> DataFrame:
    return zset.minus(*_custkeys(spark, d))


@query(_KEYS.format("SELECT o_custkey AS k, -1 AS w FROM orders"))
def zset_neg(spark: SparkSession, d: str) -> DataFrame:
    return zset.neg(_custkeys(spark, d)[1])


@query("SELECT k, CAST(1 AS BIGINT) AS _w FROM (" + _KEYS.format("SELECT c_custkey AS k, -1 AS w FROM customer UNION ALL SELECT o_custkey, 1 FROM orders") + ") WHERE _w > 0")
def zset_distinct(spark: SparkSession, d: str) -> DataFrame:
    cust, orders = _custkeys(spark, d)
    return zset.distinct(zset.minus(orders, cust))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS _w FROM lineitem GROUP BY ALL")
def zset_map_collapse(spark: SparkSession, d: str) -> DataFrame:
    z = zset.from_rows(table(spark, d, "lineitem"))
    return zset.select(z, "l_returnflag", "l_linestatus")


@query(
    """SELECT o_orderkey, o_totalprice, CAST(sum(w) AS BIGINT) AS _w FROM (
    SELECT o_orderkey, o_totalprice, -1 AS w FROM orders UNION ALL
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END, 1 FROM orders) GROUP BY ALL HAVING sum(w) <> 0"""
)
def zset_update(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose new value equals the old one net to nothing."""
    o = _orders(spark, d)
    new = o.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    return zset.update(o.select("o_orderkey", "o_totalprice"), new.select("o_orderkey", "o_totalprice"))


@query("SELECT n_name, n_regionkey, CAST(count(*) AS BIGINT) AS _w FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def zset_wire(spark: SparkSession, d: str) -> DataFrame:
    """A Z-set over the boundary and back."""
    z = zset.from_rows(table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n_regionkey"))
    return zset.from_wire(zset.to_wire(z), "n_name string, n_regionkey int")


# ------------------------------------------------------------------------------------------------ lenses


def _events(s: SparkSession, d: str) -> DataFrame:
    return zset.from_rows(table(s, d, "events").select("event_id", "user_id", "event_type", "value"))


@query("SELECT event_id, user_id, event_type, round(value + 2.5, 6) AS value, CAST(count(*) AS BIGINT) AS _w FROM events GROUP BY ALL")
def lens_calibrate(spark: SparkSession, d: str) -> DataFrame:
    return Calibrate("value", 2.5).forward(_events(spark, d)).withColumn("value", F.round("value", 6))


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value, CAST(count(*) AS BIGINT) AS _w FROM events GROUP BY ALL")
def lens_calibrate_backward(spark: SparkSession, d: str) -> DataFrame:
    """Backward of forward is the input."""
    lens = Calibrate("value", 2.5)
    return lens.backward(lens.forward(_events(spark, d)), [])[0].withColumn("value", F.round("value", 6))


@query("SELECT event_id, user_id, event_type, value, CAST(count(*) AS BIGINT) AS _w FROM events WHERE value > 50 AND event_type <> 'view' GROUP BY ALL")
def lens_filter(spark: SparkSession, d: str) -> DataFrame:
    return Filter((F.col("value") > 50) & (F.col("event_type") != "view")).forward(_events(spark, d))


@query("SELECT upper(event_type) AS kind, CAST(user_id % 10 AS BIGINT) AS last_digit, CAST(count(*) AS BIGINT) AS _w FROM events GROUP BY ALL")
def lens_map(spark: SparkSession, d: str) -> DataFrame:
    lens = Map("kind", lambda z: z.select(F.upper("event_type").alias("kind"), (F.col("user_id") % 10).alias("last_digit"), WEIGHT))
    return lens.forward(_events(spark, d))


_JOIN = "SELECT c_name, o_custkey, o_orderkey, o_totalprice, CAST(sum(w) AS BIGINT) AS _w FROM ({}) o JOIN customer ON c_custkey = o_custkey GROUP BY ALL HAVING sum(w) <> 0"


def _join_lens() -> Join:
    return Join("o_custkey", "c_custkey", ["o_orderkey", "o_totalprice"], ["c_name"])


def _join_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return zset.from_rows(_orders(s, d)), zset.from_rows(table(s, d, "customer").select("c_custkey", "c_name"))


@query(_JOIN.format("SELECT *, 1 AS w FROM orders"))
def lens_join(spark: SparkSession, d: str) -> DataFrame:
    return _join_lens().forward(*_join_inputs(spark, d))


@query(
    """SELECT t.name AS series, t.assetid, a.id AS child, CAST(count(*) AS BIGINT) AS _w FROM (SELECT DISTINCT name, assetid FROM timeseries) t
    JOIN (SELECT DISTINCT id, parentid FROM assets) a ON t.assetid IS NOT DISTINCT FROM a.parentid GROUP BY ALL"""
)
def lens_join_null_safe(spark: SparkSession, d: str) -> DataFrame:
    """Series beside the children of their asset; series of no asset meet assets of no parent."""
    t = zset.from_rows(table(spark, d, "timeseries").select(F.col("name").alias("series"), "assetid").distinct())
    a = zset.from_rows(table(spark, d, "assets").select(F.col("id").alias("child"), "parentid").distinct())
    return Join("assetid", "parentid", ["series"], ["child"]).forward(t, a)


@query(_JOIN.format("SELECT *, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE -1 END AS w FROM orders WHERE o_orderstatus IN ('P', 'F')"))
def lens_join_delta(spark: SparkSession, d: str) -> DataFrame:
    """The join's change as orders in progress come in and finished ones go."""
    orders, cust = _join_inputs(spark, d)
    delta = orders.where(F.col("o_orderstatus").isin("P", "F")).withColumn(WEIGHT, F.when(F.col("o_orderstatus") == "P", F.col(WEIGHT)).otherwise(-F.col(WEIGHT)))
    after = orders.where("o_orderstatus <> 'F'")
    return _join_lens().delta([delta, cust.limit(0)], [after, cust])


@query(
"SELECT c_custkey AS k, c_nationkey AS nat, c_name AS name, CAST(count(*) AS BIGINT) AS _w FROM customer WHERE c_acctbal >= 5000 GROUP BY ALL"
)
def lens_join_diamond(spark: SparkSession, d: str) -> DataFrame:
    """Both inputs change at once: what both changed must not count twice."""
    c = table(spark, d, "customer")
    left = zset.from_rows(c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nat"), "c_acctbal"))
    right = zset.from_rows(c.select(F.col("c_custkey").alias("rk"), F.col("c_name").alias("name"), "c_acctbal"))
    lens = Join("k", "rk", ["nat"], ["name"])
    rich = F.col("c_acctbal") >= 5000
    return lens.delta([left.where(rich), right.where(rich)], [left, right])


@query("SELECT o_orderkey, o_totalprice, CAST(sum(w) AS BIGINT) AS _w FROM (SELECT o_orderkey, o_totalprice, -1 AS w FROM orders UNION ALL SELECT o_orderkey, o_totalprice + 1000, 1 FROM orders) GROUP BY ALL HAVING sum(w) <> 0")
def lens_join_backward(spark: SparkSession, d: str) -> DataFrame:
    """An edit of joined prices reaches the orders; the customers' side nets to nothing and adds none."""
    lens = _join_lens()
    out = lens.forward(*_join_inputs(spark, d))
    edit = zset.plus(zset.neg(out), out.withColumn("o_totalprice", F.col("o_totalprice") + 1000))
    left, right = lens.backward(edit, [])
    untouched = zset.consolidate(right).select(F.lit(None).cast("bigint").alias("o_orderkey"), F.lit(None).cast("double").alias("o_totalprice"), WEIGHT)
    return zset.select(left, "o_orderkey", "o_totalprice").unionByName(untouched)


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS count, CAST(1 AS BIGINT) AS _w FROM events GROUP BY ALL")
def lens_count(spark: SparkSession, d: str) -> DataFrame:
    return Count("event_type").forward(_events(spark, d))


@query(
    """WITH n AS (SELECT user_id, count(*) AS after, count(*) + sum(CASE WHEN event_type = 'error' THEN 0 ELSE 0 END) AS x, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS moved FROM events GROUP BY user_id)
    SELECT user_id, CAST(after - moved AS BIGINT) AS count, CAST(-1 AS BIGINT) AS _w FROM n WHERE moved > 0 AND after - moved > 0
    UNION ALL SELECT user_id, CAST(after AS BIGINT), CAST(1 AS BIGINT) FROM n WHERE moved > 0 AND after > 0"""
)
def lens_count_delta(spark: SparkSession, d: str) -> DataFrame:
    """Counts per user as the errors come in: only users that have errors change."""
    e = _events(spark, d)
    return Count("user_id").delta([e.where("event_type = 'error'")], [e])


@query("SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(1 AS BIGINT) AS _w FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def lens_topk(spark: SparkSession, d: str) -> DataFrame:
    return TopK("o_totalprice", 25, tie=["o_orderkey"]).forward(zset.from_rows(_orders(spark, d)))


@query(
    """WITH a AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25),
    b AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)
    SELECT o_orderkey, o_totalprice, CAST(sum(w) AS BIGINT) AS _w FROM (SELECT *, 1 AS w FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL HAVING sum(w) <> 0"""
)
def lens_topk_delta(spark: SparkSession, d: str) -> DataFrame:
    """What changes at the top as the urgent orders come in."""
    o = zset.from_rows(_orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderpriority"))
    out = TopK("o_totalprice", 25, tie=["o_orderkey"]).delta([o.where("o_orderpriority = '1-URGENT'")], [o])
    return zset.select(out, "o_orderkey", "o_totalprice")


# ------------------------------------------------------------------------------------------------ graph


def _graph(s: SparkSession, d: str) -> Graph:
    cust = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("reading"), F.col("o_custkey").alias("asset"), F.col("o_totalprice").alias("temp"), "o_orderstatus")
    g = Graph()
    g.source("assets", cust)
    g.source("readings", orders.drop("o_orderstatus"), external=True)
    g.apply("calibrated", Calibrate("temp", 2.0), "readings")
    g.apply("warm", Filter(F.col("temp") >= 40000), "calibrated")
    g.apply("joined", Join("id", "asset", ["name"], ["reading", "temp"]), "assets", "warm")
    g.apply("per_asset", Count("id"), "joined")
    g.submit("assets", zset.from_rows(cust), author="load", note="customers")
    for status in ("F", "O", "P"):
        g.submit("readings", zset.from_rows(orders.where(F.col("o_orderstatus") == status).drop("o_orderstatus")), author="feed", origin="upstream", note=f"status {status}")
    g.submit("readings", zset.neg(zset.from_rows(orders.where("o_orderstatus = 'P'").drop("o_orderstatus"))), author="feed", origin="upstream", note="taken back")
    return g


@query("SELECT c_custkey AS id, CAST(count(*) AS BIGINT) AS count, CAST(1 AS BIGINT) AS _w FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND o_totalprice + 2.0 >= 40000 GROUP BY ALL")
def graph_step(spark: SparkSession, d: str) -> DataFrame:
    """A count behind a join behind a filter, maintained change by change, some taken back: as if computed at once."""
    return _graph(spark, d).state_of("per_asset")


@query("WITH s AS (SELECT CAST(row_number() OVER (ORDER BY o_orderstatus) AS INTEGER) AS seq, 'feed' AS author, 'status ' || o_orderstatus AS note FROM (SELECT DISTINCT o_orderstatus FROM orders)) SELECT * FROM s UNION ALL SELECT max(seq) + 1, 'feed', 'taken back' FROM s WHERE 'status P' IN (SELECT note FROM s) HAVING count(*) > 0")
def graph_blame(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(e["seq"], e["author"], e["note"]) for e in _graph(spark, d).blame("readings")], "seq int, author string, note string")


# ------------------------------------------------------------------------------------------------ ordered tables


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def table_window(spark: SparkSession, d: str) -> DataFrame:
    return tableview.window(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 100, 50, descending=True)


@query(
    """WITH a AS (SELECT o_orderkey AS key, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS INTEGER) AS place, o_orderstatus AS st FROM orders QUALIFY place < 50),
    b AS (SELECT o_orderkey AS key, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS INTEGER) AS place, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS st FROM orders WHERE o_orderpriority <> '2-HIGH' QUALIFY place < 50),
    j AS (SELECT coalesce(a.key, b.key) AS key, a.place AS ap, b.place AS bp, a.st AS ast, b.st AS bst FROM a FULL JOIN b ON a.key = b.key)
    SELECT 'remove' AS op, key, ap AS place, NULL::VARCHAR AS "column", NULL::VARCHAR AS value FROM j WHERE bp IS NULL
    UNION ALL SELECT 'create', key, bp, NULL, NULL FROM j WHERE ap IS NULL
    UNION ALL SELECT 'move', key, bp, NULL, NULL FROM j WHERE ap <> bp
    UNION ALL SELECT 'set', key, bp, 'st', coalesce(bst, '') FROM j WHERE bp IS NOT NULL AND (ap IS NULL OR ast IS DISTINCT FROM bst)"""
)
def table_window_diff(spark: SparkSession, d: str) -> DataFrame:
    """What changes on screen as the high-priority orders go and open ones are renamed."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice", F.col("o_orderstatus").alias("st"), "o_orderpriority")
    new = o.where("o_orderpriority <> '2-HIGH'").withColumn("st", F.when(F.col("st") == "O", "open").otherwise(F.col("st")))
    a, b = (tableview.with_place(tableview.window(x, "o_totalprice", "key", 0, 50, True), "o_totalprice", "key", True) for x in (o, new))
    return tableview.window_diff(a, b, "key", ["st"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE '%1%' OR CAST(s_suppkey AS VARCHAR) LIKE '%1%' OR CAST(s_nationkey AS VARCHAR) LIKE '%1%' ORDER BY s_suppkey LIMIT 200")
def show_table(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with a 1 in a column, by key."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").orderBy("s_suppkey")
    return tableview.show(s, ["S SuppKey", "s_name", "no such"], contains="1", limit=500)


@query("SELECT r_regionkey || ' | ' || r_name AS line FROM region")
def table_render(spark: SparkSession, d: str) -> DataFrame:
    return tableview.render(table(spark, d, "region"), ["r_regionkey", "r_name"])


@query("SELECT o_orderkey, max_by(o_orderstatus, o_totalprice) AS status FROM orders GROUP BY o_orderkey HAVING max_by(o_orderpriority, o_totalprice) <> '5-LOW'")
def table_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last change per order, in order of price; low-priority ones delete."""
    o = table(spark, d, "orders")
    changes = o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("seq"), (F.col("o_orderpriority") == "5-LOW").alias("deleted"))
    return tableview.upsert(o.select("o_orderkey", F.col("o_orderstatus").alias("status")).limit(0), changes, "o_orderkey", "seq")


# ------------------------------------------------------------------------------------------------ change capture

_SNAPSHOTS = """a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'),
    b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW')"""


def _snapshots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    a = o.where("o_orderpriority <> '1-URGENT'").drop("o_orderpriority")
    b = o.where("o_orderpriority <> '5-LOW'").drop("o_orderpriority").withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return a, b


@query(f"WITH {_SNAPSHOTS} SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(sum(w) AS BIGINT) AS _w FROM (SELECT *, -1 AS w FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL HAVING sum(w) <> 0")
def cdc_poll_diff(spark: SparkSession, d: str) -> DataFrame:
    return cdc.poll_diff(*_snapshots(spark, d), key="o_orderkey")


@query(f"WITH {_SNAPSHOTS} SELECT * FROM b")
def cdc_write_through(spark: SparkSession, d: str) -> DataFrame:
    """An edit made of the difference turns one snapshot into the other."""
    a, b = _snapshots(spark, d)
    return cdc.write_through(a, cdc.poll_diff(a, b, "o_orderkey"), "o_orderkey")


@query("SELECT CAST(0 AS BIGINT) AS changes, CAST(count(*) AS BIGINT) AS known FROM orders WHERE o_orderpriority <> '5-LOW'")
def cdc_echo(spark: SparkSession, d: str) -> DataFrame:
    """After an own write the next poll finds nothing."""
    a, b = _snapshots(spark, d)
    t = cdc.KeyedTable(a, "o_orderkey")
    t.poll()
    t.write(cdc.poll_diff(a, b, "o_orderkey"))
    return t.poll().agg(F.count("*").alias("changes")).crossJoin(t.known.agg(F.count("*").alias("known")))


# ------------------------------------------------------------------------------------------------ profiles


def _report_sql(name: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        empty = f"({c} IS NULL OR CAST({c} AS VARCHAR) = '')" if kind == "string" else f"{c} IS NULL"
        parts.append(
            f"SELECT '{c}' AS field, '{kind}' AS kind, count(*) AS rows, count(*) FILTER (WHERE NOT {empty}) AS filled, count(DISTINCT CASE WHEN NOT {empty} THEN {c} END) AS dist FROM (SELECT DISTINCT * FROM {name})"
        )
    return f"""SELECT field, CASE WHEN filled = 0 THEN 'empty' ELSE kind END AS type, rows, filled, dist AS "distinct",
    CAST(CASE WHEN rows = filled THEN 0 ELSE greatest(1, floor(100.0 * (rows - filled) / rows + 0.5)) END AS INTEGER) AS empty_pct,
    CASE WHEN filled = rows AND dist = rows THEN 'key' WHEN dist = 1 THEN 'constant' WHEN kind = 'string' AND dist BETWEEN 2 AND 12 AND filled >= 3 * dist THEN 'enum' END AS role
    FROM ({' UNION ALL '.join(parts)})"""


@query(_report_sql("orders", {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "number", "o_orderpriority": "string"}).replace("SELECT DISTINCT * FROM orders", "SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"))
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    """Keys, constants, enumerations and empties of the orders."""
    return profile.columns_report(_orders(spark, d)).drop("any_value")


@query(_report_sql("timeseries", {"id": "number", "externalid": "string", "name": "string", "unit": "string", "isstring": "boolean", "assetid": "number", "description": "string"}))
def profile_timeseries(spark: SparkSession, d: str) -> DataFrame:
    """The same for a table with blanks, nulls and repeated rows."""
    return profile.columns_report(table(spark, d, "timeseries")).drop("any_value")


@query("SELECT o_orderpriority AS value, count(*) AS n, min(o_orderkey) AS first_seen FROM orders GROUP BY 1")
def profile_enums(spark: SparkSession, d: str) -> DataFrame:
    return profile.enum_values(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


@query(
    """WITH v AS (SELECT DISTINCT c_custkey, c_name FROM customer), m AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c_name,
    '[0-9]{6,}', '######', 'g'), '(^|[^0-9#])[0-9]{5}($|[^0-9])', '\\1#####\\2', 'g'), '(^|[^0-9#])[0-9]{4}($|[^0-9])', '\\1####\\2', 'g'), '(^|[^0-9#])[0-9]{3}($|[^0-9])', '\\1###\\2', 'g'), '(^|[^0-9#])[0-9]{2}($|[^0-9])', '\\1##\\2', 'g'), '(^|[^0-9#])[0-9]($|[^0-9])', '\\1#\\2', 'g') AS p FROM v)
    SELECT 'c_name' AS field, p AS pattern, CAST(floor(100.0 * n / total + 0.5) AS INTEGER) AS coverage FROM (SELECT p, count(*) AS n, sum(count(*)) OVER () AS total FROM m GROUP BY p) WHERE n >= 0.6 * total ORDER BY n DESC, p DESC LIMIT 1"""
)
def profile_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The form of the customers' names."""
    return profile.patterns(zset.support_of(table(spark, d, "customer").select("c_custkey", "c_name")), ["c_name"])


@query(
    """WITH t AS (SELECT DISTINCT name, externalid, unit, description FROM timeseries), c AS (SELECT coalesce(name, '') AS a, coalesce(externalid, '') AS b, coalesce(unit, '') AS c, coalesce(description, '') AS d FROM t),
    p AS (SELECT unnest([{'field': 'externalid', 'of': 'name', 's': avg((a = b)::INT), 'f': max((a <> '')::INT)}, {'field': 'unit', 'of': 'name', 's': avg((a = c)::INT), 'f': max((a <> '')::INT)},
    {'field': 'description', 'of': 'name', 's': avg((a = d)::INT), 'f': max((a <> '')::INT)}, {'field': 'unit', 'of': 'externalid', 's': avg((b = c)::INT), 'f': max((b <> '')::INT)},
    {'field': 'description', 'of': 'externalid', 's': avg((b = d)::INT), 'f': max((b <> '')::INT)}, {'field': 'description', 'of': 'unit', 's': avg((c = d)::INT), 'f': max((c <> '')::INT)}]) AS x FROM c)
    SELECT x.field AS field, x.of AS "of", CAST(CASE WHEN x.s < 0.98 THEN floor(100.0 * x.s + 0.5) END AS INTEGER) AS overlap FROM p WHERE x.s >= 0.6 AND x.f = 1"""
)
def profile_redundant(spark: SparkSession, d: str) -> DataFrame:
    return profile.redundant(table(spark, d, "timeseries").select("name", "externalid", "unit", "description"))


@query(
    """WITH keys AS (SELECT 'nation' AS target, 'n_nationkey' AS target_field, CAST(n_nationkey AS VARCHAR) AS v FROM nation UNION ALL SELECT 'nation', 'n_name', n_name FROM nation
        UNION ALL SELECT 'region', 'r_regionkey', CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT 'region', 'r_name', r_name FROM region
        UNION ALL SELECT 'customer', 'c_custkey', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'orders', 'o_orderkey', CAST(o_orderkey AS VARCHAR) FROM orders),
    parts AS (SELECT DISTINCT 'nation' AS source, 'n_regionkey' AS field, CAST(n_regionkey AS VARCHAR) AS v FROM nation UNION ALL SELECT DISTINCT 'customer', 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
        UNION ALL SELECT DISTINCT 'orders', 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
    tot AS (SELECT source, field, count(*) AS total FROM parts GROUP BY ALL HAVING count(*) >= 3),
    hit AS (SELECT p.source, p.field, k.target, k.target_field, count(*) AS hits FROM parts p JOIN keys k USING (v) WHERE p.source <> k.target OR p.field <> k.target_field GROUP BY ALL)
    SELECT source, field, 'ref' AS kind, target, target_field, hits, total FROM hit JOIN tot USING (source, field) WHERE hits >= 0.95 * total
    QUALIFY row_number() OVER (PARTITION BY source, field ORDER BY hits DESC, target, target_field) = 1"""
)
def profile_links(spark: SparkSession, d: str) -> DataFrame:
    """Which columns refer to which keys among four tables."""
    return profile.links(
        {
            "region": table(spark, d, "region"),
            "nation": table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"),
            "customer": table(spark, d, "customer").select("c_custkey", "c_nationkey"),
            "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        }
    )


@query("SELECT event_type AS source, CAST(user_id AS VARCHAR) AS field, 'title' AS fact, max_by(props, event_id) AS value FROM events WHERE props IS NOT NULL AND props <> '' GROUP BY ALL")
def claim_fold(spark: SparkSession, d: str) -> DataFrame:
    """The last claim per field holds."""
    claimed = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("field"), F.lit("title").alias("fact"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    return profile.fold_claims(claimed)


@query("SELECT DISTINCT table_name AS source, column_name AS field FROM duckdb_columns() WHERE table_name = 'customer' AND column_name <> 'c_name' OR table_name = 'nation' AND column_name <> 'n_name'")
def schema_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Columns without a title after two were given one."""
    cat = Catalog(spark)
    cat.register("customer", table(spark, d, "customer"))
    cat.register("nation", table(spark, d, "nation"))
    cat.annotate("customer", "C NAME", title="Customer")
    cat.annotate("nation", "n_name", title="Nation")
    return cat.gaps()


@query(
    """SELECT 'p_size' AS field, CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi, false AS is_date FROM part UNION ALL
    SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice), false FROM part UNION ALL SELECT 'p_partkey', min(p_partkey), max(p_partkey), false FROM part"""
)
def inspect_ranges(spark: SparkSession, d: str) -> DataFrame:
    return profile.inspect_ranges(table(spark, d, "part"))


@query(
    """WITH t AS (SELECT DISTINCT * FROM timeseries), g AS (SELECT unnest([{'f': 'unit', 'n': count(*) FILTER (WHERE unit IS NULL OR unit = '')}, {'f': 'assetid', 'n': count(*) FILTER (WHERE assetid IS NULL)}, {'f': 'description', 'n': count(*) FILTER (WHERE description IS NULL OR description = '')},
    {'f': 'name', 'n': count(*) FILTER (WHERE name IS NULL OR name = '')}, {'f': 'externalid', 'n': count(*) FILTER (WHERE externalid IS NULL OR externalid = '')}, {'f': 'isstring', 'n': count(*) FILTER (WHERE isstring IS NULL)}, {'f': 'id', 'n': count(*) FILTER (WHERE id IS NULL)}]) AS x, count(*) AS total FROM t)
    SELECT x.f AS field, CASE WHEN x.n = total THEN 'always' WHEN floor(100.0 * x.n / total + 0.5) < 1 THEN '<1%' ELSE CAST(floor(100.0 * x.n / total + 0.5) AS BIGINT) || '%' END AS empty FROM g WHERE x.n > 0"""
)
def inspect_gaps(spark: SparkSession, d: str) -> DataFrame:
    return profile.inspect_gaps(table(spark, d, "timeseries"))


@query("SELECT 'l_orderkey' AS field, count(*) - count(DISTINCT l_orderkey) AS repeats FROM (SELECT DISTINCT * FROM lineitem)")
def inspect_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return profile.inspect_duplicates(table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT lower(split_part(name, '.', -1)) AS extension, count(*) AS files FROM scanned_docs GROUP BY 1")
def inspect_documents(spark: SparkSession, d: str) -> DataFrame:
    return profile.inspect_documents(table(spark, d, "scanned_docs"))


# ------------------------------------------------------------------------------------------------ views


@query("SELECT CAST(count(*) AS DOUBLE) AS value FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders)")
def view_metric_count(spark: SparkSession, d: str) -> DataFrame:
    return views.metric(_orders(spark, d))


def _metric(agg: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return views.metric(_orders(spark, d), agg, "o_totalprice").select(F.round("value", 2).alias("value"))

    run.__name__ = f"view_metric_{agg}"
    query(f"SELECT round({agg}(o_totalprice), 2) AS value FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders)")(run)


for _agg in ("sum", "avg", "min", "max"):
    _metric(_agg)


@query(
    """WITH v AS (SELECT CAST(p_size AS DOUBLE) AS v FROM (SELECT DISTINCT * FROM part)), s AS (SELECT min(v) AS lo, max(v) AS hi, least(28, greatest(6, count(DISTINCT v))) AS bins FROM v),
    w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / bins ELSE 1 END AS w FROM s), c AS (SELECT CAST(least(bins - 1, floor((v - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM v, w GROUP BY 1)
    SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * w, 6) AS lo, coalesce(n, 0) AS n FROM w, (SELECT unnest(range(0, 28)) AS bin) g LEFT JOIN c ON c.bin = g.bin WHERE g.bin < bins"""
)
def view_histogram(spark: SparkSession, d: str) -> DataFrame:
    return views.histogram(table(spark, d, "part"), "p_size").withColumn("lo", F.round("lo", 6))


@query("SELECT CASE WHEN unit IS NULL OR unit = '' THEN '(empty)' ELSE unit END AS label, count(*) AS n FROM (SELECT DISTINCT * FROM timeseries) GROUP BY 1 ORDER BY n DESC, label LIMIT 20")
def view_histogram_cat(spark: SparkSession, d: str) -> DataFrame:
    return views.histogram_categories(table(spark, d, "timeseries"), "unit")


@query(
    """WITH dd AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders) GROUP BY 1), s AS (SELECT list_sort(list(n)) AS s FROM dd),
    q AS (SELECT s[1 + least(len(s) - 1, CAST(floor(0.85 * len(s)) AS BIGINT))] AS q85, s[1 + least(len(s) - 1, CAST(floor(0.5 * len(s)) AS BIGINT))] AS q50 FROM s),
    m AS (SELECT DISTINCT date_trunc('month', day) AS m FROM dd ORDER BY 1 DESC LIMIT 6)
    SELECT day, n, CASE WHEN n >= q85 THEN 'c3' WHEN n >= q50 THEN 'c2' ELSE 'c1' END AS shade FROM dd, q WHERE date_trunc('month', day) IN (SELECT m FROM m)"""
)
def view_calendar(spark: SparkSession, d: str) -> DataFrame:
    return views.calendar(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), "o_orderdate")


@query(
    """SELECT CAST(w AS INTEGER) AS weekday, CAST(h AS INTEGER) AS hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 7)) AS w), (SELECT unnest(range(0, 24)) AS h) LEFT JOIN
    (SELECT isodow(ts) - 1 AS wd, hour(ts) AS hr, count(*) AS n FROM (SELECT DISTINCT * FROM events) GROUP BY ALL) ON wd = w AND hr = h"""
)
def view_heatmap_time(spark: SparkSession, d: str) -> DataFrame:
    return views.heatmap_time(table(spark, d, "events"), "ts")


@query(
    """WITH t AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders)
    SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS n FROM t GROUP BY ALL"""
)
def view_heatmap_xy(spark: SparkSession, d: str) -> DataFrame:
    return views.heatmap(_orders(spark, d), "o_orderstatus", "o_orderpriority")


@query(
    """WITH t AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders), s AS (SELECT o_orderpriority AS lane, count(*) AS lane_size, min(o_orderkey) AS f FROM t GROUP BY 1),
    l AS (SELECT lane, lane_size, CAST(row_number() OVER (ORDER BY lane_size DESC, f) AS INTEGER) AS lane_rank FROM s QUALIFY lane_rank <= 8),
    c AS (SELECT o_orderpriority AS lane, o_orderkey AS key, o_orderstatus AS title, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS card FROM t QUALIFY card <= 25)
    SELECT lane, lane_rank, lane_size, card, title, key FROM c JOIN l USING (lane)"""
)
def view_kanban(spark: SparkSession, d: str) -> DataFrame:
    return views.kanban(_orders(spark, d), "o_orderpriority", "o_orderkey", "o_orderstatus")


@query(
    """WITH c AS (SELECT p_brand AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM (SELECT DISTINCT * FROM part) GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS vals FROM c)
    SELECT CASE WHEN r > 7 THEN (vals - 7) || ' others' ELSE label END AS label, CAST(sum(n) AS BIGINT) AS n, CAST(floor(100.0 * sum(n) / max(total) + 0.5) AS BIGINT) AS pct FROM c, t GROUP BY 1"""
)
def view_donut(spark: SparkSession, d: str) -> DataFrame:
    return views.donut(table(spark, d, "part"), "p_brand")


@query(
    """WITH t AS (SELECT DISTINCT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM t)
    SELECT x, y FROM r WHERE n <= 1500 OR i % CAST(ceil(n / 1500) AS BIGINT) = 0"""
)
def view_scatter(spark: SparkSession, d: str) -> DataFrame:
    return views.scatter(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice", "p_partkey")


@query("SELECT round(greatest(0.2, cos(radians((min(lat) + max(lat)) / 2))), 9) AS aspect FROM (SELECT s_nationkey * 3.0 AS lat FROM supplier)")
def view_map_aspect(spark: SparkSession, d: str) -> DataFrame:
    pts = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * 3.0).alias("lat"), (F.col("s_acctbal") / 100).alias("lon"))
    return views.geo(pts, "lon", "lat", "s_suppkey")[1].select(F.round("aspect", 9).alias("aspect"))


@query(
    """WITH t AS (SELECT DISTINCT id, type, starttime AS a, endtime AS b FROM asset_events WHERE starttime > 946684800000 AND starttime < 4102444800000 AND endtime > 946684800000 AND endtime < 4102444800000 AND endtime >= starttime)
    SELECT id AS title, CASE WHEN type IS NULL OR type = '' THEN '(empty)' ELSE type END AS lane, a AS from_ms, b AS to_ms FROM t ORDER BY a DESC, id LIMIT 36"""
)
def view_gantt(spark: SparkSession, d: str) -> DataFrame:
    g = views.gantt(table(spark, d, "asset_events").select("id", "type", "starttime", "endtime"), "starttime", "endtime", "id", "type")
    return g.select("title", "lane", F.unix_millis("from_time").alias("from_ms"), F.unix_millis("to_time").alias("to_ms"))


@query(
    """WITH t AS (SELECT DISTINCT p_partkey AS k, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(p_partkey AS DOUBLE) AS z, p_brand AS g FROM part), s AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM t),
    r AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t), gg AS (SELECT g AS grp FROM t GROUP BY g ORDER BY min(k), g LIMIT 8)
    SELECT round((x - lx) / (hx - lx) - 0.5, 9) AS x, round((y - ly) / (hy - ly) - 0.5, 9) AS y, round((z - lz) / (hz - lz) - 0.5, 9) AS z, grp FROM r CROSS JOIN s LEFT JOIN gg ON g = grp WHERE n <= 4000 OR i % CAST(ceil(n / 4000) AS BIGINT) = 0"""
)
def view_cloud3d(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("z", F.col("p_partkey").cast("double"))
    c = views.cloud(p.select("p_partkey", "p_size", "p_retailprice", "z", "p_brand"), "p_size", "p_retailprice", "z", "p_partkey", "p_brand")
    return c.select(*(F.round(k, 9).alias(k) for k in "xyz"), "grp")


@query("SELECT doc_id AS key, text FROM documents WHERE text IS NOT NULL AND text <> '' ORDER BY coalesce(epoch_us(written_at), 0), doc_id LIMIT 30")
def view_reading(spark: SparkSession, d: str) -> DataFrame:
    return views.reading(table(spark, d, "documents").select("doc_id", "text", "written_at"), "text", "doc_id", "written_at")


@query(
    """WITH g AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m, count(*) AS n FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderdate FROM orders) GROUP BY 1), b AS (SELECT min(m) AS a, max(m) AS z FROM g),
    s AS (SELECT unnest(range(a, z + 1)) AS m FROM b) SELECT (s.m // 12) || '-' || lpad(CAST(s.m % 12 + 1 AS VARCHAR), 2, '0') AS month, coalesce(n, 0) AS n FROM s LEFT JOIN g ON g.m = s.m"""
)
def view_timeline(spark: SparkSession, d: str) -> DataFrame:
    return views.timeline(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate")


@query(
    """WITH RECURSIVE n AS (SELECT DISTINCT id, parentid FROM assets), up(id, anc, dist) AS (SELECT DISTINCT id, id, 0 FROM n UNION ALL SELECT up.id, n.parentid, dist + 1 FROM up JOIN n ON n.id = up.anc WHERE n.parentid IS NOT NULL AND n.parentid <> n.id AND n.parentid IN (SELECT id FROM n) AND dist < 64),
    own AS (SELECT assetid AS id, count(*) AS sensors FROM (SELECT DISTINCT * FROM timeseries) WHERE assetid IS NOT NULL GROUP BY 1),
    dp AS (SELECT id, max(dist) AS depth FROM up GROUP BY 1), su AS (SELECT anc AS id, sum(sensors) AS sensors FROM (SELECT DISTINCT id, anc FROM up) u JOIN own USING (id) GROUP BY 1)
    SELECT id, depth, CAST(coalesce(sensors, 0) AS BIGINT) AS sensors FROM dp LEFT JOIN su USING (id)"""
)
def view_tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Depth and number of sensors below each asset."""
    nodes = table(spark, d, "assets").select("id", F.col("parentid").alias("parent")).distinct()
    own = zset.support_of(table(spark, d, "timeseries")).where("assetid is not null").groupBy(F.col("assetid").alias("id")).agg(F.count("*").alias("sensors"))
    return views.tree_rollup(nodes, own, ["sensors"])


@query(
    """WITH RECURSIVE n AS (SELECT DISTINCT id, parentid FROM assets), up(id, anc, dist) AS (SELECT DISTINCT id, id, 0 FROM n UNION ALL SELECT up.id, n.parentid, dist + 1 FROM up JOIN n ON n.id = up.anc WHERE n.parentid IS NOT NULL AND n.parentid <> n.id AND n.parentid IN (SELECT id FROM n) AND dist < 64),
    so AS (SELECT assetid AS id, count(*) AS sensors FROM (SELECT DISTINCT * FROM timeseries) WHERE assetid IS NOT NULL GROUP BY 1),
    r AS (SELECT DISTINCT id, trim(unnest(string_split(assetids, ';'))) AS ref FROM asset_events WHERE assetids IS NOT NULL), eo AS (SELECT TRY_CAST(ref AS BIGINT) AS id, count(*) AS events FROM r WHERE regexp_full_match(ref, '[0-9]+') GROUP BY 1),
    dp AS (SELECT id, max(dist) AS depth FROM up GROUP BY 1),
    su AS (SELECT anc AS id, sum(sensors) AS sensors, sum(events) AS events FROM (SELECT DISTINCT id, anc FROM up) u LEFT JOIN so USING (id) LEFT JOIN eo USING (id) GROUP BY 1)
    SELECT id, depth, CAST(coalesce(sensors, 0) AS BIGINT) AS sensors, CAST(coalesce(events, 0) AS BIGINT) AS events FROM dp LEFT JOIN su USING (id)"""
)
def view_tree_rollup_events(spark: SparkSession, d: str) -> DataFrame:
    """Depth and number of sensors and events below each asset; an event counts once for each asset that it names."""
    nodes = table(spark, d, "assets").select("id", F.col("parentid").alias("parent")).distinct()
    sensors = zset.support_of(table(spark, d, "timeseries")).where("assetid is not null").groupBy(F.col("assetid").alias("id")).agg(F.count("*").alias("sensors"))
    events = entity.event_counts(_event_refs(spark, d).where(F.col("ref").rlike("^[0-9]+$"))).groupBy(F.col("ref").try_cast("bigint").alias("id")).agg(F.sum("events").alias("events"))
    return views.tree_rollup(nodes, sensors.join(events, "id", "full"), ["sensors", "events"])


@query("SELECT 'p_retailprice' AS curve, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part UNION ALL SELECT 'p_partkey', min(p_partkey), max(p_partkey) FROM part")
def view_depth_log(spark: SparkSession, d: str) -> DataFrame:
    return views.depth_log(table(spark, d, "part").withColumnRenamed("p_size", "md"), "md", ["p_retailprice", "p_partkey"])[1]


@query(
    """SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice BETWEEN (SELECT min(s_acctbal) FROM supplier) AND (SELECT max(s_acctbal) FROM supplier)
    AND c_nationkey IN (SELECT s_nationkey FROM supplier)"""
)
def depth_picks(spark: SparkSession, d: str) -> DataFrame:
    """Picks within the depths of a log, of the log's wells."""
    log = table(spark, d, "supplier").select("s_acctbal", F.concat(F.lit("no 15 / "), F.col("s_nationkey").cast("string")).alias("well"))
    picks = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_totalprice", F.concat(F.lit("15/"), F.col("c_nationkey").cast("string")).alias("wellbore"))
    return views.depth_picks(log, picks, "s_acctbal", "o_totalprice", "well", "wellbore").select("o_orderkey", "o_totalprice")


@query(
    """WITH e AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    b AS (SELECT *, ((i + 1) * 20 - 1) // n AS b FROM e WHERE n > 40), x AS (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY value, i) AS rl, row_number() OVER (PARTITION BY user_id, b ORDER BY value DESC, i) AS rh FROM b)
    SELECT user_id, (epoch_us(ts) // 1000) AS ts, value FROM e WHERE n <= 40 UNION ALL SELECT user_id, (epoch_us(ts) // 1000), value FROM x WHERE rl = 1 OR rh = 1"""
)
def downsample_minmax(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", _ms("ts"), "event_id", "value")
    return series.downsample(e, "user_id", "ts", "value", 40, "event_id")


@query("SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) >= (SELECT max((epoch_us(ts) // 1000)) FROM events) - 7 * 86400000")
def series_latest_window(spark: SparkSession, d: str) -> DataFrame:
    return series.latest_window(table(spark, d, "events").select("event_id", _ms("ts")), "ts", 7).select("event_id")


@query("SELECT user_id, count(value) AS points, min(value) AS lo, max(value) AS hi, min((epoch_us(ts) // 1000)) AS from_ts, max((epoch_us(ts) // 1000)) AS to_ts FROM events GROUP BY 1")
def series_chart(spark: SparkSession, d: str) -> DataFrame:
    return series.chart(table(spark, d, "events").select("user_id", _ms("ts"), "value"), "user_id", "ts", "value")


# ------------------------------------------------------------------------------------------------ entities and search

_REFS = "SELECT DISTINCT id, trim(unnest(string_split(assetids, ';'))) AS ref FROM asset_events WHERE assetids IS NOT NULL"


def _event_refs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "asset_events").where("assetids is not null").select("id", "assetids").distinct()
    return entity.references(e, "id", "assetids").distinct()


@query(
    """SELECT 'asset' AS part, CAST(id AS BIGINT) AS key FROM (SELECT DISTINCT * FROM assets) WHERE id = 4415915 UNION ALL SELECT 'sensors', id FROM (SELECT DISTINCT * FROM timeseries) WHERE assetid = 4415915
    UNION ALL SELECT 'events', id FROM (SELECT id FROM (SELECT DISTINCT id, starttime, assetids FROM asset_events) WHERE list_contains(list_transform(string_split(assetids, ';'), lambda x: trim(x)), '4415915') ORDER BY starttime DESC NULLS LAST, id LIMIT 60)"""
)
def asset_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of the busiest asset: itself, its sensors, its latest 60 events."""
    ev = table(spark, d, "asset_events").select("id", "starttime", "assetids").distinct()
    parts = entity.asset_page(4415915, zset.support_of(table(spark, d, "assets")), zset.support_of(table(spark, d, "timeseries")), ev)
    return reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("part"), F.col("id").alias("key")) for n, df in parts.items()))


@query(
    """SELECT * FROM (SELECT DISTINCT 'assets' AS section, CAST(id AS VARCHAR) AS key FROM assets WHERE lower(name) LIKE '%pump%' OR lower(description) LIKE '%pump%' ORDER BY key LIMIT 40)
    UNION ALL SELECT * FROM (SELECT DISTINCT 'sensors', CAST(id AS VARCHAR) AS key FROM timeseries WHERE lower(externalid) LIKE '%pump%' OR lower(name) LIKE '%pump%' OR lower(description) LIKE '%pump%' ORDER BY key LIMIT 40)
    UNION ALL SELECT * FROM (SELECT DISTINCT 'events', CAST(id AS VARCHAR) AS key FROM asset_events WHERE lower(description) LIKE '%pump%' OR lower(type) LIKE '%pump%' ORDER BY key LIMIT 30)"""
)
def search_substring(spark: SparkSession, d: str) -> DataFrame:
    return entity.search(
        "Pump",
        {
            "assets": (table(spark, d, "assets"), "id", ["name", "description"], 40),
            "sensors": (table(spark, d, "timeseries"), "id", ["externalid", "name", "description"], 40),
            "events": (table(spark, d, "asset_events"), "id", ["description", "type"], 30),
        },
    )


@query(
    """WITH f AS (SELECT * FROM (SELECT DISTINCT 'assets' AS section, CAST(id AS VARCHAR) AS key FROM assets WHERE lower(name) LIKE '%pump%' OR lower(description) LIKE '%pump%' ORDER BY key LIMIT 40)
    UNION ALL SELECT * FROM (SELECT DISTINCT 'sensors', CAST(id AS VARCHAR) AS key FROM timeseries WHERE lower(externalid) LIKE '%pump%' OR lower(name) LIKE '%pump%' OR lower(description) LIKE '%pump%' ORDER BY key LIMIT 40)
    UNION ALL SELECT * FROM (SELECT DISTINCT 'events', CAST(id AS VARCHAR) AS key FROM asset_events WHERE lower(description) LIKE '%pump%' OR lower(type) LIKE '%pump%' ORDER BY key LIMIT 30)
    UNION ALL SELECT * FROM (SELECT DISTINCT 'documents', CAST(scan_id AS VARCHAR) AS key FROM scanned_docs WHERE lower(name) LIKE '%pump%' ORDER BY key LIMIT 40))
    SELECT section, key, count(*) OVER (PARTITION BY section) AS in_section, count(*) OVER () AS total FROM f"""
)
def search_sections(spark: SparkSession, d: str) -> DataFrame:
    """All four sections of the search, documents by name among them, with the number of each and of all."""
    found = entity.search(
        "Pump",
        {
            "assets": (table(spark, d, "assets"), "id", ["name", "description"], 40),
            "sensors": (table(spark, d, "timeseries"), "id", ["externalid", "name", "description"], 40),
            "events": (table(spark, d, "asset_events"), "id", ["description", "type"], 30),
            "documents": (table(spark, d, "scanned_docs"), "scan_id", ["name"], 40),
        },
    )
    return entity.with_totals(found)


@query(f"WITH r AS ({_REFS}) SELECT ref, count(*) AS events FROM r WHERE ref <> '' AND ref NOT IN (SELECT CAST(assetid AS VARCHAR) FROM timeseries WHERE assetid IS NOT NULL) GROUP BY ref HAVING count(*) >= 2 ORDER BY events DESC, ref LIMIT 15")
def watch_blind_spots(spark: SparkSession, d: str) -> DataFrame:
    sensors = table(spark, d, "timeseries").select(F.col("assetid").cast("string").alias("ref")).where("ref is not null")
    return entity.blind_spots(entity.event_counts(_event_refs(spark, d)), sensors)


@query(
    f"""WITH r AS ({_REFS}), c AS (SELECT ref, count(*) AS events FROM r WHERE ref <> '' GROUP BY ref ORDER BY events DESC, ref LIMIT 10), s AS (SELECT CAST(assetid AS VARCHAR) AS ref, count(*) AS sensors FROM (SELECT DISTINCT * FROM timeseries) GROUP BY 1)
    SELECT ref, events, coalesce(sensors, 0) AS sensors FROM c LEFT JOIN s USING (ref)"""
)
def watch_hotspots(spark: SparkSession, d: str) -> DataFrame:
    sensors = zset.support_of(table(spark, d, "timeseries")).select(F.col("assetid").cast("string").alias("ref"))
    return entity.hotspots(entity.event_counts(_event_refs(spark, d)), sensors)


@query(
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 5) AS similarity FROM embeddings, q
    ORDER BY similarity DESC, vec_id LIMIT 6"""
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The vectors most like the first one."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    return semantic.cosine_topk(q, e, "embedding", "vec_id")


@query(
    """WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 5) AS similarity FROM embeddings, q)
    SELECT query, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) <= 6"""
)
def cosine_topk_each(spark: SparkSession, d: str) -> DataFrame:
    """The vectors most like each of those whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    return semantic.cosine_topk_each(e.where("vec_id % 50 = 0"), e, "embedding", "vec_id")


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents, 700 bytes at most."""
    return semantic.chunk(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT source, count(*) AS documents FROM documents WHERE source NOT IN (SELECT source FROM embed_items WHERE source IS NOT NULL) OR source IS NULL GROUP BY 1")
def embedding_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Documents of sources that have no chunk stored yet."""
    left = semantic.not_yet_embedded(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "embed_items"), "source")
    return left.groupBy("source").agg(F.count("*").alias("documents"))


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 80) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents)")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scalars.snippet(F.col("text"), 80).alias("snippet"))


# ------------------------------------------------------------------------------------------------ folds


def _seq_events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "user_id", "event_type", "value")


@query("SELECT user_id, max_by(event_type, ((epoch_us(ts) // 1000), event_id)) AS event_type FROM events GROUP BY 1")
def fold_latest(spark: SparkSession, d: str) -> DataFrame:
    return folds.latest(_seq_events(spark, d), "user_id", F.struct("ms", "event_id"), "event_type")


@query("SELECT user_id, max(event_id) AS last FROM events GROUP BY 1 ORDER BY last DESC LIMIT 8")
def fold_recents(spark: SparkSession, d: str) -> DataFrame:
    return folds.recents(_seq_events(spark, d), "user_id", F.col("event_id"))


@query("SELECT user_id, max(event_id) AS since FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(*) % 2 = 1")
def fold_stars(spark: SparkSession, d: str) -> DataFrame:
    return folds.stars(_seq_events(spark, d).where("event_type = 'click'"), "user_id", F.col("event_id"))


@query(
    """SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(note, event_id) FILTER (WHERE note <> '') AS note, min(event_id) AS arrived FROM (SELECT *, CASE WHEN event_type = 'error' THEN props ELSE '' END AS note FROM events) GROUP BY 1"""
)
def fold_agenda(spark: SparkSession, d: str) -> DataFrame:
    """The last status of each item, with the last note that said anything."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "error", F.col("props")).otherwise("").alias("note"))
    return folds.agenda(e, "user_id", "event_id", "event_type", ["note"])


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS r FROM events) WHERE r = 1 OR event_type IS DISTINCT FROM p")
def dedupe_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return folds.drop_repeats(_seq_events(spark, d), ["ms", "event_id"], ["event_type"], "user_id").select("event_id")


@query()
def story_fold(spark: SparkSession, d: str) -> DataFrame:
    """The steps of each user's events told shortly."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "built").when(F.col("event_type") == "view", "inspected").otherwise(F.col("event_type"))
    e = _seq_events(spark, d).select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("value") / 25).cast("int").cast("string").alias("subject"), F.lit("").alias("detail"))
    return folds.story(e, "task", "seq")


@query("SELECT user_id, max(event_id) + 1 AS next FROM events GROUP BY 1")
def sync_have_map(spark: SparkSession, d: str) -> DataFrame:
    return folds.have_map(table(spark, d, "events"), "user_id", "event_id")


@query("SELECT event_id, event_type FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND event_id >= 100")
def sync_events_from(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return folds.events_from(e, "user_id", "event_id", e.agg(F.min("user_id")).first()[0], 100).select("event_id", "event_type")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 1) QUALIFY l_linenumber = row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def sync_contiguous(spark: SparkSession, d: str) -> DataFrame:
    """Of each order the lines that go on without a gap from the first."""
    return folds.contiguous(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 1)


# ------------------------------------------------------------------------------------------------ layers


def _entries(s: SparkSession, d: str) -> DataFrame:
    """Customers as entries: a layer by segment, deleted where the balance is negative."""
    c = table(s, d, "customer")
    layer = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "AUTOMOBILE", 1).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(3)
    return c.select(layer.alias("layer"), F.col("c_nationkey").alias("key"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("value"), (F.col("c_acctbal") < 0).alias("deleted"), F.col("c_custkey").alias("seq"))


_ENTRIES = """e AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS layer, c_nationkey AS key, CASE WHEN c_acctbal >= 0 THEN c_name END AS value, c_acctbal < 0 AS deleted, c_custkey AS seq FROM customer)"""
_VISIBLE = "SELECT key, value, layer FROM {} QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer, seq DESC) = 1 AND NOT deleted"


@query(f"WITH {_ENTRIES} {_VISIBLE.format('e')}")
def layers_resolve(spark: SparkSession, d: str) -> DataFrame:
    return layers.resolve(_entries(spark, d))


@query(
    f"""WITH {_ENTRIES}, a AS ({_VISIBLE.format('(SELECT * FROM e WHERE layer <> 0)')}), b AS ({_VISIBLE.format('e')})
    SELECT coalesce(a.key, b.key) AS key, a.value AS base, b.value AS branch FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value OR a.key IS NULL OR b.key IS NULL"""
)
def layers_diff(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return layers.diff(layers.fork(e), e)


@query(
    f"""WITH {_ENTRIES}, v AS ({_VISIBLE.format('e')}), k AS (SELECT DISTINCT key FROM e) SELECT k.key, v.value FROM k JOIN v ON v.key = k.key"""
)
def layers_promote(spark: SparkSession, d: str) -> DataFrame:
    """Everything visible promoted; of the shared layer alone the same is seen."""
    e = _entries(spark, d)
    up = layers.promote(e, e.select("key").distinct(), 10**12)
    return layers.resolve(up.where(F.col("layer") == layers.SHARED)).select("key", "value")


# ------------------------------------------------------------------------------------------------ authored lenses and joins


@query("SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_join_lens(spark: SparkSession, d: str) -> DataFrame:
    """A lens over one table that asks another."""
    cat = Catalog(spark)
    cat.register("customer", table(spark, d, "customer").select("c_custkey", "c_name"))
    cat.register("orders", table(spark, d, "orders"))
    lens = cat.make_lens("Big spenders", "customer", lambda rows, other: joins.semi_join(rows, other("orders").where("o_totalprice > 100000"), "c_custkey", "o_custkey"))
    return lens.df


@query("SELECT DISTINCT n_name, c_acctbal, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 AND n_regionkey = 1")
def lens_chain(spark: SparkSession, d: str) -> DataFrame:
    """A lens in SQL over a lens that is a function."""
    cat = Catalog(spark)
    cat.register("customer", table(spark, d, "customer"))
    cat.register("nation", table(spark, d, "nation"))
    cat.make_lens("rich", "customer", lambda rows, other: rows.where("c_acctbal > 5000"))
    out = cat.make_lens("rich abroad", "the lens: rich", "SELECT n_name, c_acctbal, c_custkey FROM rows JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
    return out.df


@query("SELECT o_orderkey, count(*) AS suppliers, min(s_suppkey) AS first FROM orders JOIN supplier ON o_totalprice BETWEEN s_acctbal * 20 AND s_acctbal * 20 + 500 GROUP BY 1")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """In how many suppliers' intervals of price each order is, and the first of them."""
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") * 20).alias("lo"), (F.col("s_acctbal") * 20 + 500).alias("hi"))
    met = joins.interval_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), s, "o_totalprice", "lo", "hi", 500.0)
    return met.groupBy("o_orderkey").agg(F.count("*").alias("suppliers"), F.min("s_suppkey").alias("first"))


@query(
    """WITH w AS (SELECT regexp_extract(name, '([0-9]+_[0-9]+-[A-Z]-[0-9]+)-[0-9]{5}', 1).replace('_', '/') AS well, count(DISTINCT scan_id) AS documents FROM scanned_docs GROUP BY 1),
    l AS (SELECT DISTINCT uidlog, trim(regexp_replace(upper(namewell), '^NO\\s+', '')) AS well FROM log_curves) SELECT uidlog, CAST(sum(documents) AS BIGINT) AS documents FROM l JOIN w USING (well) GROUP BY 1"""
)
def normalized_join(spark: SparkSession, d: str) -> DataFrame:
    """How many scanned documents there are of each log's well, however its name is written."""
    logs = table(spark, d, "log_curves").select("uidlog", scalars.normalize_well(F.col("namewell")).alias("namewell")).distinct()
    docs = table(spark, d, "scanned_docs").select("scan_id", F.regexp_replace(F.regexp_extract("name", r"([0-9]+_[0-9]+-[A-Z]-[0-9]+)-[0-9]{5}", 1), "_", " / ").alias("well"))
    per_well = docs.groupBy("well").agg(F.countDistinct("scan_id").alias("documents"))
    return joins.normalized_join(logs, per_well, "namewell", "well").groupBy("uidlog").agg(F.sum("documents").alias("documents"))


@query(
    """WITH d AS (SELECT DISTINCT coalesce(type, '') AS kind, trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')) AS source, subtype AS name FROM asset_events)
    SELECT kind, source, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE name IS NOT NULL)), ', '), '') AS names FROM d GROUP BY ALL"""
)
def definition_registry(spark: SparkSession, d: str) -> DataFrame:
    """Texts by content: equal ones are one definition, under all its names."""
    from lensframe.plans.catalog import definitions

    rows = table(spark, d, "asset_events").select(F.coalesce("type", F.lit("")).alias("kind"), F.coalesce("description", F.lit("")).alias("source"), F.lit(None).cast("string").alias("deps"), F.col("subtype").alias("name"))
    return definitions(rows).select("kind", "source", F.array_join("names", ", ").alias("names"))


@query(
    """SELECT p_partkey, CASE WHEN abs(p_retailprice) >= 1000 OR p_retailprice = floor(p_retailprice) THEN format('{:,}', CAST(floor(p_retailprice + 0.5) AS BIGINT)) ELSE
    regexp_replace(CAST(round(p_retailprice * pow(10, 3 - floor(log10(p_retailprice)))) / pow(10, 3 - floor(log10(p_retailprice))) AS VARCHAR), '\\.0$', '') END AS num, format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) AS whole FROM part"""
)
def scalar_formats(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as they are shown."""
    p = table(spark, d, "part")
    return p.select("p_partkey", scalars.fmt_num(F.col("p_retailprice")).alias("num"), scalars.fmt_int(F.col("p_retailprice")).alias("whole"))


@query(
    """SELECT DISTINCT id, CASE WHEN starttime > 946684800000 AND starttime < 4102444800000 THEN starttime END AS ms, CASE WHEN starttime IS NULL OR starttime = 0 THEN '' ELSE strftime(make_timestamp(starttime * 1000), '%Y-%m-%d') END AS day
    FROM asset_events"""
)
def scalar_when(spark: SparkSession, d: str) -> DataFrame:
    """Which numbers are times, and their dates."""
    from pyspark.sql import types as T

    e = table(spark, d, "asset_events")
    return e.select("id", F.unix_millis(scalars.as_when(F.col("starttime"), T.LongType())).alias("ms"), scalars.fmt_date(F.col("starttime")).alias("day")).distinct()


@query("SELECT table_name AS source, CAST(count(DISTINCT column_name) AS INTEGER) AS gaps FROM duckdb_columns() WHERE table_name IN ('customer', 'nation', 'region') GROUP BY 1")
def gap_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Untitled columns per source, the most first."""
    columns = spark.createDataFrame([(n, c) for n in ("customer", "nation", "region") for c in table(spark, d, n).columns], "source string, field string")
    return profile.gap_backlog(columns, spark.createDataFrame([], "source string, field string, fact string, value string")).select("source", F.col("gaps").cast("int").alias("gaps"))


@query(
    """SELECT user_id, coalesce(e.n, 0) AS errors, o.n AS others FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1) o LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) e USING (user_id)"""
)
def event_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Derived counts beside the inputs that they come from."""
    e = table(spark, d, "events")
    per = lambda c: e.where(c).groupBy("user_id").agg(F.count("*").alias("n"))
    raw = per("event_type = 'error'").select(F.col("user_id").alias("seq"), "n")
    out = folds.lineage(raw, per("event_type <> 'error'").select(F.col("user_id").alias("input_seq"), F.col("n").alias("others")))
    return out.select(F.col("input_seq").alias("user_id"), F.coalesce("input_n", F.lit(0)).alias("errors"), "others")


@query(
    """SELECT doc_id, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS canon, CASE WHEN uidwell IS NULL THEN NULL ELSE trim(regexp_replace(regexp_replace(regexp_replace(upper(uidwell), '^NO\\s+', ''), '\\s*/\\s*', '/', 'g'), '\\s+', ' ', 'g')) END AS well,
    left(sha256(CAST(octet_length(CAST(source AS BLOB)) AS VARCHAR) || ':' || source), 16) AS hash FROM documents"""
)
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", scalars.canon(F.col("source")).alias("canon"), scalars.normalize_well(F.col("uidwell")).alias("well"), scalars.content_hash(F.col("source")).alias("hash"))


@query("SELECT o_orderkey, o_totalprice, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus FROM orders")
def infer_types(spark: SparkSession, d: str) -> DataFrame:
    """Text cells cast to what all of a column are."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")
    return scalars.infer_types(o.select(*(F.col(c).cast("string").alias(c) for c in o.columns)))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_append_count(spark: SparkSession, d: str) -> DataFrame:
    """Counts maintained over a stream of files, batch by batch."""
    import uuid

    from lensframe.operators.lenses import Count as CountLens
    from lensframe.session import checkpoint_dir, cut
    from lensframe.streaming.live import GrowingTable

    where = f"{checkpoint_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
    source = table(spark, d, "events").select("event_id", "event_type")
    source.write.parquet(f"{where}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    state = {"rows": zset.from_rows(source.limit(0)), "out": CountLens("event_type", "n").forward(zset.from_rows(source.limit(0)))}

    def step(delta: DataFrame, number: int) -> None:
        state["rows"] = cut(zset.plus(state["rows"], delta))
        state["out"] = cut(zset.plus(state["out"], CountLens("event_type", "n").delta([delta], [state["rows"]])))

    grown = GrowingTable(spark, where)
    grown.watch(step)
    grown.run(stream, "snapshot").awaitTermination()
    return zset.support(state["out"])
