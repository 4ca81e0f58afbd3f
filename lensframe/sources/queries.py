"""Queries of the readers and sinks: tables written in each format and read back, against SQL over the tables themselves."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.operators import folds, semantic, series
from lensframe.plans.catalog import Catalog
from lensframe.plans.queries import registry
from lensframe.session import table
from lensframe.sources import binary_formats, dispatch, sink, text_formats, xml_formats

QUERIES, ORACLES, query = registry()

_EVENTS = "SELECT DISTINCT id, nullif(trim(type), '') AS type, starttime, nullif(trim(assetids), '') AS assetids, nullif(trim(description), '') AS description FROM asset_events"


def _events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "asset_events").select("id", "type", "starttime", "assetids", "description").distinct()
    return e.select("id", *(F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in ("type", "assetids", "description")), "starttime")


@query(_EVENTS)
def read_csv(spark: SparkSession, d: str) -> DataFrame:
    """Asset events as CSV and back: quotes, doubled quotes and delimiters in fields, blanks, numbers by inference."""
    where = sink.folder(spark, "csv")
    _events(spark, d).write.csv(where, header=True, quote='"', escape='"', emptyValue="")
    return text_formats.read_delimited(spark, where).select("id", "type", "starttime", "assetids", "description")


@query("SELECT doc_id, text, lang FROM (SELECT doc_id, nullif(trim(text), '') AS text, nullif(trim(lang), '') AS lang FROM documents) WHERE text IS NOT NULL")
def read_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents with line ends inside of quoted fields."""
    where = sink.folder(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", F.when(F.trim("text") != "", F.trim("text")).alias("text"), F.when(F.trim("lang") != "", F.trim("lang")).alias("lang")).where("text is not null")
    docs.write.csv(where, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return text_formats.read_delimited(spark, where)


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def read_tsv(spark: SparkSession, d: str) -> DataFrame:
    where = sink.folder(spark, "tables") + "/supplier.tsv"
    table(spark, d, "supplier").write.csv(where, header=True, sep="\t")
    return text_formats.read_delimited(spark, where, "\t")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def read_json_list(spark: SparkSession, d: str) -> DataFrame:
    """A file that is one list of objects."""
    rows = [r.asDict() for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]  # 25 rows at any scale
    return dispatch.read_path(spark, sink.write_bytes(spark, sink.folder(spark, "json") + "/nation.json", json.dumps(rows).encode()).removeprefix("file:"))


@query("SELECT id, type, starttime, assetids, description FROM (" + _EVENTS + ")")
def read_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Asset events with an object per line."""
    where = sink.folder(spark, "tables") + "/events.jsonl"
    _events(spark, d).write.json(where)
    return text_formats.read_json_lines(spark, where).select("id", "type", "starttime", "assetids", "description")


@query("SELECT DISTINCT id, parentid, nullif(trim(name), '') AS name FROM assets")
def read_fixed_width(spark: SparkSession, d: str) -> DataFrame:
    """A listing with columns under each other, below a comment."""
    cell = lambda c, n: F.rpad(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")), n, " ")
    rows = table(spark, d, "assets").select("id", "parentid", "name").distinct()
    body = rows.select(F.lit(2).alias("o"), F.concat(cell("id", 20), F.lit("   "), cell("parentid", 20), F.lit("   "), F.coalesce(F.trim("name"), F.lit(""))).alias("line"))
    head = spark.createDataFrame([(0, "# a listing of assets"), (1, f"{'id':20}   {'parentid':20}   name")], "o int, line string")
    lines = head.unionByName(body).withColumn("part", F.lit("all"))
    return text_formats.read_fixed_width(spark, sink.write_lines(lines, sink.folder(spark, "fixed"), "part", ["o", "line"]) + "/part=all")


def _las(s: SparkSession, d: str) -> DataFrame:
    """A well log per brand of parts."""
    p = table(s, d, "part").select(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-").alias("brand"), "p_partkey", "p_size", "p_retailprice")
    body = p.select("brand", F.lit(9).alias("o"), F.col("p_partkey").alias("k"), F.concat_ws("  ", F.col("p_partkey").cast("string"), F.coalesce(F.col("p_size").cast("string"), F.lit("-999.25")), F.when(F.col("p_partkey") % 7 == 0, "-999.25").otherwise(F.col("p_retailprice").cast("string"))).alias("line"))
    head = ["~Version", " VERS. 2.0 : CWLS", " WRAP. NO : one line", "~Well", " NULL. -999.25 : null", " WELL. @ : well", "~Curve", " DEPT.M : depth", " SIZE.IN : size", " PRICE.USD : price", "~A"]
    heads = p.select("brand").distinct().select("brand", F.posexplode(F.array(*(F.lit(h) for h in head))).alias("k", "h")).select("brand", F.lit(0).alias("o"), F.col("k").cast("bigint").alias("k"), F.replace("h", F.lit("@"), F.col("brand")).alias("line"))
    return heads.unionByName(body)


@query("SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g') AS well, p_partkey AS \"DEPT\", CAST(p_size AS BIGINT) AS \"SIZE\", CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS \"PRICE\" FROM part")
def read_las(spark: SparkSession, d: str) -> DataFrame:
    """Well logs with null values, one file per well."""
    return text_formats.read_las(spark, sink.write_lines(_las(spark, d), sink.folder(spark, "las"), "brand", ["o", "k"]) + "/*/*.txt")


def _xml(rows: DataFrame, root: str, spark: SparkSession) -> str:
    """One XML file per part: ``part, k, line`` between the root's tags."""
    parts = rows.select("part").distinct()
    ends = parts.select("part", F.lit(-1).cast("bigint").alias("k"), F.lit(f'<?xml version="1.0"?><{root} xmlns="urn:x" version="1">').alias("line")).unionByName(parts.select("part", F.lit(2**62).cast("bigint").alias("k"), F.lit(f"</{root}>").alias("line")))
    return sink.write_lines(rows.unionByName(ends), sink.folder(spark, "xml"), "part", ["k"]) + "/*/*.txt"


@query("SELECT CAST(n_nationkey AS BIGINT) AS uid, n_name AS \"nameWell\", c_custkey AS \"no\", c_acctbal AS \"depth.value\" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 2)")
def read_xml_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects with members that repeat: a row per member with its object's context; units and namespaces are dropped."""
    s = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = s.join(s.groupBy("n_nationkey").count().where("count >= 2").select("n_nationkey"), "n_nationkey")
    member = s.select("n_nationkey", (F.col("c_custkey") + 1).alias("o"), F.format_string('<sta><no>%d</no><depth><value uom="m">%s</value></depth></sta>', "c_custkey", F.col("c_acctbal").cast("string")).alias("line"))
    head = s.select("n_nationkey", "n_name").distinct().select("n_nationkey", F.lit(0).alias("o"), F.format_string('<well uid="%d"><nameWell>%s</nameWell><commonData><x>1</x></commonData>', "n_nationkey", "n_name").alias("line"))
    tail = s.select("n_nationkey").distinct().select("n_nationkey", F.lit(2**31).alias("o"), F.lit("</well>").alias("line"))
    rows = head.unionByName(member).unionByName(tail).select(F.lit("all").alias("part"), (F.col("n_nationkey").cast("bigint") * 2**32 + F.col("o")).alias("k"), "line")
    return xml_formats.read_xml(spark, _xml(rows, "wells", spark)).select("uid", "nameWell", "no", "`depth.value`")


@query("SELECT n_name AS well, s_suppkey AS \"KEY\", CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS \"BAL\" FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def read_xml_logs(spark: SparkSession, d: str) -> DataFrame:
    """Logs with their curves and data lines."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    data = s.select("n_nationkey", (F.col("s_suppkey") + 1).alias("o"), F.concat(F.lit("<data>"), F.col("s_suppkey").cast("string"), F.lit(","), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.col("s_acctbal").cast("string")), F.lit("</data>")).alias("line"))
    info = "".join(f"<logCurveInfo uid='u{m}'><mnemonic>{m}</mnemonic></logCurveInfo>" for m in ("KEY", "BAL"))
    head = s.select("n_nationkey", "n_name").distinct().select("n_nationkey", F.lit(0).alias("o"), F.format_string(f"<log><nameWell>%s</nameWell>{info}<logData>", "n_name").alias("line"))
    tail = s.select("n_nationkey").distinct().select("n_nationkey", F.lit(2**31).alias("o"), F.lit("</logData></log>").alias("line"))
    rows = head.unionByName(data).unionByName(tail).select(F.lit("all").alias("part"), (F.col("n_nationkey").cast("bigint") * 2**32 + F.col("o")).alias("k"), "line")
    return xml_formats.read_xml(spark, _xml(rows, "logs", spark)).select("well", "KEY", "BAL")


@query("SELECT 'CD_SUPPLIER' AS family, s_suppkey AS supplier_id, s_name AS supplier_name, CAST(s_nationkey AS BIGINT) AS nation FROM supplier UNION ALL SELECT 'CD_NATION', NULL, n_name, CAST(n_nationkey AS BIGINT) FROM nation")
def read_xml_export(spark: SparkSession, d: str) -> DataFrame:
    """An export of elements that have attributes only."""
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.format_string('<CD_SUPPLIER supplier_id="%d" supplier_name="%s" nation="%d"/>', "s_suppkey", "s_name", "s_nationkey").alias("line"))
    b = table(spark, d, "nation").select((F.col("n_nationkey") + 2**40).alias("k"), F.format_string('<CD_NATION supplier_name="%s" nation="%d"/>', "n_name", "n_nationkey").alias("line"))
    rows = a.unionByName(b).withColumn("part", F.lit("all"))
    return xml_formats.read_xml(spark, _xml(rows, "export", spark)).select("family", "supplier_id", "supplier_name", "nation")


def _workbook(rows: list[list[object]]) -> bytes:
    """A workbook of one sheet: texts shared, numbers, booleans, and cells left out."""
    shared: list[str] = []
    xml = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, str):
                shared.append(f"<si><t>{v}</t></si>")
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
        xml.append(f'<row r="{r}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst>{''.join(shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{''.join(xml)}</sheetData></worksheet>")
    return out.getvalue()


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, n_regionkey = 1 AS first, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey + 0.5 END AS half FROM nation")
def read_xlsx(spark: SparkSession, d: str) -> DataFrame:
    rows: list[list[object]] = [["key", "name", "first", "half", None]]
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():  # 25 rows at any scale
        rows.append([r["n_nationkey"], r["n_name"], r["n_regionkey"] == 1, None if r["n_nationkey"] % 4 == 0 else r["n_regionkey"] + 0.5, 7])
    rows.insert(3, [None] * 5)
    return binary_formats.read_workbook(spark, sink.write_bytes(spark, sink.folder(spark, "xlsx") + "/nation.xlsx", _workbook(rows)))


def _pdf(pages: list[str]) -> bytes:
    out = b"%PDF-1.4\n"
    for n, p in enumerate(pages):
        shown = ("BT " + " ".join(f"({w}) Tj" if i % 2 else f"[({w}) -250 (.)] TJ" for i, w in enumerate(p.split())) + " ET").encode("latin-1")
        body = zlib.compress(shown) if n % 2 else shown
        out += f"{n + 1} 0 obj <<{'/Filter /FlateDecode ' if n % 2 else ''}/Length {len(body)}>> stream\n".encode() + body + b"\nendstream endobj\n"
    return out + b"%%EOF"


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS page, 'Nation . ' || n_name || ' of . region ' || n_regionkey || ' .' AS text, 'text-layer' AS via FROM nation")
def read_pdf(spark: SparkSession, d: str) -> DataFrame:
    """A page per content stream, packed or not."""
    pages = [f"Nation {r['n_name'].replace(' ', '~')} of region {r['n_regionkey']}" for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows at any scale
    out = binary_formats.read_document(spark, sink.write_bytes(spark, sink.folder(spark, "pdf") + "/nations.pdf", _pdf(pages)))
    return out.select("page", F.replace("text", F.lit("~"), F.lit(" ")).alias("text"), "via")


def _varint(n: int) -> bytes:
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


@query("SELECT CAST(n_nationkey AS BIGINT) * 1000 + 1700000000000 AS ts, n_regionkey + 0.25 AS value FROM nation")
def read_datapoints(spark: SparkSession, d: str) -> DataFrame:
    """Packed datapoints, nested as a service sends them."""
    points = b""
    for r in table(spark, d, "nation").collect():  # 25 rows at any scale
        p = b"\x08" + _varint(r["n_nationkey"] * 1000 + 1_700_000_000_000) + b"\x11" + struct.pack("<d", r["n_regionkey"] + 0.25)
        points += b"\x0a" + _varint(len(p)) + p
    item = b"\x1a" + _varint(len(points)) + points
    return binary_formats.read_datapoints(spark, sink.write_bytes(spark, sink.folder(spark, "pb") + "/points.pb", b"\x0a" + _varint(len(item)) + item))


@query("SELECT c_custkey, c_name, c_acctbal, lower(c_mktsegment) AS kind FROM customer")
def read_directory(spark: SparkSession, d: str) -> DataFrame:
    """Folders of CSV files as one table with the folder's name; a file that is none is passed over."""
    where = sink.folder(spark, "mount")
    c = table(spark, d, "customer")
    for r in c.select("c_mktsegment").distinct().collect():  # a few segments
        c.where(F.col("c_mktsegment") == r[0]).select("c_custkey", "c_name", "c_acctbal").write.csv(f"{where}/{r[0].lower()}/2024", header=True)
    sink.write_bytes(spark, f"{where}/broken/x.xlsx", b"no workbook")
    return dispatch.read_directory(spark, where.removeprefix("file:")).select("c_custkey", "c_name", "c_acctbal", "kind")


@query("SELECT r_name AS folder, CAST(count(*) AS INTEGER) AS files FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey > 0 GROUP BY 1")
def scan_available(spark: SparkSession, d: str) -> DataFrame:
    """Folders that hold data and are not mounted yet: a folder per region with a file per nation, the first one mounted."""
    where = sink.folder(spark, "available")
    for r in table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).collect():  # 25 rows at any scale
        sink.write_bytes(spark, f"{where}/{r['r_name']}/{r['n_nationkey']}.csv", b"a,b\n1,2\n")
    local = where.removeprefix("file:")
    first = table(spark, d, "region").where("r_regionkey = 0").first()["r_name"]
    return dispatch.available(spark, [local], (f"{local}/{first}",)).select(F.element_at(F.split("path", "/"), -1).alias("folder"), "files")


@query("SELECT event_id AS ts, value FROM events WHERE value IS NOT NULL")
def series_files(spark: SparkSession, d: str) -> DataFrame:
    """A series written and read; headers and lines that do not parse are left out."""
    where = sink.folder(spark, "series")
    series.write_series(table(spark, d, "events").select(F.col("event_id").alias("ts"), "value"), where)
    sink.write_bytes(spark, f"{where}/odd.csv", b"timestamp,value\nno,number\n1\n")
    return series.read_series(spark, where)


@query("SELECT 'nations' AS source, count(*) AS rows FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier")
def mount_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What a manifest names, under its names; paths that are missing are passed over."""
    where = sink.folder(spark, "manifest")
    table(spark, d, "nation").write.csv(f"{where}/a", header=True)
    table(spark, d, "supplier").write.json(f"{where}/supplier")
    entries = [{"name": "nations", "path": "a", "title": "Nations"}, {"path": "supplier"}, {"name": "gone", "path": "nowhere.csv"}]
    local = where.removeprefix("file:")
    manifest = sink.write_bytes(spark, f"{where}/manifest.json", json.dumps(entries).encode()).removeprefix("file:")
    cat = Catalog(spark)
    cat.mount_manifest(manifest)
    assert local
    return spark.createDataFrame([(n, cat.table(n).count()) for n in sorted(cat.sources)], "source string, rows bigint")


_JOURNAL = "SELECT event_id, 'ev' AS k, CASE WHEN user_id % 3 > 0 THEN CAST(user_id AS VARCHAR) END AS o, event_id AS s FROM events"


def _journal(s: SparkSession, d: str) -> DataFrame:
    """Events as journal lines; every third user's have no origin. Written in two appends."""
    where = sink.folder(s, "journal")
    tagged = F.col("user_id") % 3 > 0
    p = F.to_json(F.struct(F.lit("agenda").alias("kind"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("status"), F.col("props").alias("text")))
    rows = table(s, d, "events").select("event_id", F.lit("ev").alias("k"), p.alias("p"), F.when(tagged, F.col("user_id").cast("string")).alias("o"), F.when(tagged, F.col("event_id")).alias("s"))
    half = rows.agg(F.max("event_id") / 2).first()[0] or 0
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        dispatch.append_journal(rows.where(part), where)
    return dispatch.read_journal(s, where)


@query(f"WITH j AS ({_JOURNAL}) SELECT coalesce(o, 'local') AS o, CASE WHEN o IS NULL THEN count(*) ELSE max(s) + 1 END AS next FROM j GROUP BY o")
def journal_have_map(spark: SparkSession, d: str) -> DataFrame:
    """What each origin goes on with; lines without one are numbered by their place as local ones."""
    return folds.have_map(_journal(spark, d), "o", "s")


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS events, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def journal_replay(spark: SparkSession, d: str) -> DataFrame:
    """A journal's events folded again, each once; what is no event is left out."""
    j = _journal(spark, d)
    again = j.unionByName(j).unionByName(j.select(F.lit("effect").alias("k"), "p", "o", "s", "line"))
    state = folds.replay(again, ["agenda"])
    return state.groupBy("key").agg(F.count("*").alias("events"), F.countDistinct("status").alias("kinds"))


@query("SELECT source, count(*) AS chunks, sum(len(vec)) AS numbers FROM embed_items WHERE len(vec) > 0 AND source IS NOT NULL GROUP BY 1")
def embedding_store(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their vectors appended to a store; those of a source that is there are skipped, and so are such without a vector."""
    where = sink.folder(spark, "store")
    items = table(spark, d, "embed_items").where("source is not null").select("source", "text", "vec")
    first = items.agg(F.min("source")).first()[0]
    semantic.append_store(items.where(F.col("source") == first), where)
    semantic.append_store(items, where)
    return semantic.read_store(spark, where).groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.size("vec")).alias("numbers"))
