"""Queries of the text and vector problems: p2, p4, p7, p8, p9."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensframe.llm import mixing, neighbours, packing, scans, sentences, tokens
from lensframe.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the scanned pages with a running header, a page number, a broken word or a misread character."""
    return scans.defects(scans.learn(_table(spark, sf_dir, "scanned_docs")))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every scanned document, repaired and reflowed into paragraphs."""
    return scans.paragraphs(scans.learn(_table(spark, sf_dir, "scanned_docs")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of text chunks of which one is among the other's five most similar, with a cosine of 0.85 at least."""
    return neighbours.similar_pairs(_table(spark, sf_dir, "embed_items"), "item_id", "vec", 64)


def _sizes(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return cut(tokens.with_tokens(_table(spark, sf_dir, "documents"), "text", keep=["doc_id", *keep]))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of each capacity of pack_limits, with the fill of each container."""
    sizes = _sizes(spark, sf_dir)
    limits = _table(spark, sf_dir, "pack_limits").collect()  # a few named capacities
    return reduce(DataFrame.unionByName, (packing.pack(sizes, "doc_id", "tokens", r["max_tokens"]).withColumn("limit_name", F.lit(r["limit_name"])) for r in limits))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mix with the target shares, and how often each is used."""
    return mixing.mix(_sizes(spark, sf_dir, "source"), "doc_id", "source", "tokens", _table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    return mixing.shares(p8_mix(spark, sf_dir), "source", "tokens", _table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every document as code point positions."""
    return sentences.split_sentences(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each scanned document has, all of them either furniture or text, and that a defect is only ever said of one of them."""
    model = scans.learn(_table(spark, sf_dir, "scanned_docs"))
    lines = cut(model.lines.select("scan_id", F.explode("lines").alias("x")).select("scan_id", "x.page_no", "x.line_no").distinct())
    said = scans.defects(model).join(lines, ["scan_id", "page_no", "line_no"], "left_anti").groupBy("scan_id").agg(F.count("*").alias("astray"))
    return lines.groupBy("scan_id").agg(F.count("*").alias("lines")).join(said, "scan_id", "full").select("scan_id", "lines", F.coalesce("astray", F.lit(0)).alias("astray"))


def p4_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many similar others each item of a vector has: five at most, none of them itself, each at least as much alike as asked, told once."""
    near = neighbours.nearest(_table(spark, sf_dir, "embed_items"), "item_id", "vec", 64, 5, 0.85)
    per = near.groupBy("item").agg(F.count("*").alias("n"), F.countDistinct("other").alias("others"), F.min("cosine").alias("least"), F.count_if(F.col("item") == F.col("other")).alias("itself"))
    return per.agg(F.count_if((F.col("n") > 5) | (F.col("n") != F.col("others")) | (F.col("least") < 0.85) | (F.col("itself") > 0)).alias("wrong"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: every document is in containers once and whole, pieces follow each other, no container holds more than its capacity or other than it says."""
    packed = p7_pack(spark, sf_dir)
    limits = _table(spark, sf_dir, "pack_limits")
    size = F.coalesce(F.col("tok_to") - F.col("tok_from") + 1, F.lit(0))
    docs = packed.groupBy("limit_name", "doc_id").agg(F.count("*").alias("pieces"), F.max("piece_no").alias("last"), F.coalesce(F.max("tok_to"), F.lit(0)).alias("tokens"), F.sum(size).alias("held"))
    docs = docs.join(F.broadcast(limits), "limit_name")
    whole = (F.col("pieces") == F.col("last")) & (F.col("tokens") == F.col("held")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("max_tokens"))))
    by_doc = docs.groupBy("limit_name").agg(F.count("*").alias("documents"), F.count_if(~whole).alias("not_whole"))
    bins = packed.where("container_no is not null").groupBy("limit_name", "container_no").agg(F.sum(size).alias("held"), F.max("fill").alias("fill"), F.min("fill").alias("least")).join(F.broadcast(limits), "limit_name")
    by_bin = bins.groupBy("limit_name").agg(F.count_if((F.col("held") > F.col("max_tokens")) | (F.col("held") != F.col("fill")) | (F.col("fill") != F.col("least"))).alias("wrong_fill"), (F.max("container_no") - F.count("*")).alias("unused_numbers"))
    return by_doc.join(by_bin, "limit_name")


def p8_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source with documents: how many are used more often than may be or come twice, and whether its tokens are as near to the target among what is present as whole documents allow: within its own largest document and the largest of all."""
    targets = _table(spark, sf_dir, "mix_targets")
    sizes = _sizes(spark, sf_dir, "source")
    used = cut(mixing.mix(sizes, "doc_id", "source", "tokens", targets))
    largest = sizes.groupBy("source").agg(F.max("tokens").alias("largest"))
    over = used.join(F.broadcast(targets), "source").groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("too_often"), (F.count("*") - F.countDistinct("doc_id")).alias("twice"), F.sum(F.col("copies") * F.col("tokens")).alias("t"), F.first("target_share").alias("target")).join(largest, "source")
    all_ = over.agg(F.sum("t").alias("all_t"), F.sum("target").alias("all_target"), F.max("largest").alias("any"))
    return over.crossJoin(F.broadcast(all_)).select("source", "too_often", "twice", (F.abs(F.col("t") - F.col("all_t") * F.col("target") / F.col("all_target")) <= F.col("largest") + F.col("any")).alias("near"))


#: White space of all scripts, as both engines write it.
_SPACES = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}\\x{0b}]+"


def p9_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of each document hold all of its text but white space, once and in order."""
    units = p9_found(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_start", "sent_end"))).alias("u"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").join(units, "doc_id")
    told = F.array_join(F.transform("u", lambda x: F.substring(F.col("text"), x["sent_start"], x["sent_end"] - x["sent_start"] + 1)), "")
    return docs.select("doc_id", F.md5(F.regexp_replace(told, _SPACES, "")).alias("content"))


QUERIES = {"p2_lines": p2_lines, "p4_each": p4_each, "p7_containers": p7_containers, "p8_within": p8_within, "p9_rejoined": p9_rejoined, "p7_pack": p7_pack, "p8_mix": p8_mix, "p8_shares": p8_shares, "p4_found": p4_found, "p2_found": p2_found, "p2_paragraphs": p2_paragraphs, "p9_found": p9_found}

ORACLES = {
    "p2_lines": """WITH p AS (SELECT DISTINCT scan_id, name, pages, ocr_pages FROM scanned_docs WHERE pages IS NOT NULL), g AS (SELECT scan_id, unnest(pages) AS page, generate_subscripts(pages, 1) AS page_no FROM p),
    l AS (SELECT scan_id, page_no, unnest(x) AS line, generate_subscripts(x, 1) AS line_no FROM (SELECT scan_id, page_no, string_split_regex(page, '\\r\\n|\\n|\\r') AS x FROM g WHERE page IS NOT NULL))
    SELECT scan_id, count(*) AS lines, 0 AS astray FROM (SELECT DISTINCT scan_id, page_no, line_no FROM l WHERE regexp_matches(line, '\\S')) GROUP BY 1""",
    "p4_each": "SELECT 0 AS wrong WHERE (SELECT count(*) FROM embed_items) > 0",
    "p7_containers": "SELECT limit_name, (SELECT count(*) FROM documents) AS documents, 0 AS not_whole, 0 AS wrong_fill, 0 AS unused_numbers FROM pack_limits",
    "p8_within": "SELECT source, 0 AS too_often, 0 AS twice, true AS near FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE text IS NOT NULL)",
    "p9_rejoined": f"SELECT doc_id, md5(regexp_replace(text, '{_SPACES}', '', 'g')) AS content FROM documents WHERE regexp_replace(text, '{_SPACES}', '', 'g') <> ''",
    "p4_found": """WITH v AS (SELECT DISTINCT item_id, CAST(vec AS DOUBLE[]) AS e FROM embed_items WHERE len(vec) = 64 AND list_max(list_transform(vec, lambda x: abs(x))) > 0),
    s AS (SELECT a.item_id AS i, b.item_id AS j, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.item_id <> b.item_id),
    t AS (SELECT i, j, c FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY c DESC, j) <= 5)
    SELECT DISTINCT least(i, j) AS item_lo, greatest(i, j) AS item_hi FROM t WHERE c >= 0.85""",
}
