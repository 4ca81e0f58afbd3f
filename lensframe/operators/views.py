"""Aggregate views: the data that each view of a table shows.

Views read the set of a table's rows. Caps that a view has (the top 20, the last 6 months) are part of the view; nothing else is cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lensframe.functions.scalars import as_when, half_up, normalize_well
from lensframe.operators import detect
from lensframe.operators.series import numbered
from lensframe.operators.zset import support_of

#: Bounds of the views.
BINS_LEAST, BINS_MOST, TOP_VALUES, MONTHS, LANES, CARDS, SLICES, POINTS, SPANS, TEXTS, CLOUD, GROUPS, CURVES = 6, 28, 20, 6, 8, 25, 7, 1500, 36, 30, 4000, 8, 4
EMPTY = "(empty)"


def _label(c: str) -> Column:
    text = F.col(f"`{c}`").cast("string")
    return F.when(text.isNull() | (text == ""), F.lit(EMPTY)).otherwise(text)


def _number(c: Column) -> Column:
    n = c.cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), n)


def _when(df: DataFrame, c: str) -> Column:
    return as_when(F.col(f"`{c}`"), df.schema[c].dataType)


def metric(df: DataFrame, agg: str = "count", field: str | None = None, strict: bool = False) -> DataFrame:
    """``value``: rows, or the sum, mean, least or greatest of a column's numbers.

    A column that is not there gives the number of rows, unless ``strict``. Another name than these gives the count of numbers.
    """
    rows = support_of(df)
    if agg == "count" or field is None or field not in df.columns:
        if strict and agg != "count":
            raise ValueError(f"no such column: {field}")
        return rows.agg(F.count("*").cast("double").alias("value"))
    n = _number(F.col(f"`{field}`"))
    fn = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}.get(agg, F.count)
    return rows.agg(fn(n).cast("double").alias("value"))


def histogram(df: DataFrame, field: str) -> DataFrame:
    """``bin, lo, n``: a column's numbers in 6 to 28 bins of equal width, empty ones too."""
    values = support_of(df).select(_number(F.col(f"`{field}`")).alias("v")).where("v is not null")
    stats = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.countDistinct("v").alias("d")).where("lo is not null")
    stats = stats.withColumn("bins", F.least(F.lit(BINS_MOST), F.greatest(F.lit(BINS_LEAST), F.col("d"))).cast("int")).withColumn("w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")).otherwise(F.lit(1.0)))
    counted = values.crossJoin(F.broadcast(stats)).groupBy(F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) / F.col("w"))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    all_bins = stats.select(F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "lo", "w")
    return all_bins.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lo"), F.coalesce("n", F.lit(0)).alias("n"))


def counts(df: DataFrame, field: str, arrival: str | None = None) -> DataFrame:
    """``label, n, first_seen``: rows per value of a column."""
    first = F.min(arrival) if arrival else F.min(_label(field))
    return support_of(df).groupBy(_label(field).alias("label")).agg(F.count("*").alias("n"), first.alias("first_seen"))


def histogram_categories(df: DataFrame, field: str, arrival: str | None = None, most: int = TOP_VALUES) -> DataFrame:
    """``label, n``: the most frequent values, ties by first arrival (or by value)."""
    return counts(df, field, arrival).orderBy(F.desc("n"), "first_seen", "label").limit(most).select("label", "n")


def calendar(df: DataFrame, field: str, months: int = MONTHS) -> DataFrame:
    """``day, n, shade``: rows per UTC day of the last months that have any; the shade by the counts' quantiles over all days."""
    day = F.to_date(_when(df, field))
    days = support_of(df).select(day.alias("day")).where("day is not null").groupBy("day").agg(F.count("*").alias("n"))
    ordered = days.select(F.col("n")).agg(F.array_sort(F.collect_list("n")).alias("s"))  # one number per day
    at = lambda p: F.element_at("s", F.least(F.size("s") - 1, F.floor(F.lit(p) * F.size("s"))).cast("int") + 1)
    q = ordered.select(at(0.85).alias("q85"), at(0.5).alias("q50"))
    shade = F.when(F.col("n") >= F.col("q85"), "c3").when(F.col("n") >= F.col("q50"), "c2").otherwise("c1")
    month = F.date_trunc("month", "day")
    kept = days.select(month.alias("month")).distinct().orderBy(F.desc("month")).limit(months)
    return days.withColumn("month", month).join(kept, "month", "left_semi").crossJoin(F.broadcast(q)).select("day", "n", shade.alias("shade"))


def heatmap_time(df: DataFrame, field: str) -> DataFrame:
    """``weekday, hour, n``: rows per UTC hour and day of the week (Monday is 0), zeros kept."""
    t = _when(df, field)
    got = support_of(df).where(t.isNotNull()).groupBy(F.weekday(t).alias("weekday"), F.hour(t).alias("hour")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(7 * 24).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(F.broadcast(got), ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def heatmap(df: DataFrame, x: str, y: str, arrival: str | None = None, most: int = 20) -> DataFrame:
    """``x, y, n``: rows per pair of the first values of two columns; rows where one is empty are left out."""
    rows = support_of(df)

    def first(c: str, name: str) -> DataFrame:
        return counts(df, c, arrival).orderBy("first_seen", "label").limit(most).select(F.col("label").alias(name))

    filled = rows.where((F.col(x).cast("string") != "") & (F.col(y).cast("string") != "")).select(F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y"))
    return filled.join(F.broadcast(first(x, "x")), "x", "left_semi").join(F.broadcast(first(y, "y")), "y", "left_semi").groupBy("x", "y").agg(F.count("*").alias("n"))


def kanban(df: DataFrame, lane: str, arrival: str, title: str, lanes: int = LANES, cards: int = CARDS) -> DataFrame:
    """``lane, lane_rank, lane_size, card, title, key``: the largest lanes, each with its first cards in order of arrival."""
    rows = support_of(df)
    sizes = rows.groupBy(_label(lane).alias("lane")).agg(F.count("*").alias("lane_size"), F.min(arrival).alias("f")).orderBy(F.desc("lane_size"), "f").limit(lanes)
    ranked = sizes.withColumn("lane_rank", F.row_number().over(W.orderBy(F.desc("lane_size"), "f"))).drop("f")  # a row per lane
    in_lanes = rows.select(_label(lane).alias("lane"), F.col(arrival).alias("key"), F.col(title).alias("title")).withColumn("card", F.row_number().over(W.partitionBy("lane").orderBy("key")))
    return in_lanes.where(F.col("card") <= cards).join(F.broadcast(ranked), "lane").select("lane", "lane_rank", "lane_size", "card", "title", "key")


def donut(df: DataFrame, field: str, arrival: str | None = None, most: int = SLICES) -> DataFrame:
    """``label, n, pct``: the largest slices; beyond seven the rest is one slice."""
    c = counts(df, field, arrival)
    top = c.orderBy(F.desc("n"), "first_seen", "label").limit(most).select("label", "n")
    total = c.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    shown = top.agg(F.sum("n").alias("shown"), F.count("*").alias("slices"))
    rest = total.crossJoin(shown).where(F.col("kinds") > F.col("slices")).select(F.concat((F.col("kinds") - F.col("slices")).cast("string"), F.lit(" others")).alias("label"), (F.col("total") - F.col("shown")).alias("n"))
    return top.unionByName(rest).crossJoin(F.broadcast(total)).select("label", "n", half_up(F.lit(100.0) * F.col("n") / F.col("total")).alias("pct"))


def scatter(df: DataFrame, x: str, y: str, order: str, points: int = POINTS) -> DataFrame:
    """``x, y``: rows with both numbers; of more than ``points`` every n-th in the given order."""
    both = support_of(df).select(_number(F.col(f"`{x}`")).alias("x"), _number(F.col(f"`{y}`")).alias("y"), F.col(f"`{order}`").alias("__k")).where("x is not null and y is not null")
    placed = numbered(both, None, ["__k"])
    return placed.where((F.col("n") <= points) | (F.col("i") % F.ceil(F.col("n") / points) == 0)).select("x", "y")


def geo(df: DataFrame, lon: str, lat: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Points, and ``aspect``: how much narrower a degree is at the middle latitude."""
    points = scatter(df, lon, lat, order)
    mid = points.agg(((F.min("y") + F.max("y")) / 2).alias("mid"))
    return points, mid.select(F.greatest(F.lit(0.2), F.cos(F.radians("mid"))).alias("aspect"))


def gantt(df: DataFrame, start: str, end: str, title: str, lane: str | None = None, most: int = SPANS) -> DataFrame:
    """``title, lane, from_time, to_time``: the latest spans, in order of their start."""
    a, b = _when(df, start), _when(df, end)
    rows = support_of(df).select(F.col(title).alias("title"), (_label(lane) if lane else F.lit(None).cast("string")).alias("lane"), a.alias("from_time"), b.alias("to_time"))
    return rows.where("from_time is not null and to_time >= from_time").orderBy(F.desc("from_time"), "title").limit(most).orderBy("from_time", "title")


def cloud(df: DataFrame, x: str, y: str, z: str, order: str, group: str | None = None, points: int = CLOUD) -> DataFrame:
    """``x, y, z, grp``: three numbers scaled to -0.5..0.5; of more than ``points`` every n-th; the first eight groups are named."""
    axes = {"x": x, "y": y, "z": z}
    label = _label(group) if group else F.lit("")
    rows = support_of(df).select(*(_number(F.col(f"`{c}`")).alias(k) for k, c in axes.items()), F.col(f"`{order}`").alias("__k"), label.alias("grp")).where("x is not null and y is not null and z is not null")
    placed = numbered(rows, None, ["__k"])
    placed = placed.where((F.col("n") <= points) | (F.col("i") % F.ceil(F.col("n") / points) == 0))
    span = rows.agg(*(F.min(k).alias(f"lo_{k}") for k in axes), *(F.max(k).alias(f"hi_{k}") for k in axes))
    named = rows.groupBy("grp").agg(F.min("__k").alias("f")).orderBy("f", "grp").limit(GROUPS).select("grp", F.lit(True).alias("named"))
    width = lambda k: F.when(F.col(f"hi_{k}") > F.col(f"lo_{k}"), F.col(f"hi_{k}") - F.col(f"lo_{k}")).otherwise(1.0)
    return placed.crossJoin(F.broadcast(span)).join(F.broadcast(named), "grp", "left").select(*(((F.col(k) - F.col(f"lo_{k}")) / width(k) - 0.5).alias(k) for k in axes), F.when(F.col("named"), F.col("grp")).alias("grp"))


def reading(df: DataFrame, prose: str, key: str, date: str | None = None, most: int = TEXTS) -> DataFrame:
    """``key, text``: the first texts, by date where there is one (none is first)."""
    rows = support_of(df).where(F.col(prose).isNotNull() & (F.col(prose) != ""))
    when = F.coalesce(F.unix_micros(_when(df, date)), F.lit(0)) if date else F.lit(0)
    return rows.select(F.col(key).alias("key"), F.col(prose).alias("text"), when.alias("w")).orderBy("w", "key").limit(most).select("key", "text")


def timeline(df: DataFrame, field: str) -> DataFrame:
    """``month, n``: rows per UTC month from the first to the last, zeros kept."""
    t = _when(df, field)
    got = support_of(df).where(t.isNotNull()).groupBy((F.year(t) * 12 + F.month(t) - 1).alias("m")).agg(F.count("*").alias("n"))
    dense = got.agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("m"))
    return dense.join(F.broadcast(got), "m", "left").select(F.concat(F.floor(F.col("m") / 12).cast("string"), F.lit("-"), F.lpad((F.col("m") % 12 + 1).cast("string"), 2, "0")).alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """``id, ancestor, distance``: every node (``id, parent``) with itself and all above it; a parent that is not there ends the way.

    By doubling: each round joins the paths known so far with the longest of them, so a hierarchy of any depth d takes log d rounds. Pairs that are known
    are not found again, so a cycle ends when all of its nodes are each other's ancestors.
    """
    from lensframe.session import cut

    ids = nodes.select("id").distinct()
    link = nodes.where("parent is not null and parent <> id").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").select("id", F.col("parent").alias("ancestor")).distinct()
    known = cut(link.withColumn("distance", F.lit(1)))
    newest = known
    while not newest.isEmpty():
        far = newest.select(F.col("id").alias("a"), F.col("ancestor").alias("id"), F.col("distance").alias("so_far"))
        further = far.join(known, "id").where("ancestor <> a").select(F.col("a").alias("id"), "ancestor", (F.col("distance") + F.col("so_far")).alias("distance"))
        newest = cut(further.groupBy("id", "ancestor").agg(F.min("distance").alias("distance")).join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        known = known.unionByName(newest)
    return ids.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).unionByName(known)


def tree_rollup(nodes: DataFrame, own: DataFrame, measures: list[str]) -> DataFrame:
    """``id, depth`` and for each measure its sum over the node's subtree; ``own`` has ``id`` and the measures of single nodes."""
    up = ancestors(nodes)
    depth = up.groupBy("id").agg(F.max("distance").alias("depth"))
    sums = up.join(own, "id").groupBy(F.col("ancestor").alias("id")).agg(*(F.sum(m).alias(m) for m in measures))
    return depth.join(sums, "id", "left").select("id", "depth", *(F.coalesce(m, F.lit(0)).alias(m) for m in measures))


def depth_log(df: DataFrame, depth: str | None = None, curves: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows by depth with up to four curves, and each curve's range (``curve, lo, hi``); curves are given, or the columns mostly of numbers."""
    shapes = detect.shapes(df)
    depth = depth or detect.depth_field(shapes)
    if depth is None:
        raise ValueError("no depth column")
    chosen = (curves or [c.name for c in shapes if c.numeric and c.name != depth and 2 * c.filled > c.rows])[:CURVES]
    rows = support_of(df).where(_number(F.col(depth)).isNotNull()).select(_number(F.col(depth)).alias("depth"), *(_number(F.col(c)).alias(c) for c in chosen)).orderBy("depth")
    cells = F.array(*(F.struct(F.lit(c).alias("curve"), F.col(c).alias("v")) for c in chosen))
    ranges = rows.select(F.explode(cells).alias("x")).groupBy("x.curve").agg(F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))
    return rows, ranges


def depth_picks(log: DataFrame, picks: DataFrame, depth: str, pick_depth: str, well: str | None = None, pick_well: str | None = None) -> DataFrame:
    """Picks within the log's depths and, where both sides name wells, of a well of the log."""
    span = log.agg(F.min(depth).alias("__lo"), F.max(depth).alias("__hi"))
    inside = picks.crossJoin(F.broadcast(span)).where(F.col(pick_depth).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    if well and pick_well:
        names = log.select(normalize_well(F.col(well)).alias("__n")).distinct()
        inside = inside.withColumn("__n", normalize_well(F.col(pick_well))).join(names, "__n", "left_semi").drop("__n")
    return inside


def gallery(df: DataFrame) -> DataFrame:
    """``name, kb`` of documents."""
    return df.select("name", half_up(F.col("bytes") / 1024.0).alias("kb"))


VIEWS: dict[str, Callable[..., DataFrame]] = {
    "metric": metric, "histogram": histogram, "categories": histogram_categories, "calendar": calendar, "heatmap": heatmap, "heatmap_time": heatmap_time, "kanban": kanban,
    "donut": donut, "scatter": scatter, "gantt": gantt, "3d": cloud, "reading": reading, "timeline": timeline, "gallery": gallery,
}

_BLOCK = re.compile(r"```view\s*\n(.*?)\n```", re.S)


def parse_dashboard(body: str) -> list[dict]:
    """The view blocks of a dashboard's markdown in order; one that is no JSON object is an error with its text."""
    out = []
    for m in _BLOCK.finditer(body):
        try:
            block = json.loads(m.group(1))
        except ValueError as e:
            raise ValueError(f"a view block is no JSON: {m.group(1)[:80]}") from e
        if not isinstance(block, dict) or "view" not in block:
            raise ValueError("a view block needs a view")
        out.append(block)
    return out


def show(view: str, df: DataFrame, **options: object) -> DataFrame:
    """A view of a table by name; ``table`` is the table itself."""
    if view == "table":
        from lensframe.operators.tableview import show as show_table

        return show_table(df, **options)  # type: ignore[arg-type]
    if view not in VIEWS:
        raise ValueError(f"no such view: {view}")
    return VIEWS[view](df, **options)

