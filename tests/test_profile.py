import pytest

from lensframe.operators import detect, profile, views
from lensframe.plans.catalog import Catalog, EmptyLens, dashboard, refresh_of, resolve_field


def facts(spark, name, df):
    out = {}
    for r in profile.fold_claims(profile.claims(name, df)).collect():
        out.setdefault(r.field, {})[r.fact] = r.value
    return out


def test_keys_enums_constants_gaps(spark):
    df = spark.createDataFrame([(i, "bar" if i % 2 else "C", "ok", None if i < 3 else "x") for i in range(6)], "id int, unit string, status string, note string")
    f = facts(spark, "sensors", df)
    assert f["id"]["role"] == "key" and f["unit"]["role"] == "enum" and f["status"]["role"] == "constant" and f["status"]["value"] == "ok"
    assert f["note"]["empty"] == "50%" and f["unit"]["values"] == "C, bar"


def test_patterns_and_redundance(spark):
    df = spark.createDataFrame([(i, f"TAG-{i:04d}-AB", f"TAG-{i:04d}-AB" if i else "other") for i in range(1, 9)], "id int, externalId string, name string")
    p = {r.field: (r.pattern, r.coverage) for r in profile.patterns(df, ["externalId"]).collect()}
    assert p == {"externalId": ("TAG-####-AB", 100)}
    assert [(r.field, r.of) for r in profile.redundant(df).collect()] == [("name", "externalId")]
    mixed = spark.createDataFrame([(f"ABCDEF{x}",) for x in "qwertyuiop"], "c string")
    assert [r.pattern for r in profile.patterns(mixed, ["c"]).collect()] == ["starts ABCDEF…"]
    assert profile.patterns(mixed.limit(3), ["c"]).count() == 0


def test_links_and_several_references(spark):
    assets = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 3), (6, 4)], "id int, parentId int")
    series = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 3), (14, 4)], "id int, assetId int")
    events = spark.createDataFrame([(20, "1;2"), (21, "3"), (22, "4;5;6")], "id int, assetIds string")
    got = {(r.source, r.field, r.kind, r.target, r.target_field) for r in profile.links({"assets": assets, "series": series, "events": events}).collect()}
    assert got == {("assets", "parentId", "ref", "assets", "id"), ("series", "assetId", "ref", "assets", "id"), ("events", "assetIds", "refs", "assets", "id")}


def test_catalog_lenses_claims_and_dashboard(spark):
    cat = Catalog(spark)
    df = spark.createDataFrame([(i, "N" if i % 2 else "S", 60.0 + i) for i in range(12)], "turbine_id int, site string, gearbox_temp double")
    cat.register("turbines", df)
    cat.profile("turbines")
    hot = cat.make_lens("the lens: Hot ones", "turbines", lambda rows, table: rows.where("gearbox_temp > 66"))
    assert hot.name == "lens:hot-ones" and hot.df.count() == 5 and cat.chain("lens:hot-ones") == ["lens:hot-ones", "turbines"]
    cat.make_lens("hotter", "hot ones", "SELECT * FROM rows WHERE gearbox_temp > 69")
    assert cat.chain(cat.resolve("hotter")) == ["lens:hotter", "lens:hot-ones", "turbines"]
    with pytest.raises(EmptyLens):
        cat.make_lens("none", "turbines", lambda rows, table: rows.where("gearbox_temp > 9000"))
    with pytest.raises(KeyError):
        cat.make_lens("x", "turbines", lambda rows, table: table("nowhere"))
    cat.annotate("turbines", "gearbox temp", title="Temperature", description="of oil")
    with pytest.raises(KeyError):
        cat.annotate("turbines", "no field", title="x")
    assert cat.semantics("lens:hotter", "gearbox_temp")["title"] == "Temperature"
    assert resolve_field(df, "Temperature", cat.titles("turbines")) == "gearbox_temp"
    assert {r.field for r in cat.gaps().where("source = 'turbines'").collect()} == {"turbine_id", "site"}
    assert cat.first_gap() == ("turbines", ["turbine_id", "site"], 2)
    body = 'Text\n```view\n{"view": "metric", "source": "turbines", "agg": "max", "field": "gearbox_temp"}\n```\n```view\n{"view": "donut", "source": "turbines", "field": "site"}\n```\n'
    out = dashboard(cat, body)
    assert out[0][1].first().value == 71.0 and {(r.label, r.pct) for r in out[1][1].collect()} == {("N", 50), ("S", 50)}
    assert refresh_of(["snapshot", "interval 30", "interval 5"]) == "interval 5" and refresh_of(["odd"]) == "live" and refresh_of(["snapshot"]) == "snapshot"
    nodes, edges = cat.map()
    assert nodes.count() == 3 and {r.kind for r in edges.collect()} == {"derived"}


def test_detectors_and_views(spark):
    df = spark.createDataFrame(
        [(i, ["open", "done"][i % 2], 1_600_000_000_000 + i * 86_400_000, 1_600_000_000_000 + (i + 2) * 86_400_000, 50.0 + i, 5.0 + i, "word " * 40) for i in range(12)],
        "id int, status string, started bigint, finished bigint, lat double, lon double, report string",
    )
    s = detect.shapes(df)
    assert detect.lane_field(s) == "status" and detect.geo_pair(s) == ("lon", "lat") and detect.prose_field(s) == "report" and detect.date_field(s) == "started" and detect.span_fields(s, df) == ("started", "finished")
    assert {"gantt", "map", "kanban", "reading"} <= set(detect.available_views(df))
    assert views.gantt(df, "started", "finished", "id").count() == 12
    assert sum(r.n for r in views.calendar(df, "started").collect()) == 12 and sum(r.n for r in views.heatmap_time(df, "started").collect()) == 12
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, v double")
    assert sum(r.n for r in views.histogram(flat, "v").collect()) == 2
    empty = df.limit(0)
    for f in (views.histogram(empty, "lat"), views.donut(empty, "status"), views.timeline(empty, "started"), views.calendar(empty, "started"), views.kanban(empty, "status", "id", "report")):
        assert f.count() == 0
    assert views.metric(empty, "sum", "lat").first().value is None and views.metric(df, "sum", "nothing").first().value == 12.0
    with pytest.raises(ValueError):
        views.metric(df, "sum", "nothing", strict=True)


def test_tree_with_cycle_and_missing_parent(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 7)], "id int, parent int")
    own = spark.createDataFrame([(1, 1), (3, 5), (4, 2)], "id int, n int")
    got = {r.id: (r.depth, r.n) for r in views.tree_rollup(nodes, own, ["n"]).collect()}
    assert got[1] == (0, 6) and got[2] == (1, 5) and got[3] == (2, 5) and got[4] == (0, 2) and got[7] == (0, 0)
