import pytest

from lensframe import session
from lensframe.functions import scalars
from lensframe.operators import detect, drift, folds, semantic, series, tableview, views
from lensframe.plans.catalog import Definitions
from lensframe.sources import dispatch
from lensframe.streaming.live import Refresh
from tests.test_drift import COLS, c, rows
from pyspark.sql import functions as F


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session)


def test_journal_lines_without_origin_are_numbered(spark, tmp_path):
    lines = ['{"k":"ev","p":"a"}', "no JSON", '{"k":"ev","p":"b","o":"x","s":4}', '{"k":"ev"}', '{"k":"ev","p":"c","o":"x"}', '{"k":"ev","p":"d"}', '{"k":"ev","p":"e","o":"x","s":2}']
    (tmp_path / "j.jsonl").write_text("\n".join(lines))
    j = dispatch.read_journal(spark, str(tmp_path / "j.jsonl"), "me")
    assert [(r.p, r.o, r.s) for r in j.orderBy("line").collect()] == [("a", "me", 0), ("b", "x", 4), ("d", "me", 1), ("e", "x", 2)]
    assert {r.o: r.next for r in folds.have_map(j, "o", "s").collect()} == {"me": 2, "x": 5}
    (tmp_path / "none.jsonl").write_text("")
    assert dispatch.read_journal(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_refresh_by_policy():
    r = Refresh()
    r.watch("board", {"a": "live"})
    r.watch("page", {"a": "interval 10", "b": "snapshot", "c": "odd"})
    assert r.change("a", 1.0) == ["board"] and r.tick(9.0) == [] and r.tick(10.0) == ["page"] and r.tick(30.0) == []
    assert r.change("b", 31.0) == [] and r.change("c", 32.0) == ["page"] and r.change("nothing", 33.0) == []
    r.change("a", 34.0)
    assert r.tick(41.0) == [] and r.tick(42.0) == ["page"]


def test_tool_calls(spark):
    calls = [(1, 1, '{"tool":"search","args":{"query":"Pump"}}'), (1, 2, '{"tool":"search","args":{"query":"pUMP"}}'), (2, 3, '{"tool":"search","args":{"query":"pump"}}'), (1, 4, '{"tool":"other","args":{}}'), (1, 5, "no JSON"), (1, 6, "no JSON"), (1, 7, None)]
    df = spark.createDataFrame(calls, "turn int, seq int, call string")
    assert sorted(r.seq for r in folds.once_per_turn(df, "turn", "seq", "call").collect()) == [1, 3, 4, 5, 7]
    key = df.select(folds.call_key(F.lit('{"tool":"show","args":{"view":"v","source":"","name":"n"}}')).alias("k")).first().k
    assert key == "show:v:n:"


def test_definitions(spark):
    d = Definitions(spark)
    a = d.publish("f", "lens", "x  +\n1")
    assert d.define("lens", " x + 1 ") == a and d.define("lens", "x + 2") != a and d.define("lens", "x + 1", (a,)) != a
    d.publish("f", "lens", "x + 2")
    assert d.resolve("f") != a and d.get(a) == ("lens", "x + 1", ()) and d.resolve("none") is None
    with pytest.raises(KeyError):
        d.bind_name("g", "nothing")


def test_detector_rules(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c"][i % 3], ["x", "y"][i % 2], None, "2024-01-01", "2024-01-0%d" % (1 + i % 9), "long " * 30) for i in range(12)], "n int, work_status string, q string, title string, seen string, gone string, body string")
    s = detect.shapes(df)
    assert detect.lane_field(s) == "work_status"  # its name holds a known word, though q has fewer values
    assert detect.title_field(s) == "work_status"  # the title column is empty, so the first short text
    assert detect.span_fields(s, df) == ("seen", "gone")  # no name fits, so the first two dates
    assert detect.title_field(detect.shapes(df.select("n"))) == "n" and detect.available_views(df.select("q").limit(0), "events") == ["table", "timeline", "schema"]


def test_places_of_any_order(spark):
    """Texts, nulls, an outlier and many equal values in the order."""
    values = [None, "b", "a", "c", "a", "z" * 50] * 7
    df = spark.createDataFrame([(i % 2, v, i) for i, v in enumerate(values)], "s int, t string, i0 int")
    for name in (None, "s"):
        got = series.numbered(df, name, ["t", "i0"]).collect()
        for part in {r.s for r in got} if name else {None}:
            mine = sorted((r for r in got if name is None or r.s == part), key=lambda r: r.i)
            assert [r.i for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)}
            assert [(r.t is not None, r.t or "", r.i0) for r in mine] == sorted((r.t is not None, r.t or "", r.i0) for r in mine)
    assert series.numbered(df.limit(0), None, ["t"]).count() == 0
    far = spark.createDataFrame([(float(i) if i else 1e300,) for i in range(50)], "x double")
    assert sorted(r.i for r in series.numbered(far, None, ["x"]).collect()) == list(range(50))


def test_ancestors_at_any_depth(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "id int, parent int")
    up = views.ancestors(chain)
    assert up.count() == 150 * 151 // 2 and up.agg(F.max("distance")).first()[0] == 149


def test_long_curves_keep_every_digit(spark):
    data = rows("L", 1, 0, [c("k1", "N", k="long"), c("k2", "GR", k="double")]) + rows("L", 2, 1, [c("k1", "N", k="long"), c("k2", "GR", k="long")])
    curves = spark.createDataFrame(data, COLS)
    lines = spark.createDataFrame([(1, 1, "9007199254740993,1.5"), (2, 1, "7.0,2")], "file_id bigint, line_no int, cells string")
    w = drift.steady_table(curves, lines).orderBy("file_id").collect()
    assert [(r.n, r.gr) for r in w] == [(9007199254740993, 1.5), (7, 2.0)] and w[0].__fields__ == ["uidlog", "file_id", "line_no", "gr", "n"]
    assert drift.steady_table(curves, lines.limit(0)).count() == 0


def test_files_without_time_are_in_order(spark):
    files = spark.createDataFrame([("L", i, None) for i in (9000, 5, 4097, 1)], "s string, f bigint, at timestamp")
    got = {r.f: r.prev_file for r in drift.with_previous(files, "s", "at", "f").collect()}
    assert got == {1: None, 5: 1, 4097: 5, 9000: 4097}


def test_store_viewport_and_entities(spark, tmp_path):
    where = str(tmp_path / "store")
    chunks = spark.createDataFrame([("a", "t", [1.0]), ("a", "u", []), ("b", None, None)], "source string, text string, vec array<float>")
    semantic.append_store(chunks, where)
    semantic.append_store(chunks, where)
    assert [(r.source, r.vec) for r in semantic.read_store(spark, where).collect()] == [("a", [1.0])]
    t = spark.range(30)
    assert [r.id for r in tableview.viewport(t, "id", 100, 5).collect()] == list(range(20, 30)) and tableview.viewport(t, "id", -5, 1000).count() == 30
    assert t.limit(1).select(scalars.decode_entities(F.lit("a &lt; b &amp;lt; &quot;c&quot;")).alias("x")).first().x == 'a < b &lt; "c"'
