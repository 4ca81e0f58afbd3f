from pyspark.sql import functions as F

from lensframe.operators import cdc, folds, layers, tableview, zset


def test_window_diff_is_least(spark):
    rows = spark.createDataFrame([(i, i % 7, f"v{i}") for i in range(30)], "id int, s int, v string")
    a = tableview.with_place(tableview.window(rows, "s", "id", 0, 8), "s", "id")
    assert tableview.window_diff(a, a, "id", ["v"]).count() == 0
    edited = rows.withColumn("v", F.when(F.col("id") == 7, "new").otherwise(F.col("v")))
    b = tableview.with_place(tableview.window(edited, "s", "id", 0, 8), "s", "id")
    assert [tuple(r) for r in tableview.window_diff(a, b, "id", ["v"]).collect()] == [("set", 7, 1, "v", "new")]
    assert tableview.clamp(500, 5, 40) == (30, 10) and tableview.clamp(-4, 500, 1000) == (0, 120)
    edit = tableview.cell_edit(rows, "id", 3, "v", "x")
    assert sorted((r.v, r["_w"]) for r in edit.collect()) == [("v3", -1), ("x", 1)]


def test_poll_after_own_write_is_empty(spark):
    t = cdc.KeyedTable(spark.createDataFrame([("a", 58.0), ("b", None), (None, 1.0)], "asset string, temp double"), "asset")
    assert t.poll().count() == 3 and t.poll().count() == 0
    old = t.get("a")
    t.write(zset.update(old, old.withColumn("temp", F.lit(73.0))))
    assert t.poll().count() == 0 and t.get("a").first().temp == 73.0
    t.upsert(spark.createDataFrame([("a", 61.0)], "asset string, temp double"))
    assert sorted((r.temp, r["_w"]) for r in t.poll().collect()) == [(61.0, 1), (73.0, -1)]
    t.delete(spark.createDataFrame([("b",)], "asset string"))
    assert [r["_w"] for r in t.poll().collect()] == [-1]


def test_layers(spark):
    e = spark.createDataFrame([], "layer int, key string, value string, deleted boolean, seq bigint")
    kv = lambda *p: spark.createDataFrame(list(p), "key string, value string")
    base = layers.write(e, kv(("k", "shared"), ("x", "1")), layers.SHARED, 1)
    b = layers.delete(layers.write(base, kv(("k", "branch")), layers.BRANCH, 2), kv(("x", "")).select("key"), layers.EPHEMERAL, 3)
    assert {(r.key, r.value, r.layer) for r in layers.resolve(b).collect()} == {("k", "branch", 1)}
    assert {tuple(r) for r in layers.diff(base, b).collect()} == {("k", "shared", "branch"), ("x", "1", None)}
    assert {r.key for r in layers.resolve(layers.drop_ephemeral(b)).collect()} == {"k", "x"}
    up = layers.promote(b, kv(("k", ""), ("x", "")).select("key"), 9)
    assert {(r.key, r.value) for r in layers.resolve(up.where("layer = 3")).collect()} == {("k", "branch")}


def test_folds(spark):
    steps = spark.createDataFrame(
        [("t", 1, "failed", "s", "e1"), ("t", 2, "failed", "s", "e2"), ("t", 3, "built", "s", ""), ("t", 4, "inspected", "q", "a"), ("t", 5, "inspected", "q", "b"), ("t", 6, "note", "n", "x"), ("t", 7, "note", "n", "x"), ("u", 1, "failed", "z", "e")],
        "task string, seq bigint, kind string, subject string, detail string",
    )
    assert sorted((r.task, r.seq, r.kind, r.tries) for r in folds.story(steps, "task", "seq").collect()) == [("t", 3, "built", 3), ("t", 5, "inspected", 1), ("t", 6, "note", 1), ("u", 1, "failed", 1)]
    ev = spark.createDataFrame([("o", 0), ("o", 1), ("o", 1), ("o", 3), ("p", 1)], "o string, s bigint")
    assert sorted(tuple(r) for r in folds.contiguous(ev, "o", "s").collect()) == [("o", 0), ("o", 1)]
    assert {r.o: r.next for r in folds.have_map(ev, "o", "s").collect()} == {"o": 4, "p": 2}
    known = spark.createDataFrame([("a",)], "text string")
    new = spark.createDataFrame([("a", "warn", 1), ("b", "odd", 2), ("b", "warn", 3)], "text string, severity string, seq bigint")
    assert [(r.text, r.severity) for r in folds.new_findings(known, new).collect()] == [("b", "info")]
    notes = spark.createDataFrame([("Check the export pump", "checking export pump now"), ("Check the pump", "other words")], "t string, n string")
    assert [r[0] for r in notes.select(folds.restates(F.col("t"), F.col("n"), 0.5)).collect()] == [True, False]
