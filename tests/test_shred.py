import json

import pytest

from lensframe.operators import shred as S

TREE = {"name": "ns:a", "attrs": {"k": "1", "name": "no element"}, "children": ["t", {"Elem": {"name": "b", "attrs": [["x", "y"], ["z", None]], "children": {"Text": "deep"}}}, {"name": "c", "children": [{"Text": " "}, {"name": "d"}]}]}


def found(spark, trees):
    df = spark.createDataFrame(list(enumerate(trees)), "file_id bigint, tree string")
    e = S.entities(S.shred(df, "tree", ["file_id"]), ["file_id"], {"name": "n"})
    return sorted((r.file_id, r.node_no, r.parent_no, r.n) for r in e.collect())


def test_elements_however_written(spark):
    want = [(1, 0, "ns:a"), (2, 1, "b"), (3, 1, "c"), (4, 3, "d")]
    swapped = json.dumps({"children": TREE["children"], "attrs": TREE["attrs"], "name": TREE["name"]})
    for text in (json.dumps(TREE), json.dumps(json.dumps(TREE)), json.dumps({"Elem": TREE}), swapped):
        assert [x[1:] for x in found(spark, [text])] == want


def test_damaged_and_absent_trees_give_no_row(spark):
    assert found(spark, [None, "", "  ", json.dumps(TREE)[:-3], "[1, 2", "nothing", "5", '"text"', "null"]) == []
    assert S.shred(spark.createDataFrame([], "file_id bigint, tree string"), "tree", ["file_id"]).count() == 0


def test_tables_and_duplicates(spark):
    df = spark.createDataFrame([(1, json.dumps(TREE))] * 2, "file_id bigint, tree string")
    nodes = S.shred(df, "tree", ["file_id"])
    assert S.entities(nodes, ["file_id"], {"name": "n"}).count() == 4
    assert sorted((r.node_no, r.attr_no, r.attr_name, r.attr_value) for r in S.attributes(nodes, ["file_id"]).collect()) == [(1, 1, "k", "1"), (1, 2, "name", "no element"), (2, 1, "x", "y"), (2, 2, "z", None)]
    assert sorted((r.node_no, r.child_no, r.text) for r in S.texts(nodes, ["file_id"]).collect()) == [(1, 1, "t"), (2, 1, "deep")]
    with pytest.raises(ValueError):
        S.shred(df.withColumnRenamed("file_id", "label"), "tree", ["label"])


def test_very_deep_and_round_trip():
    deep = '{"name":"a","children":[' * 30_000 + '{"name":"z"}' + "]}" * 30_000
    assert sum(n[-1] for n in S.nodes_of(S._decode(deep))) == 30_001
    for v in ({"a": [1, {"b": "x\n\\"}, [], {}], "c": None}, [], [[1.5, True]], {}):
        assert S._decode_deep(json.dumps(v)) == v
    for bad in ('{"a":1', "[1,]", '{"a" 1}', "[1 2]", "", "[]x", '{"a":1,}'):
        with pytest.raises(ValueError):
            S._decode_deep(bad)


def test_nothing_is_lost(spark):
    """Nested lists, repeated scalars, objects under several labels: the tables together hold every scalar once."""
    tree = '{"name":"a","tags":["p","q"],"children":[["x"],["y"],[{"name":"b","n":1}]],"logs":[{"name":"L1"},{"name":"L2","tags":["r"]}],"at":{"lat":1.5}}'
    df = spark.createDataFrame([(1, tree, "k"), (1, tree, "k"), (2, "[[1,2],[3]]", "k")], "file_id int, tree string, label string")
    nodes = S.shred(df, "tree", ["file_id"])
    tables = {k: [r.asDict() for r in t.collect()] for k, t in S.related_tables(nodes, ["file_id"]).items()}
    assert sorted(tables) == ["", "/", "/children", "/tags", "at", "children", "logs"]
    assert [(r["ordinal"], r["path"], r["value"]) for r in sorted(tables["/children"], key=lambda r: r["ordinal"])] == [(1, "1.1", "x"), (2, "2.1", "y")]
    assert sorted(r["value"] for r in tables["/tags"]) == ["p", "q"] and [(r["path"], r["value"]) for r in sorted(tables["/"], key=lambda r: r["ordinal"])] == [("1.1", "1"), ("1.2", "2"), ("2.1", "3")]
    assert sorted((r["name"], r["tags"]) for r in tables["logs"]) == [("L1", None), ("L2", "r")] and tables["at"][0]["lat"] == "1.5"
    b = tables["children"][0]
    assert (b["name"], b["n"], b["parent_no"], b["path"]) == ("b", "1", 1, "3.1")
    assert [r.text for r in S.texts(nodes, ["file_id"]).orderBy("child_no").collect()] == ["x", "y"]


def test_entities_in_one_task_as_by_aggregation(spark, data):
    df = spark.read.parquet(f"{data}/xml_docs.parquet")
    a = S.shred_entities(df, "tree", ["file_id"], {"name": "n"}).select("file_id", "node_no", "parent_no", "n")
    b = S.entities(S.shred(df, "tree", ["file_id"]), ["file_id"], {"name": "n"}).select("file_id", "node_no", "parent_no", "n")
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()
    assert S.shred_entities(df.limit(0), "tree", ["file_id"], {"name": "n"}).count() == 0
