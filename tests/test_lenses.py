import random

import pytest
from pyspark.sql import functions as F

from lensframe.operators import zset
from lensframe.operators.lenses import Calibrate, Count, Filter, Join, Map, NotInvertible, TopK
from lensframe.plans.graph import Graph


def z(spark, rows, schema="id int, site string, temp double"):
    return zset.from_rows(spark.createDataFrame(rows, schema)) if rows else zset.from_rows(spark.createDataFrame([], schema))


def state(df):
    cols = sorted(df.columns)
    return sorted(((tuple(r[c] for c in cols)) for r in df.collect()), key=repr)


def test_nets_to_nothing_is_empty(spark):
    a = z(spark, [(1, "N", 2.0), (1, "N", 2.0), (2, None, None)])
    assert zset.weight(a, {"id": 1, "site": "N", "temp": 2.0}) == 2 and zset.weight(a, {"id": 2, "site": None, "temp": None}) == 1 and zset.weight(a, {"id": 9, "site": None, "temp": None}) == 0
    assert zset.is_empty(zset.minus(a, a)) and zset.equals(a, zset.plus(a, zset.neg(zset.minus(a, a))))
    assert zset.size(zset.neg(a)) == 2 and zset.support(zset.neg(a)).count() == 0
    assert state(zset.from_wire(zset.to_wire(a), "id int, site string, temp double")) == state(a)


LENSES = {
    "calibrate": (lambda: Calibrate("temp", 2.0), 1),
    "filter": (lambda: Filter(F.col("temp") > 50), 1),
    "map": (lambda: Map("lower", lambda d: d.withColumn("site", F.lower("site")).select("site", zset.WEIGHT)), 1),
    "count": (lambda: Count("site"), 1),
    "topk": (lambda: TopK("temp", 3, tie=("id", "site")), 1),
    "join": (lambda: Join("site", "site", ["id"], ["temp"], "r_"), 2),
}


@pytest.mark.parametrize("name", LENSES)
def test_incremental_equals_recompute(spark, name):
    make, arity = LENSES[name]
    lens, rng = make(), random.Random(name)
    row = lambda: (rng.randrange(5), rng.choice(["N", "S", None]), rng.choice([10.0, 60.0, 70.0, None]))
    rows = [[row() for _ in range(12)] for _ in range(arity)]
    before = [z(spark, r) for r in rows]
    deltas = [zset.plus(z(spark, [row() for _ in range(4)]), zset.neg(z(spark, r[:3]))) for r in rows]
    after = [zset.plus(a, d) for a, d in zip(before, deltas)]
    got = zset.plus(lens.forward(*before), lens.delta(deltas, after))
    assert state(got) == state(zset.consolidate(lens.forward(*after)))


def test_backward_of_forward(spark):
    a = z(spark, [(1, "N", 58.0), (2, "S", 44.0)])
    assert state(Calibrate("temp", 2.0).backward(Calibrate("temp", 2.0).forward(a), [])[0]) == state(a)
    with pytest.raises(NotInvertible):
        Count("site").backward(a, [])


def milestone(spark):
    g = Graph()
    assets, readings = spark.createDataFrame([("a", "Pump", "N"), ("b", "Fan", "S")], "id string, name string, site string"), spark.createDataFrame([("a", 58.0), ("b", 44.0)], "asset string, temp double")
    g.source("assets", assets)
    g.source("readings", readings, external=True)
    g.apply("calibrated", Calibrate("temp", 2.0), "readings")
    g.apply("warm", Filter(F.col("temp") >= 40), "calibrated")
    g.apply("joined", Join("id", "asset", ["name"], ["temp"]), "assets", "warm")
    g.submit("assets", zset.from_rows(assets), author="a")
    g.submit("readings", zset.from_rows(readings), author="b")
    return g


def test_loop_forward_backward_and_cutoff(spark):
    g = milestone(spark)
    joined = {r.id: r.temp for r in g.state_of("joined").collect()}
    assert joined == {"a": 60.0, "b": 46.0}
    old = g.state_of("joined").where("id = 'a'").drop(zset.WEIGHT)
    g.push_backward("joined", zset.update(old, old.withColumn("temp", F.lit(75.0))), author="ui")
    out = g.drain_outbox()
    assert [(n, sorted((r.asset, r.temp, r["_w"]) for r in d.collect())) for n, d, _ in out] == [("readings", [("a", 58.0, -1), ("a", 73.0, 1)])]
    # a change that the filter does not pass stops there; an empty one and an echo do nothing
    cold = zset.from_rows(spark.createDataFrame([("c", 1.0)], "asset string, temp double"))
    assert g.submit("readings", cold) == ["readings", "calibrated"]
    assert g.submit("readings", zset.minus(cold, cold)) == [] and g.submit("readings", cold, origin="echo") == []
    g.expect_echo("k")
    assert g.submit("readings", cold, key="k") == [] and g.submit("readings", zset.neg(cold), key="k") != []
    assert [e["author"] for e in g.blame("assets")] == ["a"]
    with pytest.raises(ValueError):
        g.apply("bad", Count("x"), "assets", "readings")
