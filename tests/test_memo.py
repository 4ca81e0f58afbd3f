from pyspark.sql import functions as F

from lensframe.plans.memo import Memo, fingerprint, governed_random


def test_only_what_changed_is_made_again(spark):
    m = Memo()
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    m.input("a", rows(1, -1, 2))
    m.derived("abs", lambda a: a.select(F.abs("v").alias("v")).distinct(), "a")
    m.derived("sum", lambda a: a.agg(F.sum("v").alias("s")), "abs")
    assert m.get("sum").first()["s"] == 3 and m.runs == {"abs": 1, "sum": 1}
    m.get("sum")
    m.input("a", rows(2, 1, -1))
    m.get("sum")
    assert m.runs == {"abs": 1, "sum": 1}
    m.input("a", rows(1, 2, 2))
    m.get("sum")
    assert m.runs == {"abs": 2, "sum": 1}
    m.input("a", rows(5))
    assert m.get("sum").first()["s"] == 5 and m.runs == {"abs": 3, "sum": 2}
    assert fingerprint(rows(1, 1)) != fingerprint(rows(1)) and fingerprint(rows(1, None)) == fingerprint(rows(None, 1))


def test_governed_random(spark):
    df = spark.range(1000).select("id", governed_random(7, F.col("id")).alias("r"))
    a = {x.id: x.r for x in df.collect()}
    assert a == {x.id: x.r for x in df.repartition(7).collect()} and 0.4 < sum(a.values()) / 1000 < 0.6 and 0 <= min(a.values()) < max(a.values()) < 1
