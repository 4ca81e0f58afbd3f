import math

import numpy as np
import pytest

from lensframe.llm import mixing as M
from lensframe.llm import packing as P
from lensframe.llm import tokens


def brute_fullest(lengths, capacity):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= capacity}
    return max(sums)


def test_fullest_against_all_subsets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        items = sorted(rng.integers(1, 30, rng.integers(1, 9)).tolist(), reverse=True)
        counts = {x: items.count(x) for x in items}
        got = P.fullest(sorted(counts, reverse=True), counts, 40)
        assert got[items[0]] >= 1 and all(n <= counts[x] for x, n in got.items())
        assert sum(x * n for x, n in got.items()) == items[0] + brute_fullest(items[1:], 40 - items[0])


def test_plan_places_everything():
    rng = np.random.default_rng(2)
    h = {int(x): int(n) for x, n in zip(*np.unique(rng.integers(1, 513, 5000), return_counts=True))}
    plan = P.plan(h, 512)
    placed = {}
    for pattern, times in plan:
        assert sum(x * n for x, n in pattern.items()) <= 512
        for x, n in pattern.items():
            placed[x] = placed.get(x, 0) + n * times
    assert placed == h and sum(t for _, t in plan) <= 1.01 * math.ceil(sum(x * n for x, n in h.items()) / 512)
    with pytest.raises(ValueError):
        P.plan({600: 1}, 512)


def test_pack_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 60, 400))] + [(1000, 250), (1001, 100), (1002, 0), (1003, None), (1004, 200)] + [(2000 + i, 7) for i in range(300)]
    df = spark.createDataFrame(rows, "container_no bigint, n bigint")
    out = P.pack(df, "container_no", "n", 100).toDF("doc", "piece_no", "tok_from", "tok_to", "container_no", "fill").toPandas()
    got = out.dropna(subset=["container_no"])
    assert set(out["doc"]) == {r[0] for r in rows} and set(out[out.container_no.isna()]["doc"]) == {1002, 1003}
    size = got.tok_to - got.tok_from + 1
    assert (size.groupby(got["doc"]).sum() == got["doc"].drop_duplicates().map(dict(rows)).set_axis(got["doc"].drop_duplicates()).sort_index()).all()
    fills = size.groupby(got.container_no).sum()
    assert (fills <= 100).all() and (fills == got.groupby("container_no").fill.first()).all()
    assert sorted(got[got["doc"] == 1000].tok_from) == [1, 101, 201] and len(got[got["doc"] == 1001]) == 1 and len(got[got["doc"] == 1004]) == 2
    assert P.pack(df.limit(0), "container_no", "n", 100).count() == 0


def test_pivot_keeps_the_sum_and_the_expectation():
    rng = np.random.default_rng(4)
    sizes, share = rng.integers(1, 50, 40).astype(float), rng.random(40)
    mean = np.zeros(40)
    for _ in range(3000):
        out, held, p = M.pivot(sizes, share, rng)
        if held is not None:
            assert abs((sizes * out).sum() + sizes[held] * p - (sizes * share).sum()) < 1e-6
            out[held] = rng.random() < p
        mean += out / 3000
    assert np.abs(mean - share).max() < 0.06
    sizes[0] = 100_000.0
    out, held, p = M.by_classes(sizes, np.full(40, 0.5), np.random.default_rng(0))
    assert held is None or sizes[held] < 100


def test_budgets():
    t = {"a": (0.5, 1), "b": (0.5, 4), "gone": (0.2, 9), "zero": (0.0, 3)}
    b = M.budgets({"a": 100, "b": 50, "zero": 5}, t)
    assert b == {"a": 100.0, "b": 100.0}
    b = M.budgets({"a": 100, "b": 50}, t, total=260)
    assert b["a"] == 100 and b["b"] == 160 and M.budgets({}, t) == {}


def test_mix_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, ["hot", "hot", "hot", "rare"][i % 4], int(rng.integers(1, 400))) for i in range(3000)] + [(9000, None, 5), (9001, "hot", 0), (9002, "other", 7), (9003, "rare", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, copies bigint")
    targets = spark.createDataFrame([("hot", 0.4, 1), ("rare", 0.4, 3), ("gone", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out = M.mix(df.withColumnRenamed("copies", "n"), "doc_id", "source", "n", targets)
    got = out.toPandas()
    assert got.doc_id.is_unique and (got[got.source == "hot"].copies <= 1).all() and (got[got.source == "rare"].copies <= 3).all() and set(got.source) == {"hot", "rare"}
    s = {r.source: r.actual_share for r in M.shares(out, "source", "n", targets.where("source is not null")).collect()}
    assert abs(s["hot"] - 0.5) < 0.01 and abs(s["rare"] - 0.5) < 0.01 and s["gone"] == 0
    again = M.mix(df.withColumnRenamed("copies", "n").repartition(7), "doc_id", "source", "n", targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert M.mix(df.limit(0).withColumnRenamed("copies", "n"), "doc_id", "source", "n", targets).count() == 0


def test_tree_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 20)
    monkeypatch.setattr(M, "FAN_IN", 4)
    df = spark.createDataFrame([(i, "s" if i % 3 else "t", 10 + i % 7) for i in range(1500)], "doc_id bigint, source string, n bigint")
    targets = spark.createDataFrame([("s", 0.25, 1), ("t", 0.75, 2)], "source string, target_share double, max_repeats int")
    out = M.mix(df, "doc_id", "source", "n", targets)
    s = {r.source: r.actual_share for r in M.shares(out, "source", "n", targets).collect()}
    assert abs(s["s"] - 0.25) < 0.002 and out.count() == out.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = f"/opt/tokenizers/{name}"
    df = spark.createDataFrame([(1, "Drilled to 3,024 m."), (2, None), (3, ""), (4, "ø 水" * 2000)], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in tokens.with_tokens(df, path=path).collect()}
    assert got[1] > 4 and got[2] == 0 and got[3] == 0 and got[4] > 2000


def test_same_vocabulary_same_counts():
    texts = ["Valve 12-PT-55 closed, isn't it?  Yes\n\n ok", "Brønnen ble stengt.", "数据保存"]
    assert tokens.counter("/opt/tokenizers/byte_bpe_50k.tiktoken")(texts) == tokens.counter("/opt/tokenizers/byte_bpe_50k.json")(texts)
